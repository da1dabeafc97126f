"""Hash-chained ledgers, Merkle trees over logs, and lookups in them."""

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.scalars import NULL_FIELD, SEPARATOR, canonical, hmac_sha256
from attestry.operators.policy import let
from attestry.sources import cut, small

#: The fields that a MAC covers besides the MAC before it, in order.
FIELDS = ("seq", "document_hash", "doc_no", "signer", "issuer", "level", "indication")
LINE = "seq INT, document_hash STRING, doc_no STRING, signer STRING, issuer STRING, level STRING, indication STRING, prev STRING, mac STRING, _corrupt_record STRING"


def record_from_report(reports: DataFrame) -> DataFrame:
    """Nested reports (report_id, document_hash, signatures array) to one ledger row each: document time stamps are no signers and not counted."""
    signers = F.filter("signatures", lambda s: s["type"] == "signature")
    first = F.get(signers, F.lit(0))
    return reports.select(
        "report_id", "document_hash", first["signer"].alias("signer"), first["level"].alias("level"), first["indication"].alias("indication"),
        F.size(signers).alias("signature_count"), F.exists(signers, lambda s: s["timestamped"]).alias("timestamped"))


def append_ledger(records: DataFrame, key: str, order: str = "ord", tails: DataFrame | None = None) -> DataFrame:
    """Records (ledger_id, order, fields) with seq, prev and mac, appended to ledgers that end with `tails` (ledger_id, seq, mac).

    seq is the last one plus 1 and prev the last MAC; a ledger without a tail starts at 1 with an empty prev. Rows whose document_hash is not a SHA-256 are
    refused. A chain is sequential by definition, so a ledger is one task's work; records stream through it in order and only the last MAC is held.
    """
    hmac_sha256(F.lit(""), key)  # refuses short keys
    columns = [c for c in FIELDS if c != "seq"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, seq, prev = None, 0, ""
        for batch in batches:
            kept, added = [], []
            for n, (own, tail, *fields) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if own != ledger:
                    ledger, seq, prev = own, 0, ""
                if tail is not None:
                    seq, prev = tail["seq"], tail["mac"]
                    continue
                seq, before = seq + 1, prev
                text = SEPARATOR.join([*(NULL_FIELD if x is None else str(x) for x in (seq, *fields)), before])
                prev = hmac.digest(key.encode(), text.encode(), hashlib.sha256).hex()
                kept.append(n)
                added.append((seq, before, prev))
            rows = batch.take(pa.array(kept, pa.int64()))
            new = [pa.array(list(c), k) for c, k in zip(zip(*added) if added else ((), (), ()), (pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([rows.column(0), new[0], *rows.columns[2:], *new[1:]], ["ledger_id", "seq", *columns, "prev", "mac"])

    tail_type = "struct<seq:int,mac:string>"
    rows = records.filter(F.col("document_hash").rlike("^[0-9a-f]{64}$")).select("ledger_id", F.lit(None).cast(tail_type).alias("tail"), *columns, F.col(order).alias("at"))
    if tails is not None:
        no = [F.lit(None).cast("string").alias(c) for c in columns]
        last = tails.select("ledger_id", F.struct(F.col("seq").cast("int").alias("seq"), "mac").alias("tail"), *no, F.lit(None).cast(rows.schema["at"].dataType).alias("at"))
        rows = rows.unionByName(last.join(rows.select("ledger_id"), "ledger_id", "left_semi"))
    dealt = rows.repartition("ledger_id").sortWithinPartitions("ledger_id", F.col("tail").isNull(), "at").drop("at")
    return dealt.mapInArrow(chain, "ledger_id string, seq int, document_hash string, doc_no string, signer string, issuer string, level string, indication string, prev string, mac string")


def ledger_tails(chained: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(ledger_id, seq, mac) of each ledger's last record, after the tails `before`."""
    ends = chained.select("ledger_id", "seq", "mac") if before is None else chained.select("ledger_id", "seq", "mac").unionByName(before)
    return ends.groupBy("ledger_id").agg(F.max_by(F.struct("seq", "mac"), "seq").alias("t")).select("ledger_id", "t.*")


def ledger_lines(chained: DataFrame) -> DataFrame:
    """(ledger_id, pos, line): records as JSON lines."""
    return chained.select("ledger_id", F.col("seq").alias("pos"), F.to_json(F.struct(*FIELDS, "prev", "mac")).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds the fields of each line; a line that is no JSON keeps its place with null fields."""
    return lines.withColumn("r", F.from_json("line", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).select("ledger_id", "pos", "r.*")


def verify_ledger(lines: DataFrame, key: str) -> DataFrame:
    """Lines (positions dense from 1) with ok and broken_at: the first line position whose MAC is wrong or whose prev is not the MAC of the line before; null if all hold.

    Every MAC is checked on its own, and each line meets the one before it by an equality join on ledger and position, so the check of one ledger is
    spread over all tasks, where the append is not.
    """
    x = parse_lines(lines)
    before = x.select("ledger_id", (F.col("pos") + 1).alias("pos"), F.col("mac").alias("mac_before"))
    right = F.coalesce(hmac_sha256(canonical(*map(F.col, FIELDS), F.col("prev")), key) == F.col("mac"), F.lit(False))
    linked = F.coalesce(F.col("prev") == F.when(F.col("pos") == 1, "").otherwise(F.col("mac_before")), F.lit(False))
    checked = cut(x.join(before, ["ledger_id", "pos"], "left").withColumn("ok", right & linked).drop("mac_before"), "ledger-checked")
    broken = checked.filter("NOT ok").groupBy("ledger_id").agg(F.min("pos").alias("broken_at"))
    return checked.join(small(broken), "ledger_id", "left")


def ledger_status(verified: DataFrame) -> DataFrame:
    return verified.groupBy("ledger_id").agg(F.min("broken_at").alias("broken_at"), F.count_if(F.col("broken_at").isNull() | (F.col("pos") < F.col("broken_at"))).alias("records"))


def latest_record(verified: DataFrame, by: str) -> DataFrame:
    """The last record of each value of `by`, within the verified prefix of each ledger."""
    prefix = verified.filter("broken_at IS NULL OR pos < broken_at")
    cols = [c for c in prefix.columns if c != by]
    return prefix.groupBy(by).agg(F.max_by(F.struct(*cols), F.struct("ledger_id", "pos")).alias("r")).select(by, "r.*")


def scan_lookup(claims: DataFrame, verified: DataFrame) -> DataFrame:
    """Claims (claim_id, ledger_id, hash, doc_no, computed) to (claim_id, status, binding): by hash first, then by number, in a ledger that is whole."""
    state = verified.groupBy("ledger_id").agg(F.min("broken_at").alias("broken"))
    last = lambda by: verified.groupBy("ledger_id", F.col(by).alias("k")).agg(F.max_by("indication", "pos").alias("i"))
    h, n = last("document_hash").toDF("ledger_id", "hash", "by_hash"), last("doc_no").toDF("ledger_id", "doc_no", "by_no")
    x = claims.join(state, "ledger_id", "left").join(h, ["ledger_id", "hash"], "left").join(n, ["ledger_id", "doc_no"], "left")
    found = F.coalesce("by_hash", "by_no")
    status = F.when(F.col("broken").isNotNull(), "unavailable").when(found.isNull(), "unverified").when(found == "PASSED", "verified").when(found == "FAILED", "invalid").otherwise("indeterminate")
    binding = F.when(F.col("computed").isNull(), "claimed").when(F.col("computed") == F.col("hash"), "computed").otherwise("mismatch")
    return x.select("claim_id", status.alias("status"), binding.alias("binding"))


def content_dedup(assets: DataFrame) -> DataFrame:
    """(sha, first_id, copies, bytes): equal content once, the first id kept."""
    return assets.groupBy("sha").agg(F.min_by("id", F.struct("ord", "id")).alias("first_id"), F.count("*").alias("copies"), F.first("bytes").alias("bytes"))


def leaf_hash(content: Column) -> Column:
    return F.sha2(F.concat(F.lit(bytearray(b"\0")), F.encode(content, "UTF-8")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit(bytearray(b"\1")), F.unhex(left), F.unhex(right)), 256)


#: Levels that one shuffle folds: 256 neighbours meet in a row.
FOLD = 8


def merkle_root(leaves: DataFrame) -> DataFrame:
    """(root) of leaves (leaf_index dense from 0, hash): pairs are hashed level by level, and an odd last one rises unchanged.

    A shuffle folds 8 levels of 256 neighbours, so 16 million leaves take three.
    """

    def level(a: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(a), node_hash(F.get(a, 2 * i), F.get(a, 2 * i + 1))).otherwise(F.get(a, 2 * i)))

    top = leaves.agg(F.max("leaf_index")).first()[0]
    if top is None:
        return leaves.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("root"))
    x = leaves.select("leaf_index", "hash")
    while top > 0:
        folded = F.transform(F.array_sort(F.collect_list(F.struct("leaf_index", "hash"))), lambda s: s["hash"])
        x = x.groupBy(F.shiftright("leaf_index", FOLD).alias("leaf_index")).agg(folded.alias("a"))
        for _ in range(FOLD):
            x = x.withColumn("a", let(F.col("a"), level))
        x, top = x.select("leaf_index", F.get("a", F.lit(0)).alias("hash")), top >> FOLD
    return x.select(F.col("hash").alias("root"))


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """(level, idx, hash) of all nodes. Each level is written before the one above it is made of it, and has half its rows, so the whole costs twice the leaves."""
    x = cut(leaves.select(F.lit(0).alias("level"), F.col("leaf_index").alias("idx"), "hash"), "merkle-level")
    top, out, k = leaves.agg(F.max("leaf_index")).first()[0] or 0, x, 0
    while top > 0:
        k, top = k + 1, top >> 1
        x = x.groupBy(F.shiftright("idx", 1).alias("i")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.col("hash"))).alias("r"))
        x = cut(x.select(F.lit(k).alias("level"), F.col("i").alias("idx"), F.when(F.col("r").isNull(), F.col("l")).otherwise(node_hash(F.col("l"), F.col("r"))).alias("hash")), "merkle-level")
        out = out.unionByName(x)
    return out


def inclusion_proofs(leaves: DataFrame) -> DataFrame:
    """(leaf_index, size, path): the siblings of each leaf's ancestors, from below; a level without a sibling adds nothing."""
    size = (leaves.agg(F.max("leaf_index")).first()[0] or 0) + 1
    levels = merkle_levels(leaves)
    depth = max(1, (size - 1).bit_length())
    asked = leaves.select("leaf_index", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level"))
    shifted = asked.withColumn("idx", F.expr("shiftright(leaf_index, level)").bitwiseXOR(F.lit(1)))
    met = shifted.join(levels, ["level", "idx"]).groupBy("leaf_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "hash"))), lambda s: s["hash"]).alias("path"))
    return leaves.join(met, "leaf_index", "left").select("leaf_index", F.col("hash").alias("leaf"), F.lit(size).cast("long").alias("size"), F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def verify_inclusion(proofs: DataFrame, root: Column) -> DataFrame:
    """Adds included: the path folded from leaf, leaf_index and size gives the root. An index outside the log is never included."""
    start = F.struct(F.col("leaf").alias("r"), F.col("leaf_index").alias("fn"), (F.col("size") - 1).alias("sn"))

    def step(acc: Column, p: Column) -> Column:
        odd = acc["fn"] % 2 == 1
        left = odd | (acc["fn"] == acc["sn"])
        lowest = acc["fn"].bitwiseAND(-acc["fn"])
        zeros = F.when(left & ~odd & (acc["fn"] > 0), F.bit_count(lowest - 1)).otherwise(0)
        shift = lambda c: F.floor(c / F.pow(F.lit(2.0), zeros + 1)).cast("long")
        return F.struct(F.when(acc["sn"] == 0, F.lit("")).when(left, node_hash(p, acc["r"])).otherwise(node_hash(acc["r"], p)).alias("r"), shift(acc["fn"]).alias("fn"), shift(acc["sn"]).alias("sn"))

    end = F.aggregate("path", start, step)
    return proofs.withColumn("e", end).select(*proofs.columns, ((F.col("e.r") == root) & (F.col("e.sn") == 0) & F.col("leaf_index").between(0, F.col("size") - 1)).alias("included"))


def entry_range(entries: DataFrame, start: int, end: int) -> DataFrame:
    """An inclusive slice of a log."""
    return entries.filter(F.col("leaf_index").between(start, end))
