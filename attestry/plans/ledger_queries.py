"""Queries over ledgers, Merkle logs and audit lines."""

from pyspark.sql import functions as F

from attestry import sources as S
from attestry.functions import scalars as C
from attestry.operators import ledger as L
from attestry.plans.fixtures import view
from attestry.plans.registry import query

KEY = "example-ledger-key-0001"
_BLOB = lambda pad: "'" + "".join(f"\\x{b ^ pad:02X}" for b in KEY.encode().ljust(64, b"\0")) + "'::BLOB"
HMAC = lambda m: f"sha256({_BLOB(0x5C)} || unhex(sha256({_BLOB(0x36)} || encode({m}))))"
_FIELDS = "r.seq || chr(31) || r.document_hash || chr(31) || r.doc_no || chr(31) || r.signer || chr(31) || r.issuer || chr(31) || r.level || chr(31) || r.indication || chr(31)"
CHAIN = f"""
WITH RECURSIVE recs AS MATERIALIZED (SELECT * FROM fx_records), c(ledger_id, seq, prev, mac) AS (
  SELECT r.ledger_id, r.seq, '', {HMAC(_FIELDS + " || ''")} FROM recs r WHERE r.seq = 1
  UNION ALL SELECT r.ledger_id, r.seq, c.mac, {HMAC(_FIELDS + " || c.mac")} FROM c JOIN recs r ON r.ledger_id = c.ledger_id AND r.seq = c.seq + 1)"""


def chained(spark, sf):
    return L.append_ledger(view(spark, sf, "fx_records"), KEY, "doc_id")


def tampered(spark, sf):
    """Of every four ledgers one is whole, one has an edited third line, one lacks its second line, one has a second line that is no JSON."""
    k = F.col("k")
    lines = L.ledger_lines(chained(spark, sf)).withColumn("k", F.regexp_extract("ledger_id", r"(\d+)$", 1).cast("int") % 4)
    lines = lines.filter(~((k == 2) & (F.col("pos") == 2))).withColumn("pos", F.when((k == 2) & (F.col("pos") > 2), F.col("pos") - 1).otherwise(F.col("pos")))
    edited = F.when((k == 1) & (F.col("pos") == 3), F.regexp_replace("line", '"level":"[^"]*"', '"level":"X"')).when((k == 3) & (F.col("pos") == 2), F.lit("{ no json")).otherwise(F.col("line"))
    return lines.select("ledger_id", "pos", edited.alias("line"))


_K = "regexp_extract(ledger_id, '([0-9]+)$', 1)::INT % 4"
_BROKEN = f"CASE {_K} WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 END"
_POS = f"SELECT ledger_id, {_K} AS k, CASE WHEN {_K} = 2 AND seq > 2 THEN seq - 1 ELSE seq END AS pos, document_hash, doc_no, indication, {_BROKEN} AS broken FROM fx_records WHERE NOT ({_K} = 2 AND seq = 2)"


_TWICE = CHAIN.replace("SELECT * FROM fx_records", "SELECT * REPLACE (row_number() OVER (PARTITION BY ledger_id ORDER BY doc_id % 3 = 1, doc_id)::INT AS seq) FROM fx_records")


@query("s2_append_ledger", f"{_TWICE} SELECT ledger_id, seq, prev, mac FROM c")
def append_ledger(spark, sf):
    """Two appends, the second one to where the first ended."""
    r = view(spark, sf, "fx_records")
    first = S.cut(L.append_ledger(r.filter("doc_id % 3 <> 1"), KEY, "doc_id"), "ledger")
    return first.unionByName(L.append_ledger(r.filter("doc_id % 3 = 1"), KEY, "doc_id", L.ledger_tails(first))).select("ledger_id", "seq", "prev", "mac")


@query("s1_read_ledger", f"SELECT ledger_id, pos::INT AS pos, k = 3 AND pos = 2 AS corrupt, CASE WHEN NOT (k = 3 AND pos = 2) THEN doc_no END AS doc_no FROM ({_POS})")
def read_ledger(spark, sf):
    """Ledgers are written as text, a folder each, and read back by line."""
    path = S.shared_path(spark, "ledgers")
    lines = tampered(spark, sf)
    lines.repartition("ledger_id").sortWithinPartitions("ledger_id", "pos").select(F.col("ledger_id").alias("ledger"), F.col("line").alias("value")).write.partitionBy("ledger").text(path)
    return L.parse_lines(S.read_ledger(spark, path)).select("ledger_id", "pos", F.col("mac").isNull().alias("corrupt"), "doc_no")


@query("s3_ledger_record_from_report", """
SELECT doc_id AS report_id, arg_min(o.cert_id, o.ord) FILTER (WHERE NOT is_doc_timestamp) AS signer, count(*) FILTER (WHERE NOT is_doc_timestamp) AS signature_count, coalesce(bool_or(digest_ok) FILTER (WHERE NOT is_doc_timestamp), FALSE) AS timestamped FROM fx_signatures o GROUP BY doc_id""")
def ledger_record_from_report(spark, sf):
    s = view(spark, sf, "fx_signatures")
    sig = F.struct("ord", F.when(F.col("is_doc_timestamp"), "doc_timestamp").otherwise("signature").alias("type"), F.col("cert_id").alias("signer"), F.lit("B-T").alias("level"), F.lit("PASSED").alias("indication"), F.col("digest_ok").alias("timestamped"))
    reports = s.groupBy(F.col("doc_id").alias("report_id")).agg(F.array_sort(F.collect_list(sig)).alias("signatures")).withColumn("document_hash", F.sha2(F.col("report_id").cast("string"), 256))
    return L.record_from_report(reports).select("report_id", "signer", F.col("signature_count").cast("long").alias("signature_count"), "timestamped")


@query("w1_verify_ledger", f"SELECT ledger_id, min(broken)::INT AS broken_at, count(*) FILTER (WHERE broken IS NULL OR pos < broken) AS records FROM ({_POS}) GROUP BY ledger_id")
def verify_ledger(spark, sf):
    return L.ledger_status(L.verify_ledger(tampered(spark, sf), KEY))


@query("t1_latest_record", f"SELECT document_hash, max(struct_pack(l := ledger_id, p := pos)).l AS ledger_id, max(struct_pack(l := ledger_id, p := pos)).p::INT AS pos FROM ({_POS}) WHERE broken IS NULL OR pos < broken GROUP BY document_hash")
def latest_record(spark, sf):
    return L.latest_record(L.verify_ledger(tampered(spark, sf), KEY), "document_hash").select("document_hash", "ledger_id", "pos")


@query("j15_scan_lookup", f"""
WITH p AS (SELECT * FROM ({_POS}) WHERE NOT (k = 3 AND pos = 2)), b AS (SELECT ledger_id, min(broken) AS broken FROM ({_POS}) GROUP BY ledger_id),
c AS (SELECT doc_id AS claim_id, ledger_id, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE document_hash END AS h, CASE WHEN doc_id % 10 = 0 THEN 'D-x' ELSE doc_no END AS n, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN document_hash ELSE 'other' END AS computed FROM fx_records)
SELECT claim_id, CASE WHEN b.broken IS NOT NULL THEN 'unavailable' WHEN coalesce(x.i, y.i) IS NULL THEN 'unverified' WHEN coalesce(x.i, y.i) = 'PASSED' THEN 'verified' WHEN coalesce(x.i, y.i) = 'FAILED' THEN 'invalid' ELSE 'indeterminate' END AS status,
  CASE WHEN computed IS NULL THEN 'claimed' WHEN computed = h THEN 'computed' ELSE 'mismatch' END AS binding
FROM c LEFT JOIN b USING (ledger_id) LEFT JOIN (SELECT ledger_id, document_hash, arg_max(indication, pos) AS i FROM p GROUP BY ALL) x ON x.ledger_id = c.ledger_id AND x.document_hash = c.h LEFT JOIN (SELECT ledger_id, doc_no, arg_max(indication, pos) AS i FROM p GROUP BY ALL) y ON y.ledger_id = c.ledger_id AND y.doc_no = c.n""")
def scan_lookup(spark, sf):
    d = F.col("doc_id")
    claims = view(spark, sf, "fx_records").select(d.alias("claim_id"), "ledger_id", F.when(d % 5 == 0, "none").otherwise(F.col("document_hash")).alias("hash"), F.when(d % 10 == 0, "D-x").otherwise(F.col("doc_no")).alias("doc_no"), F.when(d % 3 == 1, F.col("document_hash")).when(d % 3 == 2, "other").alias("computed"))
    return L.scan_lookup(claims, L.verify_ledger(tampered(spark, sf), KEY))


@query("a19_content_dedup", "SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS copies, any_value(strlen(text)) AS bytes FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    d = view(spark, sf, "documents")
    return L.content_dedup(d.select(C.document_hash(F.col("text")).alias("sha"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.octet_length("text").alias("bytes")))


_LEAVES = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS leaf_index, sha256('\\x00'::BLOB || encode(text)) AS hash FROM documents"
_TREE = f"""
WITH RECURSIVE leaves AS MATERIALIZED ({_LEAVES}), t(level, idx, hash) AS (
  SELECT 0, leaf_index, hash FROM leaves
  UNION ALL SELECT level + 1, idx // 2, CASE WHEN nxt IS NULL THEN hash ELSE sha256('\\x01'::BLOB || unhex(hash) || unhex(nxt)) END FROM (SELECT level, idx, hash, lead(hash) OVER (ORDER BY idx) AS nxt, count(*) OVER () AS n FROM t) WHERE idx % 2 = 0 AND n > 1)"""


def leaves(spark, sf):
    """Documents numbered from 0 in the order of doc_id, without a window over all of them."""
    d = view(spark, sf, "documents").select("doc_id", L.leaf_hash(F.col("text")).alias("hash"), F.lit(0).alias("log"))
    return S.numbered(d, "log", [F.col("doc_id")], "n").select((F.col("n") - 1).alias("leaf_index"), "hash")


@query("a14_merkle_root", f"{_TREE} SELECT hash AS root FROM t WHERE level = (SELECT max(level) FROM t)")
def merkle_root(spark, sf):
    return L.merkle_root(leaves(spark, sf))


@query("a15_inclusion_proof", f"""
{_TREE} SELECT l.leaf_index, coalesce(string_agg(t.hash, ',' ORDER BY t.level), '') AS path FROM leaves l LEFT JOIN t ON t.idx = xor(l.leaf_index >> t.level, 1) AND t.level < (SELECT max(level) FROM t) GROUP BY l.leaf_index""")
def inclusion_proof(spark, sf):
    return L.inclusion_proofs(leaves(spark, sf)).select("leaf_index", F.array_join("path", ",").alias("path"))


@query("a16_verify_inclusion", f"SELECT leaf_index, leaf_index % 5 = 0 AS included FROM ({_LEAVES})")
def verify_inclusion(spark, sf):
    """Of every five proofs one is whole; one has another leaf, one another index, one another first sibling, one a size too small by half.

    The other index is the neighbour's, unless the neighbour is an equal leaf, which is included there by the same proof: then it is one behind the log.
    """
    x = S.cut(leaves(spark, sf), "leaves")
    root = L.merkle_root(x).first()["root"]
    k = F.col("leaf_index") % 5
    other = F.when(F.get("path", F.lit(0)) == F.col("leaf"), F.col("leaf_index") + F.col("size")).otherwise(F.col("leaf_index").bitwiseXOR(F.lit(1)))
    spoiled = L.inclusion_proofs(x).withColumn("n", F.col("leaf_index")).withColumns({
        "leaf": F.when(k == 1, F.sha2("leaf", 256)).otherwise(F.col("leaf")), "leaf_index": F.when(k == 2, other).otherwise(F.col("leaf_index")),
        "path": F.when(k == 3, F.concat(F.array(F.sha2(F.lit("other"), 256)), F.slice("path", 2, 99))).otherwise(F.col("path")), "size": F.when(k == 4, F.floor(F.col("size") / 2)).otherwise(F.col("size")),
    })
    return L.verify_inclusion(spoiled, F.lit(root)).select(F.col("n").alias("leaf_index"), "included")


@query("t5_entry_range", f"SELECT leaf_index, hash FROM ({_LEAVES}) WHERE leaf_index BETWEEN 10 AND 60")
def entry_range(spark, sf):
    return L.entry_range(leaves(spark, sf), 10, 60)


@query("s7_read_audit_log", "SELECT event_type AS event, count(*) AS n, count(DISTINCT user_id) AS clients FROM events WHERE event_id % 10 <> 3 GROUP BY event_type")
def read_audit_log(spark, sf):
    e = view(spark, sf, "events")
    body = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("event"), F.lit("/api").alias("route"), F.col("user_id").cast("string").alias("client"), F.lit("ok").alias("outcome")))
    lines = e.select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("INFO "), body)).otherwise(F.concat(F.lit("12:00 AUDIT "), body)).alias("value"))
    return S.read_audit_log(lines).groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("client").alias("clients"))


@query("f1_document_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def document_hash(spark, sf):
    return view(spark, sf, "documents").select("doc_id", C.document_hash(F.col("text")).alias("hash"))


@query("f2_hmac_sha256", f"SELECT doc_id, {HMAC('text')} AS mac FROM documents")
def hmac(spark, sf):
    return view(spark, sf, "documents").select("doc_id", C.hmac_sha256(F.col("text"), KEY).alias("mac"))
