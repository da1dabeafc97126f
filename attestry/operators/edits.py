"""Edit logs and request streams: versions, conflicts, histories, merged state and rate limits."""

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of operations with the fields that each must have, and types of nodes.
REQUIRED = {
    "addNode": ("node",), "removeNode": ("nodeId",), "updateNode": ("nodeId", "patch"), "reorder": ("nodeId", "to"), "addPage": (), "removePage": ("pageId",), "movePage": ("pageId", "index"),
    "replacePage": ("pageId", "nodes"), "setPageSize": ("pageId",), "setMeta": ("meta",), "setPage": ("page",),
}
NODE_TYPES = ("text", "rect", "ellipse", "line", "path", "image", "qr", "signature", "group")
HISTORY, LOG = 200, 2000


def check_ops(raw: DataFrame) -> DataFrame:
    """(op_id, code, missing) of JSON operations: BAD_JSON, UNKNOWN_OP, MISSING_FIELD with the fields that are absent or null, NODE_TYPE, or null."""
    spec = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    keys = raw.withColumn("m", F.from_json("json", "map<string,string>")).withColumn("required", F.try_element_at(spec, F.try_element_at("m", F.lit("op"))))
    given = F.map_keys(F.map_filter("m", lambda _, v: v.isNotNull()))
    absent = F.array_except("required", given)
    kind = F.get_json_object("json", "$.node.type")
    code = (
        F.when(F.col("m").isNull(), "BAD_JSON").when(F.col("required").isNull(), "UNKNOWN_OP").when(F.size(absent) > 0, "MISSING_FIELD")
        .when((F.try_element_at("m", F.lit("op")) == "addNode") & ~F.coalesce(kind.isin(*NODE_TYPES), F.lit(False)), "NODE_TYPE")
    )
    return keys.select("op_id", code.alias("code"), F.when(F.size(absent) > 0, F.array_join(F.array_sort(absent), ",")).alias("missing"))


def assign_versions(ops: DataFrame) -> DataFrame:
    """Adds version: dense from 1 in each session, in commit order (ts, then event_id)."""
    return ops.withColumn("version", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "event_id")))


#: Versions that operations are looked for in together.
SPAN = 256


def op_conflicts(ops: DataFrame, log: int = LOG) -> DataFrame:
    """(session_id, version, conflict): the earliest operation by another client on the same target since base_version that it collides with.

    Two updates collide only where they patch a key in common. An operation asks for its target in the spans of versions that it missed, nine at most for a log of
    2000; operations trimmed from the log can no longer conflict.
    """
    low = F.greatest(F.col("base_version") + 1, F.col("version") - log)
    spans = F.sequence(F.floor(low / SPAN), F.floor((F.col("version") - 1) / SPAN))
    asked = ops.filter(low < F.col("version")).select("session_id", "target", "version", low.alias("low"), "client_id", "op", "patch_keys", F.explode(spans).alias("span"))
    o = ops.select("session_id", "target", F.floor(F.col("version") / SPAN).alias("span"), F.col("version").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("client_id", "op", "patch_keys")])
    both = (F.col("op") == "updateNode") & (F.col("o_op") == "updateNode")
    met = asked.join(o, ["session_id", "target", "span"]).filter((F.col("other") >= F.col("low")) & (F.col("other") < F.col("version")) & (F.col("client_id") != F.col("o_client_id")))
    return met.filter(~both | F.arrays_overlap(F.split("patch_keys", ","), F.split("o_patch_keys", ","))).groupBy("session_id", "version").agg(F.min("other").alias("conflict"))


def merge_edit_bursts(edits: DataFrame, gap_ms: int = 600) -> DataFrame:
    """(session_id, burst, key, edits, first_ms, last_ms): consecutive edits with one merge key and gaps up to gap_ms are one step; a null key never merges."""
    w = W.partitionBy("session_id").orderBy("ms", "event_id")
    same = F.coalesce((F.col("merge_key") == F.lag("merge_key").over(w)) & (F.col("ms") - F.lag("ms").over(w) <= gap_ms), F.lit(False))
    runs = edits.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("burst", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("session_id", "burst").agg(F.first("merge_key").alias("key"), F.count("*").alias("edits"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def bounded_history(versions: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n versions of each session."""
    return versions.withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("version")))).filter(F.col("r") <= n).drop("r")


def catch_up(versions: DataFrame, clients: DataFrame) -> DataFrame:
    """(session_id, client_id, version): what each client (session_id, client_id, base) has not seen."""
    return versions.select("session_id", "version").join(clients, "session_id").filter(F.col("version") > F.col("base")).select("session_id", "client_id", "version")


#: Fields of a node that no patch changes.
UNTOUCHED = ("id", "type", "children")


def patch_fields(patches: DataFrame) -> DataFrame:
    """Patches (session_id, target, version, patch as JSON) as a row a field with its value as text; `frame` gives a row for each of its own keys, and what no patch changes is left out."""
    entries = F.map_entries(F.from_json("patch", "map<string,string>"))
    frame = F.transform(F.coalesce(F.map_entries(F.from_json(F.get_json_object("patch", "$.frame"), "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.concat(F.lit("frame."), e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: ~e["key"].isin("frame", *UNTOUCHED))
    return patches.select("session_id", "target", "version", F.inline(F.concat(kept, frame)).alias("field", "value"))


def patch_merge(patches: DataFrame) -> DataFrame:
    """(session_id, target, field, value): the last writer of each field wins."""
    return patches.groupBy("session_id", "target", "field").agg(F.max_by("value", "version").alias("value"))


def latest_state(ops: DataFrame) -> DataFrame:
    """(session_id, target, alive, fields, last_version): nodes that are there at the end, with the patches that came after they were last added or removed."""
    life = ops.filter("op IN ('addNode', 'removeNode')").groupBy("session_id", "target").agg(F.max_by("op", "version").alias("life"), F.max("version").alias("since"))
    x = ops.join(life, ["session_id", "target"], "left")
    alive = F.coalesce(F.col("life"), F.lit("addNode")) == "addNode"
    writes = F.when((F.col("op") == "updateNode") & (F.col("version") > F.coalesce("since", F.lit(0))), F.col("version"))
    return x.filter(alive).groupBy("session_id", "target").agg(F.count(writes).alias("patches"), F.max_by("new_value", writes).alias("value"), F.max("version").alias("last_version"))


def scene_state(ops: DataFrame) -> DataFrame:
    """(session_id, node_id, parent, version, patches): the nodes that a session's operations (session_id, version, op, target, parent) leave.

    An addNode of a node that is there, and any other operation on one that isn't, is refused and changes nothing; a node goes with all that hangs on it; an
    addNode whose parent isn't there stands at the top. Order decides, so a session is one task's streaming work, and what is held is its nodes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, nodes, under = None, {}, {}

        def out() -> pd.DataFrame:
            rows = [(session, n, p, v, k) for n, (p, v, k) in nodes.items()]
            return pd.DataFrame(rows, columns=["session_id", "node_id", "parent", "version", "patches"])

        for pdf in batches:
            for s, version, op, target, parent in zip(*(pdf[c].array for c in ("session_id", "version", "op", "target", "parent"))):
                if s != session:
                    if nodes:
                        yield out()
                    session, nodes, under = s, {}, {}
                if op == "addNode" and target not in nodes:
                    up = parent if parent in nodes else None
                    nodes[target] = (up, version, 0)
                    under.setdefault(up, set()).add(target)
                elif op == "removeNode" and target in nodes:
                    under[nodes[target][0]].discard(target)
                    todo = [target]
                    while todo:
                        n = todo.pop()
                        todo += under.pop(n, ())
                        del nodes[n]
                elif op == "updateNode" and target in nodes:
                    p, _, k = nodes[target]
                    nodes[target] = (p, version, k + 1)
        if nodes:
            yield out()

    rows = ops.select("session_id", F.col("version").cast("long").alias("version"), "op", "target", "parent").repartition("session_id").sortWithinPartitions("session_id", "version")
    return rows.mapInPandas(run, "session_id long, node_id string, parent string, version long, patches long")


def sliding_rate_limit(hits: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """Hits (key, hit_id, ms) with allowed, remaining and retry_ms. Denied hits are not recorded, so they don't hold back later ones.

    A recurrence over each key in order. Keys are dealt out and sorted, and a task streams through them with the last `limit`
    accepted times of the present key: memory does not grow with a key's hits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, deque()
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"].array, pdf["ms"].array):
                if k != key:
                    key, kept = k, deque()
                while kept and kept[0] < t - window_ms:
                    kept.popleft()
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                out.append((ok, limit - len(kept), None if ok else max(1, kept[0] + window_ms - t)))
            allowed, remaining, retry = zip(*out) if out else ((), (), ())
            yield pdf.assign(allowed=allowed, remaining=remaining, retry_ms=pd.array(retry, "Int64"))

    rows = hits.select("key", "hit_id", "ms").repartition("key").sortWithinPartitions("key", "ms", "hit_id")
    return rows.mapInPandas(run, "key long, hit_id long, ms long, allowed boolean, remaining int, retry_ms long")


def offered_load(hits: DataFrame, window_ms: int) -> DataFrame:
    """Adds load: hits of the key in the trailing window, itself included, whether allowed or not."""
    w = W.partitionBy("key").orderBy("ms").rangeBetween(-window_ms, 0)
    return hits.select("key", "hit_id", "ms", F.count("*").over(w).alias("load"))
