"""Queries over edit logs and request streams."""

from pyspark.sql import functions as F

from attestry.functions import scalars as C
from attestry.operators import edits as E
from attestry.plans.fixtures import view
from attestry.plans.registry import query

OPS = """SELECT *, greatest(0, version - 1 - lag_versions) AS base_version FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS version FROM fx_ops)"""
MS = "(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000)"
def _ms():
    return F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000).cast("long")


def ops(spark, sf):
    x = E.assign_versions(view(spark, sf, "fx_ops"))
    return x.withColumn("base_version", F.greatest(F.lit(0), F.col("version") - 1 - F.col("lag_versions")).cast("int"))


@query("w13_assign_versions", f"SELECT session_id, event_id, version::INT AS version FROM ({OPS})")
def assign_versions(spark, sf):
    return ops(spark, sf).select("session_id", "event_id", "version")


@query("j10_op_conflicts", f"""
WITH o AS ({OPS}) SELECT a.session_id, a.version, min(b.version) AS conflict FROM o a JOIN o b ON a.session_id = b.session_id AND a.target = b.target AND b.version > a.base_version AND b.version < a.version AND a.client_id <> b.client_id
WHERE NOT (a.op = 'updateNode' AND b.op = 'updateNode') OR list_has_any(string_split(a.patch_keys, ','), string_split(b.patch_keys, ',')) GROUP BY ALL""")
def op_conflicts(spark, sf):
    return E.op_conflicts(ops(spark, sf))


@query("w11_merge_edit_bursts", f"""
WITH e AS (SELECT session_id, event_id, {MS} // 100000 AS ms, CASE WHEN op <> 'removeNode' THEN op END AS k FROM fx_ops),
r AS (SELECT *, CASE WHEN coalesce(k = lag(k) OVER w AND ms - lag(ms) OVER w <= 600, FALSE) THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY session_id ORDER BY ms, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ms, event_id) AS burst FROM r)
SELECT session_id, burst::BIGINT AS burst, any_value(k) AS key, count(*) AS edits, min(ms)::BIGINT AS first_ms, max(ms)::BIGINT AS last_ms FROM b GROUP BY session_id, burst""")
def merge_edit_bursts(spark, sf):
    e = view(spark, sf, "fx_ops").select("session_id", "event_id", F.floor(_ms() / 100000).cast("long").alias("ms"), F.when(F.col("op") != "removeNode", F.col("op")).alias("merge_key"))
    return E.merge_edit_bursts(e)


@query("w12_bounded_history", f"SELECT session_id, version::INT AS version FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY version DESC) AS r FROM ({OPS})) WHERE r <= 200")
def bounded_history(spark, sf):
    return E.bounded_history(ops(spark, sf)).select("session_id", "version")


@query("t2_catch_up", f"""
WITH o AS ({OPS}), c AS (SELECT session_id, client_id, max(version) AS base FROM o GROUP BY ALL) SELECT o.session_id, c.client_id, o.version::INT AS version FROM o JOIN c ON o.session_id = c.session_id WHERE o.version > c.base""")
def catch_up(spark, sf):
    o = ops(spark, sf)
    return E.catch_up(o, o.groupBy("session_id", "client_id").agg(F.max("version").alias("base")))


@query("x7_latest_state", f"""
WITH o AS ({OPS}), l AS (SELECT session_id, target, arg_max(op, version) AS life, max(version) AS since FROM o WHERE op IN ('addNode', 'removeNode') GROUP BY ALL)
SELECT o.session_id, o.target, count(*) FILTER (WHERE o.op = 'updateNode' AND o.version > coalesce(since, 0)) AS patches, arg_max('v' || o.event_id, o.version) FILTER (WHERE o.op = 'updateNode' AND o.version > coalesce(since, 0)) AS value, max(o.version)::INT AS last_version
FROM o LEFT JOIN l ON o.session_id = l.session_id AND o.target = l.target WHERE coalesce(life, 'addNode') = 'addNode' GROUP BY ALL""")
def latest_state(spark, sf):
    return E.latest_state(ops(spark, sf).withColumn("new_value", F.concat(F.lit("v"), "event_id"))).select("session_id", "target", "patches", "value", "last_version")


def scene_ops(spark, sf):
    return ops(spark, sf).withColumn("parent", F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("n"), F.col("event_id") % 5)))


@query("x7_scene_state")
def scene_state(spark, sf):
    return E.scene_state(scene_ops(spark, sf))


@query("f13_patch_merge", f"""
WITH p AS (SELECT session_id, target, version, event_id, unnest(CASE event_id % 3 WHEN 0 THEN ['x', 'frame.w', 'frame.h'] WHEN 1 THEN ['fill', 'frame.w'] ELSE ['text'] END) AS field FROM ({OPS}))
SELECT session_id, target, field, arg_max('v' || event_id, version) AS value FROM p GROUP BY ALL""")
def patch_merge(spark, sf):
    """Patches that also carry an id, a type and children, which change nothing."""
    v = F.concat(F.lit('"v'), "event_id", F.lit('"'))
    shape = F.get(F.array(F.lit('{"x":V,"id":V,"frame":{"w":V,"h":V}}'), F.lit('{"fill":V,"type":V,"frame":{"w":V}}'), F.lit('{"text":V,"children":[V]}')), (F.col("event_id") % 3).cast("int"))
    return E.patch_merge(E.patch_fields(ops(spark, sf).select("session_id", "target", "version", F.replace(shape, F.lit("V"), v).alias("patch"))))


def hits(spark, sf):
    return view(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), _ms().alias("ms"))


LIMIT, WINDOW = 3, 86_400_000


@query("w9_sliding_rate_limit", f"""
WITH RECURSIVE h AS MATERIALIZED (SELECT user_id AS key, event_id AS hit_id, {MS} AS ms, row_number() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) AS n FROM events),
w(key, hit_id, ms, n, before, allowed) AS (
  SELECT key, hit_id, ms, n, []::BIGINT[], TRUE FROM h WHERE n = 1
  UNION ALL SELECT h.key, h.hit_id, h.ms, h.n, list_filter(CASE WHEN w.allowed THEN list_append(w.before, w.ms) ELSE w.before END, lambda t: t >= h.ms - {WINDOW}),
    len(list_filter(CASE WHEN w.allowed THEN list_append(w.before, w.ms) ELSE w.before END, lambda t: t >= h.ms - {WINDOW})) < {LIMIT}
  FROM w JOIN h ON h.key = w.key AND h.n = w.n + 1)
SELECT key, hit_id, ms::BIGINT AS ms, allowed, ({LIMIT} - len(before) - CASE WHEN allowed THEN 1 ELSE 0 END)::INT AS remaining, CASE WHEN NOT allowed THEN greatest(1, before[1] + {WINDOW} - ms)::BIGINT END AS retry_ms FROM w""")
def sliding_rate_limit(spark, sf):
    return E.sliding_rate_limit(hits(spark, sf), LIMIT, WINDOW)


@query("w10_offered_load", f"SELECT user_id AS key, event_id AS hit_id, {MS}::BIGINT AS ms, count(*) OVER (PARTITION BY user_id ORDER BY {MS} RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW) AS load FROM events")
def offered_load(spark, sf):
    return E.offered_load(hits(spark, sf), WINDOW)


#: Operations by the event's number, with what is said of each.
_OPS = [
    ("{ bad", "BAD_JSON", None), ('{"op":"explode"}', "UNKNOWN_OP", None), ('{"op":"updateNode","nodeId":"n"}', "MISSING_FIELD", "patch"), ('{"op":"updateNode","nodeId":null,"patch":{}}', "MISSING_FIELD", "nodeId"),
    ('{"op":"addNode","node":{"type":"text"}}', None, None), ('{"op":"addNode","node":{"type":"circle"}}', "NODE_TYPE", None), ('{"op":"addNode"}', "MISSING_FIELD", "node"), ('{"op":"addPage"}', None, None),
    ('{"op":"reorder","nodeId":"n"}', "MISSING_FIELD", "to"), ('{"op":"reorder","nodeId":"n","to":0}', None, None), ('{"op":"movePage"}', "MISSING_FIELD", "index,pageId"), ('{"op":"replacePage","pageId":"p"}', "MISSING_FIELD", "nodes"),
    ('{"op":"setPageSize","pageId":"p"}', None, None), ('{"op":"setPage"}', "MISSING_FIELD", "page"), ('{"op":"setMeta","meta":{}}', None, None), ('{"op":"removePage","pageId":"p"}', None, None), ('{"op":"removeNode"}', "MISSING_FIELD", "nodeId"),
]
_SAID = ", ".join(f"({n}, {', '.join(repr(x) if x else 'NULL' for x in said)})" for n, (_, *said) in enumerate(_OPS))


@query("s9_read_op_log", f"WITH said(n, code, missing) AS (VALUES {_SAID}) SELECT event_id AS op_id, code, missing FROM events JOIN said ON event_id % {len(_OPS)} = n")
def read_op_log(spark, sf):
    op = F.get(F.array(*[F.lit(j) for j, *_ in _OPS]), (F.col("event_id") % len(_OPS)).cast("int"))
    return E.check_ops(view(spark, sf, "events").select(F.col("event_id").alias("op_id"), op.alias("json")))


@query("f14_client_key", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 't:' || substr(sha256('tok' || user_id), 1, 16) ELSE 'ip:10.0.0.' || (user_id % 256) END AS k FROM events")
def client_key(spark, sf):
    e = view(spark, sf, "events")
    token = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tok"), F.col("user_id").cast("string")))
    return e.select("event_id", C.client_key(token, F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))).alias("k"))


@query("f12_stable_digest", """
SELECT event_id, sha256('k=' || json_extract_string(props, '$.k') || chr(31) || 'type=' || event_type || chr(31) || 'user=\\N') AS digest,
  sha256('{"a":{"k":"' || json_extract_string(props, '$.k') || '","list":[1,{"y":null,"z":"ref"}]},"type":"' || event_type || '"}') AS nested FROM events""")
def stable_digest(spark, sf):
    """Of a map, and of nested JSON whose keys stand in one order or the other and whose references point anywhere."""
    k = F.get_json_object("props", "$.k")
    m = F.create_map(F.lit("user"), F.lit(None).cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), k)
    ref = F.concat(F.lit('{"$ref":"'), "event_id", F.lit(' 0 R"}'))
    one = F.concat(F.lit('{"type":"'), "event_type", F.lit('","a":{"list":[1,{"z":'), ref, F.lit(',"y":null}],"k":"'), k, F.lit('"}}'))
    two = F.concat(F.lit('{ "a" : {"k":"'), k, F.lit('", "list":[1, {"y":null,"z":'), ref, F.lit('}]}, "type":"'), "event_type", F.lit('"}'))
    return view(spark, sf, "events").select("event_id", C.stable_digest(m).alias("digest"), C.stable_json_digest(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("nested"))
