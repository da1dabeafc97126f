"""Streams over the events table, drained."""

from pyspark.sql import functions as F

from attestry.plans.edit_queries import LIMIT, WINDOW, scene_ops
from attestry.plans.fixtures import view
from attestry.plans.ledger_queries import CHAIN, KEY
from attestry.plans.registry import ORACLES, query
from attestry.streaming import streams as X


def events(spark, sf):
    e = view(spark, sf, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "ms": F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000).cast("long")})


@query("x1_rate_limit_stream")
def rate_limit_stream(spark, sf):
    hits = events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), "ts", "ms")
    return X.replayed(hits, "ts", lambda s: X.rate_limit_stream(s, LIMIT, WINDOW, 2 * WINDOW))


ORACLES["x1_rate_limit_stream"] = f"SELECT key, hit_id, ms, allowed FROM ({ORACLES['w9_sliding_rate_limit']})"


@query("x2_session_ttl_stream", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS session_id, count(*) AS touches, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, k""")
def session_ttl_stream(spark, sf):
    e = X.read_events(spark, f"{sf}/events.parquet*", view(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    s = X.session_ttl_stream(e.select(F.col("user_id").alias("session_id"), "ts"))
    return X.drained(s, "complete").select("session_id", "touches", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("x3_single_use_token_stream")
def single_use_token_stream(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("token"), "event_id", "ts", "ms", F.when(F.col("event_type").isin("click", "purchase"), "put").otherwise("take").alias("kind"))
    return X.replayed(e, "ts", lambda s: X.single_use_token_stream(s, 36_000_000))


@query("x2_session_admission")
def session_admission(spark, sf):
    """Four services, few enough sessions and clients that their limits are met."""
    kind = F.when(F.col("event_type") == "purchase", "create").when(F.col("event_type") == "click", "join").when(F.col("event_type") == "error", "leave").otherwise("touch")
    e = events(spark, sf).select((F.col("user_id") % 4).alias("service"), "event_id", "ts", "ms", kind.alias("kind"), F.concat(F.lit("s"), F.col("user_id") % 40).alias("session"), F.concat(F.lit("c"), F.col("event_id") % 30).alias("client"))
    return X.replayed(e, "ts", lambda s: X.session_admission_stream(s, sessions=2, clients=2, ttl_ms=86_400_000))


@query("x4_op_log_stream")
def op_log_stream(spark, sf):
    """Requests of all operations of a session within an hour."""
    op = F.when(F.col("event_type") == "purchase", "addNode").when(F.col("event_type") == "error", "removeNode").otherwise("updateNode")
    keys = F.when(F.col("event_id") % 3 == 0, "x,y").when(F.col("event_id") % 3 == 1, "y,fill").otherwise("text")
    o = events(spark, sf).select(
        F.col("user_id").alias("session_id"), "event_id", "ts", (F.floor(F.col("ms") / 3_600_000) * 3_600_000).alias("ms"), F.floor(F.col("ms") / 3_600_000).alias("request"), F.concat(F.lit("c"), F.floor(F.col("ms") / 3_600_000) % 3).alias("client_id"),
        (F.col("event_id") % 5).alias("base_version"), op.alias("op"), F.concat(F.lit("n"), F.col("event_id") % 6).alias("target"), keys.alias("patch_keys"))
    # a request comes whole: pieces are cut between hours
    return X.replayed(o.withColumn("ts", F.date_trunc("hour", "ts")), "ts", lambda s: X.op_log_stream(s, ttl_ms=43_200_000))


@query("x4_fan_out", """
WITH c AS (SELECT user_id, event_id, 'c' || (event_id % 3) AS client, ts FROM events WHERE event_type IN ('click', 'purchase', 'error')),
p AS (SELECT user_id, 'c' || ((event_id + 1) % 4) AS client, ts AS since, ts + to_minutes(1 + event_id % 1440) AS until FROM events WHERE event_type NOT IN ('click', 'purchase', 'error'))
SELECT DISTINCT c.user_id AS session_id, c.event_id AS version, p.client AS receiver FROM c JOIN p ON c.user_id = p.user_id AND c.client <> p.client AND c.ts >= p.since AND c.ts < p.until""")
def fan_out(spark, sf):
    """Commits are clicks, purchases and errors; any other event is a stay of a client, for a day at most. A client whose stays overlap gets a commit once."""
    commit = F.col("event_type").isin("click", "purchase", "error")

    def made(s):
        c = s.filter(commit).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("version"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("client_id"), "ts")
        until = F.col("ts") + F.make_interval(mins=(1 + F.col("event_id") % 1440).cast("int"))
        p = s.filter(~commit).select(F.col("user_id").alias("session_id"), F.concat(F.lit("c"), (F.col("event_id") + 1) % 4).alias("client_id"), F.col("ts").alias("since"), until.alias("until"))
        return X.fan_out_stream(c, p, "1 day")

    return X.replayed(events(spark, sf), "ts", made).distinct()


_X5 = CHAIN.replace("SELECT * FROM fx_records", "SELECT 'u' || user_id AS ledger_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS seq, sha256(event_id::VARCHAR) AS document_hash, 'E' || event_id AS doc_no, 'signer' AS signer, 'issuer' AS issuer, 'level' AS level, 'indication' AS indication FROM events")


@query("x5_ledger_append_stream", f"{_X5} SELECT c.ledger_id, c.seq, document_hash, prev, mac FROM c JOIN recs r ON c.ledger_id = r.ledger_id AND c.seq = r.seq")
def ledger_append_stream(spark, sf):
    def prepare(df):
        return df.select(F.concat(F.lit("u"), "user_id").alias("ledger_id"), "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("document_hash"), F.concat(F.lit("E"), "event_id").alias("doc_no"), *[F.lit(c).alias(c) for c in ("signer", "issuer", "level", "indication")])

    e = X.read_events(spark, f"{sf}/events.parquet*", view(spark, sf, "events").schema)
    return X.ledger_append_stream(e, prepare, KEY, "event_id", "ledger-stream").select("ledger_id", "seq", "document_hash", "prev", "mac")


@query("x6_presence", "SELECT user_id AS session_id, 'c' || (event_id % 3) AS client_id, arg_max(CASE WHEN event_type = 'error' THEN 'leave' ELSE 'join' END, struct_pack(t := ts, e := event_id)) AS kind FROM events GROUP BY ALL")
def presence(spark, sf):
    kind = F.when(F.col("event_type") == "error", "leave").otherwise("join")
    e = events(spark, sf).select(F.col("user_id").alias("session_id"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("client_id"), "ts", "ms", "event_id", kind.alias("kind"))
    return X.present(X.replayed(e, "ts", X.presence))


@query("x7_scene_stream")
def scene_stream(spark, sf):
    """The nodes that x7_scene_state finds, from changes that five pieces of the log give."""
    o = scene_ops(spark, sf).select("session_id", F.col("version").cast("long").alias("version"), F.col("ts").cast("timestamp").alias("ts"), "op", "target", "parent")
    return X.scene_nodes(X.replayed(o, "ts", lambda s: X.scene_stream(s.drop("ts"))))
