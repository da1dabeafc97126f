"""Streams that SQL can't follow, against plain loops over the same events."""

import os
from collections import defaultdict

import duckdb
import pytest

from attestry.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def events():
    sql = f"SELECT user_id, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 1000 AS ms, event_type FROM '{SF}/events.parquet' ORDER BY ms, event_id"
    return duckdb.connect().execute(sql).fetchall()


def test_tokens_are_taken_once(spark, events):
    put, want = {}, {}
    for user, event, ms, kind in events:
        if kind in ("click", "purchase"):
            put[user] = ms
        else:
            want[event] = user in put and ms <= put[user] + 36_000_000
            put.pop(user, None)
    got = {r["event_id"]: r["taken"] for r in QUERIES["x3_single_use_token_stream"](spark, SF).collect()}
    assert got == want and {True, False} == set(want.values())


def test_requests_are_taken_whole(spark, events):
    """Operations of one session and hour stand or fall together."""
    by, want = defaultdict(list), {}
    for user, event, ms, kind in events:
        by[user, ms // 3_600_000].append((event, {"purchase": "addNode", "error": "removeNode"}.get(kind, "updateNode"), f"n{event % 6}", {0: "x,y", 1: "y,fill", 2: "text"}[event % 3].split(",")))
    state: dict = defaultdict(lambda: (0, {}, []))
    before: dict = {}
    for (user, hour), ops in sorted(by.items(), key=lambda x: x[0]):
        if hour - before.get(user, hour) > 12:  # gone
            state.pop(user, None)
        before[user] = hour
        version, alive, log = state[user]
        trial, code = dict(alive), None
        for _, op, node, _ in sorted(ops):
            if op == "addNode":
                code = code or ("DUPLICATE_ID" if trial.get(node) else None)
                trial[node] = True
            else:
                code = code or ("MISSING" if trial.get(node) is False else None)
                if op == "removeNode":
                    trial[node] = False
        new = []
        for event, op, node, keys in sorted(ops):
            hit = next(((c, v) for v, c, n, o, k in log if v > event % 5 and c != f"c{hour % 3}" and n == node and (op != "updateNode" or o != "updateNode" or set(k) & set(keys))), (None, None))
            if code:
                want[event] = (code, None, None, None)
            else:
                version += 1
                new.append((version, f"c{hour % 3}", node, op, keys))
                want[event] = (None, version, *hit)
        if not code:
            state[user] = (version, trial, log + new)
    got = {r["event_id"]: (r["code"], r["version"], r["overwrites_by"], r["overwrites_at"]) for r in QUERIES["x4_op_log_stream"](spark, SF).collect()}
    assert got == want and {c for c, *_ in want.values()} == {None, "MISSING", "DUPLICATE_ID"} and any(b for *_, b in want.values())


def test_sessions_and_clients_have_limits(spark, events):
    live, want = defaultdict(dict), {}
    for user, event, now, kind in events:
        room, s, c = live[user % 4], f"s{user % 40}", f"c{event % 30}"
        for k in [k for k, (t, _) in room.items() if now - t >= 86_400_000]:
            del room[k]
        code = None
        if kind == "purchase":
            if s not in room:
                code = "FULL" if len(room) >= 2 else None
                if not code:
                    room[s] = (now, set())
        elif s not in room:
            code = "NO_SESSION"
        elif kind == "click":
            if c not in room[s][1] and len(room[s][1]) >= 2:
                code = "CROWDED"
            else:
                room[s][1].add(c)
        elif kind == "error":
            room[s][1].discard(c)
            if not room[s][1]:
                room[s] = (now, set())
        else:
            room[s] = (now, room[s][1])
        want[event] = code
    got = {r["event_id"]: r["code"] for r in QUERIES["x2_session_admission"](spark, SF).collect()}
    assert got == want and {"FULL", "NO_SESSION", None} <= set(want.values())


def test_scenes_are_replayed(spark):
    from attestry.operators.edits import scene_state
    from attestry.plans.edit_queries import ops

    scenes: dict = defaultdict(dict)
    for r in ops(spark, SF).orderBy("session_id", "version").collect():
        nodes, n = scenes[r["session_id"]], r["target"]
        if r["op"] == "addNode" and n not in nodes:
            up = f"n{r['event_id'] % 5}" if r["event_id"] % 4 else None
            nodes[n] = [up if up in nodes else None, r["version"], 0]
        elif r["op"] == "removeNode" and n in nodes:
            gone = {n}
            while more := {k for k, v in nodes.items() if v[0] in gone} - gone:
                gone |= more
            for k in gone:
                del nodes[k]
        elif r["op"] == "updateNode" and n in nodes:
            nodes[n][1:] = [r["version"], nodes[n][2] + 1]
    want = {(s, n): tuple(v) for s, nodes in scenes.items() for n, v in nodes.items()}
    got = {(r["session_id"], r["node_id"]): (r["parent"], r["version"], r["patches"]) for r in QUERIES["x7_scene_state"](spark, SF).collect()}
    assert got == want and any(p for p, *_ in want.values())
    assert scene_state(ops(spark, SF).limit(0).selectExpr("*", "target AS parent")).count() == 0


def test_ledgers_go_on_across_micro_batches(spark, tmp_path):
    """Files one by one, so that each makes a batch."""
    from pyspark.sql import functions as F

    from attestry.operators import ledger as L
    from attestry.streaming import streams as X

    rows = spark.range(40).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("event_id"))
    for k in range(4):
        rows.filter(F.floor(F.col("event_id") / 10) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = X.read_events(spark, str(tmp_path / "in"), rows.schema, files=1)
    record = lambda df: df.select(F.col("user_id").cast("string").alias("ledger_id"), "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("document_hash"), F.lit("d").alias("doc_no"), *[F.lit("x").alias(c) for c in ("signer", "issuer", "level", "indication")])
    key = "a key of 16 chars"
    got = X.ledger_append_stream(stream, record, key, "event_id", "t")
    assert got.count() == 40 and {r["n"] for r in got.groupBy("ledger_id").agg((F.max("seq") - F.count("*")).alias("n")).collect()} == {0}
    status = L.ledger_status(L.verify_ledger(L.ledger_lines(got), key)).collect()
    assert len(status) == 3 and all(r["broken_at"] is None for r in status)


def test_reading_order_is_rows_from_the_top(spark):
    from attestry.operators.layout import reading_order

    nodes = [(1, 1, 50.0, 10.0, None), (1, 2, 10.0, 14.0, None), (1, 3, 5.0, 21.0, None), (1, 4, 0.0, 500.0, 0), (1, 5, 70.0, 16.5, None)]
    got = reading_order(spark.createDataFrame(nodes, "page_id long, node_id long, x double, y double, explicit int")).orderBy("position").collect()
    assert [r["node_id"] for r in got] == [4, 2, 1, 3, 5] and not any(r["guessed"] for r in got)
    open_ = [n for n in nodes if n[4] is None]
    assert all(r["guessed"] for r in reading_order(spark.createDataFrame(open_, "page_id long, node_id long, x double, y double, explicit int")).collect())


def test_keys_of_the_limiter_are_swept(spark):
    """Five pieces; the state of a key that stays away is evicted by its timer, and hits are judged as in the batch form."""
    from datetime import datetime, timedelta, timezone

    from pyspark.sql import functions as F

    from attestry.operators.edits import sliding_rate_limit
    from attestry.streaming import streams as X

    hits = [(1 if k < 20 else 2 + k % 2, k, k * 600_000) for k in range(100)]
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(k, i, ms, start + timedelta(milliseconds=ms)) for k, i, ms in hits], "key long, hit_id long, ms long, ts timestamp")
    got = X.replayed(df, "ts", lambda s: X.rate_limit_events(s, 2, 1_500_000, 3_000_000, "10 minutes")).collect()
    want = {r["hit_id"]: r["allowed"] for r in sliding_rate_limit(df.select("key", "hit_id", "ms"), 2, 1_500_000).collect()}
    assert {r["hit_id"]: r["allowed"] for r in got if not r["evicted"]} == want and {True, False} == set(want.values())
    assert [r["key"] for r in got if r["evicted"]] == [1]
    late = X.replayed(df.withColumn("ts", F.col("ts")), "ts", lambda s: X.rate_limit_stream(s, 2, 1_500_000, 3_000_000, "10 minutes"), arrivals=1).collect()
    assert {r["hit_id"]: r["allowed"] for r in late} == want


def test_limits_over_pieces_are_those_of_the_batch_form(spark):
    from attestry.plans.stream_queries import LIMIT, WINDOW, events
    from attestry.operators.edits import sliding_rate_limit
    from pyspark.sql import functions as F

    want = {r["hit_id"]: r["allowed"] for r in sliding_rate_limit(events(spark, SF).select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), "ms"), LIMIT, WINDOW).collect()}
    assert {r["hit_id"]: r["allowed"] for r in QUERIES["x1_rate_limit_stream"](spark, SF).collect()} == want


def test_scene_stream_is_the_batch_scene(spark):
    key = lambda r: (r["session_id"], r["node_id"], r["parent"], r["version"], r["patches"])
    assert sorted(map(key, QUERIES["x7_scene_stream"](spark, SF).collect()), key=str) == sorted(map(key, QUERIES["x7_scene_state"](spark, SF).collect()), key=str)


def test_scenes_after_each_piece(spark):
    """Subtrees that were built in one piece go in another; children in the middle, at the front and at the end of their parent's list."""
    from attestry.operators.edits import scene_state
    from attestry.streaming import streams as X

    log = [("addNode", "a", None), ("addNode", "b", "a"), ("addNode", "c", "a"), ("addNode", "d", "a"), ("addNode", "e", "c"), ("updateNode", "e", None), ("removeNode", "c", None), ("addNode", "c", "d"), ("removeNode", "d", None),
           ("addNode", "d", "b"), ("removeNode", "b", None), ("addNode", "f", "a"), ("addNode", "g", "a"), ("removeNode", "g", None), ("removeNode", "f", None), ("addNode", "h", "a"), ("updateNode", "zz", None), ("removeNode", "a", None), ("addNode", "a", "h")]
    rows = [(7, v, op, n, p) for v, (op, n, p) in enumerate(log, 1)]
    schema = "session_id long, version long, op string, target string, parent string"
    key = lambda r: (r["node_id"], r["parent"], r["version"], r["patches"])
    for stop in (7, 11, 14, 19):
        df = spark.createDataFrame(rows[:stop], schema)
        got = X.scene_nodes(X.replayed(df, "version", X.scene_stream, arrivals=4)).collect()
        assert sorted(map(key, got)) == sorted(map(key, scene_state(df).collect())), stop


def test_a_hash_that_comes_again_is_not_appended_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from attestry.operators import ledger as L
    from attestry.streaming import streams as X

    rows = spark.range(30).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("event_id"))
    for _ in range(2):  # the same file twice
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows.filter("event_id < 5").union(rows.filter("event_id < 5")).withColumn("event_id", F.col("event_id") + 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = X.read_events(spark, str(tmp_path / "in"), rows.schema, files=1)
    record = lambda df: df.select(F.col("user_id").cast("string").alias("ledger_id"), "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("document_hash"), F.lit("d").alias("doc_no"), *[F.lit("x").alias(c) for c in ("signer", "issuer", "level", "indication")])
    got = X.ledger_append_stream(stream, record, "a key of 16 chars", "event_id", "twice")
    assert got.count() == 35 and got.select("ledger_id", "document_hash").distinct().count() == 35
    assert all(r["broken_at"] is None for r in L.ledger_status(L.verify_ledger(L.ledger_lines(got), "a key of 16 chars")).collect())
