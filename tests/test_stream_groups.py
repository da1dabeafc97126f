"""Streams whose keys are dealt into groups: as few states as groups, and the same results whatever their number."""

import os

import pytest
from pyspark.sql import functions as F

from attestry.plans.registry import QUERIES
from attestry.plans.stream_queries import events
from attestry.streaming import streams as X

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def states(spark, stream, folder) -> int:
    """Rows of state after all input there is."""
    had = spark.conf.get(X._STORE[0], None)
    spark.conf.set(*X._STORE)
    try:
        q = stream.writeStream.format("noop").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
        q.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)
    finally:
        spark.conf.set(X._STORE[0], had) if had else spark.conf.unset(X._STORE[0])


def test_presence_of_many_clients_is_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "GROUPS", 3, raising=False)
    e = spark.range(500).select(F.col("id").alias("session_id"), F.lit("c").alias("client_id"), F.timestamp_millis(F.lit(X._EPOCH) + F.col("id")).alias("ts"), F.col("id").alias("ms"), F.col("id").alias("event_id"), F.lit("join").alias("kind"))
    e.write.parquet(str(tmp_path / "in"))
    assert 0 < states(spark, X.presence(X.read_events(spark, str(tmp_path / "in"), e.schema)), tmp_path / "seen") <= 3


def test_presence_is_that_of_all_events(spark, monkeypatch):
    monkeypatch.setattr(X, "GROUPS", 1, raising=False)
    newest = F.max_by(F.when(F.col("event_type") == "error", "leave").otherwise("join"), F.struct("ts", "event_id"))
    want = events(spark, SF).groupBy("user_id", F.concat(F.lit("c"), F.col("event_id") % 3)).agg(newest)
    assert rows(QUERIES["x6_presence"](spark, SF)) == rows(want)


def test_a_client_that_stays_away_is_forgotten(spark, tmp_path):
    """The second batch's watermark is past what is known of the first; a late change of a client that is known is no change."""
    at = lambda session, minute, event, kind: (session, "c", minute * 60_000, event, kind)
    pieces = [[at(1, 0, 1, "join"), at(2, 0, 2, "join")], [at(2, 300, 4, "leave"), at(2, 290, 3, "join")], [at(2, 295, 5, "join"), at(3, 301, 6, "join")]]
    schema = "session_id long, client_id string, ms long, event_id long, kind string"
    for k, piece in enumerate(pieces):
        df = spark.createDataFrame(piece, schema).withColumn("ts", F.timestamp_millis(F.lit(X._EPOCH) + F.col("ms"))).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    got = X.drained(X.presence(X.read_events(spark, str(tmp_path / "in"), df.schema, files=1)))
    assert rows(got.select("session_id", "event_id", "kind")) == [(1, 1, "join"), (2, 2, "join"), (2, 4, "leave"), (3, 6, "join")]


def test_logs_of_many_sessions_are_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "GROUPS", 3, raising=False)
    text = {"client_id": "c", "op": "updateNode", "target": "n", "patch_keys": "x"}
    o = spark.range(500).select(F.col("id").alias("session_id"), F.col("id").alias("event_id"), F.timestamp_millis(F.lit(X._EPOCH) + F.col("id")).alias("ts"), F.col("id").alias("ms"), F.col("id").alias("request"), F.lit(0).cast("long").alias("base_version"), *[F.lit(v).alias(k) for k, v in text.items()])
    o.write.parquet(str(tmp_path / "in"))
    assert 0 < states(spark, X.op_log_stream(X.read_events(spark, str(tmp_path / "in"), o.schema)), tmp_path / "seen") <= 3


def test_logs_are_the_same_in_one_group(spark, monkeypatch):
    want = rows(QUERIES["x4_op_log_stream"](spark, SF))
    monkeypatch.setattr(X, "GROUPS", 1, raising=False)
    assert rows(QUERIES["x4_op_log_stream"](spark, SF)) == want
