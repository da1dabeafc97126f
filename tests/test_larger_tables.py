"""What only larger tables or larger keys have, in small: queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry.operators import layout, ledger
from attestry.plans.registry import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables that DuckDB makes, sorted."""
    duck = duckdb.connect()
    for table, sql in tables.items():
        duck.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*names).collect())), sorted(found.fetchall())


@pytest.mark.parametrize("n", [9, 40])
def test_equal_neighbours_do_not_prove_another_index(spark, tmp_path, n):
    """Documents 2 and 3, 6 and 7, 12 and 13 and so on are equal, so each stands at the other's index, too."""
    same = "CASE WHEN i // 2 % 2 = 1 OR i > 10 THEN i // 2 ELSE -i END"
    got, want = against_sql(spark, tmp_path, "a16_verify_inclusion", documents=f"SELECT i AS doc_id, 'text ' || {same} AS text, 'en' AS lang, 's' AS source, 6::BIGINT AS n_chars FROM range({n}) t(i)")
    assert got == want and len(got) == n


def test_an_index_behind_the_log_is_not_included(spark):
    proof = spark.createDataFrame([(i, "aa", 1, []) for i in (0, 1, 2, -1)], "leaf_index long, leaf string, size long, path array<string>")
    assert {r["leaf_index"]: r["included"] for r in ledger.verify_inclusion(proof, F.lit("aa")).collect()} == {0: True, 1: False, 2: False, -1: False}


def test_runs_of_parts_with_long_keys(spark, tmp_path):
    """Part keys of ten digits and more are read whole."""
    keys = "SELECT i // 6 AS l_orderkey, 98765432100 + i * 13 % 101 AS l_partkey, i // 3 % 2 AS l_suppkey, (1 + i % 6)::INT AS l_linenumber FROM range(300) t(i)"
    got, want = against_sql(spark, tmp_path, "w2_merge_runs", lineitem=keys)
    assert got == want and len(got) > 100


def test_runs_do_not_depend_on_the_order_of_equal_places(spark):
    """Two pieces of one ord: the left one comes first, however they arrive."""
    pieces = [(1, 0, 5, 0.0, 10.0, 100.0, 11.0, "a"), (1, 0, 5, 10.0, 20.0, 100.0, 11.0, "b"), (1, 0, 6, 20.0, 30.0, 100.0, 11.0, "c")]
    for some in (pieces, pieces[::-1]):
        df = spark.createDataFrame(some, "doc_id long, page int, ord long, x double, right double, baseline double, font_size double, text string").coalesce(1)
        assert [tuple(r) for r in layout.merge_runs(df).collect()] == [(1, 0, 1, "abc", 0.0, 30.0)]


def shuffled(plan) -> int:
    """Rows that a plan's exchanges wrote when it ran."""
    kind, metrics = plan.getClass().getSimpleName(), plan.metrics()
    own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return own + sum(map(shuffled, inner))


def test_boxes_that_meet_are_not_shuffled_to_many_cells(spark):
    """Sizes of two magnitudes, most boxes within one cell: less than three rows a box."""
    k = F.col("id")
    boxes = spark.range(5000).select((k % 3).alias("page_id"), "id", (k * 7 % 500).cast("double").alias("x"), (k * 11 % 700).cast("double").alias("y"), (k % 50 + 1).cast("double").alias("width"), (k % 30 + 1).cast("double").alias("height"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = layout.overlap_pairs(boxes, 60.0)
        assert len(found.collect()) > 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < shuffled(found._jdf.queryExecution().executedPlan()) < 3 * 5000


def test_boxes_behind_a_batch_meet_those_before(spark, monkeypatch):
    """Tiles of several Arrow batches and lots of pairs: what is held of a tile meets all that follows, once."""
    monkeypatch.setitem(layout.__dict__, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        k = F.col("id")
        boxes = spark.range(150).select((k % 2).alias("page_id"), "id", (k * 37 % 101).cast("double").alias("x"), (k * 11 % 53).cast("double").alias("y"), (k % 20).cast("double").alias("width"), (k % 9 * 3).cast("double").alias("height"))
        got = sorted(map(tuple, layout.overlap_pairs(boxes, 60.0).collect()))
        rows = boxes.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    meets = lambda p, q: p.page_id == q.page_id and p.id < q.id and p.x < q.x + q.width and q.x < p.x + p.width and p.y < q.y + q.height and q.y < p.y + p.height
    assert got == sorted((p.page_id, p.id, q.id) for p in rows for q in rows if meets(p, q)) and len(got) > 200
