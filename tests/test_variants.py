"""Nearest variants against a comparison of all pairs, and in a family too large for that."""

import random
import threading

from attestry.operators.generic import best_variant

REQUEST, VARIANT = "request_id long, family string, want_weight int, want_style string", "family string, weight int, style string, ordinal long"


def chosen(requests, variants):
    """By SQL's rules: every variant of the family is priced; what has no price comes last."""
    out = {}
    for i, family, weight, style in requests:
        for f, w, s, o in variants:
            if family is not None and f == family:
                other = 0 if None not in (s, style) and s == style else 300 if style == "italic" else 200
                price = (True, 0, o) if None in (w, weight) else (False, other + abs(w - weight), o)
                out[i] = min(out.get(i, price), price)
    return sorted((i, out[i][2] if i in out else None) for i in {r[0] for r in requests})


def test_variants_are_those_of_all_pairs(spark):
    rnd = random.Random(4)
    family, style = lambda: rnd.choice(["a", "b", "c", None]), lambda: rnd.choice(["italic", "oblique", "normal", None])
    variants = [(family(), rnd.choice([None, *range(0, 900, 50)]), style(), o) for o in range(120)] + [("d", None, "italic", 200), ("d", None, None, 199)]
    requests = [(i, rnd.choice(["a", "b", "c", "d", "e", None]), rnd.choice([None, *range(100, 1000, 100)]), style()) for i in range(300)]
    requests += [(0, "a", 300, "italic"), (0, "e", 300, "italic")]  # one request for several families
    for some in (variants, variants[:1], []):
        got = best_variant(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(some, VARIANT)).collect()
        assert sorted((r["request_id"], r["ordinal"]) for r in got) == chosen(requests, some)


def test_a_family_of_many_variants_is_not_met_by_every_request(spark):
    """Ten billion pairs would take hours."""
    from pyspark.sql import functions as F

    requests = spark.range(100_000).select(F.col("id").alias("request_id"), F.lit("a").alias("family"), F.col("id").alias("want_weight"), F.lit("normal").alias("want_style"))
    variants = spark.range(100_000).select(F.lit("a").alias("family"), (F.col("id") + 10).alias("weight"), F.lit("normal").alias("style"), F.col("id").alias("ordinal"))
    spark.sparkContext.setJobGroup("variants", "variants", True)
    timer = threading.Timer(120, spark.sparkContext.cancelJobGroup, ["variants"])
    timer.start()
    try:
        found = best_variant(requests, variants).agg(F.count("*").alias("n"), F.sum((F.col("ordinal") == F.greatest(F.col("request_id") - 10, F.lit(0))).cast("int")).alias("right")).first()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(found) == (100_000, 100_000)
