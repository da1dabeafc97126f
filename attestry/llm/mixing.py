"""Sources mixed to target weights by Poisson replication (operator 5, native).

A source with s characters and target share w of a budget B is to be seen B*w/s times. Each document draws its own
number of copies from a Poisson distribution of that mean, by inverting the distribution at a uniform number made
from a hash of seed and document; the copies are dealt out and sorted by a hash of seed, document and copy number.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import cut, fresh, join_split

#: A mean above this is drawn as a sum of parts of at most this mean, so that no distribution table grows with the mean.
PART = 64


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def document_key(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array, to where the rest is below 1e-15."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(mean) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.array_append(acc["all"], total).alias("all"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row a source: mix_source, mix_rows (its documents), mix_rate (mean copies of each of them), mix_parts and mix_table, the table of one part.

    Weights are given by source (a source not named gets 0), or else are size**alpha; the budget is `epochs` times
    the size of all. Size counts characters; a source whose documents are all empty keeps rate `epochs`. A null
    source is a source of its own, named by the key None.
    """
    sizes = cut(docs.groupBy(F.col(source).alias("mix_source")).agg(F.sum(F.coalesce(F.char_length(text), F.lit(0)).cast("long")).alias("size"), F.count("*").alias("mix_rows")), "mix-sizes")
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    total, weighed = sizes.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.when(F.col("size") > 0, F.lit(epochs * (total or 0)) * F.col("weight") / F.lit(weighed or 1.0) / F.col("size")).otherwise(F.lit(float(epochs)))
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART)).cast("int")
    return (
        sizes.withColumn("mix_rate", rate)
        .select("mix_source", "mix_rows", "mix_rate", parts.alias("mix_parts"))
        .withColumn("mix_table", poisson_table(F.col("mix_rate") / F.col("mix_parts")))
    )


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs, each row as often as it drew, with mix_copy (from 1), mix_rate and mix_order (columns of these three names are replaced, all others stay).

    The draw depends on seed and doc_id alone: a rerun, a lost executor or another partitioning gives the same copies,
    and rows that repeat a doc_id draw the same number. A null doc_id is replaced by a hash of the text. Rows that
    draw 0 go. An empty table gives no rows.

    Rates are a row a source, broadcast while these are few, so that texts move once, in the shuffle at the end; with very many sources
    only the large ones are (`join_split`). Rows go to a partition by a hash unlike for each copy and are sorted there, so each
    output file is a random sample in random order, and no source, however large, stays together.
    """
    docs = docs.drop("mix_copy", "mix_rate", "mix_order")
    own = ("mix_source", "mix_rows", "mix_parts", "mix_table", "mix_key", "mix_u", "mix_n")
    names = dict(zip(own, fresh(docs, *own)))
    c = lambda name: F.col(names[name])
    rates = cut(source_rates(docs, weights, alpha, epochs, source, text), "mix-rates").withColumnsRenamed({k: v for k, v in names.items() if k in own[:4]})
    seeded = F.lit(str(seed))
    table = c("mix_table")
    drawn = F.aggregate(
        F.sequence(F.lit(1), c("mix_parts")), F.lit(0),
        lambda acc, j: acc + F.aggregate(table, F.lit(0), lambda n, p: n + (p <= uniform(seeded, c("mix_key"), j.cast("string"))).cast("int")),
    )
    first = F.aggregate(table, F.lit(0), lambda n, p: n + (p <= c("mix_u")).cast("int"))
    copies = (
        join_split(docs, rates, docs[source].eqNullSafe(c("mix_source")), names["mix_rows"])
        .withColumn(names["mix_key"], document_key(doc_id, text)).withColumn(names["mix_u"], uniform(seeded, c("mix_key"), F.lit("1")))
        .withColumn(names["mix_n"], F.when(c("mix_parts") == 1, first).otherwise(drawn)).filter(c("mix_n") > 0)
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), c("mix_n"))))
        .withColumn("mix_order", F.conv(F.substring(F.md5(F.concat_ws("/", seeded, c("mix_key"), F.col("mix_copy").cast("string"))), 1, 15), 16, 10).cast("long"))
    )
    return copies.select(*docs.columns, "mix_copy", "mix_rate", "mix_order").repartition("mix_order").sortWithinPartitions("mix_order")
