"""Token totals kept up by signed changes (operator 2).

A batch of inserts, deletes and revised counts becomes signed rows: what a document counted so far goes out with a
minus, what it counts now comes in with a plus, and the sums of these are added to the totals by source, language and
tokenizer version. What each document counts is kept in buckets by a hash of its id; a batch reads and writes the buckets
of its own documents and no others, so it costs what it changes and neither a recount nor the history. A batch that
is committed already is not applied again.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.shared import cut, discard, path_exists, strings

KEY = ["doc_id", "tokenizer"]
DIMS = ["source", "lang", "tokenizer"]
_HELD = "doc_id long, tokenizer string, source string, lang string, tokens long"
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def word_tokens(text: Column) -> Column:
    """Tokenizer ws@1: runs of anything but white space (ASCII)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def piece_tokens(text: Column) -> Column:
    """Tokenizer alnum@2: runs of letters and digits (ASCII), and runs of characters beyond ASCII."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z]+|[^\x00-\x7F]+")).cast("long")


def bpe_tokens(path: str):
    """A counter for the vocabulary file at `path`, as an Arrow UDF."""
    from attestry.llm.bpe import bpe

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        return pa.array([len(ids) for ids in bpe(path).encode_all(strings(text))], pa.int64())

    return count


#: Tokenizer versions by name: each makes a column of counts from a column of texts.
TOKENIZERS = {"ws@1": word_tokens, "alnum@2": piece_tokens}


def counted(docs: DataFrame, op: str, tokenizers: dict | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Changes (doc_id, op, source, lang, tokenizer, n_tokens) for rows of documents, one a tokenizer; the text is read once."""
    pairs = [F.struct(F.lit(name).alias("tokenizer"), f(F.col(text)).alias("n_tokens")) for name, f in (tokenizers or TOKENIZERS).items()]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(op).alias("op"), "source", "lang", F.inline(F.array(*pairs)))


def deleted(docs: DataFrame, tokenizers: dict | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Changes that delete documents; their texts are not read."""
    names = F.array(*map(F.lit, tokenizers or TOKENIZERS))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit("delete").alias("op"), "source", "lang", F.explode(names).alias("tokenizer"), F.lit(0).cast("long").alias("n_tokens"))


class TokenLedger:
    """Totals under a folder that driver and executors share. One writer at a time.

    commits/N-batch is the table (bucket, folder) of where each bucket's rows stand after that commit, and totals/N-batch its totals.
    The driver sees names of commits and that table, which has a row a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _commits(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if path_exists(self.spark, f"{self.path}/commits/{n}/_SUCCESS")]

    def _state(self, folders: dict[int, str], buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/state/{folders[b]}/bucket={b}" for b in buckets if b in folders]
        there = [p for p in paths if path_exists(self.spark, p)]
        return self.spark.read.schema(_HELD).parquet(*there) if there else self.spark.createDataFrame([], _HELD)

    def commit(self, batch: str, changes: DataFrame, ordered_by: str | None = None) -> bool:
        """Applies changes (doc_id, op, source, lang, tokenizer, n_tokens); False if that batch was committed before.

        op is insert, revise or delete; other rows, and rows without doc_id or tokenizer, change nothing. An insert of a
        document that is counted already revises it, a revise of one that isn't inserts it, a delete of one that isn't
        does nothing. Of several changes to one document and tokenizer, the one largest in `ordered_by` counts, ties (and
        repeated rows) being settled by a delete before others, and then the larger count. Null source, language and count are groups of
        their own and 0. An empty batch is committed too.

        Buckets and totals are written first, the table of buckets last, and its _SUCCESS marks the commit: of a batch that broke
        off before that no reader sees anything, and it is written again when it is sent again.
        """
        done = self._commits()
        if any(n.partition("-")[2] == batch for n in done):
            return False
        folders = {r["bucket"]: r["folder"] for r in self.spark.read.parquet(f"{self.path}/commits/{done[-1]}").collect()} if done else {}
        name = f"{int(done[-1].partition('-')[0]) + 1 if done else 0:09d}-{batch}"
        rows = changes.filter(F.col("op").isin("insert", "revise", "delete") & F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull())
        order = F.col(ordered_by) if ordered_by else F.lit(0)
        n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
        last = cut(
            rows.groupBy(*KEY)
            .agg(F.max(F.struct(order.alias("o"), (F.col("op") == "delete").alias("d"), n.alias("n"), "source", "lang")).alias("x"))
            .select(*KEY, F.struct(F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), F.col("x.n").alias("tokens"), "x.d").alias("now")), "ledger-batch"
        )
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = [r["bucket"] for r in last.select(bucket).distinct().collect()]
        held = self._state(folders, touched).select(*KEY, F.struct("source", "lang", "tokens").alias("was"))
        both = cut(held.join(last, KEY, "full_outer"), "ledger-both")
        state = both.filter("now IS NULL OR NOT now.d").withColumn("row", F.when(F.col("now").isNotNull(), F.struct("now.source", "now.lang", "now.tokens")).otherwise(F.col("was")))
        state.select(*KEY, "row.*", bucket).repartitionByRange("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/{name}")
        signed = lambda side, sign: F.struct(F.col(f"{side}.source").alias("source"), F.col(f"{side}.lang").alias("lang"), F.lit(sign).cast("long").alias("docs"), (sign * F.col(f"{side}.tokens")).alias("tokens"))
        pair = F.array(F.when(F.col("was").isNotNull() & F.col("now").isNotNull(), signed("was", -1)), F.when(~F.col("now.d"), signed("now", 1)))
        delta = both.select("tokenizer", F.inline(F.filter(pair, lambda x: x.isNotNull()))).groupBy(*DIMS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._summed(self._totals(done).unionByName(delta.select(*DIMS, "docs", "tokens"))).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{name}")
        found = [(b, f) for b, f in sorted((folders | dict.fromkeys(touched, name)).items())]
        self.spark.createDataFrame(found, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")
        discard(last, both)
        return True

    def _totals(self, done: list[str]) -> DataFrame:
        return self.spark.read.schema(_TOTALS).parquet(f"{self.path}/totals/{done[-1]}") if done else self.spark.createDataFrame([], _TOTALS)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*DIMS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs > 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) after all committed batches; groups without documents are left out."""
        return self._totals(self._commits())
