"""Documents to token shards: language ID, near-dedup, decontamination, mixing, token ids. Each stage works on all that the one before it kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.decontaminate import decontaminated
from attestry.llm.langid import known
from attestry.llm.minhash import deduplicated
from attestry.llm.mixing import mix
from attestry.llm.shared import shared_path
from attestry.llm.token_shards import read_documents, write_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those less like their nearest language than its learning texts of that size. Prototypes come from the rows whose crc32(doc_id) mod 4 is not 2. A null lang teaches nothing; a null text goes."""
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    return known(docs, learn)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more)."""
    return deduplicated(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources weigh as their size to the power 0.7, and shuffles them."""
    return mix(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes wavelet-matrix shards and returns what is read back of them: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(spark, "pipeline-shards")
    write_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids),
]

#: Near duplicates, edit distances and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage returns is written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
