"""Token ids in wavelet-matrix shards (operator 1): written in the order of doc_id, read back, and searched."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.bpe import bpe
from attestry.llm.shared import small, strings, tidy
from attestry.llm.wavelet import Shard, pack

#: Tokens after which a shard is closed. A document is never divided, so a longer one makes a longer shard.
SHARD_TOKENS = 1 << 20
#: A row group a shard or a few: readers hold no more than that at once.
_PARQUET = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "uncompressed"}


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes one row a shard: part, seq, n_docs, n_tokens and the shard's file as bytes.

    Documents are dealt out by ranges of doc_id, and stand in ascending order within and across parts (part, seq). A null doc_id comes first;
    rows that share a doc_id stay together, ordered by a hash of their texts. A null or empty text is the end id alone.
    A null end is not made: every row gives a document. No documents: no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = bpe(tokenizer), TaskContext.get().partitionId(), 0
        ids, tokens, size = [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
                 "n_tokens": pa.array([size], pa.int64()), "file": pa.array([pack(ids, tokens, end_id)], pa.binary())})

        for batch in batches:
            for i, own in zip(batch.column(0).to_pylist(), encoder.encode_all(strings(batch.column(1)))):
                ids.append(i)
                tokens.append(np.append(own, np.uint32(end_id)))
                size += len(tokens[-1])
                if size >= shard_tokens:
                    yield shard()
                    seq, ids, tokens, size = seq + 1, [], [], 0
        if ids:
            yield shard()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = dealt.mapInArrow(tidy(run), "part int, seq int, n_docs long, n_tokens long, file binary")
    shards.write.options(**_PARQUET).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, shard_start): tokens before each shard. Only the totals of parts, as many as the writer had tasks, pass the driver."""
    shards = spark.read.parquet(path).select("part", "seq", "n_tokens")
    totals = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    before = np.cumsum([0, *(n for _, n in totals)]).tolist()
    parts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, part_start long")
    inside = F.expr("coalesce(sum(n_tokens) OVER (PARTITION BY part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return shards.withColumn("inside", inside).join(small(parts), "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row a document, decoded from the shards: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, n_end_ids; with their ids if asked for.

    n_end_ids is how often the end id stands in the document, its own end included, from ranks in the planes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file"))):
                shard = Shard(raw)
                tokens, ends = shard.decode().astype("<u4"), shard.doc_ends.tolist()
                spans, n = list(zip([0, *ends], ends)), len(ends)
                out = {
                    "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(shard.doc_ids, pa.int64()),
                    "inside": pa.array([a for a, _ in spans], pa.int64()), "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(tokens[a:b]) for a, b in spans], pa.int64()),
                    "n_end_ids": pa.array(shard.counts(shard.end_id, np.array([0, *ends])), pa.int64()),
                }
                if ids:
                    out["ids"] = pa.array([tokens[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long, n_end_ids long" + ", ids array<int>" * ids
    docs = spark.read.parquet(path).select("part", "seq", "file").mapInArrow(tidy(run), schema)
    joined = docs.join(small(shard_starts(spark, path)), ["part", "seq"])
    return joined.select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids", *["ids"] * ids)


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each token in all shards, by ranks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                shard = Shard(raw)
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())})

    return spark.read.parquet(path).select("file").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position): every place of a token, counted from its document's start, by selects alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                shard = Shard(raw)
                at, ends = shard.occurrences(token), shard.doc_ends
                doc = np.searchsorted(ends, at, "right")
                starts = np.concatenate([[0], ends])[doc]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64()), "position": pa.array(at - starts, pa.int64())})

    return spark.read.parquet(path).select("file").mapInArrow(run, "doc_id long, position long")
