"""Where intermediate tables go, and the few helpers that several operators use."""

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources import BROADCAST_ROWS, cut, discard, shared_path, small  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that docs has as columns already (in any case)."""
    had, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in had:
            name = f"_{name}"
        had.add(name.lower())
        out.append(name)
    return out


def strings(column: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow column one by one, so that a batch isn't held twice."""
    return (x.as_py() for x in column)


def tidy(run: Callable, *forget: Callable[[], None]) -> Callable:
    """run, a function of batches, that at a task's end calls `forget` and gives freed memory back: workers are reused by tasks of other stages."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


#: A key is hot if it holds more than one in HOT of all rows; so there are HOT hot keys at most, and these are broadcast.
HOT = 1000


def join_split(left: DataFrame, right: DataFrame, on: Column, rows: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """left joined (inner or left) with right, whose key is unique and whose column `rows` says how many rows of left have it.

    A right side of `most` rows (BROADCAST_ROWS) is broadcast. Beyond that, only hot keys are, and the rows of all others are shuffled by a key of which each has few.
    """
    n, total = right.agg(F.count("*"), F.sum(rows)).first()
    if n <= (most or BROADCAST_ROWS):
        return left.join(F.broadcast(right), on, how)
    is_hot = F.col(rows) * HOT > F.lit(total)
    hot, cold = F.broadcast(right.filter(is_hot)), right.filter(~is_hot)
    return left.join(hot, on).unionByName(left.join(hot, on, "left_anti").join(cold, on, how))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def path_exists(spark: SparkSession, path: str) -> bool:
    """By the file system that Spark uses for the path, not the driver's own."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
