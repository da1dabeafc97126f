"""Readers and writers."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a local session gets a folder of this machine, and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that later rounds of a loop neither compute it again nor depend on the executors that made it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by cut() that nothing will read any more, such as those of a loop's earlier rounds."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that a lookup side may have before it is no longer broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows; else as it is, for a join that Spark shuffles and splits where it is skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key is hot if it holds more than one in HOT of all rows, so at most HOT are; rows of a hot key are dealt over SPREAD tasks.
HOT, SPREAD = 1000, 32


def join_hot(left: DataFrame, right: DataFrame, on: tuple[str, str], fits: Column, deal: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right where left's column on[0] equals right's on[1] and `fits` holds, however many rows of left have one value there.

    A right side of BROADCAST_ROWS is broadcast. Beyond that, left's rows of hot values are dealt by `deal` (a column of left) over SPREAD tasks, each of which gets right's
    rows of that value; all others are shuffled by value. Columns of both sides have different names. Nulls meet nothing.
    """
    name, other = on
    same = F.col(name) == F.col(other)
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), same & fits, how)
    hot = F.broadcast(cut(left.groupBy(F.col(name).alias("__hot")).agg(F.count("*").alias("__n")).filter(F.col("__n") * HOT > left.count()).select("__hot"), "hot"))
    dealt = left.join(hot, F.col(name) == F.col("__hot"), "left_semi").withColumn("__l", F.pmod(F.xxhash64(deal), F.lit(SPREAD)).cast("int"))
    copied = right.join(hot, F.col(other) == F.col("__hot"), "left_semi").withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = dealt.join(copied, same & (F.col("__l") == F.col("__r")) & fits, how).drop("__l", "__r")
    return met.unionByName(left.join(hot, F.col(name) == F.col("__hot"), "left_anti").join(right, same & fits, how))


def numbered(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """df with `name`, the rows of each `by` numbered from 1 in the given order, exactly and without bringing a group to one task.

    Rows are range-partitioned and sorted, and their place in their task is written with them; what earlier tasks have of the group is
    added: one small row a task and group.
    """
    placed = cut(df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__id", 33))  # the upper half of such an id is the task, the lower the row's place in it
    earlier = W.partitionBy("__by").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    groups = placed.groupBy(F.col("__part").alias("__p"), F.col(by).alias("__by")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    groups = groups.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    found = placed.join(small(groups), (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    return found.select(*df.columns, (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias(name))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(ledger_id, pos, line) of files with a JSON record a line; the file's name is the ledger, or the folder `ledger=name` that its part files stand in.

    A file is read in splits by line. Spark keeps the order of lines within a split, and splits have their offset in the file, so lines
    are numbered by (file, offset, line in the split) without any task reading a whole ledger.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"ledger=([^/]*)/[^/]*$", 1), F.lit("")), F.col("_metadata.file_name")), r"\.[^.]*$", "").alias("ledger_id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return numbered(lines, "ledger_id", [F.col("file"), F.col("at"), F.col("n")], "pos").select("ledger_id", F.col("pos").cast("int").alias("pos"), "line")


def read_audit_log(lines: DataFrame) -> DataFrame:
    """Lines `AUDIT {json}` as (ts, event, route, client, outcome); other lines are passed over."""
    body = F.regexp_extract("value", r"AUDIT (\{.*\})\s*$", 1)
    return lines.filter(F.col("value").contains("AUDIT {")).select(F.from_json(body, "ts STRING, event STRING, route STRING, client STRING, outcome STRING").alias("r")).filter("r IS NOT NULL").select("r.*")


def sniff(content: Column) -> Column:
    """The type of a file by its first bytes; null for any other than these four."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(head(8) == "89504E470D0A1A0A", "image/png").when(head(3) == "FFD8FF", "image/jpeg").when(head(4) == "00010000", "font/ttf").when(head(4) == "4F54544F", "font/otf")


def scan_assets(spark: SparkSession, path: str) -> DataFrame:
    """(id, mime, sha256, size) of files by content, never by name or declared type."""
    sha = F.sha2("content", 256)
    return spark.read.format("binaryFile").load(path).select("path", F.concat(F.lit("ast_"), F.substring(sha, 1, 16)).alias("id"), sniff(F.col("content")).alias("mime"), sha.alias("sha256"), F.col("length").alias("size"))


#: Most pixels and decoded bytes of an image, and samples a pixel by a PNG's colour type.
MOST_PIXELS, MOST_DECODED = 50_000_000, 512 * 1024 * 1024
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_facts(content: Column, most_pixels: int = MOST_PIXELS, most_decoded: int = MOST_DECODED) -> Column:
    """(width, height, decoded, code) from the header alone: refused by pixels, and by the bytes that it would take decoded, before anything is decoded.

    A sample's bits times samples a pixel are rounded up to bytes; an interlaced image takes half as much again.
    """
    n = lambda at, size=4: F.conv(F.hex(F.substring(content, at, size)), 16, 10).cast("long")
    samples = F.try_element_at(F.create_map(*[F.lit(x) for pair in PNG_SAMPLES.items() for x in pair]), n(26, 1).cast("int"))
    width, height = n(17), n(21)
    decoded = F.ceil(width * height * F.ceil(n(25, 1) * samples / 8) * F.when(n(29, 1) != 0, 1.5).otherwise(1.0)).cast("long")
    code = (
        F.when(~F.coalesce(sniff(content) == "image/png", F.lit(False)), "NOT_PNG").when(F.octet_length(content) < 33, "TRUNCATED")
        .when((n(9) != 13) | (F.hex(F.substring(content, 13, 4)) != "49484452") | samples.isNull(), "MALFORMED").when((width == 0) | (height == 0), "EMPTY")
        .when(width * height > most_pixels, "TOO_MANY_PIXELS").when(decoded > most_decoded, "DECODED_TOO_LARGE")
    )
    return F.struct(width.alias("width"), height.alias("height"), decoded.alias("decoded"), code.alias("code"))


def write_conformance_report(rollup: DataFrame, path: str) -> None:
    rollup.write.mode("overwrite").parquet(path)
