"""What lies in what, over tables of intervals such as the nodes of pages: pre when a node opens, post when it closes."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are held before they are handed on.
_FLUSH = 32_768


def structural_join(inner: DataFrame, outer: DataFrame, by: tuple[str, ...] = ("page_id",), levels: int | None = None, nearest: bool = False) -> DataFrame:
    """inner's rows with up_id, the one of an `outer` row that they lie in (outer.pre < pre < outer.post, equal `by`).

    inner has by, pre and depth and whatever it carries; outer has by, pre, post, depth and up_id. Without `nearest` a row comes once for each outer row around it, at
    most `levels` above; with it exactly once, with the up_id of the innermost, null where there is none (or where that has none).

    Both sides are sorted by place within their task and read once. Only the outer rows that are open are held, so memory grows with the depth of nesting and neither
    side is larger for it. A group is one page (or one page and rule), never many. Rows with a null in `by` lie in nothing. Intervals of a group nest or are apart; equal
    rows (a page given twice) count as often as they are given.
    """
    carried = inner.schema
    up_type = outer.schema["up_id"].dataType
    held = F.struct(*inner.columns)
    a = inner.select(*by, "pre", "depth", F.lit(False).alias("__up"), F.lit(None).cast(outer.schema["post"].dataType).alias("post"), F.lit(None).cast(up_type).alias("up_id"), held.alias("row"))
    b = outer.select(*by, "pre", "depth", F.lit(True).alias("__up"), "post", "up_id", F.lit(None).cast(carried).alias("row"))
    both = a.unionByName(b).dropna(subset=list(by)).repartition(*by).sortWithinPartitions(*by, "pre", "__up")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_ = None, []  # (post, depth, up_id) of the outer rows around here
        for batch in batches:
            rows, kind = batch.column("row"), batch.schema.field("up_id").type
            keys = zip(*(batch.column(c).to_pylist() for c in by))
            at, ups = [], []

            def found() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([rows.take(pa.array(at, pa.int64())), pa.array(ups, kind)], ["row", "up_id"])

            for i, (key, pre, depth, is_up, post, up) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in ("pre", "depth", "__up", "post", "up_id")))):
                if key != group:
                    group, open_ = key, []
                while open_ and open_[-1][0] < pre:
                    open_.pop()
                if is_up:
                    open_.append((post, depth, up))
                elif nearest:
                    at.append(i)
                    ups.append(open_[-1][2] if open_ else None)
                else:
                    for _, above, outer_id in reversed(open_):
                        if levels is not None and depth - above > levels:
                            break
                        at.append(i)
                        ups.append(outer_id)
                        if len(at) >= _FLUSH:
                            yield found()
                            at, ups = [], []
            if at:
                yield found()

    schema = a.select("row", "up_id").schema
    met = both.mapInArrow(run, schema)
    return met.select("row.*", "up_id")
