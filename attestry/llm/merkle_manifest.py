"""Merkle manifest of a dataset with inclusion proofs by pointer jumping (operator 12)."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import cut, discard, small
from attestry.sources import numbered

ARITY = 16
#: Nodes whose segments may be broadcast in a round; a segment has some 1 kB a level, so that is 10 MB at most.
NODES = 2_000

_STEPS = "array<struct<before:string,after:string,top:boolean>>"


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 in hex of the columns' values one after the other, each as its UTF-8 byte count, a colon and the value; a null is `-`."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def fold(digest: Column, steps: Column) -> Column:
    """The digest of the ancestor that the steps lead to: at each, the siblings before it, it and the siblings after it are hashed."""
    return F.aggregate(steps, digest, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]), 256))


@dataclass
class Manifest:
    """runs: (tree, level, index, children) - up to ARITY nodes each, whose digest is node (tree, level, index). Tree 0 stands over the subroots of trees 1 and up.

    runs is None if no tree has a second level. leaves: (tree, index, lone, docs) - the leaves run by run, in order. root is None for an empty table.
    """

    runs: DataFrame | None
    leaves: DataFrame
    root: str | None


def _name(tree: Column, level: Column, index: Column) -> Column:
    return F.concat_ws("/", tree.cast("string"), level.cast("string"), index.cast("string"))


def _climb(level: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, index, n, name, digest; n nodes of that level in the tree) to the runs of all levels above them, and to the last node of each tree."""
    runs, tops, k = [], [level.filter("n = 1").select("tree", "name", "digest")], 1
    level = level.filter("n > 1")
    while not level.isEmpty():
        child = F.struct("index", "name", "digest")
        made = level.groupBy("tree", F.expr(f"index DIV {arity}").alias("run"), F.expr(f"(n + {arity - 1}) DIV {arity}").alias("n")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        made = made.select("tree", F.lit(k).alias("level"), F.col("run").alias("index"), "n", _name(F.col("tree"), F.lit(k), F.col("run")).alias("name"), "children")
        made = cut(made.withColumn("digest", F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)), "merkle-level")
        runs.append(made)
        up = made.select("tree", "index", "n", "name", "digest")
        tops.append(up.filter("n = 1").select("tree", "name", "digest"))
        level, k = up.filter("n > 1"), k + 1
    last = tops[0]
    for t in tops[1:]:
        last = last.unionByName(t)
    return runs, last


def build_manifest(rows: DataFrame, by: str, order: str, arity: int = ARITY) -> Manifest:
    """A tree for each value of `by` over its rows in ascending `order`, and one over the trees' roots in ascending order of `by`.

    rows has by, order, leaf (a hex digest) and whatever else is to be carried with each leaf. Nulls come first in both orders, a null `by` is a
    tree of its own, and rows with equal `order` are ordered by their digest. While a tree has several nodes, every `arity` consecutive
    ones become the digest of their digests; a lone leaf is its own subroot. No rows: root is None. Leaves are numbered by ranges and
    grouped by runs, so a tree that holds most rows is spread as any other.
    """
    carried = [c for c in rows.columns if c != by]
    flat = rows.select(F.col(by).alias("by"), F.col(order).alias("order"), F.col("leaf"), F.struct(*carried).alias("doc"))
    placed = numbered(flat, "by", [F.col("order").asc_nulls_first(), F.col("leaf").asc()], "place")
    sizes = cut(placed.groupBy("by").agg(F.max("place").alias("n")).withColumn("all", F.lit(1)), "merkle-sizes")
    trees = cut(numbered(sizes, "all", [F.col("by").asc_nulls_first()], "tree").select(F.col("by").alias("t_by"), "n", "tree"), "merkle-trees")
    known = placed.join(small(trees), F.col("by").eqNullSafe(F.col("t_by"))).select("tree", (F.col("place") - 1).alias("index"), "n", "doc")
    run = F.expr(f"index DIV {arity}")
    leaves = known.groupBy("tree", run.alias("run"), "n").agg(F.array_sort(F.collect_list(F.struct("index", "doc"))).alias("d"))
    leaves = leaves.select("tree", F.col("run").alias("index"), (F.col("n") == 1).alias("lone"), F.expr(f"(n + {arity - 1}) DIV {arity}").alias("n"), F.transform("d", lambda x: x["doc"]).alias("docs"))
    digest = F.when(F.col("lone"), F.col("docs")[0]["leaf"]).otherwise(F.sha2(F.array_join(F.transform("docs", lambda d: d["leaf"]), ""), 256))
    leaves = cut(leaves.withColumns({"digest": digest, "name": _name(F.col("tree"), F.lit(0), F.col("index"))}), "merkle-leaves")
    runs, subroots = _climb(leaves.select("tree", "index", "n", "name", "digest"), arity)
    n = trees.count()
    upper, top = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("index"), F.lit(n).cast("long").alias("n"), "name", "digest"), arity)
    every = None
    for r in [*runs, *upper]:
        part = r.select("tree", "level", "index", "name", "children")
        every = part if every is None else every.unionByName(part)
    root = top.first()
    return Manifest(every, leaves, root and root["digest"])


def _jumped(manifest: Manifest) -> DataFrame:
    """(name, steps): the steps from each node to the root, by pointer jumping.

    A node points at its parent and holds its siblings there as one step. In a round each node's pointer is followed once more, by a self-join of pointer and
    name, and the segments are put together, so distances double. After a round of distance d a node is pointed at by 16^d others at most, and
    only nodes above level d are, so the rounds with many pointers a node have few nodes, which are broadcast if they are NODES at most.
    """
    child, kids = F.col("c"), F.col("children")
    part = lambda sign: F.array_join(F.transform(F.filter(kids, lambda k: (k["index"] < child["index"]) if sign < 0 else (k["index"] > child["index"])), lambda k: k["digest"]), "")
    step = F.struct(part(-1).alias("before"), part(1).alias("after"), (F.col("tree") == 0).alias("top"))
    nodes = manifest.runs.select("tree", "level", F.col("name").alias("up"), "children", F.explode("children").alias("c"))
    nodes = cut(nodes.select(F.col("c.name").alias("name"), "up", F.array(step).cast(_STEPS).alias("steps")), "merkle-pointers")
    high = F.split("name", "/")
    distance, old = 1, []
    while True:
        above = nodes.filter((high[0] == "0") | (high[1].cast("int") >= distance)).select(F.col("name").alias("a_name"), F.col("up").alias("a_up"), F.col("steps").alias("a_steps"))
        met = nodes.join(small(above, NODES), F.col("up") == F.col("a_name"), "left")
        nodes = cut(met.select("name", F.col("a_up").alias("up"), F.concat("steps", F.coalesce("a_steps", F.array().cast(_STEPS))).alias("steps")), "merkle-jump")
        discard(*old)
        old, distance = [nodes], distance * 2
        if nodes.filter("up IS NOT NULL").isEmpty():
            return nodes


def proofs(manifest: Manifest) -> DataFrame:
    """A row a leaf: what was carried with it (leaf included), subroot, root, and steps: the siblings before and after it and each of its ancestors, from the leaf to the root.

    The leaves of a run have all ancestors in common, so the run moves as one row until its leaves are unfolded at the end.
    """
    runs = manifest.leaves
    if manifest.runs is not None:
        runs = runs.join(_jumped(manifest), "name", "left")
    else:
        runs = runs.withColumn("steps", F.lit(None).cast(_STEPS))
    known = F.coalesce("steps", F.array().cast(_STEPS))
    runs = runs.select("lone", "docs", known.alias("steps"), fold(F.col("digest"), F.filter(known, lambda s: ~s["top"])).alias("subroot"))
    own = F.transform("docs", lambda d: d["leaf"])
    each = runs.select("*", own.alias("own"), F.posexplode("docs").alias("at", "doc"))
    beside = F.struct(F.array_join(F.slice("own", 1, F.col("at")), "").alias("before"), F.array_join(F.slice("own", F.col("at") + 2, F.size("own")), "").alias("after"), F.lit(False).alias("top"))
    steps = F.when(F.col("lone"), F.col("steps")).otherwise(F.concat(F.array(beside), F.col("steps")))
    return each.select("doc.*", "subroot", F.lit(manifest.root).cast("string").alias("root"), steps.alias("steps"))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings' digests, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)
