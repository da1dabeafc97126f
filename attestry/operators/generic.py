"""Comparisons, inventories, inheritance and rollups over any evidence tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.sources import cut, small


def snapshot_diff(before: DataFrame, after: DataFrame, actions_before: DataFrame, actions_after: DataFrame) -> DataFrame:
    """Two revisions (doc_id, page, digest, box, objects) with their actions (doc_id, open_action, aa, names) to (doc_id, page_count_changed, content_changed, box_changed, objects_changed, actions_changed, changed).

    Pages are compared by index; those beyond the shorter revision only change the count. A null digest is of a page that could not be read: it leaves content, and `changed` where
    nothing else differs, undecided (null). Actions of a document that only one revision has count as absent in the other.
    """
    own = lambda df, k: df.select("doc_id", "page", *[F.col(c).alias(f"{c}{k}") for c in ("digest", "box", "objects")])
    differs = lambda c: F.coalesce(F.bool_or(~F.col(f"{c}0").eqNullSafe(F.col(f"{c}1"))), F.lit(False))
    both = own(before, 0).join(own(after, 1), ["doc_id", "page"]).groupBy("doc_id").agg(
        F.bool_or(F.col("digest0") != F.col("digest1")).alias("some"), F.bool_or(F.col("digest0").isNull() | F.col("digest1").isNull()).alias("open"), differs("box").alias("box_changed"), differs("objects").alias("objects_changed"))
    count = lambda df, k: df.groupBy("doc_id").agg(F.count("*").alias(f"n{k}"))
    n = count(before, 0).join(count(after, 1), "doc_id", "full_outer")
    whole = lambda df, k: df.select("doc_id", F.struct("open_action", "aa", "names").alias(f"a{k}"))
    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("open_action", "aa", "names")])
    acts = whole(actions_before, 0).join(whole(actions_after, 1), "doc_id", "full_outer").select("doc_id", (~F.coalesce("a0", empty).eqNullSafe(F.coalesce("a1", empty))).alias("actions_changed"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = n.join(both, "doc_id", "left").join(acts, "doc_id", "left").select(
        "doc_id", (F.coalesce("n0", F.lit(0)) != F.coalesce("n1", F.lit(0))).alias("page_count_changed"), F.when(no("some"), True).when(no("open"), None).otherwise(False).alias("content_changed"),
        no("box_changed").alias("box_changed"), no("objects_changed").alias("objects_changed"), no("actions_changed").alias("actions_changed"))
    seen = F.col("page_count_changed") | F.col("box_changed") | F.col("objects_changed") | F.col("actions_changed")
    return x.withColumn("changed", F.when(seen, True).otherwise(F.col("content_changed")))


def missing_references(uses: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return uses.join(known.select(on), on, "left_anti")


def unused_assets(assets: DataFrame, uses: DataFrame, on: str) -> DataFrame:
    """(unused, freed): assets that nothing uses, and their bytes."""
    return assets.join(uses.select(on), on, "left_anti").agg(F.count("*").alias("unused"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("freed"))


def metadata_consistency(info: DataFrame, xmp: DataFrame) -> DataFrame:
    """(doc_id, key, issue): DIFFERS (error) where both sources have a key with other values, MISSING (warning) where only the first has it."""
    x = info.join(xmp.select("doc_id", "key", F.col("value").alias("other")), ["doc_id", "key"], "left")
    issue = F.when(F.col("other").isNull(), "MISSING").when(F.col("value") != F.col("other"), "DIFFERS")
    return x.select("doc_id", "key", issue.alias("issue")).filter("issue IS NOT NULL")


def best_variant(requests: DataFrame, variants: DataFrame) -> DataFrame:
    """(request_id, ordinal): of a family's variants the one nearest in style (another style costs 300 where italic is wanted, else 200) and weight; the first registered wins ties, null for an unknown family.

    Equal wishes are looked up once. A wish meets four variants: the nearest that are not heavier and not lighter, of its style and of any, which windows in order of weight find;
    so nothing is held against a whole family. Where a weight is missing the first registered is taken after all that can be compared.
    """
    shelves = lambda style: F.explode(F.array(F.col(style), F.lit(None).cast("string"))).alias("shelf")
    kept = variants.filter("family IS NOT NULL").select("family", shelves("style"), "weight", "ordinal").groupBy("family", "shelf", "weight").agg(F.min("ordinal").alias("ordinal"))
    wishes = requests.filter("family IS NOT NULL").select("family", "want_weight", "want_style").distinct()
    asked = wishes.select("family", shelves("want_style"), F.col("want_weight").alias("weight"), "want_style", F.lit(True).alias("asks"))
    shelf = W.partitionBy("family", "shelf")
    near = lambda order: F.last(F.when(F.col("asks").isNull() & F.col("weight").isNotNull(), F.struct("weight", "ordinal")), ignorenulls=True).over(shelf.orderBy(order))
    met = kept.unionByName(asked, allowMissingColumns=True).withColumns({"light": near(F.asc("weight")), "heavy": near(F.desc("weight")), "first": F.min("ordinal").over(shelf)}).filter("asks")
    other = F.when(F.col("shelf").isNotNull(), 0).when(F.col("want_style") == "italic", 300).otherwise(200)
    cost = lambda v: F.abs(F.col(f"{v}.weight") - F.col("weight")) + other
    priced = lambda v: F.when(cost(v).isNotNull(), F.struct(F.lit(0).alias("open"), cost(v).alias("c"), F.col(f"{v}.ordinal").alias("ordinal")))
    unpriced = F.when(F.col("shelf").isNull() & F.col("first").isNotNull(), F.struct(F.lit(1).alias("open"), F.lit(None).cast(met.select(cost("light")).schema[0].dataType).alias("c"), F.col("first").alias("ordinal")))
    found = met.groupBy("family", F.col("weight").alias("w"), F.col("want_style").alias("s")).agg(F.min(F.least(priced("light"), priced("heavy"), unpriced)).alias("best")).withColumnRenamed("family", "f")
    same = (F.col("family") == F.col("f")) & F.col("want_weight").eqNullSafe(F.col("w")) & F.col("want_style").eqNullSafe(F.col("s"))
    best = requests.join(small(cut(found, "best-variants")), same, "left").groupBy("request_id").agg(F.min("best").alias("best"))
    return best.select("request_id", F.col("best.ordinal").alias("ordinal"))


#: Bits of a field's flags.
FIELD_FLAGS = {"read_only": 0, "required": 1, "multiline": 12, "password": 13, "radio": 15, "push_button": 16, "combo": 17}


def climbed(nodes: DataFrame, merge: Callable[[str, str], list[Column]], wants: Column) -> DataFrame:
    """Nodes (node_id, up, length, and what merge keeps) whose pointers `up` are followed as far as `wants` says, by pointer doubling: rounds grow as the logarithm of the depth.

    In a round, every node that still wants more and has a pointer takes what the node it points at has gathered, by merge(own prefix, other prefix), and that
    node's pointer. Adds `cyclic`: a node still wants more after as many rounds as any path without a cycle can need. Pointers to nodes that aren't there end a path. node_id is
    unique.
    """
    node = cut(nodes, "climbed")
    for _ in range(node.count().bit_length() + 1):
        live = wants & F.col("up").isNotNull()
        if node.filter(live).isEmpty():
            break
        others = node.select(*[F.col(c).alias(f"o_{c}") for c in node.columns])
        asked = node.filter(live).join(others, F.col("up") == F.col("o_node_id"), "left")
        step = asked.select("node_id", F.col("o_up").alias("up"), (F.col("length") + F.coalesce("o_length", F.lit(0))).alias("length"), *merge("", "o_"))
        node = cut(node.filter(~F.coalesce(live, F.lit(False))).unionByName(step), "climbed")
    return node.withColumn("cyclic", F.coalesce(wants & F.col("up").isNotNull(), F.lit(False)))


def field_inventory(fields: DataFrame, widgets: DataFrame, levels: int = 32) -> DataFrame:
    """(field_id, name, kind, flags by name, depth, deep, cyclic, terminal, page) of a forest (field_id, parent_id, part, kind, flags): dotted full names, and the nearest kind and flags that an ancestor gives.

    Without any kind a field is a text field (Tx). page is that of the field's first widget (field_id, ord, page). Fields more than `levels` below a root are `deep`, which readers may not
    follow; they are given like any other. A field whose parents run in a circle is cyclic and has no name, kind, flags or depth; one whose parent isn't there counts as a root.
    """
    start = fields.select(F.col("field_id").alias("node_id"), F.col("parent_id").alias("up"), F.lit(0).alias("length"), F.array_compact(F.array("part")).alias("parts"), "kind", "flags")
    known = start.select(F.col("node_id").alias("k"))
    start = start.join(known, F.col("up") == F.col("k"), "left").withColumns({"up": F.col("k"), "length": F.col("k").isNotNull().cast("int")}).drop("k")
    merge = lambda own, other: [F.concat(f"{other}parts", f"{own}parts").alias("parts"), F.coalesce(f"{own}kind", f"{other}kind").alias("kind"), F.coalesce(f"{own}flags", f"{other}flags").alias("flags")]
    named = climbed(start, merge, F.lit(True))
    name = F.aggregate("parts", F.lit(""), lambda n, p: F.when(n == "", p).otherwise(F.concat(n, F.lit("."), p)))
    sound = lambda c: F.when(~F.col("cyclic"), c)
    out = named.select(F.col("node_id").alias("field_id"), sound(name).alias("name"), sound(F.coalesce("kind", F.lit("Tx"))).alias("kind"), sound(F.coalesce("flags", F.lit(0))).alias("flags"), sound(F.col("length")).alias("depth"), "cyclic")
    first = widgets.groupBy("field_id").agg(F.min_by("page", "ord").alias("page"))
    parents = fields.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("field_id")).distinct().withColumn("inner", F.lit(True))
    bits = [(F.shiftright("flags", k).bitwiseAND(1) == 1).alias(c) for c, k in FIELD_FLAGS.items()]
    met = out.join(first, "field_id", "left").join(parents, "field_id", "left")
    return met.select("field_id", "name", "kind", *bits, "depth", (F.col("depth") > levels).alias("deep"), "cyclic", F.col("inner").isNull().alias("terminal"), "page")


def inherited_property(nodes: DataFrame) -> DataFrame:
    """(node_id, value, distance, cyclic) of nodes (node_id, parent_id, value): the value of the nearest ancestor, itself included, that has one; null where none has. A node without a value whose ancestors run in a circle is cyclic."""
    start = nodes.select("node_id", F.col("parent_id").alias("up"), F.lit(0).alias("length"), "value", F.lit(0).alias("distance"))
    start = start.withColumn("length", F.col("up").isNotNull().cast("int"))
    merge = lambda own, other: [F.col(f"{other}value").alias("value"), (F.col(f"{own}length") + F.coalesce(f"{other}distance", F.lit(0))).alias("distance")]
    found = climbed(start, merge, F.col("value").isNull())
    return found.select("node_id", "value", F.when(F.col("value").isNotNull(), F.col("distance")).alias("distance"), "cyclic")


def latest_revision_wins(changes: DataFrame) -> DataFrame:
    """(doc_id, key, value): of each key the newest revision's value."""
    return changes.groupBy("doc_id", "key").agg(F.max_by("value", "revision").alias("value"))


def top_n_fields(fields: DataFrame, n: int = 200) -> DataFrame:
    return fields.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))).filter(F.col("r") <= n)


def locale_sort(names: DataFrame, column: str, collation: str = "tr") -> DataFrame:
    return names.orderBy(F.collate(F.col(column), collation))


def missing_families(requested: DataFrame, available: DataFrame) -> DataFrame:
    return requested.select("family").distinct().join(available.select("family").distinct(), "family", "left_anti")


def warning_summary(warnings: DataFrame) -> DataFrame:
    """(code, message, n, first): per code the first message and the count, ordered by first appearance."""
    return warnings.groupBy("code").agg(F.min_by("message", "ord").alias("message"), F.count("*").alias("n"), F.min("ord").alias("first"))


def conformance_rollup(findings: DataFrame) -> DataFrame:
    """(document, profile, errors, warnings, conforms) with subtotals by document and a grand total, whose keys are null."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.rollup("document", "profile").agg(n("error").alias("errors"), n("warning").alias("warnings")).withColumn("conforms", F.col("errors") == 0)


def rules_checked(findings: DataFrame) -> DataFrame:
    return findings.groupBy("profile").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def dominant_value(rows: DataFrame) -> DataFrame:
    """(grp, value): the most frequent value; of equals the one seen first."""
    c = rows.groupBy("grp", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return c.groupBy("grp").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))


def character_inventory(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, characters, letters): characters of all texts, and how many different ones. Characters are counted within a document before they are shuffled."""
    each = docs.select(by, F.explode(F.array_distinct(F.split(text, ""))).alias("ch")).filter("ch <> ''")
    return each.groupBy(by, "ch").agg(F.count("*").alias("docs")).groupBy(by).agg(F.count("*").alias("characters"), F.sum("docs").alias("uses"))
