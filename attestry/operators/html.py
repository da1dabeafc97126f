"""Selections, cascades, outlines and quality rules over node tables of pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.operators.structure import structural_join
from attestry.sources import cut

#: Structural role by tag.
ROLES = {
    "h1": "H1", "h2": "H2", "h3": "H3", "h4": "H4", "h5": "H5", "h6": "H6", "p": "P", "blockquote": "BlockQuote", "pre": "Code", "ul": "L", "ol": "L", "li": "LI", "dl": "L", "dt": "Lbl", "dd": "LBody",
    "table": "Table", "thead": "THead", "tbody": "TBody", "tfoot": "TFoot", "tr": "TR", "th": "TH", "td": "TD", "caption": "Caption", "figure": "Figure", "figcaption": "Caption", "img": "Figure", "a": "Link",
    "article": "Art", "section": "Sect", "aside": "Aside", "header": "Sect", "footer": "Sect", "main": "Sect", "nav": "Sect", "div": "Div", "span": "Span", "form": "Form",
}


def attribute(name: str, attrs: str = "attrs") -> Column:
    return F.try_element_at(attrs, F.lit(name))


def matches_simple(tag: str | None = None, id: str | None = None, classes: tuple = (), attributes: tuple = (), without: Column | None = None) -> Column:
    """A simple selector: tag (None: any), id, all classes, attribute tests (name, operator, value) with = ^= $= *= ~= |= or None for presence, and a negated condition."""
    ok = F.col("tag") == tag if tag else ~F.col("tag").startswith("#")
    if id:
        ok = ok & (attribute("id") == id)
    for c in classes:
        ok = ok & F.array_contains(F.split(attribute("class"), r"\s+"), c)
    for name, op, value in attributes:
        a, v = attribute(name), F.lit(value)
        ok = ok & {
            None: a.isNotNull(), "=": a == v, "^=": F.startswith(a, v), "$=": F.endswith(a, v), "*=": F.contains(a, v),
            "~=": F.array_contains(F.split(a, r"\s+"), value), "|=": (a == v) | F.startswith(a, F.concat(v, F.lit("-"))),
        }[op]
    return F.coalesce(ok & ~without if without is not None else ok, F.lit(False))


def select_nodes(nodes: DataFrame, *parts: tuple[Column, str]) -> DataFrame:
    """(page_id, node_id) for a chain of (condition, combinator) from left to right, combinator ' ' or '>' before each part but the first.

    Ancestors are taken from the right, each step going to the nearest ancestor that matches, without trying others.
    """
    *rest, (last, combinator) = parts
    place = ["page_id", "node_id", "parent_id", "pre", "depth"]
    at = nodes.filter(last).select(*place, F.col("node_id").alias("found"))
    for condition, before in reversed(rest):
        up = nodes.filter(condition)
        if combinator == ">":
            met = at.select("page_id", F.col("parent_id").alias("node_id"), "found").join(up.select(*place), ["page_id", "node_id"])
        else:
            outer = up.select("page_id", "pre", "post", "depth", F.struct("node_id", "parent_id", "pre", "depth").alias("up_id"))
            near = structural_join(at.select("page_id", "pre", "depth", "found"), outer, nearest=True).filter("up_id IS NOT NULL")
            met = near.select("page_id", "found", "up_id.*")
        at, combinator = met.select(*place, "found"), before
    return at.select("page_id", F.col("found").alias("node_id"))


def sibling_position(nodes: DataFrame) -> DataFrame:
    """Elements with nth (from 1), siblings, first, last and only."""
    w = W.partitionBy("page_id", "parent_id")
    x = nodes.filter(~F.col("tag").startswith("#")).withColumns({"nth": F.row_number().over(w.orderBy("pre")), "siblings": F.count("*").over(w)})
    return x.withColumns({"first": F.col("nth") == 1, "last": F.col("nth") == F.col("siblings"), "only": F.col("siblings") == 1})


def nth_child(a: int, b: int) -> Column:
    """Whether nth is a*n + b for some n of 0 or more."""
    n = F.col("nth")
    return n == b if a == 0 else ((n - b) % a == 0) & ((n - b) / a >= 0)


def effective_declarations(declared: DataFrame) -> DataFrame:
    """(page_id, node_id, property, value): important, then inline, then origin, then specificity a, b, c, then order; the last wins."""
    rank = F.struct("important", "inline", "origin", "a", "b", "c", "ord")
    return declared.groupBy("page_id", "node_id", "property").agg(F.max_by("value", rank).alias("value"))


def node_text(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(page_id, node_id, text): text of all descendants in order; script and style are left out."""
    raw = nodes.filter("tag IN ('script', 'style')").select("page_id", F.col("node_id").alias("parent_id"))
    words = nodes.filter("tag = '#text'").join(raw, ["page_id", "parent_id"], "left_anti").select("page_id", "pre", "depth", "text")
    met = structural_join(words, of.select("page_id", "pre", "post", "depth", F.col("node_id").alias("up_id"))).withColumnRenamed("up_id", "node_id")
    return met.groupBy("page_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: s["text"]), "").alias("text"))


def nested_outline(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, level, title) of headings with text."""
    heads = nodes.filter(F.col("tag").rlike("^h[1-6]$"))
    titled = node_text(nodes, heads).withColumn("title", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("title <> ''")
    return heads.select("page_id", "node_id", "pre", F.substring("tag", 2, 1).cast("int").alias("level")).join(titled, ["page_id", "node_id"]).select("page_id", "pre", "level", "title")


def heading_skips(outline: DataFrame) -> DataFrame:
    """(page_id, rule, pre): the first heading more than one level below all before it, and a first heading that is not level 1."""
    w = W.partitionBy("page_id").orderBy("pre")
    x = outline.withColumns({"deepest": F.max("level").over(w.rowsBetween(W.unboundedPreceding, -1)), "n": F.row_number().over(w)})
    skip = x.filter("level > deepest + 1").groupBy("page_id").agg(F.min("pre").alias("pre")).select("page_id", F.lit("HEADING_SKIP").alias("rule"), "pre")
    return skip.unionByName(x.filter("n = 1 AND level > 1").select("page_id", F.lit("FIRST_NOT_H1").alias("rule"), "pre"))


def remote_references(nodes: DataFrame) -> DataFrame:
    """Distinct (page_id, url) that a page loads from http(s): img src, url() in styles and style attributes, stylesheets."""
    urls = lambda c: F.regexp_extract_all(c, F.lit(r"url\(\s*[\"']?(https?://[^)\"']+)"), F.lit(1))
    found = F.concat(
        F.when(F.col("tag") == "img", F.array(attribute("src"))).otherwise(F.array().cast("array<string>")), F.coalesce(urls(attribute("style")), F.array().cast("array<string>")),
        F.when((F.col("tag") == "link") & (attribute("rel") == "stylesheet"), F.array(attribute("href"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("tag") == "style", urls(F.coalesce("text", F.lit("")))).otherwise(F.array().cast("array<string>")))
    return nodes.select("page_id", F.explode(found).alias("url")).filter(F.col("url").rlike("^https?://")).distinct()


def element_inventory(nodes: DataFrame) -> DataFrame:
    """(page_id, tag, n) of elements."""
    return nodes.filter(~F.col("tag").startswith("#")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def role_statistics(nodes: DataFrame) -> DataFrame:
    """(page_id, role, n): elements by structural role; tags without one don't count."""
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return nodes.withColumn("role", F.try_element_at(role, F.col("tag"))).filter("role IS NOT NULL").groupBy("page_id", "role").agg(F.count("*").alias("n"))


def structure_checks(nodes: DataFrame, levels: int = 9) -> DataFrame:
    """(page_id, node_id, rule, severity): a table without rows (error) or header cells (warning), and a list item without label or body (warning), at most `levels` below."""
    tops = nodes.filter("tag IN ('table', 'li')").select("page_id", "node_id", "tag", "pre", "post", "depth")
    parts = nodes.filter("tag IN ('tr', 'th', 'dt', 'dd')").select("page_id", "pre", "depth", F.col("tag").alias("part"))
    inside = structural_join(parts, tops.select("page_id", "pre", "post", "depth", F.col("node_id").alias("up_id")), levels=levels)
    found = inside.groupBy("page_id", F.col("up_id").alias("node_id")).agg(F.collect_set("part").alias("parts"))
    has = lambda *tags: F.coalesce(F.arrays_overlap("parts", F.array(*map(F.lit, tags))), F.lit(False))
    rule = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
    table = F.col("tag") == "table"
    rules = F.array(
        rule(table & ~has("tr"), "TABLE_WITHOUT_ROWS", "error"), rule(table & ~has("th"), "TABLE_WITHOUT_HEADERS", "warning"), rule(~table & ~has("dt", "dd"), "ITEM_WITHOUT_BODY", "warning"),
    )
    return tops.join(found, ["page_id", "node_id"], "left").select("page_id", "node_id", F.inline(F.filter(rules, lambda r: r.isNotNull())))


def decorative() -> Column:
    return F.coalesce(attribute("role").isin("presentation", "none"), F.lit(False)) | F.coalesce(attribute("aria-hidden") == "true", F.lit(False))


def page_quality(nodes: DataFrame) -> DataFrame:
    """(page_id, rule, severity, detail): language, title, headings, alternative texts, links, tables, lists and header scopes.

    Nodes that no rule asks about are dropped and the rest is written once, so that pages are parsed once. Rules on a node itself are one pass over them, texts of
    titles, links and headings one join, and the rules on a page one aggregate.
    """
    asked = nodes.filter("tag IN ('#document', '#text', 'script', 'style', 'html', 'title', 'img', 'a', 'th', 'table', 'tr', 'li', 'dt', 'dd') OR tag RLIKE '^h[1-6]$'")
    x = cut(asked, "page-nodes")
    said = lambda rule, severity, detail: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    none, own = F.lit(None), F.col("node_id")
    alt = F.coalesce(attribute("aria-label"), attribute("alt"))
    on_node = x.select("page_id", F.when((F.col("tag") == "img") & ~decorative() & alt.isNull(), said("NO_ALTERNATIVE", "error", own)).when((F.col("tag") == "th") & attribute("scope").isNull(), said("NO_SCOPE", "warning", own)).alias("s"))
    link = (F.col("tag") == "a") & attribute("href").isNotNull() & (F.coalesce(attribute("aria-label"), F.lit("")) == "")
    titled = x.filter((F.col("tag") == "title") | link | F.col("tag").rlike("^h[1-6]$")).select("page_id", "node_id", "pre", "post", "depth", "tag")
    texts = cut(titled.drop("post", "depth").join(node_text(x, titled), ["page_id", "node_id"], "left").withColumn("title", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))), "page-texts")
    silent = texts.filter("tag = 'a' AND title = ''").select("page_id", said("SILENT_LINK", "warning", own).alias("s"))
    facts = x.select("page_id", ((F.col("tag") == "html") & (F.coalesce(attribute("lang"), F.lit("")) != "")).alias("lang"), F.lit(False).alias("title"))
    facts = facts.unionByName(texts.filter("tag = 'title' AND title <> ''").select("page_id", F.lit(False).alias("lang"), F.lit(True).alias("title")))
    pages = facts.groupBy("page_id").agg(F.bool_or("lang").alias("lang"), F.bool_or("title").alias("title"))
    on_page = pages.select("page_id", F.explode(F.filter(F.array(F.when(~F.col("lang"), said("NO_LANGUAGE", "error", none)), F.when(~F.col("title"), said("NO_TITLE", "error", none))), lambda s: s.isNotNull())).alias("s"))
    outline = texts.filter("tag RLIKE '^h[1-6]$' AND title <> ''").select("page_id", "pre", F.substring("tag", 2, 1).cast("int").alias("level"))
    skips = heading_skips(outline).select("page_id", F.struct("rule", F.when(F.col("rule") == "HEADING_SKIP", "error").otherwise("warning").alias("severity"), F.col("pre").cast("string").alias("detail")).alias("s"))
    parts = structure_checks(x).select("page_id", F.struct("rule", "severity", own.cast("string").alias("detail")).alias("s"))
    every = on_node.filter("s IS NOT NULL").unionByName(silent).unionByName(on_page).unionByName(skips).unionByName(parts)
    return every.select("page_id", "s.rule", "s.severity", "s.detail")


def document_profile(nodes: DataFrame) -> DataFrame:
    """(page_id, elements, texts, links, distinct_tags, depth, letters) of each page."""
    element = ~F.col("tag").startswith("#")
    return nodes.groupBy("page_id").agg(
        F.count_if(element).alias("elements"), F.count_if(F.col("tag") == "#text").alias("texts"), F.count_if(F.col("tag") == "a").alias("links"),
        F.count_distinct(F.when(element, F.col("tag"))).alias("distinct_tags"), F.max("depth").alias("depth"), F.sum(F.coalesce(F.when(F.col("tag") == "#text", F.char_length("text")), F.lit(0))).alias("letters"))
