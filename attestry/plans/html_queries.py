"""Queries over pages as node tables."""

from pyspark.sql import functions as F

from attestry.operators import generic as G
from attestry.operators import html as H
from attestry.operators import styles
from attestry.plans.fixtures import view
from attestry.plans.registry import query
from attestry.sources.html import html_nodes


def nodes(spark, sf):
    """The node table of all pages. Texts hold no tags, so SQL can count tags in the source to hold results against."""
    return html_nodes(view(spark, sf, "pages"))


#: pages without comments and script, whose text might look like tags
_BODY = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<script></script>', 'gs')"
COUNT = lambda p: f"len(regexp_extract_all({_BODY}, '{p}'))"


@query("s6_html_nodes")
def html_node_table(spark, sf):
    return nodes(spark, sf).select("page_id", "node_id", "parent_id", "pre", "post", "depth", "tag", F.map_entries("attrs").alias("attrs"), "text")


@query("a12_element_inventory", f"""
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all({_BODY}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY page_id, tag""")
def element_inventory(spark, sf):
    return H.element_inventory(nodes(spark, sf))


@query("p18_select_nodes", f"SELECT page_id, {COUNT('<a href=.[/]')} AS local_links, {COUNT('<div class=.ad.')} AS ads, {COUNT('<meta charset=.utf-8')} AS charsets FROM pages")
def select_simple(spark, sf):
    n = nodes(spark, sf)
    return n.groupBy("page_id").agg(
        F.count_if(H.matches_simple("a", attributes=(("href", "^=", "/"),))).alias("local_links"), F.count_if(H.matches_simple("div", classes=("ad",))).alias("ads"),
        F.count_if(H.matches_simple("meta", attributes=(("charset", "=", "utf-8"),))).alias("charsets"))


@query("j18_select_combinators", f"SELECT page_id, {COUNT('<li><a ')} AS list_links, {COUNT('<nav>')} AS lists FROM pages WHERE html LIKE '%<li><a %'")
def select_combinators(spark, sf):
    n = nodes(spark, sf)
    links = H.select_nodes(n, (H.matches_simple("nav"), ""), (H.matches_simple("li"), " "), (H.matches_simple("a"), ">")).groupBy("page_id").agg(F.count("*").alias("list_links"))
    lists = H.select_nodes(n, (H.matches_simple("nav"), ""), (H.matches_simple("ul"), ">")).groupBy("page_id").agg(F.count("*").alias("lists"))
    return links.join(lists, "page_id")


@query("w8_sibling_position", f"SELECT page_id, {COUNT('<li>')} AS items, ({COUNT('<li>')} + 1) // 2 AS odd, ({COUNT('<li>')} + 1) // 3 AS third FROM pages WHERE html LIKE '%<li>%'")
def sibling_position(spark, sf):
    x = H.sibling_position(nodes(spark, sf)).filter("tag = 'li'")
    return x.groupBy("page_id").agg(F.count("*").alias("items"), F.count_if(H.nth_child(2, 1)).alias("odd"), F.count_if(H.nth_child(3, 2)).alias("third"))


_DECL = """SELECT l_orderkey AS page_id, l_partkey % 3 AS node_id, l_returnflag AS property, l_quantity AS value, l_partkey % 7 = 0 AS important, l_suppkey % 5 = 0 AS inline, l_linenumber % 2 AS origin, l_suppkey % 2 AS a, l_partkey % 4 AS b, l_suppkey % 3 AS c,
  (CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey) * 100 + CAST(l_quantity AS INT) AS ord FROM {lineitem}"""


@query("t3_effective_declarations", f"""
SELECT page_id, node_id, property, max(struct_pack(i := important, l := inline, o := origin, a := a, b := b, c := c, d := ord, v := value)).v AS value FROM ({_DECL.replace('{lineitem}', 'lineitem')}) GROUP BY ALL""")
def effective_declarations(spark, sf):
    return H.effective_declarations(spark.sql(_DECL, lineitem=view(spark, sf, "lineitem")))


#: (rule_id, selector, origin, ord, property, value, important); each part adds a rule of its own that fits nothing.
_SHEET = [
    (1, "li > a", 1, 1, "color", "list", False), (2, "nav a", 1, 2, "color", "nav", False), (2, "nav a", 1, 2, "font-weight", "bold", False), (3, 'ul li > a[href^="/t"]', 1, 0, "color", "t", False), (4, ".ad", 0, 0, "display", "block", True),
    (5, "body > div.ad:not(#x)", 1, 3, "display", "none", False), (6, "body > footer", 1, 4, "font-size", "small", False), (7, "div footer", 2, 0, "font-size", "none", False), (8, "nav li:nth-child(odd) > a", 1, 5, "margin", "odd", False), (9, "html head > meta[charset|=utf]", 1, 6, "display", "none", False),
]
_STYLED = [
    ("color", "t", COUNT('<li><a href=.[/]t')), ("color", "nav", f"{COUNT('<li><a ')} - {COUNT('<li><a href=.[/]t')}"), ("font-weight", "bold", COUNT("<li><a ")), ("margin", "odd", f"({COUNT('<li><a ')} + 1) // 2"),
    ("display", "block", COUNT("<div class=.ad.")), ("display", "none", COUNT("<meta charset=.utf-8")), ("font-size", "small", COUNT("<footer>")),
]


@query("t3_cascaded_styles", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT page_id, '{p}' AS property, '{v}' AS value, {n} AS n FROM pages" for p, v, n in _STYLED) + ") WHERE n > 0")
def cascaded_styles(spark, sf):
    """How many nodes of each page get which value, from a style sheet of some rules and one more a part."""
    sheet = spark.createDataFrame(_SHEET, "rule_id long, selector string, origin int, ord long, property string, value string, important boolean")
    more = view(spark, sf, "part").selectExpr("p_partkey + 100 AS rule_id", "concat('nav li > a.p', p_partkey, ' > #q', p_size) AS selector", "1 AS origin", "p_partkey AS ord", "'color' AS property", "p_brand AS value", "true AS important")
    every = sheet.unionByName(more.select(F.col("rule_id").cast("long"), "selector", "origin", F.col("ord").cast("long"), "property", "value", "important"))
    found = styles.cascaded_styles(nodes(spark, sf), every.select("rule_id", "selector", "origin", "ord").distinct(), every.select("rule_id", "property", "value", "important"))
    return found.groupBy("page_id", "property", "value").agg(F.count("*").alias("n"))


_H1 = "trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("t7_nested_outline", f"SELECT page_id, 1 AS level, {_H1} AS title FROM pages WHERE html LIKE '%<h1>%' AND {_H1} <> ''")
def nested_outline(spark, sf):
    return H.nested_outline(nodes(spark, sf)).select("page_id", "level", "title")


@query("f10_node_text")
def node_text(spark, sf):
    n = nodes(spark, sf)
    return H.node_text(n, n.filter("tag = 'body'")).select("page_id", "text")


@query("w6_heading_skips")
def heading_skips(spark, sf):
    """Pages have one heading each, so levels are given by the links of a page."""
    x = nodes(spark, sf).filter("tag = 'a'").select("page_id", "pre", (1 + F.pmod(F.xxhash64("page_id", "pre"), F.lit(4))).cast("int").alias("level"))
    return H.heading_skips(x)


_LEVELS = "SELECT user_id AS page_id, event_id AS pre, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 3 ELSE 5 END AS level FROM {events}"


@query("w6_heading_skips_levels", f"""
WITH x AS (SELECT *, max(level) OVER (PARTITION BY page_id ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deepest, row_number() OVER (PARTITION BY page_id ORDER BY pre) AS n FROM ({_LEVELS.replace('{events}', 'events')}))
SELECT page_id, 'HEADING_SKIP' AS rule, min(pre) AS pre FROM x WHERE level > deepest + 1 GROUP BY page_id UNION ALL SELECT page_id, 'FIRST_NOT_H1', pre FROM x WHERE n = 1 AND level > 1""")
def heading_skips_levels(spark, sf):
    return H.heading_skips(spark.sql(_LEVELS, events=view(spark, sf, "events")))


@query("u3_remote_references", "SELECT DISTINCT page_id, unnest([url, url || '?bg', url || '?css']) AS url FROM pages WHERE regexp_matches(url, '^https?://')")
def remote_references(spark, sf):
    """Pages load nothing from elsewhere, so their own URL is put in front of each as an image and a style."""
    p = view(spark, sf, "pages")
    html = F.concat(F.lit('<img src="'), "url", F.lit('"><div style="background:url('), "url", F.lit("?bg)\"></div><link rel=stylesheet href='"), "url", F.lit("?css'>"), "html")
    return H.remote_references(html_nodes(p.withColumn("html", html)))


_ROLES = "('h1', 'H1'), ('h2', 'H2'), ('h3', 'H3'), ('h4', 'H4'), ('h5', 'H5'), ('h6', 'H6'), ('p', 'P'), ('blockquote', 'BlockQuote'), ('pre', 'Code'), ('ul', 'L'), ('ol', 'L'), ('li', 'LI'), ('dl', 'L'), ('dt', 'Lbl'), ('dd', 'LBody'), ('table', 'Table'), ('thead', 'THead'), ('tbody', 'TBody'), ('tfoot', 'TFoot'), ('tr', 'TR'), ('th', 'TH'), ('td', 'TD'), ('caption', 'Caption'), ('figure', 'Figure'), ('figcaption', 'Caption'), ('img', 'Figure'), ('a', 'Link'), ('article', 'Art'), ('section', 'Sect'), ('aside', 'Aside'), ('header', 'Sect'), ('footer', 'Sect'), ('main', 'Sect'), ('nav', 'Sect'), ('div', 'Div'), ('span', 'Span'), ('form', 'Form')"
#: Put behind each page, so that roles occur that the pages themselves don't have.
_TAIL = "<dl><dt>a<dd>b</dl><table><caption>c</caption><thead><tr><th>d<tbody><tr><td>e</table><figure><img src=x><figcaption>f</figcaption></figure><aside>g</aside><pre>h</pre><form><span>i</span></form><hr>"


@query("a13_role_statistics", f"""
SELECT page_id, role, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all({_BODY.replace('html', f"(html || '{_TAIL}')", 1)}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) JOIN (VALUES {_ROLES}) AS r(tag, role) USING (tag) GROUP BY ALL""")
def role_statistics(spark, sf):
    return H.role_statistics(html_nodes(view(spark, sf, "pages").withColumn("html", F.concat("html", F.lit(_TAIL)))))


#: Structures with the rules that each breaks; list items of the pages themselves break theirs.
_PARTS = [
    ("<table></table>", ["TABLE_WITHOUT_ROWS", "TABLE_WITHOUT_HEADERS"]), ("<table><tr><td>x</td></tr></table>", ["TABLE_WITHOUT_HEADERS"]), ("<table><tr><th scope=col>x</th></tr></table>", []),
    ("<table>" + "<div>" * 8 + "<tr></tr>" + "</div>" * 8 + "</table>", ["TABLE_WITHOUT_HEADERS"]), ("<table>" + "<div>" * 9 + "<tr></tr>" + "</div>" * 9 + "</table>", ["TABLE_WITHOUT_ROWS", "TABLE_WITHOUT_HEADERS"]),
    ("<li><dl><dt>x</dl></li>", []), ("<li><b><dd>x</dd></b></li>", []), ("<li>x</li>", ["ITEM_WITHOUT_BODY"]), ("<table><tr><td><table><tr><th>x</table></table>", []),
]
_BROKEN = ", ".join(f"({n}, '{r}')" for n, (_, rules) in enumerate(_PARTS) for r in rules)


@query("a20_structure_checks", f"""
SELECT page_id, rule, CASE rule WHEN 'TABLE_WITHOUT_ROWS' THEN 'error' ELSE 'warning' END AS severity FROM (
  SELECT page_id, rule FROM pages JOIN (VALUES {_BROKEN}) AS b(n, rule) ON page_id % {len(_PARTS)} = n UNION ALL SELECT page_id, 'ITEM_WITHOUT_BODY' FROM (SELECT page_id, unnest(range({COUNT('<li>')})) FROM pages))""")
def structure_checks(spark, sf):
    """Every page gets a structure in front, by its number."""
    part = F.get(F.array(*[F.lit(t) for t, _ in _PARTS]), (F.col("page_id") % len(_PARTS)).cast("int"))
    return H.structure_checks(html_nodes(view(spark, sf, "pages").withColumn("html", F.concat(part, "html")))).select("page_id", "rule", "severity")


def faulty(spark, sf):
    """Pages with a fault each by their number: no language, an empty title, an image without a text, a link without one, a third-level heading after the first."""
    k, html = F.col("page_id"), F.col("html")
    html = F.when(k % 4 == 0, F.replace(html, F.lit("<html lang="), F.lit("<html data-x="))).otherwise(html)
    html = F.when(k % 5 == 0, F.regexp_replace(html, "(?s)<title>.*?</title>", "<title> </title>")).otherwise(html)
    more = F.when(k % 3 == 0, '<img src="/x.png"><img role="presentation"><img alt="t">').when(k % 3 == 1, '<a href="/y"></a><a href="/z" aria-label="z"></a>').otherwise("<h3>x</h3><table><tr><th>y</th></tr></table>")
    return html_nodes(view(spark, sf, "pages").withColumn("html", F.replace(html, F.lit("</article>"), F.concat(more, F.lit("</article>")))))


_QUALITY = """
SELECT page_id, 'NO_LANGUAGE' AS rule, 'error' AS severity FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'NO_TITLE', 'error' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'NO_ALTERNATIVE' WHEN 1 THEN 'SILENT_LINK' ELSE 'NO_SCOPE' END, CASE page_id % 3 WHEN 0 THEN 'error' ELSE 'warning' END FROM pages WHERE html LIKE '%</article>%'
UNION ALL SELECT page_id, 'HEADING_SKIP', 'error' FROM pages WHERE page_id % 3 = 2 AND html LIKE '%</article>%'
UNION ALL SELECT page_id, 'ITEM_WITHOUT_BODY', 'warning' FROM (SELECT page_id, unnest(range(""" + COUNT("<li>") + """)) FROM pages)"""


@query("page_quality", _QUALITY)
def page_quality(spark, sf):
    return H.page_quality(faulty(spark, sf)).select("page_id", "rule", "severity")


@query("page_quality_rollup", f"""
SELECT page_id AS document, rule AS profile, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS conforms FROM ({_QUALITY}) GROUP BY ROLLUP (page_id, rule)""")
def page_quality_rollup(spark, sf):
    return G.conformance_rollup(H.page_quality(faulty(spark, sf)).select(F.col("page_id").alias("document"), F.col("rule").alias("profile"), "severity"))


#: texts between tags, entities undone; a script's text is one more
_TEXTS = f"list_filter(string_split_regex(regexp_replace({_BODY}, '<style>.*?</style>', '<style></style>', 'gs'), '<[^>]*>'), lambda t: t <> '')"
_PLAIN = "regexp_replace(array_to_string(texts, ''), '&(lt|gt|quot|amp|copy|middot|#x27);', '.', 'g')"


@query("a11_document_profile", f"""
SELECT page_id, len(tags) AS elements, len(texts) + len(scripts) AS texts, len(list_filter(tags, lambda t: t = 'a')) AS links, len(list_distinct(tags)) AS distinct_tags, length({_PLAIN}) + length(array_to_string(scripts, '')) AS letters
FROM (SELECT page_id, regexp_extract_all({_BODY}, '<([a-z][a-z0-9]*)', 1) AS tags, {_TEXTS} AS texts, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS scripts FROM pages)""")
def document_profile(spark, sf):
    return H.document_profile(nodes(spark, sf)).select("page_id", "elements", "texts", "links", "distinct_tags", "letters")


@query("a11_document_depth")
def document_depth(spark, sf):
    return H.document_profile(nodes(spark, sf)).select("page_id", "depth")
