"""Queries over positioned text and boxes."""

from pyspark.sql import functions as F

from attestry.operators import layout as L
from attestry.operators import policy as P
from attestry.plans.fixtures import view
from attestry.plans.registry import query

_BOX = """SELECT l_orderkey % 400 AS page_id, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS id, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y, l_quantity AS width, CAST(l_partkey % 30 + 1 AS DOUBLE) AS height, CAST(l_partkey % 4 * 30 AS DOUBLE) AS degrees FROM {lineitem}"""
_B = _BOX.replace("{lineitem}", "lineitem")


def boxes(spark, sf):
    return spark.sql(_BOX, lineitem=view(spark, sf, "lineitem"))


def lines(spark, sf):
    """Lines of an order's items; items that repeat a line number are told apart by their text."""
    x = view(spark, sf, "fx_lines")
    cast = {c: F.col(c).cast("double") for c in ("x", "baseline", "font_size")} | {"right": F.col("line_end").cast("double"), "ord": F.col("ord") * 1000000 + F.expr("substr(text, 2)").cast("long")}
    return x.withColumns(cast)


@query("j12_overlap_pairs", f"""
WITH b AS (SELECT DISTINCT * FROM ({_B})) SELECT p.page_id, p.id AS a, q.id AS b FROM b p JOIN b q ON p.page_id = q.page_id AND p.id < q.id AND p.x < q.x + q.width AND q.x < p.x + p.width AND p.y < q.y + q.height AND q.y < p.y + p.height""")
def overlap_pairs(spark, sf):
    return L.overlap_pairs(boxes(spark, sf).distinct(), 60.0)


@query("p19_rect_predicates", f"""
WITH b AS (SELECT *, 100.0 AS fx, 150.0 AS fy, 200.0 AS fw, 250.0 AS fh FROM ({_B})) SELECT page_id, count(*) FILTER (WHERE x < fx + fw AND fx < x + width AND y < fy + fh AND fy < y + height) AS meets, count(*) FILTER (WHERE x >= fx AND y >= fy AND x + width <= fx + fw AND y + height <= fy + fh) AS inside, count(*) FILTER (WHERE 150.0 BETWEEN x AND x + width AND 200.0 BETWEEN y AND y + height) AS hits FROM b GROUP BY page_id""")
def rect_predicates(spark, sf):
    frame = L.column_box(F.lit(100.0), F.lit(150.0), F.lit(200.0), F.lit(250.0))
    own = L.column_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return boxes(spark, sf).select("page_id", own.alias("o"), frame.alias("f")).groupBy("page_id").agg(
        F.count_if(P.intersects(F.col("o"), F.col("f"))).alias("meets"), F.count_if(P.contains(F.col("f"), F.col("o"))).alias("inside"),
        F.count_if(P.contains_point(F.col("o"), F.lit(150.0), F.lit(200.0))).alias("hits"))


@query("a18_bounding_box", f"""
WITH r AS (SELECT page_id AS grp, x + width / 2 AS cx, y + height / 2 AS cy, (abs(width * cos(radians(degrees))) + abs(height * sin(radians(degrees)))) / 2 AS w, (abs(width * sin(radians(degrees))) + abs(height * cos(radians(degrees)))) / 2 AS h FROM ({_B})),
g AS (SELECT grp, min(cx - w) AS x0, min(cy - h) AS y0, max(cx + w) AS x1, max(cy + h) AS y1 FROM r GROUP BY grp)
SELECT grp, floor(x0 * 100 + 0.5) / 100 AS x, floor(y0 * 100 + 0.5) / 100 AS y, floor((x1 - x0) * 100 + 0.5) / 100 AS width, floor((y1 - y0) * 100 + 0.5) / 100 AS height FROM g""")
def bounding_box(spark, sf):
    return L.bounding_box(boxes(spark, sf).withColumnRenamed("page_id", "grp"))


@query("w2b_reading_space", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE -90 END AS angle, round(CASE l_partkey % 3 WHEN 0 THEN x WHEN 1 THEN y ELSE 0.0 - y END, 3) AS along, round(CASE l_partkey % 3 WHEN 0 THEN y WHEN 1 THEN 0.0 - x ELSE x END, 3) AS down, 11.0::DOUBLE AS size, 0.5 * 11.0 * length('w' || l_partkey)::DOUBLE AS width
FROM (SELECT *, l_quantity AS x, l_suppkey::DOUBLE AS y FROM lineitem) WHERE l_partkey % 13 <> 5""")
def reading_space(spark, sf):
    k = F.col("l_partkey") % 3
    items = view(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k == 0, 11.0).otherwise(0.0).alias("a"), F.when(k == 1, 11.0).when(k == 2, -11.0).otherwise(0.0).alias("b"), F.col("l_quantity").alias("x"),
        F.col("l_suppkey").cast("double").alias("y"), F.lit(None).cast("double").alias("width"), F.when(F.col("l_partkey") % 13 == 5, "  ").otherwise(F.concat(F.lit("w"), "l_partkey")).alias("text"))
    return L.reading_space(items).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "angle", F.round("along", 3).alias("along"), F.round("down", 3).alias("down"), "size", "width")


_ITEMS = """SELECT doc_id, page, ord * 1000000 + CAST(substr(text, 2) AS BIGINT) AS ord, CAST(ord * 30 + CAST(substr(text, 2) AS BIGINT) % 4 * 4 AS DOUBLE) AS x, ord * 30 + 25.0 AS edge,
  100.0 + CASE WHEN style_key = 'b' THEN 4.0 WHEN CAST(substr(text, 2) AS BIGINT) % 5 = 0 THEN 1.5 ELSE 0.0 END AS baseline, font_size, text FROM fx_lines"""


@query("w2_merge_runs", f"""
WITH RECURSIVE h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS n FROM ({_ITEMS})),
w(doc_id, page, n, run, base, size, edge, x, text, blank) AS (
  SELECT doc_id, page, n, 1, baseline::DOUBLE, font_size::DOUBLE, edge::DOUBLE, x::DOUBLE, text, FALSE FROM h WHERE n = 1
  UNION ALL SELECT doc_id, page, n, CASE WHEN j THEN run ELSE run + 1 END, CASE WHEN j THEN base ELSE baseline END, CASE WHEN j THEN size ELSE font_size END, edge, x, text, j AND gap > font_size * 0.15
  FROM (SELECT h.*, w.run, w.base, w.size, h.x - w.edge AS gap, abs(h.baseline - w.base) <= 1.5 AND abs(h.font_size - w.size) < 0.6 AND h.x >= w.edge - 1 AND h.x - w.edge <= h.font_size * 1.5 AS j
    FROM w JOIN h ON w.doc_id = h.doc_id AND w.page = h.page AND h.n = w.n + 1))
SELECT doc_id, page, run, string_agg(CASE WHEN blank THEN ' ' ELSE '' END || text, '' ORDER BY n) AS text, min(x) AS x, max(edge) AS right FROM w GROUP BY doc_id, page, run""")
def merge_runs(spark, sf):
    """Words of a line: items of one order at steps of some thirty points, a few of them lower or larger."""
    x = view(spark, sf, "fx_lines")
    k = F.expr("substr(text, 2)").cast("long")
    base = F.when(F.col("style_key") == "b", 104.0).when(k % 5 == 0, 101.5).otherwise(100.0)
    items = x.select("doc_id", "page", (F.col("ord") * 1000000 + k).alias("ord"), (F.col("ord") * 30 + k % 4 * 4).cast("double").alias("x"), (F.col("ord") * 30 + 25.0).cast("double").alias("right"), base.alias("baseline"), F.col("font_size").cast("double").alias("font_size"), "text")
    return L.merge_runs(items)


_GROUPED = """
WITH RECURSIVE h AS MATERIALIZED (SELECT doc_id, page, ord * 1000000 + CAST(substr(text, 2) AS BIGINT) AS ord, x::DOUBLE AS x, line_end::DOUBLE AS edge, baseline::DOUBLE AS baseline, font_size::DOUBLE AS font_size, style_key, text,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY baseline, ord * 1000000 + CAST(substr(text, 2) AS BIGINT)) AS n FROM fx_lines),
w(doc_id, page, n, ord, x, edge, baseline, font_size, text, run, px, pr, pend, psize, pstyle, pstep, plines) AS (
  SELECT doc_id, page, n, ord, x, edge, baseline, font_size, text, 1, x, edge, baseline, font_size, style_key, NULL::DOUBLE, 1 FROM h WHERE n = 1
  UNION ALL SELECT doc_id, page, n, ord, x, edge, baseline, font_size, text, CASE WHEN j THEN run ELSE run + 1 END, CASE WHEN j THEN least(px, x) ELSE x END, CASE WHEN j THEN greatest(pr, edge) ELSE edge END, baseline,
    CASE WHEN j THEN psize ELSE font_size END, style_key, CASE WHEN j THEN gap END, CASE WHEN j THEN plines + 1 ELSE 1 END
  FROM (SELECT h.*, run, px, pr, psize, plines, h.baseline - pend AS gap, pstyle = h.style_key AND abs(psize - h.font_size) <= 0.6 AND h.baseline > pend AND h.baseline - pend >= psize * 0.6 AND h.baseline - pend <= psize * 2.2
      AND (pstep IS NULL OR abs(h.baseline - pend - pstep) <= pstep * 0.3) AND (least(pr - px, h.edge - h.x) <= 0 OR least(pr, h.edge) - greatest(px, h.x) >= least(pr - px, h.edge - h.x) * 0.5)
      AND (abs(h.x - px) <= 1.5 OR (plines = 1 AND abs(h.x - px) <= psize * 4) OR abs((h.x + h.edge) / 2 - (px + pr) / 2) <= 1.5 OR abs(h.edge - pr) <= 1.5) AS j
    FROM w JOIN h ON w.doc_id = h.doc_id AND w.page = h.page AND h.n = w.n + 1))"""


@query("w3_group_paragraphs", f"{_GROUPED} SELECT doc_id, page, ord, run FROM w")
def group_paragraphs(spark, sf):
    return L.group_paragraphs(lines(spark, sf)).select("doc_id", "page", "ord", "run")


@query("w4_paragraph_summary", f"""{_GROUPED},
t AS (SELECT *, CASE WHEN (ord % 1000) % 4 = 1 THEN '  ' WHEN (ord % 1000) % 4 = 2 THEN ' ' || text || ' ' ELSE text END AS said, baseline - lag(baseline) OVER p AS step, lead(ord) OVER p IS NULL AS final FROM w WINDOW p AS (PARTITION BY doc_id, page, run ORDER BY n)),
g AS (SELECT doc_id, page, run, count(*) AS lines, median(step) AS mid, arg_min(font_size, n) AS size, max(x) - min(x) AS l, max(edge) - min(edge) AS r, max((x + edge) / 2) - min((x + edge) / 2) AS c,
  max(edge) FILTER (WHERE NOT final) - min(edge) FILTER (WHERE NOT final) AS body, arg_min(edge, n) AS first_edge, arg_max(edge, n) AS last_edge, coalesce(string_agg(trim(said), ' ' ORDER BY n) FILTER (WHERE trim(said) <> ''), '') AS text FROM t GROUP BY doc_id, page, run)
SELECT doc_id, page, run, lines, CASE WHEN lines < 2 THEN 'left' WHEN l <= 1.5 AND lines > 2 AND body <= 1.5 AND last_edge < first_edge - 1.5 THEN 'justify' WHEN l <= 1.5 THEN 'left' WHEN c <= 1.5 THEN 'center' WHEN r <= 1.5 THEN 'right' ELSE 'left' END AS align,
  floor(CASE WHEN mid > 0 THEN least(greatest(mid / size, 0.8), 4.0) ELSE 1.4 END * 100 + 0.5) / 100 AS line_height, text FROM g""")
def paragraph_summary(spark, sf):
    """Some lines are blank, and some have blanks around their text."""
    k = F.col("ord") % 1000 % 4
    said = F.when(k == 1, "  ").when(k == 2, F.concat(F.lit(" "), "text", F.lit(" "))).otherwise(F.col("text"))
    return L.paragraph_summary(L.group_paragraphs(lines(spark, sf).withColumn("text", said)))


_PLACED = f"SELECT page_id, id AS node_id, x, floor(y / 40) * 40 + id % 9 AS y, CASE WHEN id % 11 = 0 AND page_id % 3 <> 1 THEN (id % 1000)::INT END AS explicit FROM (SELECT DISTINCT * FROM ({_B}))"


@query("w5_reading_order", f"""
WITH RECURSIVE v AS MATERIALIZED ({_PLACED}), h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, node_id) AS n FROM v WHERE explicit IS NULL),
w(page_id, n, top, run) AS (SELECT page_id, n, y, 1 FROM h WHERE n = 1
  UNION ALL SELECT h.page_id, h.n, CASE WHEN h.y - w.top <= 6 THEN w.top ELSE h.y END, CASE WHEN h.y - w.top <= 6 THEN w.run ELSE w.run + 1 END FROM w JOIN h ON w.page_id = h.page_id AND h.n = w.n + 1)
SELECT page_id, node_id, row_number() OVER (PARTITION BY page_id ORDER BY run, explicit, CASE WHEN explicit IS NULL THEN x END, CASE WHEN explicit IS NULL THEN y END, node_id)::INT AS position, count(explicit) OVER (PARTITION BY page_id) = 0 AND count(*) OVER (PARTITION BY page_id) > 1 AS guessed
FROM (SELECT h.page_id, node_id, x, y, explicit, run FROM h JOIN w ON h.page_id = w.page_id AND h.n = w.n UNION ALL SELECT page_id, node_id, x, y, explicit, 0 FROM v WHERE explicit IS NOT NULL)""")
def reading_order(spark, sf):
    """Boxes on rows whose nodes lie up to 8 points apart; a third of the pages have no places given."""
    b = boxes(spark, sf).distinct()
    explicit = F.when((F.col("id") % 11 == 0) & (F.col("page_id") % 3 != 1), (F.col("id") % 1000).cast("int"))
    return L.reading_order(b.select("page_id", F.col("id").alias("node_id"), "x", (F.floor(F.col("y") / 40) * 40 + F.col("id") % 9).cast("double").alias("y"), explicit.alias("explicit")))


_FIT = "CASE WHEN acc.line = '' THEN {'done': acc.done, 'line': x.line} WHEN length(acc.line) + 1 + length(x.line) <= 200 THEN {'done': acc.done, 'line': acc.line || ' ' || x.line} ELSE {'done': list_append(acc.done, acc.line), 'line': x.line} END"


@query("w14_pack_chunks", f"""
WITH p AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: list_transform(range(0, length(w), 200), lambda i: substr(w, i + 1, 200)))) AS pieces FROM documents),
f AS (SELECT doc_id, list_reduce([{{'done': []::VARCHAR[], 'line': ''}}] || list_transform(pieces, lambda w: {{'done': []::VARCHAR[], 'line': w}}), lambda acc, x: {_FIT}) AS r FROM p WHERE len(pieces) > 0)
SELECT doc_id, (k - 1)::INT AS chunk, ((k - 1) // 50)::INT AS page, ((k - 1) % 50)::INT AS line, lines[k] AS text FROM (SELECT doc_id, list_append(r.done, r.line) AS lines, unnest(range(1, len(r.done) + 2)) AS k FROM f)""")
def pack_chunks(spark, sf):
    return L.pack_chunks(view(spark, sf, "documents"), 200)
