"""Queries over variants, fields, revisions, findings and characters."""

from pyspark.sql import functions as F

from attestry import sources as S
from attestry.functions import scalars as C
from attestry.operators import generic as G
from attestry.plans.fixtures import view
from attestry.plans.registry import query

#: a page a line item: revision 1 is its state after an edit
_REV = """SELECT doc_id, page, CASE WHEN p % 50 <> 7 THEN md5(p || '-0') END AS d0, CASE WHEN p % 50 <> 7 THEN md5(p || CASE WHEN s % 9 = 1 THEN '-1' ELSE '-0' END) END AS d1, q AS x0, CASE WHEN p % 31 = 2 THEN q + 1 ELSE q END AS x1,
    md5(s || '-o') AS o0, CASE WHEN p % 29 = 3 THEN CAST(NULL AS STRING) ELSE md5(s || '-o') END AS o1, page = 1 OR p % 40 <> 3 AS kept
  FROM (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""
_ACT = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN CAST(NULL AS STRING) ELSE o_orderstatus END AS a0, CASE WHEN o_orderkey % 37 = 4 THEN 'js' WHEN o_orderstatus = 'P' THEN CAST(NULL AS STRING) ELSE o_orderstatus END AS a1,
  CASE WHEN o_orderkey % 41 = 5 THEN 'n' END AS n1, o_orderkey % 43 <> 6 AS kept FROM {orders} WHERE o_orderkey % 5 <> 2"""


def revisions(spark, sf):
    x = spark.sql(_REV, lineitem=view(spark, sf, "lineitem"))
    of = lambda df, k: df.select("doc_id", "page", F.col(f"d{k}").alias("digest"), F.col(f"x{k}").alias("box"), F.col(f"o{k}").alias("objects"))
    return of(x, 0), of(x.filter("kept"), 1)


def actions(spark, sf):
    x = spark.sql(_ACT, orders=view(spark, sf, "orders"))
    none = F.lit(None).cast("string")
    return x.select("doc_id", F.col("a0").alias("open_action"), none.alias("aa"), none.alias("names")), x.filter("kept").select("doc_id", F.col("a1").alias("open_action"), none.alias("aa"), F.col("n1").alias("names"))


@query("j11_snapshot_diff", f"""
WITH r AS ({_REV.replace('{lineitem}', 'lineitem')}), a AS ({_ACT.replace('{orders}', 'orders')}),
g AS (SELECT doc_id, count(*) <> count(*) FILTER (WHERE kept) AS page_count_changed,
  CASE WHEN coalesce(bool_or(d0 <> d1) FILTER (WHERE kept), FALSE) THEN TRUE WHEN coalesce(bool_or(d0 IS NULL OR d1 IS NULL) FILTER (WHERE kept), FALSE) THEN NULL ELSE FALSE END AS content_changed,
  coalesce(bool_or(x0 IS DISTINCT FROM x1) FILTER (WHERE kept), FALSE) AS box_changed, coalesce(bool_or(o0 IS DISTINCT FROM o1) FILTER (WHERE kept), FALSE) AS objects_changed FROM r GROUP BY doc_id),
j AS (SELECT g.*, coalesce(CASE WHEN a.kept THEN a.a0 IS DISTINCT FROM a.a1 OR a.n1 IS NOT NULL ELSE a.a0 IS NOT NULL END, FALSE) AS actions_changed FROM g LEFT JOIN a ON g.doc_id = a.doc_id)
SELECT *, CASE WHEN page_count_changed OR box_changed OR objects_changed OR actions_changed THEN TRUE ELSE content_changed END AS changed FROM j""")
def snapshot_diff(spark, sf):
    return G.snapshot_diff(*revisions(spark, sf), *actions(spark, sf))


@query("j13_missing_references", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def missing_references(spark, sf):
    uses = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return G.missing_references(uses, view(spark, sf, "part").filter("p_size > 10"), "p_partkey").select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("l_partkey"))


@query("j14_unused_assets", "SELECT count(*) AS unused, coalesce(sum(p_size), 0)::BIGINT AS freed FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def unused_assets(spark, sf):
    uses = view(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return G.unused_assets(view(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("bytes")), uses, "p_partkey")


@query("j16_metadata_consistency", """
WITH i AS (SELECT o_orderkey AS doc_id, 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders),
x AS (SELECT l_orderkey AS doc_id, 'status' AS key, max(l_linestatus) AS value FROM lineitem GROUP BY l_orderkey)
SELECT i.doc_id, i.key, CASE WHEN x.value IS NULL THEN 'MISSING' ELSE 'DIFFERS' END AS issue FROM i LEFT JOIN x ON i.doc_id = x.doc_id AND i.key = x.key WHERE x.value IS NULL OR x.value <> i.value""")
def metadata_consistency(spark, sf):
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
    info = view(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(pair("status", "o_orderstatus"), pair("priority", "o_orderpriority"))))
    xmp = view(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linestatus").alias("value")).withColumn("key", F.lit("status"))
    return G.metadata_consistency(info, xmp)


_VAR = "SELECT lower(p_brand) AS family, p_size * 20 AS weight, CASE WHEN p_type = 'PROMO' THEN 'italic' WHEN p_type = 'ECONOMY' THEN 'oblique' ELSE 'normal' END AS style, p_partkey AS ordinal FROM {part}"
_REQ = "SELECT o_orderkey AS request_id, 'brand#' || (o_custkey % 30) AS family, 100 + o_orderkey % 9 * 100 AS want_weight, CASE WHEN o_orderkey % 3 = 0 THEN 'italic' ELSE 'normal' END AS want_style FROM {orders}"


@query("j17_best_variant", f"""
WITH v AS ({_VAR.replace('{part}', 'part')}), r AS ({_REQ.replace('{orders}', 'orders')})
SELECT r.request_id, arg_min(v.ordinal, struct_pack(c := CASE WHEN style = want_style THEN 0 WHEN want_style = 'italic' THEN 300 ELSE 200 END + abs(weight - want_weight), o := v.ordinal)) AS ordinal FROM r LEFT JOIN v ON r.family = v.family GROUP BY r.request_id""")
def best_variant(spark, sf):
    v = spark.sql(_VAR, part=view(spark, sf, "part"))
    return G.best_variant(spark.sql(_REQ, orders=view(spark, sf, "orders")), v)


@query("u2_missing_families", f"SELECT DISTINCT family FROM ({_REQ.replace('{orders}', 'orders')}) WHERE family NOT IN (SELECT family FROM ({_VAR.replace('{part}', 'part')}))")
def missing_families(spark, sf):
    return G.missing_families(spark.sql(_REQ, orders=view(spark, sf, "orders")), spark.sql(_VAR, part=view(spark, sf, "part")))


_FIELDS = """SELECT 'r' || r_regionkey AS field_id, CAST(NULL AS STRING) AS parent_id, r_name AS part, CASE WHEN r_regionkey > 1 THEN 'Tx' END AS kind, 2 AS flags FROM {region}
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'Sig' END, CASE WHEN n_nationkey % 4 = 0 THEN 1 + 4096 WHEN n_nationkey % 4 = 1 THEN 8192 + 32768 END FROM {nation}
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'f' || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Btn' END, CASE WHEN c_custkey % 7 = 0 THEN 3 WHEN c_custkey % 7 = 1 THEN 65536 + 131072 END FROM {customer}"""


def fields(spark, sf):
    return spark.sql(_FIELDS, **{t: view(spark, sf, t) for t in ("region", "nation", "customer")})


_F = _FIELDS.replace("{", "").replace("}", "")


_WIDGETS = "SELECT 'c' || o_custkey AS field_id, o_orderkey AS ord, CAST(o_orderkey % 7 AS INT) AS page FROM {orders}"


@query("j19_field_inventory", f"""
WITH RECURSIVE f AS ({_F}), w(field_id, name, kind, flags, depth) AS (SELECT field_id, part, kind, flags, 0 FROM f WHERE parent_id IS NULL
  UNION ALL SELECT f.field_id, w.name || '.' || f.part, coalesce(f.kind, w.kind), coalesce(f.flags, w.flags), w.depth + 1 FROM w JOIN f ON f.parent_id = w.field_id),
p AS (SELECT field_id, arg_min(page, ord) AS page FROM ({_WIDGETS.replace('{orders}', 'orders').replace('STRING', 'VARCHAR')}) GROUP BY field_id)
SELECT w.field_id, name, coalesce(kind, 'Tx') AS kind, flags & 1 <> 0 AS read_only, flags & 2 <> 0 AS required, flags & 4096 <> 0 AS multiline, flags & 8192 <> 0 AS password, flags & 32768 <> 0 AS radio, flags & 65536 <> 0 AS push_button, flags & 131072 <> 0 AS combo, depth, depth > 32 AS deep, FALSE AS cyclic,
  w.field_id NOT IN (SELECT parent_id FROM f WHERE parent_id IS NOT NULL) AS terminal, page FROM (SELECT * REPLACE (coalesce(flags, 0) AS flags) FROM w) w LEFT JOIN p ON w.field_id = p.field_id""")
def field_inventory(spark, sf):
    return G.field_inventory(fields(spark, sf), spark.sql(_WIDGETS, orders=view(spark, sf, "orders")))


@query("j20_inherited_property", f"""
WITH RECURSIVE f AS ({_F}), w(node_id, tip, value, distance) AS (SELECT field_id, parent_id, kind, 0 FROM f UNION ALL SELECT w.node_id, f.parent_id, f.kind, w.distance + 1 FROM w JOIN f ON f.field_id = w.tip WHERE w.value IS NULL)
SELECT node_id, value, CASE WHEN value IS NOT NULL THEN distance END AS distance, FALSE AS cyclic FROM w WHERE value IS NOT NULL OR tip IS NULL""")
def inherited_property(spark, sf):
    return G.inherited_property(fields(spark, sf).select(F.col("field_id").alias("node_id"), "parent_id", F.col("kind").alias("value")))


@query("w15_latest_revision_wins", "SELECT l_orderkey AS doc_id, l_returnflag AS key, arg_max(l_partkey, l_linenumber * 1000000000000 + l_suppkey * 1000000 + l_partkey) AS value FROM lineitem GROUP BY ALL")
def latest_revision_wins(spark, sf):
    x = view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("value"), (F.col("l_linenumber") * 1000000000000 + F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("revision"))
    return G.latest_revision_wins(x)


@query("t4_top_n_fields", "SELECT doc_id, ord FROM (SELECT user_id AS doc_id, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 200")
def top_n_fields(spark, sf):
    return G.top_n_fields(view(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"))).select("doc_id", "ord")


@query("t6_locale_sort", "SELECT DISTINCT p_name FROM part")
def locale_sort(spark, sf):
    return G.locale_sort(view(spark, sf, "part").select("p_name").distinct(), "p_name")


_FIND = "SELECT o_orderkey % 50 AS document, o_orderpriority AS profile, CASE WHEN o_orderstatus = 'F' THEN 'error' WHEN o_orderstatus = 'P' THEN 'warning' ELSE 'info' END AS severity, 'rule-' || (o_custkey % 12) AS rule, o_orderkey AS ord, 'm' || o_custkey AS message FROM {orders}"


def findings(spark, sf):
    return spark.sql(_FIND, orders=view(spark, sf, "orders"))


_FI = _FIND.replace("{orders}", "orders")


@query("a7_warning_summary", f"SELECT rule AS code, arg_min(message, ord) AS message, count(*) AS n, min(ord) AS first FROM ({_FI}) GROUP BY rule")
def warning_summary(spark, sf):
    return G.warning_summary(findings(spark, sf).withColumnRenamed("rule", "code"))


ROLLUP = f"SELECT document, profile, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS conforms FROM ({_FI}) GROUP BY ROLLUP (document, profile)"


@query("a8_conformance_rollup", ROLLUP)
def conformance_rollup(spark, sf):
    return G.conformance_rollup(findings(spark, sf))


@query("s8_write_conformance_report", ROLLUP)
def write_conformance_report(spark, sf):
    path = S.shared_path(spark, "conformance")
    S.write_conformance_report(G.conformance_rollup(findings(spark, sf)), path)
    return spark.read.parquet(path)


@query("a9_rules_checked", f"SELECT profile, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM ({_FI}) GROUP BY profile")
def rules_checked(spark, sf):
    return G.rules_checked(findings(spark, sf))


@query("a10_dominant_value", "SELECT grp, arg_max(value, struct_pack(n := n, f := -first)) AS value FROM (SELECT user_id AS grp, event_type AS value, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY grp")
def dominant_value(spark, sf):
    return G.dominant_value(view(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_type").alias("value"), F.col("event_id").alias("ord")))


@query("a21_character_inventory", """
SELECT lang, count(*) AS characters, sum(n)::BIGINT AS uses FROM (SELECT lang, ch, count(*) AS n FROM (SELECT lang, unnest(list_distinct(string_split(text, ''))) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL) GROUP BY lang""")
def character_inventory(spark, sf):
    return G.character_inventory(view(spark, sf, "documents"), "lang")


@query("f11_text_transform", """
SELECT doc_id, replace(upper(translate(text, 'iı', 'İI')), 'ẞ', 'SS') AS upper, lower(translate(text, 'Iİ', 'ıi')) AS lower,
  array_to_string(list_transform(regexp_extract_all(text, '\\s+|\\S+'), lambda w: replace(upper(translate(left(w, 1), 'iı', 'İI')), 'ẞ', 'SS') || substr(w, 2)), '') AS capital FROM documents""")
def text_transform(spark, sf):
    t = F.col("text")
    return view(spark, sf, "documents").select("doc_id", C.turkish_upper(t).alias("upper"), C.turkish_lower(t).alias("lower"), C.turkish_capitalize(t).alias("capital"))


#: instants from 1950 to 2110, written in turn as UTCTime, which has two digits of a year, as GeneralizedTime and with faults
_TIMES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 4 AS k, TIMESTAMP '1950-01-01' + INTERVAL 1 DAY * (l_partkey * 37 % 58000) + INTERVAL 1 SECOND * (l_suppkey * 7919 % 86400) AS t FROM lineitem"


@query("f4_asn1_time", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k < 2 THEN CASE WHEN k = 0 THEN CASE WHEN year(t) % 100 < 50 THEN '20' ELSE '19' END || strftime(t, '%y') ELSE strftime(t, '%Y') END || strftime(t, '-%m-%d %H:%M:%S') END AS time FROM ({_TIMES})""")
def asn1_time(spark, sf):
    days, seconds = F.col("l_partkey") * 37 % 58000, F.col("l_suppkey") * 7919 % 86400
    at = F.timestamp_seconds(F.lit(-631152000) + days * 86400 + seconds)
    k = F.col("l_partkey") % 4
    text = F.when(k == 0, F.date_format(at, "yyMMddHHmmss'Z'")).when(k == 1, F.date_format(at, "yyyyMMddHHmmss'Z'")).when(k == 2, F.date_format(at, "yyyyMMddHHmmss")).otherwise(F.concat(F.date_format(at, "yyyy"), F.lit("13451234Z")))
    found = C.asn1_time(text)
    return view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format(found, "yyyy-MM-dd HH:mm:ss").alias("time"))


@query("f5_f10_names", """
SELECT c_custkey, CASE WHEN regexp_matches(s, '^0+$') THEN '0' ELSE ltrim(s, '0') END AS serial, c_name AS cn, 'h' || c_custkey || '.test' AS host, lower(c_mktsegment) || ' sans' AS family FROM (SELECT *, lpad((c_custkey % 1000)::VARCHAR, 8, '0') AS s FROM customer)""")
def names(spark, sf):
    k = F.col("c_custkey").cast("string")
    return view(spark, sf, "customer").select(
        "c_custkey", C.normalise_serial(F.lpad((F.col("c_custkey") % 1000).cast("string"), 8, "0")).alias("serial"), C.extract_cn(F.concat(F.lit("C=R, CN="), "c_name", F.lit(",O=x"))).alias("cn"),
        C.uri_host(F.concat(F.lit("ldap://u:p@H"), k, F.lit(".test.:389/x"))).alias("host"), C.normalise_family(F.concat(F.lit("  "), "c_mktsegment", F.lit("   Sans "))).alias("family"))


_SPELLINGS = [
    ("sha1WithRSAEncryption", "sha1"), ("RSA-SHA512", "sha512"), ("id-SHA3-256", "sha3-256"), ("ecdsa-with-SHA384", "sha384"), ("SHA224", "sha224"), ("sha256WithRSAEncryption", "sha256"), ("md5WithRSAEncryption", "md5"),
    ("RIPEMD160", "ripemd160"), ("md2", "md2"), ("md4RSA", "md4"), ("sha3-512", "sha3-512"), ("whirlpool", None),
]


@query("f6_normalise_digest", f"WITH s(k, family) AS (VALUES {', '.join(f'({k}, {repr(f) if f else None or 'NULL'})' for k, (_, f) in enumerate(_SPELLINGS))}) SELECT o_orderkey, family FROM orders JOIN s ON o_orderkey % {len(_SPELLINGS)} = k")
def normalise_digest(spark, sf):
    spelling = F.get(F.array(*[F.lit(n) for n, _ in _SPELLINGS]), (F.col("o_orderkey") % len(_SPELLINGS)).cast("int"))
    return view(spark, sf, "orders").select("o_orderkey", C.normalise_digest(spelling).alias("family"))


@query("s4_s5_scan_assets", """
WITH p AS (SELECT page_id, page_id % 4 AS k, 100 + page_id AS w, page_id % 7 AS c, CASE WHEN page_id % 3 = 0 THEN 16 ELSE 8 END AS depth, page_id % 5 = 0 AS laced FROM pages),
d AS (SELECT *, w * 300000 AS pixels, CASE c WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 4 END AS samples FROM p),
b AS (SELECT *, ceil(pixels * ceil(depth * samples / 8.0) * CASE WHEN laced THEN 1.5 ELSE 1 END)::BIGINT AS bytes FROM d)
SELECT page_id, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'font/ttf' END AS mime, CASE WHEN k = 0 THEN w END AS width, CASE WHEN k = 0 THEN bytes END AS decoded,
  CASE WHEN k <> 0 THEN 'NOT_PNG' WHEN samples IS NULL THEN 'MALFORMED' WHEN pixels > 50000000 THEN 'TOO_MANY_PIXELS' WHEN bytes > 536870912 THEN 'DECODED_TOO_LARGE' END AS code FROM b""")
def scan_assets(spark, sf):
    """Each page's HTML behind the first bytes of a file type, as a file's content."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    i = F.col("page_id")
    size = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    header = F.concat(byte(F.when(i % 3 == 0, 16).otherwise(8)), byte(i % 7), byte(F.lit(0)), byte(F.lit(0)), byte(F.when(i % 5 == 0, 1).otherwise(0)))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), size(i + 100), size(F.lit(300000)), header)
    k = i % 4
    content = F.concat(F.when(k == 0, png).when(k == 1, F.unhex(F.lit("FFD8FFE0"))).when(k == 2, F.unhex(F.lit("0001000000"))).otherwise(F.unhex(F.lit("25504446"))), F.encode("html", "UTF-8"))
    x = view(spark, sf, "pages").select("page_id", S.sniff(content).alias("mime"), S.png_facts(content).alias("f"))
    png_only = lambda c: F.when(F.col("mime") == "image/png", F.col(f"f.{c}")).alias(c)
    return x.select("page_id", "mime", png_only("width"), png_only("decoded"), "f.code")
