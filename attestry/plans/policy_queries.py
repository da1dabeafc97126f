"""Queries over URLs, hosts, addresses, paths, limits and requests."""

from pyspark.sql import functions as F

from attestry.operators import policy as P
from attestry.plans.fixtures import view
from attestry.plans.registry import query

DENY, ALLOW = ["*.cheap-pills.example.com", "spam-farm.example.org"], ["*.example.com", "*.example.org", "*.example.net", "10.0.0.1", "8.8.8.8"]
_V4_OK = r"regexp_full_match({a}, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')"
_V4 = "(split_part({a}, '.', 1)::BIGINT * 16777216 + split_part({a}, '.', 2)::BIGINT * 65536 + split_part({a}, '.', 3)::BIGINT * 256 + split_part({a}, '.', 4)::BIGINT)"
_BLOCK = lambda n: "(" + " OR ".join(f"({n}) BETWEEN {lo} AND {hi}" for lo, hi in (P._range(*b) for b in P.BLOCKED_V4)) + ")"
V4_OK, V4 = (lambda a: _V4_OK.format(a=a)), (lambda a: _V4.format(a=a))


def _match(host: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"({host} = '{p[2:]}' OR ends_with({host}, '{p[1:]}'))" if p.startswith("*.") else f"{host} = '{p}'" for p in patterns) + ")"


#: URLs of a kind, with what the rules say of each: made anew for every page, which stands in {k}.
_KINDS = [
    ("ftp://h{k}.example.com/x", "SCHEME"), ("http://u:p@h.example.com/{k}", "CREDENTIALS"), ("http://169.254.169.254/{k}", "BLOCKED_ADDRESS"), ("http://10.0.0.1:8080/{k}", "BLOCKED_ADDRESS"),
    ("https://8.8.8.8/{k}", None), ("no url {k}", "BAD_URL"), ("http://2130706433/{k}", "BLOCKED_ADDRESS"), ("http://0x7f.1/{k}", "BLOCKED_ADDRESS"), ("http://127.1/{k}", "BLOCKED_ADDRESS"),
    ("http://0177.0.0.01:80/{k}", "BLOCKED_ADDRESS"), ("mailto:x{k}@example.com", "SCHEME"), ("http:\\\\10.0.0.1\\{k}", "BLOCKED_ADDRESS"), ("http://@www.example.com/{k}", None),
    ("http://256.1.1.1/{k}", "BAD_URL"), ("http://WWW.EXAMPLE.COM:99999/{k}", "BAD_URL"), ("http://[::ffff:127.0.0.1]/{k}", "BLOCKED_ADDRESS"), ("http://[::1]:8080/{k}", "BLOCKED_ADDRESS"),
    ("http://WWW.Example.com/{k}", None), ("http://cdn.cheap-pills.example.com/{k}", "HOST_DENIED"), ("http://8.8.4.4/{k}", "HOST_NOT_ALLOWED"),
]
_LISTED = ["127.0.0.1", "169.254.169.254", "::ffff:127.0.0.1", "::1"]
_LITERALS = ", ".join(f"({n}, '{u}', {repr(c) if c else 'NULL'})" for n, (u, c) in enumerate(_KINDS))


@query("p1_url_policy", f"""
WITH kinds(n, shape, code) AS (VALUES {_LITERALS}),
u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority FROM pages),
h AS (SELECT *, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')) AS host FROM u)
SELECT page_id, url, CASE WHEN scheme = '' OR (scheme IN ('http', 'https') AND host = '') THEN 'BAD_URL' WHEN scheme NOT IN ('http', 'https') THEN 'SCHEME' WHEN contains(authority, '@') THEN 'CREDENTIALS' WHEN {_match('host', DENY)} THEN 'HOST_DENIED'
  WHEN NOT {_match('host', ALLOW)} THEN 'HOST_NOT_ALLOWED' WHEN CASE WHEN {V4_OK('host')} THEN {_BLOCK(V4('host'))} ELSE FALSE END THEN 'BLOCKED_ADDRESS' END AS code FROM h
UNION ALL SELECT page_id, replace(shape, '{{k}}', page_id::VARCHAR), code FROM pages JOIN kinds ON page_id % {len(_KINDS)} = n""")
def url_policy(spark, sf):
    p = view(spark, sf, "pages")
    shape = F.get(F.array(*[F.lit(u) for u, _ in _KINDS]), (F.col("page_id") % len(_KINDS)).cast("int"))
    urls = p.select("page_id", "url").unionByName(p.select("page_id", F.replace(shape, F.lit("{k}"), F.col("page_id").cast("string")).alias("url")))
    return urls.select("page_id", "url", P.url_policy(F.col("url"), allow=[*ALLOW, *_LISTED], deny=DENY).alias("code"))


@query("p1_url_policy_by_lists", f"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority FROM pages),
h AS (SELECT *, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')) AS host FROM u),
p AS (SELECT DISTINCT lower(pattern) AS pattern, list FROM fx_patterns),
m AS (SELECT host, bool_or(list = 'allow') AS allowed, bool_or(list = 'deny') AS denied FROM (SELECT DISTINCT host FROM h) h JOIN p ON host = pattern OR (starts_with(pattern, '*.') AND (host = substr(pattern, 3) OR ends_with(host, substr(pattern, 2)))) GROUP BY host)
SELECT page_id, url, CASE WHEN scheme = '' OR (scheme IN ('http', 'https') AND h.host = '') THEN 'BAD_URL' WHEN scheme NOT IN ('http', 'https') THEN 'SCHEME' WHEN contains(authority, '@') THEN 'CREDENTIALS' WHEN denied THEN 'HOST_DENIED'
  WHEN NOT coalesce(allowed, FALSE) THEN 'HOST_NOT_ALLOWED' WHEN CASE WHEN {V4_OK('h.host')} THEN {_BLOCK(V4('h.host'))} ELSE FALSE END THEN 'BLOCKED_ADDRESS' END AS code FROM h LEFT JOIN m ON h.host = m.host""")
def url_policy_by_lists(spark, sf):
    return P.url_policy_by_lists(view(spark, sf, "pages").select("page_id", "url"), view(spark, sf, "fx_patterns"))


_HEX_BITS = lambda h: f"array_to_string(list_transform(string_split({h}, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), '')"


@query("p4_longest_prefix", f"""
WITH a AS (SELECT event_id, address, CASE WHEN {V4_OK('address')} THEN format('{{:08x}}', {V4('address')}) END AS h FROM fx_addresses
  UNION ALL SELECT event_id, address, array_to_string(list_transform(string_split(address, ':'), lambda g: lpad(g, 4, '0')), '') FROM (SELECT event_id, '2001:' || (event_id % 1000) || ':' || (event_id % 10) || ':' || (event_id % 7) || ':0:0:0:' || (event_id % 100) AS address FROM events)),
b AS (SELECT cidr, split_part(cidr, '/', 2)::INT AS n, CASE WHEN contains(cidr, ':') THEN rpad(array_to_string(list_transform(string_split(split_part(cidr, '::', 1), ':'), lambda g: lpad(g, 4, '0')), ''), 32, '0') ELSE format('{{:08x}}', {V4("split_part(cidr, '/', 1)")}) END AS h FROM fx_blocks),
x AS (SELECT address, {_HEX_BITS('h')} AS bits FROM (SELECT DISTINCT address, h FROM a WHERE h IS NOT NULL)), y AS (SELECT cidr, n, length(h) AS size, substr({_HEX_BITS('h')}, 1, n) AS prefix FROM b),
m AS (SELECT address, cidr FROM (SELECT address, cidr, row_number() OVER (PARTITION BY address ORDER BY n DESC, cidr) AS rn FROM x JOIN y ON length(bits) = 4 * size AND starts_with(bits, prefix)) WHERE rn = 1)
SELECT event_id, a.address, cidr FROM a LEFT JOIN m ON a.address = m.address""")
def longest_prefix(spark, sf):
    six = view(spark, sf, "events").select("event_id", F.concat(F.lit("2001:"), F.col("event_id") % 1000, F.lit(":"), F.col("event_id") % 10, F.lit(":"), F.col("event_id") % 7, F.lit(":0:0:0:"), F.col("event_id") % 100).alias("address"))
    return P.longest_prefix(view(spark, sf, "fx_addresses").select("event_id", "address").unionByName(six), view(spark, sf, "fx_blocks"))


@query("p2_host_matches", """
WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages), p(pattern) AS (VALUES ('*.example.com'), ('*.EXAMPLE.org'), ('example.net'), ('spam-farm.example.org'))
SELECT host, pattern, CASE WHEN starts_with(pattern, '*.') THEN host = lower(substr(pattern, 3)) OR ends_with(host, lower(substr(pattern, 2))) ELSE host = lower(pattern) END AS matches FROM h, p""")
def host_matches(spark, sf):
    hosts = view(spark, sf, "pages").select(F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host")).distinct()
    patterns = F.array(*map(F.lit, ["*.example.com", "*.EXAMPLE.org", "example.net", "spam-farm.example.org"]))
    return hosts.withColumn("pattern", F.explode(patterns)).select("host", "pattern", P.host_matches(F.col("host"), F.col("pattern")).alias("matches"))


@query("p3_ip_blocked", f"SELECT event_id, address, CASE WHEN {V4_OK('address')} THEN {_BLOCK(V4('address'))} ELSE TRUE END AS blocked FROM fx_addresses")
def ip_blocked(spark, sf):
    n = P.v4_number(F.col("address"))
    return view(spark, sf, "fx_addresses").select("event_id", "address", F.when(n.isNull(), True).otherwise(P.v4_blocked(n)).alias("blocked"))


@query("p4_ip6_blocked", f"""
WITH d AS (SELECT event_id, address, regexp_extract(address, '([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)$', 1) AS tail FROM fx_addresses6),
t AS (SELECT event_id, address, string_split(CASE WHEN tail = '' THEN address ELSE regexp_replace(address, '[0-9.]+$', '') || format('{{:x}}:{{:x}}', {V4('tail')} // 65536, {V4('tail')} % 65536) END, '::') AS halves FROM d),
s AS (SELECT *, list_filter(string_split(halves[1], ':'), lambda g: g <> '') AS l, list_filter(string_split(coalesce(halves[2], ''), ':'), lambda g: g <> '') AS r FROM t),
g AS (SELECT event_id, address, list_transform(l || list_transform(range(CASE WHEN len(halves) > 1 THEN 8 - len(l) - len(r) ELSE 0 END), lambda x: '0') || r, lambda x: ('0x' || x)::BIGINT) AS n FROM s)
SELECT event_id, address, CASE WHEN len(n) <> 8 THEN TRUE WHEN list_sum(n[1:5]) = 0 AND n[6] = 65535 THEN {_BLOCK('n[7] * 65536 + n[8]')} WHEN list_sum(n[1:7]) = 0 AND n[8] IN (0, 1) THEN TRUE
  WHEN n[1] & 65472 = 65152 OR n[1] & 65024 = 64512 OR n[1] & 65280 = 65280 THEN TRUE WHEN n[1] = 8194 THEN {_BLOCK('n[2] * 65536 + n[3]')} WHEN n[1] = 100 AND n[2] = 65435 THEN {_BLOCK('n[7] * 65536 + n[8]')} ELSE FALSE END AS blocked FROM g""")
def ip6_blocked(spark, sf):
    return view(spark, sf, "fx_addresses6").select("event_id", "address", (~P.address_safe(F.col("address"))).alias("blocked"))


@query("p5_host_safe_all_addresses", f"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM pages),
r AS (SELECT host, bool_and(CASE WHEN address LIKE '::ffff%' THEN FALSE WHEN contains(address, ':') THEN TRUE WHEN {V4_OK('address')} THEN NOT {_BLOCK(V4('address'))} ELSE FALSE END) AS safe FROM fx_resolution GROUP BY host)
SELECT h.host, CASE WHEN r.host IS NULL THEN 'DNS' WHEN NOT r.safe THEN 'BLOCKED_ADDRESS' END AS code FROM h LEFT JOIN r ON h.host = r.host""")
def host_safe(spark, sf):
    hosts = view(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#:]+)", 1).alias("host"))
    return P.host_safe_all_addresses(hosts, view(spark, sf, "fx_resolution"))


_PATHS = ["img/a.png", "../x.png", "a/../../b.png", "/etc/passwd", "C:\\x.png", "%2e%2e/%2e%2e/x", "%252e%252e%252fx", "http://h/x.png", "file:///etc", "data:image/png;base64,x", "", "a/./b/../c+d.png", "a%00.png", "\\\\srv\\x", "bad%zz/../x"]


@query("p6_asset_path_verdict", """
SELECT page_id, CAST(page_id % 15 AS BIGINT) AS k, CASE page_id % 15 WHEN 1 THEN 'OUTSIDE' WHEN 2 THEN 'OUTSIDE' WHEN 3 THEN 'ABSOLUTE' WHEN 4 THEN 'ABSOLUTE' WHEN 5 THEN 'OUTSIDE' WHEN 6 THEN 'OUTSIDE' WHEN 7 THEN 'REMOTE' WHEN 8 THEN 'SCHEME' WHEN 9 THEN 'IS_DATA' WHEN 10 THEN 'EMPTY' WHEN 12 THEN 'NUL' WHEN 13 THEN 'ABSOLUTE' END AS code FROM pages""")
def asset_path_verdict(spark, sf):
    src = F.get(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % 15).cast("int"))
    return view(spark, sf, "pages").select("page_id", (F.col("page_id") % 15).cast("long").alias("k"), P.asset_path_verdict(src).alias("code"))


@query("p7_limit_violations", """
SELECT doc_id AS id, 'bytes' AS kind, n_chars * 2000 AS actual, 'ERR_TOO_LARGE' AS code, 413 AS status FROM documents WHERE n_chars * 2000 > 67108864
UNION ALL SELECT doc_id, 'pages', n_chars, 'ERR_TOO_MANY', 400 FROM documents WHERE n_chars > 5000
UNION ALL SELECT user_id, 'operations', count(*), 'ERR_TOO_MANY', 400 FROM events GROUP BY user_id HAVING count(*) > 500""")
def limit_violations(spark, sf):
    d, e = view(spark, sf, "documents"), view(spark, sf, "events")
    facts = d.select(F.col("doc_id").alias("id"), F.inline(F.array(F.struct(F.lit("bytes").alias("kind"), (F.col("n_chars") * 2000).alias("actual")), F.struct(F.lit("pages").alias("kind"), F.col("n_chars").alias("actual")))))
    facts = facts.unionByName(e.groupBy(F.col("user_id").alias("id")).agg(F.lit("operations").alias("kind"), F.count("*").alias("actual")))
    return P.limit_violations(facts, spark.createDataFrame(P.LIMITS, "kind string, most long, code string, status int"))


_ROUTE = "CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN '/api/render' ELSE '/api/signature' END WHEN 'view' THEN '/static/x.css' WHEN 'purchase' THEN '/api/sign' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '/api/pfx/' || event_id ELSE '/api/ltv-' || event_id END ELSE '/api/health' END"
_CLASS = "CASE WHEN regexp_matches(path, '/api/(sign|pfx|ltv)([^A-Za-z0-9_]|$)') THEN 'sensitive' WHEN regexp_matches(path, '/api/health([^A-Za-z0-9_]|$)') THEN 'public' ELSE 'compute' END"
#: Servers: without tokens and bound to the machine, to all addresses, to an unknown one; with tokens for all routes, and for sensitive ones.
_SERVERS = [(0, "localhost", "all"), (1, "0.0.0.0", "all"), (2, None, "all"), (3, "0.0.0.0", "all"), (4, "10.0.0.9", "sensitive")]


def _requests(spark, sf):
    e = view(spark, sf, "events").withColumn("path", F.expr(_ROUTE))
    return e.withColumn("route_class", P.classify_route(F.col("path")))


@query("p8_classify_route", f"SELECT path, route_class, count(*) AS n FROM (SELECT regexp_replace(path, '[0-9]+', '') AS path, {_CLASS} AS route_class FROM (SELECT {_ROUTE} AS path FROM events)) GROUP BY ALL")
def classify_route(spark, sf):
    return _requests(spark, sf).groupBy(F.regexp_replace("path", "[0-9]+", "").alias("path"), "route_class").agg(F.count("*").alias("n"))


@query("p9_access_decision", f"""
WITH r AS (SELECT event_id, event_id % 5 AS server_id, {_CLASS} AS route_class, CASE WHEN event_id % 7 < 4 THEN 'token-' || (event_id % 4) END AS token FROM (SELECT event_id, {_ROUTE} AS path FROM events))
SELECT event_id, CASE WHEN route_class = 'public' THEN 'allowed' WHEN server_id < 3 THEN CASE WHEN server_id = 1 AND route_class = 'sensitive' THEN '503' ELSE 'allowed' END
  WHEN server_id = 4 AND route_class <> 'sensitive' THEN 'allowed' WHEN coalesce(token IN ('token-0', 'token-1') AND (server_id = 3 OR token = 'token-1'), FALSE) THEN 'allowed' ELSE '401' END AS decision FROM r""")
def access_decision(spark, sf):
    bearer = F.when(F.col("event_id") % 7 < 2, F.concat(F.lit("bearer  token-"), F.col("event_id") % 4))
    header = F.when(F.col("event_id") % 7 < 4, F.concat(F.lit(" token-"), F.col("event_id") % 4))
    r = _requests(spark, sf).withColumns({"server_id": (F.col("event_id") % 5).cast("int"), "token": P.presented_token(bearer, header)})
    tokens = spark.createDataFrame([(3, "token-0"), (3, "token-1"), (4, "token-1")], "server_id int, token string").select("server_id", F.sha2("token", 256).alias("token_hash"))
    return P.access_decision(r, spark.createDataFrame(_SERVERS, "server_id int, bound_host string, scope string"), tokens).select("event_id", "decision")


@query("p11_byte_range_check", """
SELECT sig_id, CASE WHEN b0 < 0 OR b1 < 0 OR b2 < 0 OR b3 < 0 THEN 'NOT_NUMBERS' ELSE concat_ws(',', CASE WHEN b0 <> 0 THEN 'NOT_FROM_START' END, CASE WHEN b2 < b0 + b1 THEN 'OVERLAP' END, CASE WHEN b2 + b3 > doc_length THEN 'PAST_END' END, CASE WHEN b0 + b1 <> contents_start OR b2 <> contents_end THEN 'GAP_MISMATCH' END) END AS faults FROM fx_signatures""")
def byte_range_check(spark, sf):
    c = F.col
    return view(spark, sf, "fx_signatures").select("sig_id", F.array_join(P.byte_range_check(c("b0"), c("b1"), c("b2"), c("b3"), c("doc_length"), c("contents_start"), c("contents_end")), ",").alias("faults"))


_SEGMENTS = """SELECT sig_id, 0 AS k, b0 AS start, b1 AS size, doc_length AS length, contents_start, contents_end FROM fx_signatures UNION ALL SELECT sig_id, 1, b2, b3, doc_length, contents_start, contents_end FROM fx_signatures"""


@query("p12_byte_range_issues", f"""
WITH s AS (SELECT *, lag(start + size) OVER (PARTITION BY sig_id ORDER BY k) AS before FROM ({_SEGMENTS}))
SELECT DISTINCT sig_id, issue FROM (SELECT sig_id, unnest([CASE WHEN start < 0 OR size < 0 THEN 'NEGATIVE' END, CASE WHEN start + size > length THEN 'PAST_END' END, CASE WHEN start < before THEN 'OVERLAP' END, CASE WHEN before IS NOT NULL AND (before > contents_start OR start < contents_end) THEN 'GAP' END]) AS issue FROM s) WHERE issue IS NOT NULL
UNION ALL SELECT sig_id, 'ODD_COUNT' FROM fx_signatures WHERE sig_id % 89 = 6 AND b0 IS NOT NULL""")
def byte_range_issues(spark, sf):
    """Some ranges have a fifth number."""
    numbers = F.array(*[F.col(b).cast("long") for b in ("b0", "b1", "b2", "b3")])
    extra = F.when(F.col("sig_id") % 89 == 6, F.concat(numbers, F.array(F.lit(7).cast("long")))).otherwise(numbers)
    return P.byte_range_issues(view(spark, sf, "fx_signatures").select("sig_id", extra.alias("numbers"), F.col("doc_length").alias("length"), "contents_start", "contents_end"))


@query("p17_paper_size", """
WITH s(name, w, h, k) AS (VALUES ('A3', 841.89, 1190.55, 0), ('A4', 595.28, 841.89, 1), ('A5', 419.53, 595.28, 2), ('A6', 297.64, 419.53, 3), ('Letter', 612.0, 792.0, 4), ('Legal', 612.0, 1008.0, 5), ('Tabloid', 792.0, 1224.0, 6)),
p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN b ELSE a END AS width, CASE WHEN p_size % 2 = 0 THEN a ELSE b END AS height FROM (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN 595.0 WHEN 1 THEN 612.0 WHEN 2 THEN 420.5 WHEN 3 THEN 298.0 ELSE 842.0 END::DOUBLE AS a, CASE p_size % 5 WHEN 0 THEN 842.0 WHEN 1 THEN 792.0 + p_size WHEN 2 THEN 595.0 WHEN 3 THEN 420.0 - p_size % 3 * 3 ELSE 1190.0 END::DOUBLE AS b FROM part))
SELECT p_partkey, coalesce((SELECT arg_min(name, k) FROM s WHERE abs(least(width, height) - w) <= 3 AND abs(greatest(width, height) - h) <= 3), floor(width / 72 * 25.4 + 0.5)::BIGINT || 'x' || floor(height / 72 * 25.4 + 0.5)::BIGINT || ' mm') AS label FROM p""")
def paper_size(spark, sf):
    a = F.expr("CAST(CASE p_size % 5 WHEN 0 THEN 595.0 WHEN 1 THEN 612.0 WHEN 2 THEN 420.5 WHEN 3 THEN 298.0 ELSE 842.0 END AS DOUBLE)")
    b = F.expr("CAST(CASE p_size % 5 WHEN 0 THEN 842.0 WHEN 1 THEN 792.0 + p_size WHEN 2 THEN 595.0 WHEN 3 THEN 420.0 - p_size % 3 * 3 ELSE 1190.0 END AS DOUBLE)")
    even = F.col("p_size") % 2 == 0
    return view(spark, sf, "part").select("p_partkey", P.paper_size(F.when(even, b).otherwise(a), F.when(even, a).otherwise(b)).alias("label"))


_SPEC = [("price", "number", 901.0, 1500.0, None, None), ("size", "number", 1.0, 45.0, None, None), ("type", "enum", None, None, "ECONOMY,STANDARD,PROMO", None), ("name", "text", None, None, None, 10)]


@query("p20_validate_records", """
SELECT record_id, field, issue FROM (
  SELECT p_partkey AS record_id, 'price' AS field, CASE WHEN p_retailprice < 901 THEN 'MIN' WHEN p_retailprice > 1500 THEN 'MAX' END AS issue FROM part
  UNION ALL SELECT p_partkey, 'size', CASE WHEN p_size % 7 = 0 THEN 'TYPE' WHEN p_size > 45 THEN 'MAX' END FROM part
  UNION ALL SELECT p_partkey, 'type', CASE WHEN p_partkey % 11 = 0 THEN 'MISSING' WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'ENUM' END FROM part
  UNION ALL SELECT p_partkey, 'name', CASE WHEN length(p_name) > 10 THEN 'TOO_LONG' END FROM part
  UNION ALL SELECT p_partkey, 'colour', 'UNKNOWN_FIELD' FROM part WHERE p_partkey % 13 = 0) WHERE issue IS NOT NULL""")
def validate_records(spark, sf):
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"))
    c = F.col
    pairs = F.array(
        pair("price", c("p_retailprice")), pair("size", F.when(c("p_size") % 7 == 0, "large").otherwise(c("p_size").cast("string"))), pair("type", F.when(c("p_partkey") % 11 != 0, c("p_type"))),
        pair("name", c("p_name")), F.when(c("p_partkey") % 13 == 0, pair("colour", F.lit("red"))))
    fields = view(spark, sf, "part").select(c("p_partkey").alias("record_id"), F.inline(F.filter(pairs, lambda x: x.isNotNull())))
    return P.validate_records(fields, spark.createDataFrame(_SPEC, "field string, kind string, least double, most double, choices string, longest int"))
