"""Queries over certificates, chains, revocation and verdicts."""

from pyspark.sql import functions as F

from attestry.functions.scalars import normalise_digest
from attestry.operators import trust as T
from attestry.plans.fixtures import view
from attestry.plans.registry import query
from attestry.sources import cut, small

AT = "1997-06-01"
def _at():
    return F.lit(AT).cast("timestamp")
_FAMILY = """CASE {x} WHEN lower({d}) LIKE '%sha512%' THEN 'sha512' WHEN lower({d}) LIKE '%sha384%' THEN 'sha384' WHEN lower({d}) LIKE '%sha256%' THEN 'sha256' WHEN lower({d}) LIKE '%sha224%' THEN 'sha224'
 WHEN lower({d}) LIKE '%sha1%' THEN 'sha1' WHEN lower({d}) LIKE '%md5%' THEN 'md5' END""".replace("{x} ", "")
FAMILY = lambda d: _FAMILY.replace("{d}", d)
_SERIAL = "regexp_replace(lower({c}), '^0+(.)', '\\1')"
LISTED = lambda values: ", ".join(f"'{v}'" for v in values)
SERIAL = lambda c: _SERIAL.replace("{c}", c)

CANDIDATES = f"""
SELECT c.cert_id, i.cert_id AS issuer_id FROM fx_certs c JOIN fx_certs i ON c.issuer = i.subject
WHERE (c.aki IS NULL OR i.ski IS NULL OR c.aki = i.ski) AND (c.aki_serial IS NULL OR {SERIAL('c.aki_serial')} = {SERIAL('i.serial')})"""


@query("j1_issuer_candidates", CANDIDATES)
def issuer_candidates(spark, sf):
    certs = view(spark, sf, "fx_certs")
    return T.issuer_candidates(certs, certs)


def _walk(leaves: str = "C") -> str:
    return f"""
WITH RECURSIVE ups AS (SELECT c.*, c.cert_id IN (SELECT cert_id FROM fx_anchors) AS anchor FROM fx_certs c),
best AS (
  SELECT c.cert_id, u.cert_id AS up, row_number() OVER (PARTITION BY c.cert_id ORDER BY u.anchor DESC, u.cert_id) AS rn
  FROM fx_certs c JOIN ups u ON c.issuer = u.subject AND (c.aki IS NULL OR u.ski IS NULL OR c.aki = u.ski) AND (c.aki_serial IS NULL OR {SERIAL('c.aki_serial')} = {SERIAL('u.serial')}) AND c.cert_id <> u.cert_id
  WHERE c.subject <> c.issuer),
walk(cert_id, tip, path) AS (
  SELECT cert_id, cert_id, cert_id FROM fx_certs WHERE substr(cert_id, 1, 1) IN ({LISTED(leaves)})
  UNION ALL SELECT w.cert_id, b.up, w.path || '>' || b.up FROM walk w JOIN best b ON b.cert_id = w.tip AND b.rn = 1),
ends AS (SELECT cert_id, arg_max(path, length(path)) AS path, arg_max(tip, length(path)) AS tip FROM walk GROUP BY cert_id)"""


@query("j2_build_chains", f"{_walk()} SELECT e.cert_id, e.path, c.subject = c.issuer AS complete FROM ends e JOIN fx_certs c ON e.tip = c.cert_id")
def build_chains(spark, sf):
    certs = view(spark, sf, "fx_certs")
    return T.build_chains(certs.filter("cert_id LIKE 'C%'"), certs, view(spark, sf, "fx_anchors")).select("cert_id", F.array_join("path", ">").alias("path"), "complete")


@query("j3_trusted_anchor", """
SELECT cert_id FROM fx_certs c WHERE cert_id IN (SELECT cert_id FROM fx_anchors) OR EXISTS (SELECT 1 FROM fx_anchors a WHERE a.spki = c.ski AND a.subject = c.subject)""")
def trusted_anchor(spark, sf):
    return T.trusted_anchor(view(spark, sf, "fx_certs"), view(spark, sf, "fx_anchors")).select("cert_id")


def CRL(delta: str) -> str:
    return f"""
SELECT cert_id, crl_id, CASE WHEN code IS NOT NULL THEN NULL WHEN hit THEN 'revoked' ELSE 'good' END AS status, CASE WHEN code IS NULL AND hit THEN e_reason END AS reason,
  CASE WHEN code IS NULL AND hit THEN revocation_date END AS revocation_date, CASE WHEN code IS NULL AND hit THEN invalidity_date END AS invalidity_date, partial, code, e_reason IS NOT NULL AS listed, crl_number, base_number, issuer, embedded
FROM (SELECT c.cert_id, l.crl_id, l.embedded, c.issuer, l.crl_number, l.base_number, e.reason AS e_reason, e.revocation_date, e.invalidity_date,
    coalesce(e.reason IS NOT NULL AND e.reason <> 8 AND NOT (l.indirect AND e.entry_issuer IS NOT NULL AND e.entry_issuer <> c.issuer), FALSE) AS hit,
    NOT (l.only_attribute OR (l.only_user AND c.is_ca) OR (l.only_ca AND NOT c.is_ca)) AND l.some_reasons <> '' AS partial,
    CASE WHEN len(list_filter(string_split(l.critical, ','), lambda x: x NOT IN ('', {LISTED(T.KNOWN_CRL_EXTENSIONS)}))) > 0 THEN 'UNKNOWN_CRITICAL' WHEN NOT l.sig_ok THEN 'BAD_SIGNATURE' WHEN l.this_update - INTERVAL 365 DAY > TIMESTAMP '{AT}' THEN 'NOT_YET_VALID'
      WHEN l.next_update + INTERVAL 365 DAY < TIMESTAMP '{AT}' THEN 'EXPIRED' WHEN l.only_attribute OR (l.only_user AND c.is_ca) OR (l.only_ca AND NOT c.is_ca) THEN 'OUT_OF_SCOPE' END AS code
  FROM fx_certs c JOIN fx_crls l ON c.issuer = l.issuer AND l.is_delta = {delta} LEFT JOIN fx_crl_entries e ON e.crl_id = l.crl_id AND {SERIAL('e.serial')} = {SERIAL('c.serial')})"""


def crl_rows(spark, sf, delta=False):
    return T.crl_status(view(spark, sf, "fx_certs"), view(spark, sf, "fx_crls"), view(spark, sf, "fx_crl_entries"), _at(), delta=delta)


_CRL_COLUMNS = "cert_id, crl_id, status, reason, strftime(revocation_date, '%Y-%m-%d') AS revoked_on, strftime(invalidity_date, '%Y-%m-%d') AS invalid_on, partial, code"


@query("j4_crl_status", f"SELECT {_CRL_COLUMNS} FROM ({CRL('FALSE')})")
def crl_status(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return crl_rows(spark, sf).select("cert_id", "crl_id", "status", "reason", day("revocation_date").alias("revoked_on"), day("invalidity_date").alias("invalid_on"), "partial", "code")


@query("j5_crl_with_delta", f"""
WITH b AS ({CRL('FALSE')}), d AS ({CRL('TRUE')}),
x AS (SELECT b.cert_id, b.status, d.status AS d_status, d.listed AS d_listed,
  CASE WHEN b.code IS NOT NULL THEN b.code WHEN d.issuer IS NULL THEN NULL WHEN b.crl_number IS NULL OR d.base_number IS NULL THEN 'NUMBER_MISSING'
    WHEN lpad({SERIAL('d.base_number')}, 40, '0') > lpad({SERIAL('b.crl_number')}, 40, '0') THEN 'DELTA_MISMATCH' ELSE d.code END AS code
  FROM b LEFT JOIN d ON b.cert_id = d.cert_id AND b.issuer = d.issuer)
SELECT cert_id, CASE WHEN code IS NULL THEN CASE WHEN coalesce(d_listed, FALSE) THEN d_status ELSE status END END AS status, CASE WHEN code IS NULL THEN CASE WHEN coalesce(d_listed, FALSE) THEN 'delta' ELSE 'base' END END AS source, code FROM x""")
def crl_with_delta(spark, sf):
    return T.crl_with_delta(crl_rows(spark, sf), crl_rows(spark, sf, delta=True))


OCSP = f"""
SELECT cert_id, response_id, CASE WHEN code IS NULL THEN status END AS status, code, embedded FROM (
  SELECT c.cert_id, r.response_id, r.status, r.code, r.embedded, row_number() OVER (PARTITION BY c.cert_id ORDER BY r.code IS NOT NULL, CASE WHEN r.code IS NULL THEN r.response_id ELSE -r.response_id END) AS rn
  FROM fx_certs c JOIN fx_digests n ON n.message = c.issuer JOIN fx_digests k ON k.message = 'key-' || substr(c.issuer, 4) AND k.algorithm = n.algorithm
  JOIN (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN this_update - INTERVAL 5 MINUTE > TIMESTAMP '{AT}' THEN 'NOT_YET_VALID' WHEN next_update + INTERVAL 5 MINUTE < TIMESTAMP '{AT}' THEN 'EXPIRED' END AS code FROM fx_ocsp) r
  ON {SERIAL('c.serial')} = {SERIAL('r.serial')} AND r.algorithm = n.algorithm AND r.issuer_name_hash = n.digest AND r.issuer_key_hash = k.digest AND n.algorithm IN ('sha1', 'sha256', 'sha384', 'sha512')) WHERE rn = 1"""


def ocsp_rows(spark, sf):
    certs = view(spark, sf, "fx_certs")
    issuers = certs.filter("is_ca OR subject LIKE 'CN=ca-%'").select("subject").distinct().withColumn("key", F.concat(F.lit("key-"), F.substring("subject", 4, 99)))
    return T.ocsp_match(certs, issuers, view(spark, sf, "fx_ocsp"), _at())


@query("j6_ocsp_match", f"SELECT cert_id, response_id, status, code FROM ({OCSP})")
def ocsp_match(spark, sf):
    return ocsp_rows(spark, sf).drop("embedded")


def _evidence(more: str) -> str:
    return f"""
SELECT c.cert_id, coalesce(b.status, 'unknown') AS status, coalesce(b.source, 'none') AS source, b.code, coalesce(b.embedded, FALSE) AS embedded{more} FROM fx_certs c LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY cert_id ORDER BY rank, tie) AS rn FROM (
    SELECT cert_id, CASE WHEN partial AND status = 'good' THEN 'unknown' ELSE status END AS status, 'crl' AS source, code, CASE WHEN status = 'revoked' THEN 1 WHEN code IS NOT NULL THEN 6 WHEN partial THEN 5 ELSE 2 END AS rank, -crl_id AS tie, reason, revocation_date, invalidity_date, embedded FROM ({CRL('FALSE')})
    UNION ALL SELECT cert_id, coalesce(status, 'unknown'), 'ocsp', code, 3, 0, NULL, NULL, NULL, embedded FROM ({OCSP}))) b ON c.cert_id = b.cert_id AND b.rn = 1
WHERE c.subject <> c.issuer"""


EVIDENCE = _evidence("")


def evidence_rows(spark, sf):
    return T.revocation_evidence(view(spark, sf, "fx_certs"), crl_rows(spark, sf), ocsp_rows(spark, sf))


@query("j7_revocation_evidence", EVIDENCE)
def revocation_evidence(spark, sf):
    return evidence_rows(spark, sf).select("cert_id", "status", "source", "code", "embedded")


_REASON = "CASE reason WHEN 0 THEN 'unspecified' WHEN 1 THEN 'keyCompromise' WHEN 2 THEN 'cACompromise' WHEN 3 THEN 'affiliationChanged' WHEN 4 THEN 'superseded' WHEN 5 THEN 'cessationOfOperation' WHEN 6 THEN 'certificateHold' WHEN 8 THEN 'removeFromCRL' WHEN 9 THEN 'privilegeWithdrawn' WHEN 10 THEN 'aACompromise' END"


@query("j8_poe_vs_revocation", f"""
SELECT s.sig_id, r.serial, r.reason_name, coalesce(proof < coalesce(r.invalidity_date, r.revocation_date), FALSE) AND NOT coalesce(lower(r.reason_name) LIKE '%compromise%', FALSE) AS protected
FROM fx_signatures s JOIN fx_certs c ON s.cert_id = c.cert_id JOIN (SELECT *, {_REASON} AS reason_name FROM fx_crl_entries WHERE crl_id % 2 = 0) r ON c.serial = '0' || r.serial
LEFT JOIN (SELECT sig_id, min(gen_time) AS proof FROM fx_timestamps GROUP BY sig_id) t ON s.sig_id = t.sig_id""")
def poe_vs_revocation(spark, sf):
    proof = view(spark, sf, "fx_timestamps").groupBy("sig_id").agg(F.min("gen_time").alias("proof"))
    entries = view(spark, sf, "fx_crl_entries").filter("crl_id % 2 = 0").withColumns({"reason_name": T.reason_name(F.col("reason")), "full": F.concat(F.lit("0"), "serial")})
    met = view(spark, sf, "fx_signatures").join(view(spark, sf, "fx_certs").select("cert_id", F.col("serial").alias("full")), "cert_id").join(entries, "full").join(proof, "sig_id", "left")
    return met.select("sig_id", "serial", "reason_name", T.protected(F.col("proof"), F.col("revocation_date"), F.col("invalidity_date"), F.col("reason_name")).alias("protected"))


_WITHIN = """CASE n.kind WHEN 'dns' THEN b = '' OR nm = b OR ends_with(nm, CASE WHEN starts_with(b, '.') THEN b ELSE '.' || b END)
  WHEN 'email' THEN b = '' OR CASE WHEN contains(b, '@') THEN nm = b WHEN starts_with(b, '.') THEN ends_with(nm, b) ELSE contains(nm, '@') AND regexp_extract(nm, '@([^@]*)$', 1) = b END
  WHEN 'uri' THEN coalesce(host <> '', FALSE) AND (b = '' OR host = b OR ends_with(host, CASE WHEN starts_with(b, '.') THEN b ELSE '.' || b END))
  WHEN 'ip' THEN length(n.base) IN (16, 64) AND length(n.base) = 2 * length(n.name) AND list_bool_and(list_transform(range(0, length(n.name) // 2), lambda k: coalesce(TRY_CAST('0x' || substr(n.name, 2 * k + 1, 2) AS INT), 0) & coalesce(TRY_CAST('0x' || substr(n.base, length(n.name) + 2 * k + 1, 2) AS INT), 0) = coalesce(TRY_CAST('0x' || substr(n.base, 2 * k + 1, 2) AS INT), 0) & coalesce(TRY_CAST('0x' || substr(n.base, length(n.name) + 2 * k + 1, 2) AS INT), 0)))
  WHEN 'dn' THEN list_slice(string_split(n.name, '/'), 1, len(string_split(n.base, '/'))) = string_split(n.base, '/') ELSE FALSE END"""


def _names_sql(select: str, names: str = "fx_names", constraints: str = "fx_constraints") -> str:
    return f"""
WITH p AS (SELECT n.chain_id, n.kind, n.name, c.base, c.type, CASE WHEN n.kind = 'email' THEN lower(n.name) ELSE regexp_replace(lower(n.name), '\\.$', '') END AS nm, CASE WHEN n.kind = 'email' THEN lower(c.base) ELSE regexp_replace(lower(c.base), '\\.$', '') END AS b,
    regexp_replace(lower(regexp_extract(n.name, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '\\.$', '') AS host
  FROM {names} n JOIN {constraints} c ON n.chain_id = c.chain_id AND n.kind = c.kind AND c.depth > n.depth),
w AS (SELECT *, {_WITHIN} AS within FROM p n)
{select}"""


@query("p16_name_within_subtree", _names_sql("SELECT chain_id, kind, name, base, within FROM w"))
def name_within_subtree(spark, sf):
    n, c = view(spark, sf, "fx_names"), view(spark, sf, "fx_constraints").withColumnRenamed("depth", "c_depth")
    return n.join(c, ["chain_id", "kind"]).filter("c_depth > depth").select("chain_id", "kind", "name", "base", T.within_subtree(F.col("kind"), F.col("name"), F.col("base")).alias("within"))


_NAME_RULES = """
SELECT chain_id, name, 'excluded' AS rule FROM w WHERE type = 'excluded' AND within GROUP BY ALL
UNION ALL SELECT chain_id, name, 'not_permitted' FROM w WHERE type = 'permitted' GROUP BY chain_id, name HAVING NOT bool_or(within)"""


@query("j9_name_constraint_violations", _names_sql(_NAME_RULES))
def name_constraint_violations(spark, sf):
    return T.name_constraint_violations(view(spark, sf, "fx_names"), view(spark, sf, "fx_constraints"))


STEPS = "SELECT s.chain_id, s.depth, s.last, c.* FROM fx_steps s JOIN fx_certs c ON s.cert_id = c.cert_id"


def steps(spark, sf):
    return view(spark, sf, "fx_steps").join(view(spark, sf, "fx_certs"), "cert_id")


ALGORITHMS = f"""
SELECT chain_id AS sig_id, count(*) FILTER (WHERE (key_type IN ('rsa', 'dsa') AND key_bits < 2048) OR (key_type = 'ec' AND key_bits < 256)) + count(*) FILTER (WHERE {FAMILY('digest')} IN ('md2', 'md4', 'md5', 'sha1', 'ripemd160') AND depth < last) AS errors,
  count(*) FILTER (WHERE key_type IN ('rsa', 'dsa') AND key_bits >= 2048 AND key_bits < 3072) AS warnings FROM ({STEPS}) GROUP BY chain_id"""


@query("p10_algorithm_policy", ALGORITHMS)
def algorithm_policy(spark, sf):
    return T.algorithm_policy(steps(spark, sf).withColumnRenamed("chain_id", "sig_id"))


PATH = f"""
SELECT chain_id, depth, 'not_a_ca' AS rule FROM ({STEPS}) WHERE depth > 0 AND is_ca IS NOT TRUE
UNION ALL SELECT chain_id, depth, 'no_cert_sign' FROM ({STEPS}) WHERE depth > 0 AND is_ca AND NOT key_cert_sign
UNION ALL SELECT chain_id, depth, 'leaf_key_usage' FROM ({STEPS}) WHERE depth = 0 AND NOT digital_signature AND NOT content_commitment
UNION ALL SELECT a.chain_id, max(a.depth), 'path_length' FROM ({STEPS}) a WHERE a.depth > 0 AND a.is_ca AND a.path_len < (SELECT count(*) FROM ({STEPS}) b WHERE b.chain_id = a.chain_id AND b.depth <= a.depth - 2 AND b.subject <> b.issuer) GROUP BY a.chain_id"""


def path_rows(spark, sf):
    return T.path_rules(steps(spark, sf).withColumn("self_issued", F.col("subject") == F.col("issuer")))


@query("w7_path_rules", PATH)
def path_rules(spark, sf):
    return path_rows(spark, sf)


@query("w7_required_eku", "SELECT cert_id, eku = '' OR len(list_filter(string_split(eku, ','), lambda e: e IN ('1.3.6.1.5.5.7.3.36', '2.5.29.37.0'))) > 0 AS eku_ok FROM fx_certs")
def required_eku(spark, sf):
    return T.required_eku(view(spark, sf, "fx_certs"), ("1.3.6.1.5.5.7.3.36",)).select("cert_id", "eku_ok")


_KNOWN_CERT, _KNOWN_CRL = LISTED(("", *T.KNOWN_EXTENSIONS)), LISTED(("", *T.KNOWN_CRL_EXTENSIONS))
_ODD = "SELECT {id} AS id, array_to_string(list_filter(string_split(critical, ','), lambda x: x NOT IN ({known})), ',') AS unknown FROM {table}"


@query("p13_unknown_critical", f"""
SELECT id, coalesce(unknown, '') AS unknown, coalesce(unknown, '') = '' AS usable FROM ({_ODD.format(id='cert_id', known=_KNOWN_CERT, table='fx_certs')}
UNION ALL {_ODD.format(id="'L' || crl_id", known=_KNOWN_CRL, table='fx_crls')})""")
def unknown_critical(spark, sf):
    certs, crls = T.unknown_critical(view(spark, sf, "fx_certs")), T.unknown_critical(view(spark, sf, "fx_crls"), known=T.KNOWN_CRL_EXTENSIONS)
    return certs.select(F.col("cert_id").alias("id"), "unknown", "usable").unionByName(crls.select(F.concat(F.lit("L"), "crl_id").alias("id"), "unknown", "usable"))


@query("p14_crl_in_scope", """
SELECT cert_id, crl_id, reason IS NULL AS covers, reason, reason IS NULL AND some_reasons <> '' AS partial FROM (
  SELECT *, CASE WHEN only_attribute THEN 'attribute' WHEN only_user AND is_ca THEN 'user_only' WHEN only_ca AND NOT is_ca THEN 'ca_only' WHEN uris <> '' AND points <> '' AND uris <> points THEN 'distribution_point' END AS reason
  FROM (SELECT c.cert_id, c.is_ca, CASE WHEN c.key_type = 'ec' THEN 'http://crl/3' ELSE '' END AS points, l.* FROM fx_certs c JOIN fx_crls l ON c.issuer = l.issuer))""")
def crl_in_scope(spark, sf):
    certs = view(spark, sf, "fx_certs").select("cert_id", "is_ca", "issuer", F.when(F.col("key_type") == "ec", "http://crl/3").otherwise("").alias("points"))
    return T.crl_in_scope(certs.join(view(spark, sf, "fx_crls"), "issuer")).select("cert_id", "crl_id", "covers", "reason", "partial")


@query("p15_freshness_window", f"""
SELECT 'crl' AS kind, crl_id AS id, CASE WHEN this_update - INTERVAL 365 DAY > TIMESTAMP '{AT}' THEN 'not_yet' WHEN next_update IS NULL THEN 'no_next_update' WHEN next_update + INTERVAL 365 DAY < TIMESTAMP '{AT}' THEN 'expired' ELSE 'ok' END AS fresh FROM fx_crls
UNION ALL SELECT 'ocsp', response_id, CASE WHEN this_update - INTERVAL 5 MINUTE > TIMESTAMP '{AT}' THEN 'not_yet' WHEN next_update IS NULL THEN CASE WHEN this_update + INTERVAL 100 DAY < TIMESTAMP '{AT}' THEN 'too_old' ELSE 'ok' END WHEN next_update + INTERVAL 5 MINUTE < TIMESTAMP '{AT}' THEN 'expired' ELSE 'ok' END FROM fx_ocsp""")
def freshness_window(spark, sf):
    crls = T.freshness_window(view(spark, sf, "fx_crls"), _at(), "365 days").select(F.lit("crl").alias("kind"), F.col("crl_id").cast("long").alias("id"), "fresh")
    return crls.union(T.freshness_window(view(spark, sf, "fx_ocsp"), _at(), max_age="100 days").select(F.lit("ocsp"), F.col("response_id").cast("long"), "fresh"))


_CH = lambda leaves: f"SELECT e.cert_id AS chain_id, string_split(e.path, '>') AS p, c.subject = c.issuer AS complete FROM (SELECT * FROM ({_walk(leaves)} SELECT * FROM ends)) e JOIN fx_certs c ON e.tip = c.cert_id"


def _chains_sql(leaves: str) -> str:
    """Common tables: st, the steps of built chains; bad, what forbids them; k, the facts of each."""
    on_st = lambda sql: sql.replace(f"({STEPS})", "st")
    names = _names_sql(_NAME_RULES, "(SELECT * FROM fx_names WHERE depth = 0)", "(SELECT st.chain_id, st.depth, c.type, c.kind, c.base FROM st JOIN fx_cert_constraints c ON st.cert_id = c.cert_id)")
    return f"""
WITH ch AS MATERIALIZED ({_CH(leaves)}),
st AS MATERIALIZED (SELECT ch.chain_id, k AS depth, len(p) - 1 AS last, complete, c.* FROM (SELECT *, unnest(range(len(p))) AS k FROM ch) ch JOIN fx_certs c ON c.cert_id = p[k + 1]),
bad AS MATERIALIZED (
  SELECT chain_id, rule FROM ({on_st(PATH)})
  UNION SELECT chain_id, 'unknown_critical' FROM st WHERE len(list_filter(string_split(critical, ','), lambda x: x NOT IN ({_KNOWN_CERT}))) > 0
  UNION SELECT chain_id, rule FROM ({names})),
k AS MATERIALIZED (
  SELECT g.*, EXISTS (SELECT 1 FROM fx_anchors a WHERE a.cert_id = root OR (a.spki = root_key AND a.subject = root_name)) AS trusted, chain_id IN (SELECT chain_id FROM bad) AS forbidden
  FROM (SELECT chain_id, arg_max(cert_id, depth) AS root, arg_max(ski, depth) AS root_key, arg_max(subject, depth) AS root_name, bool_and(complete) AS complete, coalesce(bool_or(sig_ok = FALSE AND depth < last), FALSE) AS broken, max(not_before) AS nb, min(not_after) AS na FROM st GROUP BY chain_id) g)"""


STAMPS = """SELECT t.*, list_contains(string_split(c.eku, ','), '1.3.6.1.5.5.7.3.8') AS eku_ok, coalesce(parsed AND imprint_ok AND t.sig_ok AND list_contains(string_split(c.eku, ','), '1.3.6.1.5.5.7.3.8'), FALSE) AS valid
FROM fx_timestamps t LEFT JOIN fx_certs c ON t.tsa_cert_id = c.cert_id"""


def _chain_tables(spark, sf, leaves: str):
    """(certs, steps, facts) of the built chains of all certificates whose id begins with one of those letters; the first two are written."""
    certs = cut(view(spark, sf, "fx_certs"), "certs")
    chains = T.build_chains(certs.filter(F.substring("cert_id", 1, 1).isin(*leaves)), certs, view(spark, sf, "fx_anchors"))
    steps_ = cut(T.chain_steps(chains, certs), "chain-steps")
    names = view(spark, sf, "fx_names").filter("depth = 0").select(F.col("chain_id").alias("cert_id"), "kind", "name")
    violations = T.path_violations(steps_, names, view(spark, sf, "fx_cert_constraints"))
    return certs, steps_, T.chain_facts(steps_, violations, view(spark, sf, "fx_anchors"))


@query("w7_path_violations", f"{_chains_sql('CT')} SELECT chain_id, rule FROM bad")
def path_violations(spark, sf):
    certs = cut(view(spark, sf, "fx_certs"), "certs")
    chains = T.build_chains(certs.filter(F.substring("cert_id", 1, 1).isin("C", "T")), certs, view(spark, sf, "fx_anchors"))
    names = view(spark, sf, "fx_names").filter("depth = 0").select(F.col("chain_id").alias("cert_id"), "kind", "name")
    return T.path_violations(cut(T.chain_steps(chains, certs), "chain-steps"), names, view(spark, sf, "fx_cert_constraints"))


@query("a2_timestamp_verdict", f"""{_chains_sql('T')}
SELECT sig_id, ts_id, valid, CASE WHEN NOT parsed THEN 'FAILED' WHEN eku_ok IS NULL THEN 'INDETERMINATE' WHEN NOT imprint_ok THEN 'FAILED' WHEN NOT sig_ok THEN 'FAILED' WHEN sig_ok IS NULL THEN 'INDETERMINATE' WHEN NOT eku_ok THEN 'FAILED' WHEN broken OR forbidden THEN 'FAILED'
    WHEN NOT (complete AND trusted) THEN 'INDETERMINATE' ELSE 'PASSED' END AS indication,
  CASE WHEN NOT parsed THEN 'FORMAT_FAILURE' WHEN eku_ok IS NULL THEN 'NO_SIGNING_CERTIFICATE_FOUND' WHEN NOT imprint_ok THEN 'HASH_FAILURE' WHEN NOT coalesce(sig_ok, FALSE) THEN 'SIG_CRYPTO_FAILURE' WHEN NOT eku_ok THEN 'SIG_CONSTRAINTS_FAILURE' WHEN broken OR forbidden THEN 'CHAIN_CONSTRAINTS_FAILURE'
    WHEN NOT (complete AND trusted) THEN 'NO_CERTIFICATE_CHAIN_FOUND' END AS sub_indication
FROM ({STAMPS}) s LEFT JOIN k ON k.chain_id = s.tsa_cert_id""")
def timestamp_verdict(spark, sf):
    certs, _, facts = _chain_tables(spark, sf, "T")
    return T.timestamp_verdict(T.stamp_purpose(view(spark, sf, "fx_timestamps"), certs), facts).select("sig_id", "ts_id", "valid", "indication", "sub_indication")


def _verdict_rows(spark, sf):
    """Signatures with all facts that rules ask for. Chains are built once and written with their certificates; all facts of a chain come from that table, by its id."""
    certs, st, facts = _chain_tables(spark, sf, "C")
    evidence = cut(evidence_rows(spark, sf), "evidence")
    stamps = T.stamp_purpose(view(spark, sf, "fx_timestamps"), certs)
    proof = stamps.filter("valid").groupBy("sig_id").agg(F.min_by("gen_time", F.struct("ts_id", "gen_time")).alias("proof"))
    algorithms = T.algorithm_policy(st.withColumnRenamed("chain_id", "sig_id")).select(F.col("sig_id").alias("cert_id"), (F.col("errors") > 0).alias("weak"))
    revoked = T.first_revoked(st, evidence).select(F.col("chain_id").alias("cert_id"), F.col("is_ca").alias("revoked_ca"), "reason", "revocation_date", "invalidity_date")
    asked = st.join(evidence.select("cert_id", "status"), "cert_id", "left").select(F.col("chain_id").alias("sig_id"), "cert_id", T.self_signed(F.col("subject"), F.col("issuer")).alias("is_root"), "status", F.col("complete").alias("chain_complete"))
    covered = T.revocation_complete(asked).select(F.col("sig_id").alias("cert_id"), F.col("complete").alias("covered"))
    by_chain = facts
    for other in (algorithms, revoked, covered):
        by_chain = by_chain.join(other, "cert_id", "left")
    x = view(spark, sf, "fx_signatures").withColumnRenamed("digest", "sig_digest")
    return x.join(proof, "sig_id", "left").join(cut(by_chain, "chain-facts"), "cert_id", "left")


def verdict_rows(spark, sf):
    c = F.col
    x = _verdict_rows(spark, sf)
    at = F.coalesce("proof", F.lit("2003-01-01").cast("timestamp"))
    broken = normalise_digest(c("sig_digest")).isin(*T.BROKEN)
    lost = c("revoked_ca").isNotNull() & ~T.protected(c("proof"), c("revocation_date"), c("invalidity_date"), T.reason_name(c("reason")))
    tail, changed = c("doc_length") > c("b2") + c("b3"), c("content_changed") | ~F.coalesce("appended_structured", F.lit(True))
    return T.verdict(x, {
        1: (c("b0") != 0) | (c("b1") < 0) | (c("b2") < c("b0") + c("b1")) | (c("b2") + c("b3") > c("doc_length")) | (c("b0") + c("b1") != c("contents_start")) | (c("b2") != c("contents_end")),
        3: ~c("cms_ok"), 4: c("root").isNull(), 5: ~c("digest_ok"), 6: ~c("sig_ok"),
        7: ~c("attributes_ok") | (~c("has_signing_certificate") & c("sub_filter").like("ETSI.%")), 7.5: ~c("has_signing_certificate"),
        8: ~(c("trusted") & c("complete")), 9: c("broken") | c("forbidden"), 10: c("weak") | broken,
        12: c("proof").isNull() & ((at < c("not_before")) | (at > c("not_after"))), 13: lost & ~c("revoked_ca"), 13.5: lost & c("revoked_ca"),
        14: ~c("covered"), 15: tail & c("content_changed").isNull(), 16: tail & changed & (F.coalesce("certification_p", F.lit(0)) != 1), 16.5: tail & changed & (c("certification_p") == 1),
    }).filter("NOT is_doc_timestamp")


#: Outcomes for SQL, from the rules' own table.
_OUTCOME = lambda k: " ".join(f"WHEN {n} THEN '{(i, sub)[k]}'" for n, _, i, sub in T.CASCADE)
_EV = f"ev AS MATERIALIZED ({_evidence(', b.reason, b.revocation_date, b.invalidity_date')})"
VERDICTS = f"""{_chains_sql('C')},
{_EV}
SELECT x.sig_id, x.doc_id, CASE v {_OUTCOME(0)} ELSE 'PASSED' END AS indication, CASE v {_OUTCOME(1)} END AS sub_indication
FROM (SELECT y.*, CASE WHEN r1 THEN 1 WHEN NOT cms_ok THEN 3 WHEN root IS NULL THEN 4 WHEN NOT digest_ok THEN 5 WHEN NOT sig_ok THEN 6 WHEN NOT attributes_ok OR (NOT has_signing_certificate AND sub_filter LIKE 'ETSI.%') THEN 7
    WHEN broken OR forbidden THEN 9 WHEN weak OR {FAMILY('sig_digest')} IN ('md5', 'sha1') THEN 10 WHEN revoked AND NOT safe THEN CASE WHEN revoked_ca THEN 13.5 ELSE 13 END WHEN NOT covered THEN 14
    WHEN tail AND content_changed IS NULL THEN 15 WHEN tail AND (content_changed OR appended_structured IS FALSE) THEN CASE WHEN coalesce(certification_p, 0) <> 1 THEN 16 ELSE 16.5 END
    WHEN proof IS NULL AND (TIMESTAMP '2003-01-01' < nb OR TIMESTAMP '2003-01-01' > na) THEN 12 WHEN NOT (trusted AND complete) THEN 8 WHEN NOT has_signing_certificate THEN 7.5 ELSE 17 END AS v
  FROM (SELECT s.* EXCLUDE (digest), s.digest AS sig_digest, t.proof, k.* EXCLUDE (chain_id), coalesce(a.errors > 0, FALSE) AS weak, r.chain_id IS NOT NULL AS revoked, coalesce(r.is_ca, FALSE) AS revoked_ca, z.covered,
      s.b0 <> 0 OR s.b1 < 0 OR s.b2 < s.b0 + s.b1 OR s.b2 + s.b3 > s.doc_length OR s.b0 + s.b1 <> s.contents_start OR s.b2 <> s.contents_end AS r1, s.doc_length > s.b2 + s.b3 AS tail,
      coalesce(t.proof < coalesce(r.invalidity_date, r.revocation_date), FALSE) AND NOT coalesce(r.reason IN (1, 2, 10), FALSE) AS safe
    FROM fx_signatures s
    LEFT JOIN (SELECT sig_id, arg_min(gen_time, struct_pack(t := ts_id, g := gen_time)) AS proof FROM ({STAMPS}) WHERE valid GROUP BY sig_id) t ON s.sig_id = t.sig_id
    LEFT JOIN k ON k.chain_id = s.cert_id
    LEFT JOIN ({ALGORITHMS.replace(f"({STEPS})", "st")}) a ON a.sig_id = s.cert_id
    LEFT JOIN (SELECT chain_id, depth, is_ca, reason, revocation_date, invalidity_date FROM (SELECT st.chain_id, st.depth, st.is_ca, ev.*, row_number() OVER (PARTITION BY st.chain_id ORDER BY st.depth) AS rn FROM st JOIN ev ON st.cert_id = ev.cert_id WHERE ev.status = 'revoked' AND st.depth < st.last) WHERE rn = 1) r ON r.chain_id = s.cert_id
    LEFT JOIN (SELECT st.chain_id, CASE WHEN bool_and(complete) THEN count(*) FILTER (WHERE st.subject <> st.issuer AND coalesce(ev.status, 'none') <> 'good') = 0 END AS covered FROM st LEFT JOIN ev ON st.cert_id = ev.cert_id GROUP BY st.chain_id) z ON z.chain_id = s.cert_id) y) x WHERE NOT is_doc_timestamp"""


@query("a1_verdict", VERDICTS)
def verdict(spark, sf):
    return verdict_rows(spark, sf).select("sig_id", "doc_id", "indication", "sub_indication")


@query("trust_verdicts", f"SELECT indication, sub_indication, count(*) AS n FROM ({VERDICTS}) GROUP BY ALL")
def trust_verdicts(spark, sf):
    return verdict_rows(spark, sf).groupBy("indication", "sub_indication").agg(F.count("*").alias("n"))


_ASKED = "SELECT s.sig_id, s.doc_id, ev.status, ev.embedded FROM fx_signatures s JOIN st ON st.chain_id = s.cert_id AND st.depth < st.last JOIN ev ON ev.cert_id = st.cert_id"


def _asked(spark, sf):
    certs, st, _ = _chain_tables(spark, sf, "C")
    return certs, T.signature_evidence(view(spark, sf, "fx_signatures"), st, evidence_rows(spark, sf))


@query("a3_achieved_level", f"""{_chains_sql('C')},
{_EV}, t AS (SELECT sig_id, bool_or(valid) AS stamped FROM ({STAMPS}) GROUP BY sig_id), e AS (SELECT sig_id, bool_and(embedded AND status IN ('good', 'revoked')) AS full_ev FROM ({_ASKED}) GROUP BY sig_id)
SELECT s.sig_id, CASE WHEN NOT coalesce(stamped, FALSE) THEN 'B-B' WHEN NOT coalesce(full_ev, FALSE) THEN 'B-T' WHEN s.doc_id NOT IN (SELECT doc_id FROM fx_signatures WHERE is_doc_timestamp) THEN 'B-LT' ELSE 'B-LTA' END AS level
FROM fx_signatures s LEFT JOIN t ON s.sig_id = t.sig_id LEFT JOIN e ON s.sig_id = e.sig_id""")
def achieved_level(spark, sf):
    sigs = view(spark, sf, "fx_signatures")
    certs, evidence = _asked(spark, sf)
    stamps = T.stamp_purpose(view(spark, sf, "fx_timestamps"), certs).select("sig_id", "valid")
    return T.achieved_level(sigs.select("sig_id", "doc_id"), stamps, evidence, sigs.filter("is_doc_timestamp"))


@query("a4_offline_verifiable", f"""{_chains_sql('C')},
{_EV} SELECT s.doc_id, bool_and(coalesce(full_ev, FALSE)) AS offline FROM fx_signatures s LEFT JOIN (SELECT sig_id, bool_and(embedded) AS full_ev FROM ({_ASKED}) GROUP BY sig_id) e ON s.sig_id = e.sig_id WHERE NOT is_doc_timestamp GROUP BY s.doc_id""")
def offline_verifiable(spark, sf):
    return T.offline_verifiable(view(spark, sf, "fx_signatures").filter("NOT is_doc_timestamp").select("sig_id", "doc_id"), _asked(spark, sf)[1])


@query("a5_revocation_complete", f"""{_chains_sql('C')},
{_EV} SELECT chain_id AS sig_id, CASE WHEN bool_and(complete) THEN count(*) FILTER (WHERE open) = 0 END AS complete, coalesce(string_agg(cert_id, ',' ORDER BY cert_id) FILTER (WHERE open), '') AS uncovered
FROM (SELECT st.chain_id, st.cert_id, st.complete, st.subject <> st.issuer AND coalesce(ev.status, 'none') <> 'good' AS open FROM st LEFT JOIN ev ON ev.cert_id = st.cert_id) GROUP BY chain_id""")
def revocation_complete(spark, sf):
    _, st, _ = _chain_tables(spark, sf, "C")
    x = st.join(evidence_rows(spark, sf).select("cert_id", "status"), "cert_id", "left")
    return T.revocation_complete(x.select(F.col("chain_id").alias("sig_id"), "cert_id", T.self_signed(F.col("subject"), F.col("issuer")).alias("is_root"), "status", F.col("complete").alias("chain_complete")))


@query("a6_coverage_summary", """
SELECT doc_id, covered, greatest(0, size - covered) AS unsigned, tail AS validation_tail, CASE WHEN f.c IS NOT NULL THEN NOT tail END AS modified FROM (
  SELECT *, size <= covered OR coalesce(f.c = FALSE AND f.a IS NOT FALSE, FALSE) AS tail FROM (
    SELECT doc_id, max(b2 + b3) AS covered, max(doc_length) AS size, max(struct_pack(k := struct_pack(e := b2 + b3, s := sig_id), c := content_changed, a := appended_structured)) AS f FROM fx_signatures GROUP BY doc_id))""")
def coverage_summary(spark, sf):
    return T.coverage_summary(view(spark, sf, "fx_signatures"))


@query("a17_revoked_snapshot", """
SELECT c.c_custkey AS serial, coalesce(s.status, 'good') AS status, s.reason FROM customer c LEFT JOIN (
  SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'revoked' ELSE 'good' END, struct_pack(d := o_orderdate, k := o_orderkey)) AS status, arg_max(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) AS reason FROM orders GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey""")
def revoked_snapshot(spark, sf):
    events = view(spark, sf, "orders").select(F.col("o_custkey").alias("serial"), F.when(F.col("o_orderstatus") == "F", "revoked").otherwise("good").alias("status"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("event_id"))
    return T.revoked_snapshot(events, view(spark, sf, "customer").select(F.col("c_custkey").alias("serial")))


@query("u1_evidence_pool", """
SELECT sha, arg_min(id, ord) AS first_id FROM (
  SELECT sha256(c_mktsegment || c_nationkey) AS sha, 'C' || c_custkey AS id, c_custkey AS ord FROM customer UNION ALL SELECT sha256('BUILDING' || s_nationkey), 'S' || s_suppkey, 1000000000 + s_suppkey FROM supplier) GROUP BY sha""")
def evidence_pool(spark, sf):
    a = view(spark, sf, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("der"), F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_custkey").alias("ord"))
    b = view(spark, sf, "supplier").select(F.concat(F.lit("BUILDING"), F.col("s_nationkey").cast("string")).alias("der"), F.concat(F.lit("S"), "s_suppkey").alias("id"), (F.col("s_suppkey") + 1000000000).alias("ord"))
    return T.evidence_pool(a, b)
