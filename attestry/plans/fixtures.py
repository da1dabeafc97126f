"""Evidence tables derived from the driver's tables, in SQL that Spark and DuckDB read alike.

`SHA256(x)` stands for the hex digest, which the two spell differently. A view may use tables and earlier views in braces.
"""

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Digests of names and keys of issuers, by Python rather than by the functions that are tested with them.
_DIGESTS = ", ".join(f"('{a}', '{m}', '{hashlib.new(a, m.encode()).hexdigest()}')" for a in ("sha1", "sha256", "sha384", "sha512", "md5") for n in range(25) for m in (f"CN=ca-{n}", f"key-ca-{n}"))

VIEWS = {
    "fx_digests": f"SELECT * FROM (VALUES {_DIGESTS}) AS v(algorithm, message, digest)",
    "fx_certs": """
SELECT 'R' || r_regionkey AS cert_id, 'CN=root-' || r_regionkey AS subject, 'CN=root-' || r_regionkey AS issuer,
  md5('key-root-' || r_regionkey) AS ski, CAST(NULL AS STRING) AS aki, CAST(NULL AS STRING) AS aki_serial, '00' || lpad(CAST(r_regionkey AS STRING), 4, '0') AS serial,
  TRUE AS is_ca, CASE WHEN r_regionkey % 3 = 1 THEN 0 WHEN r_regionkey % 3 = 2 THEN 1 END AS path_len, TRUE AS key_cert_sign, TRUE AS digital_signature,
  'rsa' AS key_type, 4096 AS key_bits, CASE WHEN r_regionkey = 4 THEN 'sha1' ELSE 'sha512' END AS digest,
  CAST('1980-01-01' AS TIMESTAMP) AS not_before, CAST('2040-01-01' AS TIMESTAMP) AS not_after, TRUE AS sig_ok, '' AS critical, '' AS eku, FALSE AS content_commitment
FROM {region}
UNION ALL
SELECT 'N' || n_nationkey, 'CN=ca-' || n_nationkey, 'CN=root-' || n_regionkey, md5('key-ca-' || n_nationkey), md5('key-root-' || n_regionkey),
  CASE WHEN n_nationkey % 4 = 0 THEN '00' || lpad(CAST(n_regionkey AS STRING), 4, '0') END, '0a' || lpad(CAST(n_nationkey AS STRING), 4, '0'),
  CASE WHEN n_nationkey <> 20 THEN n_nationkey % 13 <> 7 END, CASE WHEN n_nationkey % 5 = 0 THEN 0 END, n_nationkey % 11 <> 6, TRUE,
  CASE WHEN n_nationkey % 6 = 1 THEN 'ec' ELSE 'rsa' END, CASE WHEN n_nationkey % 6 = 1 THEN 384 WHEN n_nationkey % 11 = 3 THEN 1024 ELSE 2048 END,
  CASE WHEN n_nationkey % 7 = 5 THEN 'sha1' ELSE 'sha256' END, CAST('1985-01-01' AS TIMESTAMP), CASE WHEN n_nationkey % 9 = 8 THEN CAST('1997-01-01' AS TIMESTAMP) ELSE CAST('2030-01-01' AS TIMESTAMP) END,
  n_nationkey % 10 <> 9, CASE WHEN n_nationkey % 12 = 11 THEN '2.5.29.15,1.2.3.4' WHEN n_nationkey % 12 = 10 THEN '2.5.29.16,2.5.29.18,2.5.29.46,1.3.6.1.5.5.7.1.3' ELSE '2.5.29.15,2.5.29.19' END, '', FALSE
FROM {nation}
UNION ALL
SELECT 'X' || n_nationkey, 'CN=ca-' || n_nationkey, 'CN=root-' || n_regionkey, md5('old-ca-' || n_nationkey), md5('key-root-' || n_regionkey), CAST(NULL AS STRING), '0b' || lpad(CAST(n_nationkey AS STRING), 4, '0'),
  TRUE, CAST(NULL AS INT), TRUE, TRUE, 'rsa', 2048, 'sha256', CAST('1980-01-01' AS TIMESTAMP), CAST('2035-01-01' AS TIMESTAMP), TRUE, '', '', FALSE
FROM {nation} WHERE n_nationkey % 3 = 0
UNION ALL
SELECT 'C' || c_custkey, 'CN=' || c_name || ',O=' || c_mktsegment, 'CN=ca-' || c_nationkey, md5('key-c-' || c_custkey),
  CASE WHEN c_custkey % 10 <> 0 THEN md5('key-ca-' || c_nationkey) END, CAST(NULL AS STRING), '0c' || lpad(CAST(c_custkey AS STRING), 10, '0'),
  FALSE, CAST(NULL AS INT), FALSE, c_custkey % 31 <> 9, CASE WHEN c_custkey % 5 = 0 THEN 'ec' WHEN c_custkey % 41 = 1 THEN 'dsa' ELSE 'rsa' END,
  CASE WHEN c_custkey % 35 = 0 THEN 192 WHEN c_custkey % 5 = 0 THEN 256 WHEN c_custkey % 29 = 4 THEN 1024 WHEN c_custkey % 3 = 0 THEN 3072 ELSE 2048 END,
  CASE WHEN c_custkey % 37 = 2 THEN 'md5WithRSAEncryption' WHEN c_custkey % 2 = 0 THEN 'RSA-SHA256' ELSE 'SHA384' END,
  CAST('1991-01-01' AS TIMESTAMP), CASE WHEN c_custkey % 8 = 3 THEN CAST('1996-06-01' AS TIMESTAMP) ELSE CAST('2020-01-01' AS TIMESTAMP) END,
  CASE WHEN c_custkey % 17 = 3 THEN FALSE WHEN c_custkey % 17 = 5 THEN CAST(NULL AS BOOLEAN) ELSE TRUE END,
  CASE WHEN c_custkey % 43 = 7 THEN '2.5.29.15,9.9.9' ELSE '2.5.29.15' END, CASE WHEN c_custkey % 21 = 2 THEN '1.3.6.1.5.5.7.3.1' WHEN c_custkey % 21 = 3 THEN '1.3.6.1.5.5.7.3.36' ELSE '' END, c_custkey % 62 = 9
FROM {customer}
UNION ALL
SELECT 'T' || s_suppkey, 'CN=tsa-' || s_suppkey, 'CN=ca-' || s_nationkey, md5('key-t-' || s_suppkey), md5('key-ca-' || s_nationkey), CAST(NULL AS STRING), '0d' || lpad(CAST(s_suppkey AS STRING), 10, '0'),
  FALSE, CAST(NULL AS INT), FALSE, TRUE, 'rsa', 3072, 'sha256', CAST('1990-01-01' AS TIMESTAMP), CAST('2035-01-01' AS TIMESTAMP), s_suppkey % 13 <> 4,
  CASE WHEN s_suppkey % 17 = 6 THEN '2.5.29.37,8.8' ELSE '2.5.29.37' END, CASE WHEN s_suppkey % 9 = 1 THEN '' WHEN s_suppkey % 9 = 2 THEN '2.5.29.37.0' WHEN s_suppkey % 9 = 3 THEN '1.3.6.1.5.5.7.3.1,1.3.6.1.5.5.7.3.8' ELSE '1.3.6.1.5.5.7.3.8' END, FALSE
FROM {supplier}""",
    "fx_anchors": """
SELECT md5('key-root-' || r_regionkey) AS spki, 'CN=root-' || r_regionkey AS subject, CASE WHEN r_regionkey = 4 THEN 'A4' ELSE 'R' || r_regionkey END AS cert_id FROM {region} WHERE r_regionkey <> 3
UNION ALL SELECT 'other', 'CN=elsewhere', 'Z1' FROM {region} WHERE r_regionkey = 0""",
    "fx_crls": """
SELECT n_nationkey * 2 AS crl_id, 'CN=ca-' || n_nationkey AS issuer, '0' || CAST(10 + n_nationkey AS STRING) AS crl_number, FALSE AS is_delta, CAST(NULL AS STRING) AS base_number,
  CAST('1995-01-01' AS TIMESTAMP) AS this_update, CASE WHEN n_nationkey % 7 = 3 THEN CAST(NULL AS TIMESTAMP) WHEN n_nationkey % 7 = 4 THEN CAST('1996-01-01' AS TIMESTAMP) ELSE CAST('2001-01-01' AS TIMESTAMP) END AS next_update,
  n_nationkey % 8 = 5 AS only_ca, FALSE AS only_user, n_nationkey % 24 = 23 AS only_attribute, n_nationkey % 6 = 2 AS indirect,
  CASE WHEN n_nationkey % 5 = 4 THEN 'keyCompromise' ELSE '' END AS some_reasons, CASE WHEN n_nationkey % 9 = 1 THEN '2.5.29.28,1.2.3' WHEN n_nationkey % 9 = 2 THEN '2.5.29.20,2.5.29.27,2.5.29.55' ELSE '' END AS critical,
  n_nationkey % 16 <> 15 AS sig_ok, CASE WHEN n_nationkey % 4 = 3 THEN 'http://crl/' || n_nationkey ELSE '' END AS uris, n_nationkey % 5 <> 3 AS embedded
FROM {nation}
UNION ALL
SELECT n_nationkey * 2 + 1, 'CN=ca-' || n_nationkey, CAST(20 + n_nationkey AS STRING), TRUE, CASE WHEN n_nationkey % 5 = 1 THEN '99' WHEN n_nationkey % 5 = 2 THEN CAST(NULL AS STRING) ELSE '00' || CAST(10 + n_nationkey AS STRING) END,
  CAST('1996-01-01' AS TIMESTAMP), CAST('2001-01-01' AS TIMESTAMP), FALSE, FALSE, FALSE, FALSE, '', '', TRUE, '', TRUE
FROM {nation}
UNION ALL
SELECT 1000 + r_regionkey * 2, 'CN=root-' || r_regionkey, '30', FALSE, CAST(NULL AS STRING), CAST('1995-01-01' AS TIMESTAMP), CAST('2001-01-01' AS TIMESTAMP), FALSE, FALSE, FALSE, FALSE, '', '', TRUE, '', TRUE
FROM {region} WHERE r_regionkey <> 2""",
    "fx_crl_entries": """
SELECT c_nationkey * 2 AS crl_id, 'c' || lpad(CAST(c_custkey AS STRING), 10, '0') AS serial, CAST(c_custkey % 11 AS INT) AS reason,
  coalesce(first_order, CAST('1994-01-01' AS TIMESTAMP)) AS revocation_date,
  CASE WHEN c_custkey % 4 = 1 THEN coalesce(first_order, CAST('1994-01-01' AS TIMESTAMP)) - INTERVAL 30 DAY END AS invalidity_date,
  CASE WHEN c_custkey % 6 = 0 THEN 'CN=ca-other' END AS entry_issuer
FROM {customer} LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) AS o ON c_custkey = o_custkey
WHERE c_acctbal < 0
UNION ALL
SELECT c_nationkey * 2 + 1, 'c' || lpad(CAST(c_custkey AS STRING), 10, '0'), CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 4 END, CAST('1996-03-01' AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS STRING)
FROM {customer} WHERE c_custkey % 9 = 4
UNION ALL
SELECT 1000 + n_regionkey * 2, '0a' || lpad(CAST(n_nationkey AS STRING), 4, '0'), CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 4 END, CAST('1996-05-01' AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS STRING)
FROM {nation} WHERE n_nationkey % 7 = 6""",
    "fx_ocsp": """
SELECT c_custkey AS response_id, n.algorithm AS algorithm, n.digest AS issuer_name_hash, k.digest AS issuer_key_hash,
  'c' || lpad(CAST(c_custkey AS STRING), 10, '0') AS serial, CASE WHEN c_acctbal < 0 THEN 'revoked' WHEN c_custkey % 15 = 1 THEN 'unknown' ELSE 'good' END AS status,
  CAST('1997-01-01' AS TIMESTAMP) AS this_update, CASE WHEN c_custkey % 12 = 5 THEN CAST('1997-01-02' AS TIMESTAMP) WHEN c_custkey % 12 = 9 THEN CAST(NULL AS TIMESTAMP) ELSE CAST('2001-01-01' AS TIMESTAMP) END AS next_update,
  CASE WHEN c_custkey % 13 = 2 THEN 'ERR_OCSP_SIGNATURE' END AS error, c_custkey % 20 <> 6 AS embedded
FROM {customer} JOIN {fx_digests} AS n ON n.message = 'CN=ca-' || c_nationkey AND n.algorithm = CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'sha1' WHEN 1 THEN 'sha256' WHEN 2 THEN 'sha384' WHEN 3 THEN 'sha512' ELSE 'md5' END
JOIN {fx_digests} AS k ON k.message = 'key-ca-' || c_nationkey AND k.algorithm = n.algorithm WHERE c_custkey % 4 = 1 OR c_custkey % 4 = 2""",
    "fx_signatures": """
SELECT o_orderkey AS sig_id, CAST(floor(o_orderkey / 3.0) AS BIGINT) AS doc_id, CAST(o_orderkey % 3 AS INT) AS ord, 'C' || o_custkey AS cert_id, o_orderdate AS sig_time,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'sha1WithRSAEncryption' WHEN o_orderpriority LIKE '2%' THEN 'SHA512' ELSE 'sha256' END AS digest,
  CASE WHEN o_orderkey % 5 = 0 THEN 'adbe.pkcs7.detached' ELSE 'ETSI.CAdES.detached' END AS sub_filter,
  CASE WHEN o_orderkey % 97 = 1 THEN 1 ELSE 0 END AS b0, CASE WHEN o_orderkey % 97 = 5 THEN -1 ELSE 1000 + o_orderkey % 500 END AS b1,
  1000 + o_orderkey % 500 + CASE WHEN o_orderkey % 97 = 2 THEN -10 ELSE 200 END AS b2, 500 + CASE WHEN o_orderkey % 97 = 3 THEN 999 ELSE 0 END AS b3,
  1700 + o_orderkey % 500 + CASE WHEN o_orderkey % 10 = 7 THEN 300 ELSE 0 END AS doc_length,
  1000 + o_orderkey % 500 AS contents_start, 1200 + o_orderkey % 500 + CASE WHEN o_orderkey % 97 = 4 THEN 2 ELSE 0 END AS contents_end,
  o_orderkey % 53 <> 11 AS cms_ok, o_orderkey % 59 <> 12 AS digest_ok, CASE WHEN o_orderkey % 61 = 13 THEN FALSE ELSE TRUE END AS sig_ok,
  o_orderkey % 67 <> 14 AS attributes_ok, o_orderkey % 7 <> 4 AS has_signing_certificate, CASE WHEN o_orderkey % 11 = 6 THEN CAST(NULL AS BOOLEAN) WHEN o_orderkey % 13 = 7 THEN TRUE ELSE FALSE END AS content_changed,
  CASE WHEN o_orderkey % 19 = 3 THEN 1 WHEN o_orderkey % 19 = 5 THEN 2 END AS certification_p, o_orderkey % 41 = 17 AS is_doc_timestamp,
  CASE WHEN o_orderkey % 10 = 7 THEN CASE WHEN o_orderkey % 23 = 5 THEN FALSE WHEN o_orderkey % 23 <> 6 THEN TRUE END ELSE TRUE END AS appended_structured
FROM {orders}""",
    "fx_timestamps": """
SELECT l_orderkey AS sig_id, l_linenumber AS ts_id, l_shipdate AS gen_time, (l_orderkey + l_linenumber) % 19 <> 4 AS imprint_ok, CASE WHEN l_orderkey % 37 <> 7 THEN 'T' || l_suppkey END AS tsa_cert_id,
  CASE WHEN (l_orderkey + l_linenumber) % 29 = 8 THEN CAST(NULL AS BOOLEAN) ELSE (l_orderkey + l_linenumber) % 31 <> 9 END AS sig_ok, (l_orderkey + l_linenumber) % 43 <> 9 AS parsed
FROM {lineitem}""",
    "fx_records": """
SELECT source AS ledger_id, CAST(row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS INT) AS seq, SHA256(text) AS document_hash, 'D-' || d.doc_id AS doc_no,
  'signer-' || lang AS signer, 'ca-' || lang AS issuer, CASE WHEN d.doc_id % 3 = 0 THEN 'B-LT' ELSE 'B-B' END AS level,
  CASE WHEN quality = 0 THEN 'INDETERMINATE' WHEN toxic = 1 THEN 'FAILED' ELSE 'PASSED' END AS indication, d.doc_id AS doc_id
FROM {documents} AS d LEFT JOIN {labels} AS l ON d.doc_id = l.doc_id""",
    "fx_resolution": """
SELECT DISTINCT regexp_extract(url, '://([^/?#:]+)', 1) AS host,
  CASE WHEN page_id % 7 = 0 THEN '10.1.2.3' WHEN page_id % 7 = 1 THEN '::ffff:127.0.0.1' WHEN page_id % 7 = 2 THEN '2001:db8::1' WHEN page_id % 7 = 3 THEN '100.64.3.4' ELSE '93.184.' || (page_id % 200) || '.34' END AS address
FROM {pages} WHERE page_id % 10 <> 9""",
    "fx_addresses": """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 256) || '.' || (event_id * 7 % 256) || '.' || (event_id * 13 % 256) || '.' || (event_id * 29 % 300)
  WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 5 = 0 THEN '10.' WHEN event_id % 5 = 1 THEN '172.16.' WHEN event_id % 5 = 2 THEN '192.168.' WHEN event_id % 5 = 3 THEN '169.254.' ELSE '8.8.' END || (event_id % 256) || '.' || (event_id % 251) || CASE WHEN event_id % 5 = 0 THEN '.1' ELSE '' END
  ELSE CAST(event_id AS STRING) END AS address FROM {events}""",
    "fx_addresses6": """
SELECT event_id, CASE CAST(event_id % 12 AS INT) WHEN 0 THEN '::1' WHEN 1 THEN '::' WHEN 2 THEN 'fe80::' || (event_id % 1000) WHEN 3 THEN 'fc00:1::' || (event_id % 1000) WHEN 4 THEN 'ff02::1'
  WHEN 5 THEN '::ffff:10.0.0.' || (event_id % 256) WHEN 6 THEN '::ffff:8.8.8.' || (event_id % 256) WHEN 7 THEN '2002:0a00:' || (event_id % 1000) || '::1' WHEN 8 THEN '64:ff9b::192.168.0.' || (event_id % 256)
  WHEN 9 THEN '2001:4860:4860::' || (event_id % 1000) WHEN 10 THEN '1:2:3:4:5:6:7:8:9' ELSE '2606:4700:0:0:0:0:0:' || (event_id % 1000) END AS address FROM {events}""",
    "fx_blocks": """
SELECT (c_custkey * 37 % 256) || '.' || (c_custkey * 11 % 256) || '.' || (c_custkey * 5 % 256) || '.' || (c_custkey % 256) || '/' || (4 + c_custkey % 29) AS cidr FROM {customer}
UNION ALL SELECT '2001:' || (c_custkey % 1000) || ':' || (c_custkey % 10) || '::/' || (16 + c_custkey % 40) FROM {customer} WHERE c_custkey % 3 = 0""",
    "fx_patterns": """
SELECT CASE WHEN page_id % 5 = 1 THEN '*.' ELSE '' END || upper(regexp_extract(url, '://([^/?#:@]+)', 1)) AS pattern, 'deny' AS list FROM {pages} WHERE page_id % 17 = 3
UNION ALL SELECT '*.' || regexp_extract(url, '://[^/?#:@]*?([^/?#:@.]+[.][^/?#:@.]+)', 1), 'allow' FROM {pages} WHERE page_id % 5 < 3
UNION ALL SELECT '*.c' || c_custkey || '.test', CASE WHEN c_custkey % 2 = 0 THEN 'allow' ELSE 'deny' END FROM {customer}""",
    "fx_ops": """
SELECT user_id AS session_id, event_id, ts, 'client-' || (event_id % 5) AS client_id, CAST(floor(value) AS BIGINT) % 7 AS lag_versions,
  CASE event_type WHEN 'click' THEN 'updateNode' WHEN 'view' THEN 'updateNode' WHEN 'purchase' THEN 'addNode' WHEN 'error' THEN 'removeNode' ELSE 'setMeta' END AS op,
  'n' || (event_id % 6) AS target, CASE WHEN event_id % 3 = 0 THEN 'x,y' WHEN event_id % 3 = 1 THEN 'y,fill' ELSE 'text' END AS patch_keys, CAST(value AS STRING) AS new_value
FROM {events}""",
    "fx_lines": """
SELECT l_orderkey AS doc_id, CAST(l_suppkey % 2 AS INT) AS page, l_linenumber AS ord,
  CASE WHEN l_partkey % 9 = 1 THEN 72.0 WHEN l_partkey % 9 = 2 THEN 90.0 ELSE 50.0 END AS x, CASE WHEN l_partkey % 7 = 1 THEN 200.0 ELSE 400.0 END + CASE WHEN l_partkey % 9 = 2 THEN 90.0 ELSE 50.0 END AS line_end,
  100.0 + l_linenumber * 15.0 + CASE WHEN l_partkey % 11 = 5 THEN 40.0 ELSE 0.0 END AS baseline, CASE WHEN l_partkey % 13 = 2 THEN 20.0 ELSE 11.0 END AS font_size,
  CASE WHEN l_partkey % 17 = 3 THEN 'b' ELSE 'a' END AS style_key, 'w' || l_partkey AS text
FROM {lineitem}""",
    "fx_steps": """
SELECT 'C' || c_custkey AS chain_id, 0 AS depth, 'C' || c_custkey AS cert_id, 2 AS last FROM {customer}
UNION ALL SELECT 'C' || c_custkey, 1, 'N' || c_nationkey, 2 FROM {customer}
UNION ALL SELECT 'C' || c_custkey, 2, 'R' || n_regionkey, 2 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "fx_constraints": """
SELECT 'C' || c_custkey AS chain_id, 1 AS depth, CASE WHEN c_nationkey % 2 = 0 THEN 'permitted' ELSE 'excluded' END AS type, 'dns' AS kind, CASE WHEN c_nationkey % 3 = 0 THEN '.seg' ELSE 'machinery.seg' END AS base FROM {customer} WHERE c_nationkey % 5 < 3
UNION ALL SELECT 'C' || c_custkey, 2, 'permitted', 'email', CASE WHEN c_nationkey % 2 = 0 THEN 'corp.test' ELSE '.test' END FROM {customer} WHERE c_nationkey % 4 = 1
UNION ALL SELECT 'C' || c_custkey, 2, 'excluded', 'uri', 'shop' || (c_custkey % 3) || '.test' FROM {customer} WHERE c_nationkey % 4 = 2
UNION ALL SELECT 'C' || c_custkey, 1, 'permitted', 'dn', 'C=R/O=' || c_mktsegment FROM {customer} WHERE c_nationkey % 6 = 5
UNION ALL SELECT 'C' || c_custkey, 2, CASE WHEN c_nationkey % 2 = 0 THEN 'permitted' ELSE 'excluded' END, 'ip', CASE c_nationkey % 4 WHEN 0 THEN '0a000000ff000000' WHEN 1 THEN '0a010000ffff0000' WHEN 2 THEN '20010db8000000000000000000000000ffffffff000000000000000000000000' ELSE '0a0000' END FROM {customer} WHERE c_nationkey % 3 = 0""",
    "fx_cert_constraints": """
SELECT 'N' || n_nationkey AS cert_id, CASE WHEN n_nationkey % 2 = 0 THEN 'permitted' ELSE 'excluded' END AS type, 'dns' AS kind, CASE WHEN n_nationkey % 3 = 0 THEN '.seg' ELSE 'machinery.seg' END AS base FROM {nation} WHERE n_nationkey % 5 = 2
UNION ALL SELECT 'R' || r_regionkey, 'excluded', 'uri', 'shop' || r_regionkey || '.test' FROM {region} WHERE r_regionkey % 3 = 1
UNION ALL SELECT 'N' || n_nationkey, 'permitted', 'email', 'corp.test' FROM {nation} WHERE n_nationkey % 8 = 6""",
    "fx_names": """
SELECT 'C' || c_custkey AS chain_id, 0 AS depth, 'dns' AS kind, 'host' || (c_custkey % 7) || '.' || lower(c_mktsegment) || '.seg' AS name FROM {customer}
UNION ALL SELECT 'C' || c_custkey, 0, 'email', 'user@' || CASE WHEN c_custkey % 2 = 0 THEN 'corp.test' ELSE 'mail.other' END FROM {customer}
UNION ALL SELECT 'C' || c_custkey, 0, 'uri', 'https://u@shop' || (c_custkey % 5) || '.test:8443/x' FROM {customer}
UNION ALL SELECT 'C' || c_custkey, 0, 'ip', CASE c_custkey % 4 WHEN 0 THEN '0a0000' || lpad(hex(CAST(c_custkey % 256 AS BIGINT)), 2, '0') WHEN 1 THEN '0a0100' || lpad(hex(CAST(c_custkey % 256 AS BIGINT)), 2, '0') WHEN 2 THEN '20010db80000000000000000000000' || lpad(hex(CAST(c_custkey % 256 AS BIGINT)), 2, '0') ELSE '0b000001' END FROM {customer}
UNION ALL SELECT 'C' || c_custkey, 0, 'dn', 'C=R/O=' || CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END || '/CN=' || c_name FROM {customer}""",
}


def _spark_sql(sql: str) -> str:
    return re.sub(r"SHA256\(([^()]*)\)", r"sha2(\1, 256)", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, or one derived from them."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    return spark.sql(_spark_sql(sql), **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def oracle(sql: str) -> str:
    """SQL for DuckDB: the views that it names become common table expressions before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in VIEWS:
            if re.search(rf"\b{n}\b", text) and n not in needed:
                need(VIEWS[n])
                needed.append(n)

    need(sql)
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n]).replace('SHA256(', 'sha256(')})" for n in needed]
    body = sql.strip()
    if not parts:
        return body
    recursive = re.match(r"WITH RECURSIVE\b", body)
    rest = re.sub(r"^WITH(?: RECURSIVE)?\b", ",", body, count=1) if body.startswith("WITH") else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {rest}"
