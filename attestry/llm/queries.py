"""The queries of this subpackage, and their SQL where SQL can say the same. Each reads its whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.decontaminate import contamination
from attestry.llm.langid import identify
from attestry.llm.licenses import scan_licenses
from attestry.llm.merkle_manifest import build_manifest, fold, leaf_digest, proof_digest, proofs
from attestry.llm.minhash import near_duplicates
from attestry.llm.mixing import mix
from attestry.llm.phrases import collocations
from attestry.llm.quality import judge_quality
from attestry.llm.shared import ascii_lower, cut, shared_path, small
from attestry.llm.surrogates import replace_pii
from attestry.llm.token_ledger import TOKENIZERS, TokenLedger, bpe_tokens, counted, deleted
from attestry.llm.token_shards import read_documents, write_shards
from attestry.llm.url_filter import judge_urls
from attestry.llm.warc import plan_records, read_index, read_records, resolved, write_warc

#: Fixed values of the contract: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: The setting that holds the key of surrogates.
SURROGATE_KEY = "spark.attestry.surrogate.key"


def surrogate_key(spark: SparkSession) -> bytes:
    """The session's key. Without one, a local session or local cluster, as in tests, gets a known key, and any other an error."""
    key = spark.conf.get(SURROGATE_KEY, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SURROGATE_KEY} to a secret")
    return (key or "a key of tests").encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)


#: Ids of documents that are broadcast, 8 bytes each; more are joined by shuffle.
ID_ROWS = 500_000


def _rollup(spark: SparkSession, sf_dir: str, tokenizers: dict) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = TokenLedger(spark, shared_path(spark, "token-ledger"))
    labelled = lambda which: small(labels.filter(which).select("doc_id").distinct(), ID_ROWS)
    once = docs.join(labelled("quality = 0"), "doc_id", "left_semi").withColumn("text", F.array_join(F.array_distinct(F.split("text", "\n")), "\n"))
    revised = cut(counted(once, "revise", tokenizers), "recounted")
    ledger.commit("1-load", counted(docs, "insert", tokenizers))
    ledger.commit("2-clean", revised)
    ledger.commit("3-takedown", deleted(docs.join(labelled("toxic = 1"), "doc_id", "left_semi"), tokenizers))
    ledger.commit("2-clean", revised)
    return ledger.totals()


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those of low quality are counted again without their repeated lines; toxic ones are deleted; and the second batch is sent once more."""
    return _rollup(spark, sf_dir, {**TOKENIZERS, "byte_bpe_50k@1": bpe_tokens(public_tokenizers.path("byte_bpe_50k.json"))})


def sql_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with the tokenizers that SQL can express."""
    return _rollup(spark, sf_dir, TOKENIZERS)


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op4_pigeonhole_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", F.col("mix_copy").cast("long").alias("copy_no"), F.round("mix_rate", 6).alias("rate"), F.col("mix_order").alias("shuffle_key"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(places, lambda s: s["start_word"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(places).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["standing"])), F.lit(0.0)).alias("score"), "spans",
    )


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, surrogate_key(spark)).select("doc_id", "text", F.size(F.coalesce("pii", F.array())).cast("long").alias("n_entities"), F.col("pii.kind").alias("kinds"))


def op9_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "band_low", "band_high")


def op10_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    return identify(docs, learn).select("doc_id", "held_out", "lang_pred", "score")


def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, index = shared_path(spark, "warc"), shared_path(spark, "warc-index")
    write_warc(plan_records(table(spark, sf_dir, "pages")), path, index)
    records = cut(read_records(read_index(spark, index), path), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(tampered, leaf(ascii_lower(F.col("text")))).alias("other"))
    return proofs(build_manifest(leaves, "source", "doc_id")).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("steps"))).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_wavelet_shards": op1_wavelet_shards,
    "op2_token_rollup": op2_token_rollup,
    "sql_token_rollup": sql_token_rollup,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_pigeonhole_matches": op4_pigeonhole_matches,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_url_rules": op6_url_rules,
    "op7_license_rules": op7_license_rules,
    "op8_surrogates": op8_surrogates,
    "op9_ngram_perplexity": op9_ngram_perplexity,
    "op10_hyperdimensional_langid": op10_hyperdimensional_langid,
    "op11_warc_index": op11_warc_index,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLES = {
    "sql_token_rollup": r"""
WITH low AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
now AS (
  SELECT d.source, d.lang, coalesce(CASE WHEN l.doc_id IS NULL THEN d.text ELSE array_to_string(list_distinct(string_split(d.text, chr(10))), chr(10)) END, '') AS text
  FROM documents d LEFT JOIN low l ON d.doc_id = l.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM gone)),
counts AS (
  SELECT source, lang, 'ws@1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM now
  UNION ALL SELECT source, lang, 'alnum@2', len(regexp_extract_all(text, '[0-9A-Za-z]+|[^\x00-\x7F]+')) FROM now)
SELECT source, lang, tokenizer, count(*) AS docs, sum(n)::BIGINT AS tokens FROM counts GROUP BY source, lang, tokenizer
""",
    "op5_poisson_mix": """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0 * (SELECT sum(size) FROM sizes)::DOUBLE * pow(size::DOUBLE, 0.7) / (SELECT sum(pow(size::DOUBLE, 0.7)) FROM sizes) / size AS rate
  FROM sizes WHERE size > 0
  UNION ALL SELECT source, 1.0 FROM sizes WHERE size = 0),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 64))::BIGINT AS m FROM rates),
pmf AS (
  SELECT source, k, exp(k * ln(rate / m) - rate / m - lgamma((k + 1)::DOUBLE)) AS p
  FROM parts, range(0, 256) AS t(k) WHERE rate > 0 AND k <= ceil(rate / m + 12 * sqrt(rate / m) + 30)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
tables AS (SELECT source, list(c ORDER BY c) AS cs FROM cdf GROUP BY source),
keyed AS (SELECT *, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS k FROM documents),
draws AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, d.k, p.rate,
    list_sum(list_transform(range(1, p.m + 1), lambda j: len(list_filter(t.cs, lambda c: c <= ('0x' || substr(md5('42:' || d.k || ':' || j), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0)))) AS n
  FROM keyed d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, lang, n_chars, text, c::BIGINT AS copy_no, round(rate, 6) AS rate, ('0x' || substr(md5('42/' || k || '/' || c), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS c FROM draws)
""",
    "op6_url_rules": """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
keys AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM keys JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
""",
    "op11_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
groups AS (SELECT html, max(page_id) AS first FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN groups g ON p.html = g.html
""",
    "op12_merkle_manifest": """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda x, b: xor(xor(x, b) // 2, (xor(x, b) % 2) * 3988292384)), 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM fields)),
trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS tree FROM (SELECT DISTINCT source FROM documents)),
leaves AS (
  SELECT doc_id, leaf, other, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed h JOIN trees t ON h.source IS NOT DISTINCT FROM t.source),
inner_nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM inner_nodes WHERE n > 1 GROUP BY tree, level, idx // 16, n),
subroots AS (SELECT tree, digest AS subroot FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, tree - 1 AS idx, subroot AS digest, (SELECT count(*) FROM trees) AS n FROM subroots
  UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM outer_nodes WHERE n > 1 GROUP BY level, idx // 16, n),
met AS (
  SELECT l.tree, l.idx, x.level AS height, x.digest, x.idx AS place, l.idx // (16 ** x.level)::BIGINT AS own
  FROM leaves l JOIN inner_nodes x ON l.tree = x.tree AND x.n > 1 AND x.idx // 16 = l.idx // (16 ** (x.level + 1))::BIGINT
  UNION ALL
  SELECT l.tree, l.idx, 1000 + x.level, x.digest, x.idx, (l.tree - 1) // (16 ** x.level)::BIGINT
  FROM leaves l JOIN outer_nodes x ON x.n > 1 AND x.idx // 16 = (l.tree - 1) // (16 ** (x.level + 1))::BIGINT),
beside AS (
  SELECT tree, idx, height, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS b, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS a
  FROM met GROUP BY tree, idx, height),
steps AS (SELECT tree, idx, list({'b': b, 'a': a} ORDER BY height) AS s FROM beside GROUP BY tree, idx),
done AS (
  SELECT l.doc_id, l.leaf, r.subroot, (SELECT digest FROM outer_nodes WHERE n = 1) AS root, coalesce(array_to_string(list_transform(s, lambda x: x.b || x.a), ''), '') AS beside_all,
    coalesce(list_reduce(list_prepend({'b': other, 'a': ''}, s), lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}).b, other) AS folded_root
  FROM leaves l JOIN subroots r ON l.tree = r.tree LEFT JOIN steps s ON l.tree = s.tree AND l.idx = s.idx)
SELECT doc_id, leaf, subroot, root, sha256(beside_all) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
""",
    "op13_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS MATERIALIZED (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f FROM starts, (VALUES (1), (2), (3)) AS t(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
parts AS MATERIALIZED (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM cand, (VALUES (1), (2)) AS t(k) WHERE k < m),
lefts AS MATERIALIZED (SELECT c.*, x.f AS l FROM parts c JOIN f x ON x.lang || chr(10) || x.phrase = c.lang || chr(10) || p1),
cuts AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.m, c.a, k, l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l::HUGEINT * y.f))::BIGINT AS score
  FROM lefts c JOIN f y ON y.lang || chr(10) || y.phrase = c.lang || chr(10) || p2),
scored AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM scored s JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM cand WHERE m = 3) c ON c.lang = s.lang AND s.phrase = c.p AND 100 * c.a >= 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored s WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = s.lang AND c.phrase = s.phrase))
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN sizes z ON r.lang = z.lang WHERE rank <= 2000
""",
}
