"""The queries of the contract, held against plain Python and DuckDB on the smallest tables."""

import os
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestry.llm.queries import ORACLES, QUERIES
from tests.test_oracles import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert mine == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())


def test_op1(spark, docs):
    import numpy as np

    lib, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in QUERIES["op1_wavelet_shards"](spark, SF).collect()}
    for i, text, _ in docs:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op2(spark, duck):
    """Counted anew in plain Python; the version that SQL can express is held against SQL as well."""
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counters = {
        "ws@1": lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)), "alnum@2": lambda t: len(re.findall(r"[0-9A-Za-z]+|[^\x00-\x7F]+", t)),
        "byte_bpe_50k@1": lambda t: len(lib.encode(t, add_special_tokens=False).ids),
    }
    low = {i for i, in duck.execute("SELECT doc_id FROM labels WHERE quality = 0").fetchall()}
    gone = {i for i, in duck.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    want: dict = {}
    for i, text, source, lang in duck.execute("SELECT doc_id, text, source, lang FROM documents").fetchall():
        text = "\n".join(dict.fromkeys((text or "").split("\n"))) if i in low else text or ""
        for name, count in counters.items() if i not in gone else ():
            d, n = want.get((source, lang, name), (0, 0))
            want[source, lang, name] = (d + 1, n + count(text))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in QUERIES["op2_token_rollup"](spark, SF).collect()}
    assert got == want


def test_op3(spark, docs):
    sets = {}
    for i, text, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    to = {i: i for i in sets}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                to[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op3_circulant_minhash"](spark, SF).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_op4(spark, duck, docs):
    norm = lambda t: " ".join((t or "").lower().split())
    items = [(i, norm(t)) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    whole = {(d, i) for d, t, _ in docs for i, s in items if s in norm(t)}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in QUERIES["op4_pigeonhole_matches"](spark, SF).collect()}
    assert whole and {k for k, d in got.items() if d == 0} == whole


def test_op7(spark, docs):
    phrases = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
    got = {r["doc_id"]: r for r in QUERIES["op7_license_rules"](spark, SF).collect()}
    for i, text, _ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        at = sorted((k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        labels = ",".join(sorted({x for _, x in at}))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, labels)
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op8(spark, docs):
    """Patterns of this test's own: what they find is gone, equal finds became equal, and unlike finds unlike."""
    got = {r["doc_id"]: r for r in QUERIES["op8_surrogates"](spark, SF).collect()}
    simple = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+\.[A-Za-z0-9.]*[A-Za-z0-9]|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", re.ASCII)
    seen = {}
    for i, text, _ in docs:
        old, new = simple.findall(text or ""), simple.findall(got[i]["text"] or "")
        assert len(old) == len(new) and not set(old) & set(new) and got[i]["n_entities"] == len(got[i]["kinds"] or []) >= len(old)
        for a, b in zip(old, new):
            assert seen.setdefault(a.lower(), b.lower()) == b.lower()
        assert got[i]["n_entities"] or got[i]["text"] == text
    assert seen and len(set(seen.values())) == len(seen)


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op9_ngram_perplexity"](spark, SF).collect()}
    for i, text, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_op10_on_held_out_documents(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op10_hyperdimensional_langid"](spark, SF).collect()}
    held = [(i, lang) for i, _, lang in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, _ in held}
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)


def test_pipeline(spark, docs):
    """Each stage on its own input, against plain rules."""
    import corpus_pipeline as p
    from attestry.llm.decontaminate import normal

    stages, rows = dict(p.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_ids"]
    kept = stages["language_id"](spark, rows, SF)
    assert kept.columns == rows.columns and kept.count() >= 0.98 * len(docs)
    once = stages["near_dedup"](spark, kept, SF)
    ids = [r["doc_id"] for r in once.select("doc_id").collect()]
    assert once.columns == rows.columns and len(ids) == len(set(ids)) < kept.count()
    clean = stages["decontamination"](spark, once, SF)
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: normal(r["text"]) for r in once.collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in texts.items() if not any(x in t for x in items)}
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == rows.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    out = stages["token_ids"](spark, mixed, SF)
    assert out.count() == mixed.count()
    assert p.run(spark, SF).count() == out.count()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, empty and blank texts, repeated rows, a clashing column, and no rows at all. Each stage ends with what its docstring says."""
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    plain_text = "the cat and the other cat sat near the old house of the man who had been there before the rain came and the wind rose over the hills"
    rows = [(i, f"{plain_text} {'one two three four five six seven'.split()[i % 7]} {i}", "en", "a", 1, 0.5) for i in range(40)]
    rows += [rows[3], (None, plain_text, None, None, None, None), (50, None, "en", "a", None, None), (51, "", "en", None, 0, None), (52, " \n", None, "b", 0, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    item = "a benchmark question that no other text holds in any of its many parts"
    docs = docs.union(spark.createDataFrame([(60, plain_text + " " + item, "en", "a", 9, 1.0)], schema))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, sf = dict(p.STAGES), str(tmp_path)
    known = stages["language_id"](spark, docs, sf)
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == {*range(40), None, 60}
    once = stages["near_dedup"](spark, docs, sf)
    ids = [r["doc_id"] for r in once.collect()]
    assert once.columns == docs.columns and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and {50, 51, 52} <= set(ids) and ids.count(None) == 2
    clean = stages["decontamination"](spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1 and clean.filter("doc_id = 60").count() == 0
    mixed = stages["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r[0] for r in rows} | {60}
    out = stages["token_ids"](spark, docs, sf)
    assert out.count() == docs.count() and out.filter("n_tokens = 1").count() == 3
    none = docs.limit(0)
    for name, stage in stages.items():
        got = stage(spark, none, sf)
        assert got.count() == 0 and (name == "token_ids" or got.columns == docs.columns)
    assert none.select(F.col("text")).count() == 0
