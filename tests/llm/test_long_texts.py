"""Queries on tables with very long texts, repeated rows, nulls and columns whose names clash with those of the operators; bundles and cosines of operator 10 in plain Python."""

import base64
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestry.llm import langid
from attestry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
CLASHING = ["key", "fp", "rep", "n", "words", "text_id", "start", "n_tokens", "ids", "kept", "score", "labels", "lang_pred", "component_id", "k", "c", "v", "shard", "copies", "band", "size", "row", "part"]


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """(folder, {doc_id: text}): short texts, one of 3 MB, a copy of it with one more word, unbroken runs of 1.5 MB, one line of 200 000 blanks."""
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(5000)]
    words = r.choices(vocabulary, k=480_000)
    texts = {i: " ".join(r.choices(vocabulary, k=60)) for i in range(30)}
    texts |= {100: " ".join(words), 101: " ".join(words) + " more", 102: base64.b64encode(r.randbytes(1_100_000)).decode(), 103: "." * 1_500_000, 104: " " * 200_000, 105: None, 106: ""}
    item = "which of these questions has been asked nowhere else in this table of texts"
    texts[100] = texts[100][: len(texts[100]) // 2] + f" {item} " + texts[100][len(texts[100]) // 2 :]
    folder = str(tmp_path_factory.mktemp("long"))
    rows = [(i, t, "en" if i % 3 else None, "a" if i < 100 else None, len(t or "")) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    df.withColumns({c: F.lit("clash") for c in CLASHING}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").withColumn("bench", F.lit("b")).write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def rows_of(spark, name, folder):
    return {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}


def test_tokens(spark, long_docs):
    folder, texts = long_docs
    got, whole, start = rows_of(spark, "op1_wavelet_shards", folder), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i in sorted(texts):
        ids = [*whole.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)


def test_near_duplicates(spark, long_docs):
    folder, texts = long_docs
    got = rows_of(spark, "op3_circulant_minhash", folder)
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[i]["n_shingles"] == (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))
        assert got[i]["component_id"] == (100 if i == 101 else i)


def test_matches_in_the_middle_of_a_long_text(spark, long_docs):
    folder, _ = long_docs
    assert {r["doc_id"] for r in QUERIES["op4_pigeonhole_matches"](spark, folder).collect()} == {100}


def test_counts_of_rules_and_quality(spark, long_docs):
    folder, texts = long_docs
    licences, quality = rows_of(spark, "op7_license_rules", folder), rows_of(spark, "op9_ngram_perplexity", folder)
    assert set(licences) == set(quality) == set(texts)
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (quality[i]["n_words"], quality[i]["word_chars"]) == (len(w), sum(map(len, w)))
        assert licences[i]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) and licences[i]["n_base"] == 0


@pytest.mark.parametrize("name", ["op5_poisson_mix", "op8_surrogates", "op10_hyperdimensional_langid", "op2_token_rollup", "op12_merkle_manifest"])
def test_others_end_with_rows(spark, long_docs, name):
    folder, texts = long_docs
    found = QUERIES[name](spark, folder).collect()
    assert found and (name not in ("op10_hyperdimensional_langid", "op12_merkle_manifest") or len(found) == len(texts))


def plain_vector(text):
    """A text's vector letter by letter."""
    low = (text or "").lower()
    seen = any(ch.isalpha() for ch in low)
    s = re.sub(" +", " ", "".join(ch if ch.isalpha() or unicodedata.category(ch)[0] == "M" else " " for ch in f" {low} "))
    total = np.zeros(langid.DIMS)
    for a, b, c in zip(s, s[1:], s[2:]) if seen else ():
        x, y, z = (np.random.Generator(np.random.PCG64([ord(ch), 7919])).integers(0, 2, langid.DIMS) * 2.0 - 1 for ch in (a, b, c))
        total += np.concatenate([x[-2:], x[:-2]]) * np.concatenate([y[-1:], y[:-1]]) * z
    return total


def test_bundles_and_cosines_are_those_of_a_loop(spark):
    learn = [("the cat sat, on the mat", "en"), ("a dog!", "en"), ("le chat  noir", "fr"), ("été é", "fr"), ("", "fr"), (None, "fr"), ("x1y2", None), ("42", "zz")]
    table = spark.createDataFrame(learn, "text string, lang string")
    want = {lang: sum(plain_vector(t) for t, x in learn if x == lang) for lang in ("en", "fr")}
    got = langid.bundles(table)
    assert set(got) == set(want) and all((got[x] == want[x]).all() for x in want)
    unit = langid.prototypes(table)
    asked = ["the noir cat", "chat", "mat été", "Ünd", "7", None, " a "]
    for r in langid.predict(spark.createDataFrame([(t,) for t in asked], "text string"), unit).collect():
        v = plain_vector(r["text"])
        cos = {x: float(want[x] @ v / np.linalg.norm(want[x]) / np.linalg.norm(v)) for x in want} if v.any() else {}
        assert r["lang_pred"] == (max(sorted(cos), key=cos.get) if cos else "und") and r["score"] == pytest.approx(max(0.0, max(cos.values())) if cos else 0.0, abs=1e-9)
    tied = langid.predict(spark.createDataFrame([("chat",)], "text string"), {"b": unit["fr"], "c": unit["fr"]}).first()
    assert tied["lang_pred"] == "b"
