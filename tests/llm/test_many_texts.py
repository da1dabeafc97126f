"""Operator 9 looks at many texts together; each is judged as by itself."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import quality

#: Borders that must not leak: blanks and windows that go on in the next text, lower case by context and of other length, empty texts.
ODD = ["a b c d e", "a b c d e", "", None, " \t ", "  x", "x  ", " ", "ΑΣ", "Σ", "İİ", "é é   z", "0 12 3", "a b c d e a b c d e", "#\n#\n\n#", "\n", "b", "\U0001f600 *$%&|<>"]


def texts():
    r = random.Random(3)
    return ODD + ["".join(r.choice(["a ", "b ", "c\n", "#", "a b c a b ", "\t", "é ", "|x ", "\n", "Ж"]) for _ in range(r.randrange(40))) for _ in range(300)]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("segment", [7, 300, quality.SEGMENT])
def test_base_counts_of_many_texts(monkeypatch, segment):
    monkeypatch.setattr(quality, "SEGMENT", segment)
    got = quality.counts_in(pa.array([None, *texts()], pa.string()).slice(1))
    assert list(zip(*[c.tolist() for c in got])) == [brute(t) for t in texts()]
    assert [len(c) for c in quality.counts_in(pa.array([], pa.string()))] == [0] * 5


def test_words_of_one_hash_are_no_window_twice(monkeypatch):
    """Hashes only say which texts are counted by their words."""
    monkeypatch.setattr(quality, "_BYTES", np.ones(256, np.uint64))
    assert quality.base_counts("a b c d e f g h i j k")[4] == 0 and quality.base_counts("a b c d e a b c d e")[4] == 10


def test_grams_of_many_texts():
    found = quality.Alphabets({"en": np.array([97, 98, 32, 48, ord("σ"), ord("ς")])})
    keys, of = (np.concatenate(x) for x in zip(*found.grams_of("en", *texts())))
    for k, text in enumerate(texts()):
        assert keys[of == k].tolist() == [x for piece in found.grams("en", text) for x in piece.tolist()]


def test_a_batch_is_looked_up_together(spark, monkeypatch):
    """Some hundred short texts take a few searches of the model, not some for each text; each has its own total."""
    rows = [(k, ("en", "fr")[k % 2], t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = quality.alphabets(df.filter("doc_id % 3 > 0"))
    counts = quality.counted(df.filter("doc_id % 3 > 0"), found.grams)
    model = quality.kneser_ney(counts, spark.createDataFrame([(k, found.size(k)) for k in found.found], "lang string, v int")).cache()
    held = next(quality.model_rounds(model, found))
    own = {lang: quality.Model(*m) for (lang, *_), m in held.items()}
    asked, plain = [], quality.gram_hash
    monkeypatch.setattr(quality, "gram_hash", lambda *a: asked.append(a) or plain(*a))
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "lang": [r[1] for r in rows], "text": pa.array([r[2] for r in rows], pa.string())})
    (out,) = quality._scorer(SimpleNamespace(value=held), SimpleNamespace(value=found), True)(iter([batch]))
    assert len(asked) < 40
    for (k, lang, text), r in zip(rows, out.to_pylist()):
        pieces = list(found.grams(lang, text))
        assert r["doc_id"] == k and r["n_grams"] == sum(map(len, pieces)) and abs(r["total"] - sum(own[lang].score(p) for p in pieces)) < 1e-6
        assert tuple(r[c] for c in quality._BASE) == brute(text)
