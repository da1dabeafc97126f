"""Operators 11 to 13 against plain Python, with odd rows: nulls, empties, ties, repeats, very long texts, empty tables and columns with clashing names."""

import gzip
import hashlib
import random
import re
from collections import Counter
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from attestry.llm import merkle_manifest as M
from attestry.llm import phrases as P
from attestry.llm import warc
from attestry.llm.shared import shared_path


# 11 WARC


def written(spark, rows, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("payload", "sha256", "first", "n", "g_sha", "file")})
    path, index = shared_path(spark, "w"), shared_path(spark, "i")
    warc.write_warc(warc.plan_records(df), path, index, **how)
    return path, warc.read_index(spark, index)


def test_archives_round_trip(spark):
    big, long = "<p>" + "ü" * 600, "x" * 3_000_000
    rows = [(1, "http://a/", big), (9, "http://b/", big), (5, "http://c/\r\nX: y", big), (9, "http://d/", big), (None, None, big), (2, "u", "small"), (3, "u", "small"), (4, "u", None), (6, "u", ""), (7, "http://long/", long), (8, "v", long), (8, "v", long), (10, "head", "a\r\n\r\nb" * 300)]
    path, index = written(spark, rows, file_bytes=2000)
    got = Counter(tuple(r) for r in warc.resolved(warc.read_records(index, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    newest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            newest[h] = max(newest.get(h, -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = newest.get(h)
        old = first is not None and i != first
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", first if old else None)] += 1
    assert got == want


def test_selected_records_are_read_from_their_bytes(spark):
    rows = [(i, f"http://h{i % 3}/{i}", "z" * (1100 + i)) for i in range(60)]
    path, index = written(spark, rows)
    some = index.filter("url LIKE 'http://h1/%'")
    for gap, most in ((0, 1), (1 << 20, 1 << 20), (10, 500)):  # each alone, all at once, some together
        got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(some, path, payload=True, gap=gap, most=most).collect()}
        assert got == {i: h for i, u, h in rows if u.startswith("http://h1/")}


def test_files_are_plain_warc(spark):
    """A reader that knows only the format: members of gzip, headers, and lengths."""
    path, index = written(spark, [(1, "http://a/", "q" * 1200), (2, "http://b/", "q" * 1200)])
    folder = urlparse(path).path
    for name in {r["file"] for r in index.collect()}:
        with open(f"{folder}/{name}", "rb") as f:
            data = gzip.decompress(f.read())
        kinds = []
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and data[size : size + 4] == b"\r\n\r\n" and fields["WARC-Record-ID"].startswith("<urn:uuid:")
            kinds.append(fields["WARC-Type"])
            data = data[size + 4 :]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"}


def test_damage_is_an_error_and_no_rows_are_none(spark):
    path, index = written(spark, [(1, "http://a/", "q" * 1200)])
    with pytest.raises(Exception):
        warc.read_records(index.withColumn("at", F.col("at") + 1), path).collect()
    path, index = written(spark, [])
    assert warc.resolved(warc.read_records(index, path)).count() == 0


# 12 Merkle manifest


def tree(digests, arity):
    """Levels of a tree, from the leaves up."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][k : k + arity]).encode()).hexdigest() for k in range(0, len(levels[-1]), arity)])
    return levels


def manifest_of(rows, arity):
    """rows (source, doc_id, leaf) to {(source, doc_id, leaf): (subroot, root, proof)}, by loops."""
    by = {}
    for source, i, leaf in rows:
        by.setdefault(source, []).append((-1 if i is None else i, leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([leaf for _, leaf in sorted(by[s])], arity) for s in order}
    outer = tree([inner[s][-1][0] for s in order], arity)
    out = {}
    for k, s in enumerate(order):
        for j, (i, leaf) in enumerate(sorted(by[s])):
            proof = ""
            for levels, at in ((inner[s], j), (outer, k)):
                for level in levels[:-1]:
                    run = at // arity * arity
                    proof += "".join(d for n, d in enumerate(level[run : run + arity], run) if n != at)
                    at //= arity
            out.setdefault((s, None if i < 0 else i, leaf), []).append((inner[s][-1][0], outer[-1][0], hashlib.sha256(proof.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def h(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


@pytest.mark.parametrize("arity, sizes", [(2, (1, 2, 3, 9, 17)), (3, (27, 28, 1)), (16, (1,)), (16, (16, 17, 300)), (4, (1,) * 70), (2, (33,))])
def test_manifest_and_proofs_are_those_of_loops(spark, arity, sizes, monkeypatch):
    rows = [(None if s == 1 else f"s{s}é"[: 2 + s % 3] + str(s), i * 3, h((s, i))) for s, n in enumerate(sizes) for i in range(n)]
    rows += [(rows[0][0], rows[0][1], rows[0][2]), (rows[0][0], None, h("null"))] if len(sizes) == 3 else []  # a repeated row, and one without an id
    random.Random(1).shuffle(rows)
    want = manifest_of(rows, arity)
    df = spark.createDataFrame(rows, "src string, id long, leaf string").withColumns({c: F.lit("x") for c in ("tree", "place", "doc", "root", "extra")}).withColumnRenamed("root", "own_root")
    for nodes in (M.NODES, 0):  # rounds with and without a broadcast
        monkeypatch.setattr(M, "NODES", nodes)
        got = {}
        proofs = M.proofs(M.build_manifest(df.withColumn("s2", F.col("src")), "src", "id", arity))
        for r in proofs.withColumn("proof", M.proof_digest(F.col("steps"))).withColumn("folded", M.fold(F.col("leaf"), F.col("steps"))).collect():
            got.setdefault((r["s2"], r["id"], r["leaf"]), []).append((r["subroot"], r["root"], r["proof"]))
            assert r["folded"] == r["root"] and r["extra"] == "x"
        assert {k: sorted(v) for k, v in got.items()} == want


def test_leaves_of_any_values(spark):
    long = "é" * 2_000_000
    df = spark.createDataFrame([(1, None, long), (None, "a:b", ""), (7, "-", None)], "i long, s string, t string")
    got = [r[0] for r in df.select(M.leaf_digest(F.col("i"), F.col("s"), F.col("t"))).collect()]
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert got == [h("".join(map(part, r))) for r in ((1, None, long), (None, "a:b", ""), (7, "-", None))]


def test_no_leaves_have_no_root(spark):
    none = M.build_manifest(spark.createDataFrame([], "s string, i long, leaf string"), "s", "i")
    assert none.root is None and M.proofs(none).count() == 0


def test_query_of_the_manifest_on_no_documents(spark, tmp_path):
    from attestry.llm.queries import QUERIES

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("op11_warc_index", "op12_merkle_manifest", "op13_phrase_collocations"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0


# 13 phrases


def collocated(rows, least, percent, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in (1, 2, 3):
                    if i + m <= len(w):
                        f[lang, tuple(w[i : i + m])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [f[lang, q] for q in ((x, *p) for x in {w[0] for g, w in f if g == lang and len(w) == 1}) if f.get((lang, q), 0) >= least] if len(p) == 2 else []
        longer += [f[lang, q] for q in ((*p, x) for x in {w[0] for g, w in f if g == lang and len(w) == 1}) if f.get((lang, q), 0) >= least] if len(p) == 2 else []
        if not any(100 * b >= percent * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r): (p.decode(), -a, left, right, n[lang], -s) for lang, ps in out.items() for r, (s, a, p, left, right) in enumerate(sorted(ps)[:first], 1)}


def texts_of(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "ÉTÉ", "été", "naïve", "a", "b", "x-y", "日本", "zz z", " ", "c", "d"]
    weights = [9, 4, 8, 1, 2, 1, 5, 5, 1, 2, 1, 1, 3, 3]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "! ?", "\r\n", ";", "\x0b"]
    rows = [(r.choice(["en", "fr", None, "und"]), "".join(w + r.choice(gaps) for w in r.choices(words, weights, k=r.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, " . ,"), ("fr", "new york city. " * 40), ("fr", "new york city. " * 40), ("xx", "only words here"), ("en", "the of " * 3000)]


@pytest.mark.parametrize("suffixes, size", [(P.SUFFIXES, P.CHUNK), (40, 100), (7, 13)])
def test_phrases_are_those_of_loops(spark, suffixes, size):
    """With groups of a few suffixes, prefixes of two words are beyond the budget too; with chunks of a few words, texts go on in the next."""
    rows = texts_of(3, 120)
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("phrase", "words", "n", "grp", "w1", "rank", "score")})
    got = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in P.collocations(df, least=5, first=30, suffixes=suffixes, size=size).collect()}
    want = collocated(rows, 5, 50, 30)
    assert got == want and any(p.count(" ") == 2 for p, *_ in want.values())


def test_long_texts_are_cut_between_words():
    text = ("Word, " * 400_000 + "x" * 3_000_000 + " end").encode()
    assert [w for some in P.tokens(b"Ab c.d e", 1) for w in some] == [b"ab", b"c", b"\xff", b"d", b"e"]
    parts = list(P.tokens(text))
    flat = [w for p in parts for w in p]
    assert len(parts) > 2 and flat == text.lower().replace(b",", b" \xff ").split() and max(map(len, parts)) < 1_000_000


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("l", "a", 1, 3 * 10**13), ("l", "b", 1, 10**13 + 7), ("l", "a b", 2, 10**13 - 1)], "lang string, phrase string, words int, n long")
    a, left, right = 10**13 - 1, 3 * 10**13, 10**13 + 7
    assert [r["score"] for r in P.cut_scores(counts).collect()] == [1_000_000 * a * a // (left * right)]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_chunks_in_the_middle_of_a_text_lose_no_suffix(size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "tokens", lambda text, whole=P.tokens: whole(text, 4))
    rows = [(b"a", b"one two three. four five six seven eight"), (b"b", b"x y x y x y z"), (b"a", b""), (b"a", b"one two three four")]
    batch = pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.binary()), "text": pa.array([r[1] for r in rows], pa.binary())})
    got, want = Counter(), Counter()
    for lang, words, ids, starts in P._chunks([batch], size):
        for at in range(starts):
            if ids[at]:
                got[lang, tuple(words[k - 1] if k else b"" for k in ids[at : at + 3])] += 1
    for lang, text in rows:
        w = text.replace(b".", b" . ").split()
        for at in range(len(w)):
            if w[at] != b".":
                want[lang, tuple((*(b"" if x == b"." else x for x in w[at : at + 3]), b"", b"")[:3])] += 1
    fold = lambda c: sum((Counter({(lang, (t[0], t[1], t[2] if t[1] else b"")): n}) for (lang, t), n in c.items()), Counter())
    assert fold(got) == fold(want)
