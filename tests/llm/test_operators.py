"""The ten operators against plain Python, on rows that hold every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestry.llm import bpe, decontaminate, langid, licenses, minhash, mixing, quality, surrogates, token_ledger, token_shards, url_filter, wavelet
from attestry.llm.bpe import Bpe
from attestry.llm.shared import shared_path
from attestry.llm.wavelet import Shard, pack

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "sa", "te", "vo") for b in ("r", "n", "st", "la", "ck", "dre")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + "x" if r.random() < share else w for w in text.split())


def corpus() -> list[tuple]:
    base, long = prose(1, 300), prose(2, 20_000)
    rows = [(i, edited(base, i, i / 400), "en", "a", 1) for i in range(12)]
    rows += [(20, base, "en", "a", 1), (21, base.upper(), "en", "a", 1), (22, base.replace(" ", "\n "), "de", "b", 1)]
    rows += [(30, None, None, None, None), (31, "", "en", "b", 0), (32, " \t\n", "en", "b", 0), (33, "one two", "en", "b", 0), (34, "two one", "en", "b", 0), (35, "ONE  two", "fr", "b", 0)]
    rows += [(40, long, "en", "c", 9), (41, long + " tail of it", "en", "c", 9), (42, "Ünïcödé ß 漢字 🙂\u2028 x\x00y 'll don't", "de", "c", 9), (43, "12 !! ??", "de", None, 9)]
    rows += [(50 + i, prose(100 + i, 40), "en", "a", 1) for i in range(6)]
    return [*rows, rows[3], (None, "no id here at all ok", "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 token shards


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("'’ strevmld \n\tA9é²<|>_"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_are_the_librarys(text):
    assert ENCODER.encode(text).tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


ENCODER = Bpe(BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'’ strevmld \n\tA9é²<|>_"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6), st.sampled_from([3, 20, 1 << 20]))
def test_texts_encoded_together_are_encoded_alone(texts, segment):
    old, bpe.SEGMENT = bpe.SEGMENT, segment
    try:
        assert [x.tolist() for x in ENCODER.encode_all(texts)] == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        bpe.SEGMENT = old


def test_another_vocabulary_file_goes_through_the_library():
    other = Bpe(public_tokenizers.path("word_bpe_49k.json"))
    assert ENCODER.byte_level and not other.byte_level
    for text in ("Don't  STOP <|endoftext|> now", "", "漢字 x\n\ny"):
        assert other.encode(text).tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70000), max_size=40), max_size=8), st.sampled_from([8, 64, 1 << 15]))
def test_wavelet_shard_answers_like_a_list(docs, block):
    wavelet.BLOCK = block
    ids = [np.array(d, np.uint32) for d in docs]
    flat = [x for d in docs for x in d]
    shard = Shard(pack([None if k == 1 else k for k in range(len(docs))], ids, 2))
    assert shard.decode().tolist() == flat and len(shard) == len(flat)
    assert shard.doc_ends.tolist() == np.cumsum([len(d) for d in docs]).astype(int).tolist() if docs else True
    assert shard.doc_ids == [None if k == 1 else k for k in range(len(docs))]
    at = np.arange(len(flat))[::2]
    assert shard.access(at).tolist() == flat[::2]
    for token in {*flat[:5], 3, 99_999}:
        assert shard.count(token) == flat.count(token)
        assert shard.occurrences(token).tolist() == [i for i, x in enumerate(flat) if x == token]
        assert shard.count(token, 1, max(1, len(flat) - 1)) == flat[1 : max(1, len(flat) - 1)].count(token)


def test_shards_round_trip(spark, docs, empty):
    path = shared_path(spark, "t")
    token_shards.write_shards(docs, path, BPE, shard_tokens=500)
    got = token_shards.read_documents(spark, path, ids=True).orderBy("start").collect()
    lib = Tokenizer.from_file(BPE)
    want = {}
    for i, text, *_ in corpus():
        want.setdefault(i, []).append(lib.encode(text or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in got:
        assert r["start"] == at and list(r["ids"]) in want[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert len(got) == len(corpus()) and ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    flat = Counter(x for r in got for x in r["ids"])
    assert {r["token"]: r["n"] for r in token_shards.token_counts(spark, path, [2, 11, 60000]).collect()} == {2: flat[2], 11: flat[11], 60000: 0}
    assert token_shards.token_occurrences(spark, path, 2).count() == len(got)
    assert all(r["n_end_ids"] == list(r["ids"]).count(2) for r in got)
    odd = docs.withColumns({"part": F.lit("x"), "ids": F.lit(1), "start": F.lit(1), "file": F.lit(1)})
    other = shared_path(spark, "t")
    token_shards.write_shards(odd, other, BPE)
    assert [r["ids_crc32"] for r in token_shards.read_documents(spark, other).orderBy("start").collect()] == [r["ids_crc32"] for r in got]
    none = shared_path(spark, "t")
    token_shards.write_shards(empty, none, BPE)
    assert token_shards.read_documents(spark, none).count() == 0


# 2 token ledger


def test_ledger_follows_changes(spark):
    ledger = token_ledger.TokenLedger(spark, shared_path(spark, "ledger"))
    change = lambda rows: spark.createDataFrame(rows, "doc_id long, op string, source string, lang string, tokenizer string, n_tokens long, seq int")
    live: dict = {}
    r, batches = random.Random(5), []
    for b in range(4):
        rows = [(r.randrange(12), r.choice(["insert", "delete", "revise", "other"]), r.choice(["a", "b", None]), "en", r.choice(["v1", "v2"]), r.randrange(50), k) for k in range(25)]
        batches.append([*rows, (None, "insert", "a", "en", "v1", 5, 99), (3, "insert", "a", "en", None, 5, 99)])
        for d, op, s, lang, tok, n, _ in rows:
            if op == "delete":
                live.pop((d, tok), None)
            elif op != "other":
                live[d, tok] = (s, lang, n)
        assert ledger.commit(f"b{b}", change(batches[-1]), "seq")
        assert not ledger.commit(f"b{b}", change(batches[-1]), "seq")
        want = Counter()
        for (_, tok), (s, lang, n) in live.items():
            want[s, lang, tok, "docs"] += 1
            want[s, lang, tok, "tokens"] += n
        got = {(x["source"], x["lang"], x["tokenizer"]): (x["docs"], x["tokens"]) for x in ledger.totals().collect()}
        assert got == {k[:3]: (want[*k[:3], "docs"], want[*k[:3], "tokens"]) for k in want}
    assert ledger.commit("empty", change([]))
    before = {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{ledger.path}/commits/{ledger._commits()[-1]}").collect()}
    assert ledger.commit("one", change([(3, "insert", "a", "en", "v1", 7, 1)]))
    after = {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{ledger.path}/commits/{ledger._commits()[-1]}").collect()}
    assert sum(before.get(b) != f for b, f in after.items()) == 1  # no other bucket is written


def test_counters(spark, docs):
    rows = docs.select("text", token_ledger.word_tokens(F.col("text")).alias("w"), token_ledger.bpe_tokens(BPE)("text").alias("b")).collect()
    lib = Tokenizer.from_file(BPE)
    for r in rows:
        assert r["w"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["b"] == len(lib.encode(r["text"] or "", add_special_tokens=False).ids)


# 3 near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent", [50, 70, 80, 85])
def test_components_are_brute_force(spark, docs, percent):
    rows = [r for r in corpus() if r[0] is not None]
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    to = {i: i for i in sets}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                to[y] = x
    got = minhash.near_duplicates(docs, percent).collect()
    assert len(got) == len(corpus())
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i)
    kept = [r["doc_id"] for r in minhash.deduplicated(docs, percent).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({find(i) for i in sets}) and kept.count(None) == 2


@pytest.mark.parametrize("percent", [1, 30, 50, 70, 80, 85, 99, 100])
def test_a_pair_at_the_threshold_is_hardly_missed(percent):
    rows, bands = minhash.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS and 1 <= rows <= minhash.ROWS


def test_parities_never_rule_out_a_link(spark):
    """Sets of many sizes, similarities around the threshold: what the expression refuses is no link."""
    r, sets = random.Random(4), []
    for n in (1, 5, 60, 64, 65, 130, 500):
        base = [r.getrandbits(64) for _ in range(n)]
        for share in (0, 0.02, 0.05, 0.08, 0.1, 0.2):
            sets.append(np.unique(np.array([x for x in base if r.random() >= share] + [r.getrandbits(64) for _ in range(int(share * n))] or base, np.uint64)))
    rows = [(i, len(s), np.bitwise_xor.reduce((odd := minhash.parities(s)).reshape(-1, minhash.HEAD // 64)).tolist(), odd.tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, n long, head array<long>, odd array<long>")
    x, y = (df.select(F.col("id").alias(f"{c}_id"), F.struct("n", "head", "odd").alias(c)) for c in "xy")
    got = x.crossJoin(y).select("x_id", "y_id", minhash._may_link("x", "y", 85).alias("may")).collect()
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(both := np.intersect1d(a, b)) >= 85 * (len(a) + len(b) - len(both))}
    may = {(g["x_id"], g["y_id"]) for g in got if g["may"]}
    assert linked <= may and len(may) < 2 * len(linked) < len(got)


def test_a_group_of_near_copies_that_hardly_link(spark):
    base = prose(77, 200)
    texts = [edited(base, i, 0.012 + 0.0001 * (i % 60)) for i in range(150)]
    sets = [shingle_set(t) for t in texts]
    to = list(range(150))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a in range(150):
        for b in range(a + 1, 150):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                to[y] = x
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component int"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(150)} and 3 < len({find(i) for i in range(150)}) < 147


def test_clashing_columns_stay(spark, docs):
    """Every operator that returns its input's columns keeps those with names of its own making, and the others don't read them."""
    names = ("own_id", "is_kept", "own_rows", "id", "rep", "component", "key", "learn", "pred", "score", "class", "own", "least", "lang_pred", "spans", "n_words", "perplexity", "k", "c", "d", "t", "total", "draws")
    odd = docs.withColumns({n: F.lit(7) for n in names})
    assert sorted(map(str, minhash.deduplicated(odd, 80).select(*docs.columns).collect())) == sorted(map(str, minhash.deduplicated(docs, 80).collect()))
    assert minhash.deduplicated(odd, 80).columns == odd.columns
    known = langid.known(odd, F.lit(True))
    assert known.columns == odd.columns and {r["class"] for r in known.collect()} == {7}
    found = langid.identify(odd, F.lit(True))
    assert found.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"] and found.first()["own"] == 7
    bench = spark.createDataFrame([(1, prose(103, 40))], "item_id long, text string")
    assert decontaminate.decontaminated(odd, bench).columns == odd.columns
    assert decontaminate.contamination(odd, bench.withColumn("d", F.lit(1))).count() == decontaminate.contamination(docs, bench).count()
    assert sorted(map(str, licenses.scan_licenses(odd).collect())) == sorted(map(str, licenses.scan_licenses(docs).collect()))
    assert sorted(map(str, quality.judge_quality(odd).collect())) == sorted(map(str, quality.judge_quality(docs).collect()))
    replaced = surrogates.replace_pii(odd, b"k")
    assert replaced.columns == [*odd.columns, "pii"] and {r["draws"] for r in replaced.collect()} == {7}
    assert token_ledger.counted(odd, "insert").count() == 2 * len(corpus()) == token_ledger.deleted(odd).count()


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicated(empty).columns == empty.columns


def test_chains_and_stars_are_one_component(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 800)} == {500}


# 4 decontamination


def distance(p: str, t: str) -> int:
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abcd", max_size=30), st.integers(0, 12))
def test_myers_is_the_edit_distance(p, t, k):
    masks: dict = {}
    for i, c in enumerate(p):
        masks[c] = masks.get(c, 0) | 1 << i
    d, got = distance(p, t), decontaminate.myers(masks, len(p), t, k)
    assert (got[0] if got else None) == (d if d <= k and d < len(p) or d <= k and t else None)


def test_matches_are_brute_force(spark, docs, empty):
    items = [(1, prose(2, 20_000)[500:700]), (2, prose(103, 40)), (3, "short"), (4, None), (5, "a passage that stands nowhere at all, not even in part of it"), (6, prose(103, 40))]
    r = random.Random(3)
    noisy = list(prose(2, 20_000)[2000:2200])
    for _ in range(8):
        noisy[r.randrange(200)] = "#"
    items.append((7, "".join(noisy)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["distance"]) for x in decontaminate.contamination(docs, bench).collect()}
    want = set()
    for i, text, *_ in corpus():
        t = decontaminate.normal(text)
        for k, item in items:
            s = decontaminate.normal(item)
            if decontaminate.budget(s) and t:
                d = distance(s, t) if len(t) < 5000 else min(distance(s, t[a : a + 3000]) for a in range(0, 4000, 2000))
                if d <= decontaminate.budget(s):
                    want.add((i, k, d))
    assert got == want and {k for _, k, _ in got} == {1, 2, 6, 7}
    left = {r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()}
    assert left == {r[0] for r in corpus()} - {d for d, *_ in got}
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0


# 5 mixing


def test_copies_follow_the_inverted_poisson(spark, docs, empty):
    odd = docs.withColumns({c: F.lit(7) for c in ("mix_copy", "mix_key", "mix_u", "mix_n", "mix_source", "mix_parts", "mix_table", "mix_rows")})
    weights = {"a": 1.0, "b": 5.0, None: 2.0}
    rates = {r["mix_source"]: r["mix_rate"] for r in mixing.source_rates(docs, weights, epochs=100.0).collect()}
    assert rates["c"] == 0 and max(rates.values()) > mixing.PART
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(odd, weights, epochs=100.0).collect())

    def draw(key, rate):
        m = max(1, int(np.ceil(rate / mixing.PART)))
        total = 0
        for j in range(1, m + 1):
            u = int(hashlib.md5(f"42:{key}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = np.exp(-rate / m)
            k = 0
            while u >= c and k < 400:
                k += 1
                p *= rate / m / k
                c += p
            total += k
        return total

    want = Counter()
    for i, text, _, source, _ in corpus():
        key = str(i) if i is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
        want[i, text] += draw(key, rates[source]) if rates[source] else 0
    assert got == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(empty).count() == 0
    assert all(r["mix_key"] == r["mix_table"] == r["mix_source"] == 7 for r in mixing.mix(odd).collect())
    again = mixing.mix(odd.repartition(7), weights, epochs=100.0)
    assert Counter((r["doc_id"], r["text"]) for r in again.collect()) == got


# 6 URL rules


def test_urls(spark):
    rules = spark.createDataFrame([("COM", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("x.org", "/a", "block"), ("x.org", "/a", "allow"), (None, "/", "block"), ("y.org", "", "block"), ("z.org", None, "block")], "host string, path string, verdict string")
    cases = {
        "http://a.b.Example.com/en/1?q": ("example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com/en/", "allow"), "https://m.www.example.com/en/x#f": ("www.example.com/en/", "allow"),
        "http://example.com": (None, "allow"), "http://example.com/en": ("com/", "allow"), "http://xexample.com/en/": ("com/", "allow"), "http://x.org/abc": ("x.org/a", "block"), "http://y.org": ("y.org", "block"), "http://z.org?x": ("z.org", "block"),
        "no url": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "x://": (None, "allow"), "a://b://c.com/": (None, "allow"), "http://" + "l." * 3000 + "com/" + "p/" * 3000: ("com/", "allow"),
    }
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(cases)] + [(0, next(iter(cases)), "old")], "page_id long, url string, rule string")
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == len(cases) + 1
    urls = list(cases)
    for r in got:
        assert (r["rule"], r["verdict"]) == cases[urls[r["page_id"]]], urls[r["page_id"]]
    assert url_filter.judge_urls(pages, rules.limit(0), default="block").filter("verdict = 'block' AND rule IS NULL").count() == len(got)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    odd = pages.select("page_id", "url", *[F.lit(k).alias(c) for k, c in enumerate(("best", "b_host", "b_path", "b_rows", "b_best", "verdict", "prefix", "r_rule"))])
    named = url_filter.judge_urls(odd, rules).collect()
    assert all((r["rule"], r["verdict"]) == cases[urls[r["page_id"]]] and (r["best"], r["b_host"], r["b_best"], r["r_rule"]) == (0, 1, 4, 7) for r in named)


def test_hot_keys_are_broadcast_and_others_shuffled(spark, monkeypatch):
    from attestry.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(4000)] + [(None, 9), (99, 10)], "k int, v int")
    right = spark.createDataFrame([(k, 10 * k, 1 + (5000 if k == 0 else k)) for k in range(7)], "r int, w int, n long")
    for how in ("inner", "left"):
        got = shared.join_split(left, right, F.col("k").eqNullSafe(F.col("r")), "n", how).select("k", "v", "w").collect()
        want = left.join(right, F.col("k").eqNullSafe(F.col("r")), how).select("k", "v", "w").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


# 7 licences


def test_licences(spark, docs, empty):
    texts = ["Under the MIT-License, under the mit license.", "under the mit license under the mit license", "Apache License, Version 2.0 and CC BY-NC 4.0", "GNU GPL v3 or later", None, "", "SPDX-License-Identifier: BSD-3-Clause", "éunder the mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    places = {i: [s["start_word"] for s in r["spans"] if s["phrase"]] for i, r in got.items()}
    assert places == {0: [0, 4], 1: [0, 4], 2: [0, 6], 3: [], 4: [], 5: [], 6: [], 7: []}
    labels = {i: {s["label"] for s in r["spans"]} for i, r in got.items()}
    assert labels[2] == {"apache-2", "cc-by-nc"} and labels[3] == {"gpl-3"} and labels[6] == {"bsd-3-clause"} and got[7]["n_words"] == 4 and got[4]["n_words"] == 0
    assert licenses.scan_licenses(empty).count() == 0 and len(licenses.rules()) > 200
    assert licenses.scan_licenses(docs).filter("size(spans) > 0").count() == 0


def test_suppression_is_brute_force():
    vocab = "spdx license identifier mit apache 2 0 gnu general public version 3 or later licensed under the bsd clause cc by nc 4 lesser only".split()
    r = random.Random(1)
    for _ in range(200):
        norm = " ".join(r.choice(vocab) for _ in range(r.randrange(60)))
        hits = [(n, m.start(), m.end()) for n, (_, _, pattern, _, _) in enumerate(licenses.rules()) for m in pattern.finditer(norm)]
        rank = lambda h: (-licenses.rules()[h[0]][3], h[1] - h[2], h[0], h[1])
        left = [h for h in hits if not any(o[1] <= h[1] and h[2] <= o[2] and rank(o) < rank(h) for o in hits)]
        assert licenses.detections(norm) == sorted((a, b, licenses.rules()[n][0], licenses.rules()[n][4]) for n, a, b in left)
    long = " ".join(["licensed under the gnu general public license version 3"] * 20_000)
    assert len(licenses.detections(long)) == 20_000


def test_every_rule_has_its_keyword():
    sample = {"license mit": "license mit", "spdx": "spdx license identifier mit"}
    for keyword, text in sample.items():
        assert keyword in text and licenses.detections(text)
    spans = licenses.detections("licensed under the gnu general public license version 3")
    assert len(spans) == 1 and spans[0][2] == "gpl-3"


# 8 surrogates


def test_surrogates(spark, empty):
    texts = [
        "Write to Ana.Lee@Mail.example.com or ana.lee@mail.example.com, +1 (771) 555-1655; card 4111 1111 1111 1111 at 10.0.0.7.", 'token = "e03422dad6b454724135a384f69ba12c7de6c8f4" and 17715551655x 7713332104704538',
        "Mrs. Maria Lopez met Herr Schmidt; later Herr Lopez came.", "Herr Иванов", None, "", "nothing 1.2.3 here 12", "call +1 (771) 555-1655 again"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(0, texts[0], "old")], "doc_id long, text string, pii string")
    got = surrogates.replace_pii(df, b"secret").collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    for r in got:
        old = texts[r["doc_id"]]
        found = surrogates.entities(old)
        assert len(r["pii"] or []) == len(found)
        for (a, b, kind, _), s in zip(found, r["pii"] or []):
            new = r["text"][s["start"] : s["end"]]
            assert new != old[a:b] and old[a:b] not in r["text"] and s["kind"] == kind
            if kind in ("phone", "card", "token"):
                assert [c.isdigit() for c in new] == [c.isdigit() for c in old[a:b]] or kind == "token"
                assert len(new) == len(old[a:b])
    first = by[0]["text"]
    mails = re.findall(r"[\w.]+@[\w.]+\w", first)
    assert len(mails) == 2 and mails[0].lower() == mails[1] and mails[0] != mails[1] and mails[1].endswith(".com")
    assert by[0]["text"][by[0]["pii"][2]["start"] : by[0]["pii"][2]["end"]] in by[7]["text"]
    cards = [surrogates._luhn("".join(c for c in by[0]["text"][s["start"] : s["end"]] if c.isdigit())) for s in by[0]["pii"] if s["kind"] == "card"]
    assert cards == [0]
    assert by[2]["text"].startswith("Mrs. ") and by[2]["text"].count(by[2]["text"].split()[2]) == 2  # one surname, two places
    assert re.search("[а-я]", by[3]["text"].split()[1].lower()) and by[4]["text"] is None and by[4]["pii"] is None and by[6]["text"] == texts[6]
    assert surrogates.replace_pii(empty, b"k").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations_reach_all_and_fix_none(n):
    out = [surrogates.permuted(x, n, b"k", "a") for x in range(n)]
    assert sorted(out) == list(range(n)) and (n == 1 or all(a != b for a, b in enumerate(out)))


def test_formats_stay_valid(spark):
    """A corpus that uses a whole private network, and codes whose checksums and prefixes are known."""
    ips = [f"192.168.{a}.{b}" for a in range(256) for b in range(0, 256, 16)]
    codes = {"DE89 3704 0044 0532 0130 00": "iban", "GB82 WEST 1234 5698 7654 32": "iban", "+49 30 123456": "phone", "+44 20 7946 0958": "phone", "+351 21 123 4567": "phone", "(771) 555-1655": "phone"}
    long = "x " * 200_000 + "mail a@b.com"
    rows = [(i, t) for i, t in enumerate([*ips, *codes, "Dr. Mueller and Alice Cooper met. Cooper left; Mueller stayed.", long])]
    got = [r["text"] for r in surrogates.replace_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumn("draws", F.lit(1)), b"k").orderBy("doc_id").collect()]
    assert len(set(got[: len(ips)])) == len(ips) and all(g.startswith("192.168.") and g != o for g, o in zip(got, ips))
    for old, new in zip(codes, got[len(ips) :]):
        assert old != new and [c if c in "+() -" else "d" if c.isdigit() else "l" for c in old] == [c if c in "+() -" else "d" if c.isdigit() else "l" for c in new]
        if codes[old] == "iban":
            flat = new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 and flat[:2] == old[:2]
        elif old[0] == "+":
            assert new.split()[0] == old.split()[0]
    words = re.findall(r"\w+", got[-2])
    assert words[0] == "Dr" and words[1] == words[8] and words[4] == words[6]
    assert "Cooper" not in got[-2] and "Mueller" not in got[-2] and "Alice" not in got[-2]
    assert got[-1][:400_000] == long[:400_000] and got[-1] != long


def test_surrogates_stay_distinct(spark, monkeypatch):
    few = [(i, f"Herr {chr(65 + i % 26)}{'abcdefghij'[i // 26]}xx.") for i in range(120)]
    plain = surrogates.surrogate
    monkeypatch.setattr(surrogates, "surrogate", plain)
    names = {surrogates.entities(t)[0][3] for _, t in few}
    out = surrogates.replace_pii(spark.createDataFrame(few, "doc_id long, text string"), b"k").collect()
    new = {r["doc_id"]: r["text"] for r in out}
    assert len(set(new.values())) == len(names) and not names & {t[5:-1].lower() for t in new.values()}
    ssn = [(i, f"{100 + i:03d}-{i % 90 + 10:02d}-{1000 + i:04d}") for i in range(300)]
    assert len({r["text"] for r in surrogates.replace_pii(spark.createDataFrame(ssn, "doc_id long, text string"), b"k").collect()}) == 300


# 9 quality


def test_base_counts_are_brute_force():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "c\n", "#", "a b c a b ", "\t", "é ", "|x ", "\n"]) for _ in range(r.randrange(40)))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert quality.base_counts(text) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked))


def test_kneser_ney_is_the_formula(spark):
    text = prose(4, 400)
    found = quality.Alphabets({"en": np.array(sorted({ord(c) for c in text[:300]}), np.int64)})
    keys = np.concatenate(list(found.grams("en", text)))
    counts, size, bits = Counter(keys.tolist()), found.size("en"), quality.BITS
    df = spark.createDataFrame([("en", k, c) for k, c in counts.items()], "lang string, k long, c long")
    table = quality.kneser_ney(df, spark.createDataFrame([("en", size)], "lang string, v int")).cache()
    model = quality.Model(*next(iter(next(quality.model_rounds(table, found)).values())))
    levels = {5: counts}
    for n in (4, 3, 2, 1):
        levels[n] = Counter(k & quality.mask(n) for k in levels[n + 1])
    disc = {}
    for n, c in levels.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + m[2] else 0.5
        disc[n] = [min(max(j - (j + 1) * y * m[j + 1] / m[j] if m[j] else 0.5 * j, 0.1), j - 0.1) for j in (1, 2, 3)]

    def p(n, k):
        if n == 0:
            return 1 / size
        h = k >> bits
        total = sum(c for g, c in levels[n].items() if g >> bits == h)
        if not total:
            return p(n - 1, k & quality.mask(n - 1))
        d = lambda c: disc[n][min(c, 3) - 1]
        gamma = sum(d(c) for g, c in levels[n].items() if g >> bits == h) / total
        c = levels[n].get(k, 0)
        return (c - d(c) if c else 0) / total + gamma * p(n - 1, k & quality.mask(n - 1))

    ask = [*list(counts)[:15], *(k ^ 5 for k in list(counts)[:15]), (63 << 2 * bits) | (62 << bits) | 1]
    for k in ask:
        assert abs(model.score(np.array([k])) - np.log(p(5, k))) < 1e-4
    assert abs(sum(p(5, (list(counts)[3] >> bits) << bits | s) for s in range(1, size + 1)) - 1) < 1e-9


def test_parts_of_a_model_score_as_the_whole(spark, monkeypatch):
    text = prose(4, 400)
    rows = spark.createDataFrame([("en", text), ("fr", text.upper() + "éè")], "lang string, text string")
    found = quality.alphabets(rows, most=20)
    assert found.found["en"].tolist() == [ord(c) for c, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0]))][:20]
    table = quality.kneser_ney(quality.counted(rows, found.grams), spark.createDataFrame([(k, found.size(k)) for k in found.found], "lang string, v int")).cache()
    asked = {lang: np.concatenate(list(found.grams(lang, prose(5, 200) + " Zürich 12"))) for lang in ("en", "fr")}
    whole = {lang: quality.Model(*m).score(asked[lang]) for r in quality.model_rounds(table, found) for (lang, *_), m in r.items()}
    monkeypatch.setattr(quality, "ROUND_ENTRIES", table.count() // 7)
    rounds = list(quality.model_rounds(table, found))
    parts = Counter()
    for r in rounds:
        for (lang, *_), m in r.items():
            parts[lang] += quality.Model(*m).score(asked[lang])
    assert len(rounds) > 3 and all(abs(parts[k] - whole[k]) < 1e-6 * abs(whole[k]) for k in whole)


def test_quality_verdicts(spark, docs, empty):
    rows = [(i, prose(i, 150), "en", "a", 1) for i in range(60)] + [(100, " ".join("".join(chr(97 + (k * 11 + j * (3 + 2 * k)) % 26) for j in range(40)) for k in range(26)), "en", "a", 1), (101, prose(7, 150), None, "a", 1)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not got[100]["kept"] and not got[100]["base_failed"] and len(got) == 62
    odd = quality.judge_quality(docs).collect()
    assert len(odd) == len(corpus())
    assert all(r["base_failed"] and not r["kept"] for r in odd if r["doc_id"] in (30, 31, 32, 33)) and any(r["perplexity"] is None for r in odd)
    assert quality.judge_quality(empty).count() == 0


# 10 languages


def test_languages(spark, docs, empty):
    tongue = lambda seed, parts: " ".join("".join(random.Random(seed * 1000 + k).choices(parts, k=3)) for k in range(60))
    parts = {"en": ["th", "ing", "er", "on"], "fr": ["eau", "é", "que", "ou"], "ru": ["ст", "ов", "пр", "на"]}
    rows = [(i * 3 + j, tongue(i * 3 + j, p), lang, "s", 1) for i in range(20) for j, (lang, p) in enumerate(parts.items())]
    df = spark.createDataFrame([*rows, (900, None, "en", "s", 1), (901, "12 #!", "fr", "s", 1), (902, "", None, "s", 1)], DOCS)
    got = {r["doc_id"]: r for r in langid.identify(df, F.col("doc_id") < 30).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 for i, _, lang, *_ in rows)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert langid.identify(docs, F.lit(False)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs, F.lit(True)).count() == len(corpus()) and langid.identify(empty, F.lit(True)).count() == 0


def test_pieces_of_a_text_make_the_same_triples(monkeypatch):
    text = prose(9, 500) + " 123 ..\n" + prose(10, 50)
    whole = Counter(np.concatenate(list(langid.triples(text))).tolist())
    found = quality.Alphabets({"en": np.arange(97, 120)})
    grams = Counter(np.concatenate(list(found.grams("en", text))).tolist())
    monkeypatch.setattr(langid, "SEGMENT", 7)
    monkeypatch.setattr(quality, "SEGMENT", 5)
    assert Counter(np.concatenate(list(langid.triples(text))).tolist()) == whole
    assert Counter(np.concatenate(list(found.grams("en", text))).tolist()) == grams
    a = langid.triple_vector(int(next(iter(whole))))
    assert set(a.tolist()) == {-1, 1}
