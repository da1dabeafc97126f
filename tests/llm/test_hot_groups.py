"""Operators 3 and 6 on tables whose keys are as uneven as can be."""

import random

from pyspark.sql import functions as F

from attestry.llm import minhash, url_filter


def jaccard_components(rows, percent, size=5):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_copies_in_a_third_of_all_rows_and_empties_in_another(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    base = [r.choice(words) for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(100 + i, ("", None, "  ")[i % 3]) for i in range(60)]
    for i in range(60):
        text = list(base)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(60)] = r.choice(words)
        rows.append((200 + i, " ".join(text)))
    monkeypatch.setattr(minhash, "LOT", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for asked in (minhash.ASKED, 3):  # with and without a broadcast of the ids that are asked for
        monkeypatch.setattr(minhash, "ASKED", asked)
        got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df, percent=80).collect()}
        assert got == jaccard_components(rows, 80)


def test_a_bucket_that_hardly_links_is_dealt_out(spark, monkeypatch):
    """Texts that share most of their shingles, but not enough: buckets are large and nothing is linked."""
    r = random.Random(6)
    common = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join(common + [f"x{i}y{r.randrange(10 ** 6)}" for _ in range(13 + i % 3)])) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 40, 4)]
    monkeypatch.setattr(minhash, "LOT", 5)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == jaccard_components(rows, 80)


def test_rules_that_share_a_prefix_are_told_apart(spark, monkeypatch):
    """With one hex digit of a prefix nearly all rules share theirs with others; digests decide."""
    rules = [(f"h{k}.example", f"/p{k % 7}/", "block" if k % 2 else "allow") for k in range(60)]
    pages = [(k, f"http://a.h{k % 70}.example/p{k % 5}/x?y#z") for k in range(300)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = spark.createDataFrame(pages, "page_id long, url string")
    want = {}
    for i, u in pages:
        host, path = u[7:].split("/", 1)
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        want[i] = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    for digits in (url_filter.PREFIX, 1):
        monkeypatch.setattr(url_filter, "PREFIX", digits)
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(urls, table).collect()}
        assert got == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(url_filter, "small", lambda df: df)
        monkeypatch.setattr(url_filter, "cut", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, name))[1])
        plain, seen = __import__("attestry.sources", fromlist=["cut"]).cut, []
        url_filter.judge_urls(urls, table).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for plan in seen for line in plan.splitlines() if "Join" in line and "prefix" in line]
    assert joins and not any("digest" in line.split("Inner")[0] for line in joins)
