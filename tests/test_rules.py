"""Small cases of the rules that depend on order, unknowns and bounds."""

import hashlib
import hmac as h

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attestry.functions import scalars as C
from attestry.operators import edits, layout, ledger, trust
from attestry.operators import policy as P
from attestry.sources import html as page

KEY = "a key of 16 chars"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hmac_is_the_standard_one(spark):
    got = spark.createDataFrame([("é x",)], "m string").select(C.hmac_sha256(F.col("m"), KEY)).first()[0]
    assert got == h.digest(KEY.encode(), "é x".encode(), hashlib.sha256).hex()
    with pytest.raises(ValueError):
        C.hmac_sha256(F.lit("x"), "short")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 255, 256, 257, 300])
def test_merkle_root_and_proofs(spark, n):
    def root(x):
        if len(x) < 2:
            return x[0] if x else hashlib.sha256(b"").digest()
        k = 1 << (len(x) - 1).bit_length() - 1
        return hashlib.sha256(b"\1" + root(x[:k]) + root(x[k:])).digest()

    leaves = [hashlib.sha256(b"\0" + str(i).encode()).digest() for i in range(n)]
    df = spark.createDataFrame([(i, x.hex()) for i, x in enumerate(leaves)], "leaf_index long, hash string")
    want = root(leaves).hex()
    assert ledger.merkle_root(df).first()[0] == want
    if 0 < n < 10:
        checked = ledger.verify_inclusion(ledger.inclusion_proofs(df), F.lit(want)).collect()
        assert len(checked) == n and all(r["included"] for r in checked)


def _ledger(spark):
    r = [("L", i, hashlib.sha256(str(i).encode()).hexdigest(), f"D{i}", "s", "i", "B-B", "PASSED") for i in range(1, 5)]
    r.append(("L", 5, "not a digest", "D5", "s", "i", "B-B", "PASSED"))
    df = spark.createDataFrame(r, "ledger_id string, seq int, document_hash string, doc_no string, signer string, issuer string, level string, indication string")
    return ledger.ledger_lines(ledger.append_ledger(df, KEY, "seq")).collect()


@pytest.mark.parametrize(("change", "key", "broken", "valid"), [(None, KEY, None, 4), ("edit", KEY, 1, 0), ("drop", KEY, 2, 1), ("garbage", KEY, 2, 1), (None, "another key of 16", 1, 0)])
def test_tampered_ledgers(spark, change, key, broken, valid):
    lines = [(r["ledger_id"], r["pos"], r["line"]) for r in _ledger(spark)]
    assert len(lines) == 4
    if change == "edit":
        lines[0] = ("L", 1, lines[0][2].replace('"B-B"', '"B-T"'))
    if change == "drop":
        lines = [lines[0], ("L", 2, lines[2][2]), ("L", 3, lines[3][2])]
    if change == "garbage":
        lines[1] = ("L", 2, "no json")
    got = ledger.ledger_status(ledger.verify_ledger(spark.createDataFrame(lines, "ledger_id string, pos int, line string"), key)).first()
    assert (got["broken_at"], got["records"]) == (broken, valid)


def test_denied_hits_are_not_recorded(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 1, 2, 3, 1001])] + [(2, 9, 3)], "key long, hit_id long, ms long")
    got = {r["hit_id"]: (r["allowed"], r["retry_ms"]) for r in edits.sliding_rate_limit(df, 3, 1000).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, 997), 4: (True, None), 9: (True, None)}


def test_path_length_counts_from_two_below(spark):
    step = lambda chain, depth, path_len: (chain, depth, depth > 0, depth > 0, path_len, False, True, False)
    data = [step("a", 0, None), step("a", 1, None), step("a", 2, 0), step("b", 0, None), step("b", 1, 0)]
    df = spark.createDataFrame(data, "chain_id string, depth int, is_ca boolean, key_cert_sign boolean, path_len int, self_issued boolean, digital_signature boolean, content_commitment boolean")
    assert rows(trust.path_rules(df)) == [("a", 2, "path_length")]


def test_cascade_continues_and_returns(spark):
    df = spark.createDataFrame([(1, True, True, False), (2, True, False, False), (3, True, True, True), (4, False, False, False), (5, None, None, None)], "id int, eight boolean, twelve boolean, five boolean")
    got = trust.verdict(df, {5: F.col("five"), 8: F.col("eight"), 12: F.col("twelve")}).collect()
    assert [r["sub_indication"] for r in sorted(got)] == ["OUT_OF_BOUNDS_NO_POE", "NO_CERTIFICATE_CHAIN_FOUND", "HASH_FAILURE", None, None]


@pytest.mark.parametrize(("reason", "proof", "revoked", "invalid", "safe"), [
    ("superseded", 1, 2, None, True), ("superseded", 2, 2, None, False), ("superseded", 1, 3, 1, False), ("keyCompromise", 1, 2, None, False), (None, None, 2, None, False), (None, 1, None, None, False)])
def test_proof_before_revocation(spark, reason, proof, revoked, invalid, safe):
    df = spark.createDataFrame([(reason, proof, revoked, invalid)], "reason string, p int, r int, i int")
    assert df.select(trust.protected(F.col("p"), F.col("r"), F.col("i"), F.col("reason"))).first()[0] is safe


@pytest.mark.parametrize(("address", "safe"), [
    ("8.8.8.8", True), ("127.0.0.1", False), ("169.254.169.254", False), ("256.1.1.1", False), ("1.2.3", False), ("::1", False), ("::", False), ("::ffff:127.0.0.1", False), ("::ffff:8.8.8.8", True),
    ("2001:4860::8888", True), ("fe80::1", False), ("fd00::1", False), ("ff02::1", False), ("2002:7f00:1::", False), ("64:ff9b::10.0.0.1", False), ("1::2::3", False), ("x", False), ("100.64.0.1", False), ("172.32.0.1", True)])
def test_addresses(spark, address, safe):
    assert spark.createDataFrame([(address,)], "a string").select(P.address_safe(F.col("a"))).first()[0] is safe


@pytest.mark.parametrize(("path", "code"), [("a/b.png", None), ("../x", "OUTSIDE"), ("%252e%252e/x", "OUTSIDE"), ("a+b%2Bc.png", None), ("C:\\x", "ABSOLUTE"), ("//h/x", "ABSOLUTE"), ("data:x", "IS_DATA"), (None, "EMPTY"), ("file:///x", "SCHEME"), ("ftp://h/x", "REMOTE"), ("a%00", "NUL")])
def test_paths(spark, path, code):
    assert spark.createDataFrame([(path,)], "p string").select(P.asset_path_verdict(F.col("p"))).first()[0] == code


@pytest.mark.parametrize(("lines", "paragraphs"), [
    ([(100, 11), (115, 11), (130, 11)], 1), ([(100, 11), (115, 11), (160, 11)], 2), ([(100, 11), (115, 11), (123, 11)], 2), ([(100, 20), (125, 11)], 2), ([(100, 11), (99, 11)], 1)])
def test_paragraphs(spark, lines, paragraphs):
    df = spark.createDataFrame([(1, 0, k, 50.0, 200.0, float(b), float(s), "a", "t") for k, (b, s) in enumerate(lines)], "doc_id long, page int, ord long, x double, right double, baseline double, font_size double, style_key string, text string")
    got = layout.group_paragraphs(df)
    assert got.agg(F.max("run")).first()[0] == (2 if lines[0][0] > lines[1][0] else paragraphs)


def test_summary_of_a_paragraph(spark):
    df = spark.createDataFrame([(1, 0, k, 50.0, 200.0 - k, 100.0 + 15 * k, 10.0, "a", f"t{k}") for k in range(3)], "doc_id long, page int, ord long, x double, right double, baseline double, font_size double, style_key string, text string")
    r = layout.paragraph_summary(layout.group_paragraphs(df)).first()
    assert (r["lines"], r["align"], r["line_height"], r["text"]) == (3, "justify", 1.5, "t0 t1 t2")  # equal edges but for a last line that is more than the tolerance shorter
    even = df.withColumn("right", F.lit(200.0))
    assert layout.paragraph_summary(layout.group_paragraphs(even)).first()["align"] == "left"


def test_runs_are_held_against_their_first_piece(spark):
    piece = lambda k, x, base, text: (1, 0, k, x, x + 10, base, 10.0, text)
    df = spark.createDataFrame([piece(0, 0.0, 100.0, "a"), piece(1, 10.5, 101.5, "b"), piece(2, 23.0, 103.0, "c"), piece(3, 100.0, 103.0, "d")], "doc_id long, page int, ord long, x double, right double, baseline double, font_size double, text string")
    assert [r["text"] for r in layout.merge_runs(df).orderBy("run").collect()] == ["ab", "c", "d"]


def test_chunks_hold_all_words(spark):
    got = layout.pack_chunks(spark.createDataFrame([(1, "aa bb cccccccc d"), (2, None), (3, "")], "doc_id long, text string"), 5).collect()
    assert [r["text"] for r in got] == ["aa bb", "ccccc", "ccc d"]


def test_html_scan():
    got = page.nodes('<!doctype html><p>a<p class="x y" id=q>b &amp; &copy; &zzz;<br/><ul><li>1<li>2</ul></x><!-- n --><script>if (a<b) "</p>"</script>c < d')
    tags = [(n[5], n[1], n[7]) for n in got]
    assert ("p", 0, None) in tags and ("#text", 3, "b & © &zzz;") in tags and ("#text", 0, "c ") in tags
    assert [n[6] for n in got if n[5] == "p"][1] == {"class": "x y", "id": "q"}
    assert sum(n[5] == "li" for n in got) == 2 and any(n[7] == 'if (a<b) "</p>"' for n in got)
    assert page.nodes(None)[0][5] == "#document" and all(n[2] < n[3] for n in got)


def test_characters_that_are_none_stay():
    assert page.decode("&#xD800; &#0; &#1114112; &#x110000; &#12ab; &#99999999999999; &#x41;&#66;&Amp;&nope;") == "&#xD800; &#0; &#1114112; &#x110000; &#12ab; &#99999999999999; AB&&nope;"
    assert [n[7] for n in page.nodes("c < d << e<")[1:]] == ["c ", "<", " d ", "<", "<", " e", "<"]


def test_depth_is_of_the_deepest_node(spark):
    import duckdb

    from attestry.plans.registry import QUERIES

    want = {i: max(n[4] for n in page.nodes(h)) for i, h in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()}
    assert {r["page_id"]: r["depth"] for r in QUERIES["a11_document_depth"](spark, "/root/testdata/sf0.001").collect()} == want
    got = page.nodes("<div><p>a<b>c</b></p></div>")
    assert all(n[8] == ([*got[n[1]][8], n[1]] if n[1] is not None else []) for n in got)


def test_files_are_known_by_their_bytes(spark, tmp_path):
    from attestry import sources as S

    (tmp_path / "a.txt").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "b.png").write_bytes(b"%PDF-1.7")
    got = {r["path"].rsplit("/", 1)[1]: (r["mime"], r["size"], r["sha256"] == hashlib.sha256((tmp_path / r["path"].rsplit("/", 1)[1]).read_bytes()).hexdigest(), r["id"][4:] == r["sha256"][:16]) for r in S.scan_assets(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("image/png", 9, True, True), "b.png": (None, 8, True, True)}


def test_ledgers_are_read_by_line(spark, tmp_path):
    """Files of many splits, an empty one, and one without a last line end."""
    from attestry import sources as S

    want = {"a": [f"line {k} of a" for k in range(5000)], "b": ["x", "", "y"]}
    for name, lines in want.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * (name == "a"))
    (tmp_path / "c.jsonl").write_text("")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = S.read_ledger(spark, str(tmp_path)).orderBy("ledger_id", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r["ledger_id"], r["pos"], r["line"]) for r in got] == [(n, k, x) for n, lines in want.items() for k, x in enumerate(lines, 1)]


def test_properties_are_inherited_over_any_depth(spark):
    """A chain of 10 000 nodes whose root has the value, a circle without one, a circle below which hangs a node, and a parent that isn't there."""
    from attestry.operators import generic

    chain = [(k, k - 1 if k else None, "v" if k == 0 else None) for k in range(10_000)]
    odd = [(20_000, 20_001, None), (20_001, 20_000, None), (20_002, 20_001, None), (30_000, 30_001, "w"), (30_001, 30_000, None), (40_000, 99_999, None), (50_000, 50_000, None)]
    got = {r["node_id"]: (r["value"], r["distance"], r["cyclic"]) for r in generic.inherited_property(spark.createDataFrame(chain + odd, "node_id int, parent_id int, value string")).collect()}
    assert len(got) == len(chain) + len(odd) and all(got[k] == ("v", k, False) for k, *_ in chain)
    assert [got[k] for k, *_ in odd] == [(None, None, True)] * 3 + [("w", 0, False), ("w", 1, False), (None, None, False), (None, None, True)]


def test_fields_of_any_depth_are_listed(spark):
    from attestry.operators import generic

    deep = [(k, k - 1 if k else None, f"p{k}" if k % 3 else None, "Btn" if k == 2 else None, 1 if k == 0 else None) for k in range(100)]
    odd = [(200, 201, "a", None, None), (201, 200, "b", None, None), (300, None, "", None, None), (301, 300, "", None, None), (302, 301, "x", None, None), (303, 302, "", None, None), (304, 303, "y", None, None)]
    df = spark.createDataFrame(deep + odd, "field_id int, parent_id int, part string, kind string, flags int")
    got = {r["field_id"]: r for r in generic.field_inventory(df, spark.createDataFrame([(5, 2, 7), (5, 1, 8)], "field_id int, ord int, page int")).collect()}
    for k, *_ in deep:
        name = ".".join(f"p{j}" for j in range(k + 1) if j % 3)
        assert (got[k]["name"], got[k]["kind"], got[k]["read_only"], got[k]["depth"], got[k]["deep"], got[k]["cyclic"]) == (name, "Btn" if k >= 2 else "Tx", True, k, k > 32, False)
    assert got[5]["page"] == 8 and got[99]["terminal"] and not got[98]["terminal"] and got[200]["cyclic"] and got[200]["name"] is None
    assert [got[k]["name"] for k in (300, 301, 302, 303, 304)] == ["", "", "x", "x.", "x..y"]


def test_ranges_of_any_number_of_values(spark):
    from attestry.operators import policy

    cases = [([0, 10, 20, 5], set()), ([0, 10, 20, 5, 7], {"ODD_COUNT"}), ([], {"ODD_COUNT"}), (None, {"NOT_NUMBERS"}), ([0, None], {"NOT_NUMBERS"}), ([0, 10, 5, 5], {"OVERLAP", "GAP"}), ([0, 10, 20, 50], {"PAST_END"}), ([-1, 10, 20, 5], {"NEGATIVE"}), ([0, 10, 20, 2, 22, 3], {"GAP"})]
    df = spark.createDataFrame([(i, n, 25, 10, 20) for i, (n, _) in enumerate(cases)], "sig_id int, numbers array<bigint>, length int, contents_start int, contents_end int")
    got = {}
    for r in policy.byte_range_issues(df).collect():
        got.setdefault(r["sig_id"], set()).add(r["issue"])
    assert [got.get(i, set()) for i in range(len(cases))] == [w for _, w in cases]


def test_paths_without_constraints_or_with_commitments(spark):
    """An issuer without basic constraints may not issue; a leaf that may commit to content may sign."""
    schema = "chain_id string, depth int, is_ca boolean, key_cert_sign boolean, path_len int, self_issued boolean, digital_signature boolean, content_commitment boolean"
    steps = [("a", 0, False, False, None, False, False, True), ("a", 1, None, None, None, False, True, False), ("a", 2, True, True, None, True, True, False), ("b", 0, False, False, None, False, False, False), ("b", 1, True, None, None, True, None, None), ("c", 0, False, None, None, False, None, None), ("c", 1, True, True, None, True, True, True)]
    assert rows(trust.path_rules(spark.createDataFrame(steps, schema))) == [("a", 1, "not_a_ca"), ("b", 0, "leaf_key_usage")]


def test_unknown_stays_unknown(spark):
    x = spark.createDataFrame([("s", "c", False, None, None)], "sig_id string, cert_id string, is_root boolean, status string, chain_complete boolean")
    assert trust.revocation_complete(x).first()["complete"] is None


def test_conflicts_need_a_common_key(spark):
    op = lambda v, base, client, keys, kind="updateNode": Row(session_id=1, version=v, base_version=base, client_id=client, op=kind, target="n", patch_keys=keys)
    df = spark.createDataFrame([op(1, 0, "a", "x"), op(2, 0, "b", "y"), op(3, 0, "b", "x,z"), op(4, 3, "a", "z"), op(5, 0, "a", "q", "removeNode")])
    assert rows(edits.op_conflicts(df)) == [(1, 3, 1), (1, 5, 2)]


def test_names_in_turkish_order(spark):
    from attestry.operators import generic

    want = ["cam", "çam", "gaz", "ğ", "ısı", "iz", "oya", "öz", "sal", "şal", "uç", "üç"]
    df = spark.createDataFrame([(w,) for w in reversed(want)], "name string")
    assert [r["name"] for r in generic.locale_sort(df, "name").collect()] == want


def test_text_of_nodes(spark):
    """Descendants at any depth and in order; script and style left out; nodes inside one another each have their own text."""
    from attestry.operators import html
    from attestry.sources.html import html_nodes

    df = html_nodes(spark.createDataFrame([(7, "<body><p>a <b>bold</b></p><script>x()</script><style>y{}</style> end<i></i>")], "page_id long, html string"))
    assert {(r["node_id"], r["text"]) for r in html.node_text(df, df.filter("tag IN ('body', 'p', 'i')")).collect()} == {(1, "a bold end"), (2, "a bold")}


def test_lists_and_blocks_are_met_by_equality(spark):
    """Thousands of patterns and blocks: the plan has no join by interval or condition, and results are those of one at a time."""
    import ipaddress

    from attestry.operators import policy

    blocks = [f"{k % 223 + 1}.{k * 7 % 256}.{k * 13 % 256}.0/{8 + k % 17}" for k in range(5000)] + [f"2001:db8:{k:x}::/{32 + k % 17}" for k in range(500)] + ["0.0.0.0/0", "nonsense", "1.2.3.4/99"]
    addresses = [f"{k % 250}.{k * 7 % 256}.{k * 5 % 256}.{k % 256}" for k in range(400)] + [f"2001:db8:{k:x}::1" for k in range(0, 800, 7)] + ["::1", "no", None]
    found = policy.longest_prefix(spark.createDataFrame([(a,) for a in addresses], "address string"), spark.createDataFrame([(b,) for b in blocks], "cidr string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    nets = [(ipaddress.ip_network(b, strict=False), b) for b in blocks[:-2]]
    for r in found.collect():
        try:
            a = ipaddress.ip_address(r["address"])
        except ValueError:
            assert r["cidr"] is None
            continue
        fits = [(-n.prefixlen, b) for n, b in nets if n.version == a.version and a in n]
        assert r["cidr"] == (min(fits)[1] if fits else None), r

    patterns = [(f"*.p{k}.test", ("allow", "deny")[k % 2]) for k in range(3000)] + [("h7.p4.test", "deny"), ("*.TEST2", "allow"), (None, "deny"), ("x.y", "other")]
    urls = [(f"http://h{k}.p{k % 6}.test/",) for k in range(60)] + [("http://p1.test/",), ("http://a.b.test2",), ("http://test2/",), ("http://x.y/",), ("ftp://p2.test/",)]
    lists = spark.createDataFrame(patterns, "pattern string, list string")
    got = {r["url"]: r["code"] for r in policy.url_policy_by_lists(spark.createDataFrame(urls, "url string"), lists).collect()}
    few = [p for p in patterns if p[0] and p[0].lower() in {f"*.p{k}.test" for k in range(6)} | {"h7.p4.test", "*.test2"}]
    one = spark.createDataFrame(urls, "url string").select("url", policy.url_policy(F.col("url"), [p for p, x in few if x == "allow"], [p for p, x in few if x == "deny"]).alias("code"))
    assert got == {r["url"]: r["code"] for r in one.collect()} and {"HOST_DENIED", "HOST_NOT_ALLOWED", "SCHEME", None} <= set(got.values())


def test_boxes_of_all_sizes_meet(spark):
    """Page-wide boxes among small ones, points, negative places, and sizes from 0.001 to 100 000."""
    import random

    r = random.Random(4)
    boxes = [(k % 2, k, r.uniform(-500, 500), r.uniform(-500, 500), s, s * r.uniform(0.1, 3)) for k, s in enumerate([r.choice([0.0, 0.001, 1.0, 7.0, 64.0, 300.0, 1e5]) for _ in range(400)])]
    boxes += [(0, 900, -1000.0, -1000.0, 2000.0, 2000.0), (0, 901, 10.0, 10.0, 10.0, 10.0), (0, 902, 20.0, 10.0, 10.0, 10.0), (0, 903, 15.0, 15.0, 10.0, 10.0), (1, 904, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "page_id long, id long, x double, y double, width double, height double")
    want = set()
    for p, i, x, y, w, h in boxes:
        for p2, j, x2, y2, w2, h2 in boxes:
            if p == p2 and i < j and None not in (x, x2) and x < x2 + w2 and x2 < x + w and y < y2 + h2 and y2 < y + h:
                want.add((p, i, j))
    for cell in (1.0, 60.0):
        got = [(q["page_id"], q["a"], q["b"]) for q in layout.overlap_pairs(df, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert layout.overlap_pairs(df.limit(0)).count() == 0
