"""Structural joins and rules of style sheets, against programs that walk the tree."""

import random

import pytest

from attestry.operators import html, styles
from attestry.operators.structure import structural_join
from attestry.sources.html import html_nodes, nodes

TAGS = ["div", "ul", "li", "p", "a", "span"]


def page(r, size):
    """A page of nested elements with ids, classes and attributes, deep in places."""
    out, open_ = [], []
    for _ in range(size):
        if open_ and r.random() < 0.4:
            out.append(f"</{open_.pop()}>")
            continue
        tag = r.choice(["div", "ul", "span", "a", "b"])
        attrs = f' class="{" ".join(r.choices(["x", "y", "z", "x-1"], k=r.randrange(3)))}"' if r.random() < 0.7 else ""
        attrs += f" id=i{r.randrange(4)}" if r.random() < 0.3 else ""
        attrs += f' href="{r.choice(["/a", "/b c", "http://q", "", "en-GB", "en"])}"' if r.random() < 0.4 else ""
        out.append(f"<{tag}{attrs}>" + r.choice(["", "t"]))
        open_.append(tag)
    return "".join(out)


def reader(page_nodes):
    """(up, children, attributes, tags) of the elements of a page."""
    element = {n[0]: n for n in page_nodes if not n[5].startswith("#")}
    kids = {}
    for n in element:
        kids.setdefault(element[n][1], []).append(n)
    return element, kids


SIMPLE = {
    "div": lambda n, e, k: e[n][5] == "div", "*": lambda n, e, k: True, ".x": lambda n, e, k: "x" in e[n][6].get("class", "").split(), "#i1": lambda n, e, k: e[n][6].get("id") == "i1",
    "ul.y.x": lambda n, e, k: e[n][5] == "ul" and {"x", "y"} <= set(e[n][6].get("class", "").split()), "[href]": lambda n, e, k: "href" in e[n][6], "a[href^='/']": lambda n, e, k: e[n][5] == "a" and e[n][6].get("href", "").startswith("/"),
    "[href$=q]": lambda n, e, k: e[n][6].get("href", "").endswith("q"), "[href*=tp]": lambda n, e, k: "tp" in e[n][6].get("href", ""), "[href~=c]": lambda n, e, k: "c" in e[n][6].get("href", "").split(),
    "[href|=en]": lambda n, e, k: e[n][6].get("href", "").split("-")[0] == "en", "[href='']": lambda n, e, k: False, ":first-child": lambda n, e, k: k[e[n][1]][0] == n, "span:last-child": lambda n, e, k: e[n][5] == "span" and k[e[n][1]][-1] == n,
    ":only-child": lambda n, e, k: len(k[e[n][1]]) == 1, "div:nth-child(2n+1)": lambda n, e, k: e[n][5] == "div" and k[e[n][1]].index(n) % 2 == 0, ":nth-child(-n+2)": lambda n, e, k: k[e[n][1]].index(n) < 2,
    ":nth-child(even)": lambda n, e, k: k[e[n][1]].index(n) % 2 == 1, ":nth-child(3)": lambda n, e, k: k[e[n][1]].index(n) == 2, "div:not(.x)": lambda n, e, k: e[n][5] == "div" and "x" not in e[n][6].get("class", "").split(),
    ":not(:first-child)": lambda n, e, k: k[e[n][1]][0] != n, "a:hover": lambda n, e, k: False, "b:unheard-of": lambda n, e, k: e[n][5] == "b",
}


def walk(steps, n, e, k):
    """steps: (combinator before it, simple) from the left; ancestors at the nearest that fits."""
    if not SIMPLE[steps[-1][1]](n, e, k):
        return False
    for (before, _), (_, want) in zip(reversed(steps), list(reversed(steps))[1:]):
        n = e[n][1]
        if before == " ":
            while n in e and not SIMPLE[want](n, e, k):
                n = e[n][1]
        if n not in e or not SIMPLE[want](n, e, k):
            return False
    return True


def test_rules_meet_the_nodes_they_fit(spark):
    r = random.Random(3)
    pages = [(p, page(r, 300)) for p in range(6)] + [(None, "<div class=x>"), (6, None), (7, "")]
    chains = [[("", s)] for s in SIMPLE]
    chains += [[(r.choice(" >"), r.choice(list(SIMPLE))) for _ in range(r.choice([2, 2, 3, 4]))] for _ in range(1500)]
    text = lambda c: "".join(s if k == 0 else f" > {s}" if b == ">" else f" {s}" for k, (b, s) in enumerate(c))
    rules = [(k, text(c)) for k, c in enumerate(chains)] + [(9000 + k, s) for k, s in enumerate(["", None, "a ~ b", "a[href=x y]", "..x", "div, p", "#"])]
    found = styles.matching_rules(html_nodes(spark.createDataFrame(pages, "page_id long, html string")), spark.createDataFrame(rules, "rule_id long, selector string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = [(x["page_id"], x["node_id"], x["rule_id"]) for x in found.collect()]
    want = set()
    for p, text_ in pages[:6]:
        e, k = reader(nodes(text_))
        want |= {(p, n, i) for i, c in enumerate(chains) for n in e if walk(c, n, e, k)}
    assert len(got) == len(set(got)) and set(got) == want and len({i for *_, i in want}) > 500


@pytest.mark.parametrize("arg, want", [("odd", ("nth", 2, 1)), ("even", ("nth", 2, 0)), ("n", ("nth", 1, 0)), ("-n+3", ("nth", -1, 3)), ("2n-1", ("nth", 2, -1)), ("0n+2", ("nth", 0, 2)), ("+3", ("nth", 0, 3)), ("7", ("nth", 0, 7)), ("x", ("never", 0, 0)), ("", ("never", 0, 0))])
def test_places(arg, want):
    assert styles.nth(arg) == want


def test_cascade(spark):
    """Important before inline before origin before specificity before order; the specificity of a selector is that of all its compounds."""
    pages = spark.createDataFrame([(1, '<div id=d class=x style="color : Own; margin: 0!IMPORTANT;;top:;x"><p>'), (2, "<p class=x>")], "page_id long, html string")
    rules = [(1, "#d", 0, 1), (2, "div", 1, 2), (3, "div.x", 1, 0), (4, "div.x", 1, 5), (5, "div p", 1, 1), (6, "p", 1, 9), (7, "p", 2, 0)]
    decl = [(1, "size", "a", True), (2, "size", "b", False), (3, "weight", "c", False), (4, "weight", "d", False), (1, "weight", "e", False), (2, "color", "f", False), (4, "margin", "g", True), (5, "color", "h", False), (6, "color", "i", False), (7, "top", "j", False), (2, "font", "k", True), (4, "font", "l", False)]
    got = styles.cascaded_styles(html_nodes(pages), spark.createDataFrame(rules, "rule_id long, selector string, origin int, ord long"), spark.createDataFrame(decl, "rule_id long, property string, value string, important boolean"))
    assert {(r["page_id"], r["node_id"], r["property"], r["value"]) for r in got.collect()} == {
        (1, 1, "size", "a"), (1, 1, "weight", "d"), (1, 1, "color", "Own"), (1, 1, "margin", "0"), (1, 1, "font", "k"), (1, 2, "color", "h"), (1, 2, "top", "j"), (2, 1, "color", "i"), (2, 1, "top", "j")}
    none = styles.matching_rules(html_nodes(pages), spark.createDataFrame([], "rule_id long, selector string"))
    assert none.count() == 0


def test_what_lies_in_what(spark):
    """Pairs, levels and nearest against the tree; a page given twice counts twice; a page without an id lies in nothing."""
    r = random.Random(5)
    pages = [(p, page(r, 200)) for p in range(3)] + [(3, None), (None, "<div><a>")]
    table = html_nodes(spark.createDataFrame(pages + [pages[0]], "page_id long, html string"))
    outer = table.filter("tag = 'div'").selectExpr("page_id", "pre", "post", "depth", "node_id AS up_id")
    inner = table.filter("tag IN ('div', 'a')").select("page_id", "node_id", "pre", "depth", "text")
    want, near = [], []
    for p, text in pages[:3]:
        copies = 2 if p == 0 else 1
        found = nodes(text)
        for n in found:
            if n[5] in ("div", "a"):
                above, m = [], n
                while m[1] is not None:
                    m = found[m[1]]
                    if m[5] == "div":
                        above.append(m)
                want += [(p, n[0], m[0], n[4] - m[4]) for m in above] * copies**2  # two copies meet two copies
                near += [(p, n[0], above[0][0] if above else None)] * copies
    assert sorted((x["page_id"], x["node_id"], x["up_id"]) for x in structural_join(inner, outer).collect()) == sorted(x[:3] for x in want)
    assert sorted((x["page_id"], x["node_id"], x["up_id"]) for x in structural_join(inner, outer, levels=2).collect()) == sorted(x[:3] for x in want if x[3] <= 2)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((x["page_id"], x["node_id"], x["up_id"]) for x in structural_join(inner, outer, nearest=True).collect()), key=key) == sorted(near, key=key)


def test_deep_pages_stay_linear(spark):
    """20 000 elements within one another: a row each, and the innermost text is found from the outermost."""
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    table = html_nodes(spark.createDataFrame([(1, deep)], "page_id long, html string")).cache()
    assert table.count() == 20_002 and "ancestors" not in table.columns
    assert html.node_text(table, table.filter("depth = 1")).first()["text"] == "x"
    assert html.select_nodes(table, (html.matches_simple("div"), ""), (html.matches_simple("div"), " ")).count() == 19_999
    table.unpersist()


def test_ancestors_of_a_page_in_hand(spark):
    """One page's nodes come with all that is around them; the table has the same nodes without."""
    r = random.Random(5)
    for text in [None, "", "x", *(page(r, 60) for _ in range(20))]:
        for n in nodes(text):
            above = [m for m in nodes(text) if m[2] < n[2] and m[3] > n[3]]
            assert n[8] == [m[0] for m in sorted(above, key=lambda m: m[2])] and len(n[8]) == n[4]
    text = page(r, 60)
    got = html_nodes(spark.createDataFrame([(1, text)], "page_id long, html string")).orderBy("node_id").collect()
    assert [list(x[1:]) for x in got] == [n[:8] for n in nodes(text)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_an_issuer_of_very_many_is_dealt_out(spark, monkeypatch, how):
    """One name in a third of all rows, nulls in another, several candidates a name: the same rows with and without dealing."""
    from pyspark.sql import functions as F

    from attestry import sources

    left = [(i, "CA" if i % 3 == 0 else None if i % 3 == 1 else f"n{i % 50}", i % 2) for i in range(3000)]
    right = [(f"u{k}", name, k % 2) for k, name in enumerate(["CA", "CA", "CA", *[f"n{i}" for i in range(0, 60, 2)], None])]
    a, b = spark.createDataFrame(left, "id long, name string, x int"), spark.createDataFrame(right, "u_id string, u_name string, u_x int")
    want = [(i, u) for i, n, x in left for u, m, y in right if n is not None and n == m and x == y]
    want += [(i, "") for i in {r[0] for r in left} - {w[0] for w in want}] if how == "left" else []
    monkeypatch.setattr(sources, "HOT", 10)
    for rows in (1000, 3):
        monkeypatch.setattr(sources, "BROADCAST_ROWS", rows)
        got = sources.join_hot(a, b, ("name", "u_name"), F.col("x") == F.col("u_x"), "id", how)
        assert sorted((r["id"], r["u_id"] or "") for r in got.collect()) == sorted(want)
