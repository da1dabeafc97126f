"""Rules of style sheets as tables: which rule fits which node, for all rules of all sheets at once."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import html as H
from attestry.operators.structure import structural_join
from attestry.sources import cut, small

#: Pseudo-classes by what a printed page makes of them. Those of neither kind fit every node.
PLACES = {"first-child", "last-child", "only-child"}
NEVER = {"hover", "focus", "active", "visited"}

_COMPOUND = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9-]*|\*)?(?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:[~^$*|]?=[\"']?[^\"'\]]*[\"']?)?\]|::?[a-zA-Z-]+(?:\([^)]*\))?)*", re.A)
_PIECE = re.compile(r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[~^$*|]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]|::?(?P<pseudo>[a-zA-Z-]+)(?:\((?P<arg>[^)]*)\))?|(?P<tag>[a-zA-Z][a-zA-Z0-9-]*|\*)", re.A)
_STEP = re.compile(r"(-?\d*)n\s*([+-]\s*\d+)?|([+-]\s*\d+)", re.A)

_TESTS = "tag:string, id:string, classes:array<string>, attrs:array<struct<name:string, op:string, value:string>>, places:array<struct<kind:string, a:bigint, b:bigint>>"
_COMPOUND_TYPE = f"struct<{_TESTS}, negated:array<struct<{_TESTS}>>, key:string, a:int, b:int, c:int>"
_PREFIX_TYPE = "array<struct<level:int, prefix:string, before:string, child:boolean, compound:string>>"


def nth(arg: str) -> tuple[str, int, int]:
    """The place an+b that an argument of nth-child means; ("never", 0, 0) where it means none."""
    arg = arg.strip().lower()
    if arg in ("odd", "even"):
        return "nth", 2, int(arg == "odd")
    if arg and (m := _STEP.fullmatch(arg)):
        each = {None: 0, "": 1, "-": -1}
        return "nth", each[m[1]] if m[1] in each else int(m[1]), int("".join((m[2] or m[3] or "0").split()))
    number = re.match(r"[+-]?\d+", arg, re.A)
    return ("nth", 0, int(number[0])) if number else ("never", 0, 0)


def compound(token: str, inside: bool = False) -> dict | None:
    """What a compound selector (no combinators) asks of a node; None if it can't be read."""
    if not token or not _COMPOUND.fullmatch(token):
        return None
    out = {"tag": None, "id": None, "classes": [], "attrs": [], "places": [], "negated": []}
    pseudos = 0
    for m in _PIECE.finditer(token):
        if m["tag"]:
            out["tag"] = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            out["id"] = m["id"]  # the last of several counts
        elif m["cls"]:
            out["classes"].append(m["cls"])
        elif m["attr"]:
            out["attrs"].append({"name": m["attr"].lower(), "op": m["op"], "value": m["val"] or None})
        else:
            pseudos += 1
            name, arg = m["pseudo"].lower(), m["arg"] or ""
            if name in PLACES:
                out["places"].append({"kind": name, "a": 0, "b": 0})
            elif name == "nth-child":
                out["places"].append(dict(zip(("kind", "a", "b"), nth(arg))))
            elif name in NEVER:
                out["places"].append({"kind": "never", "a": 0, "b": 0})
            elif name == "not" and not inside and (no := compound(arg.strip(), True)):
                out["negated"].append({k: no[k] for k in ("tag", "id", "classes", "attrs", "places")})
    out["key"] = f"#{out['id']}" if out["id"] else f".{out['classes'][0]}" if out["classes"] else out["tag"] or "*"
    out["a"], out["b"], out["c"] = int(out["id"] is not None), len(out["classes"]) + len(out["attrs"]) + pseudos, int(out["tag"] is not None)
    return out


def prefixes(selector: str | None) -> list[dict] | None:
    """Each compound of a selector with all that stands before it; None if the selector can't be read."""
    out, child = [], False
    for token in filter(None, re.split(r"\s*(>)\s*|\s+", (selector or "").strip())):
        if token == ">":
            child = True
            continue
        if compound(token) is None:
            return None
        before = out[-1]["prefix"] if out else None
        out.append({"level": len(out), "prefix": token if before is None else f"{before} > {token}" if child else f"{before} {token}", "before": before, "child": bool(out) and child, "compound": token})
        child = False
    return out or None


def _prefixes(selectors: pd.Series) -> pd.Series:
    return selectors.map(prefixes)


def _compound(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compound(t) for t in tokens], columns=["tag", "id", "classes", "attrs", "places", "negated", "key", "a", "b", "c"])


def _fits(c: Column) -> Column:
    """Whether the node at hand (tag, attrs, classes, nth, siblings) passes all tests of c."""

    def attribute(t: Column) -> Column:
        v, want, op = F.try_element_at("attrs", t["name"]), t["value"], t["op"]
        met = (
            F.when(op == "=", v == want).when(op == "^=", F.startswith(v, want)).when(op == "$=", F.endswith(v, want)).when(op == "*=", F.contains(v, want))
            .when(op == "~=", F.array_contains(F.split(v, r"\s+"), want)).when(op == "|=", (v == want) | F.startswith(v, F.concat(want, F.lit("-"))))
        )
        return v.isNotNull() & (op.isNull() | F.coalesce(met, F.lit(False)))

    def place(p: Column) -> Column:
        n, a, b = F.col("nth"), p["a"], p["b"]
        step = F.when(a == 0, n == b).otherwise((F.try_mod(n - b, a) == 0) & (F.signum(n - b) * F.signum(a) >= 0))
        return F.when(p["kind"] == "first-child", n == 1).when(p["kind"] == "last-child", n == F.col("siblings")).when(p["kind"] == "only-child", F.col("siblings") == 1).when(p["kind"] == "nth", step).otherwise(False)

    return (
        (c["tag"].isNull() | (c["tag"] == F.col("tag"))) & (c["id"].isNull() | F.coalesce(c["id"] == H.attribute("id"), F.lit(False)))
        & F.forall(c["classes"], lambda x: F.array_contains("classes", x)) & F.forall(c["attrs"], attribute) & F.forall(c["places"], place)
    )


def matching_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, node_id, rule_id, a, b, c): the rules (rule_id, selector) that fit each element, with their specificity.

    Selectors have tags, ids, classes, attribute tests, the pseudo-classes of place and :not, with ' ' and '>' between compounds; an ancestor is sought at the nearest
    node that fits, without trying those above it. Lists are split by the caller. A selector that can't be read (null, empty, other signs, a blank within brackets) fits nothing.
    An attribute test against the empty string fits nothing. Pages are told apart by page_id; nodes of a null one are met by no rule.

    Each distinct compound of all rules has one key, its id, else its first class, else its tag, else `*`, and nodes meet it by equality with theirs; the other tests
    are expressions on the pair. What stands before a compound is a row too, shared by all rules that begin so, and is decided once a node: round k settles the
    prefixes of k compounds. Rounds are as many as the longest selector has compounds, and the plan doesn't grow with the rules.
    """
    read = rules.select("rule_id", F.pandas_udf(_prefixes, _PREFIX_TYPE)(F.col("selector").cast("string")).alias("parts")).filter("parts IS NOT NULL")
    read = cut(read, "rules")
    steps = read.select(F.explode("parts").alias("s")).select("s.*").distinct()
    compounds = cut(steps.select("compound").distinct().withColumn("t", F.pandas_udf(_compound, _COMPOUND_TYPE)("compound")), "compounds")
    whole = read.select("rule_id", F.element_at("parts", -1)["prefix"].alias("prefix"), F.explode("parts").alias("s")).join(small(compounds.select(F.col("compound").alias("x"), "t.a", "t.b", "t.c")), F.col("s.compound") == F.col("x"))
    whole = whole.groupBy("rule_id", "prefix").agg(*(F.sum(x).cast("int").alias(x) for x in "abc"))
    ask = compounds.select("compound", "t.*").drop("a", "b", "c")

    element = nodes.filter(~F.col("tag").startswith("#") & F.col("page_id").isNotNull())
    placed = "size(t.places) > 0 OR exists(t.negated, n -> size(n.places) > 0)"
    if compounds.filter(placed).limit(1).count():
        element = H.sibling_position(element)
    else:  # no rule asks for places, so nodes needn't be sorted by their parents
        element = element.withColumns({"nth": F.lit(0), "siblings": F.lit(0)})
    element = element.withColumn("classes", F.filter(F.split(F.coalesce(H.attribute("class"), F.lit("")), r"\s+"), lambda x: x != ""))
    keys = F.array_compact(F.array_distinct(F.concat(F.array(F.concat(F.lit("#"), H.attribute("id")), F.col("tag"), F.lit("*")), F.transform("classes", lambda x: F.concat(F.lit("."), x)))))
    met = element.select("page_id", "node_id", "parent_id", "pre", "post", "depth", "tag", "attrs", "classes", "nth", "siblings", F.explode(keys).alias("key")).join(small(ask.select("key", "compound", F.struct("tag", "id", "classes", "attrs", "places").alias("t"), "negated")), "key")
    fits = met.filter(_fits(F.col("t")) & F.forall("negated", lambda n: ~_fits(n)))
    fits = cut(fits.select("page_id", "node_id", "parent_id", "pre", "post", "depth", "compound"), "fits")

    state, done = None, None
    for level in range((steps.agg(F.max("level")).first()[0] or 0) + 1):
        here = fits.join(small(steps.filter(F.col("level") == level)), "compound")
        if state is None:
            state = here.select("page_id", "node_id", "pre", "post", "depth", "prefix", F.lit(True).alias("ok"))
        else:
            here = here.select("page_id", "node_id", "parent_id", "pre", "post", "depth", "prefix", F.col("before"), "child")
            above = state.select("page_id", "pre", "post", "depth", F.col("prefix").alias("before"), F.when(F.col("ok"), F.col("node_id")).alias("up_id"))
            inside = structural_join(here.filter(~F.col("child")), above, ("page_id", "before"), nearest=True).withColumn("ok", F.col("up_id").isNotNull())
            parents = state.filter("ok").select("page_id", F.col("node_id").alias("parent_id"), F.col("prefix").alias("before"), F.lit(True).alias("met"))
            below = here.filter("child").join(parents, ["page_id", "parent_id", "before"], "left").withColumn("ok", F.coalesce("met", F.lit(False)))
            shape = ["page_id", "node_id", "pre", "post", "depth", "prefix", "ok"]
            state = cut(inside.select(*shape).unionByName(below.select(*shape)), "prefixes")
        found = state.filter("ok").select("page_id", "node_id", "prefix")
        done = found if done is None else done.unionByName(found)
    return done.join(small(whole), "prefix").select("page_id", "node_id", "rule_id", "a", "b", "c")


def inline_declarations(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, property, value, important, ord) of style attributes. Shorthands stay as they are; a part without a colon, a name or a value is none."""
    part = F.posexplode(F.split(H.attribute("style"), ";"))
    x = nodes.filter(H.attribute("style").isNotNull()).select("page_id", "node_id", part.alias("ord", "part")).filter(F.contains("part", F.lit(":")))
    marked = r"(?i)\s*!\s*important\s*$"
    value = F.trim(F.expr("substring(part, locate(':', part) + 1)"))
    x = x.select("page_id", "node_id", F.lower(F.trim(F.substring_index("part", ":", 1))).alias("property"), F.trim(F.regexp_replace(value, marked, "")).alias("value"), value.rlike(marked).alias("important"), F.col("ord").cast("long"))
    return x.filter("property <> '' AND value <> ''")


def cascaded_styles(nodes: DataFrame, rules: DataFrame, declarations: DataFrame) -> DataFrame:
    """(page_id, node_id, property, value) that each element gets from rules (rule_id, selector, origin int, ord long), their declarations (rule_id, property, value, important) and its style attribute."""
    of_rules = matching_rules(nodes, rules).join(small(rules.select("rule_id", "origin", "ord")), "rule_id").join(small(declarations), "rule_id")
    cols = ["page_id", "node_id", "property", "value", "important"]
    ranked = of_rules.select(*cols, F.lit(False).alias("inline"), F.col("origin").cast("int"), "a", "b", "c", F.col("ord").cast("long"))
    zero = F.lit(0)
    own = inline_declarations(nodes).select(*cols, F.lit(True).alias("inline"), zero.alias("origin"), zero.alias("a"), zero.alias("b"), zero.alias("c"), "ord")
    return H.effective_declarations(ranked.unionByName(own))
