"""Operator 4 finds copies with as many edits as its rate says."""

import random
import string

import pytest

from attestry.llm import decontaminate


def letters(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(string.ascii_lowercase, k=r.randint(3, 9))) for _ in range(words))


def spoiled(item: str, edits: int) -> str:
    """An item with that many characters replaced, at even distances."""
    at = {len(item) * (2 * i + 1) // (2 * edits) for i in range(edits)}
    return "".join("#" if i in at else c for i, c in enumerate(item))


def test_copies_with_all_edits_of_the_rate_are_found(spark):
    items = [(n, (letters(n, n) + " end")[:n].replace(" ", "_")) for n in (10, 19, 20, 31, 32, 40, 81, 120, 233, 394)]
    docs = [(n, f"before {spoiled(s, n // 10)} behind") for n, s in items] + [(1000 + n, f"before {spoiled(s, n // 10 + 1)} behind") for n, s in items]
    short = [(1, "Who wrote it?"), (2, "a  b"), (3, " "), (4, "!?")]
    docs += [(2001, "So, who  wrote it? He"), (2002, "awho wrote it?"), (2003, "a bc; xa b; (a b)"), (2004, "xa bc"), (2005, "what!?")]
    bench, rows = spark.createDataFrame([*items, *short], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["match_end"]) for r in decontaminate.contamination(rows, bench).collect()}
    assert {g[:3] for g in got} == {(n, n, n // 10) for n, _ in items} | {(2001, 1, 0), (2002, 1, 0), (2003, 2, 0), (2005, 4, 0)}
    assert (2001, 1, 0, 17) in got and (2003, 2, 0, 16) in got
    assert {r["doc_id"] for r in decontaminate.decontaminated(rows, bench).collect()} == {d for d, _ in docs} - {g[0] for g in got}


@pytest.mark.parametrize("seed", range(4))
def test_the_filter_of_hits_loses_nothing(seed):
    r = random.Random(seed)
    items = [(i, "".join(r.choices("ab c", k=r.randint(10, 70)))) for i in range(8)]
    matcher = decontaminate.Matcher(items, 0.1)
    for _ in range(60):
        n = r.randrange(8)
        noisy = list(items[n][1])
        for _ in range(r.randint(0, 9)):
            p = r.randrange(len(noisy))
            noisy[p : p + 1] = r.choice((["a"], ["#"], [], [noisy[p], "b"]))
        text = "".join(r.choices("abc ", k=20)) + "".join(noisy) + "".join(r.choices("abc ", k=20))
        want = {i: got[0] for m, (i, s) in enumerate(items) if (got := decontaminate.myers(matcher._masks(m), len(s), text, decontaminate.budget(s)))}
        assert {i: d for i, d, *_ in matcher.search(text)} == want
