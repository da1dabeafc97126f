"""Benchmark passages in documents, found within an edit distance (operator 4).

An item of m characters may differ from a passage by k edits. Cut into k + 1 pieces, at least one of these must occur
unchanged, and next to it the neighbouring pieces with no more edits than there are of these: all pieces are looked for at
once, and around each hit with such neighbours Myers' bit-parallel recurrence gives the distance of the item to the best passage.
"""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import cut, strings, tidy

#: Share of an item's characters that may be edited.
ERROR_RATE = 0.1
#: Characters of items that are broadcast at once; a larger benchmark is searched in as many rounds as it takes. A worker's automaton takes some 90 bytes a character (345 MB measured).
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    """Lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    """Edits allowed: a share of the length, rounded down."""
    return max(0, min(int(rate * len(item)), len(item) - 1))


def split(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def beside(item: str, k: int, i: int) -> tuple[int, int, int, tuple[str, ...]] | None:
    """(start, end, edits, parts) of what is cut off together with piece i when the k + 1 pieces are halved again and again.

    Of a passage within k edits one half always has fewer edits than pieces, and so on down to one piece without any. So what
    is beside that piece has as many edits as pieces at most, and of one part more than these one stands there unchanged.
    """
    lo, hi, last = 0, k + 1, None
    while hi - lo > 1:
        mid = (lo + hi) // 2
        last = (mid, hi) if i < mid else (lo, mid)
        lo, hi = (lo, mid) if i < mid else (mid, hi)
    if last is None:
        return None
    a, b = (len(item) * x // (k + 1) for x in last)
    return a, b, last[1] - last[0], tuple(part for _, part in split(item[a:b], last[1] - last[0]))


def bordered(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither begins nor ends inside a word."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum() or b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best passage of text within k edits of a pattern of m characters; the first of equals.

    One addition, a few logical operations and shifts on m-bit numbers a character of text; the passage may start and end anywhere.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d | up)), up & d
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, s, budget(s, rate)) for i, s in items]
        self.pieces = ahocorasick.Automaton()
        found: dict[str, list[tuple]] = {}
        for n, (_, s, k) in enumerate(self.items):
            for i, (offset, piece) in enumerate(split(s, k)):
                found.setdefault(piece, []).append((n, offset, beside(s, k, i)))
        for piece, uses in found.items():
            self.pieces.add_word(piece, (len(piece), tuple(uses)))
        if found:
            self.pieces.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def _masks(self, n: int) -> dict[str, int]:
        if n not in self.masks:
            masks = self.masks[n] = {}
            for i, c in enumerate(self.items[n][1]):
                masks[c] = masks.get(c, 0) | 1 << i
        return self.masks[n]

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start of the window, end) of the best passage for each item that is in the text within its budget."""
        windows: dict[int, list[tuple[int, int]]] = {}
        if len(self.pieces):
            for end, (size, uses) in self.pieces.iter(text):
                for n, offset, near in uses:
                    _, s, k = self.items[n]
                    at = end + 1 - size - offset
                    if near is not None:
                        a, b, edits, parts = near
                        there = text[at + a : at + b + edits] if a > offset else text[max(0, at + a - edits) : max(0, at + b)]
                        if not any(part in there for part in parts):
                            continue
                    elif not bordered(text, at, end + 1):
                        continue
                    windows.setdefault(n, []).append((max(0, at - k), min(len(text), at + len(s) + k)))
        for n, spans in windows.items():
            item, s, k = self.items[n]
            exact = text.find(s) if k else spans[0][0]
            best = (0, max(0, exact - k), exact + len(s)) if exact >= 0 else None
            for a, b in merged(spans) if best is None else ():
                got = myers(self._masks(n), len(s), text[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a, a + got[1])
            if best:
                yield item, *best


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_end, item_chars): a row for each document and benchmark item that it holds within the budget.

    Texts are compared in lower case with white space as single blanks; match_end counts characters of that form. Items
    that are null or blank match nothing, and those too short for an edit only themselves, between word borders; items of equal text are reported for each
    item_id. Null and empty documents hold nothing; repeated rows are each reported. No documents or no items: no rows.

    Documents are only read: no shuffle. The benchmark is broadcast in blocks of BLOCK_CHARS characters at most (one item alone may be
    longer), so that a larger one takes more rounds and not more memory.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARS
    texts, out = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")), None
    for b in range(blocks):
        rows = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        block = docs.sparkSession.sparkContext.broadcast([(r["i"], s) for r in rows.distinct().toLocalIterator() if (s := normal(r["t"]))])
        found = texts.mapInArrow(tidy(_searcher(block, rate)), "doc_id long, item_id long, distance int, match_end long, item_chars int")
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(block, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, rate)
        size = {i: len(s) for i, s, _ in matcher.items}
        for batch in batches:
            rows = [
                (d, item, distance, end, size[item])
                for d, t in zip(batch.column("d").to_pylist(), strings(batch.column("t"))) if t
                for item, distance, _, end in matcher.search(normal(t))
            ]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance", "match_end", "item_chars"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item. Each row is judged on its own text where it stands, so nothing is shuffled; a null text stays.

    Of a benchmark of several blocks each searches what the one before it left; that is written, so that no task holds the automata of several blocks.
    """
    items = benchmark.select(F.col("text").alias("t")).filter("t IS NOT NULL")
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARS
    at = docs.columns.index(text)
    for b in range(blocks):
        rows = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        block = docs.sparkSession.sparkContext.broadcast([(n, s) for n, r in enumerate(rows.distinct().toLocalIterator()) if (s := normal(r["t"]))])
        docs = docs.mapInArrow(tidy(_keeper(block, rate, at)), docs.schema)
        if b + 1 < blocks:
            docs = cut(docs, "clean-so-far")
    return docs


def _keeper(block, rate: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, rate)
        for batch in batches:
            yield batch.filter(pa.array([not t or next(matcher.search(normal(t)), None) is None for t in strings(batch.column(at))], pa.bool_()))

    return run
