"""Licence detection by ordered signature rules (operator 7).

Texts become lower-case words. One pass finds which rules' keywords occur, only those rules' regexes are tried, and of
overlapping detections one that lies within another of a higher section, or a longer one of its own, is dropped.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import license_rules
from attestry.llm.shared import strings, tidy

#: Fixed values of the contract: phrases whose every place is reported, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Sections in order of priority, with the standing that a detection gives.
SECTIONS = ((license_rules.TAGS, 0.99), (license_rules.TEXTS, 0.95), (license_rules.NAMES, 0.8))
#: By byte: A-Z to lower case, all else below 0x80 but letters and digits to a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@cache
def rules() -> list[tuple[str, str, re.Pattern, int, float]]:
    """(label, keyword, pattern, priority, standing), highest priority first."""
    out = []
    for k, (section, standing) in enumerate(SECTIONS):
        for line in filter(None, section.split("\n")):
            label, keyword, pattern = line.split(" ~ ")
            out.append((label, keyword, re.compile(rf"(?<!\S){pattern}(?!\S)"), len(SECTIONS) - k, standing))
    return out


@cache
def _gate() -> ahocorasick.Automaton:
    gate, by = ahocorasick.Automaton(), {}
    for n, (_, keyword, *_) in enumerate(rules()):
        by.setdefault(keyword, []).append(n)
    for keyword, found in by.items():
        gate.add_word(keyword, tuple(found))
    gate.make_automaton()
    return gate


def words(text: str | None) -> list[bytes]:
    """Runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z."""
    return (text or "").encode().translate(_BYTES).split()


def phrase_places(norm: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of all places of the phrases, overlapping ones too."""
    out, padded = [], f" {norm} "
    for phrase, label in PHRASES:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, at + len(phrase), label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out)


def detections(norm: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, standing) of the rules' detections that no other suppresses, by place.

    A detection goes if one of a higher section contains it, or one of its own section that is longer or, of the same place, of
    an earlier rule. In the order of their starts this is a look at how far earlier ones reach, so it takes n log n steps.
    """
    asked = sorted({n for _, found in _gate().iter(norm) for n in found})
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for n in asked:
        hits.setdefault(rules()[n][3], []).extend((m.start(), -m.end(), n) for m in rules()[n][2].finditer(norm))
    kept: list[tuple[int, int, str, float]] = []
    for priority in sorted(hits, reverse=True):
        starts, tops = [k[0] for k in kept], list(accumulate((k[1] for k in kept), max))
        reach, found = -1, []
        for a, minus, n in sorted(hits[priority]):
            b, at = -minus, bisect_right(starts, a)
            if max(reach, tops[at - 1] if at else -1) < b:
                found.append((a, b, rules()[n][0], rules()[n][4]))
            reach = max(reach, b)
        kept = sorted(kept + found)
    return kept


_SPAN = pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("standing", pa.float64()), ("phrase", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, spans = [], []
        for text in strings(batch.column(1)):
            w = words(text)
            n_words.append(len(w))
            norm = b" ".join(w).decode()
            hits = [(a, b, label, 1.0, True) for a, b, label in phrase_places(norm)] + [(*d, False) for d in detections(norm)]
            starts = list(accumulate((len(x) + 1 for x in norm.split(" ")), initial=0)) if hits else []
            spans.append([
                {"label": label, "start_word": bisect_right(starts, a) - 1, "end_word": bisect_left(starts, b), "standing": standing, "phrase": phrase}
                for a, b, label, standing, phrase in hits
            ])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "n_words", "spans"])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans): a row for each row of docs, in place: nothing is shuffled.

    A span has label, first word, word after the last, standing (0 to 1), and whether it is a place of one of the fixed phrases,
    which are all kept; of the rules' detections those survive that no better one contains. A null or an empty text has no
    words and no spans; a null doc_id and repeated rows are kept as they are. Other columns are not read.
    """
    schema = "doc_id long, n_words long, spans array<struct<label:string,start_word:long,end_word:long,standing:double,phrase:boolean>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_scan), schema)
