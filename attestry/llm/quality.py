"""Quality rules with n-gram perplexity (operator 9).

Spark counts letter 5-grams of all documents by language; from these tables come modified Kneser-Ney probabilities of
orders 5 to 1, kept as sorted arrays of n-gram hashes with log probability and log back-off weight. A document is
rejected where its perplexity leaves its language's band, above or below, or where it breaks a base rule.

A language's symbols are its own characters in lower case, the most frequent ALPHABET of them; digits are one symbol, runs
of white space another, and all rarer characters a third. So the model grows with what a corpus holds. What is broadcast at once
is bounded: languages are scored in rounds, and a language beyond the bound in parts. A part has all n-grams whose last
symbol but one, and all contexts whose last symbol, is in its share of the alphabet, so that each position is scored by one part whole.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.minhash import mix64
from attestry.llm.shared import cut, small, strings, tidy

ORDER, BITS = 5, 12
#: Symbols of a language: its most frequent characters by number, after the two that every language has.
ALPHABET = (1 << BITS) - 2
_START, _RARE = 0, 1
#: Characters of texts looked at together (a longer text: its pieces), and model entries (16 bytes each) that are broadcast in a round, unless one part has more.
SEGMENT, ROUND_ENTRIES = 1 << 18, 8 << 20
#: The band's half-width: interquartile ranges beyond the quartiles, and natural-log units over the root of the length for short texts.
BAND_IQR, BAND_SHORT = 2.0, 3.0
#: Fixed values of the contract.
SIGNS, BLANKS, WINDOW = b"#*$%&|<>", b" \t\n\v\f\r", 5
_BLANK, _DIGIT = 32, 48
#: Kinds of bytes of UTF-8: white space, signs, those of a character after its first; and for hashes of words, an odd number and one for each byte.
_WHITE, _SIGN, _LATER = 1, 2, 3
_KINDS = bytes(_WHITE if b in BLANKS else _SIGN if b in SIGNS else _LATER if 128 <= b < 192 else 0 for b in range(256))
_ODD, _BYTES = 0x9E3779B97F4A7C15, mix64(np.arange(1, 257, dtype=np.uint64))


def characters(*texts: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of texts in lower case, and which text each is from; digits are 0, and a run of white space is one blank. One text comes piece by piece, several come as one piece."""
    low, before = [(t or "").lower() for t in texts], np.zeros(1, np.uint32)
    sizes, whole = [len(t) for t in low], "".join(low)
    step = SEGMENT if len(texts) == 1 else max(len(whole), 1)
    for i in range(0, len(whole), step):
        a = np.frombuffer(whole[i : i + step].encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        of = np.repeat(np.arange(len(texts)), sizes) if len(texts) > 1 else np.zeros(len(a), np.int64)
        a[((a >= 9) & (a <= 13)) | (a == 0xA0)] = _BLANK
        a[(a >= 48) & (a <= 57)] = _DIGIT
        one = (a != _BLANK) | (np.concatenate([before, a[:-1]]) != _BLANK)
        one[borders(of)] = True
        a, of = a[one], of[one]
        if len(a):
            before = a[-1:]
            yield a, of


def borders(of: np.ndarray) -> np.ndarray:
    """Where a text begins that is not the first."""
    return np.flatnonzero(of[1:] != of[:-1]) + 1


def together(langs: list[str], texts: Iterator[str | None]) -> Iterator[tuple[str, list[int], list[str | None]]]:
    """(language, places, texts) of rows of one language that have SEGMENT characters together, unless one alone has more."""
    held: dict[str, tuple[list[int], list[str | None]]] = {}
    sizes: dict[str, int] = {}
    for k, (lang, text) in enumerate(zip(langs, texts)):
        n = len(text or "")
        if lang in held and sizes[lang] + n > SEGMENT:
            yield lang, *held.pop(lang)
        if lang not in held:
            held[lang], sizes[lang] = ([], []), 0
        held[lang][0].append(k)
        held[lang][1].append(text)
        sizes[lang] += n
    for lang, (places, own) in held.items():
        yield lang, places, own


class Alphabets:
    """Symbols by language: from (language, code points by number)."""

    def __init__(self, found: dict[str, np.ndarray]) -> None:
        self.found = found
        self.table = lru_cache(maxsize=8)(self._table)

    def _table(self, lang: str) -> np.ndarray:
        out = np.full(0x110000, _RARE, np.uint16)
        own = self.found.get(lang, ())
        out[own] = np.arange(_RARE + 1, _RARE + 1 + len(own))
        return out

    def __reduce__(self):
        return Alphabets, (self.found,)

    def size(self, lang: str) -> int:
        """Symbols that may follow: the language's own and the rare one."""
        return len(self.found.get(lang, ())) + 1

    def grams_of(self, lang: str, *texts: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the 5-grams that end at each symbol of texts of a language, and which text each is from, in the pieces of characters()."""
        tail = np.full(ORDER - 1, _START, np.int64)
        for piece, of in characters(*texts):
            a = np.concatenate([tail, self.table(lang)[piece].astype(np.int64)])
            keys = a[: len(piece)].copy()
            for j in range(1, ORDER):
                keys <<= BITS
                keys |= a[j : len(piece) + j]
            for j in range(ORDER - 1):  # a text's first symbols have START before them, which is 0
                at = borders(of) + j
                keys[at[at < len(keys)]] &= mask(j + 1)
            yield keys, of
            tail = a[-(ORDER - 1) :]

    def grams(self, lang: str, *texts: str | None) -> Iterator[np.ndarray]:
        """The keys alone."""
        return (keys for keys, _ in self.grams_of(lang, *texts))


def mask(n: int) -> int:
    return (1 << BITS * n) - 1


def gram_hash(order: int, keys: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.uint64) | np.uint64(order << 60))


def _counter(keys_of):
    """Counts by language, summed over a task's whole input unless they grow past some millions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        held: dict = {}
        size = 0

        def fold() -> None:
            for lang, parts in held.items():
                k, c = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    k, at = np.unique(np.concatenate([sums[lang][0], k]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([sums[lang][1], c])).astype(np.int64)
                sums[lang] = (k, c)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (k, c) in sums.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "k": pa.array(k.astype(np.int64), pa.int64()), "c": pa.array(c.astype(np.int64), pa.int64())})
            sums.clear()

        for batch in batches:
            for lang, _, texts in together(batch.column("lang").to_pylist(), strings(batch.column("text"))):
                for keys in keys_of(lang, *texts):
                    held.setdefault(lang, []).append(keys)
                    size += len(keys)
                    if size >= 2 << 20:
                        fold()
                        size = 0
                        if sum(len(k) for k, _ in sums.values()) > 2 << 20:
                            yield from out()
        fold()
        yield from out()

    return tidy(run)


def counted(rows: DataFrame, keys_of) -> DataFrame:
    """(lang, k, c): how often each key stands in the texts of a language."""
    return rows.filter("text IS NOT NULL").select("lang", "text").mapInArrow(_counter(keys_of), "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c"))


def alphabets(rows: DataFrame, most: int = ALPHABET) -> Alphabets:
    """The `most` most frequent characters of each language, by code point among equals. The driver sees these alone."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("c"), "k"))
    found: dict[str, list[int]] = {}
    for lang, k in counted(rows, lambda _, *texts: (a for a, _ in characters(*texts))).withColumn("r", rank).filter(F.col("r") <= most).orderBy("lang", "r").select("lang", "k").collect():
        found.setdefault(lang, []).append(k)
    return Alphabets({lang: np.array(k, np.int64) for lang, k in found.items()})


def kneser_ney(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, n, k, logp, backoff) from counts (lang, k, c) of 5-grams and sizes (lang, v) of alphabets: interpolated modified Kneser-Ney.

    Order 5 has the counts, lower orders the number of different symbols seen before an n-gram. Discounts come from a
    language's numbers of n-grams of count 1 to 4; order 1 is mixed with the uniform distribution over symbols. logp is null where an n-gram
    is only a context, backoff where it is none; n = 0 is the empty context.
    """
    level = cut(counts.select("lang", F.lit(ORDER).alias("n"), "k", "c"), "quality-grams")
    levels = [level]
    for n in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.col("k").bitwiseAND(F.lit(mask(n))).alias("k")).agg(F.count("*").alias("c")).select("lang", F.lit(n).alias("n"), "k", "c"))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    every = cut(every, "quality-levels")
    of = [F.count_if(F.col("c") == j).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def discount(j: int) -> Column:
        d = j - (j + 1) * y * F.try_divide(F.col(f"n{j + 1}"), F.col(f"n{j}"))
        return F.least(F.greatest(F.coalesce(d, F.lit(0.5 * j)), F.lit(0.1)), F.lit(j - 0.1)).alias(f"d{j}")

    disc = every.groupBy("lang", "n").agg(*of).select("lang", "n", *[discount(j) for j in (1, 2, 3)])
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    held = every.join(small(cut(disc, "quality-discounts")), ["lang", "n"]).withColumns({"d": d, "h": F.shiftright("k", BITS)}).select("lang", "n", "k", "h", "c", "d")
    context = cut(held.groupBy("lang", "n", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("mass")).withColumn("gamma", F.col("mass") / F.col("total")), "quality-contexts")
    alpha = cut(held.join(context, ["lang", "n", "h"]).select("lang", "n", "k", ((F.col("c") - F.col("d")) / F.col("total")).alias("a"), "gamma"), "quality-alphas")
    p = alpha.filter("n = 1").join(small(sizes), "lang").select("lang", "k", (F.col("a") + F.col("gamma") / F.col("v")).alias("p"))
    found = [p.withColumn("n", F.lit(1))]
    for n in range(2, ORDER + 1):
        lower = found[-1].select("lang", F.col("k").alias("s"), F.col("p").alias("q"))
        own = alpha.filter(F.col("n") == n).withColumn("s", F.col("k").bitwiseAND(F.lit(mask(n - 1))))
        p = own.join(lower, ["lang", "s"]).select("lang", "k", (F.col("a") + F.col("gamma") * F.col("q")).alias("p"))
        found.append(cut(p, "quality-order").withColumn("n", F.lit(n)))
    seen = found[0]
    for f in found[1:]:
        seen = seen.unionByName(f)
    back = context.select("lang", (F.col("n") - 1).alias("n"), F.col("h").alias("k"), F.ln("gamma").alias("backoff"))
    return seen.select("lang", "n", "k", F.ln("p").alias("logp")).join(back, ["lang", "n", "k"], "full_outer")


def pivot() -> Column:
    """The symbol by which an entry is asked for in a position: its last but one where it is an n-gram, its last where it is a context; null for those that all parts need.

    An entry that is both is in two parts.
    """
    last, before = F.col("k").bitwiseAND(F.lit(mask(1))), F.shiftright("k", BITS).bitwiseAND(F.lit(mask(1)))
    return F.when(F.col("n") < 2, F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array(F.when(F.col("logp").isNotNull(), before).otherwise(last), F.when(F.col("backoff").isNotNull(), last).otherwise(before))))


class Model:
    """N-grams of a language, or of a part of its alphabet: sorted hashes with log probabilities and log back-off weights.

    Hashes are even over their range, so a table by their first bits says where a search begins, a step or two before its end.
    """

    def __init__(self, size: int, parts: int, part: int, hashes: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> None:
        self.parts, self.part, self.hashes, self.logp, self.backoff = parts, part, hashes, logp, backoff
        empty = hashes[:1] == gram_hash(0, np.zeros(1, np.int64))  # of the empty context, which is the smallest hash
        self.unseen = float(backoff[:1][empty].sum()) - np.log(size)  # of a symbol that the language never has
        bits = len(hashes).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.uint32)
        for i in range(0, len(hashes), SEGMENT):
            at, n = np.unique(hashes[i : i + SEGMENT] >> self.shift, return_counts=True)
            self.first[at.astype(np.int64) + 1] += n.astype(np.uint32)
        np.cumsum(self.first, out=self.first)

    def _find(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = gram_hash(order, keys)
        at = np.minimum(self.first[(h >> self.shift).astype(np.int64)], len(self.hashes) - 1)
        got = self.hashes[at]
        late = np.flatnonzero(got < h)
        while len(late):
            late = late[at[late] < len(self.hashes) - 1]
            at[late] += 1
            got[late] = self.hashes[at[late]]
            late = late[got[late] < h[late]]
        return at, got == h

    def each(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of the last symbols of 5-grams; 0 for those of other parts."""
        out = np.zeros(len(keys))
        todo = np.flatnonzero((keys >> BITS & mask(1)) % self.parts == self.part) if self.parts > 1 else np.arange(len(keys))
        keys, rest = keys[todo], np.zeros(len(todo))
        for n in range(ORDER, 0, -1):
            at, hit = self._find(n, keys & mask(n))
            logp = self.logp[at]
            hit &= ~np.isnan(logp)
            out[todo[hit]] = logp[hit] + rest[hit]
            todo, keys, rest = todo[~hit], keys[~hit], rest[~hit]
            if not len(todo):
                return out
            if n > 1:
                at, hit = self._find(n - 1, keys >> BITS & mask(n - 1))
                rest += np.where(hit, self.backoff[at], 0)
        out[todo] = rest + self.unseen
        return out

    def score(self, keys: np.ndarray) -> float:
        """The sum of log probabilities of the last symbols of 5-grams, those of this part."""
        return float(self.each(keys).sum())


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words that is found twice or more, the first included."""
    if len(words) < WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    n = len(ids) - WINDOW + 1
    h = ids[:n].copy()
    for j in range(1, WINDOW):
        h = mix64(h) + ids[j : n + j]
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    marks = np.zeros(len(ids) + 1, np.int64)
    twice = np.flatnonzero(times[at] > 1)
    marks[twice] += 1
    np.subtract.at(marks, twice + WINDOW, 1)
    return int((np.cumsum(marks) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; words are runs of anything but ASCII white space."""
    return tuple(int(c[0]) for c in base_counts_of([(text or "").encode()]))


def base_counts_of(texts: list[bytes]) -> list[np.ndarray]:
    """base_counts() of texts in UTF-8, a column each. Hashes say which texts may have a window twice; only these are counted word by word, by the words themselves."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    whole, has = b"".join(texts), np.flatnonzero(sizes)
    data, kind = np.frombuffer(whole, np.uint8), np.frombuffer(whole.translate(_KINDS), np.uint8)

    def by_text(marks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        if len(has):
            out[has] = np.add.reduceat(marks, (ends - sizes)[has], dtype=np.int64)
        return out

    inside = kind != _WHITE
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    new = (ends - sizes)[has]
    begins[new] = inside[new]
    n_words = by_text(begins)
    starts = np.flatnonzero(begins)
    of = np.repeat(np.arange(len(texts)), n_words)
    repeat, dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k in twice(data, inside, starts, of) if len(data) <= SEGMENT else range(len(texts)):
        repeat[k] = repeated_words(texts[k].split())
    for k in np.flatnonzero(by_text(data == 10)):
        dup[k] = repeated_lines(texts[k])
    return [n_words, by_text(inside & (kind != _LATER)), by_text(kind == _SIGN), dup, repeat]


def twice(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, of: np.ndarray) -> list[int]:
    """Texts in which two windows of words have the same hash; all that have a window twice are among them.

    A word's hash is the sum of its bytes, each times an odd number to the power of its place, from differences of running sums over all texts.
    """
    n = len(starts) - WINDOW + 1
    if n < 1:
        return []
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(inside, _BYTES[data], 0) * _powers(_ODD, SEGMENT)[: len(data)], out=sums[1:])
    # white space adds nothing, so a word's sum reaches to the next word's start; the inverse power takes its place out of it
    words = mix64(np.diff(sums[np.append(starts, len(data))]) * _powers(pow(_ODD, -1, 1 << 64), SEGMENT)[starts])
    h = words[:n].copy()
    for j in range(1, WINDOW):
        h *= np.uint64(_ODD)
        h += words[j : n + j]
    within = of[:n] == of[WINDOW - 1 :]
    bits = np.uint64(int(of[-1]).bit_length())
    h = np.sort(mix64(h[within]) >> bits << bits | of[:n][within].astype(np.uint64))
    return np.unique(h[1:][h[1:] == h[:-1]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64).tolist()


@lru_cache(maxsize=2)
def _powers(x: int, n: int) -> np.ndarray:
    """x to the powers 0 to n - 1, modulo 2 to the 64."""
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def counts_in(column: pa.Array) -> list[np.ndarray]:
    """base_counts() of an Arrow column of texts, some of SEGMENT bytes together at a time, unless one alone has more."""
    found, held, size = [], [], 0
    for text in strings(column.cast(pa.binary())):
        text = text or b""
        if held and size + len(text) > SEGMENT:
            found.append(base_counts_of(held))
            held, size = [], 0
        held.append(text)
        size += len(text)
    found.append(base_counts_of(held))
    return [np.concatenate(c) for c in zip(*found)]


def _scorer(models, symbols, first: bool):
    """Adds what the round's models say of each row's text to its total; the first round also makes the counts of the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[Model]] = {}
        for (lang, *_), m in models.value.items():
            own.setdefault(lang, []).append(Model(*m))
        signs = symbols.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows) if first else batch.column("total").to_numpy().copy()
            for lang, places, texts in together(batch.column("lang").to_pylist(), strings(batch.column("text"))):
                for keys, of in signs.grams_of(lang, *texts) if first or lang in own else ():
                    n[places] += np.bincount(of, minlength=len(texts))
                    for m in own.get(lang, ()):
                        total[places] += np.bincount(of, m.each(keys), len(texts))
            made = [*counts_in(batch.column("text")), n, total] if first else [total]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 3 if first else -1], *map(pa.array, made)], ["doc_id", "lang", "text", *_BASE, "n_grams", "total"])

    return tidy(run)


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCORED = "doc_id long, lang string, text string, " + ", ".join(f"{c} long" for c in _BASE) + ", n_grams long, total double"


def bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high) of mean negative log probability: the exact quartiles of all documents, moved out by BAND_IQR interquartile ranges.

    Scores have four decimals, so each language has few distinct ones: they are counted first, and quartiles are read off
    the counts.
    """
    counts = cut(scored.filter("nll IS NOT NULL").groupBy("lang", "nll").agg(F.count("*").alias("c")), "quality-scores")
    at = lambda q: F.expr(f"percentile(nll, {q}, c)")
    quartiles = counts.groupBy("lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.02)) * BAND_IQR
    return quartiles.select("lang", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each row of docs: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity, band_low, band_high, kept.

    A null language is a language of its own (`und`). A text without symbols, so a null or an empty one, has null perplexity and no words, and fails the base
    rule on them. A band is as wide as all documents of its language ask for, and wider for short texts, whose mean varies by the root of their length.
    Repeated rows each keep their row and count as often as they stand there; other columns are not read. No documents: no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    spark, found = docs.sparkSession, alphabets(rows)
    symbols = spark.sparkContext.broadcast(found)
    counts = counted(rows, lambda lang, *texts: symbols.value.grams(lang, *texts))
    sizes = spark.createDataFrame([(name, found.size(name)) for name in found.found], "lang string, v int")
    model = cut(kneser_ney(counts, sizes), "quality-model")
    scored = rows
    for k, names in enumerate(model_rounds(model, found)):
        if k:  # chained rounds would each keep a worker with its part of the models
            scored = cut(scored, "quality-round")
        scored = scored.mapInArrow(_scorer(spark.sparkContext.broadcast(names), symbols, k == 0), _SCORED)
    nll = F.round(-F.col("total") / F.when(F.col("n_grams") > 0, F.col("n_grams")), 4)
    scored = cut(scored.select("doc_id", "lang", *_BASE, "n_grams", nll.alias("nll")), "quality-scored")
    slack = F.lit(BAND_SHORT) / F.sqrt(F.greatest("n_grams", F.lit(1)).cast("double"))
    inside = F.col("nll").between(F.col("low") - slack, F.col("high") + slack)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.join(small(cut(bands(scored), "quality-bands")), "lang", "left").select(
        "doc_id", "lang", *_BASE, failed.alias("base_failed"), F.exp("nll").alias("perplexity"), F.exp(F.col("low") - slack).alias("band_low"),
        F.exp(F.col("high") + slack).alias("band_high"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams by hash. Its first bit is turned, so that signed numbers sort as unsigned ones."""
    for batch in batches:
        n, k = batch.column("n").to_numpy(), batch.column("k").to_numpy()
        h = mix64(k.astype(np.uint64) | n.astype(np.uint64) << np.uint64(60)) ^ np.uint64(1 << 63)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("logp"), batch.column("backoff")], ["h", "logp", "backoff"])


def model_rounds(model: DataFrame, found: Alphabets) -> Iterator[dict]:
    """What is broadcast round by round: models by (language, parts, part), ROUND_ENTRIES entries together, unless one alone has more. Spark sorts them, once."""
    todo = []
    for name, n in sorted(model.groupBy("lang").count().collect()):
        parts = -(-n // ROUND_ENTRIES)
        todo += [(name, parts, part, n // parts) for part in range(parts)]
    held, size = {}, 0
    for name, parts, part, n in todo:
        if held and size + n > ROUND_ENTRIES:
            yield held
            held, size = {}, 0
        own = model.filter(F.col("lang") == name)
        if parts > 1:
            own = own.filter(F.exists(pivot(), lambda p: p.isNull() | (p % parts == part)))
        own = own.select("n", "k", F.col("logp").cast("float").alias("logp"), F.coalesce("backoff", F.lit(0.0)).cast("float").alias("backoff"))
        t = own.mapInArrow(_hashed, "h long, logp float, backoff float").orderBy("h").toArrow()
        held[name, parts, part] = (found.size(name), parts, part, t.column("h").to_numpy().view(np.uint64) ^ np.uint64(1 << 63), t.column("logp").to_numpy(), t.column("backoff").to_numpy())
        size += n
    if held or not todo:
        yield held
