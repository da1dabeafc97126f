"""Phrase collocations from suffix subtrees that are built group by group (operator 13).

Every word of a piece starts a suffix of at most `longest` words, cut at the piece's end. Word prefixes of suffixes are grouped in byte order so that a group's
suffixes fit a memory budget; a prefix beyond the budget is replaced by the prefixes one word longer. Each group's subtree is built by itself as sorted
leaves with totals, and the count of any phrase is the sum of the totals of the leaves below it.
"""

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestry.llm.shared import cut, join_split, small, tidy

#: Words of a phrase at most. Three ids of 21 bits make the key of a leaf.
LONGEST = 3
_BITS = 21
#: Suffixes of a group at most, so a subtree is built in some 100 MB (a group of unlike words only, 500 MB); fewer where that leaves tasks without a group.
SUFFIXES = 2_000_000
#: Words that a task gathers before it sorts their suffixes; no more than ids have bits for.
CHUNK = 2_000_000
#: Bytes of a text that are cut into words at a time.
SEGMENT = 1 << 20
#: Fixed values of the contract: characters that end a piece, and that part words.
PIECE_ENDS, WORD_GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_UPPER, _LOWER, _MARK = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"\xff"
_TABLE = bytes.maketrans(_UPPER + PIECE_ENDS + WORD_GAPS, _LOWER + _MARK * len(PIECE_ENDS) + b"  ")


def tokens(text: bytes, segment: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, and the byte 0xff (no UTF-8 has it) where a piece ends; some `segment` bytes at a time, cut between words."""
    text, start = text.translate(_TABLE), 0
    while start < len(text):
        end = min((x for x in (text.find(b" ", start + segment), text.find(_MARK, start + segment)) if x >= 0), default=len(text))
        yield text[start:end].replace(_MARK, b" \xff ").split()
        start = end


class _Ids(dict):
    """Words numbered as they come; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Text:
    """The words of one language in a chunk. A text that goes on in the next chunk leaves its last words to it, as suffixes that start there see what follows."""

    def __init__(self, before: list[bytes]) -> None:
        self.words, self.runs, self.last = _Ids({_MARK: 0}), [], []
        self.add(before)

    def add(self, some: list[bytes]) -> None:
        self.runs.append(np.fromiter(map(self.words.__getitem__, some), np.int64, len(some)))
        self.last = [*self.last, *some][1 - LONGEST :]

    def close(self) -> None:
        self.runs.append(np.zeros(1, np.int64))
        self.last = []

    def sorted(self) -> tuple[list[bytes], np.ndarray, int]:
        """The vocabulary in byte order; the text as places in it from 1 on, with LONGEST zeros behind it; and how many of them start suffixes of this chunk."""
        ids = np.concatenate([*self.runs, np.zeros(LONGEST, np.int64)])
        words = sorted(w for w in self.words if w != _MARK)
        place = np.zeros(len(words) + 1, np.int64)
        place[[self.words[w] for w in words]] = np.arange(1, len(words) + 1)
        return words, place[ids], len(ids) - LONGEST - len(self.last)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray, int]]:
    """lang and _Text.sorted() for each language of about `size` words, from batches of lang and text as bytes."""
    held, n = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            own = held.get(lang) or held.setdefault(lang, _Text([]))
            for some in tokens(text.as_py()):
                own.add(some)
                n += len(some)
                if n >= size:
                    yield from ((k, *v.sorted()) for k, v in held.items())
                    own = _Text(own.last)
                    held, n = {lang: own}, 0
            own.close()
            n += 1
    yield from ((k, *v.sorted()) for k, v in held.items())


def _word_counts(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, starts in _chunks(batches, size):
            n = np.bincount(ids[:starts], minlength=len(words) + 1)[1:]
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.binary()), "w1": pa.array([words[i] for i in seen.tolist()], pa.binary()), "n": pa.array(n[seen], pa.int64())})

    return tidy(run)


def _pair_counts(size: int, heavy: set[tuple[bytes, bytes]]) -> Callable:
    """Counts of the two-word prefixes of heavy words; the second is empty where the piece ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, starts in _chunks(batches, size):
            is_heavy = np.zeros(len(words) + 1, bool)
            is_heavy[1:] = [(lang, w) in heavy for w in words]
            at = np.flatnonzero(is_heavy[ids[:starts]])
            pairs, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
            first, second = (pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(pairs), pa.binary()), "w1": pa.array([words[i - 1] for i in first], pa.binary()), "w2": pa.array([words[i - 1] if i else b"" for i in second], pa.binary()), "n": pa.array(n, pa.int64())})

    return tidy(run)


def _borders(budget: int) -> Callable:
    """From prefixes in byte order, those that begin a group: as long as the budget holds, the next prefix joins the group. One beyond the budget is a group alone, in so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n, begins, parts = batch.column("n").to_pylist(), [], []
            for x in n:
                begins.append(held is None or held + x > budget)
                held = x if begins[-1] else held + x
                parts.append(-(-x // budget))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("lang", "w1", "w2")} | {"parts": pa.array(parts, pa.int64())}).filter(pa.array(begins, pa.bool_()))

    return run


def vertical_partition(texts: DataFrame, counts: DataFrame, budget: int, size: int = CHUNK) -> tuple[list[tuple[bytes, bytes, bytes, int]], set[tuple[bytes, bytes]]]:
    """The groups' first prefixes (lang, w1, w2, parts) in byte order, and the words (lang, w1) whose subtree lies in several groups.

    counts are those of words (lang, w1, n). The driver gets no more than two prefixes a budget of words, and one a task. A prefix of two words
    beyond the budget is dealt out by its third words.
    """
    heavy = {(bytes(r["lang"]), bytes(r["w1"])) for r in counts.filter(F.col("n") > budget).collect()}
    light = counts.filter(F.col("n") <= budget).select("lang", "w1", F.lit(b"").alias("w2"), "n")
    if heavy:
        pairs = texts.mapInArrow(_pair_counts(size, heavy), "lang binary, w1 binary, w2 binary, n long")
        light = light.unionByName(pairs.groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")))
    order = ["lang", "w1", "w2"]
    found = light.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_borders(budget), "lang binary, w1 binary, w2 binary, parts long")
    return sorted((bytes(r["lang"]), bytes(r["w1"]), bytes(r["w2"]), r["parts"]) for r in found.collect()), heavy


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed differences, byte by byte."""
    return zlib.compress(np.ascontiguousarray(np.diff(numbers, prepend=numbers.dtype.type(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).tobytes(), np.int64))


def _split3(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << _BITS) - 1
    return keys >> 2 * _BITS, keys >> _BITS & low, keys & low


_BLOB = "grp long, part long, lang binary, words binary, leaves binary, totals binary"


def _suffixes(size: int, borders: list[tuple[bytes, bytes, bytes, int]]) -> Callable:
    """Chunks to a row for each group: its distinct suffixes, as words of a vocabulary of their own, with how often each stands in the chunk."""
    starts_of = [b[0] for b in borders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, starts in _chunks(batches, size):
            s1, s2, s3 = ids[:starts], ids[1 : starts + 1], ids[2 : starts + 2]
            keys = s1 << 2 * _BITS | s2 << _BITS | np.where(s2 > 0, s3, 0)
            keys, totals = np.unique(keys[s1 > 0], return_counts=True)
            low = bisect_left(starts_of, lang)
            own = borders[low : bisect_left(starts_of, lang + b"\0", low)]
            cuts = []
            for _, w1, w2, _ in own:
                at = bisect_left(words, w1)
                known = at < len(words) and words[at] == w1
                cuts.append((at + 1) << 2 * _BITS | ((bisect_left(words, w2) + 1) << _BITS if known and w2 else 0))
            edges = [0, *np.searchsorted(keys, np.array(cuts, np.int64)).tolist(), len(keys)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if a == b:
                    continue
                parts = own[k - 1][3] if k else 1
                rows = [(0, slice(a, b))]
                if parts > 1:
                    third = _split3(keys[a:b])[2]
                    part = np.array([0, *(zlib.crc32(w) % parts for w in words)])[third]
                    rows = [(p, a + np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
                for p, which in rows:
                    used, place = np.unique(np.concatenate(_split3(keys[which])), return_inverse=True)
                    place = place.astype(np.int64) + (used[0] > 0)  # 0 stays the piece's end
                    x, y, z = np.split(place, 3)
                    yield pa.RecordBatch.from_pydict({
                        "grp": pa.array([low - 1 + k], pa.int64()), "part": pa.array([p], pa.int64()), "lang": pa.array([lang], pa.binary()),
                        "words": pa.array([zlib.compress(b" ".join(words[i - 1] for i in used.tolist() if i), 1)], pa.binary()),
                        "leaves": pa.array([_packed(x << 2 * _BITS | y << _BITS | z)], pa.binary()), "totals": pa.array([zlib.compress(totals[which].astype(np.uint32).tobytes(), 1)], pa.binary()),
                    })

    return tidy(run)


class _Subtree:
    """The suffixes of a group in one language, merged to distinct leaves."""

    def __init__(self) -> None:
        self.words, self.upper, self.third, self.totals = _Ids({_MARK: 0}), [], [], []

    def add(self, words: bytes, leaves: bytes, totals: bytes) -> None:
        known = zlib.decompress(words).split(b" ")
        place = np.array([0, *map(self.words.__getitem__, known)], np.int64)
        x, y, z = _split3(_unpacked(leaves))
        self.upper.append(place[x] << 32 | place[y])
        self.third.append(place[z].astype(np.uint32))
        self.totals.append(np.frombuffer(zlib.decompress(totals), np.uint32))

    def counts(self, least: int, is_split: Callable[[bytes], bool], split_pairs: set[bytes]) -> Iterator[tuple[list[bytes], list[int], np.ndarray, np.ndarray]]:
        """Nodes depth by depth: phrases, their words, totals, and whether other groups have leaves below them too. Whole ones under `least` are left out."""
        upper, third, totals = np.concatenate(self.upper), np.concatenate(self.third), np.concatenate(self.totals).astype(np.int64)
        order = np.lexsort((third, upper))
        upper, third, totals = upper[order], third[order], totals[order]
        name = [b"", *(w for w in self.words if w != _MARK)]
        in_parts = np.array([False, *map(is_split, name[1:])])
        first, second = upper >> 32, upper & 0xFFFFFFFF
        for depth, at, real in ((1, first, first > 0), (2, upper, second > 0), (3, None, third > 0)):
            change = np.r_[True, upper[1:] != upper[:-1]] if depth > 1 else np.r_[True, first[1:] != first[:-1]]
            if at is None:
                change |= np.r_[True, third[1:] != third[:-1]]
            node = np.flatnonzero(change)
            n = np.add.reduceat(totals, node)
            split = np.zeros(len(node), bool)
            if depth == 1:
                split = in_parts[first[node]]
            elif depth == 2 and split_pairs:
                split[:] = [b" ".join((name[a], name[b])) in split_pairs for a, b in zip(first[node].tolist(), second[node].tolist())]
            keep = real[node] & ((n >= least) | split)
            node, n, split = node[keep], n[keep], split[keep]
            ids = [c[node].tolist() for c in (first, second, third)[:depth]]
            yield [b" ".join(name[i] for i in t) for t in zip(*ids)], [depth] * len(node), n, split


def _subtrees(least: int, heavy: set[tuple[bytes, bytes]], borders: list[tuple[bytes, bytes, bytes, int]]) -> Callable:
    """Groups to nodes. A word is split if it is heavy, two words if their group has parts; longer phrases never are."""
    split_pairs: dict[bytes, set[bytes]] = {}
    for lang, w1, w2, parts in borders:
        if parts > 1:
            split_pairs.setdefault(lang, set()).add(w1 + b" " + w2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(lang: bytes, tree: _Subtree) -> Iterator[pa.RecordBatch]:
            for phrases, words, n, split in tree.counts(least, lambda w: (lang, w) in heavy, split_pairs.get(lang, set())):
                if phrases:
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(phrases), pa.binary()), "phrase": pa.array(phrases, pa.binary()), "words": pa.array(words, pa.int32()), "n": pa.array(n, pa.int64()), "split": pa.array(split, pa.bool_())})

        now, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                grp, part, lang, words, leaves, totals = (batch.column(c)[i].as_py() for c in range(6))
                if (grp, part, lang) != now:
                    if tree:
                        yield from nodes(now[2], tree)
                    now, tree = (grp, part, lang), _Subtree()
                tree.add(words, leaves, totals)
        if tree:
            yield from nodes(now[2], tree)

    return tidy(run)


def phrase_counts(docs: DataFrame, least: int, lang: str = "lang", text: str = "text", suffixes: int = SUFFIXES, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of one to LONGEST words with n >= least, and (lang, n) of all words.

    A null text has no words, a null lang is `und`. Repeated documents count as often as they stand. Texts of any length are read in segments. Empty tables
    give empty results.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    words = texts.mapInArrow(_word_counts(size), "lang binary, w1 binary, n long").groupBy("lang", "w1").agg(F.sum("n").alias("n"))
    words = cut(words, "phrase-words")
    sizes = cut(words.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n")), "phrase-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    budget = max(1, min(suffixes, total // (2 * tasks)))
    borders, heavy = vertical_partition(texts, words, budget, size)
    groups = texts.mapInArrow(_suffixes(size, borders), _BLOB)
    dealt = groups.repartition(max(tasks, len(borders)), "grp", "part").sortWithinPartitions("grp", "part", "lang")
    nodes = cut(dealt.mapInArrow(_subtrees(least, heavy, borders), "lang binary, phrase binary, words int, n long, split boolean"), "phrase-nodes")
    nodes = nodes.withColumns({"lang": F.col("lang").cast("string"), "phrase": F.col("phrase").cast("string")})
    shared = nodes.filter("split").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return nodes.filter("NOT split").drop("split").unionByName(shared), sizes


def _part(first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def cut_scores(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words or more: of all cuts the one of the smallest score 1000000 * a * a div (l * r), then of the shortest first part.

    Exact up to a = 10^16. A part is counted at least as often as the phrase, so `counts` has it. Frequent parts are asked for by many phrases; they are joined apart.
    """
    found = counts.filter("words > 1")
    sides = [(k, s) for k in range(1, longest) for s in (0, 1)]
    asked = [F.when(F.lit(k) < F.col("words"), F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), (_part(1, k) if s == 0 else _part(k + 1, longest)).alias("part"))) for k, s in sides]
    need = cut(found.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("x")).select("*", "x.*").drop("x"), "phrase-parts")
    of = counts.filter(F.col("words") < longest).select(F.col("lang").alias("f_lang"), F.col("phrase").alias("f_phrase"), F.col("n").alias("f"))
    met = join_split(need, of, (F.col("lang") == F.col("f_lang")) & (F.col("part") == F.col("f_phrase")), "f")
    wide = met.groupBy("lang", "phrase", "words").agg(F.max("a").alias("a"), *[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{'lr'[s]}{k}") for k, s in sides])
    big = lambda c, p=19: F.col(c).cast(f"decimal({p},0)")
    score = lambda k: F.call_function("div", big("a", 17) * big("a", 17) * F.lit(1000000).cast("decimal(7,0)"), big(f"l{k}", 19) * big(f"r{k}", 19))
    cuts = [F.when(F.lit(k) < F.col("words"), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    return wide.select("lang", "phrase", "words", "a", F.array_min(F.array(*cuts)).alias("c")).select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def uncovered(scored: DataFrame, percent: int, longest: int = LONGEST) -> DataFrame:
    """Drops phrases that stand in a longer one with `percent` of their count or more, whether that is dropped or not."""
    of = lambda n: lambda at: _part(at, F.lit(n))
    inner = [F.when(F.lit(n) < F.col("words"), F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), of(n))) for n in range(2, longest)]
    parts = F.explode(F.flatten(F.filter(F.array(*inner), lambda x: x.isNotNull())))
    longer = scored.filter("words > 2").select(F.col("lang").alias("o_lang"), parts.alias("o_phrase"), F.col("a").alias("o_a")).groupBy("o_lang", "o_phrase").agg(F.max("o_a").alias("most"))
    met = scored.join(longer, (F.col("lang") == F.col("o_lang")) & (F.col("phrase") == F.col("o_phrase")), "left")
    return met.filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).select(*scored.columns)


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, first: int = 2000, lang: str = "lang", text: str = "text", suffixes: int = SUFFIXES, size: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each lang the `first` best phrases of two to LONGEST words that occur `least` times or more.

    Ranks go by score, then a, both descending, then phrase by bytes; that is a whole order, as a phrase stands once a lang. They are found in
    slices of each lang first, so that no task sorts all phrases of one.
    """
    counts, sizes = phrase_counts(docs, least, lang, text, suffixes, size)
    scored = cut(cut_scores(counts), "phrase-scores")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = uncovered(scored, percent).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for by in (["lang", "slice"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= first)
    named = best.select(F.col("lang").alias("b_lang"), "rank", "phrase", "a", "l", "r", "score")
    return named.join(small(sizes), F.col("b_lang") == F.col("lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
