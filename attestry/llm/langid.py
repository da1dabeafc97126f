"""Language identification by hyperdimensional profiles (operator 10).

Every letter has a random vector of +1 and -1, drawn from its code point. The vector of three letters binds theirs by
product, the first rotated by two places and the second by one; a text's vector bundles (sums) those of its letter
triples, words being set apart by one space. A language's prototype bundles its training texts, and a text gets the language of
the prototype with the largest cosine.
"""

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from attestry.llm.shared import cut, fresh, small, strings, tidy

DIMS = 1024
#: A text must reach SLACK times the cosine that all but LOW of its language's learning texts of as many triples reach, and NOISE standard
#: deviations of unrelated vectors. Classes of fewer than CLASS_ROWS learning texts take in those of fewer triples, then those
#: of more, whose cosines are scaled: while most triples of a text differ, its cosine grows with the root of their number.
LOW, SLACK, NOISE, CLASS_ROWS = 0.05, 0.5, 3.0, 100
#: Code points that are looked at together, and triples whose vectors a worker remembers.
SEGMENT, REMEMBERED = 1 << 20, 1 << 15
UNDETERMINED = "und"
_SPACE = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    """By code point: 1 for letters, 2 for the marks that go with them."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        out[cp] = 1 if chr(cp).isalpha() else 2 if unicodedata.category(chr(cp))[0] == "M" else 0
    return out


def triples(text: str | None) -> Iterator[np.ndarray]:
    """Keys of all letter triples of a text, piece by piece; none if the text has no letter."""
    low, letters, tail, seen = (text or "").lower(), _letters(), np.array([_SPACE]), False
    for i in range(0, len(low), SEGMENT):
        a = np.frombuffer(low[i : i + SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letters[a]
        seen = seen or bool((kind == 1).any())
        a = np.concatenate([tail, np.where(kind > 0, a, _SPACE)])
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != _SPACE) | (a[:-1] != _SPACE)
        a = a[keep]
        if seen and len(a) > 2:
            yield _keys(a)
        tail = a[-2:] if seen else a[-1:]
    if seen and tail[-1] != _SPACE:
        yield _keys(np.append(tail, _SPACE))


def _keys(a: np.ndarray) -> np.ndarray:
    a = a.astype(np.int64)
    return (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]


@cache
def _letter(cp: int, dims: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([cp, 7919])).integers(0, 2, dims).astype(np.int8) * 2 - 1


def triple_vector(key: int, dims: int = DIMS) -> np.ndarray:
    a, b, c = (_letter((key >> s) & 0x1FFFFF, dims) for s in (42, 21, 0))
    return np.roll(a, 2) * np.roll(b, 1) * c


class _Vectors:
    """Vectors of the triples met so far, by row; forgets all when full."""

    def __init__(self, dims: int) -> None:
        self.dims, self.rows, self.table = dims, {}, np.empty((256, dims), np.int8)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of count times vector."""
        total = np.zeros(self.dims, np.float64)
        for i in range(0, len(keys), 4096):
            part = keys[i : i + 4096].tolist()
            if len(self.rows) + len(part) > REMEMBERED:
                self.rows.clear()
            for k in part:
                if k not in self.rows:
                    n = self.rows[k] = len(self.rows)
                    if n >= len(self.table):
                        self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    self.table[n] = triple_vector(k, self.dims)
            n = counts[i : i + 4096]
            kind = np.float32 if int(n.sum()) < 1 << 24 else np.float64  # sums of whole numbers, exact in either
            total += n.astype(kind) @ self.table[[self.rows[k] for k in part]].astype(kind)
        return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of triples a language, summed over some millions of characters at a time."""
    held: dict = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            k, c = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "k": pa.array(k, pa.int64()), "c": pa.array(c, pa.int64())})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
            for keys in triples(text):
                held.setdefault(lang, []).append(keys)
                size += len(keys)
                if size >= 2 << 20:
                    yield from out()
                    size = 0
    yield from out()


def bundles(labelled: DataFrame, lang: str = "lang", text: str = "text", dims: int = DIMS) -> dict[str, np.ndarray]:
    """Sums of vectors by language, from all rows with text and language.

    Spark counts the different triples. Each task bundles those that the shuffle brought it, and the parts are summed by
    language and dimension, so what reaches the driver is one number for each of these, whatever the texts hold.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(tidy(_count), "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = _Vectors(dims), {}
        for batch in batches:
            langs, k, c = batch.column("lang").dictionary_encode(), batch.column("k").to_numpy(), batch.column("c").to_numpy()
            for n, name in enumerate(langs.dictionary.to_pylist()):
                own = langs.indices.to_numpy() == n
                sums[name] = sums.get(name, 0) + vectors.bundle(k[own], c[own])
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * dims, pa.string()), "d": pa.array(range(dims), pa.int32()), "v": pa.array(v.astype(np.int64), pa.int64())})

    sums = counts.mapInArrow(tidy(bundle), "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for name, d, v in sums.collect():
        found.setdefault(name, np.zeros(dims))[d] = v
    return {k: v for k, v in sorted(found.items()) if v.any()}


def prototypes(labelled: DataFrame, lang: str = "lang", text: str = "text", dims: int = DIMS) -> dict[str, np.ndarray]:
    """The bundles as unit vectors."""
    return {k: v / np.linalg.norm(v) for k, v in bundles(labelled, lang, text, dims).items()}


def predict(docs: DataFrame, found: dict[str, np.ndarray], text: str = "text", dims: int = DIMS) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    score is the cosine, 0 where it is negative. A text that is null or has no letter, or any text where nothing was
    learned, gets `und` with score 0; of equal cosines the first language in alphabetical order wins. Whole texts are
    read, in pieces. No documents: no rows.
    """
    langs, matrix = list(found), np.array(list(found.values())) if found else np.zeros((0, dims))
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(dims)
        for batch in batches:
            pred, score = [], []
            for s in strings(batch.column(at)):
                v = np.zeros(dims)
                for keys in triples(s):
                    v += vectors.bundle(*np.unique(keys, return_counts=True))
                cos = matrix @ v / n if langs and (n := np.linalg.norm(v)) > 0 else None
                pred.append(UNDETERMINED if cos is None else langs[int(cos.argmax())])
                score.append(0.0 if cos is None else float(min(1.0, max(0.0, cos.max()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names)

    names = [*docs.columns, "lang_pred", "score"]
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", dims: int = DIMS) -> DataFrame:
    """predict() with prototypes of those rows of docs for which `learn` holds."""
    return predict(docs, prototypes(docs.filter(learn), lang, text, dims), text, dims)


def known(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", dims: int = DIMS) -> DataFrame:
    """docs without texts that have no letter or are in none of the languages learned from the rows for which `learn` holds.

    The bound is the language's own, by the number of distinct triples (in powers of two), so that short texts and texts of
    repeated words are held against their like. Learning texts are compared with their language's bundle without themselves.
    All rows are judged once and written to the shared folder; the driver sees counts by language, class and cosine in hundredths.
    """
    columns, floor = docs.columns, NOISE / dims**0.5
    names = fresh(docs, "learn", "pred", "score", "class", "own", "least")
    learns, pred, score, size, own, bound = names
    docs = docs.withColumn(learns, F.coalesce(learn, F.lit(False)))
    sums = bundles(docs.filter(F.col(learns)), lang, text, dims)
    judged = cut(_judge(docs, sums, lang, text, dims, names), "language-judged")
    counts = judged.filter(F.col(own).isNotNull()).groupBy(F.col(lang).alias("l"), F.col(size).alias("s"), F.floor(F.col(own) * 100).alias("c")).agg(F.count("*").alias("n")).collect()
    least = _bounds([(r["l"], r["s"], r["c"] / 100, r["n"]) for r in counts], floor)
    bounds = docs.sparkSession.createDataFrame(least, f"{pred} string, {size} int, {bound} double")
    held = judged.filter(F.col(pred).isNotNull()).join(small(bounds), [pred, size], "left")
    return held.filter(F.col(score) >= F.coalesce(bound, F.lit(floor))).select(*columns)


def _bounds(counts: list[tuple[str, int, float, int]], floor: float) -> list[tuple[str, int, float]]:
    """(language, class, least cosine) for the classes 0 to 31, from (language, class, cosine, rows)."""
    found: dict[str, dict[int, list[tuple[float, int]]]] = {}
    for lang, size, cosine, n in counts:
        found.setdefault(lang, {}).setdefault(size, []).append((cosine, n))
    out = []
    for lang, classes in sorted(found.items()):
        for size in range(32):
            rows: list[tuple[float, int]] = []
            for near in [*range(size, -1, -1), *range(size + 1, 32)]:
                if sum(n for _, n in rows) >= CLASS_ROWS:
                    break
                rows += [(c * min(1.0, 2 ** ((size - near) / 2)), n) for c, n in classes.get(near, [])]
            rows.sort()
            below = np.cumsum([n for _, n in rows])
            out.append((lang, size, max(floor, SLACK * rows[int(np.searchsorted(below, LOW * below[-1], "right"))][0])))
    return out


def _judge(docs: DataFrame, sums: dict[str, np.ndarray], lang: str, text: str, dims: int, names: list[str]) -> DataFrame:
    """docs with the prediction (null without letters), score, size class and, for learning rows, the cosine with the rest of their language."""
    langs, norms = list(sums), {k: float(np.linalg.norm(v)) for k, v in sums.items()}
    matrix = np.array([v / norms[k] for k, v in sums.items()]) if sums else np.zeros((0, dims))
    at, of, learns = (docs.columns.index(c) for c in (text, lang, names[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(dims)
        for batch in batches:
            out: list[tuple] = []
            for s, label, learned in zip(strings(batch.column(at)), *(batch.column(i).to_pylist() for i in (of, learns))):
                v, kinds = np.zeros(dims), 0
                for keys in triples(s):
                    unique, counts = np.unique(keys, return_counts=True)
                    v += vectors.bundle(unique, counts)
                    kinds = max(kinds, len(unique))
                n = float(np.linalg.norm(v))
                if not langs or n == 0:
                    out.append((None, None, None, None))
                    continue
                cos, own = matrix @ v / n, None
                if learned and label in norms:
                    dot = cos[langs.index(label)] * norms[label]  # with the unit vector of the text
                    rest = norms[label] ** 2 - 2 * dot * n + n * n
                    own = float((dot - n) / rest**0.5) if rest > 1e-6 * n * n else None
                out.append((langs[int(cos.argmax())], float(cos.max()), kinds.bit_length() - 1, own))
            cols = list(zip(*out)) or [[]] * 4
            kind = (pa.string(), pa.float64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(cols, kind))], [f.name for f in schema])

    schema = StructType([*docs.schema.fields, *(StructField(c, k) for c, k in zip(names[1:5], (StringType(), DoubleType(), IntegerType(), DoubleType())))])
    return docs.mapInArrow(tidy(run), schema)
