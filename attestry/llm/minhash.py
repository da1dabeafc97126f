"""Near duplicates by circulant MinHash (operator 3).

Signatures: a 64-bit hash of each distinct five-word shingle goes through a first permutation; coordinate k is the
minimum over the set of a second permutation, circularly shifted by k. So two permutations give all coordinates.
Bands of coordinates propose pairs, and every link is confirmed on the full shingle sets.

Texts with equal words are collapsed first. Each bucket's members are then confirmed against its smallest member only,
which joins most groups at once; what remains are buckets that still hold several components, and there members outside
the largest component meet the others across components. Pairs are made rows only if sizes and parities allow the
threshold: a set's parities say for each of some 4 n places whether an odd number of its hashes fall there, and two sets
differ in as many elements, at least, as in parities. So no pair is ruled out that could be a link, nearly all others
are, and what is left is confirmed or refuted on full sets. Nothing is capped.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import cut, discard, fresh, join_split, small, strings, tidy

#: Bands have at most ROWS coordinates each, and fewer where that would take more than COORDS of them.
WORDS, ROWS, COORDS = 5, 6, 320
#: Probability that a pair just at the threshold shares no band.
MISS = 1e-6
#: Parities for each element of a set, rounded up to a power of two; all are folded to HEAD for a first look.
PARITIES, HEAD = 4, 256
#: Texts that one task holds a leader's set against, at most; more are dealt to several tasks.
FOLLOWERS = 50
#: Elements that one sweep over all coordinates works on; they stay in the CPU's cache.
SWEEP = 1 << 16

_WEIGHT = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xD1B54A32D192ED03)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Words(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def forget() -> None:
    _words.clear()


def word_hashes(text: str | None) -> np.ndarray:
    """bytes.lower() changes A-Z alone, and bytes.split() cuts at space and \\t \\n \\v \\f \\r alone: words are `[^\\x20\\x09-\\x0D]+`."""
    return np.fromiter(map(_words.__getitem__, (text or "").encode().lower().split()), np.uint64)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; with fewer words, the whole sequence as one; without words, empty."""
    n = len(words) - size + 1
    if len(words) and n < 1:
        return mix64(np.array([reduce(lambda h, w: (h * int(_WEIGHT) + int(w)) % 2**64, words, int(_SHORT))], np.uint64))
    h = words[: max(n, 0)].copy()
    for j in range(1, size):
        h *= _WEIGHT
        h += words[j : n + j]
    return np.unique(mix64(h))


def banding(percent: int) -> tuple[int, int]:
    """(rows a band, bands) with which a pair at the threshold shares no band with probability MISS at most."""
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-min(percent / 100, 1 - 1e-9) ** rows))
        if rows * bands <= COORDS or rows == 1:
            return rows, bands


def signatures(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """(coordinate, set) minima; no set may be empty."""
    ends = np.cumsum([len(s) for s in sets])
    first = (mix64(np.concatenate(sets) ^ _SHORT) >> np.uint64(32)).astype(np.uint32)  # the first permutation, to a 32-bit circle
    starts = np.r_[0, ends[:-1]]
    out, v, t = np.empty((coords, len(sets)), np.uint32), np.empty_like(first), np.empty_like(first)
    for k in range(coords):
        np.subtract(first, np.uint32(k), out=v)  # shifted along the circle
        np.right_shift(v, np.uint32(16), out=t)
        np.bitwise_xor(v, t, out=v)
        np.multiply(v, np.uint32(0x7FEB352D), out=v)
        np.right_shift(v, np.uint32(15), out=t)
        np.bitwise_xor(v, t, out=v)
        np.multiply(v, np.uint32(0x846CA68B), out=v)  # the second permutation
        out[k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """For each set, a 64-bit key a band."""
    s = sig.astype(np.uint64).reshape(-1, rows, sig.shape[1])
    keys = np.repeat(mix64(np.arange(1, len(s) + 1, dtype=np.uint64))[:, None], s.shape[2], 1)
    for j in range(rows):
        keys = mix64(keys * _WEIGHT + s[:, j])
    return keys.T.view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes fall on each place, 64 places a number. Halves put together by XOR are the parities of half as many places."""
    places = max(HEAD, 1 << (PARITIES * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _features(size: int, percent: int):
    rows, bands = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, todo, total = 0, [], 0
            for text in strings(batch.column("text")):
                w = word_hashes(text)
                todo.append((xxhash.xxh3_128_digest(w.tobytes()), shingles(w, size)))
                total += len(todo[-1][1])
                if total >= SWEEP:
                    yield _rows(batch.column("id").slice(done, len(todo)), todo, rows, bands)
                    done, todo, total = done + len(todo), [], 0
            if todo:
                yield _rows(batch.column("id").slice(done, len(todo)), todo, rows, bands)

    return tidy(run, forget)


def _rows(ids: pa.Array, todo: list, rows: int, bands: int) -> pa.RecordBatch:
    full = [j for j, x in enumerate(todo) if len(x[1])]
    keys = band_keys(signatures([todo[j][1] for j in full], rows * bands), rows) if full else ()
    own, odd, head = ([None] * len(todo) for _ in range(3))
    for j, k in zip(full, keys):
        own[j], odd[j] = k, parities(todo[j][1])
        head[j] = np.bitwise_xor.reduce(odd[j].reshape(-1, HEAD // 64))
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([x[0] for x in todo], pa.binary()), pa.array([len(x[1]) for x in todo], pa.int64()), *(pa.array(c, longs) for c in (own, head, odd))],
        ["id", "fp", "n", "bands", "head", "odd"])


#: Ids of texts that are broadcast, 8 bytes each.
ASKED = 500_000
#: Members of a bucket that meet the others of it in one task.
LOT = 512


def _confirm(percent: int, size: int):
    """Rows sorted so that a leader comes before those that are held against it; a leader's set is kept until the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for g, salt, follows, i, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "follows", "id")), strings(batch.column("text"))):
                own = shingles(word_hashes(text), size)
                if not follows:
                    group, lead = (g, salt), own
                elif group == (g, salt) and len(own) and len(lead):
                    at = np.searchsorted(lead, own)
                    at[at == len(lead)] = 0
                    both = int((lead[at] == own).sum())
                    if 100 * both >= percent * (len(own) + len(lead) - both):
                        a.append(g)
                        b.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tidy(run, forget)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass. Texts that are asked for move once to their id, and once to each leader; a leader's followers are dealt to tasks in lots.

    Where ASKED ids or fewer are asked for, they are broadcast, and other texts don't move at all.
    """
    lots = pairs.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / FOLLOWERS)).cast("int").alias("lots"))
    leaders = lots.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("salt"), F.lit(False).alias("follows"))
    followers = pairs.join(cut(lots.filter("lots > 1"), "dedup-lots"), "a", "left").select(
        F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.coalesce("lots", F.lit(1))).cast("int").alias("salt"), F.lit(True).alias("follows"))
    needs = cut(leaders.unionByName(followers), "dedup-needs")
    ids = needs.select("id").distinct()
    if ids.limit(ASKED + 1).count() <= ASKED:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    return (
        texts.join(needs.hint("merge"), "id").select("a", "salt", "follows", "id", "text")
        .repartition("a", "salt").sortWithinPartitions("a", "salt", "follows")
        .mapInArrow(_confirm(percent, size), "a long, b long").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id in an edge (a, b), the smallest id that it reaches.

    Every round each node moves to the neighbour of most edges (ties by a hash that changes each round), and edges are
    drawn anew between where their ends went. Stars vanish in one round and chains shrink by a constant share, so that
    rounds grow as the logarithm of the longest chain. Each round is written, so a lost executor costs one round.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct(), "dedup-edges")
    at = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("at", F.col("id")), "dedup-at")
    for turn in range(64):
        if edges.isEmpty():
            return at.join(at.groupBy("at").agg(F.min("id").alias("component")), "at").select("id", "component")
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        rank = cut(both.groupBy("u").agg(F.count("*").alias("n")).select("u", F.struct("n", F.xxhash64("u", F.lit(turn)).alias("h"), F.col("u").alias("v")).alias("rank")), "dedup-rank")
        around = both.join(rank.select(F.col("u").alias("v"), "rank"), "v").groupBy("u").agg(F.max("rank").alias("best"))
        move = cut(around.join(rank, "u").select("u", F.greatest("best", "rank")["v"].alias("to")), "dedup-move")
        last, edges = [edges, at, rank, move], cut(
            edges.join(move.toDF("a", "a2"), "a").join(move.toDF("b", "b2"), "b").filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "dedup-edges")
        at = cut(at.join(move.toDF("at", "to"), "at", "left").select("id", F.coalesce("to", "at").alias("at")), "dedup-at")
        discard(*last)
    raise RuntimeError("edges are left after 64 rounds")


def _may_link(a: str, b: str, percent: int) -> Column:
    """False only for pairs that sizes or parities rule out: sets that differ in d of all s elements of both are linked if d (100 + percent) <= s (100 - percent)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = lambda d: d * (100 + percent) <= (n + m) * (100 - percent)
    head = sum((F.bit_count(F.col(f"{a}.head")[j].bitwiseXOR(F.col(f"{b}.head")[j])) for j in range(HEAD // 64)), F.lit(0))
    x, y = F.col(f"{a}.odd"), F.col(f"{b}.odd")

    def folded(c: Column) -> Column:
        half = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    apart = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda d, i: d + i)
    whole = (
        F.when(F.size(x) == F.size(y), apart(x, y)).when(F.size(x) == 2 * F.size(y), apart(folded(x), y)).when(2 * F.size(x) == F.size(y), apart(x, folded(y))).otherwise(0)
    )
    return F.when((100 * F.least(n, m) < percent * F.greatest(n, m)) | ~near(head), False).otherwise(near(whole))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct `size`-word shingles;
    component_id is the smallest doc_id that a document reaches, itself included, and kept marks that document.
    A null, empty or blank text has no shingles and is linked with nothing. Fewer words than `size`: the whole sequence
    is the one shingle. Repeated rows each keep their row; rows that share a doc_id count as one document. A null doc_id
    gives a null component, is linked with nothing and is kept. Other columns are not read. No documents: no rows.

    A pair just at the threshold shares no band with probability 1e-6 at most, for any percent, and one above it less.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    feats = cut(texts.mapInArrow(_features(size, percent), "id long, fp binary, n long, bands array<long>, head array<long>, odd array<long>"), "dedup-features")
    full = feats.filter("n > 0 AND id IS NOT NULL")
    reps = cut(full.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "dedup-copies")
    first_of = reps.select(F.col("rep").alias("id"), "fp")
    texts_once = full.join(first_of, ["id", "fp"], "left_semi").dropDuplicates(["id", "fp"])  # by id too, so that a text with many copies is no hot key
    rows = texts_once.select("id", F.explode("bands").alias("key"))
    heads = cut(rows.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head < last").select("key", "head"), "dedup-buckets")
    shared = cut(rows.join(heads, "key"), "dedup-members")  # members of buckets of more than one text
    sizes = cut(full.join(shared.select("id").distinct(), "id", "left_semi").select("id", "n", "head", "odd"), "dedup-parities")

    def allowed(pairs: DataFrame) -> DataFrame:
        one, two = (sizes.select(F.col("id").alias(c), F.struct("n", "head", "odd").alias(f"of_{c}")) for c in "ab")
        return pairs.join(one, "a").join(two, "b").filter(_may_link("of_a", "of_b", percent)).select("a", "b").distinct()

    first = cut(allowed(shared.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()), "dedup-pairs")
    links = cut(confirmed(first, texts, percent, size), "dedup-links")
    comps = cut(components(links), "dedup-components")

    info = sizes.join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    members = cut(shared.select("key", "id").join(info, "id"), "dedup-members")
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = cut(counts.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("key", "main"), "dedup-mixed")
    rest = cut(members.join(mixed, "key"), "dedup-rest")
    lots = rest.groupBy("key").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    dealt = cut(rest.join(lots, "key").join(sizes, "id"), "dedup-dealt")
    x = dealt.filter("comp <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.struct("id", "comp", "n", "head", "odd").alias("x"))
    y = dealt.select("key", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int").alias("lot"), F.struct("id", "comp", "main", "n", "head", "odd").alias("y"))
    across = (F.col("y.comp") == F.col("y.main")) | (F.col("x.comp") < F.col("y.comp"))
    met = x.join(y, (x["key"] == y["key"]) & (x["lot"] == y["lot"]) & (F.col("x.comp") != F.col("y.comp")) & across & _may_link("x", "y", percent))
    second = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = cut(second, "dedup-pairs")
    discard(heads, shared, sizes, members, mixed, rest, dealt)
    if not second.isEmpty():
        more = cut(confirmed(second, texts, percent, size), "dedup-links")
        if not more.isEmpty():
            comps = cut(components(links.union(more)), "dedup-components")

    goes_to = cut(reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("fp").alias("g_fp"), "copies", F.coalesce("component", "rep").alias("component")), "dedup-goes-to")
    linked = F.coalesce(F.col("n") > 0, F.lit(False)) & F.col("id").isNotNull()
    met = join_split(feats.filter(linked).select("id", "fp", "n"), goes_to, F.col("fp") == F.col("g_fp"), "copies", "left")
    alone = feats.filter(~linked).select("id", "n", F.col("id").alias("component"))  # empty texts are one fingerprint, and so take part in no join
    out = met.select("id", "n", F.coalesce("component", "id").alias("component")).unionByName(alone)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80, size: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id. Of rows that share a doc_id one stays; a null doc_id stays."""
    groups = near_duplicates(docs, percent, size, doc_id, text)
    seen = cut(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows")), "dedup-kept")
    own, kept, rows = fresh(docs, "own_id", "is_kept", "own_rows")
    odd = small(seen.filter("NOT kept OR rows > 1"), ASKED)  # all other rows stay, and where these are few no text moves
    held = docs.join(odd.toDF(own, kept, rows), docs[doc_id] == F.col(own), "left").filter(F.coalesce(kept, F.lit(True)))
    out = held.filter(F.coalesce(rows, F.lit(1)) == 1)
    if not seen.filter("kept AND rows > 1").isEmpty():
        out = out.unionByName(held.filter(F.col(rows) > 1).dropDuplicates([doc_id]))
    return out.select(*docs.columns)
