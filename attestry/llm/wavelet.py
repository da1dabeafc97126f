"""A shard of token ids as a wavelet matrix, in one compressed file.

Level by level, from the highest bit of an id down, the shard keeps the plane of that bit of all ids in their present
order, and then puts ids with bit 0 before those with bit 1, both in order. Ranks in the planes lead from a position
to its id (access) and from an id to its number (count), selects from an id to its places (occurrences).

File: "WMX2", then little-endian: levels u16, end id u32, tokens u64, documents u64, block length in bits u32, and the lengths of
the sections u64 each. Sections: doc ids i64, a null flag a document u8, tokens a document u64, zstd-compressed each; then for each level
its index (ones before each block and all ones, u64; where each block begins and the last ends, u64) and its blocks, each
compressed by itself. So a rank is one number of the index and the bits of one block, and nothing else is decompressed.
"""

import struct
from functools import cached_property, lru_cache

import numpy as np
import zstandard

MAGIC, HEAD = b"WMX2", "<4sHIQQI"
#: Bits of a plane that are compressed together.
BLOCK = 1 << 15


def pack(doc_ids: list, tokens: list[np.ndarray], end_id: int) -> bytes:
    """One shard; tokens are the ids of each document, end id included."""
    ids = np.concatenate(tokens) if tokens else np.empty(0, np.uint32)
    levels = max(1, int(ids.max(initial=1)).bit_length())
    if levels <= 16:
        ids = ids.astype(np.uint16)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    sections = [
        squeeze(np.array([x or 0 for x in doc_ids], "<i8").tobytes()), squeeze(np.array([x is None for x in doc_ids], np.uint8).tobytes()),
        squeeze(np.array([len(t) for t in tokens], "<u8").tobytes()),
    ]
    for level in reversed(range(levels)):
        bit = ids & ids.dtype.type(1 << level) != 0
        blocks = [squeeze(np.packbits(bit[i : i + BLOCK], bitorder="little").tobytes()) for i in range(0, len(bit), BLOCK)]
        ones = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK), dtype=np.int64) if len(bit) else []
        sections.append(np.concatenate([[0], np.cumsum(ones), [0], np.cumsum([len(b) for b in blocks])]).astype("<u8").tobytes())
        sections.append(b"".join(blocks))
        ids = np.concatenate([ids[~bit], ids[bit]])
    head = struct.pack(HEAD, MAGIC, levels, end_id, len(ids), len(doc_ids), BLOCK)
    return b"".join([head, struct.pack(f"<{len(sections)}Q", *map(len, sections)), *sections])


class _Plane:
    """One bit a position, with ranks and selects; a block is decompressed when it is asked for."""

    def __init__(self, index: bytes, blocks: memoryview, n: int, size: int) -> None:
        self.ones_before, self.begins = np.split(np.frombuffer(index, "<u8").astype(np.int64), 2)
        self.blocks, self.n, self.size = blocks, n, size
        self.ones = int(self.ones_before[-1])
        self.zeros = n - self.ones
        self.block = lru_cache(maxsize=2)(self._block)

    def _block(self, j: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self.blocks[self.begins[j] : self.begins[j + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(self.size, self.n - j * self.size), bitorder="little")

    def bits(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint8), *map(self._block, range(len(self.begins) - 1))]).view(bool)

    def _by_block(self, at: np.ndarray):
        """(block, which of the positions lie in it)."""
        of = at // self.size
        order = np.argsort(of, kind="stable")
        blocks, first = np.unique(of[order], return_index=True)
        return zip(blocks.tolist(), np.split(order, first[1:]))

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        for j, own in self._by_block(at):
            out[own] = self.block(j)[at[own] - j * self.size]
        return out

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position, which may be the end."""
        out = np.full(len(at), self.ones, np.int64)
        for j, own in self._by_block(at):
            if j * self.size >= self.n:
                continue
            out[own] = self.ones_before[j]
            inside = at[own] - j * self.size
            if inside.any():
                out[own] += np.r_[0, np.cumsum(self.block(j), dtype=np.int64)][inside]
        return out

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """Positions of the k-th (from 0) one or zero."""
        starts = np.arange(len(self.ones_before)) * self.size
        starts[-1] = self.n
        before = self.ones_before if bit else starts - self.ones_before
        out = np.empty(len(k), np.int64)
        of = np.searchsorted(before, k, "right") - 1
        for j in np.unique(of).tolist():
            own = of == j
            out[own] = j * self.size + np.flatnonzero(self.block(j) == bit)[k[own] - before[j]]
        return out


class Shard:
    def __init__(self, raw: bytes) -> None:
        magic, self.levels, self.end_id, self.n, self.n_docs, self.block = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at, count = struct.calcsize(HEAD), 3 + 2 * self.levels
        sizes = struct.unpack_from(f"<{count}Q", raw, at)
        ends = np.cumsum([at + 8 * count, *sizes]).tolist()
        self._sections = [memoryview(raw)[a:b] for a, b in zip(ends, ends[1:])]
        self._planes: dict[int, _Plane] = {}

    def __len__(self) -> int:
        return self.n

    def _section(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._sections[k])

    def _plane(self, k: int) -> _Plane:
        if k not in self._planes:
            self._planes[k] = _Plane(self._sections[3 + 2 * k], self._sections[4 + 2 * k], self.n, self.block)
        return self._planes[k]

    @cached_property
    def doc_ids(self) -> list:
        flags = np.frombuffer(self._section(1), np.uint8)
        return [None if f else x for x, f in zip(np.frombuffer(self._section(0), "<i8").tolist(), flags.tolist())]

    @cached_property
    def doc_ends(self) -> np.ndarray:
        return np.cumsum(np.frombuffer(self._section(2), "<u8").astype(np.int64))

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at positions, without reading the rest."""
        at, out = np.asarray(positions, np.int64), np.zeros(len(positions), np.uint32)
        for k in range(self.levels):
            plane = self._plane(k)
            bit, ones = plane.get(at), plane.rank1(at)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def narrowed(self, token: int, at: np.ndarray) -> np.ndarray:
        """For each position, where in the last order the occurrences of token from there on begin."""
        if token < 0 or token >> self.levels:
            return np.zeros(len(at), np.int64)
        for k in range(self.levels):
            plane = self._plane(k)
            ones = plane.rank1(at)
            at = plane.zeros + ones if token >> (self.levels - 1 - k) & 1 else at - ones
        return at

    def counts(self, token: int, bounds: np.ndarray) -> np.ndarray:
        """How often token stands between each position of bounds and the next."""
        return np.diff(self.narrowed(token, np.asarray(bounds, np.int64)))

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        return int(self.counts(token, np.array([start, self.n if end is None else end]))[0])

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """All positions of a token from start to end, ascending."""
        at = np.arange(*self.narrowed(token, np.array([start, self.n if end is None else end], np.int64)), dtype=np.int64)
        for k in reversed(range(self.levels)):
            plane, bit = self._plane(k), bool(token >> (self.levels - 1 - k) & 1)
            if len(at):
                at = plane.select(at - plane.zeros if bit else at, bit)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the levels from the last."""
        ids = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in reversed(range(self.levels)):
            bit = self._plane(k).bits()
            zeros = self.n - int(np.count_nonzero(bit))
            back = np.empty_like(ids)
            back[~bit] = ids[:zeros]
            back[bit] = ids[zeros:] | ids.dtype.type(1 << (self.levels - 1 - k))
            ids = back
        return ids
