"""Byte-level BPE of whole texts with the tokenizers library, each distinct piece being encoded once a segment.

A byte-level tokenizer first cuts a text into pieces (words with their space, numbers, punctuation, white space), and a
piece's ids depend on nothing else. Where a vocabulary file asks for just this, many texts are cut at once by array
operations, Arrow numbers the distinct pieces, the library's model encodes these, and ids are gathered by number. Any
other file's texts, and texts that hold an added token's string or code points that this Python's Unicode tables don't
know, are given to the library as a whole.
"""

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Characters that are cut at once, and pieces (some 40 bytes each) that a worker remembers from one segment to the next.
SEGMENT, REMEMBERED = 6 << 20, 1 << 20
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: The code points of white space, and what may follow an apostrophe at a piece's start.
_SPACES = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_AFTER_APOSTROPHE = ("s", "t", "re", "ve", "m", "ll", "d")
#: What a vocabulary file must say for pieces to be cut here.
_PRE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "byte_fallback": False, "ignore_merges": False}


@cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        out[cp] = _UNKNOWN if c == "Cn" else kinds.get(c[0], _OTHER)
    out[_SPACES] = _SPACE
    return out


def cuts(a: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points of the given classes; a text begins at each of `begins`."""
    start = np.ones(len(a), bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(a) + 1, bool)
    first[begins] = True
    first[-1] = True
    space = kind == _SPACE
    last = space & ~np.append(space[1:], False) & ~first[1:]  # the last of a run of white space before other text stands apart,
    start |= last | first[:-1]
    after = np.flatnonzero(last & (a == 32)) + 1  # or, if it is a blank, goes with what follows
    start[after] = False
    quote = np.flatnonzero((a == 39) & start)
    for word in _AFTER_APOSTROPHE:
        at = quote[quote + len(word) < len(a)]
        for j, c in enumerate(word, 1):
            at = at[(a[at + j] == ord(c)) & ~first[at + j]]
        start[at + 1] = False
        end = at + 1 + len(word)
        start[end[end < len(a)]] = True
    return np.flatnonzero(start)


@cache
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        pre, model = said["pre_tokenizer"] or {}, said["model"]
        self.byte_level = said["normalizer"] is None and all(pre.get(k, v) == v for k, v in _PRE.items()) and bool(pre)
        self.byte_level &= all((model.get(k, v) or v) == v for k, v in _MODEL.items())
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.starts = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where in them the ids of each of some distinct pieces start and end. Where too many are known, only these are kept."""
        if len(self.known) > REMEMBERED:
            self.forget()
        row = pc.fill_null(pc.index_in(pieces, self.known), -1).to_numpy()
        new = pieces.filter(pa.array(row < 0))
        if len(new):
            letters, tokenize = _byte_letters(), self.model.tokenize
            each = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] for p in new.to_pylist()]
            row = row.copy()
            row[row < 0] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return self.ids, self.starts[row], self.starts[row + 1]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts) -> Iterator[np.ndarray]:
        """Ids of each text as uint32; none for a null or an empty one."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= SEGMENT:
                yield from self._segment(held)
                held, size = [], 0
        yield from self._segment(held)

    def _segment(self, texts: list[str]) -> Iterator[np.ndarray]:
        if sum(map(len, texts)) < 2 * SEGMENT:
            yield from self._encode(texts)
            return
        for text in texts:  # a blank between other characters always begins a piece: long texts are cut there
            parts, at = [], 0
            while len(text) - at > 2 * SEGMENT:
                cut = text.find(" ", at + SEGMENT)
                while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
                    cut = text.find(" ", cut + 1)
                if cut < 0 or any(s in text for s in self.added):
                    break
                parts.append(text[at:cut])
                at = cut
            parts.append(text[at:])
            yield np.concatenate([ids for part in parts for ids in self._encode([part])])

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        own = [self.byte_level and not any(s in t for s in self.added) for t in texts]
        joined = "".join(t for t, ok in zip(texts, own) if ok)
        a = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _classes()[a]
        ends = np.cumsum([len(t) if ok else 0 for t, ok in zip(texts, own)])
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        for at in np.unique(np.searchsorted(ends, np.flatnonzero(kind == _UNKNOWN), "right")).tolist():
            own[at] = False
        ids, bounds = self._gather(joined, a, kind, begins, ends) if len(a) else (np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
        for n, (text, ok) in enumerate(zip(texts, own)):
            yield ids[bounds[n] : bounds[n + 1]] if ok else self._whole(text)

    def _gather(self, joined: str, a: np.ndarray, kind: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a segment, and where each text's begin."""
        at = cuts(a, kind, begins[begins < len(a)])
        raw = joined.encode()
        if len(raw) == len(a):
            places = at
        else:
            width = np.ones(len(a), np.uint8)
            for limit in (0x80, 0x800, 0x10000):
                width += a >= limit
            places = (np.cumsum(width, dtype=np.int64) - width)[at]
        offsets = np.append(places, len(raw)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        number = found.indices.to_numpy()
        flat, first, after = self._pieces(found.dictionary)
        size = (after - first)[number]
        last = np.cumsum(size)
        ids = flat[np.repeat(first[number] - last + size, size) + np.arange(int(last[-1]))]
        before = np.r_[0, last]
        return ids, np.r_[before[np.searchsorted(at, begins)], last[-1]]


@cache
def bpe(path: str) -> Bpe:
    """One a worker process."""
    return Bpe(path)
