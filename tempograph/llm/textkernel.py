"""Vectorised text kernels: whole Arrow string batches become NumPy arrays of words and lines.

A batch is handled as one byte buffer.  A word is a maximal run of ASCII letters, digits, ``_``
or non-ASCII bytes; its hash is a polynomial over the case-folded bytes (ASCII and Latin-1 capital
letters fold), read from prefix sums modulo 2**64, so no Python code runs per word.  Null texts are
empty texts.  Batches are cut into chunks of bounded bytes; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[95] = True
_WORD[128:] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 1 << 16, self.size * 2)
            both = []
            for b in (self.base, self.inverse):
                x = np.full(self.size, b, dtype=np.uint64)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            self.pow, self.inv = both
        return self.pow, self.inv


_BYTES, _WORDS_A, _WORDS_B = _Powers(_B), _Powers(0xC2B2AE3D27D4EB4F), _Powers(0x165667B19E3779F9)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _M64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most`` bytes (one text at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(b.column(column)).to_pandas(), dtype=float))
        begin, total = 0, 0
        for i, s in enumerate(sizes):
            if total and total + s > most:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += s
        yield b.slice(begin)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of each text and the end); nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(data) > 1:
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        at = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
        out[at] += 32
    return out


def in_word(data: np.ndarray) -> np.ndarray:
    return _WORD[data]


def prefix_hashes(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=sums[1:])
    return sums, inverse


class Words:
    """Words of a chunk: start, end (byte offsets), hash, text number, and first word of each text."""

    __slots__ = ("data", "offsets", "start", "end", "hash", "doc", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = _WORD[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:]
        ends = ~inside
        ends[0] = False
        ends[1:] |= edge[1:]
        ends[1:] &= inside[:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        sums, inverse = prefix_hashes(fold(data).astype(np.uint64) + np.uint64(1), _BYTES)
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    @classmethod
    def of(cls, column: pa.Array) -> "Words":
        return cls(*text_bytes(column))


def span_hash(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of each sequence hashes[first:last]."""
    sums, inverse = prefix_hashes(hashes, _WORDS_B if second else _WORDS_A)
    return mix((sums[last] - sums[first]) * inverse[first], 2 if second else 1)


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number, number in the text) of each line."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = np.ones(n, dtype=np.int64) + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1])
    doc = np.repeat(np.arange(n), counts)
    return start, end, doc, np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)


class Lines:
    """Lines of a chunk (text cut at newlines): start, end, text number, number in the text, words first/last."""

    __slots__ = ("start", "end", "doc", "number", "first", "last")

    def __init__(self, w: Words):
        self.start, self.end, self.doc, self.number = line_bounds(w.data, w.offsets)
        self.first, self.last = np.searchsorted(w.start, self.start), np.searchsorted(w.start, self.end)


def weight_of(length: np.ndarray) -> np.ndarray:
    """Weight of a word by its bytes: short words are mostly function words and say little."""
    return np.array([0.0, 0.1, 0.1, 0.15, 0.4, 0.7, 1.0])[np.minimum(length, 6)]


#: Bits of the hashes that are counted together, and the words a group from which the larger number is quicker.
_LITTLE, _MUCH, _LONG = 4, 8, 300
_SIGNS = {k: (((np.arange(1 << k)[:, None] >> np.arange(k)) & 1) * 2.0 - 1.0).astype(np.float32) for k in (_LITTLE, _MUCH)}


def simhash(hashes: np.ndarray, weights: np.ndarray, group: np.ndarray, n: int, lanes: int = 1) -> np.ndarray:
    """uint64 [n, lanes]: weighted SimHash of each group's hashes.

    Parts of the hashes, of 4 or 8 bits, are counted by value, and the counts meet a sign matrix; a tie gives 0.
    """
    out = np.zeros((n, lanes), dtype=np.uint64)
    width = _MUCH if len(group) > _LONG * n else _LITTLE
    step = 1 << 20 - width  # groups at a time: a million counts
    bounds = np.searchsorted(group, np.arange(0, n + step, step))
    for lane in range(lanes):
        h = mix(hashes, 100 + lane)
        for k, begin in enumerate(range(0, n, step)):
            m, own = min(step, n - begin), slice(bounds[k], bounds[k + 1])
            at, g, w = h[own], (group[own] - begin) << width, weights[own]
            bits = np.empty((m, 64), dtype=bool)
            for low in range(0, 64, width):
                value = ((at >> np.uint64(low)) & np.uint64((1 << width) - 1)).view(np.int64)
                counts = np.bincount(g + value, weights=w, minlength=m << width)[: m << width].reshape(m, 1 << width)
                bits[:, low : low + width] = (counts.astype(np.float32) @ _SIGNS[width]) > 1e-4
            out[begin : begin + m, lane] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist(), strict=True)]
