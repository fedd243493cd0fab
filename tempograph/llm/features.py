"""Document features shared by the trained models: hashed words, structure statistics, metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tempograph.llm.textkernel import Lines, Words, mix, span_hash

STATS = 16
META = 256


def stats_of(w: Words) -> np.ndarray:
    """float [texts, STATS]: structure of each text, from its bytes, words and lines; zeros for an empty text."""
    n = len(w.offsets) - 1
    size = np.diff(w.offsets).astype(float)
    size1 = np.maximum(size, 1)
    bytes_doc_sum = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
    words = np.diff(w.first).astype(float)
    words1 = np.maximum(words, 1)
    d = w.data
    digit = (d >= 48) & (d <= 57)
    space = (d == 32) | (d == 10) | (d == 9)
    upper = (d >= 65) & (d <= 90)
    point = (d == 46) | (d == 44) | (d == 59) | (d == 58) | (d == 33) | (d == 63)
    symbol = ~(space | point | (d >= 128) | ((d >= 48) & (d <= 57)) | ((d | 32) >= 97) & ((d | 32) <= 122))
    lines = Lines(w)
    per_line = np.bincount(lines.doc, minlength=n).astype(float)
    length = (w.end - w.start).astype(float)
    total = np.bincount(w.doc, weights=length, minlength=n)
    square = np.bincount(w.doc, weights=length * length, minlength=n)
    same = np.zeros(len(w.hash), dtype=float)
    if len(w.hash) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    key = (w.doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24))
    order = np.sort(key)
    new = np.ones(len(order), dtype=bool)
    new[1:] = order[1:] != order[:-1]
    distinct = np.bincount((order[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(n)
    np.maximum.at(top, (order[new] >> np.uint64(40)).astype(np.int64), runs)
    lh = span_hash(w.hash, lines.first, lines.last)
    lk = np.sort((lines.doc.astype(np.uint64) << np.uint64(40)) | (lh >> np.uint64(24)))
    repeat = np.zeros(n)
    if len(lk) > 1:
        repeat += np.bincount((lk[1:][lk[1:] == lk[:-1]] >> np.uint64(40)).astype(np.int64), minlength=n)
    mean = total / words1
    return np.stack(
        [
            np.log1p(words), np.log1p(per_line), mean, np.sqrt(np.maximum(square / words1 - mean**2, 0)), bytes_doc_sum(digit) / size1, bytes_doc_sum(upper) / size1,
            bytes_doc_sum(space) / size1, bytes_doc_sum(point) / size1, np.minimum(bytes_doc_sum(symbol) / words1, 4), np.minimum(bytes_doc_sum(d == 124) / words1, 2), distinct / words1, top / words1,
            np.bincount(w.doc, weights=same, minlength=n) / words1, repeat / np.maximum(per_line, 1), np.log1p(words / np.maximum(per_line, 1)), bytes_doc_sum(d >= 128) / size1,
        ],
        axis=1,
    )


def bag_of(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of each distinct hashed word of a text: 1 + ln(count), scaled to length 1 by text."""
    n = len(w.offsets) - 1
    key = np.sort(w.doc * buckets + (mix(w.hash, 5) % np.uint64(buckets)).astype(np.int64))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(key)))
    doc, bucket = key[at] // buckets, key[at] % buckets
    value = 1 + np.log(np.maximum(count, 1))
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=n))
    return doc, bucket, value / norm[doc]


def meta_of(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """int [rows, columns]: hashed metadata values in 0..META-1; a null is a value of its own."""
    out = np.zeros((batch.num_rows, len(columns)), dtype=np.int64)
    for k, c in enumerate(columns):
        w = batch.column(c).cast(pa.string()).to_pylist()
        seen: dict[str | None, int] = {}
        for i, x in enumerate(w):
            if x not in seen:
                raw = f"{c}={x}".encode() if x is not None else f"{c} null".encode()
                h = 1469598103934665603
                for byte in raw:
                    h = (h ^ byte) * 1099511628211 & (1 << 64) - 1
                seen[x] = (h >> 17) % META
            out[i, k] = seen[x]
    return out
