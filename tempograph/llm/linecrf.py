"""Operator 9: quality rules by line labelling with a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import sample_labelled
from tempograph.llm.textkernel import Lines, Words, chunks, mix, span_hash

CONTENT, BOILERPLATE = 0, 1
STATS = 15
BUCKETS = 1 << 14
MIN_SHARE = 0.3


def line_features(w: Words) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines that hold a word: (lines, indices, statistics, bucket of the whole line, hash of the line)."""
    lines = Lines(w)
    at = np.flatnonzero(lines.last > lines.first)
    first, last = lines.first[at], lines.last[at]
    words = (last - first).astype(float)
    size = (lines.end - lines.start)[at].astype(float)
    d = w.data
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    part = lambda s: (s[lines.end[at]] - s[lines.start[at]]).astype(float)
    letter = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 128)
    digit = (d >= 48) & (d <= 57)
    space = (d == 32) | (d == 9)
    point = (d == 46) | (d == 44) | (d == 59) | (d == 58) | (d == 33) | (d == 63)
    same = np.zeros(len(w.hash))
    same[1:] = w.hash[1:] == w.hash[:-1]
    s = sums(same)
    repeats = np.maximum(s[last] - s[np.minimum(first + 1, last)], 0)
    h = span_hash(w.hash, first, last)
    key = mix(h ^ (lines.doc[at].astype(np.uint64) << np.uint64(1)), 9)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    n = np.bincount(lines.doc, minlength=len(w.offsets) - 1)[lines.doc[at]]
    number = lines.number[at]
    tail = d[np.maximum(lines.end[at] - 1, 0)] if len(d) else np.zeros(len(at), np.uint8)
    x = np.stack(
        [
            np.ones(len(at)), np.log1p(words) - 3, words < 3, words < 8, part(sums(letter)) / np.maximum(words, 1) / 5 - 1, np.minimum(part(sums(~(letter | digit | space | point))) / words, 3), np.minimum(part(sums(d == 124)) / words, 2),
            part(sums(digit)) / size, repeats / words, np.minimum(count[inverse] - 1, 4) / 4, number == 0, number == n - 1, (tail == 46) | (tail == 33) | (tail == 63), part(sums((d >= 65) & (d <= 90))) / words, n == 1,
        ],
        axis=1,
    ).astype(float)
    return lines, at, x, (mix(h, 3) % np.uint64(BUCKETS)).astype(np.int64), h


@dataclass
class Field:
    """Weights of a line's statistics and of its hashed normal form, for boilerplate against content; start and transition scores."""

    w: np.ndarray
    bucket: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def emission(self, x: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 2))
        out[:, BOILERPLATE] = x @ self.w + self.bucket[bucket]
        return out


def steps(doc: np.ndarray) -> list[np.ndarray]:
    """Line indices by their place in the sequence: step t has line t of each text that has one, texts in one order."""
    if not len(doc):
        return []
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(begin, len(doc)))
    begin = begin[np.argsort(-length, kind="stable")]
    length = -np.sort(-length, kind="stable")
    alive = np.searchsorted(-length, -np.arange(length[0]) - 0.5)
    return [begin[:m] + t for t, m in enumerate(alive)]


def viterbi(field: Field, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The likeliest marks of each text's lines; all texts advance together.  Equal scores give content."""
    marks = np.zeros(len(e), dtype=np.int8)
    order = steps(doc)
    if not order:
        return marks
    back = []
    v = field.start + e[order[0]]
    final = np.empty_like(v)
    for t in range(1, len(order)):
        m = len(order[t])
        final[m : len(v)] = v[m:]
        to = v[:m, :, None] + field.move
        arg = to.argmax(axis=1)
        back.append(arg)
        v = np.take_along_axis(to, arg[:, None, :], axis=1)[:, 0, :] + e[order[t]]
    final[: len(v)] = v
    state = final.argmax(axis=1)
    for t in range(len(order) - 1, -1, -1):
        m = len(order[t])
        marks[order[t]] = state[:m]
        if t:
            state[:m] = np.take_along_axis(back[t - 1], state[:m, None], axis=1)[:, 0]
    return marks


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(field: Field, e: np.ndarray, order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(mark of each line), and expected transitions [2, 2]."""
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[order[0]] = field.start + e[order[0]]
    for t in range(1, len(order)):
        prev = order[t - 1][: len(order[t])]
        alpha[order[t]] = _lse(alpha[prev][:, :, None] + field.move, 1) + e[order[t]]
    moves = np.zeros((2, 2))
    z = np.zeros(len(e))
    for t in range(len(order) - 1, -1, -1):
        if t + 1 < len(order):
            m = len(order[t + 1])
            here, after = order[t][:m], order[t + 1]
            beta[here] = _lse(field.move + (e[after] + beta[after])[:, None, :], 2)
        z[order[t]] = _lse(alpha[order[t]] + beta[order[t]], 1)
        if t + 1 < len(order):
            moves += np.exp(alpha[here][:, :, None] + field.move + (e[after] + beta[after])[:, None, :] - z[here][:, None, None]).sum(axis=0)
    return np.exp(alpha + beta - z[:, None]), moves


def fit(x: np.ndarray, bucket: np.ndarray, doc: np.ndarray, y: np.ndarray, iterations: int = 120) -> Field:
    """Maximum likelihood with a light penalty, by Adam on the exact gradient."""
    f = Field(np.zeros(STATS), np.zeros(BUCKETS), np.zeros(2), np.zeros((2, 2)))
    order = steps(doc)
    if not order:
        return f
    n = len(y)
    pair = np.zeros((2, 2))
    for t in range(1, len(order)):
        np.add.at(pair, (y[order[t - 1][: len(order[t])]], y[order[t]]), 1)
    begin = np.bincount(y[order[0]], minlength=2)
    theta = np.zeros(STATS + BUCKETS + 6)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, iterations + 1):
        f = Field(theta[:STATS], theta[STATS : STATS + BUCKETS], theta[-6:-4], theta[-4:].reshape(2, 2))
        p, moves = marginals(f, f.emission(x, bucket), order)
        r = p[:, BOILERPLATE] - y
        g = np.concatenate([x.T @ r, np.bincount(bucket, weights=r, minlength=BUCKETS), p[order[0]].sum(axis=0) - begin, (moves - pair).ravel()]) / n + 2e-5 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:STATS], theta[STATS : STATS + BUCKETS], theta[-6:-4], theta[-4:].reshape(2, 2))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, contexts: int = 3) -> Field:
    """Fit on at most ``max_labelled`` labelled documents, least id hash first (documented bound).

    Lines of documents labelled low are boilerplate; in others, a line is so if it comes after
    ``contexts`` different lines or more in the sample, which template lines do and the lines of
    copied documents don't; the rest is content.
    """
    sample = sample_labelled(spark, docs, labels, ["quality"], max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            lines, at, x, bucket, h = line_features(Words.of(b.column("text")))
            rows = lines.doc[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column("__id").to_numpy()[rows]), pa.array(lines.number[at]), pa.array(b.column("q").to_numpy()[rows].astype(np.int32)), pa.array(bucket), pa.array(h.view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATS).cast(pa.list_(pa.float64()))],
                ["id", "line", "q", "bucket", "h", "x"],
            )

    t = sample.select("__id", "text", F.col("__quality").cast("int").alias("q")).mapInArrow(run, "id long, line long, q int, bucket long, h long, x array<double>").toArrow()
    if not t.num_rows:
        return fit(np.zeros((0, STATS)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    t = t.sort_by([("id", "ascending"), ("line", "ascending")]).combine_chunks()
    ids, q, bucket, h = (t.column(c).to_numpy() for c in ("id", "q", "bucket", "h"))
    x = np.asarray(t.column("x").combine_chunks().flatten()).reshape(-1, STATS)
    before = np.where(np.concatenate([[True], ids[1:] != ids[:-1]]), 0, np.concatenate([[0], h[:-1]]))
    place = np.unique(np.stack([h, before, np.where(before == 0, ids, 0)], axis=1), axis=0)
    kinds, count = np.unique(place[:, 0], return_counts=True)
    template = np.isin(h, kinds[count >= contexts])
    return fit(x, bucket, ids, ((q <= 0) | template).astype(np.int64))


def label_lines(docs: DataFrame, field: Field, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, lines, content_lines, content_share, marks, keep) of every row of docs.

    ``marks`` has C (content) or B (boilerplate) for each line that holds a word; ``content_share`` is
    the share of content lines by bytes of these lines; ``keep`` if it is at least ``min_share``.  A null
    text is empty; a text without a word has no marks, share 0, and isn't kept.  Null ids stay null;
    repeated rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in chunks(batches):
            n = b.num_rows
            lines, at, x, bucket, _ = line_features(Words.of(b.column("text")))
            doc = lines.doc[at]
            marks = viterbi(f, f.emission(x, bucket), doc)
            size = (lines.end - lines.start)[at]
            content = marks == CONTENT
            total = np.bincount(doc, weights=size, minlength=n)
            share = np.bincount(doc[content], weights=size[content], minlength=n) / np.maximum(total, 1)
            cut = np.searchsorted(doc, np.arange(n + 1))
            text = np.where(content, ord("C"), ord("B")).astype(np.uint8).tobytes().decode()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(cut)), pa.array(np.bincount(doc[content], minlength=n)), pa.array(share), pa.array([text[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.string()), pa.array((share >= min_share) & (total > 0))],
                ["doc_id", "lines", "content_lines", "content_share", "marks", "keep"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lines long, content_lines long, content_share double, marks string, keep boolean")
