"""Operator 2: quality classifier, a factorisation machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import sample_labelled
from tempograph.llm.features import META, STATS, bag_of, meta_of, stats_of
from tempograph.llm.textkernel import Words, chunks

BUCKETS = 1 << 14
RANK = 8
META_COLS = ["lang", "source"]


@dataclass
class Machine:
    """w0, linear weights and low-rank factors of BUCKETS hashed words, STATS statistics, META values."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float = 0.5

    def score(self, n: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Logits.  Sum over pairs of <v_i, v_j> x_i x_j = half of (sum of v x) squared less the sum of squares: linear in the features."""
        out = self.w0 + np.bincount(doc, weights=self.w[feature] * value, minlength=n)
        for f in range(self.v.shape[1]):
            p = self.v[feature, f] * value
            out += 0.5 * (np.bincount(doc, weights=p, minlength=n) ** 2 - np.bincount(doc, weights=p * p, minlength=n))
        return out


def example(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of hashed words and metadata, and the raw statistics."""
    w = Words.of(batch.column("text"))
    doc, bucket, value = bag_of(w, BUCKETS)
    meta = meta_of(batch, META_COLS)
    rows = np.repeat(np.arange(batch.num_rows), len(META_COLS))
    return np.concatenate([doc, rows]), np.concatenate([bucket, BUCKETS + STATS + meta.ravel()]), np.concatenate([value, np.full(len(rows), 0.2)]), stats_of(w)


def with_stats(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(stats)
    z = np.clip((stats - mean) / scale, -4, 4) * 0.5
    return np.concatenate([doc, np.repeat(np.arange(n), STATS)]), np.concatenate([feature, np.tile(BUCKETS + np.arange(STATS), n)]), np.concatenate([value, z.ravel()])


def _collect(sample: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            doc, feature, value, stats = example(b)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(cut, pa.array(feature[order].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value[order].astype(np.float32))), pa.ListArray.from_arrays(np.arange(0, len(stats) * STATS + 1, STATS, dtype=np.int32), pa.array(stats.ravel())), b.column("__label").cast(pa.int32()), b.column("__id")],
                ["f", "x", "s", "y", "id"],
            )

    t = sample.select("text", *META_COLS, F.col(label).alias("__label"), "__id").mapInArrow(run, "f array<int>, x array<float>, s array<double>, y int, id long").toArrow()
    if not t.num_rows:
        z = np.zeros(0)
        return z.astype(np.int64), z.astype(np.int64), z, np.zeros((0, STATS)), z.astype(np.int32)
    t = t.take(pc.sort_indices(t.column("id"))).combine_chunks()
    f, x, s = (t.column(c).combine_chunks() for c in "fxs")
    doc = np.repeat(np.arange(t.num_rows), np.diff(np.asarray(f.offsets)))
    return doc, np.asarray(f.flatten()).astype(np.int64), np.asarray(x.flatten()).astype(float), np.asarray(s.flatten()).reshape(-1, STATS), np.asarray(t.column("y"))


def train(sample: DataFrame, label: str = "__quality", epochs: int = 6, batch: int = 128, seed: int = 7, keep_good: float = 0.995) -> Machine:
    """Fit on the sample (Adam, logistic loss); a fifth is held out, and the cut, between 0.1 and 0.5, rejects
    at most 1 - keep_good of its good documents, unless they score under 0.1."""
    doc, feature, value, stats, y = _collect(sample, label)
    n = len(y)
    size = BUCKETS + STATS + META
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)), np.zeros(STATS), np.ones(STATS), 0.0)
    if n < 10 or len(set(y.tolist())) < 2:  # nothing to learn from: everything is kept
        return m
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    doc, feature, value = with_stats(doc, feature, value, stats, m.mean, m.scale)
    order = np.argsort(doc, kind="stable")
    doc, feature, value = doc[order], feature[order], value[order]
    ptr = np.searchsorted(doc, np.arange(n + 1))
    held = np.arange(n) % 5 == 4
    ids = np.flatnonzero(~held)
    # the rarer class weighs as much as the other
    good = max(y[ids].mean(), 1e-6)
    weight = np.where(y > 0, 0.5 / good, 0.5 / max(1 - good, 1e-6))
    p = np.concatenate([m.w[:, None], m.v], axis=1)
    m1, m2, t = np.zeros_like(p), np.zeros_like(p), 0
    b1 = b2 = 0.0
    # small samples are gone over more often: 400 steps at least
    for _ in range(max(epochs, -(-400 * batch // len(ids)))):
        rng.shuffle(ids)
        for k in range(0, len(ids), batch):
            own = ids[k : k + batch]
            at = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in own])
            d = np.repeat(np.arange(len(own)), ptr[own + 1] - ptr[own])
            f, x = feature[at], value[at]
            m.w, m.v = p[:, 0], p[:, 1:]
            g = (1 / (1 + np.exp(-np.clip(m.score(len(own), d, f, x), -30, 30))) - (y[own] > 0)) * weight[own] / len(own)
            t += 1
            rate = 0.02
            gx = g[d] * x
            uniq, inv = np.unique(f, return_inverse=True)
            grad = np.empty((len(uniq), RANK + 1))
            grad[:, 0] = np.bincount(inv, weights=gx, minlength=len(uniq))
            for c in range(RANK):
                vx = m.v[f, c] * x
                s = np.bincount(d, weights=vx, minlength=len(own))
                grad[:, c + 1] = np.bincount(inv, weights=gx * (s[d] - vx), minlength=len(uniq))
            grad += 1e-5 * p[uniq]
            m1[uniq] = 0.9 * m1[uniq] + 0.1 * grad
            m2[uniq] = 0.99 * m2[uniq] + 0.01 * grad**2
            p[uniq] -= rate * (m1[uniq] / (1 - 0.9**t)) / (np.sqrt(m2[uniq] / (1 - 0.99**t)) + 1e-6)
            b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.99 * b2 + 0.01 * g.sum() ** 2
            m.w0 -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-6)
    m.w, m.v = p[:, 0].copy(), p[:, 1:].copy()
    z = 1 / (1 + np.exp(-np.clip(m.score(n, doc, feature, value), -30, 30)))
    ok = np.sort(z[held & (y > 0)])
    m.cut = float(np.clip(ok[int((1 - keep_good) * len(ok))], 0.1, 0.5)) if len(ok) else 0.0
    return m


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, p_good, keep) of every row of docs; see classify."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chunks(batches):
            doc, feature, value, stats = example(b)
            z = m.score(b.num_rows, *with_stats(doc, feature, value, stats, m.mean, m.scale))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            empty = stats[:, 0] == 0
            p[empty] = 0.0
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= m.cut) & ~empty)], ["doc_id", "p_good", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *META_COLS).mapInArrow(run, "doc_id long, p_good double, keep boolean")


def keep_rows(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that the machine keeps, with all their columns, in one scan and no shuffle.

    As classify: null, empty and wordless texts go, null ids and repeated rows are judged by their texts, each for itself; no rows
    give no rows, and other columns may have any name.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(machine), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chunks(batches):
            doc, feature, value, stats = example(b)
            z = m.score(b.num_rows, *with_stats(doc, feature, value, stats, m.mean, m.scale))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield b.filter(pa.array((p >= m.cut) & (stats[:, 0] > 0))).select(names)

    return docs.mapInArrow(run, docs.schema)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> Machine:
    """Train on labels.quality of at most ``max_labelled`` labelled documents of docs, least id hash first (documented bound)."""
    return train(sample_labelled(spark, docs, labels, ["quality"], max_labelled))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> DataFrame:
    """Factorisation-machine quality of every document: (doc_id, p_good, keep).

    One row for each row of docs, repeated rows alike.  A null text is an empty one; a text without a
    word has p_good 0 and isn't kept.  Null lang or source are values of their own; a null doc_id stays
    null.  Labels that are null or of no document don't count; without labels of both kinds all texts
    with words are kept.  Other columns are ignored.
    """
    return score_documents(docs, fit(spark, docs, labels, max_labelled))
