"""Operator 4: soft-membership mixing towards target weights."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import quality
from tempograph.llm.common import pairs_in_runs, sample_labelled, written
from tempograph.llm.features import META, STATS
from tempograph.llm.packing import token_estimate
from tempograph.llm.textkernel import CHUNK_BYTES, chunks
from tempograph.llm.textkernel import mix as mix64

#: Domain of a label row: good and clean, good but toxic, low quality.
DOMAINS = ["clean", "toxic", "low"]
TARGETS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}
SIZE = quality.BUCKETS + STATS + META


@dataclass
class Posterior:
    """Softmax regression over the shared features."""

    w: np.ndarray  # [features, domains]
    b: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def of(self, n: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        z = np.stack([np.bincount(doc, weights=self.w[feature, k] * value, minlength=n) for k in range(len(self.b))], axis=1) + self.b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, epochs: int = 12, batch: int = 128, seed: int = 3) -> Posterior:
    """Fit domain posteriors on at most ``max_labelled`` labelled documents, least id hash first (documented bound).

    Without labels of a domain its posterior is next to 0; without any, posteriors are equal.
    """
    s = sample_labelled(spark, docs, labels, ["quality", "toxic"], max_labelled)
    s = s.withColumn("__domain", F.when(F.col("__quality") == 0, 2).when(F.col("__toxic") == 1, 1).otherwise(0))
    doc, feature, value, stats, y = quality._collect(s, "__domain")
    n, k = len(y), len(DOMAINS)
    m = Posterior(np.zeros((SIZE, k)), np.zeros(k), np.zeros(STATS), np.ones(STATS))
    if not n:
        return m
    m.mean, m.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    doc, feature, value = quality.with_stats(doc, feature, value, stats, m.mean, m.scale)
    order = np.argsort(doc, kind="stable")
    doc, feature, value = doc[order], feature[order], value[order]
    ptr = np.searchsorted(doc, np.arange(n + 1))
    m.b = np.log((np.bincount(y, minlength=k) + 0.5) / n)
    rng, ids = np.random.default_rng(seed), np.arange(n)
    g2 = np.full((SIZE, k), 1e-4)
    for _ in range(epochs):
        rng.shuffle(ids)
        for i in range(0, n, batch):
            own = ids[i : i + batch]
            at = np.concatenate([np.arange(ptr[j], ptr[j + 1]) for j in own])
            d = np.repeat(np.arange(len(own)), ptr[own + 1] - ptr[own])
            f, x = feature[at], value[at]
            g = m.of(len(own), d, f, x)
            g[np.arange(len(own)), y[own]] -= 1
            g /= len(own)
            uniq, inv = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(inv, weights=g[d, c] * x, minlength=len(uniq)) for c in range(k)], axis=1) + 1e-6 * m.w[uniq]
            g2[uniq] += grad**2
            m.w[uniq] -= 0.2 * grad / np.sqrt(g2[uniq])
            m.b -= 0.1 * g.sum(axis=0)
    return m


def posteriors(docs: DataFrame, model: Posterior) -> DataFrame:
    """(doc_id, n_tokens, p array<double>) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chunks(batches):
            doc, feature, value, stats = quality.example(b)
            p = m.of(b.num_rows, *quality.with_stats(doc, feature, value, stats, m.mean, m.scale))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *quality.META_COLS, token_estimate().alias("n_tokens")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _rates(n: int, p: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Rates after the projected steps of history, all from rate 1: a row needs only its own posterior."""
    r = np.ones(n)
    for step in history:
        r = np.maximum(r - p @ step, 0)
    return r


#: Weight, as a share of all tokens, of the change of rates against the miss of the targets.
EASE = 1e-7


def fit_rates(members: DataFrame, targets: dict[str, float], iterations: int = 40, tolerance: float = 1e-4) -> np.ndarray:
    """The one projected step from r = 1 to the rates nearest to 1 of those with least |sum_d r_d n_d p_d - b|, r >= 0.

    b is the target weights times all tokens.  In the metric of the tokens the nearest rates are
    max(1 + p_d . x, 0) for some x of as many numbers as there are domains: x is found by Newton's method,
    each evaluation of which is one distributed sum, so that rare domains take no more steps than others.
    EASE bounds x where the targets can't be met.  A warning tells when ``iterations`` evaluations
    don't suffice or a target is missed by more than ``tolerance`` of all tokens.
    """
    k = len(DOMAINS)
    weights = np.array([targets[x] for x in DOMAINS], dtype=float)
    weights /= weights.sum()

    def totals(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k + 2)
            for b in batches:
                n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                r = _rates(len(n), p, -x[None])
                out[:k] += (r * n) @ p
                out[k:-2] += ((p * (n * (r > 0))[:, None]).T @ p).ravel()
                out[-2:] += (n * r * r).sum() / 2, n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["i", "x"])

        got = members.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k + k * k + 2)
        for r in got:
            out[r["i"]] = r["x"]
        return out

    x = np.zeros(k)
    now = totals(x)
    tokens = now[-1]
    if tokens <= 0:
        return np.zeros((0, k))
    b, ease = weights * tokens, EASE * tokens

    def slope(x: np.ndarray, now: np.ndarray) -> np.ndarray:
        return now[:k] - b + ease * x

    def value(x: np.ndarray, now: np.ndarray) -> float:
        return now[-2] - b @ x + ease * (x @ x) / 2

    step, length = None, 1.0
    for _ in range(iterations):
        g = slope(x, now)
        if np.abs(g).max() <= tolerance * tokens:
            break
        if step is None:
            step, length = -np.linalg.solve(now[k:-2].reshape(k, k) + ease * np.eye(k), g), 1.0
        then = totals(x + length * step)
        if value(x + length * step, then) <= value(x, now) + 1e-4 * length * (g @ step) + 1e-12 * tokens:
            x, now, step = x + length * step, then, None
        else:
            length /= 2
    missed = np.abs(now[:k] - b).max() / tokens
    if np.abs(slope(x, now)).max() > tolerance * tokens:
        warnings.warn(f"mixing: rates not fitted after {iterations} evaluations, a target is missed by {missed:.2g} of all tokens", stacklevel=2)
    elif missed > 2 * tolerance:
        warnings.warn(f"mixing: the targets can't be met, the nearest miss is {missed:.2g} of all tokens", stacklevel=2)
    return -x[None]


def copies(rate: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Rates rounded by a fixed uniform number of each id (one half for a null id)."""
    h = mix64(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 21)
    u = np.where(np.asarray(ids.is_null()), 0.5, (h >> np.uint64(11)).astype(float) / float(1 << 53))
    return np.floor(rate + u).astype(np.int64)


def repeated(b: pa.RecordBatch, n: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of b, row k n[k] times, in batches whose texts hold about ``most`` bytes: a rare domain's rates reach thousands, and an Arrow string column ends at 2 GB."""
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for rows, _ in pairs_in_runs(np.zeros_like(n), n, 1 << 14):
        full = (np.cumsum(size[rows]) - size[rows]) // most
        for part in np.split(rows, np.flatnonzero(np.diff(full)) + 1):
            yield b.take(pa.array(part))


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_labelled: int = 6000) -> DataFrame:
    """Soft-membership mixing: (doc_id, n_tokens, p_clean, p_toxic, p_low, rate, copies) of every row of docs.

    A classifier of the labelled table gives each document's posterior over DOMAINS; rates are
    fitted by distributed Newton steps so that the expected tokens of each domain, over all
    documents, come to the target weights of all tokens.  ``copies`` rounds the rate by a fixed uniform
    number of the doc_id, so that its mean is the rate.  A domain that no document is in can't be met:
    the fit is then the nearest, with a warning.  Null texts are empty (1 token); null ids round down at one half;
    repeated rows have a rate each; no rows give no rows; other columns are ignored.
    """
    targets = targets or TARGETS
    members = written(posteriors(docs, train(spark, docs, labels, max_labelled)), "members")
    history = fit_rates(members, targets)
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            rate = _rates(len(p), p, history)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), *[pa.array(p[:, i]) for i in range(k)], pa.array(rate), pa.array(copies(rate, b.column("doc_id")))], ["doc_id", "n_tokens", *[f"p_{x}" for x in DOMAINS], "rate", "copies"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"p_{x} double" for x in DOMAINS) + ", rate double, copies long")


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_labelled: int = 6000, fit_on: DataFrame | None = None) -> DataFrame:
    """docs with each row repeated ``copies`` times (see mix): rows at 0 go, all columns stay; no shuffle of texts.

    Null and empty texts count 1 token, null ids round at one half, repeated rows are repeated each by the rate they
    share; no rows give no rows, and other columns may have any name.  The classifier is fitted on the labelled documents of ``fit_on`` (default: docs).
    """
    model = train(spark, docs if fit_on is None else fit_on, labels, max_labelled)
    history = fit_rates(written(posteriors(docs, model), "members"), targets or TARGETS)
    shared, names = spark.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in chunks(batches):
            doc, feature, value, stats = quality.example(b)
            p = m.of(b.num_rows, *quality.with_stats(doc, feature, value, stats, m.mean, m.scale))
            n = copies(_rates(b.num_rows, p, history), b.column("doc_id").cast(pa.int64()))
            yield from repeated(b.select(names), n)

    return docs.mapInArrow(run, docs.schema)
