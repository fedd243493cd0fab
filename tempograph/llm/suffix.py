"""Operator 1: passages repeated across documents, by a range-partitioned suffix array.

Only suffixes at sampled positions are sorted.  With passages of L words, n-grams of k = L // 2 + 1 words
and windows of w = L - k + 1 of them (together just L words), the position whose n-gram hashes least in each
window is sampled: equal passages of L words sample the same positions, whatever surrounds them, so that
no repeat of L words is missed and none is reported that isn't one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempograph.llm.common import id_bitmap, in_bitmap, numbers, table_of, tasks, written
from tempograph.llm.textkernel import Words, chunks, span_hash

MIN_WORDS = 50
_BITMAP = 25
_ROWS = 50_000
_DEPTHS = 4  # words of a suffix by which splitters are drawn: its lead


def _k(words: int) -> tuple[int, int]:
    k = words // 2 + 1
    return k, words - k + 1


def samples(w: Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word position in the chunk) of the sampled suffixes of each text with at least ``words`` words; and their n-gram hashes."""
    k, window = _k(words)
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = span_hash(w.hash, np.arange(n), np.arange(k, n + k))
    # sliding least hash by doubling: least[i] of gram[i : i + window]; windows must lie within a text
    at = np.flatnonzero(w.doc[: max(n - window + 1, 0)] == w.doc[window + k - 2 :]) if n >= window else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.int64), gram
    low, span = gram, 1
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    least = np.minimum(low[at], low[at + window - span])
    # the positions that hold a window's least value: the leftmost one of each window
    place = np.zeros(len(at), dtype=np.int64)
    todo = np.arange(len(at))
    for step in range(window):
        hit = gram[at[todo] + step] == least[todo]
        place[todo[hit]] = at[todo[hit]] + step
        todo = todo[~hit]
        if not len(todo):
            break
    return np.unique(place), gram


def grams(docs: DataFrame, words: int) -> DataFrame:
    """(h, lead, doc_id): n-gram hashes at sampled positions, each once for a batch's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words.of(b.column("text"))
            at, gram = samples(w, words)
            key, doc = gram[at], w.doc[at]
            order = np.lexsort((key, doc))
            key, doc, at = key[order], doc[order], at[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            ids = b.column("doc_id").to_numpy()[doc[new]]
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(lead(w.hash, at[new])), pa.array(ids)], ["h", "lead", "doc_id"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "h long, lead long, doc_id long")


def lead(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Leading _DEPTHS words of suffixes as a number that sorts as they do: 16 bits of each."""
    out = np.zeros(len(at), dtype=np.uint64)
    for d in range(_DEPTHS):
        out = (out << np.uint64(16)) | (token(hashes[at + d]).astype(np.uint64) >> np.uint64(16))
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def token(hashes: np.ndarray) -> np.ndarray:
    """32-bit number of a word; suffixes are compared as sequences of these."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def multikey_sort(keys: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of words, within given segments: (order, common), common[i] words shared with the row before.

    All segments are split at once: each by the median of three of its rows' words at its depth into
    lower, equal and higher rows; equal rows go on at the next word.  A row that starts a segment has common -1.
    """
    m, depth_max = keys.shape
    order = np.argsort(segment, kind="stable")
    seg = segment[order].astype(np.int64)
    common = np.full(m, -1, dtype=np.int64)
    start = np.concatenate([[True], seg[1:] != seg[:-1]]) if m else np.zeros(0, bool)
    begins = np.flatnonzero(start)
    ends = np.append(begins[1:], m)
    depth = np.zeros(len(begins), dtype=np.int64)
    live = ends - begins > 1
    begins, ends, depth = begins[live], ends[live], depth[live]
    while len(begins):
        size = ends - begins
        at = np.repeat(begins, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        own = np.repeat(np.arange(len(begins)), size)
        word = keys[order[at], depth[own]]
        a, b, c = keys[order[begins], depth], keys[order[begins + size // 2], depth], keys[order[ends - 1], depth]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[own]
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        put = np.argsort(own * 3 + side, kind="stable")
        order[at] = order[at][put]
        key = (own * 3 + side)[put]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first, last = at[new], at[np.append(new[1:], len(key)) - 1] + 1
        d = depth[own[put]][new]
        # two parts of a segment differ at its depth
        inner = first != begins[own[put][new]]
        common[first[inner]] = d[inner]
        equal = key[new] % 3 == 1
        d = d + equal
        done = d >= depth_max
        for f, e in zip(first[done & (last - first > 1)].tolist(), last[done & (last - first > 1)].tolist(), strict=True):
            common[f + 1 : e] = depth_max
        live = (last - first > 1) & ~done
        begins, ends, depth = first[live], last[live], d[live]
    return order, common


def suffixes(docs: DataFrame, hot: DataFrame, splitters: np.ndarray, words: int) -> DataFrame:
    """(bucket, doc_id, at, before, after, ctx): the sampled suffixes whose n-gram is in several documents, with their words around."""
    k, window = _k(words)
    shared = docs.sparkSession.sparkContext.broadcast((id_bitmap(hot, "h", _BITMAP), splitters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, cuts = shared.value
        for b in chunks(batches):
            w = Words.of(b.column("text"))
            at, gram = samples(w, words)
            at = at[in_bitmap(bitmap, gram[at], _BITMAP)]
            if not len(at):
                continue
            t = token(w.hash)
            doc = w.doc[at]
            before = np.minimum(at - w.first[doc], window - 1)
            after = np.minimum(w.first[doc + 1] - at, words)
            span = np.arange(-(window - 1), words)
            place = at[:, None] + span
            inside = (span >= -before[:, None]) & (span < after[:, None])
            ctx = np.where(inside, t[np.clip(place, 0, len(t) - 1)], 0).astype("<u4")
            bucket = np.searchsorted(cuts, lead(w.hash, at), side="right").astype(np.int32)
            width = ctx.shape[1] * 4
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(np.ascontiguousarray(ctx))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(b.column("doc_id").to_numpy()[doc]), pa.array((at - w.first[doc]).astype(np.int64)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), fixed.cast(pa.binary())], ["bucket", "doc_id", "at", "before", "after", "ctx"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "bucket int, doc_id long, at long, before int, after int, ctx binary")


def _repeats(words: int):  # noqa: ANN202
    k, window = _k(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table_of(batches)
        if t is None:
            return
        # whole buckets at a time, of about _ROWS suffixes, so that memory doesn't follow the task
        t = t.take(np.argsort(numbers(t, "bucket"), kind="stable"))
        bucket = numbers(t, "bucket")
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cuts, last = [0], 0
        for a in starts[1:].tolist():
            if a - last >= _ROWS:
                cuts.append(a)
                last = a
        for a, b in zip(cuts, [*cuts[1:], t.num_rows], strict=True):
            yield compare(t.slice(a, b - a).combine_chunks())

    def compare(t: pa.Table) -> pa.RecordBatch:
        doc, at, before, after = (numbers(t, c) for c in ("doc_id", "at", "before", "after"))
        m = len(doc)
        ctx = np.frombuffer(b"".join(t.column("ctx").to_pylist()), dtype="<u4").reshape(m, -1)
        right, left = ctx[:, window - 1 :], ctx[:, : window - 1][:, ::-1]
        # right: sorted suffixes; neighbours that share r words are one group at depth r
        order, common = multikey_sort(right, np.zeros(m, dtype=np.int64))
        run_of = np.empty(m, dtype=np.int64)
        run_of[order] = np.cumsum(common < k)
        # left: within runs that share the n-gram, sorted by the words before, read backwards
        order_l, common_l = multikey_sort(left, run_of)
        found = np.zeros((m, window), dtype=bool)
        copies = np.zeros((m, window), dtype=np.int32)
        origin = np.zeros((m, window), dtype=np.int64)
        rg, lg = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
        for back in range(window):
            ok = (before >= back) & (after >= words - back)
            rg[order] = np.cumsum(common < words - back)
            lg[order_l] = np.cumsum(common_l < back)
            rows = np.flatnonzero(ok)
            if len(rows) < 2:
                continue
            key = rg[rows] * (m + 2) + lg[rows]
            by = np.argsort(key, kind="stable")
            key, rows = key[by], rows[by]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(new, len(key)))
            least, most = np.minimum.reduceat(doc[rows], new), np.maximum.reduceat(doc[rows], new)
            found[rows, back] = np.repeat(least < most, n)
            copies[rows, back] = np.repeat(n, n)
            origin[rows, back] = np.repeat(least, n)
        # each run of marked windows of a suffix is an interval of its document
        edge = np.zeros((m, window + 2), dtype=np.int8)
        edge[:, 1:-1] = found
        step = np.diff(edge, axis=1)
        row, low = np.nonzero(step == 1)
        high = np.nonzero(step == -1)[1] - 1
        top = np.where(found, copies, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(at[row] - high), pa.array(at[row] - low + words), pa.array(top.max(axis=1)[row].astype(np.int64)), pa.array(np.where(found, origin, np.iinfo(np.int64).max).min(axis=1)[row])],
            ["doc_id", "b", "e", "copies", "origin"],
        )

    return run


def repeated_passages(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``min_words`` words that occur in two or more documents.

    (doc_id, first_word, last_word, words, copies, first_doc, first): a row for each maximal stretch of a
    document (words counted from 0, last_word exclusive) all of whose ``min_words``-word passages occur in
    another document too; ``copies``: the most occurrences of one of them, ``first_doc`` the least doc_id
    that has one, ``first`` whether that is this document.  Words are case-folded, without
    punctuation (textkernel).

    Suffixes are range-partitioned by their leading words with splitters drawn from a sample; each
    task sorts its suffixes by multikey quicksort and compares neighbours.  Splitters are leads, so
    suffixes that share a lead never fall on both sides of a boundary, and neighbours across one share
    fewer words than any repeat has.

    Null and short texts have no passages; rows without doc_id are left out; repeated rows of a
    doc_id are one document; a passage repeated in one document alone isn't reported.  No rows give no rows.
    Other columns are ignored.
    """
    n = tasks(spark)
    by = grams(docs, min_words).groupBy("h").agg(F.min("lead").alias("lead"), F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    hot = written(by.where("low < high").select("h", "lead", "n"), "hot")
    # a bounded sample of leads, each as likely as its suffixes are many, in a fixed order
    most = 64 * n
    drawn = hot.select("lead", (F.log(F.lit(1.0) - F.pmod(F.xxhash64("h"), F.lit(1 << 40)) / float(1 << 40)) / F.col("n")).alias("u")).orderBy(F.desc("u")).limit(most).select("lead").toArrow()
    leads = np.sort(drawn.column("lead").to_numpy())
    splitters = np.unique(leads[np.linspace(0, len(leads) - 1, min(8 * n, len(leads))).astype(int)]) if len(leads) else leads
    rows = suffixes(docs, hot, splitters, min_words)
    parts = rows.repartition(n, "bucket").mapInArrow(_repeats(min_words), "doc_id long, b long, e long, copies long, origin long")
    # overlapping and adjoining intervals of a document are one stretch
    by_doc = W.partitionBy("doc_id").orderBy("b", "e")
    reach = F.max("e").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    marked = parts.groupBy("doc_id", "b", "e").agg(F.max("copies").alias("copies"), F.min("origin").alias("origin"))
    marked = marked.withColumn("new", F.when(reach.isNull() | (F.col("b") > reach), 1).otherwise(0)).withColumn("k", F.sum("new").over(by_doc))
    out = marked.groupBy("doc_id", "k").agg(F.min("b").alias("first_word"), F.max("e").alias("last_word"), F.max("copies").alias("copies"), F.min("origin").alias("first_doc"))
    return out.select("doc_id", "first_word", "last_word", (F.col("last_word") - F.col("first_word")).alias("words"), "copies", "first_doc", (F.col("first_doc") == F.col("doc_id")).alias("first"))
