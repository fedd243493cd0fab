"""Operator 5: language identification by language-bitmask n-gram filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempograph.llm.textkernel import chunks, fold, text_bytes

NGRAM = 4
HASHES = 2
LOG_SLOTS = 18


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 4-byte n-gram) of case-folded bytes, where all that isn't a letter is one kind of gap; grams of gaps only are left out."""
    low = fold(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, np.uint8(32))
    n = len(low)
    if n < NGRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    gram = np.zeros(n - NGRAM + 1, dtype=np.uint32)
    for k in range(NGRAM):
        gram |= low[k : n - NGRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = doc[: n - NGRAM + 1] == doc[NGRAM - 1 :]
    count = np.concatenate([[0], np.cumsum(letter)])
    ok = same & (count[NGRAM:] - count[:-NGRAM] >= 2)
    return doc[: n - NGRAM + 1][ok], gram[ok]


def slots(gram: np.ndarray, which: int) -> np.ndarray:
    x = gram.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[which])
    return (x >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: slot s holds a mask with bit l set if a gram of language l fell on it; 64 languages a word, as many words as it takes."""

    names: list[str]
    table: np.ndarray  # uint64 [words, slots]

    @classmethod
    def empty(cls, names: list[str]) -> "Filters":
        return cls(names, np.zeros((max(1, -(-len(names) // 64)), 1 << LOG_SLOTS), dtype=np.uint64))

    def add(self, language: int, gram: np.ndarray) -> None:
        for h in range(HASHES):
            self.table[language >> 6, slots(gram, h)] |= np.uint64(1 << (language & 63))

    def false_rate(self) -> np.ndarray:
        """Chance that a gram that isn't in language l seems to be: its fill, to the power of the hashes."""
        return np.array([np.mean((self.table[k >> 6] >> np.uint64(k & 63)) & np.uint64(1)) ** HASHES for k in range(len(self.names))])

    def counts(self, n: int, doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """[texts, languages]: grams of each text that are in each language's filter.

        One AND over the slots returns the mask of all languages with the gram; masks are counted by
        text, and bits then by language.
        """
        at = [slots(gram, h) for h in range(HASHES)]
        masks = []
        for word in self.table:
            masks.append(word[at[0]])
            for x in at[1:]:
                masks[-1] &= word[x]
        k = len(self.names)
        out = np.zeros((n, k))
        for low in range(0, k, 8):  # 8 languages at a time
            m = min(8, k - low)
            part = ((masks[low >> 6] >> np.uint64(low & 63)) & np.uint64(255)).astype(np.int64)
            by = np.bincount((doc << 8) + part, minlength=n << 8).reshape(n, 256)
            out[:, low : low + m] = by @ ((np.arange(256)[:, None] >> np.arange(m)) & 1)
        return out


def train(spark: SparkSession, docs: DataFrame, per_language: int = 400, min_share: float = 3e-5) -> Filters:
    """Filters of each language in docs.lang, from at most ``per_language`` documents of it, least id hash first (documented bound).

    A gram enters a language's filter if it makes at least ``min_share`` of the grams of its sample, so
    that stray words and names of others stay out.
    """
    docs = docs.select("doc_id", "text", "lang")
    d = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").alias("l"))
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = d.withColumn("r", rank).where(F.col("r") <= per_language).select(F.col("doc_id").alias("__id"), "l").distinct()
    sample = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("text", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            names = b.column("l").to_pylist()
            doc, gram = ngrams(*text_bytes(b.column("text")))
            kinds = sorted(set(names))
            code = np.array([kinds.index(x) for x in names])
            key, n = np.unique((code[doc].astype(np.uint64) << np.uint64(32)) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([kinds[i] for i in (key >> np.uint64(32)).astype(int)], pa.string()), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["l", "g", "n"])

    by = sample.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    kept = by.withColumn("all", F.sum("n").over(W.partitionBy("l"))).where(F.col("n") >= F.greatest(F.lit(2.0), min_share * F.col("all"))).select("l", "g").toArrow()
    lang = np.array(kept.column("l").to_pylist(), dtype=object)
    gram = kept.column("g").to_numpy().astype(np.uint64).astype(np.uint32)
    names = sorted(set(lang.tolist()))
    f = Filters.empty(names)
    for k, name in enumerate(names):
        f.add(k, gram[lang == name])
    return f


def identify(docs: DataFrame, filters: Filters, min_grams: int = 8, min_share: float = 0.25) -> DataFrame:
    """(doc_id, language, share, grams) of every row of docs.

    ``share`` is the part of the text's n-grams in the winning language's filter, corrected for false
    positives: (hits - grams * f) / (grams * (1 - f)).  'und' with fewer than ``min_grams`` grams or a
    share under ``min_share``; equal shares give the first name.  A null text is empty, thus 'und'; a
    null doc_id stays null; repeated rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        rate = f.false_rate()
        names = np.array([*f.names, "und"], dtype=object)
        for b in chunks(batches):
            n = b.num_rows
            doc, gram = ngrams(*text_bytes(b.column("text")))
            total = np.bincount(doc, minlength=n)
            share = np.zeros((n, max(1, len(f.names))))
            if f.names:
                share = (f.counts(n, doc, gram) - total[:, None] * rate) / (np.maximum(total, 1)[:, None] * np.maximum(1 - rate, 1e-9))
            best = share.argmax(axis=1)
            top = np.clip(share.max(axis=1), 0, 1)
            sure = (total >= min_grams) & (top >= min_share) & bool(f.names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(names[np.where(sure, best, len(f.names))], pa.string()), pa.array(np.where(total > 0, top, 0.0)), pa.array(total)], ["doc_id", "language", "share", "grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, language string, share double, grams long")
