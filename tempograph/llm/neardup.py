"""Operator 8: SimHash near-duplicates by segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import cell_pairs, classes, components, drop_ids, fresh, row_ids, written
from tempograph.llm.textkernel import Words, chunks, simhash, weight_of

TABLES = 8  # independent fingerprints of 32 bits
SEGMENTS = 16  # of 2 bits each
RADIUS = 2  # differing bits of a 32-bit fingerprint
AGREE = 48  # differing bits of all 256, up to which a pair is linked

_WORDS = ["f0", "f1", "f2", "f3"]


def popcounts(x: np.ndarray) -> np.ndarray:
    """uint8 [n, SEGMENTS]: set bits of each 2-bit segment of 32-bit fingerprints."""
    shifts = np.arange(SEGMENTS, dtype=np.uint32) * 2
    s = (x[:, None] >> shifts) & np.uint32(3)
    return ((s & 1) + (s >> 1)).astype(np.uint8)


def cell(counts: np.ndarray) -> np.ndarray:
    """Number of the unit grid cell of popcounts."""
    return counts.astype(np.int64) @ (3 ** np.arange(SEGMENTS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the popcounts of 32-bit fingerprints, segment by segment in one word."""
    odd = np.uint32(0x55555555)

    def counts(x: np.ndarray) -> np.ndarray:
        return (x & odd) + ((x >> np.uint32(1)) & odd)

    # fields of 2 bits, 0..2: |u - v| is the popcount of the difference of unary codes (0: 00, 1: 01, 2: 11)
    unary = lambda c: (c & odd) | ((c >> np.uint32(1)) & odd) * np.uint32(3)
    return np.bitwise_count(unary(counts(a)) ^ unary(counts(b)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1, f2, f3): 256-bit SimHash of the words of each text, weighted by length; texts without words or ids left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words.of(b.column("text"))
            f = simhash(w.hash, weight_of(w.end - w.start), w.doc, b.num_rows, len(_WORDS)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(f[:, k].copy()) for k in range(len(_WORDS))]], ["doc_id", *_WORDS]).filter(pa.array(np.diff(w.first) > 0))

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f0 long, f1 long, f2 long, f3 long")


def _lanes(b: pa.RecordBatch) -> list[np.ndarray]:
    u = [b.column(c).to_numpy().view(np.uint64) for c in _WORDS]
    return [((u[t // 2] >> np.uint64(32 * (t % 2))) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for t in range(TABLES)]


def _cells(probes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Grid rows of each fingerprint: its own cell, and with ``probes`` all cells one step away.

    Two cells at Manhattan distance 2 or less are the same, or one step apart, or have a cell one step from
    both: fingerprints within RADIUS 2 meet, be it as probes.
    """
    power = 3 ** np.arange(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, cls = b.column("id").to_numpy(), b.column("cls").to_numpy()
            for t, x in enumerate(_lanes(b)):
                counts = popcounts(x)
                home = cell(counts)
                keys, rows = [home], [np.arange(len(home))]
                if probes:
                    for step in (-1, 1):
                        own, d = np.nonzero((counts + step >= 0) & (counts + step <= 2) if step > 0 else counts > 0)
                        keys.append(home[own] + step * power[d])
                        rows.append(own)
                at, key = np.concatenate(rows), np.concatenate(keys) + t * 3**SEGMENTS
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(at)) >= len(home)), pa.array(ids[at]), pa.array(cls[at]), pa.array(x[at].view(np.int32))], ["key", "probe", "id", "cls", "x"])

    return run


def _near(cells: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Manhattan distance, the lower bound, first; then Hamming distance."""
    x, y = (cells["x"][k].view(np.uint32) for k in (i, j))
    near = manhattan(x, y) <= RADIUS
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= RADIUS
    return near


def linked(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b, distance) of the pairs that are links: a 32-bit fingerprint within RADIUS and all bits within AGREE."""
    both = pairs.join(prints.selectExpr("id as a", *[f"{c} as a_{c}" for c in _WORDS]), "a").join(prints.selectExpr("id as b", *[f"{c} as b_{c}" for c in _WORDS]), "b")
    xors = [F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in _WORDS]
    half = F.lit(0xFFFFFFFF).cast("long")
    lane = F.least(*[F.least(F.bit_count(x.bitwiseAND(half)), F.bit_count(F.shiftrightunsigned(x, 32))) for x in xors])
    distance = sum((F.bit_count(x) for x in xors[1:]), F.bit_count(xors[0]))
    return both.select("a", "b", distance.alias("distance"), lane.alias("lane")).where((F.col("lane") <= RADIUS) & (F.col("distance") <= AGREE)).select("a", "b", "distance").distinct()


def links(prints: DataFrame, **split: int) -> DataFrame:
    """(a, b, distance), a < b: links between rows (id, f0, f1, f2, f3) that connect all that links do.

    The Manhattan distance of segment popcounts never exceeds the Hamming distance, so that the grid join
    misses no pair within RADIUS.  Pairs that are of one class by the links to the least id of their
    cells aren't compared (common.cell_pairs).
    """
    schema = "key long, probe boolean, id long, cls long, x int"
    first, cls = classes(prints.select("id", F.col("id").alias("cls"), *_WORDS).mapInArrow(_cells(False), schema).select("key", "id").distinct(), lambda p: linked(p, prints))
    rows = written(prints.join(cls, "id", "left").select("id", F.coalesce("root", "id").alias("cls"), *_WORDS), "classed")
    rest = linked(written(cell_pairs(rows, _cells(True), {"x": "int"}, _near, True, **split), "near"), prints)
    return first.unionByName(rest).distinct()


def groups(spark: SparkSession, docs: DataFrame, **split: int) -> DataFrame:
    """SimHash near-duplicate groups: (doc_id, group_id, keep), a row for each document of a group of two or more.

    Documents are linked when one of their eight 32-bit fingerprints differs in at most RADIUS bits and all
    256 bits in at most AGREE; groups are the connected components, ``group_id`` their least doc_id, and
    ``keep`` holds for that document alone.  Equal fingerprints are collapsed before the search, so
    thousands of copies cost one row.  Words are runs of ASCII letters, digits, _ and non-ASCII characters, in lower case
    (textkernel).  Null or empty texts, and texts without a word, are near nothing;
    rows without doc_id are left out.  Rows that share a doc_id and a fingerprint count once; with several
    fingerprints, the id is a member by each.  No rows give no rows.  Other columns are ignored.
    """
    f = written(fingerprints(docs).distinct(), "prints")
    unique = written(f.groupBy(*_WORDS).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "unique")
    same = f.join(unique.where("copies > 1").select(*_WORDS, "id"), _WORDS).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    found = components(links(unique.drop("copies"), **split).select("a", "b").unionByName(same), "a", "b")
    return found.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), (F.col("id") == F.col("root")).alias("keep"))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the least doc_id.

    Of rows that share a doc_id and a text one stays; with other texts the id is as many documents, which
    groups decide on one by one (common.row_ids).  Rows with null doc_id, and texts without words, stay as they are.  No rows give no rows;
    all columns stay, whatever their names.
    """
    keyed, key, again = row_ids(spark, docs)
    found = groups(spark, keyed.select(F.col(key).alias("doc_id"), "text"))
    rest = drop_ids(keyed, written(found.where("not keep").select("doc_id"), "gone"), key, "doc_id")
    if again is not None:
        # equal rows of an id: the one whose JSON is least
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        row = fresh(docs, "__row")
        many = rest.join(again, F.col("doc_id") == F.col(again.columns[0]), "left_semi")
        one = many.groupBy(key).agg(F.min_by(own, F.to_json(own)).alias(row)).select(F.col(f"{row}.*"))
        rest = rest.join(again, F.col("doc_id") == F.col(again.columns[0]), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one.select(*[F.col(f"`{c}`") for c in docs.columns]))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
