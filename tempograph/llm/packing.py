"""Operator 3: harmonic packing of documents into fixed-capacity training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CAPACITY = 2048
CLASSES = 64
ROWS_PER_SHARD = 4096


def token_estimate(text: str = "text") -> F.Column:
    """Tokens of a text by its UTF-8 bytes: a token for every 4 begun, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4)).cast("long")


def pack(docs: DataFrame, length: F.Column | None = None, capacity: int = CAPACITY, classes: int = CLASSES, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Harmonic packing: (doc_id, piece, piece_start, piece_tokens, class, shard, bin, slot), a row for each piece.

    A document longer than ``capacity`` is cut into full pieces and a rest.  A piece of length t is in
    class floor(capacity / t), at most ``classes``: t <= capacity / class, so that any ``class`` pieces of
    it fill a bin without overflow.  Each worker (shard: a hash of doc_id; their number follows the
    rows) fills each class's bins with that fixed number of pieces, in order of (doc_id, piece), on its
    own; only a shard's last bin of a class can be short.

    ``length`` is a column of whole tokens (default: token_estimate).  A null text is empty; lengths that
    are null or under 1 count as 1.  A null doc_id is an id like any other (shard 0).  Repeated rows are
    packed as often as they occur; which takes which slot is immaterial, as they are alike.  No rows
    give no rows.  Other columns are ignored.
    """
    size = F.greatest(F.lit(1), F.coalesce(length if length is not None else token_estimate(), F.lit(1))).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n"))
    shards = max(1, -(-docs.count() // rows_per_shard))
    key = F.expr("pmod(doc_id * 2654435761 % 4294967296, 4294967296)")
    d = d.withColumn("shard", F.coalesce(F.floor(key * shards / 4294967296), F.lit(0)).cast("long"))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))))
    d = d.withColumn("piece_start", F.col("piece") * capacity).withColumn("piece_tokens", F.least(F.lit(capacity), F.col("n") - F.col("piece_start")))
    d = d.withColumn("class", F.least(F.lit(classes), F.floor(F.lit(capacity) / F.col("piece_tokens"))).cast("long"))
    rank = F.row_number().over(W.partitionBy("shard", "class").orderBy("doc_id", "piece")) - 1
    return d.withColumn("r", rank.cast("long")).select("doc_id", "piece", "piece_start", "piece_tokens", "class", "shard", F.floor(F.col("r") / F.col("class")).alias("bin"), (F.col("r") % F.col("class")).alias("slot"))


def pack_sql(source: str = "documents", capacity: int = CAPACITY, classes: int = CLASSES, rows_per_shard: int = ROWS_PER_SHARD) -> str:
    """DuckDB SQL for pack() over a relation with doc_id and text."""
    return f"""
WITH src AS (SELECT doc_id, text FROM {source}),
k AS (SELECT greatest(1, CAST(ceil(count(*) / {rows_per_shard}.0) AS BIGINT)) AS shards FROM src),
d AS (SELECT doc_id, greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT)) AS n,
        coalesce(CAST(floor(((doc_id * 2654435761 % 4294967296 + 4294967296) % 4294967296)::DOUBLE * shards / 4294967296) AS BIGINT), 0) AS shard FROM src, k),
p AS (SELECT doc_id, shard, n, unnest(range(0, (n - 1) // {capacity} + 1)) AS piece FROM d),
q AS (SELECT doc_id, shard, piece, piece * {capacity} AS piece_start, least({capacity}, n - piece * {capacity}) AS piece_tokens FROM p),
c AS (SELECT *, least({classes}, {capacity} // piece_tokens) AS class FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY shard, class ORDER BY doc_id NULLS FIRST, piece) - 1 AS r FROM c)
SELECT doc_id, piece, piece_start, piece_tokens, class, shard, r // class AS bin, r % class AS slot FROM r
"""
