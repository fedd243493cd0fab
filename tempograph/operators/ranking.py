"""Retrieval, fusion and reranking.

Ranked lists are DataFrames (uuid, score float, pos int): pos counts from 0 in rank order.  Candidates are
ranked on narrow rows; payload is joined last.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.text import query_terms, runs, tokens
from tempograph.functions.vector import cosine, dot, l2_normalize, literal
from tempograph.sources.tables import written

K1, B = 1.2, 0.75


def with_pos(df: DataFrame, *order: Column) -> DataFrame:
    """(uuid, score, pos) of a bounded list; its rows were limited before, so one window task is enough."""
    return df.withColumn("pos", F.row_number().over(W.orderBy(*order)) - 1).select("uuid", F.col("score").cast("float").alias("score"), F.col("pos").cast("int").alias("pos"))


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """(uuid, score, pos) of a list of any length: rows are range-partitioned and sorted, and each partition's places begin after those before it.

    What the driver holds is a count for each partition.
    """
    t = written(df.orderBy(*order).select("uuid", F.col("score").cast("float").alias("score"), F.monotonically_increasing_id().alias("__at")))
    total, before = 0, []
    for r in t.groupBy(F.shiftright("__at", 33).alias("p")).count().orderBy("p").collect():
        before.append((r["p"], total))
        total += r["count"]
    starts = F.broadcast(t.sparkSession.createDataFrame(before, "__p long, __before long"))
    j = t.join(starts, F.shiftright("__at", 33) == F.col("__p"))
    return j.select("uuid", "score", (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"))


def top_by_score(df: DataFrame, k: int | None, min_score: float | None = None, strict: bool = False, seq: str = "_seq") -> DataFrame:
    """Best k rows of (uuid, score, seq): score descending, arrival ascending; k <= 0 is none, None all."""
    if k is not None and k <= 0:
        return df.limit(0)
    if min_score is not None:
        df = df.where(F.col("score") > min_score if strict else F.col("score") >= min_score)
    return df if k is None else df.orderBy(F.desc("score"), F.asc(seq)).limit(k)


def ranked(df: DataFrame, k: int, min_score: float | None = None, strict: bool = False, seq: str = "_seq") -> DataFrame:
    return with_pos(top_by_score(df, k, min_score, strict, seq), F.desc("score"), F.asc(seq))


def bm25_scores(df: DataFrame, text: Column, query: str, keep: list[str] | None = None) -> DataFrame:
    """Rows with score > 0 by BM25 over df as it is filtered: its statistics are of these rows.

    One pass, which runs at once: each text is cut into tokens once, rows that hold a term are written with their counts, and the
    statistics (as many numbers as the query has terms) are observed on the way.  No posting is shuffled.
    """
    keep = keep or ["uuid", "_seq"]
    terms = query_terms(query)
    if not terms:
        return df.select(*keep).withColumn("score", F.lit(0.0).cast("float")).limit(0)
    t = df.select(*keep, runs(text).alias("__t"))
    t = t.select(*keep, F.size("__t").alias("__n"), F.filter("__t", lambda x: F.lower(x).isin(terms)).alias("__m"))
    count = lambda w: F.size(F.filter("__m", lambda x: F.lower(x) == w))
    t = t.select(*keep, "__n", F.size("__m").alias("__hits"), *[F.when(F.size("__m") > 0, count(w)).otherwise(0).alias(f"__{i}") for i, w in enumerate(terms)])
    seen = Observation()
    t = t.observe(seen, F.count(F.lit(1)).alias("all"), F.sum("__n").alias("n"), *[F.sum((F.col(f"__{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    t = written(t.where("__hits > 0").drop("__hits"))
    got = seen.get
    if not got["n"]:
        return t.select(*keep, F.lit(0.0).cast("float").alias("score")).limit(0)
    average, score = got["n"] / got["all"], F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (got["all"] - got[f"df{i}"] + 0.5) / (got[f"df{i}"] + 0.5))
        tf = F.col(f"__{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / average))
    return t.select(*keep, score.cast("float").alias("score")).where("score > 0")


def bm25(df: DataFrame, text: Column, query: str, k: int) -> DataFrame:
    return ranked(bm25_scores(df, text, query), k)


def text_overlap(text: Column, query: str) -> Column:
    """(matches + distinct matches) / (tokens + distinct query terms), the identity cross-encoder; 0 without tokens or terms."""
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0).cast("float")
    t = tokens(text)
    hits = F.filter(t, lambda x: x.isin(terms))
    return F.when(F.size(t) > 0, (F.size(hits) + F.size(F.array_distinct(hits))) / (F.size(t) + len(terms))).otherwise(F.lit(0.0)).cast("float")


def knn(df: DataFrame, vector: str, query: list[float], k: int, min_score: float = 0.6) -> DataFrame:
    """Full-scan cosine, strictly above min_score, best k."""
    scored = df.select("uuid", "_seq", cosine(F.col(vector), literal(query)).cast("float").alias("score"))
    return ranked(scored, k, min_score, strict=True)


def rrf_scores(lists: list[DataFrame], const: int = 1) -> DataFrame:
    """(uuid, score, seen): sum of 1 / (pos + const) over the lists; seen is the first place over the lists in order."""
    rows = [x.select("uuid", "pos", F.lit(n).alias("list_no")) for n, x in enumerate(lists)]
    both = rows[0]
    for x in rows[1:]:
        both = both.unionByName(x)
    return both.groupBy("uuid").agg(F.sum(1.0 / (F.col("pos") + const)).cast("float").alias("score"), F.min(F.struct("list_no", "pos")).alias("seen"))


def rrf(lists: list[DataFrame], k: int | None = None, min_score: float = 0.0, const: int = 1) -> DataFrame:
    """Reciprocal rank fusion; input scores don't count, ties by first sight."""
    top = top_by_score(rrf_scores(lists, const), k, min_score, seq="seen")
    return with_pos(top, F.desc("score"), F.asc("seen"))


def merge_first_seen(lists: list[DataFrame], by_score: bool = False) -> DataFrame:
    """Union with the best score of each uuid, in order of first sight or by score."""
    rows = [x.select("uuid", "score", "pos", F.lit(n).alias("list_no")) for n, x in enumerate(lists)]
    both = rows[0]
    for x in rows[1:]:
        both = both.unionByName(x)
    m = both.groupBy("uuid").agg(F.max("score").alias("score"), F.min(F.struct("list_no", "pos")).alias("seen"))
    return with_pos(m, *([F.desc("score")] if by_score else []), F.asc("seen"))


def mmr(candidates: DataFrame, vectors: DataFrame, vector: str, query: list[float], k: int, weight: float = 0.5, min_score: float = 0.0, digits: int | None = None) -> DataFrame:
    """Maximal marginal relevance in one pass: weight * q.x + (weight - 1) * max(0, best other x.y) of scaled candidates.

    Candidates are the few of a search (at most six limits), so their self-join is small.  A candidate
    without vector has all its products 0.  With ``digits``, scores that are equal when rounded to them are ties, which go by the
    candidates' order: near copies of the query have scores of 0 but for the last digits of their sums.
    """
    c = candidates.select("uuid", "pos").join(vectors.select("uuid", F.col(vector).alias("v")), "uuid", "left").withColumn("v", l2_normalize("v"))
    other = c.select(F.col("uuid").alias("o"), F.col("v").alias("w"))
    sims = c.join(other, F.col("uuid") != F.col("o")).groupBy("uuid").agg(F.max(F.coalesce(dot("v", "w"), F.lit(0.0))).alias("m"))
    j = c.join(sims, "uuid", "left")
    s = weight * F.coalesce(dot("v", literal(query)), F.lit(0.0)) + (weight - 1) * F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0))
    j = j.select("uuid", "pos", s.cast("float").alias("score"))
    if digits is None:
        return ranked(j, k, min_score, seq="pos")
    order = [F.desc(F.round(F.col("score").cast("double"), digits) + 0.0), F.asc("pos")]
    top = j.where(F.col("score") >= min_score).orderBy(*order).limit(max(0, k))
    return top.select("uuid", "score", (F.row_number().over(W.orderBy(*order)) - 1).cast("int").alias("pos"))


Scorer = Callable[[str, list[str]], list[float]]


def by_model(passages: DataFrame, query: str, scorer: Scorer, batch: int = 64) -> DataFrame:
    """(p, score) of distinct passages (p) by a model: ``scorer`` gets the query and up to ``batch`` passages at once, on the executors, and gives as many scores.

    A score that is missing, not finite or from outside 0 to 1 counts as 0 or is brought to the nearer end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                own = b["p"].iloc[k : k + batch].tolist()
                got = list(scorer(query, own))
                if len(got) != len(own):
                    raise ValueError(f"the scorer gave {len(got)} scores for {len(own)} passages")
                fixed = [0.0 if x is None or not math.isfinite(x) else min(max(float(x), 0.0), 1.0) for x in got]
                yield pd.DataFrame({"p": own, "score": fixed})

    return passages.select("p").mapInPandas(run, "p string, score float")


def cross_encode(candidates: DataFrame, passages: DataFrame, passage: str, query: str, k: int, min_score: float = 0.0, scorer: Scorer | None = None) -> DataFrame:
    """Rerank by a cross-encoder, the identity one (text_overlap) unless there is a ``scorer``: equal passages are one, shown by its last candidate."""
    c = candidates.select("uuid", "pos").join(passages.select("uuid", F.coalesce(F.col(passage), F.lit("")).alias("p")), "uuid")
    one = c.groupBy("p").agg(F.max_by("uuid", "pos").alias("uuid"), F.min("pos").alias("pos"))
    if scorer is None:
        scored = one.select("uuid", "pos", text_overlap(F.col("p"), query).alias("score"))
    else:
        scored = one.join(by_model(one, query, scorer), "p").select("uuid", "pos", "score")
    return ranked(scored, k, min_score, seq="pos")


def node_distance(candidates: DataFrame, facts: DataFrame, center: str, min_score: float = 0.0, bounded: bool = True) -> DataFrame:
    """10 for the center, 1 for what shares a fact with it in either direction, else 0; input order within.

    ``bounded``: candidates are the few of a search; else they may be of any number.
    """
    near = facts.where(F.col("source_node_uuid") == center).select(F.col("target_node_uuid").alias("uuid")).union(facts.where(F.col("target_node_uuid") == center).select("source_node_uuid")).distinct()
    c = candidates.groupBy("uuid").agg(F.min("pos").alias("pos")).join(near.withColumn("near", F.lit(True)), "uuid", "left")
    s = F.when(F.col("uuid") == center, 10.0).when(F.col("near"), 1.0).otherwise(0.0)
    return (with_pos if bounded else placed)(c.withColumn("score", s).where(F.col("score") >= min_score), F.desc("score"), F.asc("pos"))


def episode_mentions(candidates: DataFrame, mentions: DataFrame, min_score: float = 0.0, bounded: bool = True) -> DataFrame:
    """Mention rows of each node, ascending; nodes without any have infinity and come last.  ``bounded`` as in node_distance."""
    n = mentions.groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.count("*").alias("n"))
    c = candidates.groupBy("uuid").agg(F.min("pos").alias("pos")).join(n, "uuid", "left")
    s = F.coalesce(F.col("n").cast("double"), F.lit(float("inf")))
    return (with_pos if bounded else placed)(c.withColumn("score", s).where(F.col("score") >= min_score), F.asc("score"), F.asc("pos"))


def facts_by_episodes(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts by number of episodes, descending; the scores keep their places."""
    c = candidates.join(facts.select("uuid", F.size("episodes").alias("n")), "uuid")
    moved = c.select("uuid", (F.row_number().over(W.orderBy(F.desc("n"), F.asc("pos"))) - 1).cast("int").alias("at"))
    return moved.join(candidates.select("score", F.col("pos").alias("at")), "at").select("uuid", "score", F.col("at").alias("pos"))


def facts_by_source_distance(candidates: DataFrame, facts: DataFrame, center: str, min_score: float = 0.0) -> DataFrame:
    """Facts in the order of their source nodes' distance; facts of one node keep their order."""
    c = candidates.join(facts.select("uuid", "source_node_uuid"), "uuid")
    nodes = c.groupBy(F.col("source_node_uuid").alias("uuid")).agg(F.min("pos").alias("pos"))
    order = node_distance(nodes, facts, center, min_score).select(F.col("uuid").alias("source_node_uuid"), F.col("score").alias("s"), F.col("pos").alias("np"))
    j = c.drop("score").join(order, "source_node_uuid").withColumnRenamed("s", "score")
    return with_pos(j, F.asc("np"), F.asc("pos"))


def match_passages(passages: DataFrame, scored: DataFrame) -> DataFrame:
    """(pos, uuid, score) of passages (pos, uuid, passage) matched to scored (rank, passage, score); equal ones first in, first out."""
    a = passages.withColumn("n", F.row_number().over(W.partitionBy("passage").orderBy("pos")))
    b = scored.withColumn("n", F.row_number().over(W.partitionBy("passage").orderBy("rank")))
    return a.join(b, ["passage", "n"]).select("rank", "uuid", "score")
