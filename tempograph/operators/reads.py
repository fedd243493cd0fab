"""Reads of the graph's tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.operators.filters import in_groups
from tempograph.plans.schema import VECTORS, EdgeNotFound, NodeNotFound


def without_vectors(df: DataFrame) -> DataFrame:
    """Vector columns null, so that the scan doesn't read them."""
    for v in set(VECTORS.values()) & set(df.columns):
        df = df.withColumn(v, F.lit(None).cast(df.schema[v].dataType))
    return df


def by_uuid(df: DataFrame, uuid: str, edge: bool = False) -> DataFrame:
    """The row; an error if there is none."""
    got = df.where(F.col("uuid") == uuid)
    if not got.head(1):
        raise (EdgeNotFound if edge else NodeNotFound)(uuid)
    return got


def by_uuids(df: DataFrame, uuids: list[str], group: str | None = None) -> DataFrame:
    """Rows in the order of distinct uuids, with their place ``pos``; missing ones are left out."""
    spark = df.sparkSession
    ids = list(dict.fromkeys(uuids))
    wanted = spark.createDataFrame([(u, i) for i, u in enumerate(ids)], "uuid string, pos int")
    got = df.where(F.col("uuid").isin(ids)) if len(ids) <= 1000 else df
    got = got.where(F.col("group_id") == group) if group is not None else got
    return without_vectors(got).join(wanted, "uuid").orderBy("pos")


def page(df: DataFrame, groups: list[str] | None, limit: int | None = None, cursor: str | None = None, vectors: bool = False) -> DataFrame:
    """Keyset page: groups' rows by uuid descending, below the cursor."""
    df = df if vectors else without_vectors(df)
    p = in_groups(groups)
    df = df.where(p) if p is not None else df
    df = df.where(F.col("uuid") < cursor) if cursor else df
    df = df.orderBy(F.desc("uuid"))
    return df if limit is None else df.limit(max(0, limit))


def between(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where((F.col("source_node_uuid") == source) & (F.col("target_node_uuid") == target)).orderBy("uuid")


def incident(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("source_node_uuid") == node) | (F.col("target_node_uuid") == node)).orderBy("uuid")


def episodes_mentioning(episodes: DataFrame, mentions: DataFrame, entity: str | None = None) -> DataFrame:
    """(entity, episode uuid, first edge): distinct episodes of an entity (or of each), in order of their mention's uuid."""
    m = mentions.where(F.col("target_node_uuid") == entity) if entity else mentions
    first = m.groupBy("target_node_uuid", "source_node_uuid").agg(F.min("uuid").alias("edge"))
    j = first.join(episodes.select("uuid"), first["source_node_uuid"] == F.col("uuid"))
    return j.select(F.col("target_node_uuid").alias("entity"), "uuid", "edge").orderBy("entity", "edge")


def mentioned_nodes(entities: DataFrame, mentions: DataFrame, episodes: DataFrame) -> DataFrame:
    """(uuid, at) of entities mentioned by episodes (uuid, pos): distinct, first seen by (episode's place, edge uuid)."""
    m = mentions.join(episodes.select(F.col("uuid").alias("source_node_uuid"), "pos"), "source_node_uuid")
    first = m.groupBy("target_node_uuid").agg(F.min(F.struct("pos", F.col("uuid").alias("edge"))).alias("at"))
    return first.join(entities.select("uuid"), first["target_node_uuid"] == F.col("uuid")).select("uuid", F.col("at.pos").alias("pos"), F.col("at.edge").alias("edge"))


def communities_of(communities: DataFrame, has_member: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uuid, pos, edge) of communities of nodes (uuid, pos), first seen."""
    m = has_member.join(nodes.select(F.col("uuid").alias("target_node_uuid"), "pos"), "target_node_uuid")
    first = m.groupBy("source_node_uuid").agg(F.min(F.struct("pos", F.col("uuid").alias("edge"))).alias("at"))
    return first.join(communities.select("uuid"), first["source_node_uuid"] == F.col("uuid")).select("uuid", F.col("at.pos").alias("pos"), F.col("at.edge").alias("edge"))


def retrieve_episodes(episodes: DataFrame, until: datetime, last: int = 3, groups: list[str] | None = None, source: str | None = None, saga: str | None = None, sagas: DataFrame | None = None, has_episode: DataFrame | None = None) -> DataFrame:
    """Last episodes valid at ``until``, in order of time.

    With a saga's name: those of the saga of that name in the first group, once for each membership;
    without groups there are none.
    """
    df = episodes.where(F.col("valid_at") <= F.lit(until))
    df = df.where(F.col("source") == source) if source else df
    if saga is None:
        p = in_groups(groups)
        df = df.where(p) if p is not None else df
    elif not groups:
        return df.limit(0)
    else:
        own = find_saga(sagas, saga, groups[0]).select(F.col("uuid").alias("__saga"))
        own = has_episode.join(own, F.col("source_node_uuid") == F.col("__saga"), "left_semi").select(F.col("target_node_uuid").alias("__episode"))
        df = df.join(own, F.col("uuid") == F.col("__episode")).drop("__episode")
    top = df.orderBy(F.desc("valid_at"), F.asc("_seq")).limit(max(0, last))
    return top.orderBy(F.asc("valid_at"), F.desc("_seq"))


def find_saga(sagas: DataFrame, name: str, group: str) -> DataFrame:
    return sagas.where((F.col("name") == name) & (F.col("group_id") == group)).orderBy("uuid").limit(1)


def saga_episodes(episodes: DataFrame, has_episode: DataFrame) -> DataFrame:
    """(saga, episode row) of each membership."""
    return has_episode.select(F.col("source_node_uuid").alias("saga"), F.col("target_node_uuid").alias("uuid")).join(episodes, "uuid")


def previous_episode(episodes: DataFrame, has_episode: DataFrame, current: str | None = None) -> DataFrame:
    """(saga, previous): each saga's last episode by (valid_at, created_at), without the current one."""
    s = saga_episodes(episodes, has_episode)
    s = s.where(F.col("uuid") != current) if current else s
    return s.groupBy("saga").agg(F.max_by("uuid", F.struct("valid_at", "created_at", "uuid")).alias("previous"))


def previous_in_saga(episodes: DataFrame, has_episode: DataFrame) -> DataFrame:
    """(saga, uuid, previous) for each episode."""
    w = W.partitionBy("saga").orderBy("valid_at", "created_at", "uuid")
    return saga_episodes(episodes, has_episode).select("saga", "uuid", F.lag("uuid").over(w).alias("previous"))


def saga_contents(episodes: DataFrame, has_episode: DataFrame, since: datetime | None = None, limit: int = 200) -> DataFrame:
    """(saga, uuid, content, n): what is new since, oldest first; or the newest, in order of time.  The limit comes before empty contents are dropped."""
    s = saga_episodes(episodes, has_episode)
    if since is not None:
        s = s.where(F.col("created_at") > F.lit(since)).withColumn("n", F.row_number().over(W.partitionBy("saga").orderBy("created_at", "valid_at", "uuid")))
    else:
        s = s.withColumn("n", F.row_number().over(W.partitionBy("saga").orderBy(F.desc("valid_at"), F.desc("created_at"), F.desc("uuid"))))
    s = s.where(F.col("n") <= limit).where(F.coalesce(F.trim("content"), F.lit("")) != "")
    return s.select("saga", "uuid", "content", "n")


def group_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("group_id").distinct().orderBy("group_id")


def vectors(df: DataFrame, vector: str, uuids: list[str] | None = None) -> DataFrame:
    df = df.where(F.col("uuid").isin(uuids)) if uuids is not None else df
    return df.select("uuid", vector)


def nodes_and_facts_by_episode(episodes: DataFrame, entities: DataFrame, mentions: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentioned nodes of episodes (uuid, pos, entity_edges), and their listed facts, episode by episode (facts may repeat)."""
    listed = episodes.select("pos", F.posexplode("entity_edges").alias("k", "uuid"))
    return mentioned_nodes(entities, mentions, episodes), listed.join(facts, "uuid").orderBy("pos", "k")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
