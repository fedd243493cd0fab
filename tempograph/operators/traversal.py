"""Breadth-first traversal of mentions and facts: bounded joins over narrow edge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.operators.filters import SearchFilters, filter_edges, filter_nodes
from tempograph.sources.tables import written


def walk(origins: DataFrame, nodes: DataFrame, mentions: DataFrame, facts: DataFrame, depth: int) -> DataFrame:
    """Steps (ord, depth, kind, edge, target, origin_group) of outgoing walks from origins (uuid, pos).

    Mentions come before facts, edges by uuid.  A node is expanded once for each origin group, at its
    first visit, but steps to visited nodes are still listed.  Steps but the last are written, and the walk ends where one reaches nothing new.  ``ord`` sorts as the steps come: an array
    of (kind, edge) along the path, after the origin's place.  Unknown origins give nothing.
    """
    own = nodes.select("uuid", "group_id").distinct()
    edges = mentions.select(F.lit(0).alias("kind"), "uuid", "source_node_uuid", "target_node_uuid").unionByName(facts.select(F.lit(1).alias("kind"), "uuid", "source_node_uuid", "target_node_uuid"))
    path = "array<struct<a:long,b:string>>"
    front = origins.join(own, "uuid").groupBy("uuid", "group_id").agg(F.min("pos").alias("pos"))
    front = front.select("uuid", F.col("group_id").alias("origin_group"), F.array(F.struct(F.col("pos").cast("long").alias("a"), F.lit("").alias("b"))).cast(path).alias("ord"))
    seen = front.select("uuid", "origin_group")
    out = None
    for d in range(1, depth + 1):
        step = front.join(edges.withColumnsRenamed({"uuid": "edge"}), front["uuid"] == F.col("source_node_uuid")).select(
            F.concat("ord", F.array(F.struct(F.col("kind").cast("long").alias("a"), F.col("edge").alias("b")))).cast(path).alias("ord"), F.lit(d).alias("depth"), "kind", "edge", F.col("target_node_uuid").alias("target"), "origin_group"
        )
        step = written(step) if d < depth else step
        out = step if out is None else out.unionByName(step)
        if d < depth:
            new = step.groupBy(F.col("target").alias("uuid"), "origin_group").agg(F.min("ord").alias("ord")).join(seen, ["uuid", "origin_group"], "left_anti")
            if not new.head(1):
                break
            seen = seen.unionByName(new.select("uuid", "origin_group"))
            front = new
    return out


def _first(steps: DataFrame, key: str, limit: int | None) -> DataFrame:
    """First step for each key, 1 / depth its score.  Level by level, then as they come within one."""
    f = steps.groupBy(F.col(key).alias("uuid")).agg(F.min(F.struct("depth", "ord")).alias("at"))
    f = f.select("uuid", (1.0 / F.col("at.depth")).cast("float").alias("score"), "at")
    if limit is None:
        return f.select("uuid", "score", F.lit(None).cast("int").alias("pos"))
    f = f.orderBy("at").limit(limit)
    return f.withColumn("pos", (F.row_number().over(W.orderBy("at")) - 1).cast("int")).select("uuid", "score", "pos")


def node_hits(origins: DataFrame, entities: DataFrame, episodes: DataFrame, mentions: DataFrame, facts: DataFrame, depth: int = 3, limit: int | None = 10, filters: SearchFilters | None = None, groups: list[str] | None = None) -> DataFrame:
    """Entities reached from origins, in their origin's group and past the filters."""
    nodes = entities.select("uuid", "group_id").unionByName(episodes.select("uuid", "group_id"))
    steps = walk(origins, nodes, mentions, facts, depth) if depth >= 1 else None
    if steps is None:
        return entities.select("uuid", F.lit(0.0).cast("float").alias("score"), F.lit(0).alias("pos")).limit(0)
    ok = filter_nodes(entities, filters, groups).select(F.col("uuid").alias("target"), F.col("group_id").alias("origin_group"))
    return _first(steps.join(ok, ["target", "origin_group"], "left_semi"), "target", limit)


def fact_hits(origins: DataFrame, entities: DataFrame, episodes: DataFrame, mentions: DataFrame, facts: DataFrame, depth: int = 3, limit: int | None = 10, filters: SearchFilters | None = None, groups: list[str] | None = None) -> DataFrame:
    """Facts walked over from origins, past the filters; groups of origins don't count."""
    nodes = entities.select("uuid", "group_id").unionByName(episodes.select("uuid", "group_id"))
    steps = walk(origins, nodes, mentions, facts, depth) if depth >= 1 else None
    if steps is None:
        return facts.select("uuid", F.lit(0.0).cast("float").alias("score"), F.lit(0).alias("pos")).limit(0)
    steps = steps.where("kind = 1")
    if filters is not None or groups:
        steps = steps.join(filter_edges(facts, filters, groups, entities).select(F.col("uuid").alias("edge")), "edge", "left_semi")
    return _first(steps, "edge", limit)


def default_origins(text: DataFrame, vector: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(uuid, pos): distinct nodes of the text hits, then the vector hits; of facts, their source nodes."""
    both = text.select("uuid", "pos", F.lit(0).alias("list_no")).unionByName(vector.select("uuid", "pos", F.lit(1).alias("list_no")))
    if facts is not None:
        both = both.join(facts.select("uuid", "source_node_uuid"), "uuid").select(F.col("source_node_uuid").alias("uuid"), "pos", "list_no")
    first = both.groupBy("uuid").agg(F.min(F.struct("list_no", "pos")).alias("at"))
    return first.withColumn("pos", F.row_number().over(W.orderBy("at")) - 1).select("uuid", "pos")
