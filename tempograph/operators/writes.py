"""Mutations as transformations: each takes tables and gives new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.plans.schema import EDGES, ENDPOINTS, NODES
from tempograph.sources.tables import written

Tables = dict[str, DataFrame]


def upsert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace base rows of their uuid; of rows that share a uuid the latest (_seq) stays.

    Only the new rows are ranked; the base is filtered by an anti join on their ids.
    """
    new = rows.withColumn("__n", F.row_number().over(W.partitionBy("uuid").orderBy(F.desc("_seq")))).where("__n = 1").drop("__n")
    return base.join(new.select("uuid"), "uuid", "left_anti").unionByName(new.select(*base.columns))


def with_endpoints(tables: Tables, kind: str, edges: DataFrame) -> DataFrame:
    """Edges whose both endpoints exist in a table of the right kind; others are dropped silently.  Targets come first: facts may lie by them already."""
    for end, kinds in reversed(list(zip(("source_node_uuid", "target_node_uuid"), ENDPOINTS[kind], strict=True))):
        ids = None
        for k in kinds:
            own = tables[k].select(F.col("uuid").alias("__end"))
            ids = own if ids is None else ids.unionByName(own)
        edges = edges.join(ids, F.col(end) == F.col("__end"), "left_semi")
    return edges


def save_nodes(tables: Tables, kind: str, rows: DataFrame) -> Tables:
    return tables | {kind: upsert(tables[kind], rows)}


def save_edges(tables: Tables, kind: str, rows: DataFrame) -> Tables:
    return tables | {kind: upsert(tables[kind], with_endpoints(tables, kind, rows))}


def save_bulk(tables: Tables, rows: Tables) -> Tables:
    """Episodes and entities first, then mentions and facts, which may refer to them."""
    for kind in [k for k in ("episodic", "entity", "community", "saga") if k in rows]:
        tables = save_nodes(tables, kind, rows[kind])
    for kind in [k for k in ("mentions", "entity_edge", "has_member", "has_episode", "next_episode") if k in rows]:
        tables = save_edges(tables, kind, rows[kind])
    return tables


def delete_nodes(tables: Tables, kind: str, ids: DataFrame) -> Tables:
    """Without the nodes (uuid) and the edges that can be attached to that kind of node."""
    gone = ids.select(F.col("uuid").alias("__gone")).distinct()
    out = tables | {kind: tables[kind].join(gone, F.col("uuid") == F.col("__gone"), "left_anti")}
    for e, (sources, targets) in ENDPOINTS.items():
        if e not in out:
            continue
        for end, kinds in (("source_node_uuid", sources), ("target_node_uuid", targets)):
            if kind in kinds:
                out[e] = out[e].join(gone, F.col(end) == F.col("__gone"), "left_anti")
    return out


def delete_group(tables: Tables, kind: str, group: str) -> Tables:
    return delete_nodes(tables, kind, tables[kind].where(F.col("group_id") == group))


def delete_edges(tables: Tables, ids: DataFrame, kinds: list[str] | None = None) -> Tables:
    gone = ids.select("uuid").distinct()
    return tables | {k: tables[k].join(gone, "uuid", "left_anti") for k in kinds or EDGES if k in tables}


def clear(tables: Tables, groups: list[str] | None = None) -> Tables:
    """Everything; or the groups' nodes but sagas, with the edges at them."""
    if groups is None:
        return {k: t.limit(0) for k, t in tables.items()}
    for kind in NODES:
        if kind != "saga" and kind in tables:
            tables = delete_nodes(tables, kind, tables[kind].where(F.col("group_id").isin(groups)))
    return tables


def remove_episodes(tables: Tables, ids: DataFrame) -> Tables:
    """Without episodes (uuid), what only they tell, and with their sagas' chains repaired.

    Facts that the episodes list lose them from their own list, and go if none is left.  An entity goes if
    the removed episodes mention it and no other does, unless a fact that stays ends at it.
    """
    gone = ids.select("uuid").distinct()
    own = tables["episodic"].join(gone, "uuid", "left_semi")
    listed = own.select(F.explode("entity_edges").alias("uuid"), F.col("uuid").alias("__e")).groupBy("uuid").agg(F.collect_set("__e").alias("__gone"))
    facts = tables["entity_edge"].join(listed, "uuid", "left").withColumn("episodes", F.when(F.col("__gone").isNull(), F.col("episodes")).otherwise(F.array_except("episodes", "__gone")))
    facts = facts.where(F.col("__gone").isNull() | (F.size("episodes") > 0)).drop("__gone").select(*tables["entity_edge"].columns)
    marked = tables["mentions"].join(gone.select(F.col("uuid").alias("source_node_uuid"), F.lit(1).alias("__x")), "source_node_uuid", "left")
    alone = marked.groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.countDistinct("source_node_uuid").alias("n"), F.count("__x").alias("x"), F.countDistinct(F.when(F.col("__x") == 1, F.col("source_node_uuid"))).alias("g")).where("x > 0 and n = g")
    kept_ends = facts.select(F.explode(F.array("source_node_uuid", "target_node_uuid")).alias("uuid"))
    out = delete_nodes(tables | {"entity_edge": facts}, "entity", alone.join(kept_ends, "uuid", "left_anti"))
    before = tables
    out = delete_nodes(out, "episodic", gone)
    return repair_sagas(before, out, gone)


def repair_sagas(before: Tables, after: Tables, gone: DataFrame) -> Tables:
    """Firsts and lasts of sagas over what is left by (valid_at, created_at, uuid), and bridges over removed episodes.

    A bridge joins each episode before a run of removed ones with each after it, but no episode with itself
    and no pair that is joined already.
    """
    if "saga" in after and "has_episode" in after:
        touched = before["has_episode"].join(gone.select(F.col("uuid").alias("target_node_uuid")), "target_node_uuid", "left_semi").select(F.col("source_node_uuid").alias("uuid")).distinct()
        left = after["has_episode"].select(F.col("source_node_uuid").alias("saga"), F.col("target_node_uuid").alias("uuid")).join(after["episodic"].select("uuid", "valid_at", "created_at"), "uuid")
        ends = left.groupBy(F.col("saga").alias("uuid")).agg(F.min_by("uuid", F.struct("valid_at", "created_at", "uuid")).alias("__f"), F.max_by("uuid", F.struct("valid_at", "created_at", "uuid")).alias("__l"))
        s = after["saga"].join(touched.withColumn("__t", F.lit(True)), "uuid", "left").join(ends, "uuid", "left")
        s = s.withColumn("first_episode_uuid", F.when(F.col("__t"), F.col("__f")).otherwise(F.col("first_episode_uuid"))).withColumn("last_episode_uuid", F.when(F.col("__t"), F.col("__l")).otherwise(F.col("last_episode_uuid")))
        after = after | {"saga": s.select(*after["saga"].columns)}
    if "next_episode" in after:
        links = bridged(before["next_episode"], gone)
        after = after | {"next_episode": links}
    return after


def bridged(links: DataFrame, gone: DataFrame) -> DataFrame:
    """next_episode links without the removed episodes (uuid), and with bridges over them.

    Ways through removed episodes are followed by doubling: the number of joins is the logarithm of the longest run.
    A bridge has the group and time of the link that leads into the run.
    """
    out = gone.select(F.col("uuid").alias("r")).distinct()
    flag = lambda rows, end: rows.join(out.withColumnRenamed("r", end).withColumn(f"{end}_gone", F.lit(True)), end, "left")
    marked = written(flag(flag(links.select(F.col("source_node_uuid").alias("a"), F.col("target_node_uuid").alias("b"), "group_id", "created_at", "_seq"), "a"), "b"))
    jump = written(marked.where("a_gone and a <> b").select(F.col("a").alias("r"), "b", "b_gone").distinct())
    for _ in range(max(1, jump.count()).bit_length()):
        if not jump.where("b_gone").head(1):
            break
        further = jump.where("b_gone").join(jump.select(F.col("r").alias("b"), F.col("b").alias("c"), F.col("b_gone").alias("c_gone")), "b").select("r", F.col("c").alias("b"), F.col("c_gone").alias("b_gone"))
        jump = written(jump.where("b_gone is null").unionByName(further).distinct())
    ends = jump.where("b_gone is null").select("r", "b")
    into = marked.where("a_gone is null and b_gone").select("a", F.col("b").alias("r"), "group_id", "created_at", "_seq")
    new = into.join(ends, "r").where("a <> b").groupBy("a", "b").agg(F.min(F.struct("_seq", "r", "group_id", "created_at")).alias("x"))
    rest = links.join(out.withColumnRenamed("r", "source_node_uuid"), "source_node_uuid", "left_anti").join(out.withColumnRenamed("r", "target_node_uuid"), "target_node_uuid", "left_anti").select(*links.columns)
    new = new.join(rest.select(F.col("source_node_uuid").alias("a"), F.col("target_node_uuid").alias("b")), ["a", "b"], "left_anti")
    return rest.unionByName(new.select(F.sha2(F.concat_ws("|", F.lit("next"), "a", "b"), 256).alias("uuid"), "x.group_id", F.col("a").alias("source_node_uuid"), F.col("b").alias("target_node_uuid"), "x.created_at", "x._seq").select(*links.columns))
