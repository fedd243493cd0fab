"""The engine's facade: a graph of tables with reads, writes, search and ingest."""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.functions.vector import fill_vectors, hash_embed
from tempograph.operators import communities as cm
from tempograph.operators import facts as fx
from tempograph.operators import ingest as ig
from tempograph.operators import reads, resolve, writes
from tempograph.operators.filters import SearchFilters
from tempograph.plans import search as plan
from tempograph.plans.schema import EDGES, SCHEMAS, VECTORS, GraphError, Reranker, check_groups
from tempograph.sources import tables as src


@dataclass
class Namespace:
    """Typed access to a table of the store."""

    store: GraphStore
    kind: str

    @property
    def table(self) -> DataFrame:
        return self.store.tables[self.kind]

    def get(self, uuid: str) -> DataFrame:
        return reads.by_uuid(self.table, uuid, self.kind in EDGES)

    def get_many(self, uuids: list[str], group: str | None = None) -> DataFrame:
        return reads.by_uuids(self.table, uuids, group)

    def page(self, groups: list[str] | None = None, limit: int | None = None, cursor: str | None = None, vectors: bool = False) -> DataFrame:
        return reads.page(self.table, check_groups(groups), limit, cursor, vectors)

    def between(self, source: str, target: str) -> DataFrame:
        return reads.between(self.table, source, target)

    def incident(self, node: str) -> DataFrame:
        return reads.incident(self.table, node)

    def vectors(self, uuids: list[str] | None = None) -> DataFrame:
        return reads.vectors(self.table, VECTORS[self.kind], uuids)

    def save(self, rows: DataFrame) -> None:
        f = writes.save_edges if self.kind in EDGES else writes.save_nodes
        self.store.commit(f(self.store.tables, self.kind, rows))

    def delete(self, uuids: list[str]) -> None:
        ids = self.store.spark.createDataFrame([(u,) for u in uuids], "uuid string")
        self.store.commit(writes.delete_edges(self.store.tables, ids, [self.kind]) if self.kind in EDGES else writes.delete_nodes(self.store.tables, self.kind, ids))

    def delete_group(self, group: str) -> None:
        self.store.commit(writes.delete_group(self.store.tables, self.kind, group))


@dataclass
class GraphStore:
    """Tables are immutable DataFrames: each write makes new ones, so whoever holds a table has a snapshot.

    ``extract`` turns episode contents into the JSON that operators.ingest parses (a DataFrame of
    (episode_uuid, group_id, content) to (episode_uuid, group_id, response)); without one, ingest stores episodes alone.
    ``written`` cuts the lineage of the tables that a write has changed (a table in the shared folder, by default).
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    extract: Callable[[DataFrame], DataFrame] | None = None
    written: Callable[[DataFrame], DataFrame] = src.written
    dim: int = 1024
    store_raw_content: bool = True

    def __post_init__(self) -> None:
        self.tables = src.empty(self.spark) | self.tables

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Take new tables, writing those that changed."""
        self.tables = {k: t if t is self.tables.get(k) else self.written(t) for k, t in tables.items()}

    def __getattr__(self, kind: str) -> Namespace:
        if kind in SCHEMAS:
            return Namespace(self, kind)
        raise AttributeError(kind)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options: object) -> GraphStore:
        return cls(spark, src.load(spark, path), **options)

    def save(self, path: str) -> None:
        src.store(self.tables, path)

    def clear(self, groups: list[str] | None = None) -> None:
        self.commit(writes.clear(self.tables, groups))

    def save_bulk(self, rows: dict[str, DataFrame]) -> None:
        for kind, (text, vector) in {"entity": ("name", "name_embedding"), "entity_edge": ("fact", "fact_embedding")}.items():
            if kind in rows:
                rows = rows | {kind: fill_vectors(rows[kind], text, vector, self.dim)}
        self.commit(writes.save_bulk(self.tables, rows))

    def retrieve_episodes(self, until: datetime, last: int = 3, groups: list[str] | None = None, source: str | None = None, saga: str | None = None) -> DataFrame:
        return reads.retrieve_episodes(self.tables["episodic"], until, last, check_groups(groups), source, saga, self.tables["saga"], self.tables["has_episode"])

    def search(self, query: str, groups: list[str] | None = None, limit: int = 10, center: str | None = None, filters: SearchFilters | None = None) -> DataFrame:
        """Facts, by fusion, or by distance from a center."""
        config = plan.recipe("edge_hybrid_search_node_distance" if center else "edge_hybrid_search_rrf", limit=limit)
        return self.search_config(query, config, groups, center, filters)

    def search_advanced(self, query: str, groups: list[str] | None = None, limit: int = 10, filters: SearchFilters | None = None) -> DataFrame:
        return self.search_config(query, plan.recipe("combined_hybrid_search_cross_encoder", limit=limit), groups, None, filters)

    def search_config(self, query: str, config: plan.Config, groups: list[str] | None = None, center: str | None = None, filters: SearchFilters | None = None, origins: list[str] | None = None) -> DataFrame:
        scopes = [s for s in (config.edge, config.node, config.community) if s]
        need = any(plan.SearchMethod.COSINE in s.methods or s.reranker is Reranker.MMR for s in scopes)
        vector = [float(x) for x in hash_embed([(query or "").replace("\n", " ")], self.dim)[0]] if need else None
        return plan.search(self.tables, query, config, vector, filters, groups, center, origins)

    def remove_episode(self, uuid: str) -> None:
        self.commit(writes.remove_episodes(self.tables, self.spark.createDataFrame([(uuid,)], "uuid string")))

    def nodes_and_facts_by_episode(self, uuids: list[str]) -> tuple[DataFrame, DataFrame]:
        e = reads.by_uuids(self.tables["episodic"], uuids)
        return reads.nodes_and_facts_by_episode(e, self.tables["entity"], self.tables["mentions"], self.tables["entity_edge"])

    def build_communities(self, groups: list[str] | None = None) -> None:
        t = self.tables
        e = t["entity"] if not groups else t["entity"].where(F.col("group_id").isin(groups))
        old = t["community"] if not groups else t["community"].where(F.col("group_id").isin(groups))
        self.commit(writes.delete_nodes(t, "community", old))
        rows, members = cm.build(e, self.written(cm.label_propagation(e, t["entity_edge"])))
        now = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz")
        rows = rows.withColumn("labels", F.array(F.lit("Community"))).withColumn("created_at", now).withColumn("name_embedding", F.lit(None).cast("array<float>")).withColumn("_seq", F.monotonically_increasing_id())
        self.community.save(fill_vectors(self.written(rows.select(*SCHEMAS["community"].names)), "name", "name_embedding", self.dim))
        self.has_member.save(self.written(members.withColumn("created_at", now).withColumn("_seq", F.monotonically_increasing_id()).select(*SCHEMAS["has_member"].names)))

    def add_episodes(self, episodes: DataFrame, now: datetime | None = None) -> None:
        """Bulk ingest: store episodes, extract, resolve entities and facts, end what they contradict, save all."""
        now = now or datetime.now(UTC).replace(tzinfo=None)
        t, spark = self.tables, self.spark
        episodes = self.written(episodes)
        if self.extract is None:
            self.save_bulk({"episodic": episodes})
            return
        responses = self.written(self.extract(episodes.select(F.col("uuid").alias("episode_uuid"), "group_id", "content")))
        parsed, raw = ig.parse_table(responses)
        types = spark.createDataFrame([(0, "Entity")], "entity_type_id int, type string")
        nodes = ig.entity_rows(parsed, types)
        stamp = F.lit(now).cast("timestamp_ntz")
        nodes = nodes.select("uuid", "name", "group_id", "labels", stamp.alias("created_at"), F.lit(None).cast("array<float>").alias("name_embedding"), F.lit("").alias("summary"), F.lit("{}").alias("attributes"), F.xxhash64("uuid").alias("_seq"))
        nodes = self.written(nodes)
        same = self.written(resolve.resolve(nodes, t["entity"]))
        mapping = same.select("uuid", F.coalesce("match", "uuid").alias("canonical"))
        fresh = nodes.join(same.where("match is null").select("uuid"), "uuid", "left_semi").select(*SCHEMAS["entity"].names)
        raw = raw.withColumn("_seq", F.xxhash64("episode_uuid", "place"))
        built = fx.build_candidates(raw, nodes)
        iso = F.to_timestamp_ntz
        built = built.select(
            F.sha2(F.concat_ws("|", F.lit("fact"), "group_id", "source_node_uuid", "target_node_uuid", "fact"), 256).alias("uuid"), "group_id", "source_node_uuid", "target_node_uuid", stamp.alias("created_at"), F.col("relation").alias("name"), "fact", F.lit(None).cast("array<float>").alias("fact_embedding"),
            F.array("episode_uuid").alias("episodes"), F.lit(None).cast("timestamp_ntz").alias("expired_at"), iso("valid_at").alias("valid_at"), iso("invalid_at").alias("invalid_at"), F.lit(None).cast("timestamp_ntz").alias("reference_time"), F.lit("{}").alias("attributes"), "_seq",
        )
        new = self.written(resolve.rewrite_endpoints(built, mapping))
        dup = self.written(fx.exact_duplicates(new, t["entity_edge"]))
        kept = fx.expire_invalid(new.join(dup.select("uuid"), "uuid", "left_anti"), now)
        pairs = kept.select("source_node_uuid", "target_node_uuid", "name", F.col("uuid").alias("n"), F.col("valid_at").alias("new_valid_at"), F.col("invalid_at").alias("new_invalid_at")).join(t["entity_edge"].select(F.col("uuid").alias("candidate"), "source_node_uuid", "target_node_uuid", "name"), ["source_node_uuid", "target_node_uuid", "name"]).where("candidate <> n").select("candidate", "new_valid_at", "new_invalid_at")
        more = dup.join(new.select("uuid", "episodes"), "uuid").select(F.col("duplicate_of").alias("uuid"), F.explode("episodes").alias("e")).groupBy("uuid").agg(F.collect_set("e").alias("__e"))
        old = t["entity_edge"].join(more, "uuid", "left").withColumn("episodes", F.when(F.col("__e").isNull(), F.col("episodes")).otherwise(F.array_union("episodes", "__e"))).drop("__e").select(*SCHEMAS["entity_edge"].names)
        old = fx.invalidate(old, pairs, now)
        mention = parsed.select("episode_uuid", "group_id", F.sha2(F.concat_ws("|", F.lit("entity"), "group_id", resolve.normalize_key("name")), 256).alias("uuid")).distinct().join(mapping, "uuid")
        mention = mention.select(F.sha2(F.concat_ws("|", F.lit("mention"), "episode_uuid", "canonical"), 256).alias("uuid"), "group_id", F.col("episode_uuid").alias("source_node_uuid"), F.col("canonical").alias("target_node_uuid"), stamp.alias("created_at"), F.xxhash64("episode_uuid", "canonical").alias("_seq")).distinct()
        listed = new.join(dup, "uuid", "left").select(F.explode("episodes").alias("uuid"), F.coalesce("duplicate_of", "uuid").alias("f")).groupBy("uuid").agg(F.sort_array(F.collect_set("f")).alias("__f"))
        told = episodes.join(listed, "uuid", "left").withColumn("entity_edges", F.coalesce("__f", "entity_edges")).drop("__f").select(*SCHEMAS["episodic"].names)
        if not self.store_raw_content:
            told = told.withColumn("content", F.lit(""))
        self.commit(t | {"entity_edge": old})
        self.save_bulk({"episodic": told, "entity": fresh, "mentions": mention, "entity_edge": kept})

    def add_triplet(self, source: tuple[str, str], relation: str, fact: str, target: tuple[str, str], valid_at: datetime | None = None) -> None:
        """One fact between (name, group) nodes, which are resolved first."""
        if source[1] != target[1]:
            raise GraphError("the nodes are of two groups")
        response = f'{{"entities": [{{"name": {_json(source[0])}, "entity_type_id": 0}}, {{"name": {_json(target[0])}, "entity_type_id": 0}}], "edges": [{{"source": {_json(source[0])}, "target": {_json(target[0])}, "relation": {_json(relation)}, "fact": {_json(fact)}, "valid_at": {_json(valid_at.isoformat()) if valid_at else "null"}}}]}}'
        u = str(_uuid.uuid4())
        row = self.spark.createDataFrame([(u, source[1], response)], "episode_uuid string, group_id string, response string")
        before, self.extract = self.extract, lambda _: row
        episodic = self.tables["episodic"]
        try:
            at = datetime.now(UTC).replace(tzinfo=None)
            self.add_episodes(self.spark.createDataFrame([(u, "triplet", source[1], ["Episodic"], at, "fact_triple", "", fact, valid_at or at, [], None, 0)], SCHEMAS["episodic"]))
        finally:
            self.extract = before
        self.commit(self.tables | {"episodic": episodic, "mentions": self.tables["mentions"].where(F.col("source_node_uuid") != u)})

    def summarize_sagas(self) -> DataFrame:
        return ig.saga_summary(self.tables["saga"], self.tables["episodic"], self.tables["has_episode"])


def _json(x: str) -> str:
    import json

    return json.dumps(x)
