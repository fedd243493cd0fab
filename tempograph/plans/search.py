"""Search of facts, entities, episodes and communities: retrievers, fusion and rerankers composed into one lazy plan a scope."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.functions.text import indexed_text
from tempograph.operators import ranking as rk
from tempograph.operators import traversal as tr
from tempograph.operators.filters import SearchFilters, filter_edges, filter_nodes
from tempograph.plans.schema import VECTORS, Reranker, RerankerError, SearchMethod, check_groups

Tables = dict[str, DataFrame]


@dataclass
class Scope:
    methods: list[SearchMethod] = field(default_factory=lambda: [SearchMethod.BM25])
    reranker: Reranker = Reranker.RRF
    sim_min_score: float = 0.6
    mmr_lambda: float = 0.5
    #: Decimals to which scores of MMR are compared; None: all.
    mmr_digits: int | None = None
    bfs_max_depth: int = 3


@dataclass
class Config:
    edge: Scope | None = None
    node: Scope | None = None
    episode: Scope | None = None
    community: Scope | None = None
    limit: int = 10
    reranker_min_score: float = 0.0


_B, _C, _W = SearchMethod.BM25, SearchMethod.COSINE, SearchMethod.BFS


def _recipes() -> dict[str, Config]:
    out: dict[str, Config] = {}
    two, three = [_B, _C], [_B, _C, _W]
    for name, r in (("rrf", Reranker.RRF), ("mmr", Reranker.MMR), ("cross_encoder", Reranker.CROSS_ENCODER)):
        weight = 1.0 if name == "mmr" else 0.5
        m = three if name == "cross_encoder" else two
        episode = Scope([_B], Reranker.CROSS_ENCODER if name == "cross_encoder" else Reranker.RRF)
        out[f"combined_hybrid_search_{name}"] = Config(Scope(m, r, mmr_lambda=weight), Scope(m, r, mmr_lambda=weight), episode, Scope(two, r, mmr_lambda=weight))
    for kind in ("edge", "node"):
        for name, r in (("rrf", Reranker.RRF), ("mmr", Reranker.MMR), ("node_distance", Reranker.NODE_DISTANCE), ("episode_mentions", Reranker.EPISODE_MENTIONS), ("cross_encoder", Reranker.CROSS_ENCODER)):
            out[f"{kind}_hybrid_search_{name}"] = Config(**{kind: Scope(three if name == "cross_encoder" else two, r)})
    for name, r in (("rrf", Reranker.RRF), ("mmr", Reranker.MMR), ("cross_encoder", Reranker.CROSS_ENCODER)):
        out[f"community_hybrid_search_{name}"] = Config(community=Scope(two, r), limit=3 if name == "cross_encoder" else 10)
    return out


RECIPES = _recipes()


def recipe(name: str, **changes: object) -> Config:
    return replace(RECIPES[name], **changes)


def check(config: Config) -> Config:
    if config.limit < 0:
        raise ValueError("limit is negative")
    for s in (config.edge, config.node, config.episode, config.community):
        if s:
            s.methods = [SearchMethod(m) for m in s.methods]
            s.reranker = Reranker(s.reranker)
    return config


def _vector_hits(df: DataFrame, kind: str, vector: list[float] | None, k: int, scope: Scope) -> DataFrame | None:
    return rk.knn(df.where(F.col(VECTORS[kind]).isNotNull()), VECTORS[kind], vector, k, scope.sim_min_score) if vector is not None else None


def _bounded(df: DataFrame) -> DataFrame:
    """A ranked list of at most a few limits, as a local table: its scan runs once, however often the list is used."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def _retrieve(t: Tables, kind: str, df: DataFrame, query: str, vector: list[float] | None, scope: Scope, k: int, filters: SearchFilters | None, groups: list[str] | None, origins: list[str] | None) -> list[DataFrame]:
    lists = []
    if SearchMethod.BM25 in scope.methods:
        lists.append(rk.bm25(df, indexed_text(kind), query, k))
    if SearchMethod.COSINE in scope.methods and vector is not None:
        lists.append(_vector_hits(df, kind, vector, k, scope))
    if SearchMethod.BFS in scope.methods or scope.reranker is not Reranker.RRF:
        lists = [_bounded(x) for x in lists]
    if SearchMethod.BFS in scope.methods:
        spark = df.sparkSession
        if origins is not None:
            start = spark.createDataFrame([(u, i) for i, u in enumerate(dict.fromkeys(o for o in origins if o))], "uuid string, pos int")
        elif lists:
            start = tr.default_origins(lists[0], lists[-1] if len(lists) > 1 else lists[0].limit(0), t["entity_edge"] if kind == "entity_edge" else None)
        else:
            start = spark.createDataFrame([], "uuid string, pos int")
        walk = tr.fact_hits if kind == "entity_edge" else tr.node_hits
        lists.append(_bounded(walk(_bounded(start), t["entity"], t["episodic"], t["mentions"], t["entity_edge"], scope.bfs_max_depth, k, filters, groups)))
    return lists


def _empty(df: DataFrame) -> DataFrame:
    return df.select("uuid", F.lit(0.0).cast("float").alias("score"), F.lit(0).alias("pos")).limit(0)


def search_facts(t: Tables, query: str, scope: Scope, limit: int = 10, vector: list[float] | None = None, filters: SearchFilters | None = None, groups: list[str] | None = None, center: str | None = None, origins: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """(uuid, score, pos) of facts."""
    df = filter_edges(t["entity_edge"], filters, groups, t["entity"])
    lists = _retrieve(t, "entity_edge", df, query, vector, scope, 2 * limit, filters, groups, origins)
    if not lists or limit <= 0:
        return _empty(df)
    if scope.reranker is Reranker.MMR:
        return rk.mmr(rk.merge_first_seen(lists), df, "fact_embedding", vector, limit, scope.mmr_lambda, min_score, scope.mmr_digits)
    if scope.reranker is Reranker.CROSS_ENCODER:
        return rk.cross_encode(_bounded(rk.rrf(lists, 2 * limit)), df, "fact", query, limit, min_score)
    if scope.reranker is Reranker.NODE_DISTANCE:
        if not center:
            raise RerankerError("node distance needs a center")
        return rk.facts_by_source_distance(rk.rrf(lists, min_score=min_score), t["entity_edge"], center).where(F.col("pos") < limit)
    if scope.reranker is Reranker.EPISODE_MENTIONS:
        return rk.facts_by_episodes(rk.rrf(lists, min_score=min_score), df).where(F.col("pos") < limit)
    return rk.rrf(lists, limit, min_score)


def search_nodes(t: Tables, query: str, scope: Scope, limit: int = 10, vector: list[float] | None = None, filters: SearchFilters | None = None, groups: list[str] | None = None, center: str | None = None, origins: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    df = filter_nodes(t["entity"], filters, groups)
    lists = _retrieve(t, "entity", df, query, vector, scope, 2 * limit, filters, groups, origins)
    if not lists or limit <= 0:
        return _empty(df)
    if scope.reranker is Reranker.MMR:
        return rk.mmr(rk.merge_first_seen(lists), df, "name_embedding", vector, limit, scope.mmr_lambda, min_score, scope.mmr_digits)
    if scope.reranker is Reranker.CROSS_ENCODER:
        return rk.cross_encode(rk.merge_first_seen(lists), df, "name", query, limit, min_score)
    if scope.reranker is Reranker.NODE_DISTANCE:
        if not center:
            raise RerankerError("node distance needs a center")
        return rk.node_distance(rk.rrf(lists), t["entity_edge"], center, min_score).where(F.col("pos") < limit)
    if scope.reranker is Reranker.EPISODE_MENTIONS:
        return rk.episode_mentions(rk.rrf(lists), t["mentions"], min_score).where(F.col("pos") < limit)
    return rk.rrf(lists, limit, min_score)


def search_episodes(t: Tables, query: str, scope: Scope, limit: int = 10, groups: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """Always by BM25, whatever the methods; search filters don't apply."""
    df = filter_nodes(t["episodic"], None, groups)
    if limit <= 0:
        return _empty(df)
    fused = rk.rrf([rk.bm25(df, indexed_text("episodic"), query, 2 * limit)], limit, 0.0 if scope.reranker is Reranker.CROSS_ENCODER else min_score)
    return rk.cross_encode(fused, df, "content", query, limit, min_score) if scope.reranker is Reranker.CROSS_ENCODER else fused


def search_communities(t: Tables, query: str, scope: Scope, limit: int = 10, vector: list[float] | None = None, groups: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """By BM25, and by vector whenever there is one, whatever the methods."""
    df = filter_nodes(t["community"], None, groups)
    if limit <= 0:
        return _empty(df)
    lists = [rk.bm25(df, indexed_text("community"), query, 2 * limit)]
    hits = _vector_hits(df, "community", vector, 2 * limit, scope)
    lists += [hits] if hits is not None else []
    if scope.reranker is Reranker.MMR:
        return rk.mmr(rk.merge_first_seen(lists), df, "name_embedding", vector, limit, scope.mmr_lambda, min_score, scope.mmr_digits)
    if scope.reranker is Reranker.CROSS_ENCODER:
        return rk.cross_encode(rk.merge_first_seen(lists), df, "name", query, limit, min_score)
    return rk.rrf(lists, limit, min_score)


def search(t: Tables, query: str, config: Config, vector: list[float] | None = None, filters: SearchFilters | None = None, groups: list[str] | None = None, center: str | None = None, origins: list[str] | None = None) -> DataFrame:
    """(scope, uuid, score, pos) of all scopes of the config; a blank query finds nothing."""
    check(config)
    groups = check_groups(groups)
    out = []
    blank = not (query or "").strip()
    own = {"edge": ("entity_edge", config.edge), "node": ("entity", config.node), "episode": ("episodic", config.episode), "community": ("community", config.community)}
    for name, (kind, scope) in own.items():
        if not scope:
            continue
        if blank:
            hits = _empty(t[kind])
        elif name == "edge":
            hits = search_facts(t, query, scope, config.limit, vector, filters, groups, center, origins, config.reranker_min_score)
        elif name == "node":
            hits = search_nodes(t, query, scope, config.limit, vector, filters, groups, center, origins, config.reranker_min_score)
        elif name == "episode":
            hits = search_episodes(t, query, scope, config.limit, groups, config.reranker_min_score)
        else:
            hits = search_communities(t, query, scope, config.limit, vector, groups, config.reranker_min_score)
        out.append(hits.select(F.lit(name).alias("scope"), "uuid", "score", "pos"))
    got = out[0]
    for x in out[1:]:
        got = got.unionByName(x)
    return got


def context(facts: DataFrame, entities: DataFrame, episodes: DataFrame, communities: DataFrame) -> str:
    """The found rows as a prompt's context; they are the few of a search."""
    date = lambda a, b: f"{a or 'date unknown'} - {b or 'present'}"
    f = [{"fact": r["fact"], "valid": date(r["valid_at"], r["invalid_at"])} for r in facts.select("fact", "valid_at", "invalid_at").collect()]
    e = [{"entity_name": r["name"], "summary": r["summary"]} for r in entities.select("name", "summary").collect()]
    p = [{"source_description": r["source_description"], "content": r["content"]} for r in episodes.select("source_description", "content").collect()]
    c = [{"community_name": r["name"], "summary": r["summary"]} for r in communities.select("name", "summary").collect()]
    part = lambda tag, rows: f"<{tag}>\n" + "\n".join(json.dumps(x, ensure_ascii=False, default=str) for x in rows) + f"\n</{tag}>"
    return "\n".join([part("FACTS", f), part("ENTITIES", e), part("EPISODES", p), part("COMMUNITIES", c)])
