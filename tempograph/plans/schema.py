"""Fixed schemas of the graph's tables, and validators of names."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.sql import types as T


class GraphError(ValueError):
    """Base of the engine's errors."""


class NodeNotFound(GraphError):
    pass


class EdgeNotFound(GraphError):
    pass


class GroupIdError(GraphError):
    pass


class LabelError(GraphError):
    pass


class RerankerError(GraphError):
    pass


class SearchMethod(str, Enum):
    BM25 = "bm25"
    COSINE = "cosine_similarity"
    BFS = "breadth_first_search"


class Reranker(str, Enum):
    RRF = "reciprocal_rank_fusion"
    MMR = "mmr"
    NODE_DISTANCE = "node_distance"
    EPISODE_MENTIONS = "episode_mentions"
    CROSS_ENCODER = "cross_encoder"


_s, _t, _l, _v = T.StringType(), T.TimestampNTZType(), T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField("_seq", T.LongType())])


_NODE = [("uuid", _s), ("name", _s), ("group_id", _s), ("labels", _l), ("created_at", _t)]
_EDGE = [("uuid", _s), ("group_id", _s), ("source_node_uuid", _s), ("target_node_uuid", _s), ("created_at", _t)]

SCHEMAS: dict[str, T.StructType] = {
    "entity": _table(*_NODE, ("name_embedding", _v), ("summary", _s), ("attributes", _s)),
    "episodic": _table(*_NODE, ("source", _s), ("source_description", _s), ("content", _s), ("valid_at", _t), ("entity_edges", _l), ("episode_metadata", _s)),
    "community": _table(*_NODE, ("name_embedding", _v), ("summary", _s)),
    "saga": _table(*_NODE, ("summary", _s), ("first_episode_uuid", _s), ("last_episode_uuid", _s), ("last_summarized_at", _t), ("last_summarized_episode_valid_at", _t)),
    "entity_edge": _table(*_EDGE, ("name", _s), ("fact", _s), ("fact_embedding", _v), ("episodes", _l), ("expired_at", _t), ("valid_at", _t), ("invalid_at", _t), ("reference_time", _t), ("attributes", _s)),
    "mentions": _table(*_EDGE),
    "has_member": _table(*_EDGE),
    "has_episode": _table(*_EDGE),
    "next_episode": _table(*_EDGE),
}
NODES = ["entity", "episodic", "community", "saga"]
EDGES = ["entity_edge", "mentions", "has_member", "has_episode", "next_episode"]
#: Node tables of an edge's source and target.
ENDPOINTS: dict[str, tuple[list[str], list[str]]] = {
    "entity_edge": (["entity"], ["entity"]),
    "mentions": (["episodic"], ["entity"]),
    "has_member": (["community"], ["entity", "community"]),
    "has_episode": (["saga"], ["episodic"]),
    "next_episode": (["episodic"], ["episodic"]),
}
VECTORS = {"entity": "name_embedding", "community": "name_embedding", "entity_edge": "fact_embedding"}
PROTECTED = {"uuid", "name", "group_id", "labels", "created_at", "name_embedding", "summary", "attributes"}


def check_groups(groups: list[str] | None) -> list[str] | None:
    """Validated groups; None for none, an empty list or a single blank: all groups."""
    for g in groups or []:
        if g and not re.fullmatch(r"[A-Za-z0-9_-]+", g):
            raise GroupIdError(f"a group id has letters, digits, _ and - only: {g!r}")
    return None if not groups or groups == [""] else groups


def check_labels(labels: list[str] | None) -> list[str]:
    for x in labels or []:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x or ""):
            raise LabelError(f"not a label: {x!r}")
    return labels or []


def check_attributes(names: list[str]) -> None:
    if bad := PROTECTED & set(names):
        raise GraphError(f"protected attribute names: {sorted(bad)}")


def check_excluded(excluded: list[str] | None, known: list[str]) -> None:
    if bad := set(excluded or []) - set(known) - {"Entity"}:
        raise GraphError(f"unknown excluded types: {sorted(bad)}")
