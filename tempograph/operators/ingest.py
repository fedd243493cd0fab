"""From extraction output to rows: parsing, attribute rules, summaries, sagas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.text import normalize_key

MOST_SUMMARY = 2000
MOST_ATTRIBUTE = 250

_ENTITY_KEYS = ("extracted_entities", "entities", "nodes")
_EDGE_KEYS = ("edges", "facts", "relationships")


def _first(d: dict, *names: str) -> object:
    return next((d[n] for n in names if d.get(n) is not None), None)


def parse_extraction(response: str | None) -> tuple[list[dict], list[dict]]:
    """Entities and edges of a JSON response, by its key aliases.

    An entity needs a name and an integer entity_type_id, which is an error otherwise; an edge with a
    blank source, target or fact is skipped; a relation is never invented: without one it is skipped too.
    """
    data = json.loads(response or "{}")
    if not isinstance(data, dict):
        raise ValueError("the response isn't an object")
    entities = []
    for x in _first(data, *_ENTITY_KEYS) or []:
        name = str(_first(x, "name", "entity_name") or "").strip()
        if not name:
            continue
        kind = _first(x, "entity_type_id", "type_id")
        if isinstance(kind, bool) or not isinstance(kind, int):
            raise ValueError(f"entity {name!r} has no entity_type_id")
        entities.append({"name": name, "entity_type_id": kind, "episode_indices": _indices(x)})
    edges = []
    for x in _first(data, *_EDGE_KEYS) or []:
        e = {
            "source_name": _first(x, "source_entity_name", "source", "source_name"), "target_name": _first(x, "target_entity_name", "target", "target_name"), "relation": _first(x, "relation_type", "relation", "name"),
            "fact": _first(x, "fact", "fact_text"), "valid_at": _first(x, "valid_at"), "invalid_at": _first(x, "invalid_at"),
        }
        e = {k: str(v).strip() if v is not None else None for k, v in e.items()}
        if all(e[k] for k in ("source_name", "target_name", "relation", "fact")):
            edges.append(e | {"episode_indices": _indices(x)})
    return entities, edges


def _indices(x: dict) -> list[int]:
    v = x.get("episode_indices")
    return [i for i in v if isinstance(i, int) and not isinstance(i, bool)] if isinstance(v, list) else []


def parse_table(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of (episode_uuid, group_id, response) rows; a malformed response gives none."""

    def run(batches: Iterator[pd.DataFrame], which: int) -> Iterator[pd.DataFrame]:
        columns = [["name", "entity_type_id", "episode_indices"], ["source_name", "target_name", "relation", "fact", "valid_at", "invalid_at", "episode_indices"]][which]
        for b in batches:
            rows = []
            for u, g, r in zip(b["episode_uuid"], b["group_id"], b["response"], strict=True):
                try:
                    got = parse_extraction(r)[which]
                except (ValueError, AttributeError, TypeError):
                    got = []
                rows += [(u, g, i, *[x[c] for c in columns]) for i, x in enumerate(got)]
            yield pd.DataFrame(rows, columns=["episode_uuid", "group_id", "place", *columns])

    head = "episode_uuid string, group_id string, place int, "
    entities = responses.mapInPandas(lambda b: run(b, 0), head + "name string, entity_type_id int, episode_indices array<int>")
    edges = responses.mapInPandas(lambda b: run(b, 1), head + "source_name string, target_name string, relation string, fact string, valid_at string, invalid_at string, episode_indices array<int>")
    return entities, edges


def normalize_indices(indices: Column, n: Column) -> Column:
    """Indices in range, distinct and sorted; null, empty or all invalid means all."""
    ok = F.array_sort(F.array_distinct(F.filter(indices, lambda i: (i >= 0) & (i < n))))
    return F.when(F.size(F.coalesce(ok, F.array().cast("array<int>"))) > 0, ok).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).cast("array<int>"))


def entity_rows(parsed: DataFrame, types: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Rows of parsed entities with types (entity_type_id, type): labels Entity and the type, excluded types left out, equal keys of a group collapsed with their indices merged."""
    t = parsed.join(F.broadcast(types), "entity_type_id", "left").withColumn("type", F.coalesce("type", F.lit("Entity")))  # a schema's few types
    if excluded:
        t = t.where(~F.lower("type").isin([x.lower() for x in excluded]))
    t = t.withColumn("labels", F.when(F.lower("type") == "entity", F.array(F.lit("Entity"))).otherwise(F.array(F.lit("Entity"), F.col("type"))))
    order = F.struct(F.size("labels"), F.length("name"), -F.col("place"))
    g = t.groupBy("group_id", normalize_key("name").alias("key")).agg(F.max_by(F.struct("name", "labels"), order).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("episode_indices")))).alias("episode_indices"))
    return g.select(F.sha2(F.concat_ws("|", F.lit("entity"), "group_id", "key"), 256).alias("uuid"), "group_id", F.col("x.name").alias("name"), F.col("x.labels").alias("labels"), "episode_indices")


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge ends at, by name."""
    ends = edges.select("group_id", F.col("source_name").alias("name")).union(edges.select("group_id", "target_name"))
    return nodes.join(ends, ["group_id", "name"], "left_semi")


def edge_type_allowed(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """edges with ``allowed``: whether a (source_label, target_label, type) row permits its relation; a missing node is an Entity."""
    lab = nodes.select("uuid", "labels")
    j = edges.join(lab.select(F.col("uuid").alias("source_node_uuid"), F.col("labels").alias("sl")), "source_node_uuid", "left").join(lab.select(F.col("uuid").alias("target_node_uuid"), F.col("labels").alias("tl")), "target_node_uuid", "left")
    only = F.array(F.lit("Entity"))
    pairs = j.select("uuid", "name", F.explode(F.coalesce("sl", only)).alias("source_label"), "tl").select("uuid", "name", "source_label", F.explode(F.coalesce("tl", only)).alias("target_label"))
    ok = pairs.join(F.broadcast(allowed.withColumnRenamed("type", "name")), ["source_label", "target_label", "name"], "left_semi").select("uuid").distinct()
    return edges.join(ok.withColumn("allowed", F.lit(True)), "uuid", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def merge_attributes(old: dict, new: dict, declared: dict[str, dict], replace: bool = False, most: int = MOST_ATTRIBUTE) -> dict:
    """Declared keys of new over old.  Too long strings are dropped unless required, as are lists with an item over ``most`` or over 8 times that in all; on replace, other declared keys go but those dropped keep their old value."""

    def fits(v: object) -> bool:
        if isinstance(v, str):
            return len(v) <= most
        if isinstance(v, list):
            sizes = [len(str(x)) for x in v]
            return max(sizes, default=0) <= most and sum(sizes) <= 8 * most
        return True

    out = {k: v for k, v in old.items() if k not in declared} if replace else dict(old)
    for k, rule in declared.items():
        if k in new and (fits(new[k]) or rule.get("required")):
            out[k] = new[k]
        elif replace and k in new and k in old:
            out[k] = old[k]
    return out


def summaries(entities: DataFrame, facts: DataFrame, most: int = MOST_SUMMARY) -> DataFrame:
    """(uuid, summary, by_model): the summary with its entity's non-blank facts on new lines in order; longer than ``most`` needs a model and stays as it is."""
    ends = facts.where(F.trim(F.coalesce("fact", F.lit(""))) != "").select("fact", "_seq", F.explode(F.array_distinct(F.array("source_node_uuid", "target_node_uuid"))).alias("uuid"))
    text = ends.groupBy("uuid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "fact"))), lambda x: x["fact"]), "\n").alias("t"))
    j = entities.select("uuid", "summary").join(text, "uuid", "left")
    full = F.concat_ws("\n", F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("summary")), F.col("t"))
    return j.select("uuid", F.when(F.length(full) <= most, full).otherwise(F.col("summary")).alias("summary"), (F.length(full) > most).alias("by_model"))


def chain(episodes: DataFrame, has_episode: DataFrame) -> DataFrame:
    """next_episode rows of each saga's episodes in order of (valid_at, created_at, uuid)."""
    w = W.partitionBy("saga").orderBy("valid_at", "created_at", "uuid")
    s = has_episode.select(F.col("source_node_uuid").alias("saga"), F.col("target_node_uuid").alias("uuid"), "group_id").join(episodes.select("uuid", "valid_at", "created_at"), "uuid")
    s = s.select("group_id", F.col("uuid").alias("source_node_uuid"), F.lead("uuid").over(w).alias("target_node_uuid"), "created_at").where("target_node_uuid is not null")
    return s.select(F.sha2(F.concat_ws("|", F.lit("next"), "source_node_uuid", "target_node_uuid"), 256).alias("uuid"), "group_id", "source_node_uuid", "target_node_uuid", "created_at")


def saga_summary(sagas: DataFrame, episodes: DataFrame, has_episode: DataFrame, most: int = 1000) -> DataFrame:
    """(saga, summary, watermark): old summary and the contents created since the last one, oldest first, cut at ``most`` characters; the watermark never falls."""
    s = has_episode.select(F.col("source_node_uuid").alias("saga"), F.col("target_node_uuid").alias("e")).join(episodes.select(F.col("uuid").alias("e"), "content", "valid_at", "created_at"), "e")
    j = sagas.select(F.col("uuid").alias("saga"), "summary", "last_summarized_at", "last_summarized_episode_valid_at").join(s, "saga").where("last_summarized_at is null or created_at > last_summarized_at")
    g = j.groupBy("saga").agg(F.first("summary").alias("old"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "valid_at", "e", "content"))), lambda x: x["content"]), "\n").alias("t"), F.greatest(F.max("valid_at"), F.max("last_summarized_episode_valid_at")).alias("watermark"))
    return g.select("saga", F.substring(F.concat_ws("\n", F.when(F.coalesce("old", F.lit("")) != "", F.col("old")), "t"), 1, most).alias("summary"), "watermark")


def token_usage(calls: DataFrame) -> DataFrame:
    """Calls (prompt, input_tokens, output_tokens) summed and averaged by prompt."""
    return calls.groupBy("prompt").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.avg("input_tokens").alias("avg_input"), F.avg("output_tokens").alias("avg_output"))
