"""Queries over whole tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempograph.functions import text as tx
from tempograph.functions import vector as vx
from tempograph.operators import chunking, communities, facts, ingest, ranking, reads, resolve, traversal, writes
from tempograph.operators.filters import DateTest, SearchFilters, filter_edges, filter_nodes
from tempograph.plans import search as plan
from tempograph.plans.schema import Reranker, SearchMethod
from tempograph.sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_P9 = "lpad(CAST({} AS VARCHAR), 9, '0')"


def _k(prefix: str, column: str) -> str:
    return f"'{prefix}' || {_P9.format(column)}"


ENT = f"""ent AS (SELECT {_k("c", "c_custkey")} AS uuid, c_name AS name, c_mktsegment AS group_id, 'Customer' AS l, 'nation ' || c_nationkey AS summary, c_custkey AS _seq FROM customer
 UNION ALL SELECT {_k("s", "s_suppkey")}, s_name, 'SUPPLY', 'Supplier', 'nation ' || s_nationkey, s_suppkey + 1000000000 FROM supplier
 UNION ALL SELECT {_k("p", "p_partkey")}, p_name, p_type, 'Part', p_brand || ' ' || p_type, p_partkey + 2000000000 FROM part)"""
FCT = f"""fct AS (SELECT {_k("f", "l_orderkey")} || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || {_k("-", "l_partkey")} || {_k("-", "l_suppkey")} AS uuid, c_mktsegment AS group_id, {_k("c", "o_custkey")} AS s, {_k("p", "l_partkey")} AS t, 'ORDERED_' || l_returnflag AS name,
 c_name || ' ordered ' || CAST(l_quantity AS INTEGER) || ' ' || p_name AS fact, {_k("o", "l_orderkey")} AS ep, o_orderdate AS valid_at, CASE WHEN l_shipdate > o_orderdate THEN l_shipdate END AS invalid_at, l_orderkey * 10 + l_linenumber AS _seq
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
EVT = f"""evt AS (SELECT {_k("v", "event_id")} AS uuid, event_type AS group_id, ts AS valid_at, props AS content, {_k("m", "event_id")} AS m, {_k("c", "user_id")} AS entity, event_id AS _seq FROM events)"""
TRN = f"""trn AS (SELECT {_k("t", "conv_id")} || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS uuid, {_k("g", "conv_id")} AS saga, role, text AS content, turn, TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)) AS valid_at FROM conversations)"""
TOK = r"list_transform(regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))"


def query(sql: str | None = None, *base: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("WITH " + ", ".join(base) + " " if base else "") + sql
        return f

    return add


def _score(c: str = "score") -> F.Column:
    return F.round(F.col(c).cast("double"), 4).alias("score")


# --- reads


@query("SELECT uuid, name, group_id FROM ent WHERE uuid = 'c000000007'", ENT)
def s1_node_by_uuid(s: SparkSession, d: str) -> DataFrame:
    return reads.by_uuid(src.entities(s, d), "c000000007").select("uuid", "name", "group_id")


_IDS = ["p000000003", "c000000001", "missing", "s000000002", "c000000001"]


@query("SELECT e.uuid, e.name, w.pos FROM ent e JOIN (VALUES ('p000000003', 0), ('c000000001', 1), ('missing', 2), ('s000000002', 3)) w(uuid, pos) ON e.uuid = w.uuid", ENT)
def s2_nodes_by_uuids(s: SparkSession, d: str) -> DataFrame:
    return reads.by_uuids(src.entities(s, d), _IDS).select("uuid", "name", "pos")


@query("SELECT uuid, group_id FROM ent WHERE group_id IN ('BUILDING', 'MACHINERY') AND uuid < 'c000000100' ORDER BY uuid DESC LIMIT 50", ENT)
def s3_node_page(s: SparkSession, d: str) -> DataFrame:
    return reads.page(src.entities(s, d), ["BUILDING", "MACHINERY"], 50, "c000000100").select("uuid", "group_id")


@query("SELECT uuid, s AS source_node_uuid, t AS target_node_uuid, name FROM fct WHERE uuid = (SELECT min(uuid) FROM fct)", FCT)
def s4_edge_by_uuid(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    return reads.by_uuid(f, f.agg(F.min("uuid")).first()[0], edge=True).select("uuid", "source_node_uuid", "target_node_uuid", "name")


@query("SELECT uuid, group_id FROM fct WHERE group_id IN ('BUILDING') ORDER BY uuid DESC LIMIT 100", FCT)
def s5_edge_page(s: SparkSession, d: str) -> DataFrame:
    return reads.page(src.facts(s, d), ["BUILDING"], 100).select("uuid", "group_id")


@query("SELECT f.uuid FROM fct f JOIN (SELECT s, t FROM fct ORDER BY uuid LIMIT 1) x ON f.s = x.s AND f.t = x.t", FCT)
def s6_facts_between(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    x = f.orderBy("uuid").select("source_node_uuid", "target_node_uuid").first()
    return reads.between(f, x[0], x[1]).select("uuid")


@query("SELECT uuid, s AS source_node_uuid, t AS target_node_uuid FROM fct WHERE s = 'p000000005' OR t = 'p000000005'", FCT)
def s7_incident_facts(s: SparkSession, d: str) -> DataFrame:
    return reads.incident(src.facts(s, d), "p000000005").select("uuid", "source_node_uuid", "target_node_uuid")


@query("SELECT entity, uuid, min(m) AS edge FROM evt GROUP BY entity, uuid", EVT)
def s8_episodes_mentioning(s: SparkSession, d: str) -> DataFrame:
    return reads.episodes_mentioning(src.events(s, d), src.mentions(s, d))


@query("SELECT entity AS uuid, min(_seq) AS pos FROM evt WHERE entity IN (SELECT uuid FROM ent) GROUP BY entity", EVT, ENT)
def s9_mentioned_nodes(s: SparkSession, d: str) -> DataFrame:
    return reads.mentioned_nodes(src.entities(s, d), src.mentions(s, d), src.events(s, d).select("uuid", F.col("_seq").alias("pos"))).select("uuid", "pos")


@query(f"SELECT {_k('n', 'c_nationkey')} AS uuid, min(c_custkey) AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey")
def s10_communities_of_nodes(s: SparkSession, d: str) -> DataFrame:
    return reads.communities_of(src.communities(s, d), src.has_member(s, d), src.entities(s, d).select("uuid", F.col("_seq").alias("pos"))).select("uuid", "pos")


@query("SELECT uuid, valid_at FROM evt WHERE valid_at <= TIMESTAMP '2024-01-15' AND group_id IN ('view', 'click') ORDER BY valid_at DESC, _seq LIMIT 20", EVT)
def s11_retrieve_episodes(s: SparkSession, d: str) -> DataFrame:
    return reads.retrieve_episodes(src.events(s, d), datetime(2024, 1, 15), 20, ["view", "click"], "json").select("uuid", "valid_at")


@query("SELECT uuid, valid_at FROM trn WHERE saga = 'g000000003' AND valid_at <= TIMESTAMP '2024-01-02' ORDER BY valid_at DESC LIMIT 3", TRN)
def s11_retrieve_saga_episodes(s: SparkSession, d: str) -> DataFrame:
    return reads.retrieve_episodes(src.turns(s, d), datetime(2024, 1, 2), 3, ["talk"], None, "conversation 3", src.sagas(s, d), src.has_episode(s, d)).select("uuid", "valid_at")


@query(f"SELECT {_k('g', 'conv_id')} AS uuid FROM conversations WHERE conv_id = 5 GROUP BY conv_id")
def s12_find_saga(s: SparkSession, d: str) -> DataFrame:
    return reads.find_saga(src.sagas(s, d), "conversation 5", "talk").select("uuid")


@query("SELECT saga, max(uuid) AS previous FROM trn GROUP BY saga", TRN)
def s13_previous_episode(s: SparkSession, d: str) -> DataFrame:
    return reads.previous_episode(src.turns(s, d), src.has_episode(s, d))


@query("SELECT saga, uuid, lag(uuid) OVER (PARTITION BY saga ORDER BY valid_at, uuid) AS previous FROM trn", TRN)
def s13_previous_in_saga(s: SparkSession, d: str) -> DataFrame:
    return reads.previous_in_saga(src.turns(s, d), src.has_episode(s, d))


@query("SELECT * FROM (SELECT saga, uuid, content, row_number() OVER (PARTITION BY saga ORDER BY valid_at DESC, uuid DESC) AS n FROM trn) WHERE n <= 200 AND trim(content) <> ''", TRN)
def s14_saga_contents(s: SparkSession, d: str) -> DataFrame:
    return reads.saga_contents(src.turns(s, d), src.has_episode(s, d))


@query("SELECT * FROM (SELECT saga, uuid, content, row_number() OVER (PARTITION BY saga ORDER BY valid_at, uuid) AS n FROM trn WHERE valid_at > TIMESTAMP '2024-01-01 00:02:00') WHERE n <= 200 AND trim(content) <> ''", TRN)
def s14_saga_contents_since(s: SparkSession, d: str) -> DataFrame:
    return reads.saga_contents(src.turns(s, d), src.has_episode(s, d), datetime(2024, 1, 1, 0, 2))


@query("SELECT DISTINCT group_id FROM ent", ENT)
def s15_group_ids(s: SparkSession, d: str) -> DataFrame:
    return reads.group_ids(src.entities(s, d))


@query(f"SELECT {_k('e', 'vec_id')} AS uuid, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def s16_vectors(s: SparkSession, d: str) -> DataFrame:
    v = reads.vectors(src.vectors(s, d), "name_embedding")
    return v.select("uuid", F.size("name_embedding").cast("long").alias("n"), F.round(F.aggregate(F.transform("name_embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT ep AS episode, uuid FROM fct", FCT)
def s17_facts_by_episode(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    listed = f.select(F.explode("episodes").alias("episode"), "uuid").groupBy("episode").agg(F.sort_array(F.collect_list("uuid")).alias("entity_edges"))
    e = listed.select("episode", F.col("episode").alias("uuid"), F.lit(0).alias("pos"), "entity_edges")
    return e.select("episode", F.posexplode("entity_edges").alias("k", "uuid")).join(f.select("uuid"), "uuid").select("episode", "uuid")


# --- writes


@query("SELECT uuid, name, CASE WHEN l = 'Part' THEN 'new' ELSE summary END AS summary FROM ent UNION ALL SELECT 'x' || uuid, name, 'added' FROM ent WHERE l = 'Supplier'", ENT)
def w1_upsert_nodes(s: SparkSession, d: str) -> DataFrame:
    e = src.entities(s, d)
    p = e.where("labels[1] = 'Part'")
    rows = p.withColumn("summary", F.lit("old")).unionByName(p.withColumn("summary", F.lit("new")).withColumn("_seq", F.col("_seq") + 1)).unionByName(e.where("labels[1] = 'Supplier'").withColumn("uuid", F.concat(F.lit("x"), "uuid")).withColumn("summary", F.lit("added")))
    return writes.save_nodes({"entity": e}, "entity", rows)["entity"].select("uuid", "name", "summary")


@query("SELECT uuid, s AS source_node_uuid FROM fct UNION ALL SELECT 'y' || uuid, t FROM fct WHERE name = 'ORDERED_R'", FCT)
def w2_upsert_edges(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    turned = f.where("name = 'ORDERED_R'").withColumn("uuid", F.concat(F.lit("y"), "uuid")).withColumns({"source_node_uuid": F.col("target_node_uuid"), "target_node_uuid": F.col("source_node_uuid")})
    lost = f.withColumn("uuid", F.concat(F.lit("z"), "uuid")).withColumn("target_node_uuid", F.lit("nowhere"))
    return writes.save_edges({"entity": src.entities(s, d), "entity_edge": f}, "entity_edge", turned.unionByName(lost))["entity_edge"].select("uuid", "source_node_uuid")


@query("SELECT 'entity' AS kind, count(*) AS n FROM ent WHERE group_id <> 'BUILDING' UNION ALL SELECT 'entity_edge', count(*) FROM fct WHERE group_id <> 'BUILDING' UNION ALL SELECT 'mentions', count(*) FROM evt WHERE entity NOT IN (SELECT uuid FROM ent WHERE group_id = 'BUILDING') UNION ALL SELECT 'has_member', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING'", ENT, FCT, EVT)
def w4_delete_group(s: SparkSession, d: str) -> DataFrame:
    g = src.graph(s, d)
    t = writes.delete_group({k: g[k] for k in ("entity", "entity_edge", "mentions", "has_member")}, "entity", "BUILDING")
    return reads.union_all([t[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("entity", "entity_edge", "mentions", "has_member")])


@query("SELECT uuid FROM fct WHERE name <> 'ORDERED_N'", FCT)
def w5_delete_edges(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    return writes.delete_edges({"entity_edge": f}, f.where("name = 'ORDERED_N'"))["entity_edge"].select("uuid")


@query("SELECT 'episodic' AS kind, count(*) AS n FROM evt WHERE group_id <> 'view' UNION ALL SELECT 'mentions', count(*) FROM evt WHERE group_id <> 'view' UNION ALL SELECT 'saga', count(DISTINCT conv_id) FROM conversations", EVT)
def w6_clear_groups(s: SparkSession, d: str) -> DataFrame:
    t = writes.clear({"entity": src.entities(s, d), "episodic": src.events(s, d), "mentions": src.mentions(s, d), "saga": src.sagas(s, d)}, ["view", "talk"])
    return reads.union_all([t[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("episodic", "mentions", "saga")])


@query("SELECT 'entity_edge' AS kind, count(*) AS n FROM fct WHERE ep >= 'o000000100' UNION ALL SELECT 'entity', (SELECT count(*) FROM ent)", ENT, FCT)
def w9_remove_episodes(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    orders = f.groupBy(F.col("episodes")[0].alias("uuid")).agg(F.sort_array(F.collect_list("uuid")).alias("entity_edges"))
    t = {"episodic": orders, "entity_edge": f, "entity": src.entities(s, d), "mentions": src.mentions(s, d)}
    t = writes.remove_episodes(t, orders.where("uuid < 'o000000100'"))
    return reads.union_all([t[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("entity_edge", "entity")])


@query(f"""SELECT {_k("g", "conv_id")} AS uuid, {_k("t", "conv_id")} || '-' || lpad(CAST(min(turn) FILTER (turn <> 1) AS VARCHAR), 4, '0') AS first_episode_uuid, {_k("t", "conv_id")} || '-' || lpad(CAST(max(turn) FILTER (turn <> 1) AS VARCHAR), 4, '0') AS last_episode_uuid FROM conversations GROUP BY conv_id""")
def w10_saga_repair(s: SparkSession, d: str) -> DataFrame:
    before = {"saga": src.sagas(s, d), "has_episode": src.has_episode(s, d), "episodic": src.turns(s, d)}
    gone = before["episodic"].where("uuid like '%-0001'").select("uuid")
    return writes.repair_sagas(before, writes.delete_nodes(before, "episodic", gone), gone)["saga"].select("uuid", "first_episode_uuid", "last_episode_uuid")


@query(f"""SELECT {_k("t", "conv_id")} || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS source_node_uuid, {_k("t", "conv_id")} || '-' || lpad(CAST(nxt AS VARCHAR), 4, '0') AS target_node_uuid FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE turn NOT IN (1, 2)) WHERE nxt IS NOT NULL""")
def w10_saga_chain(s: SparkSession, d: str) -> DataFrame:
    gone = src.turns(s, d).where("uuid like '%-0001' or uuid like '%-0002'").select("uuid")
    return writes.bridged(src.next_episode(s, d), gone).select("source_node_uuid", "target_node_uuid")


# --- filters and joins


@query("SELECT uuid FROM ent WHERE l = 'Supplier'", ENT)
def p2_node_labels(s: SparkSession, d: str) -> DataFrame:
    return filter_nodes(src.entities(s, d), SearchFilters(node_labels=["Entity", "Supplier"])).select("uuid")


@query("SELECT f.uuid FROM fct f JOIN ent a ON f.s = a.uuid JOIN ent b ON f.t = b.uuid", FCT, ENT)
def p3_endpoint_labels(s: SparkSession, d: str) -> DataFrame:
    return filter_edges(src.facts(s, d), SearchFilters(node_labels=["Entity"]), None, src.entities(s, d)).select("uuid")


@query("SELECT uuid, name FROM fct WHERE name IN ('ORDERED_A', 'ORDERED_R') AND group_id = 'MACHINERY'", FCT)
def p4_edge_types(s: SparkSession, d: str) -> DataFrame:
    return filter_edges(src.facts(s, d), SearchFilters(edge_types=["ORDERED_A", "ORDERED_R"]), ["MACHINERY"]).select("uuid", "name")


@query("SELECT uuid FROM fct WHERE (valid_at >= TIMESTAMP '1997-01-01' AND valid_at < TIMESTAMP '1998-01-01') OR valid_at > TIMESTAMP '2000-06-01'", FCT)
def p5_date_predicates(s: SparkSession, d: str) -> DataFrame:
    return filter_edges(src.facts(s, d), SearchFilters(valid_at=[[DateTest(">=", datetime(1997, 1, 1)), DateTest("<", datetime(1998, 1, 1))], [DateTest(">", datetime(2000, 6, 1))]])).select("uuid")


@query("SELECT uuid FROM fct WHERE invalid_at IS DISTINCT FROM TIMESTAMP '1999-01-01' AND (invalid_at IS NULL OR coalesce(invalid_at <= TIMESTAMP '1998-06-01', FALSE))", FCT)
def p6_null_safe_comparisons(s: SparkSession, d: str) -> DataFrame:
    f = SearchFilters(invalid_at=[[DateTest("<>", datetime(1999, 1, 1)), DateTest("IS NULL")], [DateTest("<>", datetime(1999, 1, 1)), DateTest("<=", datetime(1998, 6, 1))]])
    return filter_edges(src.facts(s, d), f).select("uuid")


@query("SELECT f.uuid, a.name AS source_name, b.name AS target_name FROM fct f JOIN ent a ON f.s = a.uuid JOIN ent b ON f.t = b.uuid", FCT, ENT)
def j1_fact_endpoints(s: SparkSession, d: str) -> DataFrame:
    e = src.entities(s, d).select("uuid", "name")
    f = src.facts(s, d).select("uuid", "source_node_uuid", "target_node_uuid")
    return f.join(e.select(F.col("uuid").alias("target_node_uuid"), F.col("name").alias("target_name")), "target_node_uuid").join(e.select(F.col("uuid").alias("source_node_uuid"), F.col("name").alias("source_name")), "source_node_uuid").select("uuid", "source_name", "target_name")


@query("SELECT x.uuid AS a, y.uuid AS b FROM fct x JOIN fct y ON x.s = y.s AND x.t = y.t AND x.uuid < y.uuid", FCT)
def j7_parallel_facts(s: SparkSession, d: str) -> DataFrame:
    return facts.parallel_candidates(src.facts(s, d))


# --- aggregates, order, sets


@query("SELECT entity, count(*) AS n FROM evt GROUP BY entity", EVT)
def a1_mention_counts(s: SparkSession, d: str) -> DataFrame:
    return src.mentions(s, d).groupBy(F.col("target_node_uuid").alias("entity")).agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term")
def a2_document_frequency(s: SparkSession, d: str) -> DataFrame:
    t = src.documents(s, d).select(F.explode(F.array_distinct(tx.tokens("content"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


@query("SELECT a, b, count(*) AS weight FROM (SELECT s AS a, t AS b FROM fct UNION ALL SELECT t, s FROM fct) GROUP BY a, b", FCT)
def a5_neighbour_weights(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d).select(F.col("source_node_uuid").alias("a"), F.col("target_node_uuid").alias("b"))
    both = f.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
    return src.spread(both, s.read.parquet(f"{d}/lineitem.parquet"), "a", "b").groupBy("a", "b").agg(F.count("*").alias("weight"))


@query("SELECT uuid, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT uuid, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY uuid) AS p FROM (SELECT uuid, unnest(string_split(replace(name, ' ', ''), '')) AS c FROM ent) GROUP BY uuid, c) GROUP BY uuid", ENT)
def a9_name_entropy(s: SparkSession, d: str) -> DataFrame:
    return src.entities(s, d).select("uuid", F.round(tx.entropy("name"), 6).alias("entropy"))


@query("SELECT role AS prompt, count(*) AS calls, sum(length(content) // 4)::BIGINT AS input_tokens, sum(length(content))::BIGINT AS output_tokens, round(avg(length(content) // 4), 4) AS avg_input, round(avg(length(content)), 4) AS avg_output FROM trn GROUP BY role", TRN)
def a10_token_usage(s: SparkSession, d: str) -> DataFrame:
    u = ingest.token_usage(src.turns(s, d).select(F.col("source_description").alias("prompt"), tx.token_count("content").alias("input_tokens"), F.length("content").alias("output_tokens")))
    return u.withColumn("avg_input", F.round("avg_input", 4)).withColumn("avg_output", F.round("avg_output", 4))


@query("SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS uuid, n_chars::DOUBLE AS score FROM documents WHERE n_chars > 1000 ORDER BY n_chars DESC, doc_id LIMIT 100")
def k1_top_by_score(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("uuid"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("_seq"))
    return ranking.top_by_score(r, 100, 1000, strict=True).select("uuid", "score")


@query("SELECT uuid, row_number() OVER (PARTITION BY t ORDER BY valid_at, uuid) - 1 AS place FROM fct", FCT)
def k6_invalidation_order(s: SparkSession, d: str) -> DataFrame:
    return facts.candidate_places(src.facts(s, d).withColumn("pos", F.col("uuid")), "target_node_uuid").select("uuid", "place")


def _bm25(rows: str, terms: list[str], k: int | None, name: str = "bm") -> str:
    """SQL of BM25 over rows (uuid, seq, txt)."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""{name} AS (WITH d AS (SELECT uuid, seq, {TOK.format("txt")} AS t FROM ({rows})), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS a FROM d), q AS (SELECT * FROM (VALUES {values}) v(w)),
 tf AS (SELECT d.uuid, d.seq, q.w, len(list_filter(d.t, lambda x: x = q.w))::DOUBLE AS f, len(d.t)::DOUBLE AS n FROM d, q), df AS (SELECT w, sum((f > 0)::INT)::DOUBLE AS c FROM tf GROUP BY w)
 SELECT uuid, seq, CAST(sum(ln(1 + (st.n - c + 0.5) / (c + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * tf.n / a))) AS FLOAT) AS score FROM tf JOIN df USING (w), st WHERE f > 0 GROUP BY uuid, seq ORDER BY score DESC, seq {f"LIMIT {k}" if k else ""})"""


_DOCS = f"SELECT {_k('d', 'doc_id')} AS uuid, doc_id AS seq, coalesce(text, '') || ' text ' || lang || ' ' || source AS txt FROM documents"
_FACTS = "SELECT uuid, _seq AS seq, name || ' ' || fact || ' ' || group_id AS txt FROM fct"
_EVENTS = "SELECT uuid, _seq AS seq, content || ' json events ' || group_id AS txt FROM evt"
_ENTITIES = "SELECT uuid, _seq AS seq, name || ' ' || summary || ' ' || group_id AS txt FROM ent"
_PLACE = "row_number() OVER (ORDER BY score DESC, seq) - 1"
_LISTS = f"l AS (SELECT 0 AS k, uuid, score, {_PLACE} AS pos FROM bm UNION ALL SELECT 1, uuid, score, {_PLACE} FROM bm2)"
_TWO = [_bm25(_DOCS, ["the", "eaueux"], 60), _bm25(_DOCS, ["thering", "src3"], 80, "bm2"), _LISTS]


def _two_lists(s: SparkSession, d: str) -> list[DataFrame]:
    """The lists of two searches over all documents."""
    docs, text = src.documents(s, d), tx.indexed_text("episodic")
    return [ranking.bm25(docs, text, "the eaueux", 60), ranking.bm25(docs, text, "thering src3", 80)]


@query("SELECT uuid, round(max(score)::DOUBLE, 4) AS score, row_number() OVER (ORDER BY min(k * 1000 + pos)) - 1 AS pos FROM l GROUP BY uuid", *_TWO)
def u1_merge_first_seen(s: SparkSession, d: str) -> DataFrame:
    return ranking.merge_first_seen(_two_lists(s, d)).select("uuid", _score(), F.col("pos").cast("long").alias("pos"))


@query("SELECT uuid, round(max(score)::DOUBLE, 4) AS score, row_number() OVER (ORDER BY max(score) DESC, min(k * 1000 + pos)) - 1 AS pos FROM l GROUP BY uuid", *_TWO)
def u2_merge_by_score(s: SparkSession, d: str) -> DataFrame:
    return ranking.merge_first_seen(_two_lists(s, d), by_score=True).select("uuid", _score(), F.col("pos").cast("long").alias("pos"))


@query("SELECT uuid, CASE WHEN name = 'ORDERED_A' THEN 'changed' ELSE fact END AS fact FROM fct UNION ALL SELECT 'q' || uuid, 'added' FROM fct WHERE name = 'ORDERED_R'", FCT)
def u3_merge_overrides(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    new = F.col("name") == "ORDERED_R"
    o = f.where("name in ('ORDERED_A', 'ORDERED_R')").withColumns({"uuid": F.when(new, F.concat(F.lit("q"), "uuid")).otherwise(F.col("uuid")), "fact": F.when(new, "added").otherwise("changed")})
    return facts.merge_overrides(f, o).select("uuid", "fact")


@query("SELECT s || '>' || t AS uuid, arg_max(fact, _seq * 1000000000000 + CAST(right(uuid, 9) AS BIGINT)) AS fact, min(valid_at) AS valid_at, count(DISTINCT ep) AS episodes FROM fct GROUP BY s, t", FCT)
def u7_merge_versions(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    seq = F.col("_seq").cast("decimal(38,0)") * 1000000000000 + F.substring("uuid", -9, 9).cast("decimal(38,0)")
    v = f.withColumn("_seq", F.row_number().over(W.partitionBy("source_node_uuid", "target_node_uuid").orderBy(seq)).cast("long")).withColumn("uuid", F.concat_ws(">", "source_node_uuid", "target_node_uuid"))
    first = v.groupBy("uuid").agg(F.min("valid_at").alias("valid_at"))
    return facts.merge_fields(v).select("uuid", "fact", F.size("episodes").cast("long").alias("episodes")).join(first, "uuid").select("uuid", "fact", "valid_at", "episodes")


# --- ranking


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def r1_tokens(s: SparkSession, d: str) -> DataFrame:
    return src.documents(s, d).select(F.col("_seq").alias("doc_id"), tx.tokens("content").alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("SELECT uuid, round(score::DOUBLE, 4) AS score FROM bm", _bm25(_DOCS, ["the", "que", "src3"], None))
def r2_bm25_documents(s: SparkSession, d: str) -> DataFrame:
    return ranking.bm25_scores(src.documents(s, d), tx.indexed_text("episodic"), "The que src3 THE").select("uuid", _score())


@query("SELECT uuid, round(score::DOUBLE, 4) AS score FROM bm", FCT, _bm25(_FACTS, ["red", "widget", "building"], None))
def r4_bm25_facts(s: SparkSession, d: str) -> DataFrame:
    return ranking.bm25_scores(src.facts(s, d), tx.indexed_text("entity_edge"), "red widget building").select("uuid", _score())


@query("SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS uuid, regexp_replace(coalesce(text, ''), '([+\\-&|!(){}\\[\\]^\"~*?:\\\\/ORNTAD])', '\\\\\\1', 'g') AS escaped FROM documents")
def r6_lucene_escape(s: SparkSession, d: str) -> DataFrame:
    return src.documents(s, d).select("uuid", tx.lucene_escape(F.coalesce("content", F.lit(""))).alias("escaped"))


def _first_vector(s: SparkSession, d: str) -> list[float]:
    return [float(x) for x in src.vectors(s, d).where("uuid = 'e000000000'").first()["name_embedding"]]


_COS = "cs AS (SELECT 'e' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS uuid, vec_id AS seq, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings)"


@query("SELECT uuid, round(c, 4) AS score FROM cs", _COS)
def r7_cosine(s: SparkSession, d: str) -> DataFrame:
    q = _first_vector(s, d)
    return src.vectors(s, d).select("uuid", F.round(vx.cosine("name_embedding", vx.literal(q)), 4).alias("score"))


@query("SELECT uuid, round(c, 4) AS score FROM cs WHERE c > 0.1 ORDER BY CAST(c AS FLOAT) DESC, seq LIMIT 20", _COS)
def r8_knn(s: SparkSession, d: str) -> DataFrame:
    return ranking.knn(src.vectors(s, d), "name_embedding", _first_vector(s, d), 20, 0.1).select("uuid", _score())


# --- traversal and rerankers


_ORIGINS = ["error", "87", "13"]


def _event_origins(s: SparkSession, d: str) -> DataFrame:
    """The 25 best events of a search."""
    return ranking.bm25(src.events(s, d), tx.indexed_text("episodic"), " ".join(_ORIGINS), 25).select("uuid", "pos")


def _one_group(s: SparkSession, d: str) -> dict[str, DataFrame]:
    one = F.lit("all")
    return {"entity": src.entities(s, d).withColumn("group_id", one), "episodic": src.events(s, d).withColumn("group_id", one), "mentions": src.mentions(s, d), "entity_edge": src.facts(s, d)}


@query("SELECT uuid, round(1.0 / min(depth), 4)::DOUBLE AS score FROM (SELECT entity AS uuid, 1 AS depth FROM evt WHERE uuid IN (SELECT uuid FROM bm) UNION ALL SELECT t, 2 FROM fct WHERE s IN (SELECT entity FROM evt WHERE uuid IN (SELECT uuid FROM bm))) GROUP BY uuid", EVT, FCT, _bm25(_EVENTS, _ORIGINS, 25))
def g2_bfs_nodes(s: SparkSession, d: str) -> DataFrame:
    g = _one_group(s, d)
    return traversal.node_hits(_event_origins(s, d), g["entity"], g["episodic"], g["mentions"], g["entity_edge"], 3, None).select("uuid", _score())


@query("SELECT uuid, 0.5::DOUBLE AS score FROM fct WHERE s IN (SELECT entity FROM evt WHERE uuid IN (SELECT uuid FROM bm))", EVT, FCT, _bm25(_EVENTS, _ORIGINS, 25))
def g3_bfs_facts(s: SparkSession, d: str) -> DataFrame:
    g = _one_group(s, d)
    return traversal.fact_hits(_event_origins(s, d), g["entity"], g["episodic"], g["mentions"], g["entity_edge"], 2, None).select("uuid", _score())


@query("SELECT uuid, CASE WHEN uuid = 'p000000001' THEN 10.0 WHEN uuid IN (SELECT s FROM fct WHERE t = 'p000000001') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM ent", FCT, ENT)
def g6_node_distance(s: SparkSession, d: str) -> DataFrame:
    c = src.entities(s, d).select("uuid", F.col("_seq").alias("pos"))
    return ranking.node_distance(c, src.facts(s, d), "p000000001", bounded=False).select("uuid", F.col("score").cast("double").alias("score"))


@query("SELECT e.uuid, coalesce(n, 'inf'::DOUBLE)::VARCHAR AS score, row_number() OVER (ORDER BY coalesce(n, 'inf'::DOUBLE), _seq) - 1 AS pos FROM ent e LEFT JOIN (SELECT entity, count(*)::DOUBLE AS n FROM evt GROUP BY entity) m ON e.uuid = m.entity", ENT, EVT)
def g7_episode_mentions(s: SparkSession, d: str) -> DataFrame:
    c = src.entities(s, d).select("uuid", F.col("_seq").alias("pos"))
    r = ranking.episode_mentions(c, src.mentions(s, d), bounded=False)
    return r.select("uuid", F.when(F.col("score") == float("inf"), "inf").otherwise(F.col("score").cast("double").cast("string")).alias("score"), F.col("pos").cast("long").alias("pos"))


@query("SELECT uuid, round(CAST(sum(1.0::DOUBLE / (pos + 1)) AS FLOAT)::DOUBLE, 4) AS score, row_number() OVER (ORDER BY CAST(sum(1.0::DOUBLE / (pos + 1)) AS FLOAT) DESC, min(k * 1000 + pos)) - 1 AS pos FROM l GROUP BY uuid", *_TWO)
def f1_rrf(s: SparkSession, d: str) -> DataFrame:
    return ranking.rrf(_two_lists(s, d)).select("uuid", _score(), F.col("pos").cast("long").alias("pos"))


@query("""SELECT uuid, round(score::DOUBLE, 3) + 0.0 AS score FROM (SELECT a.uuid, CAST(0.5 * list_dot_product(a.v, q.q) - 0.5 * greatest(0, max(list_dot_product(a.v, b.v))) AS FLOAT) AS score FROM n a JOIN n b ON a.uuid <> b.uuid, (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0) q GROUP BY a.uuid, a.v, q.q) WHERE score >= -2""", _COS, "n AS (SELECT uuid, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS v FROM (SELECT 'e' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS uuid, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings JOIN (SELECT seq FROM cs ORDER BY CAST(c AS FLOAT) DESC, seq LIMIT 60) ON vec_id = seq))")
def f2_mmr(s: SparkSession, d: str) -> DataFrame:
    v = src.vectors(s, d)
    c = ranking.knn(v, "name_embedding", _first_vector(s, d), 60, -2.0)
    return ranking.mmr(c, v, "name_embedding", _first_vector(s, d), 60, 0.5, -2.0).select("uuid", (F.round(F.col("score").cast("double"), 3) + 0.0).alias("score"))


@query(f"SELECT doc_id, round(CAST((len(h) + len(list_distinct(h))) / (len(t) + 3.0)::DOUBLE AS FLOAT)::DOUBLE, 4) AS score FROM (SELECT doc_id, t, list_filter(t, lambda x: x IN ('the', 'and', 'que')) AS h FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)) WHERE len(t) > 0")
def f4_text_overlap(s: SparkSession, d: str) -> DataFrame:
    r = src.documents(s, d).where(F.size(tx.tokens("content")) > 0)
    return r.select(F.col("_seq").alias("doc_id"), F.round(ranking.text_overlap(F.col("content"), "the and que").cast("double"), 4).alias("score"))


# --- search


@query("SELECT uuid, round(CAST(1.0::DOUBLE / row_number() OVER (ORDER BY score DESC, seq) AS FLOAT)::DOUBLE, 4) AS score FROM bm ORDER BY 2 DESC LIMIT 10", FCT, _bm25(_FACTS, ["large", "rod"], 20))
def q1_fact_search(s: SparkSession, d: str) -> DataFrame:
    t = src.graph(s, d)
    return plan.search_facts(t, "large rod", plan.Scope([SearchMethod.BM25])).select("uuid", _score())


_WALKED = f"""r AS (SELECT uuid, {_PLACE} AS pos FROM bm), o AS (SELECT s, min(pos) AS pos FROM r JOIN fct USING (uuid) GROUP BY s), w AS (SELECT fct.uuid, row_number() OVER (ORDER BY o.pos, fct.uuid) - 1 AS pos FROM fct JOIN o USING (s) ORDER BY o.pos, fct.uuid LIMIT 20),
 u AS (SELECT uuid, CAST(sum(1.0::DOUBLE / (pos + 1)) AS FLOAT) AS score, min(k * 1000 + pos) AS seen FROM (SELECT 0 AS k, * FROM r UNION ALL SELECT 1, * FROM w) GROUP BY uuid ORDER BY score DESC, seen LIMIT 20),
 c AS (SELECT fact, arg_max(uuid, pos) AS uuid, min(pos) AS pos FROM (SELECT uuid, row_number() OVER (ORDER BY score DESC, seen) - 1 AS pos FROM u) JOIN fct USING (uuid) GROUP BY fact),
 x AS (SELECT uuid, pos, {TOK.format("fact")} AS t FROM c), y AS (SELECT uuid, pos, t, list_filter(t, lambda z: z IN ('large', 'rod')) AS h FROM x), z AS (SELECT uuid, pos, CAST((len(h) + len(list_distinct(h))) / (len(t) + 2.0)::DOUBLE AS FLOAT) AS score FROM y)"""


@query("SELECT uuid, round(score::DOUBLE, 4) AS score, row_number() OVER (ORDER BY score DESC, pos) - 1 AS pos FROM z ORDER BY score DESC, z.pos LIMIT 10", FCT, _bm25(_FACTS, ["large", "rod"], 20), _WALKED)
def q1_fact_search_bfs_cross_encoder(s: SparkSession, d: str) -> DataFrame:
    t = src.graph(s, d)
    return plan.search_facts(t, "large rod", plan.Scope([SearchMethod.BM25, SearchMethod.BFS], Reranker.CROSS_ENCODER)).select("uuid", _score(), F.col("pos").cast("long").alias("pos"))


_NAMED = "SELECT 'e' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS uuid, vec_id AS seq, 'vector ' || vec_id || '  label' || label AS txt FROM embeddings"
_WORDS = ["vector", "17", "label3"]


def _hybrid(reranker: Reranker, **more: float) -> plan.Scope:
    return plan.Scope([SearchMethod.BM25, SearchMethod.COSINE], reranker, sim_min_score=0.1, **more)


#: Text and vector lists of twice the limit over the embeddings as entities.
_BOTH = [_bm25(_NAMED, _WORDS, 20), "cs AS (SELECT 'e' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS uuid, vec_id AS seq, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings)",
         f"l AS (SELECT 0 AS k, uuid, score, {_PLACE} AS pos FROM bm UNION ALL SELECT 1, uuid, score, {_PLACE} FROM (SELECT uuid, seq, CAST(c AS FLOAT) AS score FROM cs WHERE c > 0.1 ORDER BY CAST(c AS FLOAT) DESC, seq LIMIT 20))"]


@query("SELECT uuid, round(score::DOUBLE, 4) AS score, row_number() OVER (ORDER BY score DESC, seen) - 1 AS pos FROM (SELECT uuid, CAST(sum(1.0::DOUBLE / (pos + 1)) AS FLOAT) AS score, min(k * 1000 + pos) AS seen FROM l GROUP BY uuid) ORDER BY score DESC, seen LIMIT 10", *_BOTH)
def q2_hybrid_nodes_rrf(s: SparkSession, d: str) -> DataFrame:
    r = plan.search_nodes({"entity": src.vectors(s, d)}, " ".join(_WORDS), _hybrid(Reranker.RRF), 10, _first_vector(s, d))
    return r.select("uuid", _score(), F.col("pos").cast("long").alias("pos"))


_SCALED = "n AS (SELECT uuid, seen, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS v FROM (SELECT m.uuid, seen, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM (SELECT uuid, min(k * 1000 + pos) AS seen FROM l GROUP BY uuid) m JOIN embeddings ON m.uuid = 'e' || lpad(CAST(vec_id AS VARCHAR), 9, '0')))"


@query("""SELECT uuid, round(score::DOUBLE, 3) + 0.0 AS score FROM (SELECT a.uuid, a.seen, CAST(0.5 * list_dot_product(a.v, q.q) - 0.5 * greatest(0, max(list_dot_product(a.v, b.v))) AS FLOAT) AS score FROM n a JOIN n b ON a.uuid <> b.uuid, (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0) q GROUP BY a.uuid, a.seen, a.v, q.q) ORDER BY score DESC, seen LIMIT 10""", *_BOTH, _SCALED)
def q2_hybrid_nodes_mmr(s: SparkSession, d: str) -> DataFrame:
    r = plan.search_nodes({"entity": src.vectors(s, d)}, " ".join(_WORDS), _hybrid(Reranker.MMR, mmr_digits=3), 10, _first_vector(s, d), min_score=-9.0)
    return r.select("uuid", (F.round(F.col("score").cast("double"), 3) + 0.0).alias("score"))


@query("SELECT uuid, coalesce(n::DOUBLE, 'inf'::DOUBLE)::VARCHAR AS score, pos FROM (SELECT uuid, n, row_number() OVER (ORDER BY coalesce(n, 1e300), p) - 1 AS pos FROM (SELECT bm.uuid, n, row_number() OVER (ORDER BY score DESC, seq) AS p FROM bm LEFT JOIN (SELECT entity, count(*) AS n FROM evt GROUP BY entity) m ON bm.uuid = m.entity)) WHERE pos < 10", ENT, EVT, _bm25(_ENTITIES, ["nation", "3", "household"], 20))
def q2_node_search_mentions(s: SparkSession, d: str) -> DataFrame:
    t = src.graph(s, d)
    r = plan.search_nodes(t, "nation 3 household", plan.Scope([SearchMethod.BM25], Reranker.EPISODE_MENTIONS))
    return r.select("uuid", F.when(F.col("score") == float("inf"), "inf").otherwise(F.col("score").cast("double").cast("string")).alias("score"), F.col("pos").cast("long").alias("pos"))


@query("SELECT uuid, round(CAST(1.0::DOUBLE / row_number() OVER (ORDER BY score DESC, seq) AS FLOAT)::DOUBLE, 4) AS score FROM bm ORDER BY 2 DESC LIMIT 10", _bm25(_DOCS, ["eaueux", "thering", "the"], 20))
def q3_episode_search(s: SparkSession, d: str) -> DataFrame:
    t = {"episodic": src.documents(s, d)}
    return plan.search_episodes(t, "eaueux thering the", plan.Scope()).select("uuid", _score())


@query("SELECT uuid, round(CAST(1.0::DOUBLE / row_number() OVER (ORDER BY score DESC, seq) AS FLOAT)::DOUBLE, 4) AS score FROM bm ORDER BY 2 DESC LIMIT 10", _bm25(f"SELECT {_k('n', 'n_nationkey')} AS uuid, n_nationkey AS seq, n_name || ' ' || r_name AS txt FROM nation JOIN region ON n_regionkey = r_regionkey", ["asia", "nation_1"], 20))
def q4_community_search(s: SparkSession, d: str) -> DataFrame:
    return plan.search_communities({"community": src.communities(s, d)}, "ASIA nation_1", plan.Scope()).select("uuid", _score())


@query()
def q5_combined_search(s: SparkSession, d: str) -> DataFrame:
    return plan.search(src.graph(s, d), "customer red widget view", plan.recipe("combined_hybrid_search_rrf")).select("scope", "uuid", _score(), "pos")


# --- entity resolution


@query("SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS key FROM documents")
def d1_normalize_key(s: SparkSession, d: str) -> DataFrame:
    return src.documents(s, d).select(F.col("_seq").alias("doc_id"), tx.normalize_key(F.coalesce("content", F.lit(""))).alias("key"))


@query("SELECT uuid, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS form FROM ent", ENT)
def d2_fuzzy_form(s: SparkSession, d: str) -> DataFrame:
    return src.entities(s, d).select("uuid", tx.fuzzy_form("name").alias("form"))


_SHINGLES = "list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3)))"


@query(f"SELECT uuid, len({_SHINGLES}) AS n FROM (SELECT uuid, replace(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' ', '') AS n FROM ent)", ENT)
def d4_shingles(s: SparkSession, d: str) -> DataFrame:
    return src.entities(s, d).select("uuid", F.size(tx.shingles(tx.fuzzy_form("name"))).cast("long").alias("n"))


def _names(s: SparkSession, d: str) -> DataFrame:
    p = src.entities(s, d).where("labels[1] = 'Part'").withColumn("group_id", F.lit("parts"))
    return p.withColumn("name", F.concat_ws(" ", "name", "summary"))


_NAMES = "nm AS (SELECT uuid, name || ' ' || summary AS name, _seq FROM ent WHERE l = 'Part')"


_ALL_SHAPES = "sh AS (SELECT name, unnest(t) AS x, len(t) AS n FROM (SELECT name, list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) AS t FROM (SELECT name, replace(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' ', '') AS n FROM (SELECT DISTINCT name || ' ' || summary AS name FROM ent))))"


@query("SELECT a, b, round(c::DOUBLE / (m + n - c), 6) AS j FROM (SELECT p.name AS a, q.name AS b, count(*) AS c, any_value(p.n) AS m, any_value(q.n) AS n FROM sh p JOIN sh q ON p.x = q.x AND p.name < q.name GROUP BY p.name, q.name) WHERE c::DOUBLE / (m + n - c) >= 0.8", ENT, _ALL_SHAPES)
def d6_jaccard(s: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct names with a Jaccard of 0.8 or more."""
    e = src.entities(s, d).select(F.concat_ws(" ", "name", "summary").alias("id"), F.lit("").alias("g")).distinct().repartition(src.tasks(s), "id")
    return resolve.similar_sets(e.withColumn("t", tx.shingles(tx.fuzzy_form("id"))), 0.8).withColumn("j", F.round("j", 6))


@query("SELECT 'x' || uuid AS uuid, CASE WHEN n = 1 THEN m END AS match, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS how FROM nm JOIN (SELECT name, count(*) AS n, min(uuid) AS m FROM nm GROUP BY name) c USING (name)", ENT, _NAMES)
def d7_resolve_exact(s: SparkSession, d: str) -> DataFrame:
    n = _names(s, d)
    return resolve.resolve(n.withColumn("uuid", F.concat(F.lit("x"), "uuid")).withColumn("name", F.upper(F.concat(F.lit("  "), "name"))), n)


_FORM = "replace(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')), ' ', '')"
_SETS = "SELECT uuid, _seq, unnest(t) AS x, len(t) AS n FROM (SELECT uuid, _seq, list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) AS t FROM (SELECT uuid, _seq, {} AS n FROM one))"


@query("""SELECT 'x' || o.uuid AS uuid, m AS match, CASE WHEN m IS NULL THEN 'new' ELSE 'fuzzy' END AS how FROM one o LEFT JOIN (SELECT a, arg_max(b, (j, -seq)) AS m FROM (SELECT p.uuid AS a, q.uuid AS b, any_value(q._seq) AS seq, count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)) AS j FROM left_sets p JOIN right_sets q ON p.x = q.x GROUP BY p.uuid, q.uuid) WHERE j >= 0.9 GROUP BY a) ON o.uuid = a""",
       ENT, _NAMES, "one AS (SELECT name, min(uuid) AS uuid, min(_seq) AS _seq FROM nm GROUP BY name)", f"left_sets AS ({_SETS.format(_FORM.format("name || '!s'"))})", f"right_sets AS ({_SETS.format(_FORM.format('name'))})")
def d7_resolve_fuzzy(s: SparkSession, d: str) -> DataFrame:
    n = resolve.collapse(_names(s, d))
    return resolve.resolve(n.withColumn("uuid", F.concat(F.lit("x"), "uuid")).withColumn("name", F.concat("name", F.lit("!s"))), n)


@query("SELECT a.uuid AS uuid, b.uuid AS candidate, round(CAST(list_cosine_similarity(a.v, b.v) AS FLOAT)::DOUBLE, 4) AS score FROM v a JOIN v b ON a.g = b.g AND list_cosine_similarity(a.v, b.v) > 0.6 QUALIFY row_number() OVER (PARTITION BY a.uuid ORDER BY CAST(list_cosine_similarity(a.v, b.v) AS FLOAT) DESC, b.uuid) <= 15", "v AS (SELECT 'e' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS uuid, label AS g, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")
def d8_candidates(s: SparkSession, d: str) -> DataFrame:
    v = src.vectors(s, d)
    return resolve.candidates(v, v).select("uuid", "candidate", _score())


@query()
def d11_bulk(s: SparkSession, d: str) -> DataFrame:
    return resolve.canonicalize_bulk(src.entities(s, d))


@query("SELECT uuid, least(uuid, b) AS canonical FROM (SELECT uuid, CASE WHEN _seq % 2 = 0 THEN 'c' || lpad(CAST(_seq + 1 AS VARCHAR), 9, '0') ELSE 'c' || lpad(CAST(_seq - 1 AS VARCHAR), 9, '0') END AS b FROM ent WHERE l = 'Customer')", ENT)
def d13_components(s: SparkSession, d: str) -> DataFrame:
    c = src.entities(s, d).where("labels[1] = 'Customer' and _seq % 2 = 0").select(F.col("uuid").alias("a"), F.concat(F.lit("c"), F.lpad((F.col("_seq") + 1).cast("string"), 9, "0")).alias("b"))
    return resolve.least_union(c, src.written)


@query("SELECT uuid, 'n' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS source_node_uuid, t AS target_node_uuid FROM fct JOIN customer ON s = 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')", FCT)
def d14_rewrite_endpoints(s: SparkSession, d: str) -> DataFrame:
    m = src.has_member(s, d).select(F.col("target_node_uuid").alias("uuid"), F.col("source_node_uuid").alias("canonical"))
    return resolve.rewrite_endpoints(src.facts(s, d), m).select("uuid", "source_node_uuid", "target_node_uuid")


# --- facts


@query("SELECT source_name, target_name, fact, min(_seq) AS _seq FROM (SELECT s.name AS source_name, t.name AS target_name, f.fact, f._seq, f.s AS s, t.m AS t FROM fct f JOIN ent s ON f.s = s.uuid JOIN (SELECT uuid, name, first_value(uuid) OVER (PARTITION BY name ORDER BY _seq) AS m FROM ent) t ON f.t = t.uuid) GROUP BY ALL", FCT, ENT)
def e1_build_candidates(s: SparkSession, d: str) -> DataFrame:
    e = src.entities(s, d).withColumn("group_id", F.lit("all"))
    n = e.select("uuid", "name")
    f = src.facts(s, d).select("fact", "_seq", "source_node_uuid", "target_node_uuid")
    raw = f.join(n.select(F.col("uuid").alias("target_node_uuid"), F.col("name").alias("target_name")), "target_node_uuid").join(n.select(F.col("uuid").alias("source_node_uuid"), F.col("name").alias("source_name")), "source_node_uuid")
    raw = raw.select(F.lit("all").alias("group_id"), "source_name", "target_name", "fact", "_seq")
    return facts.build_candidates(raw, e).select("source_name", "target_name", "fact", "_seq")


@query("SELECT s AS source_node_uuid, t AS target_node_uuid, fact, count(DISTINCT ep) AS n FROM fct GROUP BY s, t, fact", FCT)
def e2_dedupe_batch(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    f = f.withColumn("_seq", F.row_number().over(W.partitionBy("source_node_uuid", "target_node_uuid").orderBy("uuid")).cast("long"))
    return facts.dedupe_batch(f).select("source_node_uuid", "target_node_uuid", "fact", F.size("episodes").cast("long").alias("n"))


@query("SELECT 'x' || f.uuid AS uuid, m.m AS duplicate_of FROM fct f JOIN (SELECT s, t, fact, arg_min(uuid, _seq * 1000000000000 + CAST(right(uuid, 9) AS BIGINT)) AS m FROM fct GROUP BY s, t, fact) m USING (s, t, fact)", FCT)
def e5_exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    seq = F.col("_seq").cast("decimal(38,0)") * 1000000000000 + F.substring("uuid", -9, 9).cast("decimal(38,0)")
    return facts.exact_duplicates(f.withColumn("uuid", F.concat(F.lit("x"), "uuid")).withColumn("fact", F.upper("fact")), f.withColumn("_seq", seq))


_NOW = datetime(2025, 1, 1)


@query("""SELECT f.uuid, coalesce(max(n.valid_at) FILTER (NOT coalesce(f.invalid_at <= n.valid_at, FALSE) AND NOT coalesce(n.invalid_at <= f.valid_at, FALSE) AND f.valid_at < n.valid_at), f.invalid_at) AS invalid_at,
 CASE WHEN count(*) FILTER (NOT coalesce(f.invalid_at <= n.valid_at, FALSE) AND NOT coalesce(n.invalid_at <= f.valid_at, FALSE) AND f.valid_at < n.valid_at) > 0 THEN TIMESTAMP '2025-01-01' END AS expired_at FROM fct f JOIN fct n ON f.s = n.s AND f.t = n.t GROUP BY f.uuid, f.invalid_at""", FCT)
def t1_invalidate(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    return facts.invalidate_among(f, ["source_node_uuid", "target_node_uuid"], _NOW).select("uuid", "invalid_at", "expired_at")


@query("SELECT f.uuid, coalesce(min(n.valid_at) FILTER (n.valid_at > f.valid_at), f.invalid_at) AS invalid_at, CASE WHEN count(*) FILTER (n.valid_at > f.valid_at) > 0 THEN TIMESTAMP '2025-01-01' END AS expired_at FROM fct f JOIN fct n ON f.s = n.s AND f.t = n.t GROUP BY f.uuid, f.invalid_at", FCT)
def t2_expire_new(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d)
    return facts.expire_among(f, ["source_node_uuid", "target_node_uuid"], _NOW).select("uuid", "invalid_at", "expired_at")


@query("SELECT uuid, CASE WHEN invalid_at IS NOT NULL THEN TIMESTAMP '2025-01-01' END AS expired_at FROM fct", FCT)
def t3_expire_invalid(s: SparkSession, d: str) -> DataFrame:
    return facts.expire_invalid(src.facts(s, d), _NOW).select("uuid", "expired_at")


# --- communities, summaries, sagas, chunks


@query()
def c1_label_propagation(s: SparkSession, d: str) -> DataFrame:
    return communities.label_propagation(_one_group(s, d)["entity"], src.facts(s, d))


@query("SELECT 'n' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS label, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
def c2_build_communities(s: SparkSession, d: str) -> DataFrame:
    m = src.has_member(s, d).select(F.col("target_node_uuid").alias("uuid"), F.lit("g").alias("group_id"), F.col("source_node_uuid").alias("label"), F.count("*").over(W.partitionBy("source_node_uuid")).alias("n_members"))
    _, members = communities.build(src.entities(s, d), m)
    names = m.select(F.sha2(F.concat_ws("|", F.lit("community"), "group_id", F.col("label").cast("string")), 256).alias("source_node_uuid"), "label").distinct()
    return members.join(names, "source_node_uuid").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT uuid, arg_min(n, (-k, first, n)) AS community FROM (SELECT f.s AS uuid, 'n' || lpad(CAST(s_nationkey AS VARCHAR), 9, '0') AS n, count(*) AS k, min(f.uuid) AS first FROM fct f JOIN supplier ON CAST(right(f.uuid, 9) AS BIGINT) = s_suppkey GROUP BY 1, 2) GROUP BY uuid", FCT)
def c4_join_community(s: SparkSession, d: str) -> DataFrame:
    f = src.facts(s, d).withColumn("target_node_uuid", F.concat(F.lit("s"), F.substring("uuid", -9, 9)))
    sup = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("target_node_uuid"), F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 9, "0")).alias("source_node_uuid"))
    return communities.join_community(f.select(F.col("source_node_uuid").alias("uuid")).distinct(), f, sup)


@query("SELECT uuid, CASE WHEN length(f) <= 2000 THEN f ELSE summary END AS summary, coalesce(length(f) > 2000, FALSE) AS by_model FROM (SELECT e.uuid, e.summary, e.summary || coalesce(chr(10) || t, '') AS f FROM ent e LEFT JOIN (SELECT uuid, string_agg(fact, chr(10) ORDER BY _seq, fact) AS t FROM (SELECT s AS uuid, fact, _seq FROM fct UNION ALL SELECT t, fact, _seq FROM fct) GROUP BY uuid) x ON e.uuid = x.uuid)", ENT, FCT)
def m1_summaries(s: SparkSession, d: str) -> DataFrame:
    return ingest.summaries(src.entities(s, d), src.facts(s, d))


@query("SELECT uuid AS source_node_uuid, nxt AS target_node_uuid FROM (SELECT uuid, lead(uuid) OVER (PARTITION BY saga ORDER BY valid_at, uuid) AS nxt FROM trn) WHERE nxt IS NOT NULL", TRN)
def m7_saga_chain(s: SparkSession, d: str) -> DataFrame:
    return ingest.chain(src.turns(s, d), src.has_episode(s, d)).select("source_node_uuid", "target_node_uuid")


@query("SELECT saga, substr(string_agg(content, chr(10) ORDER BY valid_at, uuid), 1, 1000) AS summary, max(valid_at) AS watermark FROM trn GROUP BY saga", TRN)
def m7_saga_summary(s: SparkSession, d: str) -> DataFrame:
    return ingest.saga_summary(src.sagas(s, d), src.turns(s, d), src.has_episode(s, d))


@query()
def x1_should_chunk(s: SparkSession, d: str) -> DataFrame:
    return chunking.density_table(src.documents(s, d))


@query()
def x3_chunk_documents(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_table(src.documents(s, d), 400, 40)


@query()
def x5_cover_pairs(s: SparkSession, d: str) -> DataFrame:
    return chunking.cover_table(src.entities(s, d).withColumn("n", F.col("summary")), "n", "uuid", 3)


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS cleaned FROM documents")
def l2_clean_prompt(s: SparkSession, d: str) -> DataFrame:
    return src.documents(s, d).select(F.col("_seq").alias("doc_id"), tx.clean_prompt(F.coalesce("content", F.lit(""))).alias("cleaned"))


@query()
def l6_hash_embeddings(s: SparkSession, d: str) -> DataFrame:
    e = vx.fill_vectors(src.entities(s, d), "name", "name_embedding", 64)
    return e.select("uuid", F.size("name_embedding").alias("dim"), F.round(vx.norm("name_embedding"), 4).alias("norm"))


@query("SELECT 'a' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS uuid, 'n' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') AS source_node_uuid FROM customer JOIN nation ON c_nationkey = n_nationkey")
def d16_has_member_edges(s: SparkSession, d: str) -> DataFrame:
    m = src.has_member(s, d).select(F.col("source_node_uuid").alias("community"), F.col("target_node_uuid").alias("uuid"))
    return facts.has_member_edges(src.communities(s, d), m).select(F.concat(F.lit("a"), F.substring("target_node_uuid", 2, 9)).alias("uuid"), "source_node_uuid")


@query("SELECT uuid AS source_node_uuid, entity AS target_node_uuid FROM evt", EVT)
def d15_mentions_edges(s: SparkSession, d: str) -> DataFrame:
    e = src.events(s, d).select(F.col("_seq").alias("pos"), "uuid")
    i = src.mentions(s, d).groupBy(F.col("target_node_uuid").alias("uuid")).agg(F.collect_list("_seq").alias("index"))
    return facts.mentions_edges(i.select("uuid"), i, e)


@query("SELECT uuid, group_id FROM ent UNION ALL SELECT uuid, group_id FROM fct UNION ALL SELECT m, group_id FROM evt", ENT, FCT, EVT)
def w3_save_bulk(s: SparkSession, d: str) -> DataFrame:
    g = src.graph(s, d)
    t = writes.save_bulk(src.empty(s), {k: g[k] for k in ("episodic", "entity", "mentions", "entity_edge")})
    return reads.union_all([t[k].select("uuid", "group_id") for k in ("entity", "entity_edge", "mentions")])


@query("SELECT a.uuid, count(*) AS n FROM fct a JOIN fct b ON a.s = b.s AND a.t = b.t AND a.uuid <> b.uuid GROUP BY a.uuid", FCT)
def e3_duplicate_candidates(s: SparkSession, d: str) -> DataFrame:
    f = src.written(facts.between_same(src.facts(s, d)))
    return facts.duplicate_candidates(f, f, 100).groupBy("uuid").agg(F.count("*").alias("n"))


_POSTINGS = f"""d AS (SELECT uuid, group_id, _seq, s, t AS target, {TOK.format("name || ' ' || fact || ' ' || group_id")} AS t, {TOK.format("fact")} AS q FROM fct), st AS (SELECT group_id, count(*)::DOUBLE AS n, avg(len(t)) AS a FROM d GROUP BY group_id),
 p AS (SELECT uuid, group_id, _seq, w, any_value(n) AS n, count(*)::DOUBLE AS tf FROM (SELECT uuid, group_id, _seq, len(t) AS n, unnest(t) AS w FROM d) GROUP BY uuid, group_id, _seq, w), df AS (SELECT group_id, w, count(*)::DOUBLE AS c FROM p GROUP BY group_id, w),
 q AS (SELECT DISTINCT uuid, group_id, unnest(q) AS w FROM d WHERE (_seq // 10) % 100 = 0),
 hits AS (SELECT q.uuid, p.uuid AS candidate, p._seq, CAST(sum(ln(1 + (st.n - c + 0.5) / (c + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.n / a))) AS FLOAT) AS score FROM q JOIN df USING (group_id, w) JOIN st USING (group_id) JOIN p USING (group_id, w) WHERE q.uuid <> p.uuid GROUP BY q.uuid, p.uuid, p._seq)"""


@query("""SELECT uuid, candidate, pos FROM (SELECT uuid, candidate, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, _seq, candidate) - 1 AS pos FROM hits) h WHERE pos < 10 AND NOT EXISTS (SELECT 1 FROM d a JOIN d b ON a.s = b.s AND a.target = b.target WHERE a.uuid = h.uuid AND b.uuid = h.candidate)""", FCT, _POSTINGS)
def e4_invalidation_candidates(s: SparkSession, d: str) -> DataFrame:
    """As queries, the facts of orders whose key is divisible by 100; against all facts of their groups."""
    f = src.facts(s, d)
    new = f.where("floor(_seq / 10) % 100 = 0")
    return facts.invalidation_candidates(new, f, facts.duplicate_candidates(new, f)).select("uuid", "candidate", F.col("pos").cast("long").alias("pos"))


@query("SELECT sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS key, doc_id FROM documents")
def w11_cache_keys(s: SparkSession, d: str) -> DataFrame:
    r = s.read.parquet(f"{d}/documents.parquet")
    return r.select(tx.canonical_hash(F.col("doc_id"), F.col("lang")).alias("key"), "doc_id")
