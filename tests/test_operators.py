"""Hand-computed expectations of the graph operators."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tempograph.functions import text as tx
from tempograph.functions import vector as vx
from tempograph.operators import chunking as ch
from tempograph.operators import communities as cm
from tempograph.operators import facts as fx
from tempograph.operators import ingest as ig
from tempograph.operators import ranking as rk
from tempograph.operators import reads, resolve, traversal, writes
from tempograph.operators.filters import DateTest, SearchFilters, filter_edges
from tempograph.plans import search as plan
from tempograph.plans import schema as sc
from tempograph.sources import tables as src
from tempograph.store import GraphStore

T0 = datetime(2026, 1, 1, 12)


def ranked(spark, uuids):
    return spark.createDataFrame([(u, 1.0, i) for i, u in enumerate(uuids)], "uuid string, score float, pos int")


def pairs(df, digits=4):
    return [(r.uuid, round(r.score, digits)) for r in df.orderBy("pos").collect()]


def entity(spark, rows):
    return spark.createDataFrame([(u, n, g, labels, T0, v, "", "{}", i) for i, (u, n, g, labels, v) in enumerate(rows)], sc.SCHEMAS["entity"])


def fact(spark, rows):
    return spark.createDataFrame([(u, g, s, t, T0, "R", f, None, ["e"], None, va, ia, None, "{}", i) for i, (u, g, s, t, f, va, ia) in enumerate(rows)], sc.SCHEMAS["entity_edge"])


def test_fusion(spark):
    assert pairs(rk.rrf([ranked(spark, "ab"), ranked(spark, "bc")])) == [("b", 1.5), ("a", 1.0), ("c", 0.5)]
    assert [u for u, _ in pairs(rk.merge_first_seen([ranked(spark, "ab"), ranked(spark, "cb")]))] == ["a", "b", "c"]


def test_mmr(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "uuid string, v array<float>")
    got = dict(pairs(rk.mmr(ranked(spark, "abc"), v, "v", [1.0, 0.0], 3, 0.5, -2.0)))
    assert got == {"a": 0.2, "b": -0.1, "c": -0.4}


def test_overlap_and_bm25(spark):
    d = spark.createDataFrame([("1", "alpha alpha gamma", 0), ("2", "café ωmega ωmega other", 1), ("3", "", 2)], "uuid string, t string, _seq int")
    got = [r[0] for r in d.select(rk.text_overlap(F.col("t"), "alpha beta"), "_seq").orderBy("_seq").collect()]
    assert [round(x, 4) for x in got] == [0.6, 0.0, 0.0]
    assert round(d.where("uuid = '2'").select(rk.text_overlap(F.col("t"), "CAFÉ café ΩMEGA")).first()[0], 4) == round(5 / 6, 4)
    b = spark.createDataFrame([("x", "alpha beta", 0), ("y", "alpha alpha alpha alpha alpha", 1), ("z", "gamma delta", 2)], "uuid string, t string, _seq int")
    assert [u for u, _ in pairs(rk.bm25(b, F.col("t"), "alpha beta", 5))] == ["x", "y"]
    assert rk.bm25(b, F.col("t"), " !", 5).count() == 0


def test_places_of_a_long_list(spark):
    rows = [(f"u{i:05d}", float(i * 7919 % 1000), i) for i in range(3000)]
    d = spark.createDataFrame(rows, "uuid string, score float, pos int").repartition(7)
    got = {r.uuid: r.pos for r in rk.placed(d, F.desc("score"), F.asc("pos")).collect()}
    assert got == {u: k for k, (u, _, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert rk.placed(d.limit(0), F.desc("score")).count() == 0


def test_a_model_as_cross_encoder(spark):
    d = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", "one two"), ("d", "bad"), ("e", None)], "uuid string, fact string")
    score = {"one two": 0.25, "three": 7.0, "bad": float("nan"), "": None}
    got = pairs(rk.cross_encode(ranked(spark, "abcde"), d, "fact", "q", 9, 0.0, lambda q, ps: [score[p] for p in ps]))
    assert got == [("b", 1.0), ("c", 0.25), ("d", 0.0), ("e", 0.0)]
    with pytest.raises(Exception, match="scores for"):
        rk.cross_encode(ranked(spark, "abc"), d, "fact", "q", 9, 0.0, lambda q, ps: []).collect()


def test_search_for_each_row(spark):
    rows = [("1", "g", "red rod large", 0), ("2", "g", "red box", 1), ("3", "g", "blue box", 2), ("4", "h", "red rod", 3)]
    d = spark.createDataFrame(rows, "candidate string, group_id string, t string, _seq long")
    q = spark.createDataFrame([("x", "g", "red rod"), ("2", "g", "red box red"), ("y", "h", "nothing here"), ("z", "i", "red")], "uuid string, group_id string, q string")
    got = {(r.uuid, r.candidate): r.pos for r in fx.search_each(q, d, 2).collect()}
    assert got == {("x", "1"): 0, ("x", "2"): 1, ("2", "3"): 0, ("2", "1"): 1}
    one = rk.bm25(d.where("group_id = 'g'").withColumnRenamed("candidate", "uuid"), F.col("t"), "red rod", 5)
    assert [u for u, _ in pairs(one)] == ["1", "2"]


def test_similar_sets_are_those_of_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(f"i{k}", r.choice("gh"), [f"s{r.randrange(9)}" for _ in range(r.randrange(8))]) for k in range(150)]
    for threshold in (0.5, 0.8, 1.0):
        got = {(x.a, x.b) for x in resolve.similar_sets(spark.createDataFrame(rows, "id string, g string, t array<string>"), threshold).collect()}
        want = {(min(a, b), max(a, b)) for i, (a, g, s) in enumerate(rows) for b, h, t in rows[i + 1 :] if g == h and s and t and len({*s} & {*t}) >= threshold * len({*s} | {*t}) - 1e-12}
        assert got == want and want


def test_knn(spark):
    v = entity(spark, [("a", "a", "g", ["Entity"], [1.0, 0.0]), ("b", "b", "g", ["Entity"], [0.6, 0.8]), ("c", "c", "g", ["Entity"], [0.0, 0.0]), ("d", "d", "g", ["Entity"], None)])
    assert pairs(rk.knn(v, "name_embedding", [1.0, 0.0], 5, 0.6)) == [("a", 1.0), ("b", 0.6)] or pairs(rk.knn(v, "name_embedding", [1.0, 0.0], 5, 0.6)) == [("a", 1.0)]
    with pytest.raises(Exception, match="unequal"):
        v.select(vx.cosine("name_embedding", vx.literal([1.0]))).collect()


def test_walk(spark):
    e = entity(spark, [(u, u, "g", ["Entity"], None) for u in "abc"])
    p = spark.createDataFrame([("p", "p", "g", ["Episodic"], T0, "text", "", "x", T0, [], None, 0)], sc.SCHEMAS["episodic"])
    m = spark.createDataFrame([("m1", "g", "p", "a", T0, 0)], sc.SCHEMAS["mentions"])
    f = fact(spark, [("e1", "g", "a", "b", "x", None, None), ("e2", "g", "b", "c", "x", None, None), ("e3", "g", "c", "a", "x", None, None)])
    o = lambda *u: spark.createDataFrame([(x, i) for i, x in enumerate(u)], "uuid string, pos int")
    hits = lambda origins, d: [u for u, _ in pairs(traversal.fact_hits(origins, e, p, m, f, d))]
    assert hits(o("p"), 1) == [] and hits(o("p"), 2) == ["e1"] and hits(o("a"), 2) == ["e1", "e2"] and hits(o("nobody"), 3) == []
    assert pairs(traversal.node_hits(o("p"), e, p, m, f, 3)) == [("a", 1.0), ("b", 0.5), ("c", round(1 / 3, 4))]
    assert [u for u, _ in pairs(traversal.node_hits(o("a"), e, p, m, f, 3))] == ["b", "c", "a"]


def test_rerankers(spark):
    f = fact(spark, [("e1", "g", "a", "b", "x", None, None), ("e2", "g", "c", "a", "x", None, None)])
    assert pairs(rk.node_distance(ranked(spark, "dcba"), f, "a")) == [("a", 10.0), ("c", 1.0), ("b", 1.0), ("d", 0.0)]
    m = spark.createDataFrame([(f"m{i}", "g", f"p{i}", t, T0, i) for i, t in enumerate("bbc")], sc.SCHEMAS["mentions"])
    assert pairs(rk.episode_mentions(ranked(spark, "abc"), m)) == [("c", 1.0), ("b", 2.0), ("a", float("inf"))]
    g = f.withColumn("episodes", F.when(F.col("uuid") == "e2", F.array(F.lit("x"), F.lit("y"))).otherwise(F.col("episodes")))
    r = spark.createDataFrame([("e1", 0.9, 0), ("e2", 0.5, 1)], "uuid string, score float, pos int")
    assert pairs(rk.facts_by_episodes(r, g)) == [("e2", 0.9), ("e1", 0.5)]


def test_filters(spark):
    f = fact(spark, [("1", "g", "a", "b", "x", T0, None), ("2", "g", "a", "b", "x", None, None)])
    ids = lambda **k: {r.uuid for r in filter_edges(f, SearchFilters(**k)).collect()}
    assert ids(edge_types=[]) == set() and ids(edge_types=None) == {"1", "2"} and ids(edge_uuids=["2"]) == {"2"}
    assert ids(valid_at=[[DateTest("<>", T0)]]) == {"2"} and ids(valid_at=[[DateTest("IS NULL")], [DateTest(">=", T0)]]) == {"1", "2"} and ids(valid_at=[[]]) == {"1", "2"} and ids(valid_at=[[DateTest("<", T0)]]) == set()
    with pytest.raises(sc.LabelError):
        filter_edges(f, SearchFilters(node_labels=["no label!"]), None, f)
    with pytest.raises(sc.GroupIdError):
        sc.check_groups(["a b"])


def test_label_propagation():
    def clusters(nodes, edges):
        got = {}
        for u, k in cm.propagate(nodes, edges).items():
            got.setdefault(k, set()).add(u)
        return sorted(map(sorted, got.values()))

    assert clusters(list("abcde"), [("a", "c"), ("b", "c"), ("c", "d")]) == [["a", "b", "c", "d"], ["e"]]
    assert cm.propagate([], []) == {} and cm.summarize_tree(list("abcde"), lambda a, b: a + b) == "acbde"


def test_resolution(spark):
    e = entity(spark, [("1", "OpenAI", "g", ["Entity"], None), ("2", "Same", "g", ["Entity"], None), ("3", "same ", "g", ["Entity"], None)])
    x = entity(spark, [("x", "Open AI", "g", ["Entity", "Organization"], None), ("y", "SAME", "g", ["Entity"], None), ("z", "openai", "h", ["Entity"], None), ("w", "Bo", "g", ["Entity"], None)])
    got = {r.uuid: (r.match, r.how) for r in resolve.resolve(x, e).collect()}
    assert got == {"x": ("1", "fuzzy"), "y": (None, "ambiguous"), "z": (None, "new"), "w": (None, "new")}
    assert resolve.directed_union([("a", "b"), ("b", "c"), ("d", "a")]) == {k: "c" for k in "abcd"}
    c = {r.uuid: r.canonical for r in resolve.canonicalize_bulk(entity(spark, [("1", "OpenAI", "g", [], None), ("2", "Open AI", "g", [], None), ("3", "openai", "g", [], None), ("4", "Other", "g", [], None)])).collect()}
    assert c == {"1": "1", "2": "1", "3": "1", "4": "4"}
    one = spark.createDataFrame([("a",), ("ab",), ("abc",), ("ab cd",)], "s string").select(F.size(tx.shingles("s"))).collect()
    assert [r[0] for r in one] == [1, 0, 1, 2]


def test_merge_entity(spark):
    e = spark.createDataFrame([("1", ["Entity"], "old", {"a": "1", "b": "2"}), ("2", ["Entity", "X"], "s", {})], "uuid string, labels array<string>, summary string, attributes map<string,string>")
    u = spark.createDataFrame([("1", ["Entity", "Org"], " ", {"b": "3"}), ("2", ["Entity", "Y"], "new", None)], "uuid string, labels array<string>, summary string, attributes map<string,string>")
    got = {r.uuid: r for r in resolve.merge_entity(e, u).collect()}
    assert got["1"].labels == ["Entity", "Org"] and got["1"].summary == "old" and got["1"].attributes == {"a": "1", "b": "3"}
    assert got["2"].labels == ["Entity", "X"] and got["2"].summary == "new"


def test_time(spark):
    d = datetime
    old = fact(spark, [("a", "g", "x", "y", "f", d(2026, 1, 1), None), ("b", "g", "x", "y", "f", d(2026, 2, 1), None), ("c", "g", "x", "y", "f", d(2026, 4, 1), None), ("d", "g", "x", "y", "f", d(2026, 1, 1), d(2026, 1, 5))])
    p = spark.createDataFrame([(u, d(2026, 3, 1), None) for u in "abcd"], "candidate string, new_valid_at timestamp_ntz, new_invalid_at timestamp_ntz")
    got = {r.uuid: (r.invalid_at, r.expired_at) for r in fx.invalidate(old, p, T0).collect()}
    assert got["a"] == got["b"] == (d(2026, 3, 1), T0) and got["c"] == (None, None) and got["d"] == (d(2026, 1, 5), None)
    new = fact(spark, [("n", "g", "x", "y", "f", d(2026, 3, 1), None)])
    c = spark.createDataFrame([("n", d(2026, 4, 1)), ("n", d(2026, 5, 1)), ("n", None)], "uuid string, valid_at timestamp_ntz")
    r = fx.expire_new(new, c, T0).first()
    assert (r.invalid_at, r.expired_at) == (d(2026, 4, 1), T0)
    s = {r.uuid: r.invalid_at for r in fx.supersede(old, ["source_node_uuid"], T0).collect()}
    assert s == {"a": d(2026, 2, 1), "b": d(2026, 4, 1), "c": None, "d": d(2026, 1, 5)}


def test_text():
    assert tx.parse_iso("2026-W05-1T10:00+02:00") == datetime(2026, 1, 26, 8) and tx.parse_iso(" 2026-01-01") is None and tx.parse_iso("2026-01-01T00:00:00Z") == datetime(2026, 1, 1) and tx.parse_iso("2026-13-01") is None
    assert tx.truncate_sentences("One. Two. Three", 9) == "One. Two." and tx.truncate_sentences("abcdef", 3) == "abc" and tx.truncate_sentences("One. Two", -3) == "One."
    assert tx.describe_type("A b.  C d. E f. G h.\n\nsecond") == "A b. C d. E f."
    assert tx.join_episodes([("t", "x")]) == "x" and tx.join_episodes([("t", "x"), ("u", "y")]).startswith("[Episode 0] (timestamp: t)\nx")
    v = vx.hash_embed(["Open ai", "OPEN AI", None], 64)
    assert (v[0] == v[1]).all() and not v[2].any()


def test_chunks():
    big = "[" + ", ".join(f'{{"k": {i}}}' for i in range(900)) + "]"
    assert ch.should_chunk(big, "json") and not ch.should_chunk("short", "json")
    import json

    got = ch.chunk_json(big, 300, 20)
    assert len(got) > 3 and all(ch.count_tokens(c) <= 300 for c in got)
    assert sorted({x["k"] for c in got for x in json.loads(c)}) == list(range(900)) and json.loads(got[0])[-1] in json.loads(got[1])
    prose = "\n\n".join(" ".join(f"Sentence {i} of paragraph {k}." for i in range(30)) for k in range(20))
    parts = ch.chunk_text(prose, 200, 20)
    assert all(ch.count_tokens(c) <= 220 for c in parts) and all(f"Sentence {i} of paragraph {k}." in " ".join(parts) for i in (0, 29) for k in (0, 19))
    talk = "\n".join(f"Speaker{i % 3}: " + "words " * 60 for i in range(40))
    assert "".join(ch.chunk_message(talk, 300, 0)).count("Speaker") == 40
    assert ch.chunk(None) == [] and ch.chunk("") == [] and ch.chunk("x" * 99999, "text", 100, 10)[0] == "x" * 400


@pytest.mark.parametrize(("n", "k"), [(0, 3), (3, 5), (7, 3), (6, 1), (30, 4)])
def test_covers(n, k):
    from itertools import combinations

    got = ch.cover(list(range(n)), k)
    met = {p for c in got for p in combinations(sorted(c), 2)}
    assert met == set(combinations(range(n), 2)) and all(len(c) <= max(2, k) for c in got)


def test_parsing(spark):
    e, f = ig.parse_extraction('{"nodes": [{"name": "A", "type_id": 1}, {"name": " "}], "facts": [{"source": "A", "target": "B", "relation": "R", "fact": "x", "episode_indices": [0, "y"]}, {"source": "A", "target": "B", "fact": "none"}]}')
    assert e == [{"name": "A", "entity_type_id": 1, "episode_indices": []}] and len(f) == 1 and f[0]["episode_indices"] == [0]
    with pytest.raises(ValueError):
        ig.parse_extraction('{"nodes": [{"name": "A"}]}')
    rows = spark.createDataFrame([("e", "g", x) for x in ("{", None, "[1]", '{"nodes": [5]}', '{"nodes": [{"name": "A", "type_id": 0}]}')], "episode_uuid string, group_id string, response string")
    assert ig.parse_table(rows)[0].count() == 1
    assert ig.merge_attributes({"a": 1, "x": 2}, {"a": "y" * 300, "b": 3, "z": 4}, {"a": {}, "b": {}}, True) == {"x": 2, "a": 1, "b": 3}
    n = spark.createDataFrame([([1, 9, 1],), (None,), ([],)], "i array<int>").select(ig.normalize_indices(F.col("i"), F.lit(3))).collect()
    assert [r[0] for r in n] == [[1], [0, 1, 2], [0, 1, 2]]


def test_recipes_and_errors(spark):
    assert len(plan.RECIPES) == 16
    with pytest.raises(ValueError):
        plan.check(plan.Config(limit=-1))
    with pytest.raises(sc.NodeNotFound):
        reads.by_uuid(src.empty(spark)["entity"], "x")
    t = src.empty(spark)
    assert plan.search(t, "  ", plan.recipe("edge_hybrid_search_rrf")).count() == 0
    with pytest.raises(sc.RerankerError):
        plan.search(t, "x", plan.recipe("edge_hybrid_search_node_distance"), [1.0]).count()


def test_store(spark, tmp_path):
    import json

    answers = {"p1": {"entities": [{"name": "Ann Lee", "entity_type_id": 0}, {"name": "Acme Inc", "entity_type_id": 0}], "edges": [{"source": "Ann Lee", "target": "Acme Inc", "relation": "WORKS_AT", "fact": "Ann Lee works at Acme Inc", "valid_at": "2026-01-01T00:00:00"}]}, "p2": {"entities": [{"name": "ann lee", "entity_type_id": 0}, {"name": "Acme Inc", "entity_type_id": 0}], "edges": [{"source": "ann lee", "target": "Acme Inc", "relation": "WORKS_AT", "fact": "Ann Lee leads Acme Inc", "valid_at": "2026-03-01T00:00:00"}]}}

    def extract(df):
        return spark.createDataFrame([(r.episode_uuid, r.group_id, json.dumps(answers[r.episode_uuid])) for r in df.collect()], "episode_uuid string, group_id string, response string")

    g = GraphStore(spark, extract=extract, dim=32)
    for k, u in enumerate(("p1", "p2")):
        g.add_episodes(spark.createDataFrame([(u, u, "g", ["Episodic"], T0, "text", "", f"text {u}", T0, [], None, k)], sc.SCHEMAS["episodic"]), T0)
    assert g.entity.table.count() == 2 and g.mentions.table.count() == 4
    f = {r.fact: r for r in g.entity_edge.table.collect()}
    assert f["Ann Lee works at Acme Inc"].invalid_at == datetime(2026, 3, 1) and f["Ann Lee leads Acme Inc"].invalid_at is None
    hit = g.search("who leads", ["g"]).join(g.entity_edge.table, "uuid").orderBy("pos").first()
    assert hit.fact == "Ann Lee leads Acme Inc"
    g.build_communities()
    assert g.has_member.table.count() in (0, 2)
    g.save(f"{tmp_path}/saved")
    h = GraphStore.load(spark, f"{tmp_path}/saved", dim=32)
    h.remove_episode("p2")
    assert [r.fact for r in h.entity_edge.table.collect()] == ["Ann Lee works at Acme Inc"] and h.entity.table.count() == 2
    h.remove_episode("p1")
    assert h.entity.table.count() == 0 == h.entity_edge.table.count()
    h.add_triplet(("A b", "g"), "R", "A b knows C d", ("C d", "g"))
    assert h.entity_edge.table.count() == 1 and h.entity.table.count() == 2 and h.episodic.table.count() == 0
    h.clear()
    assert h.entity.table.count() == 0


def test_stream(spark, tmp_path):
    from tempograph.streaming import ingest as st

    rows = [(f"e{i}", "n", "g", ["Entity"], T0, None, f"s{i}", "{}", i) for i in range(3)]
    spark.createDataFrame(rows, sc.SCHEMAS["entity"]).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("e1", "n", "g", ["Entity"], T0, None, "later", "{}", 9)], sc.SCHEMAS["entity"]).write.mode("append").parquet(f"{tmp_path}/in")
    q = st.upsert_batches(st.episode_stream(spark, f"{tmp_path}/in", "entity", files=1), f"{tmp_path}/graph", "entity", f"{tmp_path}/cp")
    q.awaitTermination()
    got = {r.uuid for r in spark.read.parquet(st.current(spark, f"{tmp_path}/graph", "entity")).collect()}
    assert got == {"e0", "e1", "e2"}


def test_saga_repair(spark):
    n = spark.createDataFrame([("n1", "g", "a", "b", T0, 0), ("n2", "g", "b", "c", T0, 1), ("n3", "g", "c", "d", T0, 2)], sc.SCHEMAS["next_episode"])
    gone = spark.createDataFrame([("b",), ("c",)], "uuid string")
    after = writes.repair_sagas({"next_episode": n}, {"next_episode": n}, gone)["next_episode"].collect()
    assert [(r.source_node_uuid, r.target_node_uuid) for r in after] == [("a", "d")]


def test_bridges_over_branches_and_circles(spark):
    links = [("a", "r"), ("r", "s"), ("s", "b"), ("r", "c"), ("a", "c"), ("s", "r"), ("d", "t"), ("t", "d"), ("e", "t"), ("x", "y"), ("s", "s")]
    n = spark.createDataFrame([(f"n{i}", "g", a, b, T0, i) for i, (a, b) in enumerate(links)], sc.SCHEMAS["next_episode"])
    gone = spark.createDataFrame([(u,) for u in "rst"], "uuid string")
    got = sorted((r.source_node_uuid, r.target_node_uuid) for r in writes.bridged(n, gone).collect())
    assert got == [("a", "b"), ("a", "c"), ("e", "d"), ("x", "y")]
    assert writes.bridged(n, gone.limit(0)).count() == len(links)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_grouped_by_ends_need_no_further_shuffle(spark, no_broadcast):
    f = src.facts(spark, "/root/testdata/sf0.001")
    assert exchanges(f) == 6  # lines twice, orders twice, customers, parts
    assert exchanges(f.groupBy("source_node_uuid", "target_node_uuid").count()) == 6
    assert exchanges(fx.dedupe_batch(f)) == 6


def test_validity_among_facts_is_that_of_pairs(spark, no_broadcast):
    rng, now = random.Random(5), datetime(2025, 1, 1)
    day = lambda: datetime(2024, 1, rng.randint(1, 9)) if rng.random() < 0.9 else None
    rows = [(str(i), "a", str(rng.randint(0, 9)), day(), day(), day() if rng.random() < 0.2 else None) for i in range(80)]
    f = spark.createDataFrame(rows, "uuid string, source_node_uuid string, target_node_uuid string, valid_at timestamp_ntz, invalid_at timestamp_ntz, expired_at timestamp_ntz")
    key = ["source_node_uuid", "target_node_uuid"]
    peers = f.select("uuid", *key).join(f.select(*key, "valid_at", "invalid_at"), key)
    pairs = peers.select(F.col("uuid").alias("candidate"), F.col("valid_at").alias("new_valid_at"), F.col("invalid_at").alias("new_invalid_at"))
    for got, want in ((fx.invalidate_among(f, key, now), fx.invalidate(f, pairs, now)), (fx.expire_among(f, key, now), fx.expire_new(f, peers.select("uuid", "valid_at"), now))):
        assert exchanges(got) == 1
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_first_duplicates_and_overrides_make_no_pairs(spark, no_broadcast):
    rng = random.Random(6)
    rows = [(str(rng.randint(0, 25)), "a", "b", rng.choice("xyz") + " ", rng.randint(0, 40)) for _ in range(60)]
    f = spark.createDataFrame(rows, "uuid string, source_node_uuid string, target_node_uuid string, fact string, _seq long").dropDuplicates(["_seq"])
    want = {}
    for a in f.collect():
        hits = [(b["_seq"], b["uuid"]) for b in f.collect() if b["fact"] == a["fact"] and b["uuid"] != a["uuid"]]
        want[a["uuid"]] = min([*hits, *([want[a["uuid"]]] if a["uuid"] in want else [])])
    got = fx.exact_duplicates(f, f)
    assert {r["uuid"]: r["duplicate_of"] for r in got.collect()} == {u: d for u, (_, d) in want.items()}
    base = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "uuid string, fact string")
    new = fx.merge_overrides(base, spark.createDataFrame([("1", None), ("3", "d")], "uuid string, fact string"))
    assert exchanges(new) == 2
    assert sorted(map(tuple, new.collect()), key=str) == sorted([("1", None), ("1", None), ("2", "c"), ("3", "d")], key=str)


def test_mmr_by_rounded_scores_takes_ties_in_order(spark):
    v = spark.createDataFrame([("a", [1.0, 1e-4]), ("b", [1.0, 0.0]), ("c", [1.0, 2e-4]), ("d", [0.0, 1.0])], "uuid string, v array<float>")
    got = rk.mmr(ranked(spark, "acbd"), v, "v", [1.0, 0.0], 3, 0.5, -2.0, digits=3)
    assert [u for u, _ in pairs(got)] == ["a", "c", "b"]


def test_candidates_are_those_of_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(resolve, "CELL", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    x[40:50] = x[:10]  # copies: equal scores go by _seq
    x[50] = 0
    rows = [(f"e{i:03d}", None, "g" if i % 4 else f"h{i % 3}", [], T0, x[i].tolist() if i != 51 else None, "", "{}", i) for i in range(60)]
    v = spark.createDataFrame(rows, sc.SCHEMAS["entity"])
    j = v.alias("a").join(v.alias("b"), F.expr("a.group_id = b.group_id and a.name_embedding is not null and b.name_embedding is not null"))
    s = j.select("a.uuid", F.col("b.uuid").alias("c"), vx.cosine("a.name_embedding", "b.name_embedding").alias("s")).where("s > 0.6").collect()
    want = set()
    for u in {r["uuid"] for r in s}:
        own = sorted((-np.float32(r["s"]), r["c"]) for r in s if r["uuid"] == u)[:3]
        want |= {(u, c, k, float(-z)) for k, (z, c) in enumerate(own, 1)}
    got = resolve.candidates(v, v, limit=3)
    assert {(r["uuid"], r["candidate"], r["rank"], r["score"]) for r in got.collect()} == want


def test_similar_sets_of_frequent_members_make_few_pairs(spark):
    rows = [(f"Customer#{i:09d} nation {i % 25}", "g") for i in range(3000)]
    x = spark.createDataFrame(rows, "id string, g string").withColumn("t", tx.shingles(tx.fuzzy_form("id")))
    sets = {r["id"]: set(r["t"]) for r in x.collect()}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    plan_of = resolve.similar_sets(x, 0.8)
    assert {(r["a"], r["b"]) for r in plan_of.collect()} == want and want
    assert resolve._levels(22, 0.8)[5] == 9 and resolve._levels(15, 0.9)[12] == 13


def test_exact_resolution_reads_no_shingles(spark):
    e = entity(spark, [("1", "Alpha Beta", "g", [], None), ("2", "Gamma Delta", "g", [], None)])
    got = resolve.resolve(e.withColumn("uuid", F.concat(F.lit("x"), "uuid")), e)
    assert "_bands" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("x1", "1", "exact"), ("x2", "2", "exact")]


def test_label_propagation_by_rounds_is_that_of_one_task(spark):
    rng = random.Random(8)
    groups = {"a": 30, "b": 12, "c": 2, None: 3}
    rows, edges, want = [], [], {}
    for g, n in groups.items():
        own = [f"{g}{i:02d}" for i in range(n)]
        rows += [(u, u, g, [], None) for u in own]
        links = [(rng.choice(own), rng.choice(own)) for _ in range(2 * n)] if g != "c" else [("c00", "c01")] * 2  # c: two labels in turn
        edges += links
        want |= {u: (g, k) for u, k in cm.propagate(sorted(own, reverse=True), links if g else []).items()}
    f = fact(spark, [(str(i), "x", s, t, "", None, None) for i, (s, t) in enumerate([*edges, ("a00", "b00")])])
    out = cm.label_propagation(entity(spark, rows), f)
    assert "applyInPandas" not in out._jdf.queryExecution().logical().toString() and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().logical().toString()
    got = out.collect()
    assert {r["uuid"]: (r["group_id"], r["label"]) for r in got} == want
    assert all(r["n_members"] == sum(v == want[r["uuid"]] for v in want.values()) for r in got)


@pytest.mark.parametrize(("n", "k"), [(101, 2), (250, 3), (333, 3), (240, 5), (700, 40), (150, 149)])
def test_parts_cover_every_pair_and_number_their_lists(n, k):
    lists, numbers = [], []
    for part in ch.cover_parts(n, k):
        for number, offsets, at in ch._lists(part, k):
            lists += [at[i:j].tolist() for i, j in zip(offsets, offsets[1:])]
            numbers += range(number, number + len(offsets) - 1)
    assert sorted(numbers) == list(range(len(lists)))
    assert all(1 < len(x) <= k and x == sorted(set(x)) for x in lists)
    assert {(a, b) for x in lists for i, a in enumerate(x) for b in x[i + 1 :]} == {(a, b) for a in range(n) for b in range(a + 1, n)}
    assert len(lists) <= (1.6 if k < 9 else 3) * n * (n - 1) / (k * (k - 1)) + 2 * n / k


def test_covers_of_a_large_group_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(ch, "PART_LISTS", 2000)
    rows = spark.createDataFrame([("a", f"{i:03d}") for i in range(150)] + [("b", "x"), ("b", "y")], "g string, i string")
    got = ch.cover_table(rows, "g", "i", 3)
    assert got.select(F.spark_partition_id()).distinct().count() > 2
    own = [r for r in got.collect() if r["g"] == "a"]
    assert {(x, y) for r in own for x in r["items"] for y in r["items"] if x < y} == {(f"{i:03d}", f"{j:03d}") for i in range(150) for j in range(i + 1, 150)}
    assert sorted(r["cover_no"] for r in own) == list(range(len(own)))
    assert [tuple(r) for r in got.where("g = 'b'").collect()] == [("b", 0, ["x", "y"])]


def test_chunks_are_given_a_slice_at_a_time():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"content": ["x" * 700_000, None, "y" * 700_000, "", "z" * 3_000_000, "w"]})
    got = [s.column("content").to_pylist() for s in ch._slices(b, "content")]
    assert [x for s in got for x in s] == b.column("content").to_pylist()
    assert len(got) > 2 and all(len(s) == 1 or sum(len(x or "") for x in s) <= 2 * ch.TEXT_BYTES + 3_000_000 for s in got)


def test_searches_by_classes_are_those_of_scores(spark, monkeypatch):
    import math

    monkeypatch.setattr(fx, "RARE", 4)
    monkeypatch.setattr(fx, "CELL", (3, 5))
    rng = random.Random(4)
    word = lambda: rng.choice("abcde") if rng.random() < 0.7 else f"n{rng.randint(0, 60)}"
    docs = [(f"u{i:03d}", rng.choice("gh"), " ".join(word() for _ in range(rng.randint(1, 6))), i // 2) for i in range(200)]
    rows = spark.createDataFrame(docs, "candidate string, group_id string, t string, _seq long")
    asked = docs[::7]
    queries = spark.createDataFrame([(u, g, t) for u, g, t, _ in asked], "uuid string, group_id string, q string")
    want = set()
    for u, g, q, _ in asked:
        own = [(c, t.split(), k) for c, h, t, k in docs if h == g]
        avg = sum(len(t) for _, t, _ in own) / len(own)
        got = []
        for c, t, k in own:
            s = 0.0
            for w in set(q.split()):
                df = sum(w in x for _, x, _ in own)
                s += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg))
            if s > 0 and c != u:
                got.append((-round(s, 6), k, c))
        want |= {(u, c, i) for i, (_, _, c) in enumerate(sorted(got)[:5])}
    assert {(r["uuid"], r["candidate"], r["pos"]) for r in fx.search_each(queries, rows, 5).collect()} == want


def test_a_walk_ends_where_it_reaches_nothing_new(spark, monkeypatch):
    made = []
    monkeypatch.setattr(traversal, "written", lambda df: made.append(1) or src.written(df))
    n = entity(spark, [(x, x, "g", [], None) for x in "abc"])
    f = fact(spark, [("1", "g", "a", "b", "", None, None), ("2", "g", "a", "c", "", None, None)])
    m = spark.createDataFrame([], sc.SCHEMAS["mentions"])
    steps = traversal.walk(spark.createDataFrame([("a", 0)], "uuid string, pos int"), n.select("uuid", "group_id"), m, f, 9)
    assert sorted((r["edge"], r["depth"]) for r in steps.collect()) == [("1", 1), ("2", 1)]
    assert len(made) == 2  # b and c; then nothing
