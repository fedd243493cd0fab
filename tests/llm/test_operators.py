"""Each operator against brute force, and its edge cases."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempograph.llm import langid, lattice, linecrf, lines, mixing, neardup, packing, quality, secretscan, suffix
from tempograph.llm.common import cell_pairs, components

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "a null id with some words", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "... !!!", "en", "s", 7), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "\n\n\n", "xx", "s", 3), (6, "word " * 30000, "en", "s", 150000), (7, "é" * 10, "fr", "s", 10)]


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    # columns that clash with names used inside
    return spark.createDataFrame(ODD, DOCS).withColumn("h", F.lit(1)).withColumn("n", F.lit("x")).withColumn("__id", F.lit(2)).withColumn("rep", F.lit(2)).withColumn("count", F.lit(2)).withColumn("b", F.lit(0))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, 0), (4, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in read(spark, "documents").select("doc_id", "text").collect()}


def words(t):
    return re.findall(rb"[A-Za-z0-9_\x80-\xff]+", (t or "").lower().encode())


# 1


def test_repeated_passages_are_those_of_brute_force(spark, texts):
    got = {(r.doc_id, r.first_word, r.last_word) for r in suffix.repeated_passages(spark, read(spark, "documents")).collect()}
    where = collections.defaultdict(set)
    toks = {d: words(t) for d, t in texts.items()}
    for d, w in toks.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(d)
    want = set()
    for d, w in toks.items():
        m = np.zeros(len(w) + 1, int)
        for i in range(len(w) - 49):
            if len(where[tuple(w[i : i + 50])]) > 1:
                m[i : i + 50] = 1
        e = np.flatnonzero(np.diff(np.concatenate([[0], m])))
        want |= {(d, int(s), int(x)) for s, x in zip(e[::2], e[1::2], strict=True)}
    assert got == want and want


def test_repeated_passages_planted_and_odd(spark, odd):
    r = random.Random(1)
    p = " ".join(str(r.random()) for _ in range(30))  # 60 words
    rows = [(100 + i, f"{' '.join(str(r.random()) for _ in range(20 + i))} {p.upper() if i else p} tail{i}", "en", "s", 1) for i in range(3)]
    rows += [(200, "same " * 500, "en", "s", 1), (201, p[: len(p) // 2], "en", "s", 1)]
    d = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, DOCS))
    got = {x.doc_id: x for x in suffix.repeated_passages(spark, d).collect()}
    assert set(got) == {100, 101, 102}
    assert all(x.words == 60 and x.copies == 3 and x.first_doc == 100 for x in got.values()) and got[100]["first"] and not got[101]["first"]
    assert suffix.repeated_passages(spark, odd.limit(0)).count() == 0 == suffix.repeated_passages(spark, odd).count()


# 2


def test_quality_on_held_out_rows(spark):
    d, lab = read(spark, "documents"), read(spark, "labels")
    m = quality.fit(spark, d, lab.where("doc_id % 3 <> 0"))
    j = quality.score_documents(d, m).join(lab.where("doc_id % 3 = 0"), "doc_id").select("quality", "keep").collect()
    good, bad = [x.keep for x in j if x.quality == 1], [x.keep for x in j if x.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_machine_pairs_by_hand():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)), np.zeros(1), np.ones(1))
    f, x = np.array([1, 4, 7, 8]), rng.normal(size=4)
    want = 0.3 + m.w[f] @ x + sum(m.v[f[i]] @ m.v[f[j]] * x[i] * x[j] for i, j in itertools.combinations(range(4), 2))
    assert abs(m.score(1, np.zeros(4, int), f, x)[0] - want) < 1e-9


def test_quality_odd_rows(spark, odd, labels):
    got = quality.classify(spark, odd, labels).collect()
    assert len(got) == len(ODD)
    assert {x.doc_id for x in got if not x.keep} >= {1, 2, 3, 5}
    assert quality.classify(spark, odd.limit(0), labels).count() == 0
    assert quality.keep_rows(odd, quality.fit(spark, odd, labels.limit(0))).columns == odd.columns


# 3


def test_packing_is_its_sql(spark, odd):
    for d in (read(spark, "documents"), odd):
        got = packing.pack(d).toPandas()
        c = duckdb.connect()
        rows = d.select("doc_id", "text").toPandas()
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        c.register("documents", rows)
        want = c.execute(packing.pack_sql()).df()[list(got.columns)]
        key = lambda df: sorted(map(str, df.astype("Int64").values.tolist()))
        assert key(got) == key(want)
        bins = got.groupby(["class", "shard", "bin"]).piece_tokens.agg(["sum", "count"]).reset_index()
        assert bins["sum"].max() <= packing.CAPACITY and (bins["count"] <= bins["class"]).all()
    assert packing.pack(odd.limit(0)).count() == 0
    odd_lengths = packing.pack(odd, F.when(F.col("doc_id") == 6, 5000).when(F.col("doc_id") == 1, None).otherwise(0)).collect()
    assert sorted(x.piece_tokens for x in odd_lengths if x.doc_id == 6) == [904, 2048, 2048]


# 4


def test_mixing_meets_targets_in_expectation(spark):
    got = mixing.mix(spark, read(spark, "documents"), read(spark, "labels"), {"clean": 0.8, "toxic": 0.15, "low": 0.05}).toPandas()
    n = got.n_tokens.sum()
    for k, w in (("clean", 0.8), ("toxic", 0.15), ("low", 0.05)):
        assert abs((got.n_tokens * got.rate * got[f"p_{k}"]).sum() / n - w) < 0.02
    assert (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()


def test_rates_reach_the_least_squares(spark):
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.5] * 3, 60), rng.integers(1, 50, 60)
    rows = [(i, int(n[i]), [float(x) for x in p[i]]) for i in range(60)]
    h = mixing.fit_rates(spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>"), {"clean": 0.2, "toxic": 0.7, "low": 0.1}, 200, 1e-6)
    r = mixing._rates(60, p, h)
    assert np.abs((r * n) @ p / n.sum() - [0.2, 0.7, 0.1]).max() < 1e-3


def test_rates_of_rare_domains_with_the_defaults(spark):
    """Shares of 0.955, 0.045 and 0.0005 as after the quality stage, once hard and once a little soft."""
    n = 4000
    for soft in (0.0, 0.004):
        p = np.full((n, 3), soft / 2)
        p[np.arange(n), [2 if i < 2 else 1 if i < 180 else 0 for i in range(n)]] = 1 - soft
        rows = [(i, 100, [float(x) for x in p[i]]) for i in range(n)]
        h = mixing.fit_rates(spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>"), mixing.TARGETS)
        r = mixing._rates(n, p, h)
        assert np.abs(r @ p / n - [0.97, 0.02, 0.01]).max() < 2e-4


def test_unmet_targets_are_reported(spark):
    d = spark.createDataFrame([(i, 10, [1.0, 0.0, 0.0]) for i in range(20)], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="can't be met"):
        h = mixing.fit_rates(d, mixing.TARGETS)
    assert abs(mixing._rates(1, np.array([[1.0, 0.0, 0.0]]), h)[0] - 0.97) < 1e-3


def test_rates_are_the_nearest_by_the_optimality_conditions(spark):
    """Least change of rates in the token metric, given the targets: r = max(1 + p . x, 0) for one x, and it is unique."""
    rng = np.random.default_rng(14)
    d = read(spark, "documents").where("doc_id < 300")
    got = mixing.mix(spark, d, read(spark, "labels"), {"clean": 0.5, "toxic": 0.2, "low": 0.3}).toPandas()
    p, n, r = got[["p_clean", "p_toxic", "p_low"]].to_numpy(), got.n_tokens.to_numpy(float), got.rate.to_numpy()
    assert np.abs((r * n) @ p / n.sum() - [0.5, 0.2, 0.3]).max() < 1e-3
    x = np.linalg.lstsq(p[r > 0], r[r > 0] - 1, rcond=None)[0]
    assert np.abs(np.maximum(1 + p @ x, 0) - r).max() < 1e-6
    # brute force: no other rates with the same totals are nearer to 1
    move = rng.normal(size=(200, len(n)))
    totals = p * n[:, None]
    move -= (totals @ np.linalg.solve(totals.T @ totals, totals.T @ move.T)).T
    for m in move:
        other = np.maximum(r + 0.05 * m, 0)
        if np.abs((other * n) @ p - (r * n) @ p).max() < 1e-6 * n.sum():
            assert (n * (other - 1) ** 2).sum() >= (n * (r - 1) ** 2).sum() - 1e-6
    # copies round the rate, and repeated rows have one rate
    twice = mixing.mix(spark, d.unionByName(d.where("doc_id = 7")), read(spark, "labels")).where("doc_id = 7").collect()
    assert len(twice) == 2 and abs(twice[0].rate - twice[1].rate) < 1e-9 and twice[0].copies == twice[1].copies


def test_mixing_odd_rows(spark, odd, labels):
    assert mixing.mix(spark, odd, labels).count() == len(ODD)
    assert mixing.mix(spark, odd.limit(0), labels.limit(0)).count() == 0
    assert mixing.resample(spark, odd, labels).columns == odd.columns


def test_copies_of_more_than_an_arrow_column_holds(spark, labels, monkeypatch):
    """33,000 copies of a text of 64 KB are more than the 2 GB of one string column."""
    monkeypatch.setattr(mixing, "fit_rates", lambda *_: np.full((1, 3), -32999.0))
    docs = spark.createDataFrame([(1, "word " * 13107, "en", "s", 65535)], DOCS)
    got = mixing.resample(spark, docs, labels.limit(0)).agg(F.count("*"), F.min(F.length("text")), F.max(F.length("text"))).first()
    assert tuple(got) == (33000, 65535, 65535)


# 5


def test_languages_of_held_out_rows(spark):
    d = read(spark, "documents")
    f = langid.train(spark, d.where("doc_id % 2 = 0"), 200)
    j = langid.identify(d.where("doc_id % 2 = 1"), f).join(d.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 40").collect()
    assert np.mean([x.language == x.lang for x in j]) > 0.98


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(5)
    f = langid.Filters.empty([f"l{k}" for k in range(70)])
    grams = [rng.integers(0, 2**32, 2000).astype(np.uint32) for _ in range(2)]
    for k, g in zip((3, 68), grams, strict=True):
        f.add(k, g)
    got = f.counts(1, np.zeros(2000, int), grams[1])
    assert got[0, 68] == 2000 and got[0, 3] < 40 and got.sum() == got[0, 3] + 2000


def test_languages_are_those_of_exact_ngram_sets(spark, texts):
    """Brute force: each language's n-grams as a set, counted in Python, instead of the filters."""
    d = read(spark, "documents")
    f = langid.train(spark, d, 40)
    lang = {r[0]: r[1] for r in d.select("doc_id", "lang").collect()}
    order = {r[0]: r[1] for r in d.select("doc_id", F.xxhash64("doc_id")).collect()}

    def grams(t):
        low = re.sub(rb"[^a-z\x80-\xff]", b" ", (t or "").translate({c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}).encode())
        return [g for g in (low[i : i + 4] for i in range(len(low) - 3)) if len(g.replace(b" ", b"")) >= 2]

    sets = {}
    for name in f.names:
        own = sorted((k for k in lang if lang[k] == name and texts[k] is not None), key=lambda k: order[k])[:40]
        count = collections.Counter(g for k in own for g in grams(texts[k]))
        sets[name] = {g for g, n in count.items() if n >= max(2.0, 3e-5 * count.total())}
    got = {r.doc_id: r for r in langid.identify(d, f).collect()}
    off = 0
    for k, t in texts.items():
        g = grams(t)
        share = {name: sum(x in sets[name] for x in g) / max(len(g), 1) for name in f.names}
        best = max(f.names, key=lambda x: share[x])
        assert got[k].grams == len(g)
        if len(g) >= 8 and share[best] >= 0.25:
            off += got[k].language != best
            assert abs(got[k].share - share[best]) < 0.02 or len(g) < 100
    assert off <= 0.005 * len(texts)
    assert langid.identify(d.limit(0), f).count() == 0
    tie = langid.Filters.empty(["b", "a"])
    for k in range(2):
        tie.add(k, np.frombuffer(b"abcdefghabcdefgh", dtype=np.uint8)[:0].astype(np.uint32))
        tie.add(k, langid.ngrams(np.frombuffer(b"some words of a text", np.uint8), np.array([0, 20]))[1])
    assert langid.identify(d.limit(1).withColumn("text", F.lit("some words of a text")), tie).first().language == "b"


def test_languages_odd_rows(spark, odd):
    got = {x.doc_id: x.language for x in langid.identify(odd, langid.train(spark, odd)).collect()}
    assert len(got) == len(ODD) - 1 and got[1] == got[2] == got[3] == got[5] == "und"
    assert langid.identify(odd, langid.train(spark, odd.limit(0))).where("language <> 'und'").count() == 0


# 6


def test_lattice_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base[:150] + rng.normal(scale=0.25, size=(150, 64)), base[:40] + rng.normal(scale=0.05, size=(40, 64))])
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [1.0], 0), (None, [1.0] * 64, 0), (904, [None] * 64, 0), (0, rows[0][1], 0), (0, rows[0][1], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).withColumn("x", F.lit(2))
    rows += [(950 + i, [1.0, float(i), 0.0], 0) for i in (0, 0.01, 9)] + [(960, rows[5][1], 0), (961, [2 * v for v in rows[5][1]], 0)]
    d = spark.createDataFrame([(None if r[0] is None else int(r[0]), *r[1:]) if k < len(x) + 8 else (950 + k, *r[1:]) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).withColumn("x", F.lit(2))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= lattice.THRESHOLD, 1)), strict=True)}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for i, j in want:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    found = []
    for split in ({}, {"hot": 2, "sampled": 1}):
        r = {y.vec_id: y for y in lattice.near_duplicates(spark, d, **split).collect()}
        found.append({k: v.class_id for k, v in r.items()})
        assert all(v.cosine >= lattice.THRESHOLD and v.links >= 1 for v in r.values())
        same = sum(i in r and j in r and r[i].class_id == r[j].class_id for i, j in want)
        assert same >= 0.9 * len(want) and len(want) > 100, (same, len(want))
        # no class is larger than its component
        assert all(root(k) == root(v.class_id) for k, v in r.items() if k < len(x))
        others = {k for k in r if k >= len(x)}
        assert r[5].class_id == 5 and len(others) == 4 and len({r[k].class_id for k in others}) == 2
    assert found[0] == found[1]
    assert lattice.near_duplicates(spark, d.limit(0)).count() == 0


def test_cell_pairs_are_those_of_brute_force(spark):
    r = random.Random(6)
    rows = [(r.randrange(12), r.random() < 0.3, i, i if r.random() < 0.5 else r.randrange(3), r.randrange(100)) for i in range(400)]
    d = spark.createDataFrame(rows, "key long, probe boolean, id long, cls long, v int")
    near = lambda x, i, j: abs(x["v"][i] - x["v"][j]) < 50
    for probes in (False, True):
        want = {(min(a[2], b[2]), max(a[2], b[2])) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[3] != b[3] and abs(a[4] - b[4]) < 50 and (probes or not (a[1] and b[1]))}
        for split in ({}, {"hot": 10, "sampled": 1}):
            got = {(x.a, x.b) for x in cell_pairs(d, None, {"v": "int"}, near, probes, **split).collect()}
            assert got == want and want


def test_decode_is_nearest():
    rng = np.random.default_rng(7)
    x = rng.normal(scale=1.5, size=(200, 8))
    got = lattice.decode_e8(x) / 2
    ring = np.concatenate([np.zeros((1, 8)), lattice.shortest() / 2])
    assert len(lattice.shortest()) == 240
    d = ((x[:, None, :] - (got[:, None, :] + ring)) ** 2).sum(axis=2)
    assert (d[:, 0] <= d.min(axis=1) + 1e-9).all()


# 7


def test_assignments():
    p = {(x.name, x.literal, x.via) for x in secretscan.pairs('a = "q8Zr4kPw"\npassword = a\nurl: str = "http://x"\nexport DB_PASS=hunter22\n{"api_key": "k" + "9x"}\ntoken = f"{a}-1"\nif x == "y": pass')}
    assert {("a", "q8Zr4kPw", ""), ("password", "q8Zr4kPw", "a"), ("url", "http://x", ""), ("DB_PASS", "hunter22", ""), ("api_key", "k9x", ""), ("token", "q8Zr4kPw-1", "a")} <= p


def test_scores():
    assert secretscan.score("password", "q8Zr4kPw") > 0.5 > secretscan.score("color", "q8Zr4kPw9zL0")
    assert secretscan.score("password", "changeme") == secretscan.score("token", "<your token>") == secretscan.score("token", "${TOKEN}") == 0
    assert secretscan.score("x", "AKIA" + "A1B2" * 4) == 1 and secretscan.score("token_count", "12345678901234") < 0.5


def test_secrets_of_the_documents(spark, odd, texts):
    want = {d for d, t in texts.items() if re.search(r'token = "[0-9a-f]{40}"', t)}
    got = {r.doc_id for r in secretscan.scan(read(spark, "documents")).collect()}
    assert got >= want and len(got - want) <= 5
    assert secretscan.scan(odd).count() == 0 == secretscan.scan(odd.limit(0)).count()


QUOTED = ['password = "q8Zr4kPw9x"', '`password` = "q8Zr4kPw9x"', 'password_clé = "q8Zr4kPw9x"', 'token_ñ: "q8Zr4kPw9xL2"', 'password += "q8Zr4kPw9x"', '`api_key`: "q8Zr4kPw9xL2"', "password' = q8Zr4kPw9x", 'environ["password"] = "q8Zr4kPw9x"', 'password:: "q8Zr4kPw9x"', "password =\t'q8Zr4kPw9x'"]


def test_scan_finds_every_pair_that_scores(spark, texts):
    """Brute force: the parser over every text, with no filter in front."""
    rows = [*texts.items(), *[(10**6 + i, t) for i, t in enumerate(QUOTED)], (None, QUOTED[0]), (5 * 10**6, QUOTED[0]), (5 * 10**6, QUOTED[0]), (6 * 10**6, "plain words and signs: a = b; " * 20000 + QUOTED[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("x")).withColumn("score", F.lit(0)).withColumn("name", F.lit(1))
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.position, r.name, r.score) for r in secretscan.scan(d).collect()), key=key)
    want = []
    for k, t in rows:
        for p in secretscan.pairs(t or ""):
            v = secretscan.score(p.name, p.literal)
            if v >= secretscan.MIN_SCORE:
                want.append((k, p.at, p.name, v))
    assert got == sorted(want, key=key)
    assert {10**6 + i for i in range(len(QUOTED))} <= {g[0] for g in got}
    assert sum(g[0] is None for g in got) == 1 and sum(g[0] == 5 * 10**6 for g in got) == 2 and sum(g[0] == 6 * 10**6 for g in got) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"[a-z_]{0,5}(password|api_key|client_secret)", fullmatch=True), st.text("ABCDEFGHabcdefgh0123456789", min_size=16, max_size=30), st.sampled_from(["{n} = \"{v}\"", "{n}: '{v}'", "\"{n}\": \"{v}\",", "{n}={v}", "export {n}={v}", "{n} := `{v}`", "a_{n} = '{v}'"])), max_size=5), st.sampled_from(["", "some words, here.", "x == y"]))
def test_a_grammar_of_assignments_is_found(made, between):
    """Independent of the lexer: what is written by a small grammar must come back, in order."""
    text = f"\n{between}\n".join(form.format(n=n, v=v) for n, v, form in made)
    got = [(p.name, p.literal) for p in secretscan.pairs(text)]
    assert [x for x in got if x[1] in {v for _, v, _ in made}] == [(f"a_{n}" if form.startswith("a_") else n, v) for n, v, form in made]


# 8


def _brute_links(prints):
    """All pairs (a, b) of prints (id, f0, f1, f2, f3) that are links, by comparing all."""
    f = np.array([[x.f0, x.f1, x.f2, x.f3] for x in prints], dtype=np.int64).view(np.uint64)
    lanes = np.stack([((f[:, t // 2] >> np.uint64(32 * (t % 2))) & np.uint64(0xFFFFFFFF)) for t in range(neardup.TABLES)])
    out = set()
    for i in range(len(prints)):
        d = np.bitwise_count(lanes ^ lanes[:, i : i + 1])
        for j in np.flatnonzero((d.min(axis=0) <= neardup.RADIUS) & (d.sum(axis=0) <= neardup.AGREE)):
            if prints[i].id < prints[j].id:
                out.add((prints[i].id, prints[j].id))
    return out


def _roots(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(parent)}


def test_near_duplicate_links_connect_as_those_of_brute_force(spark):
    p = neardup.fingerprints(read(spark, "documents")).groupBy("f0", "f1", "f2", "f3").agg(F.min("doc_id").alias("id")).cache()
    want = _brute_links(p.collect())
    for split in ({}, {"hot": 3, "sampled": 1}):
        got = {(x.a, x.b) for x in neardup.links(p, **split).select("a", "b").collect()}
        assert got <= want and _roots(got) == _roots(want) and len(want) > 20


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2**32, 500).astype(np.uint32), rng.integers(0, 2**32, 500).astype(np.uint32)
    want = np.abs(neardup.popcounts(a).astype(int) - neardup.popcounts(b)).sum(axis=1)
    assert (neardup.manhattan(a, b) == want).all() and (want <= np.bitwise_count(a ^ b)).all()


def test_near_duplicate_groups(spark, odd, texts):
    r = random.Random(2)
    w = [f"w{r.randrange(10**6)}x" for _ in range(300)]
    near = w[:]
    near[10], near[200] = "changed", "altered"
    rows = [(500, " ".join(w), "en", "s", 1), (501, " ".join(w), "en", "s", 1), (502, " ".join(near), "en", "s", 1), (503, " ".join(f"u{r.randrange(10**6)}y" for _ in range(300)), "en", "s", 1), (503, "other words here", "en", "s", 1)]
    d = odd.unionByName(spark.createDataFrame(rows, DOCS), allowMissingColumns=True)
    got = {x.doc_id: (x.group_id, x.keep) for x in neardup.groups(spark, d).collect()}
    assert got == {500: (500, True), 501: (500, False), 502: (500, False)}
    kept = [x.doc_id for x in neardup.deduplicate(spark, d).collect()]
    # both texts of 503 stay, one of the equal rows of 4
    assert sorted(x for x in kept if x is not None) == [1, 2, 3, 4, 5, 6, 7, 500, 503, 503] and None in kept
    assert neardup.deduplicate(spark, d).columns == d.columns and neardup.deduplicate(spark, d.limit(0)).count() == 0
    assert neardup.groups(spark, odd.limit(0)).count() == 0
    all_of = {x.doc_id: x.group_id for x in neardup.groups(spark, read(spark, "documents")).collect()}
    same = collections.defaultdict(list)
    for k, t in texts.items():
        if words(t):
            same[t].append(k)
    assert all(len({all_of[x] for x in v}) == 1 for v in same.values() if len(v) > 1)


# 9


def test_viterbi_and_marginals_by_enumeration():
    rng = np.random.default_rng(9)
    f = linecrf.Field(np.zeros(linecrf.STATS), np.zeros(linecrf.BUCKETS), rng.normal(size=2), rng.normal(size=(2, 2)))
    doc = np.array([0, 0, 0, 0, 1, 3, 3])
    e = rng.normal(size=(7, 2))
    marks, (p, moves) = linecrf.viterbi(f, e, doc), linecrf.marginals(f, e, linecrf.steps(doc))
    total = np.zeros((2, 2))
    for k in (0, 1, 3):
        at = np.flatnonzero(doc == k)
        z, best, mass, pair = 0.0, None, np.zeros((len(at), 2)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            s = f.start[y[0]] + sum(e[i, v] for i, v in zip(at, y, strict=True)) + sum(f.move[a, b] for a, b in itertools.pairwise(y))
            q = np.exp(s)
            z += q
            best = max(best or (s, y), (s, y))
            for i, v in enumerate(y):
                mass[i, v] += q
            for a, b in itertools.pairwise(y):
                pair[a, b] += q
        assert tuple(marks[at]) == best[1] and np.allclose(p[at], mass / z)
        total += pair / z
    assert np.allclose(moves, total)


def test_ties_are_content():
    f = linecrf.Field(np.zeros(linecrf.STATS), np.zeros(linecrf.BUCKETS), np.zeros(2), np.zeros((2, 2)))
    assert (linecrf.viterbi(f, np.zeros((5, 2)), np.array([0, 0, 1, 2, 2])) == linecrf.CONTENT).all()


def test_line_labels_on_held_out_rows(spark, odd, labels):
    d, lab = read(spark, "documents"), read(spark, "labels")
    f = linecrf.train(spark, d, lab.where("doc_id % 3 <> 0"))
    j = linecrf.label_lines(d, f).join(lab.where("doc_id % 3 = 0"), "doc_id").select("quality", "keep").collect()
    assert np.mean([x.keep for x in j if x.quality == 1]) > 0.95 and np.mean([x.keep for x in j if x.quality == 0]) < 0.2
    got = linecrf.label_lines(odd, f).collect()
    assert len(got) == len(ODD) and {x.doc_id for x in got if x.lines == 0} == {1, 2, 3, 5}
    assert linecrf.label_lines(odd.limit(0), linecrf.train(spark, odd, labels.limit(0))).count() == 0


# 10


def _line_groups(texts):
    """Brute force over the normal lines: all pairs by SimHash and edit similarity, then components."""
    import pyarrow as pa

    from tempograph.llm.textkernel import Lines, Words, simhash, weight_of

    where = collections.defaultdict(list)
    for d, t in texts.items():
        for i, x in enumerate((t or "").split("\n")):
            w = words(x)
            if w:
                where[b" ".join(w).decode()].append((d, i))
    keys = [k for k in where if len(k.split(" ")) >= lines.MIN_WORDS]
    short = {frozenset(v) for k, v in where.items() if len(k.split(" ")) < lines.MIN_WORDS and len(v) > 1}
    w = Words.of(pa.array(keys))
    assert len(Lines(w).doc) == len(keys)
    s = simhash(w.hash, weight_of(w.end - w.start) + 0.05, w.doc, len(keys), 2)
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(s[i + 1 :] ^ s[i]).sum(axis=1) <= lines.RADIUS) + i + 1:
            a, b = keys[i], keys[j]
            most = int((1 - lines.SIMILARITY) * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and lines.edits(a, b, most) <= most:
                parent[root(i)] = root(int(j))
    out = collections.defaultdict(list)
    for i, k in enumerate(keys):
        out[root(i)] += where[k]
    return short | {frozenset(v) for v in out.values() if len(v) > 1}


def test_line_groups_are_those_of_brute_force(spark):
    d = read(spark, "documents").where("doc_id < 250").cache()
    texts = {r.doc_id: r.text.replace("É", "é") for r in d.select("doc_id", "text").collect()}
    low = lambda t: t.translate({c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7})
    want = _line_groups({k: low(v) for k, v in texts.items()})
    for split in ({}, {"hot": 3, "sampled": 1}):
        by = collections.defaultdict(list)
        keep = collections.Counter()
        for r in lines.duplicates(spark, d, **split).collect():
            by[r.group_id].append((r.doc_id, r.line))
            keep[r.group_id] += r.keep
        assert {frozenset(v) for v in by.values()} == want and set(keep.values()) == {1} and len(want) > 10


def test_line_pairs_by_edit_similarity_alone(spark):
    """No SimHash in the brute force; of every other line there is a copy with a word replaced."""
    r, keys = random.Random(5), set()
    for x in read(spark, "documents").where("doc_id < 100").select("text").collect():
        keys |= {b" ".join(words(y)).decode() for y in (x[0] or "").split("\n") if 3 <= len(words(y)) < 150}
    keys = sorted(keys)
    vocabulary = sorted({w for k in keys for w in k.split()})
    for k in keys[::2]:
        w = k.split()
        w[r.randrange(len(w))] = r.choice(vocabulary)
        keys.append(" ".join(w))
    keys = sorted(set(keys), key=len)
    pairs = []
    for j, b in enumerate(keys):
        most = int((1 - lines.SIMILARITY) * len(b) + 1e-9)
        count = collections.Counter(b)
        for i in range(j - 1, -1, -1):
            if len(keys[i]) < len(b) - most:
                break
            if (count - collections.Counter(keys[i])).total() <= most and lines.edits(keys[i], b, most) <= most:
                pairs.append((i, j))
    d = spark.createDataFrame([(i, k, "en", "s", len(k)) for i, k in enumerate(keys)], DOCS)
    group = {x.doc_id: x.group_id for x in lines.duplicates(spark, d).collect()}
    found = [group.get(i, -1) == group.get(j, -2) for i, j in pairs]
    assert len(pairs) > 200 and np.mean(found) >= 0.97


def test_simhash_distance_of_lines_counts_all_bits():
    r = np.random.default_rng(3)
    s, z = r.integers(-(2**63), 2**63, (2, 400))
    s[1::2], z[1::2] = s[::2] ^ (1 << r.integers(0, 63, 200)), z[::2] ^ np.where(r.random(200) < 0.5, -(2**63), 0)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400)))
    bits = [(int(a) % 2**64).bit_count() + (int(b) % 2**64).bit_count() for a, b in zip(s[i] ^ s[j], z[i] ^ z[j], strict=True)]
    near = lines._near({"s": s, "z": z, "n": np.full(400, 9)}, i, j)
    assert (near == (np.array(bits) <= lines.RADIUS)).all() and near[(np.minimum(i, j) % 2 == 0) & (abs(i - j) == 1)].all()


def test_word_replacement_is_never_less_than_the_edit_distance():
    r = random.Random(9)
    some = ["alpha", "be", "gamma", "delta9", "é", "x"]
    sure = 0
    for _ in range(600):
        p = [r.choice(some) + str(r.randrange(20)) for _ in range(r.randrange(1, 25))]
        q = [x for w in p for x in r.choice([[w]] * 6 + [[], [w, "new"], ["other"]])]
        a, b = " ".join(p), " ".join(q)
        most = r.randrange(0, 30)
        if lines._surely(a, b, most):
            sure += 1
            assert lines.edits(a, b, 10**6) <= most
    assert sure > 100 and not lines._surely("a " * 3000 + "b", "b " + "a " * 3000, 1)


def test_drop_lines(spark, odd):
    long = "a line of words that goes on for quite some while and is long enough to differ a little without any harm at all in its many words"
    ending = "unique ending line with words of its own that are many enough to be more than one half of all the words of the text in which they are"
    rows = [(50, f"first here now\n{long}", "en", "s", 1), (51, f"{long}!\n{ending}", "en", "s", 1), (52, long.upper(), "en", "s", 1), (53, f"{long} at\nthe rest", "en", "s", 1), (54, "a b\na c\na B!\nx\ny", "en", "s", 1)]
    rows += [(55, "one text of this id\nshare", "en", "s", 1), (55, "share\nquite another text of this id", "en", "s", 1), (56, "share\nwords that stay here", "en", "s", 1), (56, "share\nwords that stay here", "en", "s", 1)]
    d = odd.unionByName(spark.createDataFrame(rows, DOCS), allowMissingColumns=True)
    out = lines.drop_lines(spark, d)
    by = collections.defaultdict(list)
    for x in out.collect():
        by[x.doc_id].append(x)
    got = {k: v[0] for k, v in by.items()}
    assert got[50].text == f"first here now\n{long}" and got[51].text == ending and got[51].n_chars == len(ending)
    # documents that are mostly in one other go as a whole
    assert 52 not in got and 53 not in got
    # short lines are duplicates if they are equal
    assert got[54].text == "a b\na c\nx\ny"
    # of the two texts of 55 each loses its own lines; equal rows are one occurrence
    assert sorted(x.text for x in by[55] + by[56]) in ([s for s in sorted([a, b, c, c])] for a, b, c in (("one text of this id\nshare", "quite another text of this id", "words that stay here"), ("one text of this id", "share\nquite another text of this id", "words that stay here"), ("one text of this id", "quite another text of this id", "share\nwords that stay here")))
    assert set(got) >= {None, 1, 2, 3, 4, 5, 6, 7} and out.columns == d.columns
    assert lines.duplicates(spark, odd.limit(0)).count() == 0 == lines.drop_lines(spark, odd.limit(0)).count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("abcdé ", max_size=150), st.text("abcdé ", max_size=150), st.integers(0, 60)), min_size=1, max_size=6))
def test_distances_are_those_of_the_table(rows):
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rows = [(a, b, m) for a, b, m in rows if a and b]
    got = lines.distances([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64)) if rows else []
    for (a, b, m), g in zip(rows, got, strict=True):
        want = table(a, b)
        assert g == want if want <= m else g > m
        assert lines.edits(a, b, 999) == want

def test_pairs_out_of_reach_are_given_up(monkeypatch):
    """Texts that lack each other's words need no runs of equal words, lower bounds hold, and distances are exact up to most also where pairs are left out on the way."""
    monkeypatch.setattr(lines, "SequenceMatcher", None)
    assert not lines._surely("one two three four five six seven", "one too tree for fife sex heaven", 4)
    rng = random.Random(8)
    a = ["".join(rng.choice("abcd é漢") for _ in range(rng.randrange(300))) for _ in range(60)]
    b = [x if k % 3 == 0 else "".join(c for c in x if rng.random() > 0.05 * (k % 7)) + "abcd" * (k % 4) for k, x in enumerate(a)]
    most = np.array([max(len(x), len(y)) // 5 for x, y in zip(a, b, strict=True)])
    true = [lines.edits(x, y, 10**6) for x, y in zip(a, b, strict=True)]
    got = lines.distances(a, b, most)
    assert 0 < sum(d > m for d, m in zip(true, most, strict=True)) < 60
    assert all(g == d if d <= m else g > m for g, d, m in zip(got, true, most, strict=True))
    assert all(n <= d for n, d in zip(lines.lacking(a, b), true, strict=True)) and lines.lacking(["aab"], ["bcd"])[0] == 2


def test_distances_are_given_up_within_the_band():
    """Rows out of reach aren't computed; distances up to most are exact all the same."""
    rng = random.Random(4)
    for n in (70, 300, 900):
        a = "".join(rng.choice("abcdefgh ") for _ in range(n))
        for share in (0, 0.02, 0.1, 0.25, 1):
            b = "".join(x if rng.random() >= share else rng.choice(["", "z", "ab", "c"]) for x in a) or "z"
            true = lines.edits(a, b, 10**6)
            assert lines.distances([a], [b], np.array([true]))[0] == true
            for most in (true - 1, true, true + 1, true + 30, np.int64(n // 5)):
                got = lines.edits(a, b, most)
                assert got == true if true <= most else got > most


def test_only_texts_of_candidate_pairs_are_read(spark, monkeypatch):
    """Lines that share a triple but are far apart by SimHash are looked up no more."""
    asked, own = [], lines.line_texts
    monkeypatch.setattr(lines, "line_texts", lambda docs, wanted: (asked.extend(r.h for r in wanted.collect()), own(docs, wanted))[1])
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    far = [f"{' '.join(word() for _ in range(20))} common words here" for _ in range(40)]
    near = " ".join(word() for _ in range(20))
    d = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in enumerate([*far, near, f"{near} more"])], DOCS)
    assert {(r.doc_id, r.keep) for r in lines.duplicates(spark, d).collect()} == {(40, True), (41, False)}
    assert len(set(asked)) == 2


def test_keys_of_several_lines_and_distinct_lines_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    pairs = np.stack([rng.integers(0, 300, 900), rng.integers(-40, 40, 900)], axis=1)
    blobs = pa.array([pairs[k : k + 100].tobytes() for k in range(0, 900, 100)], pa.binary())
    by = collections.defaultdict(set)
    for k, h in pairs.tolist():
        by[k].add(h)
    got = [x for b in lines._shared(iter([pa.record_batch([blobs[:4]], ["keys"]), pa.record_batch([blobs[4:]], ["keys"])])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted((k, h) for k, v in by.items() if len(v) > 1 for h in v) and not list(lines._shared(iter([])))
    # rows of a line are cut by batches; a hash of two lines is left out
    rows = [(h, 5 + (h == 2 and k == 4), *map(int, rng.integers(0, 9, 2)), h, h, 7) for h in range(-5, 6) for k in range(1 + 3 * (h % 3))]
    want = {h: ([x[2:4] for x in rows if x[0] == h]) for h in range(-5, 6) if h != 2}
    for cut in (1, 2, 5, 100):
        parts = [pa.record_batch([pa.array(c) for c in zip(*rows[k : k + cut], strict=True)], lines._LINE.names) for k in range(0, len(rows), cut)]
        out = [r for b in lines._distinct(iter(parts)) for r in b.to_pylist()]
        assert [(r["h"], (r["doc_id"], r["line"]), (r["to_doc"], r["to_line"])) for r in out] == [(h, min(v), max(v)) for h, v in want.items()]


def test_components(spark):
    r = random.Random(11)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (5, 5)]
    both = [{x.id: x.root for x in components(spark.createDataFrame(edges, "p long, q long"), "p", "q", most).collect()} for most in (0, 500_000)]
    got = both[0]
    assert both[0] == both[1]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: root(x) for x in list(parent)}
