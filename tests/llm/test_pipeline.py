import collections
import re

import numpy as np
import pyarrow as pa
import pytest

cp = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from tempograph.llm import lines, mixing, neardup, packing, quality  # noqa: E402
from tests.llm.test_operators import _brute_links, _line_groups, _roots  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The smallest documents and labels, with nulls, empties, repeats, a long text and a clashing column added."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("length(text) > 200").orderBy("doc_id").first()
    odd = [(None, "a null id with some words of its own", "en", "s", 36), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "\n\n", "en", "s", 2), (first.doc_id, first.text, first.lang, first.source, first.n_chars), (10**6 + 3, "wording " * 20000, "en", "s", 160000), (10**6 + 4, first.text + " more", "en", "s", 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("__key", F.lit("x")).withColumn("count", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_run_is_that_of_brute_force(spark, small):
    """Each stage by hand over all rows or pairs; models as trained."""
    import duckdb

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    # quality: all pairs of features, instead of the identity of sums
    m = quality.fit(spark, docs, labels)
    kept = []
    for r in rows:
        batch = pa.RecordBatch.from_pylist([{"text": r["text"], "lang": r["lang"], "source": r["source"]}], schema=pa.schema([("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]))
        _, f, x, stats = quality.example(batch)
        _, f, x = quality.with_stats(np.zeros(len(f), int), f, x, stats, m.mean, m.scale)
        v = m.v[f] * x[:, None]
        p = v @ v.T
        z = m.w0 + m.w[f] @ x + np.triu(p, 1).sum()
        if re.search("[A-Za-z0-9_\x80-\U0010ffff]", r["text"] or "") and 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= m.cut:
            kept.append(r)
    assert 0 < len(kept) < len(rows)
    # lines: all pairs of lines; rows of an id with one text are one document
    low = lambda t: t.translate({c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7})
    texts = {r["doc_id"]: low(r["text"]) for r in kept if r["doc_id"] is not None}
    gone, source = collections.defaultdict(set), collections.defaultdict(collections.Counter)
    normal = lambda t: " ".join(re.findall("[A-Za-z0-9_\x80-\U0010ffff]+", t))
    for group in _line_groups(texts):
        group = sorted(group)
        for d, i in group[1:]:
            gone[d].add(i)
            source[d][group[0][0]] += len(normal(texts[d].split("\n")[i])) + 1
    lined = []
    for r in kept:
        k = r["doc_id"]
        if k in gone:
            text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone[k])
            if not normal(text) or max((n for d, n in source[k].items() if d != k), default=0) >= lines.COPIED * (len(normal(r["text"])) + 1):
                continue
            r = r | {"text": text, "n_chars": len(text)}
        lined.append(r)
    assert 0 < len(lined) < len(kept)
    # near duplicates: all pairs of fingerprints
    d = spark.createDataFrame([(r["doc_id"], r["text"]) for r in lined], "doc_id long, text string")
    edges, by = [], collections.defaultdict(list)
    for x in neardup.fingerprints(d).distinct().collect():
        by[tuple(x)[1:]].append(x.doc_id)
    Print = collections.namedtuple("Print", "id f0 f1 f2 f3")
    prints = [Print(min(v), *k) for k, v in by.items()]
    edges = [*_brute_links(prints), *((min(v), x) for v in by.values() for x in v if x != min(v))]
    root = _roots(edges)
    unique, seen = [], set()
    for r in lined:
        if r["doc_id"] is None or root.get(r["doc_id"], r["doc_id"]) == r["doc_id"] and r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            unique.append(r)
    assert 0 < len(unique) < len(lined)
    # mixing: rates by the optimality conditions, copies by hand
    model = mixing.train(spark, docs, labels)
    d = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in unique], docs.schema)
    members = mixing.posteriors(d, model)
    step = mixing.fit_rates(members, mixing.TARGETS)
    mixed = []
    got = members.collect()
    rates = [np.maximum(1 + np.array(x.p) @ -step[0], 0) for x in got]
    for x, rate in zip(got, rates, strict=True):
        mixed += [x.doc_id] * int(mixing.copies(np.array([rate]), pa.array([x.doc_id], pa.int64()))[0])
    n = np.array([x.n_tokens for x in got], dtype=float)
    share = np.array(rates) * n @ np.array([x.p for x in got]) / n.sum()
    assert np.abs(share - [mixing.TARGETS[k] for k in mixing.DOMAINS]).max() < 0.05
    # packing: SQL
    import pandas as pd

    text = {r["doc_id"]: r["text"] for r in unique}
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": pd.array(mixed, "Int64"), "text": [text[k] for k in mixed]}))
    want = c.execute(packing.pack_sql()).df()
    out = cp.run(spark, small).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(str, df.astype("Int64").values.tolist()))
    assert key(out) == key(want) and len(out) > 100


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, small)
        again = stage(spark, docs.limit(0), small)
        assert again.columns == out.columns and again.count() == 0
        if k == len(cp.STAGES) - 1:
            packed = out.toPandas()
            assert packed.groupby(["class", "shard", "bin"]).piece_tokens.sum().max() <= 2048 and len(packed) == len(docs.collect()) + (packed.piece > 0).sum()
        else:
            assert out.columns == docs.columns


def test_near_copies_go(spark):
    """Of each near-duplicate group of the documents, one is left after the lines and near-duplicates stages, but for a few."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    group = {r.doc_id: r.group_id for r in neardup.groups(spark, docs).collect()}
    out = cp.near_duplicate_stage(spark, cp.line_stage(spark, docs, sf), sf)
    left = collections.Counter(group[r.doc_id] for r in out.select("doc_id").collect() if r.doc_id in group)
    copies = len(group) - len(set(group.values()))
    assert sum(n - 1 for n in left.values()) <= 0.05 * copies and copies > 100
    # documents that are no copies stay, but for those whose text is all in others
    assert out.count() >= docs.count() - copies - 0.02 * docs.count()


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
