"""Session helpers: written tables in the shared folder, size-checked joins, pair enumeration, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast; more go through a shuffled join.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The application's part of the cluster's shared folder (spark.checkpoint.dir).

    Where none is set, a temporary one in local mode, as in tests; on a cluster that is an error, since a
    folder of one machine would lose tables with it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder; for when its results are stored."""
    delete(spark, shared_dir(spark))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows where the session has the default: whole texts make batches of 10,000 rows large in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "2000")


def written_at(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, executors may go."""
    return written_at(df, name)[0]


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def sized(rows: DataFrame, row_bytes: int = 16) -> DataFrame:
    """rows with a broadcast hint if as many as are counted, of ``row_bytes`` each, are few bytes; without one, the join is shuffled."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows.hint("merge")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", theirs: str = "doc_id") -> DataFrame:
    """docs without the ids of dropped; rows whose id is null stay."""
    name = fresh(docs, "__gone")
    return docs.join(sized(dropped.select(F.col(theirs).alias(name))), F.col(key) == F.col(name), "left_anti")


def row_ids(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str, DataFrame | None]:
    """(docs with a long id of each document, its column's name, the ids of several rows or None).

    The id is doc_id; where rows share a doc_id, it is a hash of doc_id and text, so that equal rows are one document and
    others are told apart.  Null ids stay null.
    """
    key, name = fresh(docs, "__key"), fresh(docs, "__again")
    own = F.col("doc_id").cast("long")
    again = written(docs.where("doc_id is not null").groupBy(own.alias(name)).count().where("count > 1").select(name), "again")
    if not again.head(1):
        return docs.withColumn(key, own), key, None
    flag = fresh(docs, "__several")
    joined = docs.join(sized(again.withColumn(flag, F.lit(True))), own == F.col(name), "left")
    return joined.withColumn(key, F.when(F.col(flag), F.xxhash64(own, "text")).otherwise(own)).drop(flag, name), key, again


def id_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits over mixed values of a long column: its size doesn't depend on the rows.

    It only prunes (it has false positives, never false negatives); a later exact step decides.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tempograph.llm.textkernel import mix

        own = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            x = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
            own[(mix(x, 77) >> np.uint64(64 - bits)).astype(np.int64)] = True
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["b"])

    # one bitmap a task, and at most 16 tasks, reach the driver
    rows = df.select(F.col(column).cast("long").alias("x")).coalesce(16).mapInArrow(fold, "b binary")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        out |= np.frombuffer(bytes(r[0]), dtype=np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    from tempograph.llm.textkernel import mix

    at = (mix(values.astype(np.uint64), 77) >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def pairs_in_runs(first: np.ndarray, last: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j): i in order, j from first[i] to last[i], in arrays of about ``most`` pairs (a row's own are cut up)."""
    counts = np.maximum(last - first, 0)
    at = np.flatnonzero(counts)
    if not len(at):
        return
    total = np.concatenate([[0], np.cumsum(counts[at])])
    done = 0
    while done < total[-1]:
        to = min(done + most, total[-1])
        flat = np.arange(done, to)
        row = np.searchsorted(total, flat, side="right") - 1
        yield at[row], first[at[row]] + (flat - total[row])
        done = to


#: Rows of a cell, by estimate, above which it is split; sample that the estimate is from, one id in so many.
HOT, SAMPLED = 1_000_000, 64
#: Rows of small cells that are compared together.
_TOGETHER = 1 << 17


def classes(homes: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """First classes of a candidate search by cells: (links, classes (id, root)).

    homes (key, id) has each id's own cells.  Each is compared with the least id of each of its cells; ``verify``
    keeps the true ones of pairs (a, b), and their components are classes.  A cell costs as many pairs as rows,
    however hot it is, and its least id is pre-aggregated.
    """
    pivots = homes.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    pairs = homes.join(pivots, "key").where("a < id").select("a", F.col("id").alias("b")).distinct()
    links = written(verify(pairs), "links")
    return links, components(links, "a", "b")


def cell_pairs(rows: DataFrame, emit: Callable | None, extra: dict[str, str], near: Callable | None = None, probes_meet: bool = False, hot: int = HOT, sampled: int = SAMPLED) -> DataFrame:
    """(a, b), a < b: all pairs of ids that share a cell, are of different classes and are ``near``; probes meet homes only, unless ``probes_meet``.

    ``emit`` is a mapInArrow function from rows (id, cls, ...) to cells (key, probe, id, cls, ``extra``), None if rows are cells; near(x, i, j) tests
    rows i against j by the arrays x of extra.  In a cell the largest class is compared with the others but not with itself, so a hot group whose
    members are one class already costs as many pairs as it has rows, not their square.  Cells are
    streamed in the order of their keys; a cell of more than ``hot`` rows is split: its largest class over several tasks,
    to each of which all its other rows go.  Which cells are hot is estimated from one id in ``sampled``; the
    result doesn't depend on it.
    """
    spark = rows.sparkSession
    fields = ["key", "probe", "id", "cls", *extra]
    made = lambda r: r.select(*fields) if emit is None else r.mapInArrow(emit, "key long, probe boolean, id long, cls long" + "".join(f", {k} {v}" for k, v in extra.items()))
    cells = made(rows).withColumn("part", F.lit(0))
    part = made(rows.where(F.pmod(F.xxhash64("id"), F.lit(sampled)) == 0)).groupBy("key", "cls").agg(F.count("*").alias("n"))
    part = part.groupBy("key").agg((F.sum("n") * sampled).alias("n"), F.max_by("cls", F.struct("n", "cls")).alias("most")).where(F.col("n") > hot)
    large = written(part.select("key", "most", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "hot")
    if large.head(1):
        one = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        where = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("cls") == F.col("most"), one).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        cells = cells.join(sized(large, 24), "key", "left").withColumn("part", F.explode(where)).select(*fields, "part")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, probe, ids, cls = (numbers(t, c) for c in ("key", "part", "probe", "id", "cls"))
        cell = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        order = np.lexsort((cls, cell))
        c, k = cls[order], cell[order]
        new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])]))
        size = np.diff(np.append(new, len(c)))
        # the longest run of each cell comes last in it
        by = np.lexsort((-new, size, k[new]))
        last = np.concatenate([k[new][by][1:] != k[new][by][:-1], [True]])
        longest = np.zeros(len(new), bool)
        longest[by[last]] = True
        longest = np.repeat(longest, size)
        put = np.lexsort((np.repeat(new, size), longest, k))
        order, k, longest = order[put], k[put], longest[put]
        c, probe, ids = cls[order], probe[order], ids[order]
        x = {k: numbers(t, k)[order] for k in extra}
        begin = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
        after = np.append(np.flatnonzero(begin)[1:], len(c))[np.cumsum(begin) - 1]
        for i, j in pairs_in_runs(after, np.where(longest, 0, np.searchsorted(k, k, side="right"))):
            ok = ids[i] != ids[j]
            if not probes_meet:
                ok &= ~(probe[i] & probe[j])
            if near is not None:
                ok[ok] = near(x, i[ok], j[ok])
            i, j = ids[i[ok]], ids[j[ok]]
            if len(i):
                both = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if sum(x.num_rows for x in kept) >= _TOGETHER:
                key, part = b.column("key").to_numpy(), b.column("part").to_numpy()
                same = (kept[-1].column("key")[-1].as_py(), kept[-1].column("part")[-1].as_py()) == (key[0], part[0])
                # whole cells only: up to the first row of another cell
                cut = int(np.argmax(np.append((key != key[0]) | (part != part[0]), True))) if same else 0
                if cut < b.num_rows:
                    yield from compare(pa.Table.from_batches([*kept, b.slice(0, cut)]).combine_chunks())
                    kept, b = [], b.slice(cut)
            kept.append(b)
        if kept:
            yield from compare(pa.Table.from_batches(kept).combine_chunks())

    parts = cells.repartition(tasks(spark), "key", "part").sortWithinPartitions("key", "part")
    return parts.mapInArrow(meet, "a long, b long").distinct()


def table_of(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's edges as stars about the least member: fewer edges, the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = root(u), root(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    edges = [(x, root(x)) for x in list(parent)]
    edges = [(x, r) for x, r in edges if x != r]
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])


#: Edges, after each task has reduced its own, that one task may connect.
ONE_TASK = 500_000


def components(edges: DataFrame, a: str, b: str, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of undirected edges of longs: (id, root), root the least id; only ids with an edge.

    Alternating large-star and small-star steps on written tables, after each task has reduced its
    own edges to stars; a logarithmic number of rounds.  As soon as no more than ``one_task`` edges are left, one
    task connects the rest.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    spark = edges.sparkSession
    e, path = written_at(e.mapInArrow(_forest, "u long, v long"), "edges")
    before = None
    while True:
        if e.limit(one_task + 1).count() <= one_task:
            e, old = written(e.repartition(1).mapInArrow(_forest, "u long, v long"), "edges"), path
            delete(spark, old)
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
        print_ = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_ == before or print_[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
        before = print_
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # aggregates joined back, not windows: the star of a hot id isn't one task's
        large = both.join(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = least.select("u", F.col("m").alias("v")).unionByName(least.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        (e, new), old = written_at(small, "edges"), path
        delete(spark, old)
        path = new


def sample_labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, label_cols: list[str], most: int) -> DataFrame:
    """Labelled documents (doc_id, text, lang, source, __id, __label...): at most ``most`` of them, those whose id hashes least; no null labels, one row an id, none without a document."""
    lab = labels.where(" and ".join(f"`{c}` is not null" for c in ["doc_id", *label_cols]))
    lab = lab.groupBy("doc_id").agg(*[F.min(c).alias(f"__{c}") for c in label_cols]).withColumnRenamed("doc_id", "__id")
    docs = docs.select("doc_id", "text", "lang", "source")
    lab = lab.join(docs.select("doc_id"), F.col("doc_id") == F.col("__id"), "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(most)
    return docs.join(F.broadcast(lab), F.col("doc_id") == F.col("__id"))
