"""Graph tables from files, and from the star-schema tables of the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tempograph.plans.schema import SCHEMAS

Tables = dict[str, DataFrame]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the application's part of the shared folder (spark.checkpoint.dir), read again: lineage is cut.

    Where no folder is set, a temporary one in local mode, as in tests; on a cluster that is an error.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, once its results are stored elsewhere."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def empty(spark: SparkSession) -> Tables:
    return {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> Tables:
    """Tables stored under path, one folder each, with their fixed schemas; absent ones are empty."""
    out = empty(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, s in SCHEMAS.items():
        if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{k}")):
            out[k] = spark.read.schema(s).format(fmt).load(f"{path}/{k}")
    return out


def store(tables: Tables, path: str, fmt: str = "parquet") -> None:
    """Each table under its own folder, which must not be one that the tables are read from."""
    for k, t in tables.items():
        t.write.format(fmt).mode("overwrite").save(f"{path}/{k}")


def _id(prefix: str, column: str, width: int = 9) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def _null(kind: str) -> F.Column:
    return F.lit(None).cast(kind)


_EPOCH = "timestamp_ntz'2020-01-01 00:00:00'"


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, suppliers and parts as entities."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(_id("c", "c_custkey").alias("uuid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("group_id"), F.lit("Customer").alias("l"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("summary"), F.col("c_custkey").alias("_seq"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(_id("s", "s_suppkey").alias("uuid"), F.col("s_name").alias("name"), F.lit("SUPPLY").alias("group_id"), F.lit("Supplier").alias("l"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("summary"), (F.col("s_suppkey") + 1_000_000_000).alias("_seq"))
    p = spark.read.parquet(f"{sf}/part.parquet").select(_id("p", "p_partkey").alias("uuid"), F.col("p_name").alias("name"), F.col("p_type").alias("group_id"), F.lit("Part").alias("l"), F.concat_ws(" ", "p_brand", "p_type").alias("summary"), (F.col("p_partkey") + 2_000_000_000).alias("_seq"))
    u = c.unionByName(s).unionByName(p)
    return u.select("uuid", "name", "group_id", F.array(F.lit("Entity"), F.col("l")).alias("labels"), F.expr(_EPOCH).alias("created_at"), _null("array<float>").alias("name_embedding"), "summary", F.lit("{}").alias("attributes"), F.col("_seq").cast("long").alias("_seq"))


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle that is to be spread however few bytes it has, since its rows are much work."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of a table's files for each of its partitions in a shuffle, where that is more of them than the session has.
PART_BYTES = 8 << 20


def spread(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as keep each to about PART_BYTES of the table's files, where the session has fewer for a shuffle."""
    n = -(-min(int(table._jdf.queryExecution().analyzed().stats().sizeInBytes()), 1 << 43) // PART_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else df


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as facts: a customer ordered a part, valid from the order, until it is shipped if that came later.

    Lines are shuffled twice, as numbers: to their orders, which have met their customers before, and by target to their
    parts.  The rows stay partitioned by target_node_uuid, so that what is grouped by target, or by both ends, needs no
    further shuffle of facts.
    """
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    x = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("__part"), _id("p", "p_partkey").alias("__target"), "p_name")
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = spread(x, lines, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    # keys of more than 9 digits may share a target, so the numbers are compared too, but not as a key: rows stay where their target is
    j = spread(j.withColumn("target_node_uuid", _id("p", "l_partkey")), lines, "target_node_uuid").join(p, (F.col("target_node_uuid") == F.col("__target")) & (F.col("l_partkey") - F.col("__part") == 0))
    return j.select(
        F.concat(_id("f", "l_orderkey"), _id("-", "l_linenumber", 2), _id("-", "l_partkey"), _id("-", "l_suppkey")).alias("uuid"), F.col("c_mktsegment").alias("group_id"), _id("c", "o_custkey").alias("source_node_uuid"), "target_node_uuid", F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("ORDERED_"), F.col("l_returnflag")).alias("name"), F.concat_ws(" ", "c_name", F.lit("ordered"), F.col("l_quantity").cast("int").cast("string"), "p_name").alias("fact"), _null("array<float>").alias("fact_embedding"),
        F.array(_id("o", "l_orderkey")).alias("episodes"), _null("timestamp_ntz").alias("expired_at"), F.col("o_orderdate").alias("valid_at"), F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate")).alias("invalid_at"),
        F.col("o_orderdate").alias("reference_time"), F.lit("{}").alias("attributes"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("_seq"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as episodes."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        _id("v", "event_id").alias("uuid"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("name"), F.col("event_type").alias("group_id"), F.array(F.lit("Episodic")).alias("labels"), F.col("ts").alias("created_at"), F.lit("json").alias("source"), F.lit("events").alias("source_description"),
        F.col("props").alias("content"), F.col("ts").alias("valid_at"), F.array().cast("array<string>").alias("entity_edges"), _null("string").alias("episode_metadata"), F.col("event_id").cast("long").alias("_seq"),
    )


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(_id("m", "event_id").alias("uuid"), F.col("event_type").alias("group_id"), _id("v", "event_id").alias("source_node_uuid"), _id("c", "user_id").alias("target_node_uuid"), F.col("ts").alias("created_at"), F.col("event_id").cast("long").alias("_seq"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as episodes, a minute apart."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)")
    return d.select(
        _id("d", "doc_id").alias("uuid"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("group_id"), F.array(F.lit("Episodic")).alias("labels"), at.alias("created_at"), F.lit("text").alias("source"), F.col("lang").alias("source_description"),
        F.col("text").alias("content"), at.alias("valid_at"), F.array().cast("array<string>").alias("entity_edges"), _null("string").alias("episode_metadata"), F.col("doc_id").cast("long").alias("_seq"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as episodes."""
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(turn as int), 0)")
    return t.select(
        F.concat(_id("t", "conv_id"), _id("-", "turn", 4)).alias("uuid"), F.concat_ws(" ", F.lit("turn"), F.col("turn").cast("string")).alias("name"), F.lit("talk").alias("group_id"), F.array(F.lit("Episodic")).alias("labels"), at.alias("created_at"), F.lit("message").alias("source"), F.col("role").alias("source_description"),
        F.col("text").alias("content"), at.alias("valid_at"), F.array().cast("array<string>").alias("entity_edges"), _null("string").alias("episode_metadata"), (F.col("conv_id") * 10_000 + F.col("turn")).cast("long").alias("_seq"),
    )


def sagas(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).select(F.substring("uuid", 2, 9).alias("k"), "uuid")
    g = t.groupBy("k").agg(F.min("uuid").alias("f"), F.max("uuid").alias("l"))
    return g.select(F.concat(F.lit("g"), F.col("k")).alias("uuid"), F.concat(F.lit("conversation "), F.col("k").cast("long").cast("string")).alias("name"), F.lit("talk").alias("group_id"), F.array(F.lit("Saga")).alias("labels"), F.expr(_EPOCH).alias("created_at"), F.lit("").alias("summary"), F.col("f").alias("first_episode_uuid"), F.col("l").alias("last_episode_uuid"), _null("timestamp_ntz").alias("last_summarized_at"), _null("timestamp_ntz").alias("last_summarized_episode_valid_at"), F.col("k").cast("long").alias("_seq"))


def has_episode(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    return t.select(F.concat(F.lit("h"), F.col("uuid")).alias("uuid"), "group_id", F.concat(F.lit("g"), F.substring("uuid", 2, 9)).alias("source_node_uuid"), F.col("uuid").alias("target_node_uuid"), "created_at", "_seq")


def next_episode(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy(F.substring("uuid", 2, 9)).orderBy("uuid")
    t = turns(spark, sf).select("group_id", F.col("uuid").alias("source_node_uuid"), F.lead("uuid").over(w).alias("target_node_uuid"), "created_at", "_seq").where("target_node_uuid is not null")
    return t.select(F.concat(F.lit("n"), F.col("source_node_uuid")).alias("uuid"), "group_id", "source_node_uuid", "target_node_uuid", "created_at", "_seq")


def communities(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(_id("n", "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.col("r_name").alias("group_id"), F.array(F.lit("Community")).alias("labels"), F.expr(_EPOCH).alias("created_at"), _null("array<float>").alias("name_embedding"), F.concat_ws(" ", F.lit("customers of"), "n_name").alias("summary"), F.col("n_nationkey").cast("long").alias("_seq"))


def has_member(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(_id("b", "c_custkey").alias("uuid"), F.lit("members").alias("group_id"), _id("n", "c_nationkey").alias("source_node_uuid"), _id("c", "c_custkey").alias("target_node_uuid"), F.expr(_EPOCH).alias("created_at"), F.col("c_custkey").cast("long").alias("_seq"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as entities with a name vector."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return v.select(_id("e", "vec_id").alias("uuid"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("name"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("group_id"), F.array(F.lit("Entity")).alias("labels"), F.expr(_EPOCH).alias("created_at"), F.col("embedding").alias("name_embedding"), F.lit("").alias("summary"), F.lit("{}").alias("attributes"), F.col("vec_id").cast("long").alias("_seq"))


def graph(spark: SparkSession, sf: str) -> Tables:
    """The whole graph: events and turns are its episodes."""
    return {
        "entity": entities(spark, sf), "episodic": events(spark, sf).unionByName(turns(spark, sf)), "community": communities(spark, sf), "saga": sagas(spark, sf), "entity_edge": facts(spark, sf),
        "mentions": mentions(spark, sf), "has_member": has_member(spark, sf), "has_episode": has_episode(spark, sf), "next_episode": next_episode(spark, sf),
    }
