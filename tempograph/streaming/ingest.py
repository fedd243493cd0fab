"""Incremental ingest: a stream of rows upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tempograph.operators.writes import save_edges, save_nodes
from tempograph.plans.schema import NODES, SCHEMAS
from tempograph.sources.tables import load


def episode_stream(spark: SparkSession, path: str, kind: str = "episodic", fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMAS[kind]).format(fmt).option("maxFilesPerTrigger", files).load(path)


def upsert_batches(stream: DataFrame, path: str, kind: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch is merged into path/kind as a new version; path/kind-current names it, so readers see whole versions and a repeated batch changes nothing."""
    write = _merge(path, kind)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _merge(path: str, kind: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = load(spark, path)
        if (at := current(spark, path, kind)) is not None:
            tables[kind] = spark.read.schema(SCHEMAS[kind]).parquet(at)
        tables = (save_nodes if kind in NODES else save_edges)(tables, kind, batch)
        tables[kind].write.mode("overwrite").parquet(f"{path}/{kind}-v{number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/{kind}-current")

    return write


def current(spark: SparkSession, path: str, kind: str) -> str | None:
    """Where the latest version is; None before the first batch."""
    try:
        v = spark.read.parquet(f"{path}/{kind}-current").agg({"version": "max"}).first()[0]
    except Exception as e:  # no version yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return f"{path}/{kind}-v{v}"
