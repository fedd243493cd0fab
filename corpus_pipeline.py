"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tempograph.llm import lines, mixing, neardup, packing, quality
from tempograph.llm.common import delete, shared_dir, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go; all columns stay (quality.keep_rows).

    Null, empty and wordless texts are rejected; null ids and repeated rows are judged each by its text; no rows give no rows.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_rows(docs, quality.fit(spark, docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of each group of near-equal lines one occurrence stays; documents that have lines.COPIED or more of their words in one other go (lines.drop_lines).

    Null and empty texts, and rows with null ids, stay as they are; equal rows of an id lose the same lines; no rows give no rows.
    """
    small_batches(spark)
    return lines.drop_lines(spark, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, that of the least doc_id (neardup.deduplicate).

    Null, empty and wordless texts, and rows with null ids, stay; of equal rows of an id one stays; no rows give no rows.
    """
    small_batches(spark)
    return neardup.deduplicate(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document is repeated as often as its fitted rate says; at rate 0 it goes (mixing.resample).

    The classifier is fitted on the labelled documents of the whole input, of which the stages before have taken most that are
    labelled low; the rates are fitted to this stage's own.  Null and empty texts count a token; null ids round at one half; no rows give no rows.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resample(spark, docs, labels, fit_on=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Harmonic packing: the place of every piece of every document (packing.pack).

    Null and empty texts take a token; a null id is one like others; repeated rows are packed each; no rows give no rows.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained and approximate stages aren't expressible in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}")
        if k:
            delete(spark, f"{at}/{k - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}")
    return docs
