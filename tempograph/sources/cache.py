"""A response cache as a table: keys are hashes of canonical JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.functions.text import canonical_hash

KEY = ["model", "small_model", "temperature", "max_tokens", "schema", "messages"]


def keyed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("key", canonical_hash(*[F.col(c) for c in KEY]))


def answer(requests: DataFrame, cache: DataFrame, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(requests with responses, new cache): each distinct unanswered key is called once (key, ...) -> (key, response)."""
    r = keyed(requests)
    missing = r.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = call(missing).select("key", "response")
    full = cache.select("key", "response").unionByName(new)
    return r.join(full, "key", "left"), full
