"""Search filters compiled to Column predicates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.plans.schema import check_labels


@dataclass
class DateTest:
    """Comparison of a timestamp column: =, <>, >, <, >=, <=, IS NULL or IS NOT NULL."""

    operator: str
    date: datetime | None = None


_ORDER: dict[str, Callable[[Column, Column], Column]] = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}


@dataclass
class SearchFilters:
    node_labels: list[str] | None = None
    edge_types: list[str] | None = None
    edge_uuids: list[str] | None = None
    valid_at: list[list[DateTest]] | None = None
    invalid_at: list[list[DateTest]] | None = None
    created_at: list[list[DateTest]] | None = None
    expired_at: list[list[DateTest]] | None = None
    #: Accepted and ignored, as in the studied engine.
    property_filters: list[dict] = field(default_factory=list)


def date_test(column: Column, test: DateTest) -> Column:
    """Equality and inequality are null-safe; an ordering with a null is false."""
    other = F.lit(test.date)
    if test.operator == "IS NULL":
        return column.isNull()
    if test.operator == "IS NOT NULL":
        return column.isNotNull()
    if test.operator == "=":
        return column.eqNullSafe(other)
    if test.operator == "<>":
        return ~column.eqNullSafe(other)
    if test.operator not in _ORDER:
        raise ValueError(f"unknown comparison: {test.operator}")
    return F.coalesce(_ORDER[test.operator](column, other), F.lit(False))


def date_predicate(name: str, tests: list[list[DateTest]] | None) -> Column | None:
    """OR of ANDs; an empty list, outer or inner, is no predicate."""
    if not tests or any(not t for t in tests):
        return None
    return reduce(or_, [reduce(and_, [date_test(F.col(name), t) for t in inner]) for inner in tests])


def has_labels(labels: list[str] | None, column: str = "labels") -> Column | None:
    """All requested labels are there."""
    check_labels(labels)
    return F.size(F.array_except(F.array(*[F.lit(x) for x in labels]), F.col(column))) == 0 if labels else None


def in_groups(groups: list[str] | None) -> Column | None:
    return F.col("group_id").isin(groups) if groups and groups != [""] else None


def _where(df: DataFrame, *predicates: Column | None) -> DataFrame:
    for p in predicates:
        if p is not None:
            df = df.where(p)
    return df


def filter_nodes(nodes: DataFrame, filters: SearchFilters | None = None, groups: list[str] | None = None) -> DataFrame:
    return _where(nodes, in_groups(groups), has_labels(filters.node_labels) if filters else None)


def filter_edges(edges: DataFrame, filters: SearchFilters | None = None, groups: list[str] | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Null lists are no predicate, empty ones match nothing; with node labels both endpoints must exist and have them all."""
    df = _where(edges, in_groups(groups))
    if not filters:
        return df
    for column, wanted in (("name", filters.edge_types), ("uuid", filters.edge_uuids)):
        if wanted is not None:
            df = df.where(F.col(column).isin(wanted) if wanted else F.lit(False))
    df = _where(df, *[date_predicate(n, getattr(filters, n)) for n in ("valid_at", "invalid_at", "created_at", "expired_at")])
    if filters.node_labels:
        if entities is None:
            raise ValueError("endpoint labels need the entity table")
        ok = entities.where(has_labels(filters.node_labels)).select(F.col("uuid").alias("__end"))
        for end in ("target_node_uuid", "source_node_uuid"):  # facts may lie by target already
            df = df.join(ok, F.col(end) == F.col("__end"), "left_semi")
    return df
