"""Row predicates of queries and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.streams import stream_eq
from stratalog.functions.times import day_of
from stratalog.model import QuerySpec


def time_range(start_ns: int | None, end_ns: int | None) -> list[Column]:
    """Inclusive at both ends; an unbounded side has no predicate."""
    out = []
    if start_ns is not None:
        out.append(F.col("_time_ns") >= F.lit(start_ns))
    if end_ns is not None:
        out.append(F.col("_time_ns") <= F.lit(end_ns))
    return out


def day_range(start_ns: int | None, end_ns: int | None) -> list[Column]:
    """The days of a time range, which Catalyst doesn't derive by itself; prunes partitions."""
    out = []
    if start_ns is not None:
        out.append(F.col("day") >= day_of(start_ns))
    if end_ns is not None:
        out.append(F.col("day") <= day_of(end_ns))
    return out


def filter_rows(rows: DataFrame, spec: QuerySpec, stream_fields: tuple[str, ...], with_day: bool = False) -> DataFrame:
    """Rows in the time range, with the tags, whose message holds the substring (case and bytes as they are)."""
    conditions = day_range(spec.start_ns, spec.end_ns) if with_day else []
    conditions += time_range(spec.start_ns, spec.end_ns)
    if spec.tags:
        conditions.append(stream_eq(spec.tags, stream_fields))
    if spec.contains:
        conditions.append(F.contains(F.col("_msg"), F.lit(spec.contains)))
    for c in conditions:
        rows = rows.where(c)
    return rows


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """Any ``limit`` rows; all for zero or less."""
    return rows.limit(limit) if limit > 0 else rows
