"""Options, query and delete specifications, and the schema of log rows."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import timedelta

from pyspark.sql import types as T

MISSING_MSG, DEFAULT_STREAM = "missing _msg", "_default"
RESERVED = ("_time", "_stream")
DAY_NS = 86_400 * 10**9
HTTP_LIMIT = 100


@dataclass(frozen=True)
class Options:
    """Table options. Intervals and counts of zero or less take their defaults where the comment says so."""

    stream_fields: tuple[str, ...] = ("service", "host")
    max_rows_per_block: int = 1024  # <= 0: default
    flush_interval: timedelta = timedelta(seconds=5)  # 0: default, below 1 s: 1 s, negative: off
    enable_wal: bool = False
    merge_min_parts: int = 4  # <= 0: default, never below 2
    merge_max_parts: int = 8  # <= 0: default
    merge_interval: timedelta = timedelta(seconds=10)  # 0: default, negative: off
    merge_disable: bool = False  # stops the worker only
    retention: timedelta = timedelta(0)  # 0: off
    retention_interval: timedelta = timedelta(hours=1)
    skip_index: bool = True

    def resolved(self) -> Options:
        zero, second = timedelta(0), timedelta(seconds=1)
        plain = {f.name: f.default for f in fields(Options)}
        out = {f.name: getattr(self, f.name) for f in fields(Options)}
        out["stream_fields"] = tuple(self.stream_fields) or plain["stream_fields"]
        for name in ("max_rows_per_block", "merge_min_parts", "merge_max_parts"):
            if out[name] <= 0:
                out[name] = plain[name]
        out["merge_min_parts"] = max(2, out["merge_min_parts"])
        for name in ("flush_interval", "merge_interval", "retention_interval"):
            if out[name] == zero:
                out[name] = plain[name]
        if zero < out["flush_interval"] < second:
            out["flush_interval"] = second
        return Options(**out)


@dataclass(frozen=True)
class QuerySpec:
    """start and end (UTC nanoseconds, None: unbounded) are both inclusive; all set conditions must hold."""

    start_ns: int | None = None
    end_ns: int | None = None
    stream_eq: dict[str, str] = field(default_factory=dict)
    contains: str = ""
    limit: int = 0

    @property
    def tags(self) -> dict[str, str]:
        """The tags asked for; an empty value asks for nothing."""
        return {k: v for k, v in self.stream_eq.items() if v}


@dataclass(frozen=True)
class DeleteSpec:
    start_ns: int | None = None
    end_ns: int | None = None
    stream_eq: dict[str, str] = field(default_factory=dict)
    contains: str = ""

    def check(self) -> None:
        if self.start_ns is None and self.end_ns is None and not any(self.stream_eq.values()) and not self.contains:
            raise ValueError("a delete needs a start, an end, a stream tag or a substring")


@dataclass
class QueryStats:
    mem_blocks_scanned: int = 0
    parts_scanned: int = 0
    parts_pruned_indexdb: int = 0
    blocks_seen: int = 0
    blocks_skipped_bloom: int = 0
    blocks_scanned: int = 0
    rows_scanned: int = 0
    rows_suppressed_delete: int = 0
    rows_returned: int = 0


def tag_column(name: str) -> str:
    """The column that holds a stream field."""
    return f"tag_{name}"


def row_schema(stream_fields: tuple[str, ...], stored: bool = False) -> T.StructType:
    """Columns of log rows; stored ones have their day and part too."""
    columns = [
        T.StructField("_time_ns", T.LongType()),
        T.StructField("_time", T.TimestampType()),
        T.StructField("_stream", T.StringType()),
        T.StructField("_msg", T.StringType()),
        *(T.StructField(tag_column(f), T.StringType()) for f in stream_fields),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
    if stored:
        columns += [T.StructField("day", T.StringType()), T.StructField("part_id", T.LongType())]
    return T.StructType(columns)
