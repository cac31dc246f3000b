"""Stream ids, their tags, and tag predicates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.model import DEFAULT_STREAM, tag_column


def tag_key(name: str, value: str) -> str:
    return f"{name}={value}"


def stream_id(stream_fields: tuple[str, ...], entry: Mapping[str, str]) -> str:
    return ",".join(sorted(tag_key(f, entry[f]) for f in stream_fields if entry.get(f))) or DEFAULT_STREAM


def stream_id_column(values: Mapping[str, Column]) -> Column:
    """As ``stream_id``, from a column for each stream field."""
    parts = [F.concat(F.lit(f"{f}="), F.nullif(c, F.lit(""))) for f, c in values.items()]
    joined = F.concat_ws(",", F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull())))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(DEFAULT_STREAM))


def parse_stream_tags(stream: str) -> dict[str, str]:
    """Tags read back from an id: split at commas, then at the first ``=``; the last of equal names wins."""
    if stream == DEFAULT_STREAM:
        return {}
    pairs = (segment.split("=", 1) for segment in stream.split(",") if "=" in segment)
    return {k: v for k, v in pairs if k}


def parse_stream_tags_column(stream: Column) -> Column:
    """As ``parse_stream_tags``; independent of the session's policy on equal names."""
    pairs = F.filter(F.split(stream, ","), lambda s: F.contains(s, F.lit("=")) & ~F.startswith(s, F.lit("=")))
    named = F.transform(pairs, lambda s: F.struct(F.substring_index(s, "=", 1).alias("k"), F.substring(s, F.locate("=", s) + 1, F.length(s)).alias("v")))
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"]))
    return F.when(stream == DEFAULT_STREAM, F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(last))


def stream_eq(tags: Mapping[str, str], stream_fields: tuple[str, ...]) -> Column:
    """All tags equal; a tag that is no stream field matches nothing. Empty values ask for nothing."""
    asked = {k: v for k, v in tags.items() if v}
    if any(k not in stream_fields for k in asked):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [F.col(tag_column(k)) == v for k, v in asked.items()], F.lit(True))


def tags_array(stream_fields: tuple[str, ...]) -> Column:
    """The ``field=value`` tags of a row."""
    parts = [F.concat(F.lit(f"{f}="), F.col(tag_column(f))) for f in stream_fields]
    return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")
