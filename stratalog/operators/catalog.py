"""Aggregates over stored rows: block references, and the tag indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.streams import tags_array


def block_refs(rows: DataFrame, tags: list[str] = ()) -> DataFrame:
    """Time range and rows of each day, part and stream (with the columns of its tags, if asked for)."""
    keys = [c for c in ("day", "part_id", "_stream", *tags) if c in rows.columns]
    return rows.groupBy(*keys).agg(F.min("_time_ns").alias("time_min_ns"), F.max("_time_ns").alias("time_max_ns"), F.count(F.lit(1)).alias("rows"))


def part_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "part_id").agg(F.min("_time_ns").alias("time_min_ns"), F.max("_time_ns").alias("time_max_ns"), F.count(F.lit(1)).alias("rows"))


def by_tag(rows: DataFrame, stream_fields: tuple[str, ...], *of: str) -> DataFrame:
    """Distinct (tag, of...): the posting lists of tags, one row an entry. Rows are reduced before they are dealt out."""
    streams = rows.select(*of, tags_array(stream_fields).alias("tags")).distinct()
    return streams.select(F.explode("tags").alias("tag"), *of).distinct()


def posting_lists(entries: DataFrame, of: str) -> DataFrame:
    """(tag, ids): each tag's sorted ids. Tags are of few values by design, and so are the ids of one."""
    return entries.groupBy("tag").agg(F.sort_array(F.collect_set(of)).alias("ids"))
