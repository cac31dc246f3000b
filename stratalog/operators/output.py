"""Result rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.times import format_ns_column
from stratalog.model import tag_column


def to_ndjson(rows: DataFrame, stream_fields: tuple[str, ...]) -> DataFrame:
    """(value): one JSON object a row, of all its fields, its stream and its time, without absent ones."""
    own = [F.struct(F.lit(f).alias("key"), F.col(tag_column(f)).alias("value")) for f in stream_fields]
    own += [F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in (("_msg", F.col("_msg")), ("_stream", F.col("_stream")), ("_time", format_ns_column(F.col("_time_ns"))))]
    present = F.filter(F.array(*own), lambda p: p["value"].isNotNull())
    return rows.select(F.to_json(F.map_from_entries(F.array_sort(F.concat(F.map_entries("fields"), present)))).alias("value"))
