"""From JSON to normalised log rows, for request bodies and for bulk files."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.streams import stream_id, stream_id_column
from stratalog.functions.times import parse_time, parse_time_column, timestamp_column
from stratalog.model import MISSING_MSG, RESERVED, tag_column

Entry = dict[str, str]
_SPACES = re.compile(r"\s*")


def stringify(value: object) -> str:
    """JSON text of a value; strings as they are."""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def to_entry(item: Mapping[str, object]) -> tuple[int | None, Entry]:
    """(time or None, fields) of a JSON object; nulls are dropped."""
    if not isinstance(item, Mapping):
        raise ValueError("a log record is a JSON object")
    time = None
    if "_time" in item:
        t = item["_time"]
        if isinstance(t, str):
            time = parse_time(t)
        elif isinstance(t, bool) or not isinstance(t, (int, float)):
            raise ValueError("_time is a string or a number")
        else:
            time = math.trunc(t) * 10**9
    return time, {k: stringify(v) for k, v in item.items() if k != "_time" and v is not None}


def decode_entries(body: str) -> list[tuple[int | None, Entry]]:
    """Records of a request: an array if it begins with ``[``, else objects one after the other. All or none."""
    if body.startswith("["):
        items = json.loads(body)
    else:
        items, decoder = [], json.JSONDecoder()
        at = _SPACES.match(body).end()
        while at < len(body):
            item, at = decoder.raw_decode(body, at)
            items.append(item)
            at = _SPACES.match(body, at).end()
    if not items:
        raise ValueError("no records")
    return [to_entry(i) for i in items]


def normalise(time_ns: int | None, fields: Mapping[str, str], stream_fields: tuple[str, ...], now_ns: int) -> dict:
    """One row: empty names and values and reserved names go, then defaults, then the stream."""
    kept = {k: v for k, v in fields.items() if k and v and k not in RESERVED}
    row = {"_time_ns": now_ns if time_ns is None else time_ns, "_stream": stream_id(stream_fields, kept), "_msg": kept.pop("_msg", MISSING_MSG)}
    row |= {tag_column(f): kept.pop(f, None) for f in stream_fields}
    return row | {"fields": kept}


def normalise_df(df: DataFrame, stream_fields: tuple[str, ...], time_ns: Column, fields: Column) -> DataFrame:
    """As ``normalise``, for rows with a time column (null: now) and a map of fields."""
    named = F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, v: (k != "") & v.isNotNull() & (v != "") & ~k.isin(*RESERVED))
    ns = F.coalesce(time_ns, F.unix_micros(F.current_timestamp()) * 1000)
    base = df.select(ns.alias("_time_ns"), named.alias("__f"))
    get = lambda k: F.element_at("__f", F.lit(k))
    tags = {f: get(f) for f in stream_fields}
    own = [*stream_fields, "_msg"]
    return base.select(
        "_time_ns",
        timestamp_column(F.col("_time_ns")).alias("_time"),
        stream_id_column(tags).alias("_stream"),
        F.coalesce(get("_msg"), F.lit(MISSING_MSG)).alias("_msg"),
        *[c.alias(tag_column(f)) for f, c in tags.items()],
        F.map_filter("__f", lambda k, v: ~k.isin(*own)).alias("fields"),
    )


def _last_wins(fields: Column) -> Column:
    """A map without repeated names, which JSON text may bring: the last of each counts."""
    pairs = F.map_entries(fields)
    names = F.map_keys(fields)
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["key"]))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), fields).otherwise(F.map_from_entries(last))


def decode_lines(lines: DataFrame, stream_fields: tuple[str, ...], column: str = "value") -> DataFrame:
    """Rows of a frame of JSON texts, one object each. A malformed text or time fails the query; blank lines go."""
    text = lines.where(F.trim(column) != "")
    fields = _last_wins(F.from_json(F.col(column), "map<string,string>", {"mode": "FAILFAST"}))
    # The JSON kind of _time, which the map of strings loses. A record with a repeated name has no variant;
    # there the text itself tells a quoted time from a bare one.
    variant = F.schema_of_variant(F.try_variant_get(F.try_parse_json(column), "$._time", "variant"))
    shown = F.regexp_extract(column, r'"_time"\s*:\s*("|[-+0-9])', 1)
    kind = F.when(variant.isNotNull(), F.when(variant == "STRING", '"').when(F.rlike(variant, F.lit("INT|DECIMAL|DOUBLE|FLOAT")), "0").otherwise("")).otherwise(shown)
    value = F.element_at(fields, F.lit("_time"))
    number = F.try_multiply(F.when(value.try_cast("double") >= 0, F.floor(value.try_cast("double"))).otherwise(F.ceil(value.try_cast("double"))).cast("long"), F.lit(10**9))
    time = F.when(kind == '"', F.when(F.trim(value) == "", F.lit(None).cast("long")).otherwise(F.coalesce(parse_time_column(value), F.raise_error(F.concat(F.lit("no time: "), value)).cast("long"))))
    time = time.when(kind != "", number).when(F.map_contains_key(fields, "_time"), F.raise_error(F.lit("_time is a string or a number")).cast("long"))
    return normalise_df(text, stream_fields, time, fields)


def read_ndjson(spark, path: str, stream_fields: tuple[str, ...]) -> DataFrame:
    return decode_lines(spark.read.text(path), stream_fields)
