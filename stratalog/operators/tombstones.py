"""Logical deletes: predicate records by day, and the anti join that hides their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.streams import tags_array
from stratalog.functions.times import day_of, day_overlaps
from stratalog.model import DeleteSpec

SCHEMA = "id string, created_ns long, day string, start_ns long, end_ns long, tags array<string>, contains string"
#: Records up to which they are broadcast; beyond, they are joined by day, of which each is dealt over ``SALTS`` shares of its rows.
FEW, SALTS = 10_000, 64


def resolve_days(spec: DeleteSpec, known: set[str]) -> list[str]:
    """The known days that overlap the window; if none does, the days of its ends."""
    found = sorted(d for d in known if day_overlaps(d, spec.start_ns, spec.end_ns))
    return found or sorted({day_of(t) for t in (spec.start_ns, spec.end_ns) if t is not None})


def records(spec: DeleteSpec, days: list[str], first_id: int, now_ns: int) -> list[dict]:
    tags = sorted(f"{k}={v}" for k, v in spec.stream_eq.items() if v)
    return [{"id": f"d-{first_id + i:06d}", "created_ns": now_ns, "day": d, "start_ns": spec.start_ns, "end_ns": spec.end_ns, "tags": tags, "contains": spec.contains} for i, d in enumerate(days)]


def frame(spark: SparkSession, found: list[dict]) -> DataFrame:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], SCHEMA)


def hides(stream_fields: tuple[str, ...], record: str = "t") -> Column:
    """Whether a record hides a row. Records don't heed when they were made: rows that come later are hidden too."""
    t = lambda name: F.col(f"{record}.{name}")
    return (
        (t("start_ns").isNull() | (F.col("_time_ns") >= t("start_ns")))
        & (t("end_ns").isNull() | (F.col("_time_ns") <= t("end_ns")))
        & (F.size(F.array_except(t("tags"), tags_array(stream_fields))) == 0)
        & F.contains(F.col("_msg"), t("contains"))
    )


def apply(rows: DataFrame, found: list[dict], stream_fields: tuple[str, ...], keep_hidden: bool = False) -> DataFrame:
    """Rows (with day) that no record of their day hides; with keep_hidden those that one does."""
    if not found:
        return rows.limit(0) if keep_hidden else rows
    deletes, condition = frame(rows.sparkSession, found), (F.col("r.day") == F.col("t.day")) & hides(stream_fields)
    if len(found) <= FEW:
        deletes = F.broadcast(deletes)
    else:
        deletes = deletes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        condition = condition & (F.pmod(F.xxhash64("r._time_ns", "r._msg"), F.lit(SALTS)).cast("int") == F.col("t.salt"))
    return rows.alias("r").join(deletes.alias("t"), condition, "left_semi" if keep_hidden else "left_anti")
