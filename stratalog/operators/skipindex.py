"""A trigram index beside the files: which of them may hold a substring.

Each file has the set of its messages' byte trigrams, hashed to ``BITS`` places, so a
file's entry has a bounded size. A substring can only be in a file that has all of its
trigrams' places: no file is skipped wrongly; one may be read in vain. Substrings of fewer than three
bytes, and files without an entry, skip nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 18


def trigrams(text: Column) -> Column:
    """All windows of three bytes."""
    raw = text.cast("binary")
    n = F.octet_length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(raw, i, F.lit(3)))).otherwise(F.array().cast("array<binary>"))


def places(text: Column) -> Column:
    return F.array_distinct(F.transform(trigrams(text), lambda t: F.pmod(F.xxhash64(t), F.lit(BITS)).cast("int")))


def build(stored: DataFrame) -> DataFrame:
    """(file, place): distinct places of every file of a scan of parts; a file goes by its path below their folder."""
    file = F.format_string("day=%s/part_id=%d/%s", "day", "part_id", F.col("_metadata.file_name"))
    each = stored.select(file.alias("file"), places(F.col("_msg")).alias("p"))
    return each.select("file", F.explode("p").alias("place")).distinct()


def needle_places(spark: SparkSession, needle: str) -> list[int]:
    return spark.range(1).select(places(F.lit(needle))).first()[0] if len(needle.encode()) >= 3 else []


def files_with(index: DataFrame, needed: list[int]) -> DataFrame:
    """The files that have all the needed places."""
    hit = index.where(F.col("place").isin(needed)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return hit.where(F.col("n") == len(needed)).select("file")
