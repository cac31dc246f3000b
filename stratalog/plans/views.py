"""Log views of the driver's tables, and tables loaded from them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.streams import stream_id_column
from stratalog.functions.times import day_column, timestamp_column
from stratalog.model import Options, tag_column
from stratalog.sources.table import LogTable

FIELDS = ("service", "host")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can see it: in spark.checkpoint.dir, or on a local session's own machine."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    return f"{folder}/stratalog/{name}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="stratalog-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows, with day and event_id."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    service = F.col("event_type")
    host = F.concat(F.lit("h"), F.pmod("user_id", F.lit(4)).cast("string"))
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    named = raw.select("event_id", ns.alias("_time_ns"), F.col("props").alias("_msg"), service.alias(tag_column("service")), host.alias(tag_column("host")))
    return named.select(
        "event_id", "_time_ns", timestamp_column(F.col("_time_ns")).alias("_time"), day_column(F.col("_time_ns")).alias("day"),
        stream_id_column({f: F.col(tag_column(f)) for f in FIELDS}).alias("_stream"), "_msg", tag_column("service"), tag_column("host"),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as normalised rows, event_id among the fields."""
    own = events(spark, sf_dir)
    return own.select("_time_ns", "_time", "_stream", "_msg", *[tag_column(f) for f in FIELDS], F.create_map(F.lit("event_id"), F.col("event_id").cast("string")).alias("fields"))


def event_table(spark: SparkSession, sf_dir: str, parts: int = 1, **options) -> LogTable:
    """A new table that holds the events, in ``parts`` appends."""
    table = LogTable.open(spark, scratch(spark, "events"), Options(FIELDS, **options))
    rows = event_rows(spark, sf_dir)
    for k in range(parts):
        table.append_frame(rows if parts == 1 else rows.where(F.pmod(F.element_at("fields", "event_id").cast("long"), F.lit(parts)) == k))
    return table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log rows without a time: streams of lang and source."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tags = {"lang": F.col("lang"), "source": F.col("source")}
    return raw.select("doc_id", F.col("text").alias("_msg"), stream_id_column(tags).alias("_stream"), *[c.alias(tag_column(f)) for f, c in tags.items()])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return raw.select("conv_id", "turn", F.col("text").alias("_msg"), F.col("role").alias(tag_column("role")), stream_id_column({"role": F.col("role")}).alias("_stream"))
