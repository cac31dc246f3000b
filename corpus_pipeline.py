"""A corpus pipeline over ``documents``: five stages, each on all that the one before kept.

Every stage but the last returns the columns of ``documents``. Tables beside documents (labels) are
read from the same folder. The stages' own limits are those of their operators.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import langid, mixing, near_dup, pieces, secrets
from stratalog.llm.session import materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; others go."""
    return langid.reject_undetermined(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.keep_first(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact(docs, secrets.fit(docs.select("doc_id", "text")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: domains to grow repeat, domains to shrink lose some."""
    # A row's own columns stay together, out of the way of the operator's.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", "text")
    fit = mixing.fit_rates(mixing.with_posteriors(packed, table(spark, sf_dir, "labels"), ["own", "doc_id"]), mixing.TARGETS)
    taken = F.when(F.col("tokens") == 0, F.lit(1).cast("long")).otherwise(mixing.copies(F.col("rate"), F.col("doc_id")))
    repeated = fit.rows.withColumn("copies", taken).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies")))).where(F.col("copy") < F.col("copies"))
    return repeated.select("own.*")


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dup", near_duplicates),
    ("secret_scans", secret_spans),
    ("source_mixing", mixture),
    ("sentencepiece", segmentation),
]

#: No SQL expresses these stages; their tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
