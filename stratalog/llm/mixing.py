"""Document rates that bring soft domains to target shares of the tokens.

A classifier fitted on labelled rows gives each document a posterior over domains; a domain is a
value of the labels (here: how good and how toxic a text is). The expected tokens of domain k are
E_k = sum over documents of rate * tokens * posterior_k. Rates are nonnegative and solve
the least squares problem min sum of ((E_k - T_k) / T_k)^2 by projected gradient descent from rate 1. A step is taken in the metric of the
documents whose rate isn't at its floor (their K x K Gram matrix), as a gradient step of length 1 then solves the problem
for those, and few steps are needed; one that makes things worse is halved.

The rates are one number per document, but the gradient depends on a document only through its
posterior and the K residuals. So an iteration is one aggregate over the table (K sums and the Gram matrix to the
driver), and a document's rate is a fold over the steps since the rates were last
written, in the end over all of them: no rate is ever shuffled, and no text is written again.

Targets are met when every domain is within ``TOLERANCE`` of its own target (of 1e-6 of all tokens, if that is more). Where they
can't be met (a domain that no document may have, say) the iterations end after ``ITERATIONS``, and ``met`` says so.

A null or empty text has no tokens; it counts nowhere and keeps rate 1. Without labelled rows of two
domains or more there is one domain, ``all``, and every rate is 1. A null key is like any other key. Of rows that share a labelled
key, the classifier is fitted on the least text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.quality import word_array
from stratalog.llm.session import materialise, table

#: Labelled rows that the classifier is fitted on, about; kept by a hash of the key.
TRAIN_ROWS = 10_000
FEATURES = 1 << 13
ITERATIONS, TOLERANCE = 30, 2e-3
#: Steps after which the rates so far are written, so that no fold gets longer.
FOLDED = 6
#: Share of the tokens each domain of op8 is to have.
TARGETS = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("junk")


def token_features(text: Column) -> Column:
    """What the classifier counts: lower-case words without the signs at their ends, and each sign by itself."""
    plain = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    signs = F.filter(F.transform(F.split(F.lit("# * $ % & | < >"), " "), lambda s: F.when(F.contains(plain, s), s)), lambda s: s.isNotNull())
    return F.concat(word_array(plain), signs)


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="__tokens", outputCol="features", numFeatures=FEATURES, binary=True).transform(df.withColumn("__tokens", token_features(F.col("text"))))


@dataclass
class Posteriors:
    domains: list[str]
    rows: DataFrame


def with_posteriors(docs: DataFrame, labels: DataFrame, keep: list[str], train_rows: int = TRAIN_ROWS) -> Posteriors:
    """``keep``, tokens and posterior (an array in the order of domains) of every row of docs."""
    domain = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", domain_of_labels().alias("domain"))
    n = domain.count()
    rate = min(1.0, train_rows / n) if n else 1.0
    sample = domain.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mixing")), F.lit(1 << 20)) < math.ceil(rate * (1 << 20)))
    # Bounded by train_rows, so it may be broadcast.
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("domain").alias("domain"))
    train = materialise(_vectors(labelled).select("domain", "features"), "mixing-train")
    counts = {r["domain"]: r["count"] for r in train.groupBy("domain").count().collect()}
    domains = sorted(counts)
    tokens = F.size(word_array(F.col("text").cast("string"))).cast("long")
    if len(domains) < 2:
        return Posteriors(["all"], materialise(docs.select(*keep, tokens.alias("tokens"), F.array(F.lit(1.0)).alias("posterior")), "mixing-posteriors"))
    number = F.lit(None)
    for i, d in enumerate(domains):
        number = F.when(F.col("domain") == d, F.lit(float(i))).otherwise(number)
    model = LogisticRegression(maxIter=30, regParam=1e-3, family="multinomial", probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r").fit(train.withColumn("label", number))
    scored = model.transform(_vectors(docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)).withColumn("tokens", F.size(word_array(F.col("text").cast("string"))).cast("long")))
    return Posteriors(domains, materialise(scored.select(*keep, "tokens", vector_to_array("__p").alias("posterior")), "mixing-posteriors"))


def _fold(start: Column, steps: list[list[float]], k: int) -> Column:
    """The rate after the given steps (each K numbers), floored at 0 in each."""
    if not steps:
        return start
    moves = F.array(*[F.array(*[F.lit(x) for x in step]) for step in steps])
    towards = lambda m: sum((F.col("posterior")[i] * m[i] for i in range(k)), F.lit(0.0))
    return F.aggregate(moves, start, lambda r, m: F.greatest(F.lit(0.0), r - towards(m)))


@dataclass
class Fit:
    """Rows with their rate; expected and target tokens by domain; whether each target is met."""

    rows: DataFrame
    expected: dict[str, float]
    target: dict[str, float]
    met: bool


def fit_rates(found: Posteriors, shares: dict[str, float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> Fit:
    """The rates that bring the domains to ``shares`` of the tokens, whose total stays."""
    rows, domains = found.rows, found.domains
    k = len(domains)
    p = [F.col("posterior")[i] for i in range(k)]
    plain = rows.withColumn("rate", F.lit(1.0))

    def measured(of: DataFrame, rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens, and the Gram matrix of the rows whose rate is above 0."""
        sums = [F.sum(F.col("__rate") * F.col("tokens") * x) for x in p]
        gram = [F.sum(F.when(F.col("__rate") > 0, F.col("tokens") * p[i] * p[j])) for i in range(k) for j in range(i + 1)]
        got = [x or 0.0 for x in of.withColumn("__rate", rate).agg(*[c.alias(f"c{i}") for i, c in enumerate(sums + gram)]).first()]
        whole = np.zeros((k, k))
        whole[np.tril_indices(k)] = got[k:]
        return np.array(got[:k]), np.maximum(whole, whole.T)

    held, every, steps = plain.select("tokens", "posterior", "rate"), [], []
    now, gram = measured(held, F.col("rate"))
    total = now.sum()
    if not total or k < 2:
        return Fit(plain, dict(zip(domains, now.tolist())), dict(zip(domains, now.tolist())), True)
    share = np.array([max(0.0, shares.get(d, 0.0)) for d in domains])
    target = (share / share.sum() if share.sum() else np.full(k, 1 / k)) * total
    unit = np.maximum(target, total * 1e-6)
    worst = lambda e: float(np.abs((e - target) / unit).max())
    miss = lambda e: float((((e - target) / unit) ** 2).sum())
    step = None
    for _ in range(iterations):
        if worst(now) <= tolerance:
            break
        if step is None:
            step = np.linalg.lstsq(gram + np.diag(np.full(k, 1e-12 * total)), now - target, rcond=None)[0]
        if len(steps) == FOLDED:
            held, steps = materialise(held.withColumn("rate", _fold(F.col("rate"), steps, k)), "mixing-rates"), []
        then, after = measured(held, _fold(F.col("rate"), [*steps, step.tolist()], k))
        if miss(then) < miss(now):
            steps.append(step.tolist())
            every.append(step.tolist())
            now, gram, step = then, after, None
        else:
            step = step / 2
    return Fit(plain.withColumn("rate", _fold(F.col("rate"), every, k)), dict(zip(domains, now.tolist())), dict(zip(domains, target.tolist())), worst(now) <= tolerance)


def copies(rate: Column, key: Column, seed: int = 0) -> Column:
    """How often a document is taken: the rate's whole part, and one more by a hash of its key with the rest as chance."""
    unit = F.pmod(F.xxhash64(key.cast("string"), F.lit(f"mixing-{seed}")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors, rate and copies of every document, and whether the targets are met."""
    found = with_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    fit = fit_rates(found, TARGETS)
    named = [F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(found.domains)]
    rated = fit.rows.withColumn("rate", F.when(F.col("tokens") == 0, 1.0).otherwise(F.col("rate")))
    return rated.select("doc_id", "tokens", *named, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(fit.met).alias("targets_met"))
