"""Quality rules whose cutoffs keep the share of good documents they reject under a limit.

Features of whole texts come from DataFrame functions alone. A rule rejects a document whose
feature is above (or below) its cutoff, and a document is rejected where any rule rejects it. Cutoffs are chosen for each
stratum, for all rules together, on labelled holdouts: ``SEQUENCE`` is a fixed sequence of settings (a cutoff for each rule), the mildest
first, of which each rejects all that the one before does. For good documents (quality 1, not toxic), n of them in the stratum, k
rejected by a setting, the exact binomial p-value of "the setting rejects a share of more than
``limit``" is P(Binomial(n, limit) <= k). Settings are tested in their order, stopping at
the first that isn't significant (a fixed sequence, which needs no further correction), at level
``error`` divided by the number of strata (Bonferroni). The last significant setting
is used; a stratum without one rejects nothing. So with probability 1 - error
the rules together reject at most ``limit`` of the good documents of every stratum. (The base limits, which
``base_failed`` gives, are set from outside; what they reject takes no part here.)

A null text counts as empty. A null stratum is one of its own, apart from an empty one. Rows without a label take no part
in the choice, nor do labels without a document; repeated labels of a key count once, as the worst.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.session import materialise, table

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
LIMIT, ERROR = 0.02, 0.05
#: Rules: (name, feature, sign, cutoffs from the mildest to the harshest). Sign 1 rejects above the cutoff, -1 below.
RULES = (
    ("symbols", "symbol_share", 1, (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    ("lines", "dup_line_share", 1, (0.9, 0.7, 0.5, 0.3, 0.2, 0.1)),
    ("repeats", "repeat_share", 1, (0.9, 0.6, 0.3, 0.2, 0.1, 0.05)),
    ("long_words", "mean_word", 1, (40.0, 20.0, 14.0, 11.0, 9.0, 8.0)),
    ("short_words", "mean_word", -1, (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)),
)



def _sequence() -> list[tuple[float, ...]]:
    """Settings: all rules at their mildest cutoffs, then one rule after the other a cutoff harsher."""
    at = [0] * len(RULES)
    out = [tuple(cuts[0] for *_, cuts in RULES)]
    for step in range(1, max(len(cuts) for *_, cuts in RULES)):
        for i, (*_, cuts) in enumerate(RULES):
            if step < len(cuts):
                at[i] = step
                out.append(tuple(cuts[j] for j, (*_, cuts) in zip(at, RULES)))
    return out


SEQUENCE = _sequence()


def word_array(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def base_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(*keep, text.alias("__text"), word_array(text).alias("__words"))
    n = F.size("__words")
    hashed = one.select(*keep, "__text", "__words", F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)]))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = hashed.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.array_join("__words", "").alias("__joined"),
        lines.alias("__lines"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
    )
    # Most texts repeat no window: only the others' windows are sorted.
    any_twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    two = counted.select(
        *keep, "n_words",
        F.length("__joined").cast("long").alias("word_chars"),
        (F.length("__joined") - F.length(F.translate("__joined", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        "__lines",
        F.when(any_twice, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("__sorted"),
    )
    size = F.size("__sorted")
    h = lambda i: F.get("__sorted", i)["h"]
    twice = F.filter(F.col("__sorted"), lambda x, j: ((j > 0) & (x["h"] == h(j - 1))) | ((j < size - 1) & (x["h"] == h(j + 1))))
    three = two.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__places"),
    )
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")),
        lambda a: a["sum"],
    )
    four = three.withColumn("n_repeat_words", covered).drop("__places")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return four.withColumn("base_failed", failed)


def with_shares(features: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        features.withColumn("symbol_share", F.col("n_symbols") / words)
        .withColumn("dup_line_share", F.col("n_dup_lines") / words)
        .withColumn("repeat_share", F.col("n_repeat_words") / words)
        .withColumn("mean_word", F.col("word_chars") / words)
    )


def rejects(feature: Column, sign: int, cutoff: Column) -> Column:
    return feature > cutoff if sign > 0 else feature < cutoff


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x >= 1, by Stirling's series at x + 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    below = sum((F.log(x + i) for i in range(8)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k below n * p; 1 from there on, which no test needs.

    Terms are summed from the k-th down, where they fall, for as many as are above 1e-16 of it: some multiple of the standard deviation.
    """
    size, top = n.cast("double"), k.cast("double")
    log_term = log_gamma(size + 1) - log_gamma(top + 1) - log_gamma(size - top + 1) + top * math.log(p) + (size - top) * math.log1p(-p)
    terms = F.least(k, F.ceil(9 * F.sqrt(size * (p * (1 - p)))) + 40).cast("long")
    below = F.when(terms > 0, F.sequence(F.lit(0).cast("long"), terms - 1)).otherwise(F.array().cast("array<bigint>"))

    def add(a: Column, j: Column) -> Column:
        i = top - j
        term = a["term"] * i * (1 - p) / ((size - i + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    share = F.aggregate(below, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add, lambda a: a["sum"])
    return F.when(k >= size * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_term) * share))


def rejected(cutoffs: list[Column]) -> Column:
    """Whether any rule rejects a row of features; a null cutoff rejects nothing."""
    hit = F.lit(False)
    for (_, feature, sign, _), cutoff in zip(RULES, cutoffs):
        hit = hit | F.coalesce(rejects(F.col(feature), sign, cutoff), F.lit(False))
    return hit


def choose_settings(holdout: DataFrame, stratum: str = "stratum", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """(stratum, a cutoff column for each rule, null where it has none) from good documents' features."""
    counts = [F.count_if(rejected([F.lit(c) for c in setting])).alias(f"k{j}") for j, setting in enumerate(SEQUENCE)]
    by = materialise(holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *counts), "quality-counts")
    level = F.lit(error / max(1, by.count()))
    passed, last = F.lit(True), F.lit(-1)
    for j in range(len(SEQUENCE)):
        passed = passed & (F.col(f"p{j}") <= level)
        last = F.when(passed, F.lit(j)).otherwise(last)
    tested = by.select(stratum, *[binomial_cdf(F.col(f"k{j}"), F.col("n"), limit).alias(f"p{j}") for j in range(len(SEQUENCE))]).select(stratum, last.alias("last"))
    settings = F.array(*[F.array(*[F.lit(c) for c in setting]) for setting in SEQUENCE])
    chosen = tested.select(stratum, F.when(F.col("last") >= 0, F.get(settings, F.col("last"))).alias("setting"))
    return chosen.select(stratum, *[F.get("setting", F.lit(i)).alias(f"cut_{name}") for i, (name, *_) in enumerate(RULES)])


def stratum_key(stratum: Column) -> Column:
    """A name of each stratum; that of a null one is empty, and no other's is."""
    return F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit(""))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """(doc_id, stratum, features, base_failed, kept, cutoffs) of every row of docs; stratum as ``stratum_key`` names it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum_key(F.col(stratum)).alias("stratum"), "text")
    features = materialise(with_shares(base_features(own, ["doc_id", "stratum"])), "quality-features")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    holdout = features.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    cutoffs = materialise(choose_settings(holdout, limit=limit, error=error), "quality-cutoffs")
    # As many rows as strata: broadcast while they are few, else joined by key.
    few = cutoffs.count() <= 10_000
    judged = features.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected([F.col(f"cut_{name}") for name, *_ in RULES]))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features of every document, and the verdict of rules with controlled risk by language."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    any_rule = lambda cuts: " OR ".join(f"coalesce({feature} {'>' if sign > 0 else '<'} {c}, false)" for (_, feature, sign, _), c in zip(RULES, cuts))
    tests = [f"SELECT stratum, {j} AS step, count(*) AS n, count(*) FILTER ({any_rule(setting)}) AS k FROM good GROUP BY stratum" for j, setting in enumerate(SEQUENCE)]
    chosen = [f"CASE step {' '.join(f'WHEN {j} THEN CAST({setting[i]} AS DOUBLE)' for j, setting in enumerate(SEQUENCE))} END AS cut_{name}" for i, (name, *_) in enumerate(RULES)]
    return f"""
    WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    win AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS BIGINT) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
    f AS (SELECT w.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
    g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_share, n_dup_lines / greatest(n_words, 1) AS dup_line_share,
      n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS mean_word FROM f),
    good AS (SELECT * FROM g WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0)),
    t AS ({" UNION ALL ".join(tests)}),
    p AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({LIMIT}) + (n - i) * ln(1 - {LIMIT})))) <= {ERROR} / (SELECT count(DISTINCT stratum) FROM good) AS ok FROM t),
    q AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS passed FROM p),
    last AS (SELECT stratum, max(step) AS step FROM q WHERE passed GROUP BY stratum),
    c AS (SELECT stratum, {", ".join(chosen)} FROM last)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({any_rule([f"cut_{name}" for name, *_ in RULES])}) AS kept
    FROM g LEFT JOIN c USING (stratum)
    """


ORACLE = _oracle()
