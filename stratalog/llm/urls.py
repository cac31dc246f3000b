"""URL filtering by listed rules, and by association rules mined from labels.

``listed`` judges a URL by the longest host-and-path rule that fits. ``mine`` takes labelled
URLs as transactions of their tokens and a bad or good item, finds frequent itemsets by
FP-growth, and keeps rules "tokens -> bad" of enough support and confidence, of any number of tokens, dropping
each that a rule with fewer of its tokens and no less confidence covers. ``matches`` finds the URLs that
a rule's tokens are all in, by an inverted index: a rule is kept under its rarest token, so
a URL is compared with the rules of its own tokens alone.

Tokens are the host's labels (``h:``), path segments (``p:``, a digit run as ``0``), names of query
parameters (``q:``), and the scheme (``s:``). Mining and matching take all tokens. Frequent tokens that are in the very same labelled
URLs make one class, as no rule can tell them apart: classes are what is mined, and a URL has a class if it has one of its tokens.
Itemsets grow with the power of a URL's classes. So one with more than ``MINED`` of them is dealt over baskets of that size in which any
two of its classes meet: rules of one and two classes are complete for URLs of any length, longer ones for URLs of up to
``MINED`` classes. What FP-growth finds are candidates; their counts are made anew over the whole URLs.

A null URL, or one without ``://``, has an empty host and path, no tokens, and is allowed unless listed.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.session import materialise, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MINED = 0.002, 5, 0.6, 12
BAD = "label:bad"
#: Rules up to which the index is broadcast; beyond, it is joined by token.
FEW_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (host and path as one string), and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    some = lambda a, mark: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))
    return F.array_distinct(F.concat(some(F.split(host, r"\."), "h:"), some(segments, "p:"), some(names, "q:"), some(scheme, "s:")))


def baskets_of(whole: DataFrame) -> DataFrame:
    """whole (row, kept) with, for each row, one basket of all its items or several of MINED; any two items of a row are in one."""
    half = MINED // 2
    part = lambda i: F.slice("kept", i * half + 1, half)
    short = whole.where(F.size("kept") <= MINED).withColumn("basket", F.col("kept"))
    long = whole.where(F.size("kept") > MINED).withColumn("parts", F.ceil(F.size("kept") / half).cast("int"))
    long = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 2))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("parts") - 1)))
    return short.union(long.withColumn("basket", F.concat(part(F.col("i")), part(F.col("j")))).select(*whole.columns, "basket"))


def _within(left: DataFrame, index: DataFrame) -> DataFrame:
    """left (items, ...) with each set of index (item, set, ...) that is within its items; a set stands under one of its own."""
    return left.withColumn("item", F.explode("items")).join(index, "item").where(F.size(F.array_except("set", "items")) == 0).drop("item")


def _indexed(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """sets (set, ...) with ``item``, the rarest of its items by counts (item, count)."""
    rare = sets.select("set", F.explode("set").alias("item")).join(counts, "item").groupBy("set").agg(F.min(F.struct("count", "item"))["item"].alias("item"))
    return sets.join(rare, "set")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, members, rare, n, confidence) of the rules, from (row, tokens, bad) rows.

    tokens names each class of a rule by its least token; members has all tokens of each of these classes, rare those of the rarest one.
    """
    n = labelled.count()
    least = max(min_count, math.ceil(n * min_support))
    single = labelled.select("row", F.explode("tokens").alias("token"))
    both = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"rows{k}") for k in range(2)]
    frequent = single.groupBy("token").agg(F.count(F.lit(1)).alias("count"), *both).where(F.col("count") >= least)
    alike = frequent.groupBy("count", "rows0", "rows1").agg(F.min("token").alias("item"), F.collect_set("token").alias("members"))
    classes = materialise(alike.select("item", "count", "members"), "url-classes")
    kept = single.join(classes.select("item", F.explode("members").alias("token")), "token").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("kept"))
    whole = materialise(kept.join(labelled.select("row", "bad"), "row"), "url-whole")
    dealt = materialise(baskets_of(whole).select(F.when(F.col("bad"), F.concat("basket", F.array(F.lit(BAD)))).otherwise(F.col("basket")).alias("items")), "url-baskets")
    # Half a basket less, so that rounding never asks for one more.
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, dealt.count())), minConfidence=min_confidence).fit(dealt).freqItemsets
    sets = sets.where((F.size("items") > 1) & F.array_contains("items", BAD)).select(F.array_sort(F.array_except("items", F.array(F.lit(BAD)))).alias("set"))
    candidates = materialise(_indexed(sets, classes.select("item", "count")), "url-itemsets")
    found = _within(whole.select(F.col("kept").alias("items"), "bad"), candidates).groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
    strong = found.where(F.col("n_bad") >= least).withColumn("confidence", F.col("n_bad") / F.col("n")).where(F.col("confidence") >= min_confidence)
    strong = materialise(_indexed(strong, classes.select("item", "count")), "url-strong")
    inner = strong.select("item", "set", F.col("confidence").alias("sure"))
    covered = _within(strong.select(F.col("set").alias("items"), "confidence"), inner).where((F.size("set") < F.size("items")) & (F.col("sure") >= F.col("confidence")))
    pruned = strong.join(covered.select(F.col("items").alias("set")).distinct(), "set", "left_anti")
    members = pruned.select("set", F.explode("set").alias("one")).join(classes.select(F.col("item").alias("one"), "members"), "one").groupBy("set").agg(F.collect_list("members").alias("members"))
    rare = classes.select("item", F.col("members").alias("rare"))
    return pruned.join(members, "set").join(rare, "item").select(F.col("set").alias("tokens"), "members", "rare", "n", "confidence")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule covers, from (url, tokens)."""
    index = materialise(rules.select(F.explode("rare").alias("token"), F.col("members").alias("rule")), "url-rules")
    if index.count() <= FEW_RULES:
        index = F.broadcast(index)
    found = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return found.where(F.forall("rule", lambda own: F.arrays_overlap(own, F.col("tokens")))).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every row of pages; mined: whether a mined rule covers it."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    tokens = tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url")))
    labelled = own.where(F.col("url").isNotNull()).join(bad, "page_id").groupBy("page_id", "url").agg(F.first("bad").alias("bad"))
    labelled = materialise(labelled.select(F.struct("page_id", "url").alias("row"), tokens.alias("tokens"), "bad"), "url-labelled")
    distinct = own.select("url").where(F.col("url").isNotNull()).distinct().withColumn("tokens", tokens)
    covered = materialise(matches(distinct, mine(labelled)), "url-covered").withColumn("mined", F.lit(True))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    judged = own.join(covered, "url", "left").select("page_id", host.alias("host"), path.alias("path"), F.coalesce("mined", F.lit(False)).alias("mined"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    return rf"""
    WITH u AS (SELECT page_id, url, position('://' IN coalesce(url, '')) AS colon FROM pages),
    r AS (SELECT page_id, url, CASE WHEN colon > 0 THEN substr(url, colon + 3) ELSE '' END AS rest, CASE WHEN colon > 0 THEN substr(url, 1, colon - 1) ELSE '' END AS scheme FROM u),
    h AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
      regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM r),
    t AS (SELECT *, list_distinct(list_concat(
        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')),
        list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x),
        CASE WHEN scheme <> '' THEN ['s:' || scheme] ELSE [] END)) AS tokens FROM h),
    b AS (SELECT doc_id AS page_id, max(CAST(coalesce(quality = 0 OR toxic = 1, false) AS INT)) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    l AS (SELECT page_id, url, any_value(tokens) AS tokens, any_value(bad) AS bad FROM t JOIN b USING (page_id) WHERE url IS NOT NULL GROUP BY page_id, url),
    least AS (SELECT greatest({MIN_COUNT}, CAST(ceil(count(*) * {MIN_SUPPORT}) AS BIGINT)) AS m FROM l),
    s AS (SELECT page_id, url, bad, unnest(tokens) AS token FROM l),
    f AS (SELECT token, count(*) AS c FROM s GROUP BY token HAVING count(*) >= (SELECT m FROM least)),
    k AS (SELECT page_id, url, any_value(bad) AS bad, list_sort(list(token)) AS own FROM s JOIN f USING (token) GROUP BY page_id, url),
    p AS (SELECT bad, own, unnest(range(1, CAST(1 AS BIGINT) << len(own))) AS pick FROM k),
    i AS (SELECT bad, list_filter(own, lambda x, j: (pick >> (j - 1)) & 1 = 1) AS items FROM p),
    strong AS (SELECT items FROM i GROUP BY items HAVING count(*) FILTER (bad) >= (SELECT m FROM least) AND count(*) FILTER (bad) / count(*) >= {MIN_CONFIDENCE}),
    covered AS (SELECT DISTINCT url FROM t, strong WHERE list_has_all(tokens, items))
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN covered.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, covered.url IS NOT NULL AS mined
    FROM t LEFT JOIN covered USING (url)
    """


ORACLE = _oracle()
