"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, and verified.

Shingles are five consecutive words (all words of a shorter text). A shingle's weight in a text
is (1 + ln tf) * idf, where idf comes from the numbers of texts that each of ``BINS`` hashed bins
of shingles is in: a table of fixed size over all texts. It is scaled to [IDF_FLOOR, 1]: a group of near
copies makes its own shingles frequent, and a steep idf would let the few words that differ outweigh them.

1. Texts of equal words are one text from here on; its name is a hash of 128 bits.
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` (shingle, level) pairs of each
   text. Two texts of weighted Jaccard similarity s agree in each with probability s. Its random
   variates come from tables, at a place that depends on the shingle and the draw. ``PLAIN_BANDS * ROWS`` least
   hashes of the shingle set do so for the plain similarity, which repeated passages leave as it is.
3. Texts that agree in all rows of a band share a bucket. Every text of a bucket is first paired with the
   bucket's leader (the least name), which joins most of a group of copies. Then every two texts of a bucket that
   these links leave in different components are compared, whether a leader took them or not: in parts of
   bounded size, the bucket's largest component against the others, and the others among themselves.
4. Pairs are verified by the weighted Jaccard similarity of their whole shingle sets. One whose plain
   similarity reaches the limit passes too, so that no weight turns down what the limit itself lets in.
5. Classes are the connected components, by label propagation over the links, with pointer jumping.

A class's id is its least doc_id. Every row gets one, copies and repeated rows included. A text that is null or
has no words is in a class of its own, as is a row with a null doc_id that has no other text (its id is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.session import discard, free_name, materialise, ship, table, tidy
from stratalog.llm.words import U, Block, blocks, mix, span_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, PLAIN_BANDS, ROWS = 10, 10, 4
#: Shingles of a bucket's part; two parts at most are compared at once.
PART_SHINGLES = 1 << 18
BINS, IDF_FLOOR = 1 << 17, 0.8
_TABLE = 1 << 14
_NAME_SALTS = (0xD1342543DE82EF93, 0xA0761D6478BD642F)


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block's documents: (document, hash, tf), by document and hash."""
    at, hashes = block.windows(size)
    doc = block.doc[at] if len(at) else np.empty(0, np.int64)
    n = np.diff(block.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, span_hashes(block.hashes[np.isin(block.doc, short)], n[short])])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))) if len(doc) else np.empty(0, np.int64)
    return doc[new], hashes[new], np.diff(np.append(new, len(doc)))


def names(block: Block) -> tuple[np.ndarray, list[bytes | None]]:
    """The documents with words, and a name of 16 bytes for each document's words (None without any)."""
    some = np.flatnonzero(np.diff(block.first))
    halves = [span_hashes(block.hashes, np.diff(block.first), salt)[some] for salt in _NAME_SALTS]
    raw = np.stack(halves, axis=1).astype(">u8").tobytes() if len(some) else b""
    out: list[bytes | None] = [None] * (len(block.first) - 1)
    for k, i in enumerate(some):
        out[i] = raw[16 * k : 16 * k + 16]
    return some, out


def bin_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - BINS.bit_length() + 1)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """A factor in [IDF_FLOOR, 1] for each bin of shingles, from the texts of all rows."""
    ship(texts.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BINS, np.int64), 0
        for block in blocks(batches):
            doc, hashes, _ = shingles(block)
            seen = np.unique(doc * BINS + bin_of(hashes)) % BINS
            total += np.bincount(seen, minlength=BINS)
            n += int((np.diff(block.first) > 0).sum())
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(total[used], n), pa.int64())], ["bin", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    found = np.zeros(BINS + 1, np.float64)
    rows = counted.toArrow()
    found[rows.column("bin").to_numpy()] = rows.column("n").to_numpy()
    n, df = found[-1], found[:-1]
    idf = np.log((1 + n) / (1 + df)) / max(np.log(1 + n), 1e-9)
    return (IDF_FLOOR + (1 - IDF_FLOOR) * np.clip(idf, 0, 1)).astype(np.float32)


def _variates() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per draw: r ~ Gamma(2, 1), the log of c ~ Gamma(2, 1), and b ~ Uniform(0, 1), at _TABLE places."""
    r = np.random.default_rng(20240131)
    return [(r.gamma(2, 1, _TABLE).astype(np.float32), np.log(r.gamma(2, 1, _TABLE)).astype(np.float32), r.random(_TABLE).astype(np.float32)) for _ in range(BANDS * ROWS)]


def weights(hashes: np.ndarray, tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)).astype(np.float32) * factor[bin_of(hashes)]


def draws(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, variates: list) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have shingles, and each one's samples (documents x draws)."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(first, len(doc)))
    log_weight = np.log(weight)
    out = np.empty((len(first), len(variates)), U)
    row = np.repeat(np.arange(len(first)), size)
    for k, (r, log_c, b) in enumerate(variates):
        place = ((hashes * U((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U(50)).astype(np.int64)
        rk, bk = r[place], b[place]
        level = np.floor(log_weight / rk + bk)
        log_a = log_c[place] - rk * (level - bk + 1)
        least = np.minimum.reduceat(log_a, first)
        hit = np.flatnonzero(log_a == least[row])
        # Equal ones go to the least hash, which stands first.
        own = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        out[:, k] = mix(hashes[own] ^ (level[own].astype(np.int64).view(U) * U(0x2545F4914F6CDD1D)), k)
    return doc[first], out


def least_hashes(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each document that has shingles, the least of their hashes under each of ``n`` rehashings (documents x n)."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    out = np.empty((len(first), n), U)
    for k in range(n):
        odd = U((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        turned = hashes * odd
        turned ^= turned >> U(31)
        turned *= U(0xBF58476D1CE4E5B9)
        out[:, k] = np.minimum.reduceat(turned, first)
    return out


def mark_of(text: Column) -> Column:
    """A hash of 128 bits of a whole text."""
    return F.unhex(F.md5(text.cast("string")))


def sketch(docs: DataFrame, factor: np.ndarray) -> DataFrame:
    """(doc_id, mark, name, bands): a hash of each row's text, the name of its words and, for those with words, a key for each band."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(factor)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variates = _variates()
        for block in blocks(batches):
            _, named = names(block)
            n = len(named)
            doc, hashes, tf = shingles(block)
            keys = np.zeros((n, BANDS + PLAIN_BANDS), np.int64)
            have = np.zeros(n, bool)
            if len(doc):
                some, out = draws(doc, hashes, weights(hashes, tf, shared.value), variates)
                plain = least_hashes(doc, hashes, PLAIN_BANDS * ROWS)
                band = np.zeros((len(some), BANDS + PLAIN_BANDS), U)
                for i in range(ROWS):
                    band = mix(band ^ np.concatenate([out[:, i::ROWS], plain[:, i::ROWS]], axis=1), i + 1)
                keys[some], have[some] = band.view(np.int64), True
            size = np.where(have, BANDS + PLAIN_BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys[have].ravel(), pa.int64()))
            yield pa.record_batch([block.rows.column("doc_id"), block.rows.column("mark"), pa.array(named, pa.binary()), bands], ["doc_id", "mark", "name", "bands"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, mark binary, name binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(name, set) of the rows with words: pairs of (32 bits of a shingle's hash, tf), as u32 little-endian.

    The hash's highest bits are kept, and with them its bin. A task gives each name once, so that a text's copies are few rows.
    """
    ship(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for block in blocks(batches):
            some, named = names(block)
            some = [i for i in some.tolist() if not (named[i] in seen or seen.add(named[i]))]
            if not some:
                continue
            doc, hashes, tf = shingles(block)
            at = np.searchsorted(doc, np.arange(len(named) + 1))
            high = (hashes >> U(32)).astype("<u4")
            tf = tf.astype("<u4")
            out = []
            for i in some:
                a, b = at[i], at[i + 1]
                # Frequencies follow only where one isn't 1.
                out.append(high[a:b].tobytes() + (tf[a:b].tobytes() if tf[a:b].max() > 1 else b""))
            yield pa.record_batch([pa.array([named[i] for i in some], pa.binary()), pa.array([int(at[i + 1] - at[i]) for i in some], pa.int32()), pa.array(out, pa.binary())], ["name", "n", "set"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "name binary, n int, set binary")


def _weighted(raw: bytes, n: int, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(raw, "<u4")
    tf = flat[n:] if len(flat) > n else np.ones(n, np.uint32)
    return flat[:n], (1 + np.log(tf)) * factor[flat[:n] >> np.uint32(32 - BINS.bit_length() + 1)]


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted Jaccard similarity (sum of lesser over that of greater weights) and plain one, of sets sorted by hash."""
    place = np.searchsorted(b[0], a[0])
    place[place == len(b[0])] = 0
    both = b[0][place] == a[0]
    common = np.minimum(a[1][both], b[1][place[both]]).sum()
    n = int(both.sum())
    return float(common / (a[1].sum() + b[1].sum() - common)), n / (len(a[0]) + len(b[0]) - n)


def verify(pairs: DataFrame, sets: DataFrame, factor: np.ndarray, similarity: float) -> DataFrame:
    """pairs (a, b) with similar: whether their sets' weighted, or plain, Jaccard similarity reaches ``similarity``."""
    shared = pairs.sparkSession.sparkContext.broadcast(factor)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, held = [], None, None
            for b, na, sa, nb, sb in zip(*(batch.column(c) for c in ("b", "na", "sa", "nb", "sb"))):
                if b != last:
                    last, held = b, _weighted(sb.as_py(), nb.as_py(), shared.value)
                out.append(max(similarities(_weighted(sa.as_py(), na.as_py(), shared.value), held)) >= similarity)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "similar"])

    left = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a binary, b binary, similar boolean")


def _parts(faced: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, name, root, part) of the texts to be compared with texts of other components in their buckets.

    A bucket's largest component (part -1) is dealt over ``mains`` parts, all other texts over ``others``. Group
    (p, q) compares main part p with part q and, where p is 0, part q within itself; group (-1 - i, j) parts i and j.
    """
    rooted = faced.join(sizes, "name").join(roots, "name", "left").select("name", "band", "key", "n", F.coalesce("root", "name").alias("root"))
    rooted = materialise(rooted, "near-rooted")
    held = rooted.groupBy("band", "key", "root").agg(F.sum("n").alias("size"))
    bucket = held.groupBy("band", "key").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    parts = lambda size: F.ceil(size / PART_SHINGLES)
    open_ = bucket.where(F.col("low") < F.col("high")).select("band", "key", F.col("main.root").alias("main"), parts(F.col("main.size")).alias("mains"), parts(F.col("size") - F.col("main.size")).alias("others"))
    found = rooted.join(materialise(open_, "near-open"), ["band", "key"])
    deal = lambda count: F.pmod(F.xxhash64("name"), count)
    upto = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    pair = lambda p, q: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q"))
    main = F.col("root") == F.col("main")
    found = found.withColumn("part", F.when(main, -1).otherwise(deal(F.col("others"))))
    own = F.transform(upto(F.col("mains")), lambda p: pair(p, F.col("part")))
    apart = F.transform(F.filter(upto(F.col("others")), lambda j: j != F.col("part")), lambda j: pair(-1 - F.least(j, F.col("part")), F.greatest(j, F.col("part"))))
    groups = F.when(main, F.transform(upto(F.col("others")), lambda q: pair(deal(F.col("mains")), q))).otherwise(F.concat(own, apart))
    return found.withColumn("at", F.explode(groups)).select(F.struct("band", "key", "at.p", "at.q").alias("group"), "name", "root", "part")


def across(parts: np.ndarray, roots: np.ndarray, within: bool, sets: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links that join the components (numbers) of a group's texts, as far as similar texts allow.

    Texts of the same part are compared if ``within`` is set, those of part -1 never.
    """
    size = np.array([len(h) for h, _ in sets])
    total = np.array([w.sum() for _, w in sets])
    flat = np.concatenate([h for h, _ in sets])
    order = np.argsort(flat, kind="stable")
    flat, weight = flat[order], np.concatenate([w for _, w in sets])[order]
    owner = np.repeat(np.arange(len(sets)), size)[order]
    label, links = roots.copy(), []
    for x in np.flatnonzero(parts >= 0):
        open_ = label != label[x]
        if not within:
            open_ &= parts != parts[x]
        if not open_.any():
            continue
        hashes, own = sets[x]
        low = np.searchsorted(flat, hashes, "left")
        n = np.searchsorted(flat, hashes, "right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        with_ = owner[at]
        common = np.bincount(with_, np.minimum(np.repeat(own, n), weight[at]), len(sets))
        both = np.bincount(with_, minlength=len(sets))
        alike = np.maximum(common / (total[x] + total - common), both / (size[x] + size - both)) >= similarity
        for y in np.flatnonzero(open_ & alike):
            if label[y] != label[x]:
                links.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return links


def links_across(parts: DataFrame, sets: DataFrame, factor: np.ndarray, similarity: float) -> DataFrame:
    """(a, b): links between texts of different components that share a bucket, from ``_parts``."""
    shared = parts.sparkSession.sparkContext.broadcast(factor)

    def links_in(rows: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        _, roots = np.unique([r["root"].hex() for r in rows], return_inverse=True)
        group = rows[0]["group"]
        weighed = [_weighted(r["set"], r["n"], shared.value) for r in rows]
        for x, y in across(np.array([r["part"] for r in rows]), roots, group["p"] == 0, weighed, similarity):
            yield max(rows[x]["name"], rows[y]["name"]), min(rows[x]["name"], rows[y]["name"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for row in zip(*(batch.column(c) for c in batch.schema.names)):
                row = {c: v.as_py() for c, v in zip(batch.schema.names, row)}
                if held and row["group"] != held[0]["group"]:
                    found += links_in(held)
                    held = []
                held.append(row)
            yield pa.record_batch([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])
        found = list(links_in(held)) if held else []
        yield pa.record_batch([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

    dealt = parts.join(sets, "name").select("group", "name", "root", "part", "n", "set").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def links_of(texts: DataFrame, docs: DataFrame, factor: np.ndarray, similarity: float) -> DataFrame:
    """(a, b): verified links between the names of different texts, as many as join all similar ones that share a bucket; texts has (name, bands)."""
    members = texts.select("name", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("name").alias("leader"), F.max("name").alias("last")).where(F.col("leader") < F.col("last"))
    leaders = materialise(buckets.select("band", "key", "leader"), "near-leaders")
    faced = materialise(members.join(leaders, ["band", "key"]).where(F.col("leader") < F.col("name")).select("name", "band", "key", "leader"), "near-faced")
    ends = faced.select("name").union(leaders.select(F.col("leader").alias("name"))).distinct()
    sets = materialise(shingle_sets(docs).join(ends, "name", "left_semi").dropDuplicates(["name"]), "near-sets")
    pairs = faced.select(F.col("name").alias("a"), F.col("leader").alias("b")).distinct()
    taken = materialise(verify(pairs, sets, factor, similarity).where("similar").select("a", "b"), "near-taken")
    # The leaders themselves have met all of their buckets.
    parts = _parts(faced.select("name", "band", "key"), components(taken), sets.select("name", "n"))
    links = materialise(taken.union(links_across(parts, sets, factor, similarity)), "near-links")
    discard(leaders, faced, sets, taken)
    return links


def components(links: DataFrame) -> DataFrame:
    """(name, root) of every name that has a link: the least name of its component.

    Each round every name takes the least label among its neighbours, then its label's label.
    """
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("name"), F.least("a", "low").alias("root"), F.lit(True).alias("moved")), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("name").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        near = materialise(labels.select("name", "root").join(near.withColumnRenamed("a", "name"), "name").select("name", "root", F.least("root", "near").alias("next")), "near-step")
        jump = near.join(near.select(F.col("name").alias("next"), F.col("next").alias("far")), "next")
        moved = materialise(jump.select("name", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")), "near-labels")
        discard(near, labels)
        labels = moved
        if moved.where("moved").isEmpty():
            discard(edges)
            return labels.select("name", "root")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, mark, class_id, class_name) of every row of docs (doc_id, text); class_name is null for a row without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    factor = document_frequencies(docs)
    sketches = materialise(sketch(docs, factor), "near-sketches")
    texts = sketches.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    texts = materialise(texts, "near-texts")
    links = links_of(texts.select("name", "bands"), docs, factor, similarity)
    roots = components(links)
    rooted = materialise(texts.select("name", "low").join(roots, "name", "left").select("name", "low", F.coalesce("root", "name").alias("root")), "near-roots")
    ids = materialise(rooted.groupBy("root").agg(F.min("low").alias("class_id")), "near-ids")
    by_name = materialise(rooted.join(ids, "root").select("name", "class_id", "root"), "near-classes")
    discard(texts, rooted, ids)
    found = sketches.select("doc_id", "mark", "name").join(by_name, "name", "left")
    return found.select("doc_id", "mark", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("root").alias("class_name"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, that of the least doc_id (of equal rows one); all columns stay.

    Of several texts of a class under its least doc_id one stays, always the same. Rows without a word are all kept.
    A row with a null doc_id is kept, as nothing names it.
    """
    named = classes(docs, similarity).where(F.col("doc_id").isNotNull() & F.col("class_name").isNotNull())
    first = named.groupBy("class_name").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("first.doc_id", F.col("first.mark").alias("__mark"))
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    mark = free_name(docs.columns, "mark")
    kept = docs.where(worded).withColumn(mark, mark_of(F.col("text"))).join(first.withColumnRenamed("__mark", mark), ["doc_id", mark], "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*[f"`{c}`" for c in docs.columns]).union(docs.where(~worded))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
