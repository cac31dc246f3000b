"""Removal of word passages that repeat across documents, by suffix automata of reference shards.

Each word is removed that is covered by a window of ``size`` words which is also in something earlier: in a document of lesser
doc_id (``remove_repeats``), or in a text of another table (``remove_reference_spans``). Either way a reference of passages is parted into
shards of bounded size. The suffix automaton over a shard's words is built where the shard is needed, and the words that may
match it stream past for their matching statistics: where the longest match is ``size`` words or more, and its state
belongs to an earlier owner, the window goes. Maximal runs of such windows are the spans that are removed.

The corpus as its own reference would make shards of all its words, and each document would pass all of them. So the
reference is cut to what can match, and documents meet only the shards they need:

1. Each window has an anchor, the least hash among its runs of ``GRAM`` words, so equal windows have equal
   anchors, and neighbours mostly share one. Anchors that two documents have or more
   (an aggregate over anchors alone) are put in a bloom filter of fixed size. A filter that is full lets more windows
   through; it never drops one.
2. Windows whose anchor is in the filter are dealt out by a hash of 64 bits. An aggregate gives each that two documents have or more its
   owner: the least document, and the place in it (in blocks of ``PIECE`` words).
3. Windows join their owners (a plain equi-join that adaptive execution splits where a window is hot). What a document owns are
   passages of the reference; its other windows are regions to be streamed past the shard of their owner.
4. Pieces of reference go to shards of about ``SHARD_WORDS`` words by a hash of their owner. A shard that many regions need is
   sent to several tasks, each of which streams about ``TURN_WORDS`` words past it. So a passage that a third of all
   documents share is one reference passage, and its regions are split.

The hashes only route: a word is removed where the automaton has matched the window's words themselves. (Should two
different windows share a hash, one of them may stay.) A null or empty text has no words. Rows with a null doc_id keep all
words, and are nobody's earlier document. Rows of equal doc_id are not earlier than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.automaton import SuffixAutomaton
from stratalog.llm.session import discard, materialise, ship, table, tidy
from stratalog.llm.words import U, Block, blocks, mix, window_hashes

WINDOW, GRAM = 50, 8
FILTER_BITS, FILTER_HASHES = 28, 3
#: Windows of one piece of reference, or of a region.
PIECE = 1_000
#: Words of a shard, and words that one task streams past it, about.
SHARD_WORDS, TURN_WORDS = 50_000, 400_000


def anchors(block: Block, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of a block, and its anchor."""
    at = block.full(size)
    if not len(at):
        return at, np.empty(0, U)
    least = window_hashes(block.hashes, gram)
    span, want = 1, size - gram + 1
    while span * 2 <= want:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    return at, np.minimum(least[at], least[at + want - span])


def _bits(values: np.ndarray, k: int) -> np.ndarray:
    return (mix(values, 77 + k) >> U(64 - FILTER_BITS)).astype(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): mark is a hash of 128 bits of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("mark"))


def _rows_of(block: Block) -> np.ndarray:
    """The first 64 bits of each document's mark."""
    return np.array([int.from_bytes((m or bytes(8))[:8]) for m in block.rows.column("mark").to_pylist()], U)


def _blocks(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for the piece that a window which starts at a word of a text is in."""
    return mix(rows + (places // PIECE).astype(U), 91).view(np.int64)


def repeated_anchors(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """A bloom filter, as u64 words, of the anchors that documents of different doc_id share."""
    ship(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            at, anchor = anchors(block, size, gram)
            doc = block.doc[at] if len(at) else at
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))) if len(at) else at
            yield pa.record_batch([pa.array(anchor[new].view(np.int64)), block.rows.column("doc_id").take(pa.array(doc[new]))], ["anchor", "doc_id"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column("anchor").to_numpy().view(U)
            place = np.concatenate([_bits(value, k) for k in range(FILTER_HASHES)])
            yield pa.record_batch([pa.array(place >> 6), pa.array((U(1) << (place & 63).astype(U)).view(np.int64))], ["word", "bit"])

    found = docs.mapInArrow(run, "anchor long, doc_id long")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    words = shared.mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
    return out


def windows(docs: DataFrame, kept, size: int, gram: int, of: str) -> DataFrame:
    """(window, doc_id, ``of``) of the windows whose anchor is in the filter (a broadcast variable).

    ``of`` is ``row``, a number for the text, or ``block``, one for the piece of the text.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = kept.value
        for block in blocks(batches):
            at, anchor = anchors(block, size, gram)
            for k in range(FILTER_HASHES):
                place = _bits(anchor, k)
                inside = (bloom[place >> 6] >> (place & 63).astype(U)) & U(1) == 1
                at, anchor = at[inside], anchor[inside]
            if not len(at):
                continue
            doc = block.doc[at]
            row = _rows_of(block)[doc]
            number = row.view(np.int64) if of == "row" else _blocks(row, at - block.first[doc])
            named = window_hashes(block.hashes, size)[at].view(np.int64)
            yield pa.record_batch([pa.array(named), block.rows.column("doc_id").take(pa.array(doc)), pa.array(number)], ["window", "doc_id", of])

    return docs.mapInArrow(run, f"window long, doc_id long, {of} long")


_PASSAGE = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.binary()), ("at", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])


def passages(docs: DataFrame, hits: DataFrame, size: int) -> DataFrame:
    """(owner, block, doc_id, mark, at, n, words): runs of neighbouring windows with one owner, as the n words from word ``at`` on, parted by blanks."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            at, named = block.windows(size)
            named = named.view(np.int64)
            edge = np.searchsorted(at, block.first)
            doc_ids, marks, numbers = block.rows.column("doc_id").to_pylist(), block.rows.column("mark").to_pylist(), _rows_of(block)
            rows = []
            for i, hit in enumerate(block.rows.column("hits")):
                own = named[edge[i] : edge[i + 1]]
                window, low, part = (hit.values.field(c).to_numpy() for c in ("window", "low", "block"))
                order = np.argsort(window)
                window, low, part = window[order], low[order], part[order]
                place = np.minimum(np.searchsorted(window, own), len(window) - 1)
                found = np.flatnonzero(window[place] == own)
                low, part = low[place[found]], part[place[found]]
                # A document's own windows are reference where they are first.
                use = (low != doc_ids[i]) | (part == _blocks(numbers[i], found))
                found, low, part = found[use], low[use], part[use]
                if not len(found):
                    continue
                opens = np.flatnonzero(np.append(True, (np.diff(found) > 1) | (np.diff(low) != 0) | (np.diff(part) != 0)))
                opens = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(opens, np.append(opens[1:], len(found)))])
                for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(found)]):
                    n, k = b - a + size - 1, int(block.first[i] + found[a])
                    words = b" ".join([block.word(j) for j in range(k, k + n)])
                    rows.append((int(low[a]), int(part[a]), doc_ids[i], marks[i], int(found[a]), n, words))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_PASSAGE), _PASSAGE)], schema=_PASSAGE)

    found = docs.withColumn("row", F.conv(F.substring(F.hex("mark"), 1, 16), 16, -10).cast("long")).join(hits, ["doc_id", "row"])
    return found.select("doc_id", "text", "mark", "hits").mapInArrow(run, "owner long, block long, doc_id long, mark binary, at long, n long, words binary")


def spans(reference: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, begin, end) of the words that windows of regions cover which a lesser owner's reference has.

    reference has (shard, owner, n, words), regions (shard, doc_id, mark, at, n, words).
    """
    turns = regions.groupBy("shard").agg(F.ceil(F.sum("n") / TURN_WORDS).alias("turns"))
    columns = ("shard", "turn", "kind", "doc_id", "mark", "at", "words")
    sent = reference.join(turns, "shard").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    sent = sent.select("shard", "turn", F.lit(0).alias("kind"), F.col("owner").alias("doc_id"), "mark", F.lit(0).cast("long").alias("at"), "words")
    streamed = regions.join(turns, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "mark", "at"), "turns").alias("turn"), F.lit(1).alias("kind"), "doc_id", "mark", "at", "words")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, automaton = None, [], None
        for batch in batches:
            rows = []
            for shard, turn, kind, doc_id, mark, at, words in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (shard, turn) != key:
                    key, held, automaton = (shard, turn), [], None
                if kind == 0:
                    held.append((doc_id, words.split(b" ")))
                    continue
                if automaton is None:
                    automaton, held = SuffixAutomaton(held), []
                rows += [(doc_id, mark, at + a, at + b + size) for a, b in automaton.runs_before(words.split(b" "), size, doc_id)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_SPAN), _SPAN)], schema=_SPAN)

    dealt = sent.union(streamed).repartition("shard", "turn").sortWithinPartitions("shard", "turn", "kind")
    return dealt.mapInArrow(run, "doc_id long, mark binary, begin long, end long")


_SPAN = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("begin", pa.int64()), ("end", pa.int64())])


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(block: Block, i: int, removed: np.ndarray) -> bytes:
    first = block.first[i]
    return b" ".join([block.word(first + k) for k in np.flatnonzero(~removed)])


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _rows(block: Block, removed: list[np.ndarray]) -> pa.RecordBatch:
    kept = [_kept(block, i, r) for i, r in enumerate(removed)]
    return pa.record_batch(
        [
            block.rows.column("doc_id"),
            pa.array([len(r) for r in removed], pa.int64()),
            pa.array([int(r.sum()) for r in removed], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            pa.array([k.decode() for k in kept], pa.string()),
        ],
        ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
    )


def _removed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of docs (key, doc_id, mark, text), the key as doc_id, without the words of its spans."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            removed = []
            for i, hit in enumerate(block.rows.column("spans")):
                begin, end = (hit.values.field(c).to_numpy() for c in ("begin", "end")) if hit.is_valid else (np.empty(0, np.int64),) * 2
                removed.append(_covered(begin, end, int(block.first[i + 1] - block.first[i])))
            yield _rows(block, removed)

    spans_of = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    spans_of = materialise(spans_of, "repeat-spans")
    return docs.join(spans_of, ["doc_id", "mark"], "left").select(F.col("key").alias("doc_id"), "text", "spans").mapInArrow(run, _RESULT)


def _found(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Spans, by (doc_id, mark), of the rows of docs (doc_id, mark, text) whose doc_id isn't null."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "mark")
    kept = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, size, gram))
    owners = windows(docs, kept, size, gram, "block").groupBy("window").agg(F.min(F.struct("doc_id", "block")).alias("first"), F.max("doc_id").alias("high"))
    owners = materialise(owners.where(F.col("first.doc_id") < F.col("high")).select("window", F.col("first.doc_id").alias("low"), F.col("first.block").alias("block")), "repeat-owners")
    hits = windows(docs, kept, size, gram, "row").join(owners, "window").where("low <= doc_id")
    hits = materialise(hits.groupBy("doc_id", "row").agg(F.collect_set(F.struct("window", "low", "block")).alias("hits")), "repeat-hits")
    kept.unpersist()
    found = materialise(passages(docs, hits, size), "repeat-passages")
    discard(owners, hits)
    reference = found.where("owner = doc_id")
    n = max(1, -(-(reference.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("owner", "block"), F.lit(n)).alias("shard")
    return spans(reference.select(shard, "owner", "mark", "n", "words"), found.where("owner < doc_id").select(shard, "doc_id", "mark", "at", "n", "words"), size)


def remove_repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; kept: the words left, joined by blanks."""
    rows = _source(docs).withColumn("key", F.col("doc_id"))
    return _removed(rows, _found(rows, size, gram))


def remove_reference_spans(docs: DataFrame, reference: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """As ``remove_repeats``, against the texts of a reference table instead of earlier documents: all of those count as earlier than any row of docs."""
    rows = _source(docs).withColumn("key", F.col("doc_id")).withColumn("doc_id", F.lit(1).cast("long"))
    earlier = _source(reference.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")))
    return _removed(rows, _found(rows.select("doc_id", "text", "mark").union(earlier), size, min(size, GRAM)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words and more that documents of lesser doc_id have."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = rf"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    win AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
    low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
    gone AS (SELECT DISTINCT doc_id, i + k AS j FROM win JOIN low USING (h), range({WINDOW}) r(k) WHERE low < doc_id),
    one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM one ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """
