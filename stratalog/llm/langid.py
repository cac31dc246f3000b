"""Language identification by words first, and by shorter and shorter character n-grams for unseen words.

``fit`` counts words and n-grams by language in labelled rows; ``predict`` scores whole texts.

* Words are runs of letters, lower-cased. A known word (one that the labelled sample has ``LEAST_SEEN`` times or more) counts by its
  log frequency in each language, with additive smoothing.
* A word that isn't known is wrapped in blanks and scored by the mean log frequency of those of
  its n-grams that are known, for the largest n (from ``ORDERS``) that has any; else it says nothing.
* The prediction is the language with the largest sum over all the text's words (of equal
  ones, the first by name). ``score`` is its share among the languages at the evidence of at
  most ``EVIDENCE`` average words, so it stays between 0 and 1 for texts of any length.

Words and n-grams go by 64-bit hashes, and whole blocks of texts are counted and scored at once. The model has every known word and
n-gram of the sample, of whatever language; the sample, of about ``TRAIN_ROWS`` rows, bounds it.

A text that is null or has no letter is ``und`` with score 0, and so is every text where no
row was labelled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.session import materialise, ship, table, tidy
from stratalog.llm.words import HashTable, U, code_hashes, gather, mix

ORDERS = (4, 3, 2, 1)
#: Labelled rows that the counts are fitted on, about; kept by a hash of the key, so spread over all rows.
TRAIN_ROWS = 20_000
LEAST_SEEN = 2
EVIDENCE = 20.0
SMOOTHING = 0.1
UNDETERMINED = "und"
#: Characters of the texts that are scored at once.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter: a character of words, but no digit or underscore."""
    return np.array([(c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)])


@dataclass
class Words:
    """The lower-cased words of some texts: all their code points, words as (from, size), and the text of each."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        lower = [(t or "").lower() for t in texts]
        codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
        letter = _letters()[codes]
        edge = np.flatnonzero(np.diff(letter, prepend=False))
        start, end = edge[::2], edge[1::2]
        ends = np.cumsum(np.array([len(t) + 1 for t in lower], np.int64))
        return cls(codes, start, end - start, np.searchsorted(ends, start, "right"))

    @cached_property
    def hashes(self) -> np.ndarray:
        return code_hashes(self.codes[gather(self.start, self.size)], self.size)

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For some words the hashes of their n-grams, and the place among ``words`` of each."""
        size = self.size[words]
        if n == 1:
            codes, each = self.codes[gather(self.start[words], size)], size
        else:
            codes, each = np.full((size + 2).sum(), 32, np.int64), size + 3 - n
            codes[gather(np.cumsum(size + 2) - size - 1, size)] = self.codes[gather(self.start[words], size)]
        each = np.maximum(each, 0)
        whole = size if n == 1 else size + 2
        at = gather(np.cumsum(whole) - whole, each)
        packed = np.zeros(len(at), U)
        for k in range(min(n, 3)):
            packed = packed << U(21) | codes[at + k].astype(U)
        hashes = mix(packed, n)
        if n > 3:
            for k in range(3, n):
                hashes = mix(hashes + codes[at + k].astype(U), n)
        return hashes, np.repeat(np.arange(len(words)), each)


def blocks_of(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about ``limit`` bytes, and each one's first place."""
    texts = texts.cast(pa.large_string())
    at = 0
    while at < len(texts):
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield at, texts.slice(at, to - at).to_pylist()
        at = to


@dataclass
class Scores:
    """Scores by language of words, or of n-grams of one order, by hash."""

    hashes: np.ndarray
    scores: np.ndarray

    @cached_property
    def table(self) -> HashTable:
        found = HashTable(len(self.hashes))
        found.add(self.hashes, np.arange(len(self.hashes), dtype=np.int32))
        return found

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "scores": self.scores}


@dataclass
class Model:
    languages: list[str]
    words: Scores
    grams: dict[int, Scores]

    def unseen(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Scores of unknown words (words x languages)."""
        out = np.zeros((len(which), len(self.languages)))
        left = np.arange(len(which))
        for n in ORDERS:
            hashes, owner = words.grams(which[left], n)
            place = self.grams[n].table.find(hashes)
            owner, place = owner[place >= 0], place[place >= 0]
            if not len(owner):
                continue
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            total = np.add.reduceat(self.grams[n].scores[place].astype(np.float64), first, axis=0)
            have = owner[first]
            out[left[have]] = total / np.diff(np.append(first, len(owner)))[:, None]
            left = np.delete(left, have)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        words = Words.of(texts)
        if len(words.start) and self.languages:
            place = self.words.table.find(words.hashes)
            new = np.flatnonzero(place < 0)
            _, example, each = np.unique(words.hashes[new], return_index=True, return_inverse=True)
            place[new] = len(self.words.hashes) + each
            scores = np.concatenate([self.words.scores, self.unseen(words, new[example])]) if len(new) else self.words.scores
            first = np.flatnonzero(np.append(True, words.text[1:] != words.text[:-1]))
            total = np.add.reduceat(scores[place].astype(np.float64), first, axis=0)
            n = np.diff(np.append(first, len(words.text)))[:, None]
            scaled = total / n * np.minimum(n, EVIDENCE)
            share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
            own = words.text[first]
            best[own] = total.argmax(axis=1)
            score[own] = share[np.arange(len(own)), best[own]] / share.sum(axis=1)
        return [self.languages[i] if i >= 0 else UNDETERMINED for i in best.tolist()], score


def _scores(units: pa.Table, languages: list[str]) -> Scores:
    """Log frequencies of units (unit, by: a list of (lang, n))."""
    hashes = units.column("unit").to_numpy().view(U)
    counts = np.zeros((len(hashes), len(languages)))
    by = units.column("by").combine_chunks()
    if len(hashes):
        flat = by.flatten()
        number = {name: i for i, name in enumerate(languages)}
        lang = np.array([number[x] for x in flat.field("lang").to_pylist()], np.int64)
        counts[np.repeat(np.arange(len(hashes)), by.value_lengths().to_numpy()), lang] = flat.field("n").to_numpy()
    counts += SMOOTHING
    scores = np.log(counts) - np.log(counts.sum(axis=0, keepdims=True))
    # What all languages share says nothing about which one it is.
    return Scores(hashes, (scores - scores.sum(axis=1, keepdims=True) / max(1, len(languages))).astype(np.float32))


def fit(labelled: DataFrame, key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of (text, lang) rows whose lang isn't null."""
    ship(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.count()
    rate = min(1.0, train_rows / n) if n else 1.0
    kept = usable.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), F.lit(1 << 20)) < math.ceil(rate * (1 << 20)))

    def counted(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units, each = np.unique(hashes, return_inverse=True)
        return units, np.bincount(each, times).astype(np.int64)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = batch.column("lang").dictionary_encode()
            for at, texts in blocks_of(batch.column("text")):
                words = Words.of(texts)
                number = by_lang.indices.slice(at, len(texts)).to_numpy()[words.text]
                for lang in np.unique(number):
                    own = np.flatnonzero(number == lang)
                    distinct, example, each = np.unique(words.hashes[own], return_index=True, return_inverse=True)
                    times = np.bincount(each)
                    found = {0: (distinct, times)}
                    for order in ORDERS:
                        hashes, owner = words.grams(own[example], order)
                        found[order] = counted(hashes, times[owner])
                    for order, (units, n) in found.items():
                        name = pa.array([by_lang.dictionary[int(lang)].as_py()], pa.string()).take(pa.array(np.zeros(len(units), np.int64)))
                        yield pa.record_batch([pa.array(np.full(len(units), order, np.int32)), name, pa.array(units.view(np.int64)), pa.array(n, pa.int64())], ["size", "lang", "unit", "n"])

    source = kept.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = source.mapInArrow(count, "size int, lang string, unit long, n long").groupBy("size", "unit", "lang").agg(F.sum("n").alias("n"))
    units = found.groupBy("size", "unit").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    units = materialise(units.where(F.col("total") >= LEAST_SEEN).select("size", "unit", "by"), "langid-units")
    languages = sorted(r[0] for r in units.select(F.explode("by.lang")).distinct().collect())
    tables = {size: _scores(units.where(F.col("size") == size).select("unit", "by").toArrow(), languages) for size in (0, *ORDERS)}
    return Model(languages, tables.pop(0), tables)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, with lang_pred and score of each row's whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks_of(batch.column(batch.num_columns - 1)):
                lang, score = shared.value.predict(texts)
                columns = [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)]
                yield pa.record_batch([*columns, pa.array(lang, pa.string()), pa.array(score)], names)

    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    names = [*keep, "lang_pred", "score"]
    kinds = dict(docs.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves no remainder by 5; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the four fifths not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def reject_undetermined(docs: DataFrame, key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows whose language is determined with a score of at least ``least``; all columns stay, of whatever names."""
    model = fit(docs.where(~held_out(key)).select(key, "text", "lang"), key)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks_of(batch.column(place)):
                lang, score = shared.value.predict(texts)
                good = np.array([x != UNDETERMINED for x in lang], bool) & (score >= least)
                yield batch.slice(at, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
