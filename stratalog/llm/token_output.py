"""Token ids as entropy-coded blocks in one global order.

``encode_tokens`` gives each document's ids, ``write_blocks`` writes them in ascending
key order as rANS blocks of whole documents, ``read_blocks`` decodes and checks them.

The written form is a folder of two Parquet tables, so that Spark's own committer
makes it whole when an executor is lost:

* ``frequencies``: one row, the shared table of quantised symbol frequencies (u32
  little-endian), counted over all documents;
* ``blocks``: part, seq (both in global order), doc_ids, lengths, payload. A payload is
  coded by itself (see ``rans``), with checkpoints and a checksum, so blocks and the
  checkpoints in them decode in parallel.

Documents with a null key come first. Rows with equal keys keep one order, by their
ids. A null or empty text has the end id alone. An empty input writes no block.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import rans
from stratalog.llm.session import materialise, shared_folder, ship, table, tidy
from stratalog.llm.words import HashTable, blocks, byte_hashes, gather

#: Symbols of a block are at least this many, but for the last one of a partition.
BLOCK_SYMBOLS = 1 << 18
#: Distinct runs whose ids a worker keeps, from task to task.
KNOWN_RUNS = 1 << 21
#: Bytes of text that are encoded at once.
BLOCK_BYTES = 1 << 21
END_ID = 1


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _run_tokenizer(path: str):
    """The same model, without the normal forms and splits that plain runs don't need."""
    from tokenizers import Tokenizer

    own = json.loads(_tokenizer(path).to_str())
    own |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(own))


_ODD, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)


def _classes() -> np.ndarray:
    """What each byte of a word is: a letter (also of two bytes, U+00C0 to U+024F), a digit, a sign, or odd."""
    kind = np.full(256, _ODD, np.uint8)
    kind[33:127] = _SIGN
    kind[ord("'")] = _ODD
    kind[0x80:0xC0] = kind[0xC3:0xCA] = _LETTER
    kind[ord("a") : ord("z") + 1] = kind[ord("A") : ord("Z") + 1] = _LETTER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    return kind


def _letters() -> np.ndarray:
    """For each two-byte letter from U+00C0 on, its lower case's place among them; -1 where that isn't one of them."""
    points = [chr(0xC0 + i) for i in range(7 * 64)]
    lower = [c.lower() for c in points]
    return np.array([ord(x) - 0xC0 if c not in "\u00d7\u00f7" and c <= "\u024f" and x in points else -1 for c, x in zip(points, lower)], np.int64)


_KIND = _classes()
_LETTERS = _letters()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Byte-level BPE writes each byte as a character: printable ones as they are, the others from U+0100 on. A blank parts runs here.
_PRINTED = np.arange(256, dtype="<u4")
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_PRINTED[_UNPRINTED] = np.arange(256, 256 + len(_UNPRINTED))
_PRINTED[32] = 32


def runs_of(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a block's runs one after the other, the runs' sizes, which of them are whole odd words, and the first run of each document.

    A plain word (letters, digits, signs but the apostrophe, no bar of a special token) is parted into runs that the tokenizer
    treats each by itself: letters, one digit, or signs, in lower case. Any other word is one run, as it is.
    """
    data, sizes = block.solid, block.ends - block.starts
    kind = _KIND[data]
    after = np.append(data[1:], 0).astype(np.uint8)
    odd = kind == _ODD
    flat = _LOWER[data]
    pair = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(pair):
        lower = _LETTERS[(data[pair].astype(np.int64) - 0xC3) * 64 + (after[pair] & 0x3F)]
        odd[pair] |= lower < 0
        flat[pair], flat[pair + 1] = 0xC3 + (lower >> 6), 0x80 + (lower & 0x3F)
    odd |= (data == ord("<")) & (after == ord("|"))
    opens = np.cumsum(sizes) - sizes
    whole = np.unique(np.searchsorted(opens, np.flatnonzero(odd), "right") - 1)
    if len(whole):
        at = np.repeat(opens[whole] - np.cumsum(sizes[whole]) + sizes[whole], sizes[whole]) + np.arange(sizes[whole].sum())
        kind[at], flat[at] = _WHOLE, data[at]
    new = kind == _DIGIT
    new[1:] |= kind[1:] != kind[:-1]
    new[opens] = True
    starts = np.flatnonzero(new)
    first = np.searchsorted(starts, np.append(opens, len(data))[block.first])
    return flat, np.diff(np.append(starts, len(data))), kind[starts] == _WHOLE, first


class RunCoder:
    """Ids of texts by the ids of their distinct runs (see ``runs_of``), which are kept under a hash, with their bytes.

    Right for a tokenizer that lower-cases, drops white space, splits letters, single digits and other signs, and
    marks the last token of each such run by ``</w>``. What is found under a hash is compared byte by byte; where
    two runs share one, all runs get other hashes.
    """

    def __init__(self, path: str):
        self.path, self.salt = path, 0
        vocabulary = _tokenizer(path).get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self, room: int = KNOWN_RUNS) -> None:
        """A table of run numbers; of each run its bytes (from, size) and ids (from, size)."""
        self.known = HashTable(max(room, KNOWN_RUNS))
        self.bytes, self.ids = np.empty(0, np.uint8), np.empty(0, np.uint32)
        self.from_byte, self.n_bytes, self.from_id, self.n_ids = (np.empty(0, np.int64) for _ in range(4))

    def _coded(self, data: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs one after the other, and their numbers."""
        starts = np.cumsum(sizes) - sizes
        plain, odd = np.flatnonzero(~whole), np.flatnonzero(whole)
        counts = np.zeros(len(sizes), np.int64)
        ids = np.empty(0, np.uint32)
        if len(plain):
            wide = sizes[plain] + 1
            spaced = np.full(wide.sum(), 32, np.uint8)
            spaced[gather(np.cumsum(wide) - wide, sizes[plain])] = data[gather(starts[plain], sizes[plain])]
            text = _PRINTED[spaced].tobytes().decode("utf-32-le")
            ids = np.array(_run_tokenizer(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer doesn't close each run with one token")
            counts[plain] = np.diff(ends, prepend=0)
        if len(odd):
            words = [data[a : a + n].tobytes().decode() for a, n in zip(starts[odd].tolist(), sizes[odd].tolist())]
            coded = [x.ids for x in _tokenizer(self.path).encode_batch_fast(words, add_special_tokens=False)]
            counts[odd] = [len(x) for x in coded]
            both = np.empty(counts.sum(), np.uint32)
            begin = np.cumsum(counts) - counts
            both[gather(begin[plain], counts[plain])] = ids
            both[gather(begin[odd], counts[odd])] = np.fromiter(chain.from_iterable(coded), np.uint32)
            ids = both
        return ids, counts

    def _learn(self, hashes: np.ndarray, data: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> None:
        ids, counts = self._coded(data, sizes, whole)
        n = len(self.n_bytes)
        self.from_byte = np.append(self.from_byte, len(self.bytes) + np.cumsum(sizes) - sizes)
        self.from_id = np.append(self.from_id, len(self.ids) + np.cumsum(counts) - counts)
        self.n_bytes, self.n_ids = np.append(self.n_bytes, sizes), np.append(self.n_ids, counts)
        self.bytes, self.ids = np.append(self.bytes, data), np.append(self.ids, ids)
        self.known.add(hashes, np.arange(n, n + len(hashes), dtype=np.int32))

    def _runs(self, data: np.ndarray, sizes: np.ndarray, whole: np.ndarray) -> np.ndarray | None:
        """Each run's number; none where two different runs have one hash."""
        hashes = byte_hashes(data, sizes, self.salt)
        starts = np.cumsum(sizes) - sizes
        run = self.known.find(hashes)
        open_ = np.flatnonzero(run < 0)
        if len(open_):
            new, example, each = np.unique(hashes[open_], return_index=True, return_inverse=True)
            if len(self.n_bytes) + len(new) > self.known.room:
                self.clear(len(sizes))
                return self._runs(data, sizes, whole)
            first, example = len(self.n_bytes), open_[example]
            self._learn(new, data[gather(starts[example], sizes[example])], sizes[example], whole[example])
            run[open_] = first + each
        if np.array_equal(self.n_bytes[run], sizes) and np.array_equal(self.bytes[gather(self.from_byte[run], sizes)], data):
            return run
        return None

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's documents one after the other, and n + 1 offsets."""
        data, sizes, whole, first = runs_of(block)
        while (run := self._runs(data, sizes, whole)) is None:
            self.salt += 1
            self.clear()
        n = self.n_ids[run]
        return self.ids[gather(self.from_id[run], n)], np.append(0, np.cumsum(n))[first]


@lru_cache(maxsize=1)
def _coder(path: str) -> RunCoder:
    return RunCoder(path)


def encode_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(key, ids): ids of each whole text as u16 or, if an id needs it, u32 little-endian, then ``end_id``."""
    ship(docs.sparkSession)
    wide = _tokenizer(tokenizer).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    kind = "<u4" if wide else "<u2"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for block in blocks(batches, BLOCK_BYTES):
            ids, at = coder.encode(block)
            ids = ids.astype(kind)
            end = np.array([end_id], kind).tobytes()
            coded = [ids[at[i] : at[i + 1]].tobytes() + end for i in range(len(at) - 1)]
            yield pa.record_batch([block.rows.column("key"), pa.array(coded, pa.binary())], ["key", "ids"])

    source = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "key long, ids binary")


def _symbol_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """Occurrences of every id over all rows. The counts are bounded by the vocabulary."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            found = np.bincount(flat, minlength=len(total))
            found[: len(total)] += total
            total = found
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_blocks(tokens: DataFrame, path: str, wide: bool = False, partitions: int | None = None) -> None:
    """Write (key, ids) rows as blocks in ascending key order.

    ``tokens`` is read three times (counts, bounds of the ranges, blocks): hand over a written table.
    """
    spark = tokens.sparkSession
    ship(spark)
    kind = "<u4" if wide else "<u2"
    counts = _symbol_counts(tokens, kind)
    freq = rans.quantise(counts if counts.any() else np.ones(2)).astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(freq),)], "frequencies binary").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(freq)

    @tidy
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.table(shared.value)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        ahead = held = 0

        def block() -> pa.RecordBatch:
            payload = rans.encode(np.concatenate(ids), coder)
            row = [ahead, held, keys, [len(x) for x in ids], payload]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                keys.append(key)
                ids.append(np.frombuffer(raw, kind))
                held += len(ids[-1])
                if held >= BLOCK_SYMBOLS:
                    yield block()
                    keys, ids, ahead, held = [], [], ahead + held, 0
        if ids:
            yield block()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("ids").asc()]
    ordered = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(code, "ahead long, symbols long, doc_ids array<long>, lengths array<long>, payload binary")
    made.select(F.spark_partition_id().cast("long").alias("part"), "*").write.parquet(f"{path}/blocks")


_BLOCK = pa.schema([("ahead", pa.int64()), ("symbols", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Decode every block: (doc_id, start, n_tokens, ids_crc32, ids).

    ``start`` counts the ids of all documents before in the written order. The driver
    gets one number of ids for each partition written.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/frequencies").first()[0]))
    stored = spark.read.schema("part long, ahead long, symbols long, doc_ids array<long>, lengths array<long>, payload binary").parquet(f"{path}/blocks")
    before, total = {}, 0
    for part, n in sorted(map(tuple, stored.groupBy("part").agg(F.sum("symbols")).collect())):
        before[part], total = total, total + n

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.table(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = rans.decode(row["payload"], coder).astype("<u4")
                at = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
                each = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                columns = (row["doc_ids"], before[row["part"]] + row["ahead"] + at[:-1], np.diff(at), [zlib.crc32(x) for x in each])
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(each, pa.binary())], _READ)

    return stored.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


_READ = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with the public word BPE, written as blocks and read back."""
    import public_tokenizers

    tokens = materialise(encode_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "token-ids")
    path = f"{shared_folder(spark)}/stratalog/token-blocks-{uuid.uuid4().hex}"
    write_blocks(tokens, path)
    return read_blocks(spark, path).drop("ids")
