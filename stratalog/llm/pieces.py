"""SentencePiece segmentations sampled from the piece lattice, and their lossless decoding.

A text is parted where a run of blanks begins (written as U+2581; it opens a word). No piece of the model
crosses such a place, so a text's lattice is a chain of word lattices,
and sampling each word by itself samples the whole text. For each distinct word of a
block, forward filtering gives every place in the word the total weight of the ways
to reach it. Backward sampling then walks all the words of the block at once from their
ends, choosing each piece by its share; the choice number j of word w of row key k is
a hash of (seed, k, w, j), so a row's segmentation depends on nothing but its key and text.

The piece models here are of the kind that ranks merges and holds no probabilities. A piece
of rank r counts as having log weight ``-log(r + 2)``, raised to the power ``sharpness``.
A character that is no piece becomes its bytes, as does a U+2581 of the text itself;
so decoding restores every text, with line ends, runs of blanks and odd characters.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.session import ship, table, tidy
from stratalog.llm.words import HashTable, U, distinct_spans, mix, slices

_BASE = 0xB5297A4D3F84D5A3
BLANK = "▁"
#: Bytes of text whose lattices are held at once; what a row gives doesn't depend on it.
BLOCK_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n."""
    return tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(n, b, U))])[:n] for b in (_BASE, pow(_BASE, -1, 1 << 64)))


class Substrings:
    """Hashes of substrings, overlapping ones too. They only say where to look: bytes are compared after."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:-1], out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])


class Model:
    """Pieces of a model by the hash of their bytes (a blank counting as byte 32), with log weights."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        found: list[tuple[bytes, int]] = []
        rank = 0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
                # A piece with a blank behind another character would cross the places where a text is parted.
                if BLANK not in piece.lstrip(BLANK):
                    found.append((self.bytes_of[i], i))
        scores = np.array([model.get_score(i) for _, i in found])
        order = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
        weight = -np.log(order + 2.0) * sharpness
        self.longest = max(len(b) for b, _ in found)
        data = np.frombuffer(b"".join(b for b, _ in found), np.uint8)
        ends = np.cumsum([len(b) for b, _ in found])
        lengths = np.array([len(b) for b, _ in found])
        hashes = Substrings(data).hashes(ends - lengths, ends)
        self.data, self.begin = data, ends - lengths
        self.lengths = np.unique(lengths)
        self.known = HashTable(len(found))
        self.known.add(hashes, np.arange(len(found), dtype=np.int32))
        self.piece_id = np.array([i for _, i in found], np.int32)
        self.weight = weight
        self.byte_weight = weight.min() - np.log(256.0) * sharpness


@lru_cache(maxsize=2)
def model_of(path: str, sharpness: float) -> Model:
    return Model(path, sharpness)


def part(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a block's words (each run of blanks opens one), and the first word of each document."""
    opens = data == 32
    opens[1:] &= data[:-1] != 32
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


class Lattice:
    """Nodes (character places) and edges (pieces) of the lattices of some distinct words.

    The edges into a node are neighbours, with their cumulative shares in ``below``.
    """

    def __init__(self, data: np.ndarray, model: Model):
        """data: the words' bytes, each followed by a zero byte (which no piece has)."""
        n = len(data)
        closes = np.flatnonzero(data == 0)
        opens = np.concatenate([[0], closes[:-1] + 1])
        room = np.repeat(closes, closes - opens + 1)
        heads = np.append((data & 0xC0) != 0x80, True)
        character = np.cumsum(heads)
        hashed = Substrings(data)
        inner = np.flatnonzero(heads[:-1] & (data != 0))
        starts, stops, pieces = [], [], []
        at = inner
        for size in model.lengths:
            at = at[at + size <= room[at]]
            if not len(at):
                break
            whole = at[heads[at + size]]
            found = model.known.find(hashed.hashes(whole, whole + size))
            ok = np.flatnonzero(found >= 0)
            for k in range(size):
                ok = ok[data[whole[ok] + k] == model.data[model.begin[found[ok]] + k]]
            starts.append(whole[ok])
            stops.append(whole[ok] + size)
            pieces.append(found[ok])
        start, stop, piece = (np.concatenate([np.empty(0, np.int64), *x[::-1]]) for x in (starts, stops, pieces))
        piece = piece.astype(np.int64)
        # Characters that are no piece of their own become bytes: an edge without a piece.
        single = np.zeros(n + 1, bool)
        single[start[character[stop] - character[start] == 1]] = True
        bare = inner[~single[inner]]
        ends = np.flatnonzero(heads)
        after = ends[character[bare]]
        start = np.concatenate([start, bare])
        stop = np.concatenate([stop, after])
        weight = np.concatenate([model.weight[piece], model.byte_weight * (after - bare)])
        piece = np.concatenate([model.piece_id[piece], np.full(len(bare), -1, np.int32)])
        # Edges by the node they end in, the longest first; then in waves: those that end at the same
        # place within their words, all words at once.
        order = np.argsort(stop, kind="stable")
        start, stop, weight, self.piece = start[order], stop[order], weight[order], piece[order]
        depth = stop - np.repeat(opens, closes - opens + 1)[start]
        deep = int(depth.max(initial=0))
        wave = np.argsort(depth.astype(np.uint16) if deep < 1 << 16 else depth, kind="stable")
        cuts = np.searchsorted(depth[wave], np.arange(1, deep + 2))
        total = np.full(n + 1, -np.inf)
        total[opens] = 0.0
        share = np.empty(len(start))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            edges = wave[a:b]
            value = total[start[edges]] + weight[edges]
            node = stop[edges]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            most = np.maximum.reduceat(value, first)
            size = np.diff(np.append(first, b - a))
            odds = np.exp(value - np.repeat(most, size))
            whole = np.add.reduceat(odds, first)
            total[node[first]] = most + np.log(whole)
            share[edges] = odds / np.repeat(whole, size)
        self.start, self.stop, self.total = start, stop, total
        # Cumulative shares as whole numbers of 32 bits: the same for a word in whatever block it is.
        running = np.cumsum(np.floor(share * 2.0**32).astype(np.int64))
        first = np.flatnonzero(np.append(True, stop[1:] != stop[:-1])) if len(stop) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(stop)))
        self.below = running - np.repeat(np.append(0, running)[first], size)
        self.below[first + size - 1] = 1 << 32
        self.first = np.zeros(n + 1, np.int64)
        self.first[stop[first]] = first

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each node the edge into it that a number of 32 bits picks."""
        edge = self.first[node]
        left = np.flatnonzero(self.below[edge] <= u)
        while len(left):
            edge[left] += 1
            left = left[self.below[edge[left]] <= u[left]]
        return edge


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, model: Model, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a block's documents one after the other, and n + 1 offsets."""
    starts, ends, first = part(data, offsets)
    if not len(starts):
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    example, each = distinct_spans(data[starts[0] :], ends - starts)
    size = (ends - starts)[example]
    held = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(held[-1], np.uint8)
    text[np.repeat(held[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = data[np.repeat(starts[example], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    # A zero byte of a text would close its word; no piece has one, so the byte that UTF-8 never uses stands for it.
    zero = np.flatnonzero(data == 0)
    if len(zero):
        inside = np.ones(len(text), bool)
        inside[held[1:] - 1] = False
        text[inside & (text == 0)] = 0xFF
    lattice = Lattice(text, model)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stream = mix(keys[doc] + mix((np.arange(len(starts)) - first[doc]).astype(U), seed), seed)
    at = held[:-1][each] + size[each]
    floor = held[:-1][each]
    live = np.arange(len(starts))
    picked, owner, order = [], [], []
    step = 0
    while len(live):
        edge = lattice.pick(at[live], (mix(stream[live], step * 0x9E3779B9 + 1) >> U(32)).astype(np.int64))
        picked.append(edge)
        owner.append(live)
        order.append(np.full(len(live), step))
        at[live] = lattice.start[edge]
        live = live[at[live] > floor[live]]
        step += 1
    edge, owner, order = (np.concatenate(x) for x in (picked, owner, order))
    sort = np.lexsort((-order, owner))
    edge, owner = edge[sort], owner[sort]
    ids = lattice.piece[edge]
    bare = np.flatnonzero(ids < 0)
    width = np.ones(len(ids), np.int64)
    if len(bare):
        width[bare] = (lattice.stop - lattice.start)[edge[bare]]
    upto = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(ids, width)
    if len(bare):
        spot = np.repeat(upto[bare], width[bare]) + np.arange(width[bare].sum()) - np.repeat(np.cumsum(width[bare]) - width[bare], width[bare])
        source = lattice.start[edge[bare]] - floor[owner[bare]] + starts[owner[bare]]
        byte = data[np.repeat(source, width[bare]) + np.arange(width[bare].sum()) - np.repeat(np.cumsum(width[bare]) - width[bare], width[bare])]
        out[spot] = model.byte_id[byte]
    per_word = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.bincount(owner, width, minlength=len(starts)).astype(np.int64), out=per_word[1:])
    return out, per_word[first]


def decoder(model: Model) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(b) for b in model.bytes_of], np.int64)
    return np.frombuffer(b"".join(model.bytes_of), np.uint8), np.concatenate([[0], np.cumsum(size)])


def restore(ids: np.ndarray, at: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that some documents' ids stand for, and n + 1 offsets."""
    data, place = decoder(model)
    begin, size = place[ids], place[ids + 1] - place[ids]
    upto = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])], upto[at]


def row_key(keys: pa.Array) -> np.ndarray:
    return np.where(keys.is_valid().to_numpy(False), keys.fill_null(0).to_numpy(False), -1).astype(np.int64).view(U)


def encode_pieces(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.5, key: str = "doc_id") -> DataFrame:
    """(key, n_pieces, pieces, pieces_crc32, text_sha256, lossless) of every whole text.

    pieces_crc32 is of the ids as u32 little-endian; text_sha256 is of the text decoded from
    them, and lossless says whether that is the text itself. A null text counts as empty and has
    no pieces. Rows with equal key and text are segmented alike; a null key has one stream of its own.
    """
    ship(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path, sharpness)
        for batch in batches:
            for rows, data, offsets in slices(batch, BLOCK_BYTES):
                ids, at = sample(data, offsets, row_key(rows.column("key")), model, seed)
                text, bounds = restore(ids, at, model)
                n = len(at) - 1
                raw = ids.astype("<u4")
                same = [np.array_equal(text[bounds[i] : bounds[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(n)]
                yield pa.record_batch(
                    [
                        rows.column("key"),
                        pa.array(np.diff(at), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array([zlib.crc32(raw[at[i] : at[i + 1]].tobytes()) for i in range(n)], pa.int64()),
                        pa.array([hashlib.sha256(text[bounds[i] : bounds[i + 1]].tobytes()).hexdigest() for i in range(n)]),
                        pa.array(same, pa.bool_()),
                    ],
                    [key, "n_pieces", "pieces", "pieces_crc32", "text_sha256", "lossless"],
                )

    source = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"{key} long, n_pieces long, pieces array<int>, pieces_crc32 long, text_sha256 string, lossless boolean")


def decode_pieces(coded: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, pieces)."""
    ship(coded.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path, 1.0)
        for batch in batches:
            texts = [b"".join(model.bytes_of[i] for i in row or ()).decode() for row in batch.column("pieces").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(texts, pa.string())], [key, "text"])

    return coded.select(F.col(key).cast("long").alias("key"), "pieces").mapInArrow(run, f"{key} long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, decoded again."""
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
