"""Vectorised words and word windows of whole texts, straight from Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Words, windows and texts are named by
64-bit hashes without a Python object per word. None is a polynomial: a span's hash is the sum of a
scrambled (place, value) pair for each of its values, a window's joins the hashes of its halves by a scrambling step, so that no
texts collide by construction (a polynomial modulo 2**64 has such pairs for any base). Where equal names must mean
equal words, ``distinct_spans`` compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Places within a span whose scrambled bytes are looked up; later ones are computed.
_PLACES = 64
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + U(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, the order of which counts."""
    x = a * U(0xD1342543DE82EF95)
    x += b
    x ^= x >> U(32)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    return x


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """The hash of values[i:i + size] for each i that has so many."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, U)
    power, span, out, done = values, 1, None, 0
    while True:
        if size & span:
            # Windows are put together from runs of powers of two, the shortest first.
            out = power if out is None else _join(out[: len(power) - done], power[done:])
            done += span
        if done == size:
            return mix(out[:n], size)
        power = _join(power[:-span], power[span:])
        span *= 2


def _totals(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] modulo 2**64 for spans that lie one behind the other, without gaps in ``values``."""
    out = np.zeros(len(starts), U)
    some = np.flatnonzero(ends > starts)
    if len(some):
        out[some] = np.add.reduceat(values, starts[some])
    return out


def span_hashes(values: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash for each run of ``values``, which the runs of the given sizes make up one after the other."""
    ends = np.cumsum(sizes)
    place = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
    scrambled = mix(values ^ mix(place.astype(U), salt + 0x51ED27), salt)
    return mix(_totals(scrambled, ends - sizes, ends) + sizes.astype(U), salt + 1)


def byte_hashes(data: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
    """As ``span_hashes``, for bytes."""
    table = _TABLES.get(salt)
    if table is None:
        table = _TABLES[salt] = mix(np.arange(_PLACES * 256, dtype=U) * U(0x9E3779B97F4A7C15), salt)
    ends = np.cumsum(sizes)
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 23 else np.int64)
    place -= np.repeat((ends - sizes).astype(place.dtype), sizes)
    place <<= 8
    place += data
    late = np.flatnonzero(place >= len(table)) if len(sizes) and sizes.max() > _PLACES else ()
    if len(late):
        further = mix(place[late].astype(U) * U(0x9E3779B97F4A7C15), salt)
        place[late] = 0
    scrambled = table[place]
    if len(late):
        scrambled[late] = further
    return mix(_totals(scrambled, ends - sizes, ends) + sizes.astype(U), salt + 1)


def code_hashes(codes: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
    """As ``span_hashes``, for code points."""
    scrambled_at = lambda place, code: mix((place.astype(U) << U(21) | code.astype(U)) * U(0x9E3779B97F4A7C15), salt)
    table = _TABLES.get(~salt)
    if table is None:
        both = np.arange(_PLACES // 2 * 1024)
        table = _TABLES[~salt] = scrambled_at(both >> 10, both & 1023)
    ends = np.cumsum(sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    near = (place << 10) + codes
    far = np.flatnonzero((codes >= 1024) | (place >= _PLACES // 2))
    near[far] = 0
    scrambled = table[near]
    scrambled[far] = scrambled_at(place[far], codes[far])
    return mix(_totals(scrambled, ends - sizes, ends) + sizes.astype(U), salt + 1)


class HashTable:
    """Numbers by hash, in an open table that is at most half full."""

    def __init__(self, room: int):
        self.room = 1 << (max(room, 1) - 1).bit_length()
        self.hashes, self.numbers = np.zeros(2 * self.room, U), np.full(2 * self.room, -1, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(64 - len(self.numbers).bit_length() + 1)).astype(np.int64)

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Hashes that are neither in the table nor equal to each other."""
        slot = self._slot(hashes)
        while len(numbers):
            free = self.numbers[slot] < 0
            self.hashes[slot[free]], self.numbers[slot[free]] = hashes[free], numbers[free]
            # Of those that took one slot the last has it, with its own hash.
            lost = self.numbers[slot] != numbers
            numbers, hashes, slot = numbers[lost], hashes[lost], (slot[lost] + 1) % len(self.numbers)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        slot = self._slot(hashes)
        number = self.numbers[slot].astype(np.int64)
        other = np.flatnonzero((number >= 0) & (self.hashes[slot] != hashes))
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.numbers)
            number[other] = self.numbers[slot[other]]
            other = other[(number[other] >= 0) & (self.hashes[slot[other]] != hashes[other])]
        return number


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


def distinct_spans(data: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the runs of bytes that make up ``data``: one run of each value, and each run's place among those.

    Runs are told apart by hash and then compared byte by byte; should two differ under one hash, another hash is taken.
    """
    starts = np.cumsum(sizes) - sizes
    for salt in count():
        if hashes is None:
            hashes = byte_hashes(data, sizes, salt)
        _, example, each = np.unique(hashes, return_index=True, return_inverse=True)
        like = example[each]
        if np.array_equal(sizes[like], sizes):
            place = np.arange(len(data))
            place += np.repeat(starts[like] - starts, sizes)
            if np.array_equal(data[place], data):
                return example, each
        hashes = None


@dataclass
class Block:
    """Some whole documents: their rows, bytes, and words.

    ``first[i]:first[i + 1]`` are the words of document i; ``solid`` the bytes of all words, one after the other.
    """

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    solid: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        """One hash for each word."""
        return byte_hashes(self.solid, self.ends - self.starts)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window of ``size`` words within one document, and its hash."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, U)
        at = self.full(size)
        return at, window_hashes(self.hashes, size)[at]

    def full(self, size: int) -> np.ndarray:
        """First word of each window of ``size`` words within one document."""
        n = len(self.hashes)
        if n < size:
            return np.empty(0, np.int64)
        doc = self.doc
        return np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole documents of at most ``limit`` bytes together, or one longer document."""
    data, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Block:
    space = _SPACE[data]
    solid = np.flatnonzero(~space)
    if not len(solid):
        empty = np.empty(0, np.int64)
        return Block(rows, data, offsets, empty, empty, np.zeros(len(offsets), np.int64), data[:0])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = np.empty(len(solid), bool)
    opens[0] = True
    opens[1:] = (np.diff(solid) > 1) | edge[solid[1:]]
    starts = solid[opens]
    closes = np.empty(len(solid), bool)
    closes[-1] = True
    closes[:-1] = opens[1:]
    ends = solid[closes] + 1
    return Block(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets), data[solid])


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[Block]:
    for batch in batches:
        for part in slices(batch, limit):
            yield words_of(*part)
