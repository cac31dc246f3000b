"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block is coded by itself with a frequency table that all blocks share. Symbol i of
a block belongs to lane i mod LANES; a step codes one symbol of every lane. Encoding
runs from the last step to the first, so that decoding runs forward. Every
CHECKPOINT_STEPS steps the lanes' states and the place in the stream are kept, from
which decoding may start as well as from the block's start.

Layout of a block, little-endian:

    magic b"SLB1" | u32 lanes | u32 symbols | u32 checkpoints | u32 stream words
    | u32 crc32 of the payload | payload
    payload: checkpoints x (u32 place in stream, lanes x u64 states), the first for
    step 0, then the stream of u32 words
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

U = np.uint64
MAGIC = b"SLB1"
SCALE_BITS = 20
LOW_BITS = 31
LANES = 1024
CHECKPOINT_STEPS = 64
_HEAD = struct.Struct("<4s5I")


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**SCALE_BITS, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.float64)
    used = counts > 0
    total = 1 << SCALE_BITS
    if not used.any():
        raise ValueError("a frequency table needs a symbol that occurs")
    if used.sum() > total:
        raise ValueError("more symbols than the table can hold")
    spare = total - int(used.sum())
    share = counts * (spare / counts.sum())
    freq = np.floor(share).astype(np.int64) + used
    left = total - int(freq.sum())
    order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share)), ~used))
    freq[order[:left]] += 1
    return freq.astype(np.uint32)


class Table:
    """A frequency table ready for coding."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, U)
        self.start = np.concatenate([np.zeros(1, U), np.cumsum(self.freq)[:-1]])
        if int(self.freq.sum()) != 1 << SCALE_BITS:
            raise ValueError("the frequencies don't sum to the scale")

    @property
    def slots(self) -> np.ndarray:
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


@lru_cache(maxsize=4)
def table(freq: bytes) -> Table:
    return Table(np.frombuffer(freq, "<u4"))


def encode(symbols: np.ndarray, t: Table, lanes: int = LANES) -> bytes:
    symbols = np.asarray(symbols)
    n = len(symbols)
    steps = -(-n // lanes)
    state = np.full(lanes, 1 << LOW_BITS, U)
    freq, start = t.freq[symbols], t.start[symbols]
    if n and not freq.all():
        raise ValueError("a symbol is not in the frequency table")
    limit = freq << U(LOW_BITS + 32 - SCALE_BITS)
    out: list[np.ndarray] = []
    written = 0
    marks: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        f, x = freq[at], state[: at.stop - at.start]
        full = x >= limit[at]
        if full.any():
            over = x[full]
            out.append((over & U(0xFFFFFFFF)).astype(np.uint32)[::-1])
            written += len(over)
            x[full] = over >> U(32)
        q = x // f
        x[:] = (q << U(SCALE_BITS)) + (x - q * f) + start[at]
        if step % CHECKPOINT_STEPS == 0:
            marks.append((written, state.copy()))
    if not steps:
        marks.append((0, state.copy()))
    stream = np.concatenate(out)[::-1] if out else np.empty(0, np.uint32)
    payload = b"".join(struct.pack("<I", written - w) + s.astype("<u8").tobytes() for w, s in reversed(marks))
    payload += stream.astype("<u4").tobytes()
    return _HEAD.pack(MAGIC, lanes, n, len(marks), written, zlib.crc32(payload)) + payload


def decode(block: bytes, t: Table, checkpoint: int = 0) -> np.ndarray:
    """The symbols from a checkpoint on (0: all of them)."""
    magic, lanes, n, marks, written, crc = _HEAD.unpack_from(block)
    payload = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(payload) != crc or not 0 <= checkpoint < marks:
        raise ValueError("not a whole block, or no such checkpoint")
    one = 4 + 8 * lanes
    place = struct.unpack_from("<I", payload, checkpoint * one)[0]
    state = np.frombuffer(payload, "<u8", lanes, checkpoint * one + 4).astype(U)
    stream = np.frombuffer(payload, "<u4", written, marks * one).astype(U)
    first = checkpoint * CHECKPOINT_STEPS
    steps = -(-n // lanes)
    out = np.empty(max(0, n - first * lanes), np.uint32)
    slots, freq, start = t.slots, t.freq, t.start
    mask, low = U((1 << SCALE_BITS) - 1), U(1 << LOW_BITS)
    for step in range(first, steps):
        width = min(n - step * lanes, lanes)
        x = state[:width]
        slot = x & mask
        s = slots[slot]
        out[(step - first) * lanes : (step - first) * lanes + width] = s
        x[:] = freq[s] * (x >> U(SCALE_BITS)) + slot - start[s]
        less = x < low
        k = int(less.sum())
        if k:
            x[less] = (x[less] << U(32)) | stream[place : place + k]
            place += k
    return out
