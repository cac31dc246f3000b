"""Matroska columns: write and parse files held in a binary column.

The writer makes a file of one track of 8-bit PCM samples: EBML header, Segment with
Info, Tracks, Clusters of laced SimpleBlocks, and Cues. The parser reads any file of
that shape from its bytes alone: variable-length ids and sizes (unknown sizes of
Segment and Cluster included), all four lacings, and cues, into a table of packets.

A packet is one frame: (track, timestamp in ticks, keyframe, lacing, offset, size), where
offset and size give the frame's byte range in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.session import ship, table
from stratalog.llm.words import slices

# Element ids of the Matroska and EBML specifications.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

#: One tick of a timestamp is a millisecond; a unit of 192 samples at 48 kHz lasts 4 ticks.
TICK_NS, RATE, UNIT, UNIT_TICKS = 1_000_000, 48_000, 192, 4
#: Units of a frame, frames of a block, blocks of a cluster. A cluster stays below 2**15 ticks.
FRAME_UNITS, BLOCK_FRAMES, CLUSTER_BLOCKS = 10, 8, 64


def element_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; the value of all ones means unknown and is never written for a known size."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(i: int, *payload: bytes) -> bytes:
    body = b"".join(payload)
    return element_id(i) + size_bytes(len(body)) + body


def uint(i: int, value: int) -> bytes:
    return element(i, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing of a block's frames, and its bytes: fixed where sizes agree, else by size differences."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED_LACING, bytes([len(frames) - 1]) + b"".join(frames)
    head = bytes([len(frames) - 1]) + size_bytes(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        head += signed_size(b - a)
    return EBML_LACING, head + b"".join(frames)


def signed_size(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return size_bytes(n + (1 << 7 * width - 1) - 1, width)


def write(samples: bytes) -> bytes:
    """A Matroska file whose frames, one after the other, are ``samples`` (a multiple of 192 bytes)."""
    if len(samples) % UNIT or not samples:
        raise ValueError(f"the samples must be a positive multiple of {UNIT}")
    frame = UNIT * FRAME_UNITS
    frames = [samples[i : i + frame] for i in range(0, len(samples), frame)]
    head = element(
        EBML, uint(EBML_VERSION, 1), uint(EBML_READ_VERSION, 1), uint(EBML_MAX_ID, 4), uint(EBML_MAX_SIZE, 8),
        element(DOC_TYPE, b"matroska"), uint(DOC_TYPE_VERSION, 4), uint(DOC_TYPE_READ_VERSION, 2),
    )
    app = b"stratalog"
    ticks = len(samples) // UNIT * UNIT_TICKS
    parts = [element(INFO, uint(TIMESTAMP_SCALE, TICK_NS), element(DURATION, struct.pack(">d", ticks)), element(MUXING_APP, app), element(WRITING_APP, app))]
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)), uint(CHANNELS, 1), uint(BIT_DEPTH, 8))
    entry = element(
        TRACK_ENTRY, uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(FLAG_LACING, 1),
        uint(DEFAULT_DURATION, FRAME_UNITS * UNIT_TICKS * TICK_NS), element(CODEC_ID, b"A_PCM/INT/LIT"), audio,
    )
    parts.append(element(TRACKS, entry))
    place, cues = sum(map(len, parts)), []
    per_cluster = BLOCK_FRAMES * CLUSTER_BLOCKS
    for first in range(0, len(frames), per_cluster):
        time = first * FRAME_UNITS * UNIT_TICKS
        body = [uint(CLUSTER_TIMESTAMP, time)]
        for at in range(first, min(len(frames), first + per_cluster), BLOCK_FRAMES):
            lacing, payload = lace(frames[at : at + BLOCK_FRAMES])
            relative = (at - first) * FRAME_UNITS * UNIT_TICKS
            body.append(element(SIMPLE_BLOCK, size_bytes(1), struct.pack(">hB", relative, 0x80 | lacing << 1), payload))
        cluster = element(CLUSTER, *body)
        cues.append(element(CUE_POINT, uint(CUE_TIME, time), element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER_POSITION, place))))
        place += len(cluster)
        parts.append(cluster)
    parts.append(element(CUES, *cues))
    return head + element(SEGMENT, *parts)


@dataclass
class Parsed:
    doc_type: str = ""
    tick_ns: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def read_number(data: memoryview, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """A variable-length number, the place after it, and whether all its bits are set."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length number at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    plain = value & (1 << 7 * width) - 1
    return (value if keep_marker else plain), at + width, plain == (1 << 7 * width) - 1


def children(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range. One of unknown size ends where its parent does or, for a
    cluster, where the next top-level element begins."""
    while at < end:
        i, at, _ = read_number(data, at, True)
        size, at, unknown = read_number(data, at, False)
        stop = end if unknown else at + size
        if unknown and i == CLUSTER:
            stop = at
            while stop < end:
                j, body, _ = read_number(data, stop, True)
                if j in (CLUSTER, CUES, INFO, TRACKS):
                    break
                n, body, _ = read_number(data, body, False)
                stop = body + n
        if stop > end:
            raise ValueError(f"the element at {at} is longer than its parent")
        yield i, at, stop
        at = stop


def number(data: memoryview, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def frame_sizes(data: memoryview, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if lacing == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH_LACING:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            size, at, _ = read_number(data, at, False)
            if k:
                size += sizes[-1] - (1 << 7 * (at - before) - 1) + 1
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced sizes beyond the block")
    return [*sizes, last], at


def parse(file: bytes) -> Parsed:
    data, out = memoryview(file), Parsed()

    def block(at: int, end: int, time: int, simple: bool) -> None:
        track, at, _ = read_number(data, at, False)
        relative, flags = struct.unpack_from(">hB", data, at)
        lacing = flags >> 1 & 3
        sizes, at = frame_sizes(data, at + 3, end, lacing)
        step = out.tracks.get(track, {}).get("default_duration", 0) // max(1, out.tick_ns)
        for k, size in enumerate(sizes):
            out.packets.append((track, time + relative + k * step, bool(flags & 0x80) if simple else False, lacing, at, size))
            at += size

    def cluster(at: int, end: int) -> None:
        time = 0
        for i, a, b in children(data, at, end):
            if i == CLUSTER_TIMESTAMP:
                time = number(data, a, b)
            elif i == SIMPLE_BLOCK:
                block(a, b, time, True)
            elif i == BLOCK_GROUP:
                for j, c, d in children(data, a, b):
                    if j == BLOCK:
                        block(c, d, time, False)

    for i, a, b in children(data, 0, len(data)):
        if i == EBML:
            for j, c, d in children(data, a, b):
                if j == DOC_TYPE:
                    out.doc_type = bytes(data[c:d]).decode()
        elif i == SEGMENT:
            for j, c, d in children(data, a, b):
                if j == INFO:
                    for k, e, f in children(data, c, d):
                        if k == TIMESTAMP_SCALE:
                            out.tick_ns = number(data, e, f)
                elif j == TRACKS:
                    for k, e, f in children(data, c, d):
                        if k == TRACK_ENTRY:
                            own = {x: (y, z) for x, y, z in children(data, e, f)}
                            out.tracks[number(data, *own[TRACK_NUMBER])] = {
                                "type": number(data, *own[TRACK_TYPE]), "codec": bytes(data[slice(*own[CODEC_ID])]).decode(),
                                "default_duration": number(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0,
                            }
                elif j == CLUSTER:
                    cluster(c, d)
                elif j == CUES:
                    for k, e, f in children(data, c, d):
                        if k == CUE_POINT:
                            point = {x: (y, z) for x, y, z in children(data, e, f)}
                            for x, y, z in children(data, *point[CUE_TRACK_POSITIONS]):
                                if x == CUE_TRACK:
                                    track = number(data, y, z)
                                elif x == CUE_CLUSTER_POSITION:
                                    out.cues.append((number(data, *point[CUE_TIME]), track, a + number(data, y, z)))
    return out


def samples_of(file: bytes, parsed: Parsed) -> bytes:
    return b"".join([file[at : at + size] for *_, at, size in parsed.packets])


def features(samples: bytes, parsed: Parsed) -> str:
    """Packets, cues, mean and root mean square of the samples (in thousandths), and crossings of their middle."""
    x = np.frombuffer(samples, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.bincount(x, minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    high = x >= 128
    n = max(1, len(x))
    return f"packets={len(parsed.packets)};cues={len(parsed.cues)};mean={total * 1000 // n};rms={int((squares / n) ** 0.5 * 1000)};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, packet, track, timestamp, keyframe, lacing, offset, size, error) of every file of a binary column.

    A null file has no packets. One that isn't whole has a single row, of its key and what is wrong with it.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, file in zip(batch.column(0), batch.column(1)):
                if not file.is_valid:
                    continue
                error = None
                try:
                    packets = [(i, *p) for i, p in enumerate(parse(file.as_py()).packets)]
                except (ValueError, LookupError, struct.error) as e:
                    packets, error = [(None,) * (1 + len(_PACKET))], f"{type(e).__name__}: {e}"
                if packets:
                    columns = [pa.array(c, t) for c, t in zip(zip(*packets), (pa.int64(), *_PACKET))]
                    yield pa.record_batch([pa.array([k.as_py()] * len(packets), k.type), *columns, pa.array([error] * len(packets), pa.string())], _PACKET_NAMES)

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, f"key {kind}, packet long, track long, timestamp long, keyframe boolean, lacing long, offset long, size long, error string")


_PACKET = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
_PACKET_NAMES = ["key", "packet", "track", "timestamp", "keyframe", "lacing", "offset", "size", "error"]


def store(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): every whole text as a Matroska file. A null text counts as empty, and gets one unit of blanks."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, 1 << 20):
                raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([rows.column("key"), pa.array(map(len, raw), pa.int64()), pa.array([write(padded(x)) for x in raw], pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests and features of the samples that the packets of each stored file hold."""
    ship(stored.sparkSession)

    def one(key: int | None, n_bytes: int, file: bytes) -> tuple:
        parsed = parse(file)
        payload = samples_of(file, parsed)
        return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), features(payload, parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, files = (batch.column(c) for c in ("key", "n_bytes", "media"))
            for at in range(0, batch.num_rows, 256):
                rows = [one(k.as_py(), n.as_py(), f.as_py()) for k, n, f in zip(keys[at : at + 256], sizes[at : at + 256], files[at : at + 256])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (f.type for f in _DIGEST))], schema=_DIGEST)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a Matroska file, read back from its packets."""
    return read_back(store(table(spark, sf_dir, "documents")))
