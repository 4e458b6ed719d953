"""Matroska: texts as 8-bit audio, and files read back into packet tables.

mux() writes one track of unsigned 8-bit PCM (one byte is one sample) as clusters of
SimpleBlocks, with fixed-size lacing for full blocks, and cues.  demux() reads any
file of EBML elements: sizes of 1 to 8 bytes, unknown sizes of segments and clusters,
SimpleBlocks and BlockGroups, and no, Xiph, EBML and fixed lacing.  Each frame is a
packet: track, timestamp, keyframe, byte range in the file.

Defined results: null text is empty; payloads are padded with zeros to a positive
multiple of 64 bytes; equal texts give equal files; truncated or foreign bytes raise
ValueError; repeated rows are stored each; any id column passes through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

# Element ids of the Matroska specification: fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x114D9B74
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, DURATION, CODEC, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SAMPLE_RATE = 64_000  # a frame of 64 samples is a millisecond, the unit of timestamps
FRAME, LACED, BLOCKS = 64, 128, 4  # bytes of a frame, frames of a block, blocks of a cluster


def _vint(n: int) -> bytes:
    size = 1
    while n >= (1 << (7 * size)) - 1:
        size += 1
    return (n | 1 << (7 * size)).to_bytes(size, "big")


def _element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _number(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(0x4282, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
_SETUP = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(0x4D80, b"fieldrail") + _element(0x5741, b"fieldrail")) + _element(
    TRACKS,
    _element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(0x73C5, 1) + _number(TRACK_TYPE, 2) + _number(0x9C, 1) + _number(DURATION, 1_000_000) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, struct.pack(">d", SAMPLE_RATE)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))),
)


def mux(payload: bytes) -> bytes:
    """A file of the payload's bytes as samples; the payload is a positive multiple of 64 bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    clusters, cues, at = [], [], len(_SETUP)
    per_block, per_cluster = FRAME * LACED, FRAME * LACED * BLOCKS
    for start in range(0, len(payload), per_cluster):
        blocks = []
        for a in range(start, min(start + per_cluster, len(payload)), per_block):
            data = payload[a : min(a + per_block, len(payload))]
            frames = len(data) // FRAME
            head = b"\x81" + struct.pack(">h", (a - start) // FRAME)
            # keyframe; fixed-size lacing where a block has several frames
            blocks.append(_element(SIMPLE_BLOCK, head + (b"\x84" + bytes([frames - 1]) if frames > 1 else b"\x80") + data))
        cluster = _element(CLUSTER, _number(TIMESTAMP, start // FRAME) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, start // FRAME) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        clusters.append(cluster)
        at += len(cluster)
    return _HEAD + _element(SEGMENT, _SETUP + b"".join(clusters) + _element(CUES, b"".join(cues)))


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    duration: int = 0  # of a frame, in nanoseconds
    rate: float = 0.0
    channels: int = 1
    bits: int = 0


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)  # track, timestamp, key, start, stop
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, file offset of the cluster
    clusters: list[int] = field(default_factory=list)


def _read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """(value, next place, whether all value bits are set)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise ValueError("the file ends inside a number")
    raw = int.from_bytes(data[at : at + size], "big")
    value = raw & ((1 << (7 * size)) - 1)
    return raw if keep else value, at + size, value == (1 << (7 * size)) - 1


def elements(data: bytes, at: int, stop: int, until: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, stop) of the elements; ends before an id of ``until``.

    An unknown size reaches to the end of what holds the element.
    """
    while at < stop:
        name, body, _ = _read_vint(data, at, keep=True)
        if name in until:
            return
        size, body, unknown = _read_vint(data, body)
        end = stop if unknown else body + size
        if end > stop:
            raise ValueError(f"element {name:X} at byte {at} reaches over its end")
        if unknown and name == CLUSTER:
            end = _cluster_end(data, body, stop)
        yield name, body, end
        at = end


_TOP = frozenset((CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, SEGMENT, EBML))


def _cluster_end(data: bytes, at: int, stop: int) -> int:
    end = at
    for _, _, end in elements(data, at, stop, _TOP):
        pass
    return end


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def lace(data: bytes, at: int, stop: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's body. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, stop)]
    if at >= stop:
        raise ValueError("a laced block has no frame count")
    count, at = data[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(stop - at, count)
        if rest:
            raise ValueError("fixed-size lacing doesn't divide the block")
        return [(at + i * size, at + (i + 1) * size) for i in range(count)]
    sizes = []
    for i in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            value, after, _ = _read_vint(data, at)
            # all but the first are differences, shifted to be positive
            size = value if i == 0 else sizes[-1] + value - ((1 << (7 * (after - at) - 1)) - 1)
            at = after
        sizes.append(size)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames reach over their block")
    edge = np.cumsum([at, *sizes]).tolist()
    return list(zip(edge[:-1], edge[1:]))


def _block(data: bytes, a: int, b: int, base: int, media: Media, key: bool | None) -> None:
    track, at, _ = _read_vint(data, a)
    if at + 3 > b:
        raise ValueError("a block ends inside its head")
    time = base + struct.unpack_from(">h", data, at)[0]
    flags = data[at + 2]
    step = media.tracks[track].duration / media.scale if track in media.tracks else 0
    for i, (x, y) in enumerate(lace(data, at + 3, b, flags >> 1 & 3)):
        media.packets.append((track, time + round(i * step), bool(flags & 0x80) if key is None else key, x, y))


def demux(data: bytes) -> Media:
    """Tracks, packets and cues of a file."""
    media = Media()
    names = list(elements(data, 0, len(data)))
    if not names or names[0][0] != EBML or all(n != SEGMENT for n, *_ in names):
        raise ValueError("not an EBML file with a segment")
    for name, a, b in names:
        if name != SEGMENT:
            continue
        for name, x, y in elements(data, a, b):
            if name == INFO:
                for n, p, q in elements(data, x, y):
                    media.scale = _uint(data, p, q) if n == TIMESTAMP_SCALE else media.scale
            elif name == TRACKS:
                for n, p, q in elements(data, x, y):
                    if n == TRACK_ENTRY:
                        _track(data, p, q, media)
            elif name == CLUSTER:
                # the element's own first byte: its id and size stand before its body
                media.clusters.append(x)
                base = 0
                for n, p, q in elements(data, x, y):
                    if n == TIMESTAMP:
                        base = _uint(data, p, q)
                    elif n == SIMPLE_BLOCK:
                        _block(data, p, q, base, media, None)
                    elif n == BLOCK_GROUP:
                        inner = list(elements(data, p, q))
                        for m, s, t in inner:
                            if m == BLOCK:
                                _block(data, s, t, base, media, all(k != REFERENCE for k, *_ in inner))
            elif name == CUES:
                for n, p, q in elements(data, x, y):
                    if n == CUE_POINT:
                        _cue(data, p, q, a, media)
    return media


def _track(data: bytes, a: int, b: int, media: Media) -> None:
    t = Track()
    for n, p, q in elements(data, a, b):
        if n == TRACK_NUMBER:
            t.number = _uint(data, p, q)
        elif n == TRACK_TYPE:
            t.kind = _uint(data, p, q)
        elif n == DURATION:
            t.duration = _uint(data, p, q)
        elif n == CODEC:
            t.codec = data[p:q].decode("ascii", "replace")
        elif n == AUDIO:
            for m, s, e in elements(data, p, q):
                if m == RATE:
                    t.rate = _float(data, s, e)
                elif m == CHANNELS:
                    t.channels = _uint(data, s, e)
                elif m == BIT_DEPTH:
                    t.bits = _uint(data, s, e)
    media.tracks[t.number] = t


def _cue(data: bytes, a: int, b: int, segment: int, media: Media) -> None:
    time, spots = 0, []
    for n, p, q in elements(data, a, b):
        if n == CUE_TIME:
            time = _uint(data, p, q)
        elif n == CUE_POSITIONS:
            own = {m: _uint(data, s, e) for m, s, e in elements(data, p, q)}
            spots.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0)))
    media.cues += [(time, track, segment + place) for track, place in spots]


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets."""
    return b"".join(data[a:b] for t, _, _, a, b in media.packets if t == track)


def feature(media: Media, payload: bytes) -> str:
    """packets|clusters|cues|milliseconds|rms of the samples around their middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    length = len(payload) / SAMPLE_RATE * 1000
    return f"{len(media.packets)}|{len(media.clusters)}|{len(media.cues)}|{length:.3f}|{np.sqrt((x * x).mean()):.6f}"


def _payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % FRAME or (0 if text else FRAME))


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a file."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = K.texts(batch.column(1))
            for lo, hi in K.groups(offsets, 4 << 20):
                edge = offsets[lo : hi + 1].tolist()
                made = [mux(_payload(buf[a:b].tobytes())) for a, b in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(made, pa.binary())], schema.names)

    return slim.mapInArrow(run, schema)


def media_report(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each file read and described by what was read."""
    kinds = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    schema = T.StructType([T.StructField(id_col, files.schema[id_col].dataType), *(T.StructField(n, k) for n, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                stored = data.as_py()
                media = demux(stored)
                back = samples(stored, media)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media, back)))
            columns = zip(*rows) if rows else ([] for _ in range(6))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, types))], schema.names)

    return files.select(id_col, "n_bytes", "media").mapInArrow(run, schema)


def packet_table(files: DataFrame, data_col: str = "content", id_col: str = "path") -> DataFrame:
    """A row for each packet of Matroska files (a binary column); files that can't be read have an error row."""
    slim = files.select(F.col(id_col), F.col(data_col))
    kinds = [("track", T.LongType()), ("codec", T.StringType()), ("timestamp_ns", T.LongType()), ("keyframe", T.BooleanType()), ("start", T.LongType()), ("stop", T.LongType()), ("error", T.StringType())]
    schema = T.StructType([T.StructField(id_col, files.schema[id_col].dataType), *(T.StructField(*k) for k in kinds)])
    types = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                raw = data.as_py() or b""
                try:
                    media = demux(raw)
                    codecs = {n: t.codec for n, t in media.tracks.items()}
                    rows = [(t, codecs.get(t), time * media.scale, key, a, b, None) for t, time, key, a, b in media.packets]
                except (ValueError, IndexError, struct.error) as bad:
                    rows = [(None, None, None, None, None, None, str(bad))]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], schema.names)

    return slim.mapInArrow(run, schema)
