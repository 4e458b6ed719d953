"""SentencePiece models in the tokenizers library: encoding, decoding, parity.

The model file is read as protobuf wire format here; normaliser, the marker for
spaces, scores (unigram) or merges (BPE) and byte fallback are rebuilt with the
tokenizers library, which encodes batches on several threads.

Where no piece has a space marker after another character, pieces never reach over
the begin of a run of spaces.  Then a text is encoded as the runs of spaces with the
characters up to the next one, each distinct run once; otherwise, and for models that
normalise, whole texts are encoded.  Parity with the sentencepiece library is checked
on everything that the model is given.

Defined results: null and empty texts have no ids; repeated rows are encoded each;
any id column passes through; empty tables give empty ones.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import trimmed
from .span_memo import SpanMemo, flat

MARK = "▁"
#: Distinct spans that a worker remembers.
REMEMBERED = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_space: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    unk_surface: str = " ⁇ "

    @property
    def splits(self) -> bool:
        """Whether texts may be cut before runs of spaces."""
        inner = any(MARK in p.lstrip(MARK) for p in self.pieces)
        return not (inner or self.charsmap or self.squeeze or self.suffix_space)


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.types.append(kind)
        elif number == 2:
            own = dict(_fields(value))
            m.kind = own.get(3, UNIGRAM)
            m.byte_fallback = bool(own.get(35, 0))
            m.suffix_space = bool(own.get(24, 0))
            m.unk_surface = own[44].decode() if 44 in own else m.unk_surface
        elif number == 3:
            own = dict(_fields(value))
            m.charsmap = own.get(2, b"")
            m.dummy_prefix = bool(own.get(3, 1))
            m.squeeze = bool(own.get(4, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    return m


def _core(m: Model):
    from tokenizers import models

    unk = m.types.index(UNKNOWN)
    if m.kind == UNIGRAM:
        return models.Unigram(list(zip(m.pieces, m.scores)), unk_id=unk, byte_fallback=m.byte_fallback)
    rank = {p: i for i, p in enumerate(m.pieces)}
    usable = {p for p, k in zip(m.pieces, m.types) if k in (NORMAL, USER)}
    joins = []
    for piece in usable:
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in usable and right in usable:
                joins.append((-m.scores[rank[piece]], rank[left], rank[right], left, right))
    joins.sort()
    return models.BPE(rank, [(a, b) for *_, a, b in joins], unk_token=m.pieces[unk], fuse_unk=True, byte_fallback=m.byte_fallback)


def rebuild(m: Model, bare: bool = False):
    """A tokenizers.Tokenizer; bare: without the steps that only a whole text has."""
    from tokenizers import Regex, Tokenizer, decoders, normalizers

    out = Tokenizer(_core(m))
    if bare:
        out.normalizer = normalizers.Replace(" ", MARK)
    else:
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    last = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return out


def surfaces(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of what each id stands for in a text."""
    rows = []
    for piece, kind in zip(m.pieces, m.types):
        if kind == BYTE:
            rows.append(bytes([int(piece[3:5], 16)]))
        elif kind == UNKNOWN:
            rows.append(m.unk_surface.encode())
        else:
            rows.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


@lru_cache(maxsize=2)
def codec_of(data: bytes, parity: bool = False) -> Codec:
    """One for each model in a Python worker: what it has learned stays for the next task."""
    return Codec(data, parity)


class Codec:
    """Encodes and decodes batches."""

    def __init__(self, data: bytes, parity: bool = False) -> None:
        self.model = parse(data)
        self.whole = rebuild(self.model)
        self.bare = rebuild(self.model, bare=True)
        self.other = None
        if parity:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.unlike: set[bytes] = set()
        self.memo = SpanMemo(self._spans, REMEMBERED)
        self.surface = surfaces(self.model)

    def _spans(self, spans: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        ids = [e.ids for e in self.bare.encode_batch_fast(spans, add_special_tokens=False)]
        if self.other:
            # the library puts the dummy prefix before the text itself; a text of nothing else has no ids there
            lone = self.other.encode("a ")[len(self.other.encode("a")) :]
            for span, own, want in zip(spans, ids, self.other.encode([s[1:] for s in spans], num_threads=1)):
                if own != (lone if span == " " else want):
                    self.unlike.add(span.encode())
        return spans, *flat(ids)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text, parity of each text)."""
        n = len(offsets) - 1
        alike = np.ones(n, bool)
        if not (self.model.splits and self.model.dummy_prefix):
            raw = buf.tobytes()
            own = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
            lists = [e.ids for e in self.whole.encode_batch(own, add_special_tokens=False)]
            lists = [x if t else [] for x, t in zip(lists, own)]
            if self.other:
                alike = np.array([a == b for a, b in zip(lists, self.other.encode(own, num_threads=1))], bool)
            return np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)]), alike
        size = np.diff(offsets)
        full = size > 0
        # the dummy prefix is one more space before every text
        flat = np.full(len(buf) + int(full.sum()), 0x20, np.uint8)
        shift = np.cumsum(full)
        first = offsets + np.r_[0, shift]
        flat[np.arange(len(buf)) + np.repeat(shift, size)] = buf
        space = flat == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[first[:-1][full]] = True
        starts = np.flatnonzero(begin)
        ids, count = self.memo.spans(flat, starts, np.r_[starts[1:], len(flat)])
        before = np.r_[0, np.cumsum(count)]
        span = np.searchsorted(starts, first)
        if self.unlike:
            raw, ends = flat.tobytes(), np.r_[starts[1:], len(flat)]
            for i in range(n):
                alike[i] = not any(raw[a:b] in self.unlike for a, b in zip(starts[span[i] : span[i + 1]], ends[span[i] : span[i + 1]]))
        return ids, before[span], alike

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts whose ids are ids[first[i] : first[i + 1]]."""
        data, at = self.surface
        size = at[ids + 1] - at[ids]
        out = data[K.ranges(at[ids], size)]
        edge = np.r_[0, np.cumsum(size)][first]
        if not self.model.dummy_prefix:
            return out, edge
        drop = edge[:-1][(np.diff(edge) > 0)]
        drop = drop[out[drop] == 0x20]
        keep = np.ones(len(out), bool)
        keep[drop] = False
        return out[keep], edge - np.searchsorted(drop, edge)


def crcs(ids: np.ndarray, first: np.ndarray) -> list[int]:
    raw = ids.astype("<u4").tobytes()
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def encode(docs: DataFrame, model_path: str, ids: bool = True, parity: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, parity, round_trip[, ids]) a row; parity is null if it isn't asked for."""
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    slim = docs.select(F.col(id_col), F.col(text_col))
    kinds = [("n_tokens", T.LongType()), ("ids_crc32", T.LongType()), ("parity", T.BooleanType()), ("round_trip", T.BooleanType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*k) for k in kinds)])
    if ids:
        schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, parity)
        for batch in batches:
            buf, offsets = K.texts(batch.column(1))
            for lo, hi in K.groups(offsets, 2 << 20):
                part, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                out, first, alike = codec.encode(part, off)
                back, edge = codec.decode(out, first)
                same = np.array_equal(edge, off) and np.array_equal(back, part)
                trip = [True] * (hi - lo) if same else [np.array_equal(back[a:b], part[c:d]) for a, b, c, d in zip(edge[:-1], edge[1:], off[:-1], off[1:])]
                arrays = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(crcs(out, first), pa.int64()), pa.array(alike if parity else [None] * (hi - lo), pa.bool_()), pa.array(trip, pa.bool_())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(first.astype(np.int32), out))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return slim.mapInArrow(trimmed(run), schema)


def decode(frame: DataFrame, model_path: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """frame with the text of its id lists; a null list is an empty text."""
    with open(model_path, "rb") as file:
        shared = frame.sparkSession.sparkContext.broadcast(file.read())
    at = frame.columns.index(ids_col)
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            lists = [np.asarray(x or [], np.int64) for x in batch.column(at).to_pylist()]
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            out, edge = codec.decode(flat, np.cumsum([0, *map(len, lists)]))
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw[a:b].decode(errors="replace") for a, b in zip(edge[:-1], edge[1:])], pa.string())], schema.names)

    return frame.mapInArrow(trimmed(run), schema)
