"""Token ids in files of bit planes.

A file holds whole documents.  Its ids are cut into blocks of ``BLOCK`` ids; a block
is transposed into one plane a bit, each plane is packed and compressed with
zstandard, and a chunk index holds every plane's place, so that any stretch of ids is
read by decompressing its own blocks.

    magic "BITPLANE" | u32 version, ids a block, planes | u64 ids, documents, blocks
    | documents: i64 id, u64 ids (zstandard)  | chunk index: u32 sizes, a plane each (zstandard)
    | planes

Documents are dealt by ranges of their id and encoded in ascending order; a file is
closed when it has ``FILE_IDS`` ids, after a whole document.  Files are rows of a
written table (file, path, first id, ids, bytes): Spark's commit keeps them whole when
executors are lost, and any store that Spark writes can hold them.  export_files()
puts them down as files.

Defined results: null text is empty (it has the end id only); rows with a null id come
first; rows of one id follow each other in no further order; empty tables give no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch
from .text_tokens import text_tokens

MAGIC = b"BITPLANE"
BLOCK = 1 << 16
FILE_IDS = 1 << 22
_HEAD = struct.Struct("<8sIIIQQQII")


def write_file(ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, known: np.ndarray | None = None, level: int = 1) -> bytes:
    """One file of the ids of docs (ids, number of ids of each; known: whether the id isn't null)."""
    packer = zstandard.ZstdCompressor(level=level)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    kind = np.uint16 if planes <= 16 else np.uint32
    blocks = -(-len(ids) // BLOCK)
    index, body = np.zeros((blocks, planes), np.uint32), []
    for b in range(blocks):
        own = ids[b * BLOCK : (b + 1) * BLOCK].astype(kind)
        for p in range(planes):
            data = packer.compress(np.packbits((own & kind(1 << p)) != 0, bitorder="little").tobytes())
            index[b, p] = len(data)
            body.append(data)
    known = np.ones(len(docs), np.int64) if known is None else known.astype(np.int64)
    who = packer.compress(np.stack([docs, sizes, known], 1).astype("<i8").tobytes())
    where = packer.compress(index.tobytes())
    return b"".join([_HEAD.pack(MAGIC, 1, BLOCK, planes, len(ids), len(docs), blocks, len(who), len(where)), who, where, *body])


class PlaneFile:
    """Reads a file; only the blocks that are asked for are decompressed."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.block, self.planes, self.n_ids, n_docs, blocks, who, where = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a file of bit planes")
        reader = zstandard.ZstdDecompressor()
        at = _HEAD.size
        table = np.frombuffer(reader.decompress(data[at : at + who]), "<i8").reshape(n_docs, 3)
        self.docs, self.sizes, self.known = table[:, 0], table[:, 1], table[:, 2].astype(bool)
        at += who
        sizes = np.frombuffer(reader.decompress(data[at : at + where]), "<u4").astype(np.int64)
        self.at = at + where + np.r_[0, np.cumsum(sizes)]
        self.data, self.reader = data, reader

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids[start:stop] of the file."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block, -(-stop // self.block)):
            n = min(self.block, self.n_ids - b * self.block)
            own = np.zeros(n, np.uint16 if self.planes <= 16 else np.uint32)
            for p in range(self.planes):
                k = b * self.planes + p
                bits = np.unpackbits(np.frombuffer(self.reader.decompress(self.data[self.at[k] : self.at[k + 1]]), np.uint8), count=n, bitorder="little")
                own |= bits.astype(own.dtype) << own.dtype.type(p)
            out.append(own.astype(np.uint32))
        first = (start // self.block) * self.block
        return np.concatenate(out)[start - first : stop - first]


_FILES = "part int, file int, n_ids long, data binary"


def _encode(spec, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), text_tokens(spec.value)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        total = made = 0

        def close() -> pa.RecordBatch:
            nonlocal held, total, made
            ids, docs, sizes, known = (np.concatenate(x) for x in zip(*held))
            data = write_file(ids, docs, sizes, known)
            held, total, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made - 1], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "file", "n_ids", "data"])

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            docs = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, offsets = K.texts(batch.column(1))
            for lo, hi in K.groups(offsets, min(4 << 20, 2 * file_ids)):
                ids, first = tokens.encode(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out = np.insert(ids, first[1:], end_id).astype(np.uint32)
                held.append((out, docs[lo:hi], np.diff(first) + 1, known[lo:hi]))
                total += len(out)
                if total >= file_ids:
                    yield close()
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, scratch: Scratch, end_id: int = 1, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of files (part, file, n_ids, data), in the order of (part, file)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = slim.repartitionByRange("id").sortWithinPartitions("id")
    return scratch.put("files", dealt.mapInArrow(_encode(spec, end_id, file_ids), _FILES))


def starts(files: DataFrame) -> DataFrame:
    """(part, file, start): the ids of all files before."""
    # one number a range: as many as partitions
    sums = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    total, rows = 0, []
    for part in sorted(sums):
        rows.append((part, total))
        total += sums[part]
    bases = files.sparkSession.createDataFrame(rows, "part int, base long")
    before = files.select("part", "file", "n_ids").join(F.broadcast(bases), "part")
    own = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return before.select("part", "file", (F.col("base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            file = PlaneFile(data.as_py())
            first = np.r_[0, np.cumsum(file.sizes)]
            crcs, step = [], 1 << 14
            for lo in range(0, len(file.sizes), step):  # documents of some blocks at a time
                hi = min(lo + step, len(file.sizes))
                raw = file.ids(int(first[lo]), int(first[hi])).astype("<u4").tobytes()
                edge = (4 * (first[lo : hi + 1] - first[lo])).tolist()
                crcs += [zlib.crc32(raw[a:b]) for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(file.docs, pa.int64(), mask=~file.known), pa.array(first[:-1], pa.int64()), pa.array(file.sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(np.full(len(crcs), part, np.int32)), pa.array(np.full(len(crcs), number, np.int32))], ["id", "local", "n_tokens", "ids_crc32", "part", "file"])


def read_report(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    read = files.select("part", "file", "data").mapInArrow(_read, "id long, local long, n_tokens long, ids_crc32 long, part int, file int")
    placed = read.join(starts(files), ["part", "file"])
    return placed.select(F.col("id").alias(id_col), (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> int:
    """Tasks put the files down in a folder that all executors have at this path; returns how many.

    A file gets its name when it is whole, so a task that runs again does no harm.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                path = Path(folder, f"ids-{part:05d}-{number:05d}.bitplane")
                own = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
                own.write_bytes(data.as_py())
                own.replace(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    return files.select("part", "file", "data").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
