"""Plumbing of the corpus operators: shared scratch tables and packed arrays."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Bytes of a row group of a scratch table: what a writing task holds.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs in this process alone (local tests) an own
    temporary one is set; executors elsewhere would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="fieldrail-")
    spark.sparkContext.setCheckpointDir(_OWN["dir"])
    return _OWN["dir"]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: nothing is left to clean with
        pass


class Scratch:
    """Tables written under the shared folder; they cut lineage and outlive executors.

    ``drop`` removes one that is no longer read; the rest goes when the driver's
    Python ends, as returned DataFrames may still read them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/fieldrail/{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.base)

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _remove(self.spark, f"{self.base}/{name}")

    def close(self) -> None:
        _remove(self.spark, self.base)


def give_back() -> None:
    """Free memory of this Python worker goes back to the system: workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives free memory back when it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def trimmed_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of two groups that gives free memory back when it ends."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        give_back()
        return out

    return group


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """zstandard over byte planes: high bytes of small values cost nothing."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T if len(raw) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have (names are compared without case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashes(known: DataFrame, n: int) -> list[int]:
    """The n ids with the smallest hashes, in that order.

    Hashes are even, so below a bound that some 2 n + 100 rows reach there are n (but for a chance
    of less than 1e-100); no task sends more than those few rows.
    """
    by, rows = F.xxhash64("id"), known.count()
    if rows > 2 * n + 100:
        known = known.filter(by < int(-(2**63) + 2**64 * ((2 * n + 100) / rows)))
    return [r.id for r in known.orderBy(by, "id").limit(n).collect()]


def blank(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))
