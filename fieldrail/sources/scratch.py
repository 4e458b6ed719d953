"""Tables and files that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; with a local master and none set, a temporary folder."""
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
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: nothing is left to clean with
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path; it goes when the driver's Python ends, as returned DataFrames may still read it."""
    path = f"{shared_dir(spark)}/fieldrail/{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rsplit("/", 1)[0])
    return path


def put(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: its lineage ends here."""
    path = folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
