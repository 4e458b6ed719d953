"""What streams do: a table of their progress, and duplicates dropped before they reach a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run string, query string, batch long, stage string, moment string, input_rows long, output_rows long, state_rows long, dropped_late long, watermark string, millis long, error string"


class ProgressTable(StreamingQueryListener):
    """Writes one small JSON file an event under ``folder`` (any file system that Spark knows); read_progress() reads them.

    Stages: STARTED, PROGRESS a micro-batch, IDLE, and COMPLETED or FAILED at the end.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.count = spark, folder.rstrip("/"), {}

    def _put(self, run: str, **row: object) -> None:
        k = self.count[run] = self.count.get(run, 0) + 1
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{run}-{k:08d}.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(json.dumps({"run": run, **row}).encode()))
        finally:
            out.close()

    def onQueryStarted(self, event: object) -> None:
        self._put(str(event.runId), query=event.name, stage="STARTED", moment=event.timestamp)

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        ops = p.stateOperators or []
        self._put(
            str(p.runId), query=p.name, stage="PROGRESS", moment=p.timestamp, batch=p.batchId, input_rows=p.numInputRows, output_rows=p.sink.numOutputRows if p.sink else None, millis=(p.durationMs or {}).get("triggerExecution"),
            state_rows=sum(o.numRowsTotal for o in ops), dropped_late=sum(o.numRowsDroppedByWatermark for o in ops), watermark=(p.eventTime or {}).get("watermark"),
        )

    def onQueryIdle(self, event: object) -> None:
        self._put(str(event.runId), stage="IDLE", moment=event.timestamp)

    def onQueryTerminated(self, event: object) -> None:
        self._put(str(event.runId), stage="FAILED" if event.exception else "COMPLETED", error=(event.exception or "")[:200] or None)


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The events that were written, as one table; an empty one before the first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(folder)


def stage_table(progress: DataFrame) -> DataFrame:
    """(run, query, stage, batches, input_rows, state_rows, dropped_late, millis, error): where each stream is and what it did."""
    c = F.col
    order = F.when(c("stage").isin("COMPLETED", "FAILED"), 2).when(c("stage") == "STARTED", 0).otherwise(1)
    moved = c("stage") == "PROGRESS"
    return progress.withColumn("_o", F.struct(order, F.coalesce("batch", F.lit(-1)))).groupBy("run").agg(
        F.max("query").alias("query"), F.max_by("stage", "_o").alias("stage"), F.count_distinct(F.when(moved, c("batch"))).alias("batches"), F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"), F.max_by("state_rows", F.when(moved, c("batch"))).alias("state_rows"),
        F.coalesce(F.sum("dropped_late"), F.lit(0)).alias("dropped_late"), F.coalesce(F.sum("millis"), F.lit(0)).alias("millis"), F.max("error").alias("error"),
    )


def first_of_each(stream: DataFrame, keys: list[str], moment: str, late: str = "1 day") -> DataFrame:
    """A stream's first row of each key within ``late`` of it: what append_once keeps, from bounded state and without reading the table.

    A repetition that comes later than that isn't known any more; append_stream still finds it.
    """
    return stream.withWatermark(moment, late).dropDuplicatesWithinWatermark(keys)
