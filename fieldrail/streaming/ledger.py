"""The ledger as a stream: idempotent appends, running summaries, spend budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.records import append_once


def append_stream(stream: DataFrame, table: str, keys: list[str], checkpoint: str, day: str | None = None) -> StreamingQuery:
    """Appends rows whose key the table doesn't have yet; a repeated batch adds nothing.

    day: a date column that goes with the key; the table is then written by day, and a batch reads the
    days that it has rows of, not the whole table.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(table)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        old = spark.read.schema(batch.schema).parquet(table) if there else spark.createDataFrame([], batch.schema)
        if day:
            days = [r[0] for r in batch.select(day).distinct().collect()]  # days of one batch
            old = old.filter(F.col(day).isin(*days) | (F.col(day).isNull() if None in days else F.lit(False)))
        new = append_once(old, batch, keys).write.mode("append")
        (new.partitionBy(day) if day else new).parquet(table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_summary(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Calls and cost by operation and time window, with a watermark for late rows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "operation").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


class Budget(StatefulProcessor):
    """Decides calls of a session in time order: duplicates are reused, then counts and money are limited."""

    def __init__(self, most_calls: int, most_usd: float) -> None:
        self.most_calls, self.most_usd = most_calls, most_usd

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "calls long, usd double")
        self.seen = handle.getMapState("seen", "fingerprint string", "usd double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        calls, usd = self.spent.get() if self.spent.exists() else (0, 0.0)
        for frame in rows:
            out = []
            for row in frame.sort_values(["ts", "call_id"]).itertuples():
                if self.seen.containsKey((row.fingerprint,)):
                    decision = "REUSED_CACHED_RESULT"
                elif calls >= self.most_calls:
                    decision = "BLOCKED_CALL_COUNT"
                elif usd + row.cost_usd > self.most_usd:
                    decision = "BLOCKED_SESSION_BUDGET"
                else:
                    decision, calls, usd = "ALLOW", calls + 1, usd + row.cost_usd
                    self.seen.updateValue((row.fingerprint,), (row.cost_usd,))
                out.append((key[0], row.call_id, decision, usd))
            self.spent.update((calls, usd))
            yield pd.DataFrame(out, columns=["session", "call_id", "decision", "spent_usd"])

    def close(self) -> None:
        pass


DECISIONS = "session string, call_id long, decision string, spent_usd double"


def budget_stream(stream: DataFrame, most_calls: int = 5, most_usd: float = 0.02) -> DataFrame:
    """Stateful decisions of a stream (session, call_id, ts, fingerprint, cost_usd)."""
    return stream.groupBy("session").transformWithStateInPandas(Budget(most_calls, most_usd), DECISIONS, "append", "none")


def budget_fold(calls: DataFrame, most_calls: int = 5, most_usd: float = 0.02) -> DataFrame:
    """(session, call_id, decision, spent_usd): the same decisions over a whole table.

    A session allows ``most_calls`` calls at most, so that many rounds find them: each looks for a session's
    next call that fits, by an aggregate. All calls are then decided by what was allowed before them;
    no task takes all calls of a session.
    """
    c = F.col
    rows = calls.select("session", "call_id", "ts", "fingerprint", "cost_usd").withColumn("at", F.struct("ts", "call_id"))
    none = "array<struct<at: struct<ts: timestamp, call_id: bigint>, fingerprint: string, cost_usd: double>>"
    none = none.replace("timestamp", rows.schema["ts"].dataType.simpleString()).replace("bigint", rows.schema["call_id"].dataType.simpleString())
    state = rows.select("session").distinct().withColumns({"allowed": F.array().cast(none), "usd": F.lit(0.0)})
    for _ in range(most_calls):
        later = F.coalesce(c("at") > F.get("allowed", F.size("allowed") - 1)["at"], F.lit(True))
        fits = later & ~F.exists("allowed", lambda x: x["fingerprint"] == c("fingerprint")) & (c("usd") + c("cost_usd") <= most_usd)
        found = F.min_by(F.when(fits, F.struct("at", "fingerprint", "cost_usd")), F.when(fits, c("at")))
        state = rows.join(state, "session").groupBy("session").agg(F.first("allowed").alias("allowed"), F.first("usd").alias("usd"), found.alias("found"))
        more = c("found").isNotNull()
        state = state.select("session", F.when(more, F.concat("allowed", F.array("found"))).otherwise(c("allowed")).alias("allowed"), F.when(more, c("usd") + c("found.cost_usd")).otherwise(c("usd")).alias("usd"))
    both = rows.join(state.select("session", "allowed"), "session")
    before = F.filter("allowed", lambda x: x["at"] < c("at"))
    spent = lambda some: F.aggregate(some, F.lit(0.0), lambda s, x: s + x["cost_usd"])
    own = F.exists("allowed", lambda x: x["at"] == c("at"))
    decision = (
        F.when(F.exists(before, lambda x: x["fingerprint"] == c("fingerprint")), "REUSED_CACHED_RESULT")
        .when(own, "ALLOW")
        .when(F.size(before) >= most_calls, "BLOCKED_CALL_COUNT")
        .otherwise("BLOCKED_SESSION_BUDGET")
    )
    return both.select("session", "call_id", decision.alias("decision"), (spent(before) + F.when(own, c("cost_usd")).otherwise(0.0)).alias("spent_usd"))


def read_ledger_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)
