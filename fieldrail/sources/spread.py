"""How many tasks a frame's rows are dealt to, so that what one task holds doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task that sorts or groups them: some hundred MB.
ROWS = 1_000_000


def spread(frame: DataFrame, rows: int = ROWS) -> int:
    """Partitions for a frame's rows, which are counted; at least Spark's own number."""
    return spread_rows(frame, frame.count(), rows)


def spread_rows(frame: DataFrame, n: int, rows: int = ROWS) -> int:
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n // rows))
