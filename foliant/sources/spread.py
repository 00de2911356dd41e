"""As many tasks as rows ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task; tasks sort and gather them in memory.
ROWS = 1 << 20


def spread(rows: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """rows, by hash of keys in partitions of about most (ROWS) rows if the session's number of shuffle partitions would make them larger, so that a task's share doesn't grow with the input.

    rows must be cheap to count. What is grouped or ordered within keys behind it needs no further shuffle.
    """
    tasks = -(-rows.count() // (most or ROWS))
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
