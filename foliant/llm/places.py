"""Places of rows in an order, counted over range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.storage import cut


def placed(rows: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """rows with place long, theirs in the order from 0 (nulls first), within each value of by, and of long, the number of rows with that value.

    rows must be cheap to read twice (a written table): ranges are sampled.
    Equal rows are spread over ranges by a number of their own, so that no task
    sees all rows of a value or of a key; what tasks exchange is a row for each
    partition and value in it.
    """
    first = [by] if by else []
    keys = [F.col(x).asc_nulls_first() for x in [*first, *order, "_row"]]
    d = rows.withColumn("_row", F.monotonically_increasing_id())
    d = cut(d.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    d = d.withColumns({"_part": F.shiftright("_at", 33), "_by": F.col(by) if by else F.lit(0)})
    runs = d.groupBy("_by", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    w = Window.partitionBy("_by")  # a row for each partition
    runs = runs.select("_by", "_part", "_from", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("of"))
    runs = cut(runs.select(F.col("_by").alias("_b"), F.col("_part").alias("_p"), (F.col("_before") - F.col("_from")).alias("_shift"), "of"), "runs")
    out = d.join(runs, (F.col("_part") == F.col("_p")) & F.col("_by").eqNullSafe(F.col("_b")))
    return out.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_by", "_b", "_p", "_shift")
