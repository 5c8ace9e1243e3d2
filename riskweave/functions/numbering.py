"""Dense numbers for the rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskweave.session import checkpointed

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """``df`` with a column of the numbers 0, 1, 2 and so on, in no particular order.

    Rows are materialised first, so that a number stays with its row. One count for each
    partition is added up; the rows themselves are not moved.
    """
    placed = checkpointed(df.withColumn("_n_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_n_part", F.shiftright("_n_id", _ROW_BITS))
    counts = placed.groupBy("_n_part").agg(F.count(F.lit(1)).alias("_n_rows"))
    before = F.coalesce(F.sum("_n_rows").over(Window.orderBy("_n_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_n_part", before.alias("_n_before"))  # a row for each partition
    number = F.col("_n_before") + F.col("_n_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return placed.join(F.broadcast(offsets), "_n_part").select(*df.columns, number.alias(name))
