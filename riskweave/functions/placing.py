"""Exact positions of rows in a hashed order, without ordering a large group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

RANGES = 4096


def hashed_position(table: DataFrame, by: list[str], id_column: str = "user_id", seed: int = 42) -> DataFrame:
    """Adds ``position`` (1-based) and ``group_rows`` per group, in the order of hashed ids.

    A row's position is its place inside one of 4096 hash ranges plus the sizes
    of the ranges before it; only ranges are ordered, and their counts are a
    small table (groups * 4096 rows).
    """
    h = F.xxhash64(F.col(id_column), F.lit(seed))
    placed = table.withColumns({"__h": F.shiftrightunsigned(h, 1), "__r": F.shiftrightunsigned(h, 52).cast("int")})
    sizes = placed.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*by).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        *by, "__r", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(W.partitionBy(*by)).alias("group_rows"),
    )
    place = F.row_number().over(W.partitionBy(*by, "__r").orderBy("__h", id_column))
    joined = placed.withColumn("__p", place).join(sizes, [*by, "__r"])
    return joined.withColumn("position", F.col("__before") + F.col("__p")).drop("__h", "__r", "__p", "__before")
