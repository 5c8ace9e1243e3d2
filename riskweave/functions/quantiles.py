"""Exact quantiles of groups from counts of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def group_quantile(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): the quantile of each group's non-null values, linear between neighbours.

    Values are counted before they are moved, and ranks run over a group's distinct values
    only: no task holds a group's rows, or a map of them. Groups without a value have no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_q_v")).agg(F.count(F.lit(1)).alias("_q_n"))
    group = Window.partitionBy(*keys)
    ranked = counts.withColumns({
        "_q_to": F.sum("_q_n").over(group.orderBy("_q_v").rowsBetween(Window.unboundedPreceding, 0)),
        "_q_place": F.lit(share) * (F.sum("_q_n").over(group) - 1),
    })

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_q_to") - F.col("_q_n") <= rank) & (rank < F.col("_q_to")), F.col("_q_v").cast("double")))

    low, high = F.floor("_q_place"), F.ceil("_q_place")
    found = ranked.groupBy(*keys).agg(at(low).alias("_q_low"), at(high).alias("_q_high"), F.first("_q_place").alias("_q_place"))
    between = F.col("_q_low") + (F.col("_q_high") - F.col("_q_low")) * (F.col("_q_place") - low)
    return found.select(*keys, between.alias(name))
