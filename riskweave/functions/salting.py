"""Joins that stay balanced when one key holds a large share of the left rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32


def salted_left_join(
    left: DataFrame, right: DataFrame, on: list[str], spread: Column, salts: int = SALTS
) -> DataFrame:
    """Left join to a lookup with at most one row per key.

    Each key's left rows are spread over ``salts`` join keys by a hash of
    ``spread`` (a row id), and the lookup is repeated once per salt. The result
    is the plain left join; only the work per task changes. Spark still turns
    it into a broadcast join where the measured lookup size allows.
    """
    salt = "__salt"
    salted = left.withColumn(salt, F.pmod(F.hash(spread), F.lit(salts)))
    repeated = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, salt], "left").drop(salt)
