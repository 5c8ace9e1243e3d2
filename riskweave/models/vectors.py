"""Points for the models: an id and one array of doubles, scaled on the fitted rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def points(df: DataFrame, features: list[str], id_column: str = "user_id") -> DataFrame:
    """(id, x) with x in the given feature order."""
    return df.select(F.col(id_column).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature keeps deviation 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, features: list[str]) -> "Scaler":
        stats = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)],
        ).first()  # one row
        n = len(features)
        return Scaler(
            tuple(features), tuple(float(stats[f"m{i}"] or 0.0) for i in range(n)),
            tuple(float(stats[f"s{i}"] or 0.0) or 1.0 for i in range(n)),
        )

    def scaled(self) -> list[Column]:
        return [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.means, self.deviations)]

    def points(self, df: DataFrame, id_column: str = "user_id") -> DataFrame:
        return df.select(F.col(id_column).alias("id"), F.array(*self.scaled()).alias("x"))


def score_points(pts: DataFrame, scorers: dict) -> DataFrame:
    """(id, one column per scorer) from one pass over the points; a scorer maps a matrix to a vector."""
    def run(batches):
        for pdf in batches:
            x = as_matrix(pdf["x"])
            yield pd.DataFrame({"id": pdf["id"], **{name: scorer(x) for name, scorer in scorers.items()}})

    id_type = pts.schema["id"].dataType.simpleString()
    return pts.mapInPandas(run, f"id {id_type}, " + ", ".join(f"{n} double" for n in scorers))
