"""Whitening of embeddings over their distinct quantised vectors.

Identical quantised vectors are grouped first, so that a vector with a million copies is
one row with a count. Means and the covariance are sums over the distinct vectors, weighted
by one (each vector once) or by their counts: exact integer sums for the mean, then one
weighted centred matrix product a batch, added up across tasks. The eigenvectors of the
covariance, a matrix of the vectors' width, are found on the driver. Every distinct vector
is projected once, and the result is joined back to the rows.

Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so
are rows whose width is not the commonest one (of equally common widths the largest stays).
Repeated rows are repeated in the result and rows with a null id stay. Entries beyond 2^46
in size count as 2^46 of their sign. Directions without variance (eigenvalues within
rounding of zero: constant columns, fewer vectors than columns, a single vector) have no
whitened value and are no components. An empty table gives no rows. Eigenvectors of equal
eigenvalues are any basis of their space; of either sign the one stays whose largest entry
is positive. A deviation beyond the range of long is null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_copies, map_arrow, table, written

COMPONENTS = 16
#: Quantisation of the query: a step of 1/64, and an offset that keeps usual values positive.
SCALE, OFFSET = 64, 1_000_000
#: Numbers that one matrix product works on.
BLOCK = 1 << 20


class Whitening(NamedTuple):
    n: int  # weight of the fit list
    sums: list[int]  # of each dimension over it
    eigenvalues: np.ndarray  # falling
    vectors: np.ndarray  # a column for each component
    explained: np.ndarray


def quantised(rows: DataFrame, id_column: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id_column, x) of the rows with a whole vector: x = floor(scale * c) + offset for each entry c."""
    sound = f"size(`{vector}`) > 0 AND NOT exists(`{vector}`, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity'))"
    edge = f"{1 << 46}D"
    x = f"transform(`{vector}`, c -> floor({float(scale)!r}D * greatest(least(cast(c AS double), {edge}), -{edge})) + {offset}L)"
    found = rows.where(f"`{vector}` IS NOT NULL AND {sound}").select(F.col(f"`{id_column}`").alias(id_column), F.expr(x).alias("x"))
    widths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return found.join(F.broadcast(widths.select("d")), F.size("x") == F.col("d")).select(id_column, "x")


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches and their lists as matrices, cut to ``BLOCK`` numbers."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(column).flatten().to_numpy()
            wide = flat.reshape(batch.num_rows, -1)
            step = max(1, BLOCK // wide.shape[1])
            for low in range(0, batch.num_rows, step):
                yield batch.slice(low, step), wide[low : low + step]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums without rounding: of 64 bits, or Python's integers where these are too few."""
    if n * (int(np.abs(x).max()) + max(map(abs, sums)) // n + 1) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; none where they don't fit into long."""
    most = int(np.abs(d).max())
    if most * most * d.shape[1] < 1 << 63 and d.dtype != object:
        return (d * d).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (d.astype(object) ** 2).sum(axis=1)]


def _totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """Total weight, and exact weighted sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for batch, x in _matrices(batches, "x"):
            w = batch.column("weight").to_numpy()
            fits = int(np.abs(x).max()) * int(w.sum()) < 1 << 62
            part = (x * w[:, None]).sum(axis=0) if fits else (x.astype(object) * w[:, None]).sum(axis=0)
            total, weight = part.astype(object) + (0 if total is None else total), weight + int(w.sum())
        if total is not None:
            limbs = [total >> 32, total & 0xFFFFFFFF]  # two halves, whose sums fit into long
            yield pa.RecordBatch.from_arrays([pa.array([weight]), *[pa.array([v.tolist()], pa.list_(pa.int64())) for v in limbs]], ["weight", "high", "low"])

    parts = map_arrow(distinct.select("x", "weight"), run, "weight long, high array<long>, low array<long>")
    parts = parts.select("weight", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    sums = parts.groupBy("i").agg(F.sum("weight").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).orderBy("i").collect()
    return (sums[0]["n"] if sums else 0), [(r["high"] << 32) + r["low"] for r in sums]


def _products(rows: DataFrame, column: str, centred) -> np.ndarray | None:
    """The weighted sum over all rows of the outer product of each centred vector with itself.
    A task sends one matrix of the vectors' width; they are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch, x in _matrices(batches, column):
            c = centred(x)
            total = total + (c * batch.column("weight").to_numpy()[:, None]).T @ c
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "line"])

    parts = map_arrow(rows.select(column, "weight"), run, "i long, line array<double>")
    cells = parts.select("i", F.posexplode("line").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    lines = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("line")).orderBy("i").select("line.v").collect()
    return np.array([r[0] for r in lines]) if lines else None


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``distinct`` (x, weight)."""
    n, sums = _totals(distinct)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    covariance = _products(distinct, "x", lambda x: (_deviations(x, n, sums) / n).astype(np.float64)) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0) * len(values) * np.finfo(float).eps
    values, vectors = values[real][:components], vectors[:, real][:, :components]
    largest = np.abs(vectors).argmax(axis=0) if len(values) else np.zeros(0, int)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(values))])
    return Whitening(n, sums, values, vectors, values / np.trace(covariance))


def whitened(distinct: DataFrame, model: Whitening) -> DataFrame:
    """``distinct`` with (deviation, z): the sum of squares of n * x - sums, and the whitened vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, "x"):
            d = _deviations(x, model.n, model.sums)
            z = (d / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.eigenvalues)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_squares(d), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], [*batch.schema.names, "deviation", "z"])

    return map_arrow(distinct.select("x", "copies", "weight"), run, "x array<long>, copies long, weight long, deviation long, z array<double>")


def identity_error(projected: DataFrame, n: int) -> float:
    """The largest entry of the covariance of z over the fit list, less the identity."""
    means = projected.select("weight", F.posexplode("z").alias("i", "v")).groupBy("i").agg((F.sum(F.col("v") * F.col("weight")) / n).alias("m")).orderBy("i").collect()
    mean = np.array([r["m"] for r in means])
    covariance = _products(projected, "z", lambda z: z - mean) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, by_count: bool = False) -> tuple[DataFrame, Whitening, float]:
    """(id_column, deviation, z) of every row with a whole vector, the model, and the identity error.

    ``by_count`` weighs each distinct vector by its number of rows, else by one.
    """
    x = quantised(rows, id_column, vector)
    groups = x.groupBy("x").agg(F.count("*").alias("copies"))
    distinct = written(groups.withColumn("weight", F.col("copies") if by_count else F.lit(1).cast("long")), "distinct-vectors")
    model = fit(distinct, components)
    if not len(model.eigenvalues):
        nothing = x.where("false").select(id_column, F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("z"))
        return nothing, model, 0.0
    projected = written(whitened(distinct, model), "whitened")
    found = join_copies(x, projected, "x", ["deviation", "z"]).select(id_column, "deviation", "z")
    return found, model, identity_error(projected, model.n)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    rows, model, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(v)) for v in model.explained]) if len(model.explained) else F.array(F.lit(0.0))
    long = rows.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
