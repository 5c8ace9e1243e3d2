"""Helpers shared by the training-data operators: tables, shared scratch space, Arrow slices."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one numpy pass works on. Bounds a worker's memory; a longer text is a slice of its own.
SLICE_BYTES = (2 << 20) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a folder of its own;
    on a cluster that is an error, because executors could not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="riskweave-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="riskweave-code-")  # the driver's own; Spark serves the archive from it
        sc.addPyFile(shutil.make_archive(f"{folder}/riskweave", "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers. Workers live on between tasks
    and stages; what a task has freed goes back to the machine when it ends."""
    ship(df.sparkSession)

    def released(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage,
    survives lost executors, and is computed once however many branches read it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): the batches cut where their texts exceed ``limit`` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def doc_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each byte position belongs to."""
    return np.searchsorted(offsets, starts, "right") - 1


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], zero for empty ranges."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: A value with more than one in so many rows meets its rows by broadcast: so many values at most.
HOT = 1_000


def join_copies(rows: DataFrame, distinct: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """``rows`` with the ``columns`` of ``distinct`` (on, copies, ...), a written table of one row for
    each value of ``on`` that has ``copies`` rows; null where there is none. Values with very many
    copies are broadcast, the others joined by a shuffle."""
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    hot = distinct.where(F.col("copies") * HOT > total).select(on, *[F.col(c).alias(f"_hot_{c}") for c in columns], F.lit(True).alias("_hot"))
    met = rows.join(F.broadcast(hot), on, "left")
    common = met.where("_hot").select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in columns])
    rare = met.where("_hot IS NULL").select(*rows.columns).join(distinct.where(F.col("copies") * HOT <= total).select(on, *columns), on, "left")
    return common.union(rare.select(*common.columns))
