"""Versioned store for profiles and models.

A save writes the tables of a run into a folder of its own, reads them back, and then adds
one row to the store's manifest: the run's folder, and for each table its schema, number of
rows and a checksum. That row, which Spark's file commit makes appear whole or not at all,
is what publishes the run. A run that broke off has no row and is never read; a run whose
files changed since is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "name string, number long, folder string, tables array<struct<table: string, schema: string, rows: long, checksum: string>>"


class StoreError(ValueError):
    """A run that is not in the manifest, or not as it was published."""


def _facts(table: DataFrame) -> tuple[int, str]:
    """Rows and a checksum that does not depend on their order."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    r = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(whole.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return r["n"], r["sum"]


class Store:
    """Runs under one path, by name and number; the newest of a name is its largest number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self, name: str | None = None) -> DataFrame:
        """The published runs; none where nothing was saved yet."""
        from pyspark.errors import AnalysisException

        try:
            found = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], MANIFEST)
        return found if name is None else found.where(F.col("name") == name)

    def save(self, name: str, write: Callable[[str], None], tables: list[str]) -> int:
        """Publish what ``write(folder)`` leaves; ``tables`` are the Parquet tables below the folder, "" the folder itself."""
        number = 1 + (self.runs(name).agg(F.max("number")).first()[0] or 0)
        folder = f"runs/{name}/{number}-{uuid.uuid4().hex}"
        write(f"{self.path}/{folder}")
        facts = []
        for table in tables:
            written = self.spark.read.parquet(f"{self.path}/{folder}/{table}")
            facts.append((table, written.schema.json(), *_facts(written)))
        row = self.spark.createDataFrame([(name, number, folder, facts)], MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return number

    def save_table(self, name: str, table: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        return self.save(name, lambda folder: table.write.partitionBy(*partition_by).parquet(folder), [""])

    def folder(self, name: str, number: int | None = None, verify: bool = True) -> str:
        """The folder of a run, by default of the newest, after its tables were checked."""
        runs = self.runs(name) if number is None else self.runs(name).where(F.col("number") == number)
        # two writers may have taken one number: the same of the two for every reader
        found = runs.orderBy(F.desc("number"), "folder").limit(1).collect()
        if not found:
            raise StoreError(f"no run {number or ''} of {name}".replace("  ", " "))
        run, folder = found[0], f"{self.path}/{found[0]['folder']}"
        for t in run["tables"] if verify else []:
            table = self.spark.read.parquet(f"{folder}/{t['table']}")
            if (table.schema.json(), *_facts(table)) != (t["schema"], t["rows"], t["checksum"]):
                raise StoreError(f"table {t['table'] or name} of run {run['number']} of {name} is not as it was published")
        return folder

    def table(self, name: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(name, number))
