"""Best-fit decreasing packing of documents into token sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so best fit needs no document, only the
count of pieces of each length: pieces of one length are alike, and so are bins with one
remaining capacity. ``plan`` runs best-fit decreasing over these counts, with a segment
tree over remaining capacities that finds the tightest open bin in logarithmic time, and
writes down which ranks of a length go to which bins. Spark ranks the pieces of each
length and looks up their places. The plan's size depends on the capacity alone.

A null text counts as empty, and an empty one is the end id alone. Repeated rows are
packed as often as they occur, in the order of their contents where ids are equal. Rows
with a null id are packed. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, table, written
from .tokens import default_path, encode

CAPACITY = 1024
#: Rows ranked together: buckets of about this many are ordered in one task.
BUCKET_ROWS = 100_000


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = total % capacity or capacity
    starts = [0, *range(first, total, capacity)]
    return [(s, (starts + [total])[k + 1] - s) for k, s in enumerate(starts)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                known = seen.get(text)
                if known is None:  # exact copies in a batch are encoded once
                    ids = encode(text, path)
                    known = seen[text] = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                rows += [(doc, *p) for p in known]
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class TightestBin:
    """A segment tree over remaining capacities: the smallest one not below a length that has a bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        k = remaining + self.size
        while k:
            self.open[k] += bins
            k //= 2

    def find(self, length: int) -> int | None:
        k = length + self.size
        if self.open[k]:
            return length
        while k > 1 and (k % 2 or not self.open[k + 1]):  # up to where a right neighbour has a bin
            k //= 2
        if k <= 1:
            return None
        k += 1
        while k < self.size:
            k = 2 * k if self.open[2 * k] else 2 * k + 1
        return k - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, rank, pieces, bin, each, offset) of best-fit decreasing: the pieces of
    ``length`` with ranks from ``rank`` on go to bins from ``bin`` on, ``each`` to a bin,
    one after the other from ``offset`` on. A bin that has taken a piece and still has room
    for another of that length is the tightest again, so it takes all it can."""
    tree, bins = TightestBin(capacity), [[] for _ in range(capacity + 1)]  # (first id, number) by remaining capacity
    moves, opened = [], 0

    def put(remaining: int, first: int, number: int) -> None:
        if number and remaining:
            bins[remaining].append((first, number))
            tree.add(remaining, number)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.find(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, number = opened, -(-left // each)
                opened += number
            else:
                each = remaining // length
                first, number = bins[remaining].pop()
                tree.add(remaining, -number)
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            taken = full * each + min(rest, each)
            moves.append((length, rank, taken, first, each, capacity - remaining))
            put(remaining - each * length, first, full)
            if rest:
                put(remaining - rest * length, first + full, 1)
            put(remaining, first + full + bool(rest), number - full - bool(rest))
            rank, left = rank + taken, left - taken
    return moves


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length``. ``parts`` is read several
    times: pass a written table. All its columns order pieces of one length."""
    spark = parts.sparkSession
    total = parts.count()
    buckets = max(1, total // BUCKET_ROWS)
    order = [c for c in ("doc_id", "piece", "ids_crc32", "start") if c in parts.columns]
    bucketed = parts.withColumn("_p_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = bucketed.groupBy("length", "_p_bucket").agg(F.count("*").alias("_p_n"))
    before = Window.partitionBy("length").orderBy("_p_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("_p_before", F.coalesce(F.sum("_p_n").over(before), F.lit(0))), "length-counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_p_n").alias("n")).collect()}  # at most ``capacity`` rows
    moves = plan(lengths, capacity)
    # one row a move; their number has a bound in the capacity, not in the rows
    planned = spark.createDataFrame(moves, "length long, _p_rank long, _p_taken long, _p_bin long, _p_each long, _p_offset long")
    within = Window.partitionBy("length", "_p_bucket").orderBy(*order)
    ranked = bucketed.withColumn("_p_row", F.row_number().over(within) - 1)
    ranked = ranked.join(counts.drop("_p_n"), ["length", "_p_bucket"]).withColumn("_p_at", F.col("_p_row") + F.col("_p_before"))
    placed = ranked.join(F.broadcast(planned), "length").where("_p_at >= _p_rank AND _p_at < _p_rank + _p_taken")
    nth = F.col("_p_at") - F.col("_p_rank")
    return placed.select(
        *parts.columns,
        (F.col("_p_bin") + F.floor(nth / F.col("_p_each"))).cast("long").alias("sequence_id"),
        (F.col("_p_offset") + nth % F.col("_p_each") * F.col("length")).cast("long").alias("offset"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack(written(pieces(docs), "pieces"))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)
