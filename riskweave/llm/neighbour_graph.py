"""Near-duplicate embeddings by neighbour descent.

Copies of a vector are one point with a count. Every point gets a list of near points,
first from several sorted orders of random-hyperplane codes, and then better ones among
the neighbours of its neighbours, round after round; lists are compared by sketches of 256
hyperplanes. Listed pairs whose sketches are near enough are compared exactly, in double
precision, and those at the threshold are links. A list that is full of links says nothing
about the rest: in the next pass such a point has a longer list, and points that are linked
already, directly or not, no longer take up places in each other's lists. Passes, each with
new hyperplanes, go on until one finds no link between two groups and an audit, a bounded
sample of points held against all points by brute force, meets ``RECALL``.

The links of a point are then counted exactly within its group: blocks of a group are
multiplied as matrices, and only counts leave a task. No pairs of a group are emitted. The
work of these counts grows with the square of a group's distinct vectors; its memory doesn't.

Vectors that are null, empty, zero or hold null or non-finite entries link with nothing, and
so do vectors whose width is not the commonest (of equally common widths the largest is
taken). Repeated rows are vectors of their own, linked with one another. A row with a null
id takes part; it names a group only if all its ids are null, and is kept only then. The
threshold itself is a link. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import join_copies, map_arrow, table, written
from .components import connected_components

THRESHOLD = 0.95
#: Places in a list, of a saturated point's list, and offers that a point makes each of its neighbours' neighbours.
ROOM, WIDE_ROOM, OFFERS = 8, 32, 4
#: Orders of the first lists and rows that a row meets in each.
ORDERS, REACH = 8, 4
ROUNDS = 2
SKETCH_BITS = 256
#: Bits in which sketches of listed points differ at most: two unrelated vectors differ in 128 +- 8.
FAR = 112
#: Points that the audit holds against all points, the share of links that it asks for, and passes at most.
AUDIT, RECALL, PASSES = 512, 0.99, 6
#: Vectors that one block of a group has.
BLOCK = 2048


class Graph(NamedTuple):
    points: DataFrame  # key, copies, least (id), component_id, n_links
    recall: float  # by the last audit
    passes: int


def near_bits(threshold: float) -> int:
    """Sketches of a pair at the threshold differ in no more bits, but for one pair in some 10^12."""
    share = np.arccos(threshold) / np.pi
    return int(np.ceil(SKETCH_BITS * share + 7 * np.sqrt(SKETCH_BITS * share * (1 - share))))


def units(column: pa.Array, n: int) -> np.ndarray:
    """The vectors of a list column at length one, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bits(x: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """Bits of random hyperplanes, packed into bytes."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bits))
    return np.packbits(x @ planes > 0, axis=1, bitorder="little")


def sound(vector: str) -> str:
    return f"(`{vector}` IS NOT NULL AND size(`{vector}`) > 0 AND NOT exists(`{vector}`, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity')) AND exists(`{vector}`, c -> c <> 0))"


def _marks(points: DataFrame, state: DataFrame, seed: int, orders: int) -> DataFrame:
    """(key, comp, wide, sketch, codes): a sketch of four longs, and a code of 32 bits for each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x = units(part.column("vector"), part.num_rows)
                sketch = _bits(x, seed, SKETCH_BITS).view("<i8")
                codes = _bits(x, seed + 1, 32 * orders).view("<u4").astype(np.int64)
                lists = [pa.array(list(v), pa.list_(pa.int64())) for v in (sketch, codes)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *lists], ["key", "sketch", "codes"])

    return map_arrow(points.select("key", "vector"), run, "key long, sketch array<long>, codes array<long>").join(state, "key")


_OFFER = "a long, b long, dist int, wide boolean"


def _offers(a, b, dist, wide) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(dist.astype(np.int32)), pa.array(wide)], ["a", "b", "dist", "wide"])


def _first_offers(marks: DataFrame, reach: int) -> DataFrame:
    """Offers between rows that follow one another in an order and are in different groups."""
    rows = marks.select(F.posexplode("codes").alias("turn", "code"), "key", "comp", "wide", "sketch")
    rows = rows.repartitionByRange("turn", "code", "key").sortWithinPartitions("turn", "code", "key").drop("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            turn, key, comp = (batch.column(c).to_numpy() for c in ("turn", "key", "comp"))
            rows = [turn, key, comp, batch.column("wide").to_numpy(zero_copy_only=False), batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCH_BITS // 64)]
            if kept:
                rows = [np.concatenate([v, w]) for v, w in zip(kept, rows)]
            turn, key, comp, wide, sketch = rows
            n = len(key)
            # the first row after each that is in another group
            ends = np.append(np.flatnonzero(comp[1:] != comp[:-1]) + 1, n)
            other = ends[np.searchsorted(ends, np.arange(n), "right")]
            for step in range(reach):
                at = np.flatnonzero(other + step < n)
                to = other[at] + step
                fits = (turn[at] == turn[to]) & (comp[at] != comp[to])
                at, to = at[fits], to[fits]
                dist = np.bitwise_count((sketch[at] ^ sketch[to]).view(np.uint64)).sum(axis=1)
                fits = dist <= FAR
                at, to, dist = at[fits], to[fits], dist[fits]
                yield _offers(np.concatenate([key[at], key[to]]), np.concatenate([key[to], key[at]]), np.concatenate([dist, dist]), np.concatenate([wide[at], wide[to]]))
            kept = [v[-reach:] for v in rows]

    return map_arrow(rows, run, _OFFER)


def _best(offers: DataFrame, room: int = ROOM, wide_room: int = WIDE_ROOM) -> DataFrame:
    """The nearest of what each point was offered, as many as its list has room for."""
    place = F.dense_rank().over(Window.partitionBy("a").orderBy("dist", "b"))
    return offers.withColumn("place", place).where(f"place <= {wide_room} AND (wide OR place <= {room})").drop("place").dropDuplicates(["a", "b"])


def _closer(lists: DataFrame, marks: DataFrame) -> DataFrame:
    """Offers among the neighbours, in either direction, of each point."""
    around = lists.select("a", "b", "dist").union(lists.select("b", "a", "dist")).toDF("v", "u", "dist")
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("dist", "u"))
    around = around.withColumn("place", place).where(f"place <= {2 * ROOM}").dropDuplicates(["v", "u"]).select("v", "u")
    own = marks.select(F.col("key").alias("u"), "comp", "wide", "sketch")
    # at most 2 * ROOM neighbours stand in a row
    met = around.join(own, "u").groupBy("v").agg(F.collect_list(F.struct("u", "comp", "wide", "sketch")).alias("met")).where("size(met) > 1").select("met")
    words = SKETCH_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                column = batch.column("met").slice(low, 1024)
                sizes, flat = column.value_lengths().to_numpy(), column.flatten()
                n, m = len(sizes), int(sizes.max())
                row, place = np.repeat(np.arange(n), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key, comp, wide = np.zeros((n, m), np.int64), np.zeros((n, m), np.int64), np.zeros((n, m), bool)
                sketch, there = np.zeros((n, m, words), np.int64), np.zeros((n, m), bool)
                key[row, place], comp[row, place] = flat.field("u").to_numpy(), flat.field("comp").to_numpy()
                wide[row, place], there[row, place] = flat.field("wide").to_numpy(zero_copy_only=False), True
                sketch[row, place] = flat.field("sketch").flatten().to_numpy().reshape(-1, words)
                dist = sum(np.bitwise_count((sketch[:, :, None, k] ^ sketch[:, None, :, k]).view(np.uint64)).astype(np.int16) for k in range(words))
                dist[(comp[:, :, None] == comp[:, None, :]) | ~there[:, :, None] | ~there[:, None, :]] = SKETCH_BITS + 1
                offers = min(OFFERS, m - 1)
                to = np.argpartition(dist, offers - 1, axis=2)[:, :, :offers]
                dist = np.take_along_axis(dist, to, axis=2)
                row, at, turn = np.nonzero(dist <= FAR)
                yield _offers(key[row, at], key[row, to[row, at, turn]], dist[row, at, turn], wide[row, at])

    return map_arrow(met, run, _OFFER)


def _links(pairs: DataFrame, points: DataFrame, state: DataFrame, threshold: float) -> DataFrame:
    """(a, b, of_a, of_b): pairs at the threshold, and their groups."""
    whole = points.select("key", "vector").join(state.select("key", "comp"), "key")
    both = pairs.join(whole.toDF("a", "x", "of_a"), "a").join(whole.toDF("b", "y", "of_b"), "b").select("a", "b", "of_a", "of_b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (units(batch.column(c), batch.num_rows) for c in "xy")
                yield batch.select(["a", "b", "of_a", "of_b"]).filter(pa.array((x * y).sum(axis=1) >= threshold))

    return map_arrow(both, run, "a long, b long, of_a long, of_b long")


def audit(points: DataFrame, state: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The share of the links of ``sample`` points, found by brute force among all points, that lie within a group."""
    whole = points.select("key", "vector").join(state.select("key", "comp"), "key")
    asked = whole.orderBy(F.xxhash64("key"), "key").limit(sample).toPandas()
    if asked.empty:
        return 1.0
    x = np.array(asked["vector"].tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x, key, comp = x / np.sqrt((x * x).sum(axis=1, keepdims=True)), asked["key"].to_numpy(), asked["comp"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked = found = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                near = (units(part.column("vector"), part.num_rows) @ x.T >= threshold) & (part.column("key").to_numpy()[:, None] != key)
                linked += int(near.sum())
                found += int((near & (part.column("comp").to_numpy()[:, None] == comp)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([linked]), pa.array([found])], ["linked", "found"])

    linked, found = map_arrow(whole, run, "linked long, found long").agg(F.sum("linked"), F.sum("found")).first()
    return found / linked if linked else 1.0


def _counts(points: DataFrame, state: DataFrame, threshold: float, block: int) -> DataFrame:
    """(key, linked): how many vectors of other points in its group a point is linked with."""
    sizes = state.groupBy("comp").count().where("count > 1")
    members = points.select("key", "vector", "copies").join(state.select("key", "comp").join(sizes, "comp"), "key")
    members = members.withColumn("blocks", F.expr(f"cast(ceil(count / {block}) AS int)"))
    members = members.withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) AS int)"))
    # groups of one block share tasks' batches; of a larger one each pair of blocks is a batch
    share = max(1, (sizes.agg(F.sum("count")).first()[0] or 0) // block)
    dealt = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        F.expr(f"IF(blocks = 1, pmod(xxhash64(comp), {share}), comp)").alias("batch"), F.expr("blocks > 1").alias("large"),
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "comp", "key", "copies", "vector")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("comp", "ascending"), ("own", "ascending")])
        n = rows.num_rows
        x = units(rows.column("vector").combine_chunks(), n)
        comp, own, copies, key = (rows.column(c).to_numpy() for c in ("comp", "own", "copies", "key"))
        apart = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        starts = np.append(np.flatnonzero(np.diff(comp, prepend=comp[0] - 1)), n)
        linked = np.zeros(n, np.int64)
        for s, e in zip(starts[:-1], starts[1:]):
            if apart:  # two blocks of one group, each against the other
                cut = s + int(np.searchsorted(own[s:e], own[s], "right"))
                near = x[s:cut] @ x[cut:e].T >= threshold
                linked[s:cut], linked[cut:e] = near @ copies[cut:e], near.T @ copies[s:cut]
            else:
                near = x[s:e] @ x[s:e].T >= threshold
                np.fill_diagonal(near, False)
                linked[s:e] = near @ copies[s:e]
        return pa.table({"key": key, "linked": linked})

    return dealt.groupBy("batch", "large", "low", "high").applyInArrow(run, "key long, linked long").groupBy("key").agg(F.sum("linked").alias("linked"))


def neighbour_graph(rows: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS, orders: int = ORDERS, reach: int = REACH,
                    passes: int = PASSES, recall: float = RECALL, sample: int = AUDIT, block: int = BLOCK) -> Graph:
    """The groups and link counts of the distinct vectors in ``rows`` (id, vector)."""
    spark = rows.sparkSession
    widths = rows.where(sound("vector")).groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1)
    alike = rows.where(sound("vector")).join(F.broadcast(widths.select("width")), F.size("vector") == F.col("width"))
    distinct = alike.groupBy("vector").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    points = written(distinct.withColumn("key", F.monotonically_increasing_id()), "points")
    state = written(points.select("key", F.col("key").alias("comp"), F.lit(False).alias("wide")), "state")
    done, share = 0, 1.0
    while done < passes:
        marks = written(_marks(points, state, 2 * done + 11, orders), "marks")
        lists = written(_best(_first_offers(marks, reach)), "lists")
        for _ in range(rounds):
            lists = written(_best(lists.union(_closer(lists, marks))), "lists")
        pairs = lists.where(f"dist <= {near_bits(threshold)}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = written(_links(pairs, points, state, threshold), "links")
        done += 1
        found = bool(links.limit(1).count())
        if found:
            joined = connected_components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
            ends = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("key")).count()
            full = ends.where(F.col("count") >= ROOM).select("key", F.lit(True).alias("full"))
            state = state.join(joined, F.col("comp") == F.col("node"), "left").join(full, "key", "left")
            state = written(state.select("key", F.coalesce("component", "comp").alias("comp"), F.coalesce("full", "wide").alias("wide")), "state")
        share = audit(points, state, threshold, sample)
        if not found and share >= recall:
            break
    linked = written(_counts(points, state, threshold, block), "linked")
    whole = points.drop("vector").join(state.select("key", "comp"), "key").join(linked, "key", "left")
    names = whole.groupBy("comp").agg(F.min("least").alias("component_id"))
    whole = whole.join(names, "comp").select("key", "copies", "least", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return Graph(written(whole.join(points.select("key", "vector"), "key"), "graph"), share, done)


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, **options) -> tuple[DataFrame, Graph]:
    """(id_column, n_links, component_id, kept) of every row, and the graph."""
    own = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    graph = neighbour_graph(own, threshold, **options)
    found = join_copies(own, graph.points, "vector", ["component_id", "n_links"])
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = found.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id"))), graph


def op11_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))[0]
