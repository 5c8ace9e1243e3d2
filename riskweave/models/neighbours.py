"""Exact nearest neighbours among all points of a table, by a tree of pivots.

Exact copies are one point with a weight, so a large group of copies costs nothing. The
tree is built level by level: a cell of more than ``LEAF_POINTS`` points is split among up
to ``FAN`` of its points that lie far apart, each point going to the nearest, and a node
keeps the ranges of distances from each child's points to each pivot, and the box around
them. A cell that is still too full is split again by distance, so the tree is deep where
points are dense. Levels of up to ``SHARED`` nodes in all are sent to all tasks and gone down
in one pass; the nodes of a larger level are joined with what arrives at their cells, in
bounded parts.

A search runs down the tree twice. First to the leaf around the query, whose points bound
the distance of its farthest neighbour; then into every cell that neither the ranges, by the
triangle inequality, nor the box can rule out. Queries that meet a leaf are cut into blocks,
so no task holds more than one leaf and one block. A product of matrices tells which pairs
may be near enough; only their distances are worked out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskweave.models.vectors import as_matrix
from riskweave.session import checkpointed

LEAF_POINTS = 2048
QUERY_POINTS = 4096
BLOCK = 256
#: Children of a node, and points of a cell among which they are chosen.
FAN, CANDIDATES = 16, 64
#: Nodes that are sent to all tasks at a time; of a larger level none is.
SHARED = 1024
#: Cells are numbered from the root, child i of cell c being c * FAN + i + 1; so deep they fit into long.
MOST_LEVELS = 14


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        total += np.subtract.outer(x[:, f], y[:, f]) ** 2
    return np.sqrt(total)


def nearest(x: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and positions of the k nearest rows of ``fit``, block by block."""
    found = []
    for start in range(0, len(x), BLOCK):
        d = distances(x[start:start + BLOCK], fit)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        found.append((np.take_along_axis(d, near, axis=1), near))
    return np.concatenate([d for d, _ in found]), np.concatenate([p for _, p in found])


def reached(x: np.ndarray, fit: np.ndarray, within: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, distance) of the ``k`` nearest rows of ``fit`` within each row's reach, the same as of ``nearest``."""
    limit, found = within * (1 + 1e-9), []
    centre = fit.mean(axis=0) if np.isfinite(fit).all() else 0.0
    moved, sizes = fit - centre, ((fit - centre) ** 2).sum(axis=1)
    for start in range(0, len(x), BLOCK):
        own, most = x[start:start + BLOCK], limit[start:start + BLOCK]
        there = own - centre
        about = (there**2).sum(axis=1)
        # squares off by rounding, by far less than ``slack``; what is not a number is worked out
        square = about[:, None] + sizes - 2.0 * (there @ moved.T)
        slack = 1e-11 * (about + sizes.max())
        cut = most**2 + slack
        many = np.flatnonzero((square <= cut[:, None]).sum(axis=1) > k)
        if len(many):
            cut[many] = np.minimum(cut[many], np.partition(square[many], k - 1, axis=1)[:, k - 1] + 2 * slack[many])
        row, place = np.nonzero(~(square > cut[:, None]))
        total = np.zeros(len(row))
        for f in range(x.shape[1]):
            total += (own[row, f] - fit[place, f]) ** 2
        d = np.sqrt(total)
        near = np.flatnonzero(d <= most[row])
        near = near[np.lexsort((d[near], row[near]))]
        row, place, d = row[near], place[near], d[near]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        # the last place is shared: which of them it gets is left to ``nearest``
        next_ = np.flatnonzero(at == k)
        shared = np.unique(row[next_[d[next_] == d[next_ - 1]]])
        first = (at < k) & ~np.isin(row, shared)
        found.append((row[first] + start, place[first], d[first]))
        if len(shared):
            d, place = nearest(own[shared], fit, k)
            found.append((np.repeat(shared, k) + start, place.ravel(), d.ravel()))
    return tuple(np.concatenate(v) for v in zip(*found))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt over all tasks: there is much to do for few bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def distinct_points(pts: DataFrame) -> DataFrame:
    """(pid, x, n): every distinct vector with its number of rows."""
    grouped = pts.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return checkpointed(grouped.select(F.monotonically_increasing_id().alias("pid"), "x", "n"))


class Nodes(NamedTuple):
    """Inner cells, by their number: the pivots of each, and for each child (row) how near and far its points lie
    to each pivot, and the box around them. All are filled up to ``FAN``, so that rows of many cells are looked at
    together."""

    cells: np.ndarray
    pivots: np.ndarray
    there: np.ndarray  # False for what fills up
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    floor: np.ndarray
    ceiling: np.ndarray

    @staticmethod
    def of(pdf: pd.DataFrame) -> "Nodes":
        pdf = pdf.sort_values("cell")
        held = [[np.stack([np.asarray(v, float) for v in row]) for row in pdf[c]] for c in ("pivots", "low", "high")]
        shape = (len(pdf), FAN, FAN)
        pivots = np.zeros((len(pdf), FAN, held[0][0].shape[1] if len(pdf) else 0))
        there = np.zeros(shape[:2], bool)
        # a missing pivot rules nothing out
        low, high, n = np.full(shape, -np.inf), np.full(shape, np.inf), np.zeros(shape[:2])
        floor, ceiling = np.full(pivots.shape, -np.inf), np.full(pivots.shape, np.inf)
        for k, (p, near, far, rows) in enumerate(zip(*held, pdf["n"])):
            pivots[k, : len(p)], there[k, : len(p)] = p, True
            low[k, : near.shape[0], : near.shape[1]], high[k, : far.shape[0], : far.shape[1]] = near, far
            n[k, : len(rows)] = rows
        for side, c in ((floor, "floor"), (ceiling, "ceiling")):
            for k, box in enumerate(pdf[c] if c in pdf else ()):  # a level without boxes: nothing ruled out by them
                side[k, : len(box)] = np.stack([np.asarray(v, float) for v in box])
        return Nodes(pdf["cell"].to_numpy(np.int64), pivots, there, low, high, n, floor, ceiling)

    def at(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each cell is here, its place)."""
        place = np.searchsorted(self.cells, cells)
        here = place < len(self.cells)
        here[here] = self.cells[place[here]] == cells[here]
        return here, np.where(here, place, 0)

    def distances(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """From each row to the pivots of its cell, infinite where there are fewer."""
        total = np.zeros((len(x), FAN))
        for f in range(x.shape[1]):
            total += (x[:, f, None] - self.pivots[place, :, f]) ** 2
        return np.where(self.there[place], np.sqrt(total), np.inf)

    def children(self, x: np.ndarray, place: np.ndarray, within: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance to each pivot, least distance to each child's points, a distance that holds ``need`` points)."""
        d, n = self.distances(x, place), self.n[place]
        known = np.where(self.there[place], d, 0.0)[:, None]
        low, high = self.low[place], self.high[place]
        least = np.maximum(np.maximum(low - known, known - high).max(axis=2), 0.0)
        most = (known + high).min(axis=2)
        gap, span = np.zeros(d.shape), np.zeros(d.shape)
        for f in range(x.shape[1]):
            below, above = self.floor[place, :, f] - x[:, f, None], x[:, f, None] - self.ceiling[place, :, f]
            gap += np.maximum(np.maximum(below, above), 0.0) ** 2
            span += np.maximum(-below, -above) ** 2
        least, most = np.maximum(least, np.sqrt(gap)), np.minimum(most, np.sqrt(span))
        order = np.argsort(most, axis=1)
        enough = np.cumsum(np.take_along_axis(n, order, axis=1), axis=1) >= need
        reach = np.take_along_axis(most, order, axis=1)[np.arange(len(x)), enough.argmax(axis=1)]
        least[~self.there[place]] = np.nan  # no child: not within any distance
        return d, least, np.minimum(within, np.where(enough.any(axis=1), reach, np.inf))


def _meet(rows: DataFrame, nodes: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(rows, nodes)`` over ``rows``, in blocks of rows of any cells; ``nodes`` has their inner cells."""
    few = nodes.limit(SHARED + 1).toPandas()
    if len(few) <= SHARED:
        return _meet_shared(rows, Nodes.of(few), run, schema)
    return _meet_joined(rows, nodes, run, schema)


def _meet_shared(rows: DataFrame, nodes, run: Callable, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(nodes)

    def local(batches):
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK):
                yield run(pdf.iloc[start:start + BLOCK], shared.value)

    return rows.mapInPandas(local, schema)


def _meet_joined(rows: DataFrame, nodes: DataFrame, run: Callable, schema: str) -> DataFrame:
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_POINTS).alias("parts"))
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(rows.columns[0]), F.col("parts"))).drop("parts")
    held = nodes.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def meet(part: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        one = Nodes.of(node)
        part = part.drop(columns="part")
        blocks = [run(part.iloc[start:start + BLOCK], one) for start in range(0, len(part), BLOCK)]
        return pd.concat(blocks) if blocks else pd.DataFrame()

    return dealt.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInPandas(meet, schema)


def _pivots(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Points of a cell that lie far apart: each is the farthest from all before it."""
    x = as_matrix(pdf.sort_values("pid")["x"])
    chosen, away = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < FAN and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(x, x[chosen[-1:]])[:, 0])
    return pd.DataFrame({"cell": [cell[0]], "pivots": [[x[k].tolist() for k in chosen]]})


def _split(points: DataFrame, leaf_points: int) -> tuple[DataFrame, DataFrame] | None:
    """(points with their new cells, the nodes of this level), or nothing where no cell is too full."""
    full = checkpointed(points.groupBy("cell").count().where(F.col("count") > leaf_points).select("cell"))
    if full.isEmpty():
        return None
    crowded = points.join(full, "cell", "left_semi")
    by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("pid"), "pid")
    some = crowded.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= CANDIDATES).select("cell", "pid", "x")
    pivots = checkpointed(some.groupBy("cell").applyInPandas(_pivots, "cell bigint, pivots array<array<double>>"))

    def route(part: pd.DataFrame, nodes: Nodes) -> pd.DataFrame:
        cell = part["cell"].to_numpy()
        here, place = nodes.at(cell)
        out = part.assign(parent=np.where(here, cell, -1), d=None)
        if here.any():
            d = nodes.distances(as_matrix(part["x"][here]), place[here])
            child = cell.copy()
            child[here] = cell[here] * FAN + d.argmin(axis=1) + 1
            held = np.empty(len(part), object)
            for k, row, own in zip(np.flatnonzero(here), d, nodes.there[place[here]]):
                held[k] = row[own]
            out = out.assign(cell=child, d=held)
        return out

    unranged = pivots.select("cell", "pivots", *[F.array(F.array(F.lit(0.0))).alias(c) for c in ("low", "high")], F.array(F.lit(0)).alias("n"))
    routed = checkpointed(_meet(points.select("pid", "x", "n", "cell"), unranged, route, "pid bigint, x array<double>, n bigint, cell bigint, parent bigint, d array<double>"))
    width = len(pivots.first()["pivots"][0])
    ranges = [f(F.get("d", F.lit(k))).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(FAN)]
    sides = [f(F.get("x", F.lit(k))).alias(f"{name}{k}") for name, f in (("floor", F.min), ("ceiling", F.max)) for k in range(width)]
    children = routed.where("parent >= 0").groupBy("parent", "cell").agg(F.sum("n").alias("n"), *ranges, *sides)
    present = [F.array_compact(F.array(*[f"{name}{k}" for k in range(FAN)])).alias(name) for name in ("low", "high")]
    present += [F.array(*[f"{name}{k}" for k in range(width)]).alias(name) for name in ("floor", "ceiling")]
    children = children.select(F.col("parent").alias("cell"), F.struct(F.col("cell").alias("child"), *present, "n").alias("child"))
    nodes = children.groupBy("cell").agg(F.sort_array(F.collect_list("child")).alias("children"))  # at most FAN
    nodes = pivots.join(nodes, "cell").select("cell", "pivots", *[f"children.{c}" for c in ("low", "high", "n", "floor", "ceiling")])
    return routed.select("pid", "x", "n", "cell"), checkpointed(nodes)


@dataclass(frozen=True)
class PointIndex:
    points: DataFrame  # pid, x, n, cell (a leaf)
    levels: tuple[DataFrame, ...]  # cell, pivots, low, high, n, floor, ceiling of the inner cells, from the root down
    held: dict = field(default_factory=dict, compare=False)  # levels of few nodes, once they were fetched

    @staticmethod
    def build(points: DataFrame, leaf_points: int = LEAF_POINTS) -> "PointIndex":
        """Index of (pid, x, n) with distinct x. The answers do not depend on the pivots."""
        placed, levels = points.select("pid", "x", "n", F.lit(0).cast("bigint").alias("cell")), []
        while len(levels) < MOST_LEVELS and (found := _split(placed, leaf_points)):
            placed = found[0]
            levels.append(found[1])
        return PointIndex(checkpointed(placed), tuple(levels))

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        for k, nodes in enumerate(self.levels):
            nodes.withColumn("level", F.lit(k)).write.mode("append" if k else "overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str, levels: int) -> "PointIndex":
        inner = [spark.read.parquet(f"{path}/nodes").where(F.col("level") == k).drop("level") for k in range(levels)]
        return PointIndex(spark.read.parquet(f"{path}/points"), tuple(inner))

    def visits(self, queries: DataFrame, need: int, home: bool) -> DataFrame:
        """(q, x, within, home, cell): the leaf around each query (q, x, within, home), or all leaves
        but ``home`` that its ``within`` reaches. ``within`` shrinks to what the ranges promise."""
        schema = "q bigint, x array<double>, within double, home bigint, cell bigint"

        def run(part: pd.DataFrame, levels: tuple[Nodes, ...]) -> pd.DataFrame:
            x, reach = as_matrix(part["x"]), part["within"].to_numpy(float, copy=True)
            row, cell, away = np.arange(len(part)), part["cell"].to_numpy(np.int64), np.zeros(len(part))
            for nodes in levels:
                here, place = nodes.at(cell)
                steps = [(row[~here], cell[~here], away[~here])]
                inner = np.flatnonzero(here)
                for start in range(0, len(inner), QUERY_POINTS):
                    at = inner[start:start + QUERY_POINTS]
                    d, least, within = nodes.children(x[row[at]], place[at], reach[row[at]], need)
                    np.minimum.at(reach, row[at], within)
                    own, child = (np.arange(len(at)), d.argmin(axis=1)) if home else np.nonzero(least <= reach[row[at]][:, None] * (1 + 1e-9))
                    steps.append((row[at][own], cell[at][own] * FAN + child + 1, least[own, child]))
                row, cell, away = (np.concatenate(v) for v in zip(*steps))
            if not home:  # other ways down may have shortened the reach
                still = away <= reach[row] * (1 + 1e-9)
                row, cell = row[still], cell[still]
            return part.iloc[row].assign(within=reach[row], cell=cell)

        found = spread(queries.select("q", "x", "within", "home", F.lit(0).cast("bigint").alias("cell")), "q")
        few: list[Nodes] = []
        for level, nodes in enumerate(self.levels):
            own = self._few(level)
            if few and (own is None or sum(len(n.cells) for n in few) + len(own.cells) > SHARED):
                found, few = _meet_shared(found, tuple(few), run, schema), []
            if own is None:
                found = _meet_joined(found, nodes, lambda part, node: run(part, (node,)), schema)
            else:
                few.append(own)
        found = _meet_shared(found, tuple(few), run, schema) if few else found
        return checkpointed(found if home else found.where("cell <> home"))

    def _few(self, level: int) -> Nodes | None:
        """The nodes of a level, or nothing where they are too many to send to all tasks."""
        if (level, SHARED) not in self.held:
            few = self.levels[level].limit(SHARED + 1).toPandas()
            self.held[level, SHARED] = Nodes.of(few) if len(few) <= SHARED else None
        return self.held[level, SHARED]

    def _search(self, visits: DataFrame, need: int) -> DataFrame:
        """(q, p, d, n): of each leaf met, the ``need`` nearest points within reach."""
        parts = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_POINTS).alias("parts"))
        asked = visits.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).drop("parts")
        own = self.points.select(*[F.col(c).alias(c) for c in self.points.columns])  # queries may come from the same table
        held = own.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(points):
                return pd.DataFrame({"q": [], "p": [], "d": [], "n": []})
            names = points["pid"].to_numpy()
            row, p, d = reached(as_matrix(queries["x"]), as_matrix(points["x"]), queries["within"].to_numpy(float), min(need, len(points)))
            return pd.DataFrame({"q": queries["q"].to_numpy()[row], "p": names[p], "d": d, "n": points["n"].to_numpy()[p]})

        keys = ["cell", "part"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, "q bigint, p bigint, d double, n bigint")

    def nearest(self, queries: DataFrame, need: int) -> DataFrame:
        """(q, p, d, taken): per query (q, x) its nearest points until ``need`` rows are taken."""
        start = queries.select("q", "x", F.lit(float("inf")).alias("within"), F.lit(-1).cast("bigint").alias("home"))
        around = self.visits(start, need, home=True)
        near = checkpointed(_first(self._search(around, need), need))
        known = near.groupBy("q").agg(F.sum("taken").alias("taken"), F.max("d").alias("d"))
        bound = F.least("within", F.when(F.col("taken") >= need, F.col("d")))  # least() passes over null
        again = around.join(known, "q", "left").select("q", "x", bound.alias("within"), F.col("cell").alias("home"))
        others = self._search(self.visits(again, need, home=False), need)
        return checkpointed(_first(near.select("q", "p", "d", "n").unionByName(others), need)).drop("n")


def _first(found: DataFrame, need: int) -> DataFrame:
    """Adds ``taken`` and keeps the nearest rows of each query that fill ``need``."""
    by_distance = Window.partitionBy("q").orderBy("d", "p")
    few = found.withColumn("at", F.row_number().over(by_distance)).where(F.col("at") <= need)
    before = F.coalesce(F.sum("n").over(by_distance.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("before", before).where(F.col("before") < need)
    return few.select("q", "p", "d", "n", F.least(F.col("n"), F.lit(need) - F.col("before")).alias("taken"))


def fewer(near: DataFrame, need: int) -> tuple[DataFrame, DataFrame]:
    """Of (q, p, d, taken), what fills ``need`` rows of each query; and (q, shared) of queries where the next is as near as the last."""
    by_distance = Window.partitionBy("q").orderBy("d", "p")
    before = F.coalesce(F.sum("taken").over(by_distance.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = near.withColumns({"before": before, "last": F.lag("d").over(by_distance)})
    few = ranked.where(F.col("before") < need)
    shared = ranked.where((F.col("before") == need) & (F.col("last") == F.col("d"))).select("q", F.lit(True).alias("shared"))
    return few.select("q", "p", "d", F.least(F.col("taken"), F.lit(need) - F.col("before")).alias("taken")), shared


def others(near: DataFrame) -> DataFrame:
    """``near`` of points of the table itself: a row is not its own neighbour."""
    taken = F.col("taken") - (F.col("q") == F.col("p")).cast("int")
    return near.withColumn("taken", taken).where("taken > 0")


def neighbours_among(points: DataFrame, index: PointIndex, k: int) -> DataFrame:
    """(q, p, d, taken): the ``k`` nearest other rows of one row of each point; copies count."""
    return others(index.nearest(points.select(F.col("pid").alias("q"), "x"), k + 1))
