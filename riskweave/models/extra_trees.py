"""Extremely randomised trees, grown level by level over all rows.

Every tree sees every row. A node draws features at random and one random cut for each,
between the smallest and largest value that its own rows have, and takes the cut that
separates the classes best; features that are constant in it are passed over. Draws have
their place in one random sequence a level, by the node's number among all nodes of the level.

A table of up to ``WHOLE`` values is sent to all tasks, and a level is one pass in which each
task grows its own trees over all rows. A larger one stays where it is: a level is two
aggregates over it, for all nodes of all trees at once, ranges of the features, then class
counts on both sides of the drawn cuts. Only these go to the driver, at most ``max_leaves``
nodes a tree and level. Both ways give the same forest, and as counts are whole numbers, it
does not depend on how the rows are partitioned.

Trees grow until their leaves are pure. Where that takes more than ``max_leaves`` leaves,
the nodes of most rows are split first.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.models.vectors import as_matrix, points

TREES, MAX_LEAVES, MAX_DEPTH = 150, 1024, 64
BLOCK = 8192
#: Values of a table (32 MB) up to which each task has all rows.
WHOLE = 1 << 22
COLUMNS = ["feature", "cut", "left", "right", "chance"]


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees; tree t has its root at t. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    chance: np.ndarray  # of the positive class

    def leaf_of(self, x: np.ndarray, root: int) -> np.ndarray:
        node = np.full(len(x), root)
        inner = np.flatnonzero(self.feature[node] >= 0)
        while len(inner):
            at = node[inner]
            goes_left = x[inner, self.feature[at]] <= self.cut[at]
            node[inner] = np.where(goes_left, self.left[at], self.right[at])
            inner = inner[self.feature[node[inner]] >= 0]
        return node


def _by_node(forest: Forest, trees: Iterable[int], number: np.ndarray, x: np.ndarray):
    """For each tree: the rows in growing nodes, ordered by node; the first row of each; and the nodes' numbers."""
    for root in trees:
        at = number[forest.leaf_of(x, root)]
        rows = np.flatnonzero(at >= 0)
        if len(rows):
            rows = rows[np.argsort(at[rows], kind="stable")]
            first = np.flatnonzero(np.diff(at[rows], prepend=-1))
            yield rows, first, at[rows]


def _ranges(table: DataFrame, forest: Forest, trees: int, number: np.ndarray, active: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and largest value of each feature in each growing node."""
    shared = table.sparkSession.sparkContext.broadcast((forest, number))
    names = [f"{side}{k}" for side in ("low", "high") for k in range(width)]

    def run(batches):
        forest, number = shared.value
        low, high = np.full((active, width), np.inf), np.full((active, width), -np.inf)
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK):
                x = as_matrix(pdf["x"].iloc[start:start + BLOCK])
                for rows, first, at in _by_node(forest, range(trees), number, x):
                    node = at[first]
                    low[node] = np.minimum(low[node], np.minimum.reduceat(x[rows], first))
                    high[node] = np.maximum(high[node], np.maximum.reduceat(x[rows], first))
        met = np.flatnonzero(low[:, 0] <= high[:, 0])
        yield pd.DataFrame({"node": met} | dict(zip(names, np.concatenate([low[met], high[met]], axis=1).T)))

    parts = table.mapInPandas(run, "node bigint, " + ", ".join(f"{n} double" for n in names))
    both = [(F.min if n.startswith("low") else F.max)(n).alias(n) for n in names]
    found = parts.groupBy("node").agg(*both).orderBy("node").toPandas()
    return found[names[:width]].to_numpy(), found[names[width:]].to_numpy()


def _counts(table: DataFrame, forest: Forest, trees: int, number: np.ndarray, drawn: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(node, draw, side, class): rows of each class on each side of each drawn cut."""
    active, draws = drawn.shape
    shared = table.sparkSession.sparkContext.broadcast((forest, number, drawn, cuts))
    names = [f"n{k}" for k in range(draws * 4)]

    def run(batches):
        forest, number, drawn, cuts = shared.value
        total = np.zeros((active, draws, 2, 2), np.int64)
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK):
                part = pdf.iloc[start:start + BLOCK]
                x, positive = as_matrix(part["x"]), part["label"].to_numpy() == 1
                for rows, first, at in _by_node(forest, range(trees), number, x):
                    total[at[first]] += _side_counts(x[rows], positive[rows], first, drawn[at], cuts[at])
        met = np.flatnonzero(total.any(axis=(1, 2, 3)))
        yield pd.DataFrame({"node": met} | dict(zip(names, total[met].reshape(len(met), draws * 4).T)))

    parts = table.mapInPandas(run, "node bigint, " + ", ".join(f"{n} bigint" for n in names))
    found = parts.groupBy("node").agg(*[F.sum(n).alias(n) for n in names]).orderBy("node").toPandas()
    return found[names].to_numpy(np.int64).reshape(active, draws, 2, 2)


def _impurity(sides: np.ndarray) -> np.ndarray:
    """Weighted Gini impurity of class weights in the last axis, times their total."""
    total = sides.sum(axis=-1)
    return total - (sides**2).sum(axis=-1) / np.maximum(total, 1e-300)


def _side_counts(x: np.ndarray, positive: np.ndarray, first: np.ndarray, drawn: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(node, draw, side, class) of rows in the order of their nodes, with each row's drawn features and cuts."""
    right = np.take_along_axis(x, drawn, axis=1) > cuts
    out = np.empty((len(first), drawn.shape[1], 2, 2), np.int64)
    for side, there in enumerate((~right, right)):
        for kind, own in enumerate((~positive, positive)):
            out[:, :, side, kind] = np.add.reduceat(there & own[:, None], first, axis=0, dtype=np.int64)
    return out


def _draw(seed: int, level: int, active: int, nodes: slice, low: np.ndarray, high: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features drawn, whether each varies, cuts) of the nodes, a run of the ``active`` ones of the level."""
    def part(before: int, width: int) -> np.ndarray:
        rng = np.random.default_rng([seed, level])
        rng.bit_generator.advance(int(before + nodes.start * width))
        return rng.random((nodes.stop - nodes.start, width))

    width = low.shape[1]
    # the first features of a random order that are not constant in the node
    order = np.argsort(np.where(high > low, part(0, width), 2.0), axis=1)[:, :draws]
    at = np.arange(len(low))[:, None]
    varies = (high > low)[at, order]
    cuts = low[at, order] + part(active * width, draws) * (high - low)[at, order]
    return order, varies, np.where(cuts >= high[at, order], low[at, order], cuts)  # rounding may reach the largest value


def _best(counts: np.ndarray, varies: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The draw of each node that separates the classes best."""
    weighted = counts * weight
    return np.where(varies, _impurity(weighted.sum(axis=2)) - _impurity(weighted).sum(axis=2), -np.inf).argmax(axis=1)


def _level_apart(table: DataFrame, forest: Forest, growing: np.ndarray, number: np.ndarray, trees: int, seed: int, level: int, weight: np.ndarray, width: int, draws: int):
    """Of each node that can be split: (its place in ``growing``, feature, cut, counts by side and class). Two aggregates over the table."""
    low, high = _ranges(table, forest, trees, number, len(growing), width)
    order, varies, cuts = _draw(seed, level, len(growing), slice(0, len(growing)), low, high, draws)
    counts = _counts(table, forest, trees, number, order, cuts)
    splits = np.flatnonzero(varies.any(axis=1))
    best = _best(counts, varies, weight)[splits]
    return splits, order[splits, best], cuts[splits, best], counts[splits, best]


def _level_whole(held, spark: SparkSession, forest: Forest, tree_of: np.ndarray, number: np.ndarray, trees: int, seed: int, level: int, weight: np.ndarray, draws: int):
    """As ``_level_apart``, where each task has all rows and grows its own trees. ``tree_of`` has the growing nodes' trees, in order."""
    active, first_of = len(tree_of), np.searchsorted(tree_of, np.arange(trees + 1))
    shared = spark.sparkContext.broadcast((forest, number, first_of))
    names = ["n00", "n01", "n10", "n11"]

    def run(batches):
        (x, positive), (forest, number, first_of) = held.value, shared.value
        for pdf in batches:
            own = [t for t in pdf["id"] if first_of[t] < first_of[t + 1]]
            for rows, first, at in _by_node(forest, own, number, x):
                nodes, part = slice(at[0], at[-1] + 1), x[rows]  # each growing node has rows
                low, high = np.minimum.reduceat(part, first), np.maximum.reduceat(part, first)
                order, varies, cuts = _draw(seed, level, active, nodes, low, high, draws)
                counts = _side_counts(part, positive[rows], first, order[at - at[0]], cuts[at - at[0]])
                splits = np.flatnonzero(varies.any(axis=1))
                best = _best(counts, varies, weight)[splits]
                sides = counts[splits, best].reshape(-1, 4)
                yield pd.DataFrame({"node": splits + at[0], "feature": order[splits, best], "cut": cuts[splits, best]} | dict(zip(names, sides.T)))

    parts = min(trees, 2 * spark.sparkContext.defaultParallelism)
    found = spark.range(0, trees, 1, parts).mapInPandas(run, "node bigint, feature bigint, cut double, " + ", ".join(f"{n} bigint" for n in names))
    found = found.toArrow().to_pandas().sort_values("node")
    shared.unpersist()
    return found["node"].to_numpy(np.int64), found["feature"].to_numpy(np.int64), found["cut"].to_numpy(float), found[names].to_numpy(np.int64).reshape(-1, 2, 2)


@dataclass(frozen=True)
class ExtraTrees:
    features: tuple[str, ...]
    trees: int
    forest: Forest

    @staticmethod
    def fit(train: DataFrame, features: list[str], label: str = "label", trees: int = TREES, max_leaves: int = MAX_LEAVES,
            max_depth: int = MAX_DEPTH, seed: int = 42) -> "ExtraTrees":
        """Both classes weigh the same in total. ``train`` should be materialised: a large one is read twice a level."""
        spark, table = train.sparkSession, points(train, features, label).withColumnRenamed("id", "label")
        sizes = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"), F.count(F.lit(1)).alias("rows")).first()
        classes = np.array([sizes["n"], sizes["p"]], float)
        weight = classes.sum() / (2 * np.maximum(classes, 1))
        width, draws = len(features), max(1, int(np.sqrt(len(features))))
        chance = classes[1] * weight[1] / max((classes * weight).sum(), 1e-300)
        forest = Forest(np.full(trees, -1), np.zeros(trees), np.full(trees, -1), np.full(trees, -1), np.full(trees, chance))
        held = None
        if classes.all() and sizes["rows"] * width <= WHOLE:
            rows = table.toArrow()  # at most WHOLE values
            x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held = spark.sparkContext.broadcast((x, rows["label"].to_pandas().to_numpy() == 1))
            del rows, x
        growing, tree_of, leaves = np.arange(trees if classes.all() else 0), np.arange(trees), np.ones(trees, int)
        for level in range(max_depth):
            if not len(growing):
                break
            number = np.full(len(forest.feature), -1)
            number[growing] = np.arange(len(growing))
            if held is None:
                splits, feature, cut, sides = _level_apart(table, forest, growing, number, trees, seed, level, weight, width, draws)
            else:
                splits, feature, cut, sides = _level_whole(held, spark, forest, tree_of[growing], number, trees, seed, level, weight, draws)
            # of each tree the nodes of most rows first, as far as it has leaves to give
            chosen = np.lexsort((splits, -sides.sum(axis=(1, 2)), tree_of[growing[splits]]))
            owner = tree_of[growing[splits[chosen]]]
            place = np.arange(len(chosen)) - np.searchsorted(owner, owner)
            chosen = chosen[place < max_leaves - leaves[owner]]
            nodes, sides = growing[splits[chosen]], sides[chosen]  # sides: (split, side, class)
            owner = tree_of[nodes]
            np.add.at(leaves, owner, 1)
            new = len(forest.feature) + np.arange(2 * len(nodes))
            shares = sides * weight
            fresh = np.full(len(new), -1)
            forest = Forest(np.append(forest.feature, fresh), np.append(forest.cut, np.zeros(len(new))), np.append(forest.left, fresh),
                            np.append(forest.right, fresh), np.append(forest.chance, (shares[:, :, 1] / shares.sum(axis=2)).ravel()))
            forest.feature[nodes], forest.cut[nodes] = feature[chosen], cut[chosen]
            forest.left[nodes], forest.right[nodes] = new[::2], new[1::2]
            tree_of = np.append(tree_of, np.repeat(owner, 2))
            mixed = (sides > 0).all(axis=2).ravel()
            growing = new[mixed & (leaves[tree_of[new]] < max_leaves)]
        if held is not None:
            held.unpersist()
        return ExtraTrees(tuple(features), trees, forest)

    def predict(self, table: DataFrame, name: str = "extra_probability") -> DataFrame:
        """Adds the mean chance of a row's leaves."""
        shared, trees = table.sparkSession.sparkContext.broadcast(self.forest), self.trees

        @F.pandas_udf("double")
        def chance(x: pd.Series) -> pd.Series:
            forest, rows = shared.value, as_matrix(x)
            return pd.Series(sum(forest.chance[forest.leaf_of(rows, root)] for root in range(trees)) / trees if len(rows) else [], dtype=float)

        return table.withColumn(name, chance(F.array(*[F.col(c).cast("double") for c in self.features])))

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = pd.DataFrame({c: getattr(self.forest, c) for c in COLUMNS}).rename_axis("node").reset_index()
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(list(self.features), self.trees)], "features array<string>, trees int").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ExtraTrees":
        meta, nodes = spark.read.parquet(f"{path}/meta").first(), spark.read.parquet(f"{path}/nodes").orderBy("node").toPandas()
        return ExtraTrees(tuple(meta["features"]), meta["trees"], Forest(*(nodes[c].to_numpy() for c in COLUMNS)))
