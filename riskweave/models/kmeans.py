"""k-means for many numbers of clusters and many starts at once, over sparse rows.

Rows are (id, at, value): places of features and their values. All models that fit into
``GROUP`` numbers take each step together: one pass over the rows assigns every row in every
model and adds up sums by (model, centre), which leave a task in slices of features. A start
is one sequence of distance-weighted random seeds; the model of k clusters begins with the
first k of them. Of the starts of a k the one with the lowest cost is kept, and the
silhouettes of all kept models are one more pass.

The silhouette is by squared distances, where a row's mean distance to a cluster follows
from the cluster's mean and mean square. Rows with equal ids draw alike; nothing depends on
partitions but the last digits of sums.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

STARTS, STEPS, TOLERANCE = 10, 100, 1e-4
#: Numbers (centres times features) that take a step together, 32 MB; a larger model goes alone.
GROUP = 1 << 22
#: Features in one slice of sums.
SLICE = 4096
ENTRIES = 4096
#: Rows with at least one entry in so many features are multiplied as a dense matrix.
DENSE = 16


class Rows(NamedTuple):
    """Sparse rows of one batch."""

    n: int
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray
    square: np.ndarray  # each row's sum of squares

    @staticmethod
    def of(pdf: pd.DataFrame) -> "Rows":
        sizes = pdf["at"].map(len).to_numpy()
        row = np.repeat(np.arange(len(pdf)), sizes)
        at = np.concatenate(pdf["at"].to_numpy()).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        value = np.concatenate(pdf["value"].to_numpy()).astype(float) if len(row) else np.zeros(0)
        return Rows(len(pdf), row, at, value, np.bincount(row, value**2, len(pdf)))

    def products(self, turned: np.ndarray) -> np.ndarray:
        """The product of each row with each column of ``turned`` (feature, centre)."""
        width = len(turned)
        if self.n * width <= DENSE * len(self.row):
            return np.bincount(self.row * width + self.at, self.value, self.n * width).reshape(self.n, width) @ turned
        out = np.zeros((self.n, turned.shape[1]))
        for low in range(0, len(self.row), ENTRIES):
            row, at, value = (v[low:low + ENTRIES] for v in (self.row, self.at, self.value))
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] += np.add.reduceat(value[:, None] * turned[at], first, axis=0)
        return out

    def distances(self, centres: np.ndarray, turned: np.ndarray) -> np.ndarray:
        """Squared distances to the centres."""
        return np.maximum(self.square[:, None] - 2 * self.products(turned) + (centres**2).sum(axis=1), 0.0)


def _batches(batches, rows: int = 2048):
    for pdf in batches:
        for start in range(0, len(pdf), rows):
            part = pdf.iloc[start:start + rows]
            yield part, Rows.of(part)


def _uniform(ids: pd.Series, *salt: int) -> np.ndarray:
    """A number between 0 and 1 for each id, fixed by the salt."""
    with np.errstate(over="ignore"):
        x = pd.util.hash_array(ids.astype(str).to_numpy(object)).astype(np.uint64)
        for s in salt:
            x = (x ^ np.uint64(s)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
    return (x.astype(float) + 1.0) / 2.0**64


def seeds(rows: DataFrame, width: int, most: int, starts: int, seed: int) -> list[np.ndarray]:
    """For each start up to ``most`` distinct seeds (k, width): each is drawn by its squared distance to the nearest one before."""
    found = [np.zeros((0, width)) for _ in range(starts)]
    going = list(range(starts))
    for step in range(most):
        centres = np.concatenate([found[s] for s in going])
        shared = rows.sparkSession.sparkContext.broadcast((centres, np.ascontiguousarray(centres.T)))

        def draw(batches, going=tuple(going), step=step):
            best = {}
            for pdf, x in _batches(batches):
                away = x.distances(*shared.value) if step else None
                for k, start in enumerate(going):
                    weight = away[:, k * step:(k + 1) * step].min(axis=1) if step else np.ones(x.n)
                    key = -np.log(_uniform(pdf["id"], seed, start, step)) / np.where(weight > 1e-12, weight, np.nan)
                    if np.isfinite(key).any():
                        at = int(np.nanargmin(key))
                        if start not in best or key[at] < best[start][0]:
                            best[start] = (float(key[at]), pdf["at"].iloc[at], pdf["value"].iloc[at])
            yield pd.DataFrame([(s, *b) for s, b in best.items()], columns=["start", "key", "at", "value"])

        drawn = rows.mapInPandas(draw, "start int, key double, at array<int>, value array<double>")
        drawn = drawn.groupBy("start").agg(F.min_by(F.struct("at", "value"), "key").alias("row")).collect()  # a row for each start
        going = sorted(r["start"] for r in drawn)
        for r in drawn:
            dense = np.zeros((1, width))
            dense[0, np.array(r["row"]["at"], int)] = r["row"]["value"]
            found[r["start"]] = np.concatenate([found[r["start"]], dense])
        if not going:
            break
    return found


class Sums(NamedTuple):
    sums: np.ndarray  # (centre, feature)
    counts: np.ndarray
    squares: np.ndarray  # of the rows of a centre
    costs: np.ndarray


def _assigned(rows: DataFrame, centres: np.ndarray, bounds: np.ndarray) -> Sums:
    """Sums over the rows of each centre; model m has centres bounds[m] to bounds[m + 1]."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, np.ascontiguousarray(centres.T)))
    width = centres.shape[1]

    def run(batches):
        centres, turned = shared.value
        sums, facts = np.zeros(centres.size), np.zeros((len(centres), 3))
        for _, x in _batches(batches):
            away = x.distances(centres, turned)
            for low, high in zip(bounds[:-1], bounds[1:]):
                own = low + away[:, low:high].argmin(axis=1)
                np.add.at(sums, own[x.row] * width + x.at, x.value)
                facts[:, 0] += np.bincount(own, minlength=len(centres))
                facts[:, 1] += np.bincount(own, x.square, len(centres))
                facts[:, 2] += np.bincount(own, away[np.arange(x.n), own], len(centres))
        sums = sums.reshape(centres.shape)
        out = [(c, -1, facts[c]) for c in np.flatnonzero(facts[:, 0])]
        for low in range(0, width, SLICE):
            part = sums[:, low:low + SLICE]
            out += [(c, low, part[c]) for c in np.flatnonzero(part.any(axis=1))]
        yield pd.DataFrame(out, columns=["centre", "low", "part"])

    parts = rows.mapInPandas(run, "centre int, low int, part array<double>").select("centre", "low", F.posexplode("part").alias("place", "v"))
    found = parts.groupBy("centre", "low", "place").agg(F.sum("v").alias("v")).toPandas()  # at most ``GROUP`` numbers
    sums, facts = np.zeros(centres.shape), np.zeros((len(centres), 3))
    centre, low, place, v = (found[c].to_numpy() for c in ("centre", "low", "place", "v"))
    fact = low < 0
    facts[centre[fact], place[fact]] = v[fact]
    sums[centre[~fact], (low + place)[~fact]] = v[~fact]
    return Sums(sums, facts[:, 0], facts[:, 1], np.add.reduceat(facts[:, 2], bounds[:-1]))


def _groups(models: list[np.ndarray], width: int) -> list[list[int]]:
    """Numbers of models that take a step together."""
    out, size = [[]], 0
    for m, centres in enumerate(models):
        if out[-1] and (size + len(centres)) * width > GROUP:
            out.append([])
            size = 0
        out[-1].append(m)
        size += len(centres)
    return out if models else []


def _bounds(models: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, models)])


def lloyd(rows: DataFrame, models: list[np.ndarray], tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[list[np.ndarray], np.ndarray]:
    """The models after as many steps as each needs, and their costs. A centre without rows stays where it is."""
    models, costs = [m.copy() for m in models], np.full(len(models), np.inf)
    going = list(range(len(models)))
    for _ in range(steps):
        still = []
        for group in _groups([models[m] for m in going], models[0].shape[1] if models else 1):
            own = [going[g] for g in group]
            bounds = _bounds([models[m] for m in own])
            found = _assigned(rows, np.concatenate([models[m] for m in own]), bounds)
            for m, low, high, cost in zip(own, bounds[:-1], bounds[1:], found.costs):
                counts = found.counts[low:high, None]
                new = np.where(counts > 0, found.sums[low:high] / np.maximum(counts, 1), models[m])
                moved = ((new - models[m]) ** 2).sum()
                models[m], costs[m] = new, cost
                if moved > tolerance:
                    still.append(m)
        going = still
        if not going:
            break
    return models, costs


def silhouettes(rows: DataFrame, models: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean silhouette of each model, and the sizes of its clusters."""
    out, sizes = np.full(len(models), -1.0), [np.zeros(0)] * len(models)
    for group in _groups(models, models[0].shape[1] if models else 1):
        own = [models[m] for m in group]
        bounds = _bounds(own)
        centres = np.concatenate(own)
        found = _assigned(rows, centres, bounds)
        counts = np.maximum(found.counts, 1)
        means, squares = found.sums / counts[:, None], found.squares / counts
        shared = rows.sparkSession.sparkContext.broadcast((centres, np.ascontiguousarray(centres.T), np.ascontiguousarray(means.T), found.counts, squares))

        def run(batches):
            centres, turned, means, counts, squares = shared.value
            total, n = np.zeros(len(bounds) - 1), 0
            for _, x in _batches(batches):
                away = x.distances(centres, turned)
                mean = np.maximum(x.square[:, None] - 2 * x.products(means) + squares, 0.0)
                mean[:, counts == 0] = np.inf
                n += x.n
                for m, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
                    own = low + away[:, low:high].argmin(axis=1)
                    there = np.arange(x.n)
                    inside = mean[there, own] * counts[own] / np.maximum(counts[own] - 1, 1)  # of the others
                    rest = mean[:, low:high].copy()
                    rest[there, own - low] = np.inf
                    outside = rest.min(axis=1)
                    score = np.where(np.isfinite(outside), (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
                    total[m] += score[counts[own] > 1].sum()
            yield pd.DataFrame({"model": range(len(total)), "total": total, "n": n})

        got = rows.mapInPandas(run, "model int, total double, n bigint").groupBy("model").agg((F.sum("total") / F.sum("n")).alias("s")).collect()
        for r in got:
            out[group[r["model"]]] = r["s"] if r["s"] is not None else -1.0
        for m, low, high in zip(group, bounds[:-1], bounds[1:]):
            sizes[m] = found.counts[low:high]
    return out, sizes


class Fitted(NamedTuple):
    centres: np.ndarray
    cost: float
    silhouette: float
    sizes: np.ndarray


def fit_many(rows: DataFrame, width: int, ks: list[int], starts: int = STARTS, seed: int = 42) -> dict[int, Fitted]:
    """For each k that has as many distinct rows, the start of lowest cost."""
    drawn = seeds(rows, width, max(ks, default=0), starts, seed)
    named = [(k, s) for k in ks for s in range(starts) if len(drawn[s]) >= k]
    models, costs = lloyd(rows, [drawn[s][:k] for k, s in named])
    best = {}
    for (k, _), centres, cost in zip(named, models, costs):
        if k not in best or cost < best[k][1]:
            best[k] = (centres, float(cost))
    scores, sizes = silhouettes(rows, [c for c, _ in best.values()])
    return {k: Fitted(c, cost, float(s), n) for (k, (c, cost)), s, n in zip(best.items(), scores, sizes)}
