from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from riskweave.models import kmeans


def sparse_rows(spark, x):
    at = [np.flatnonzero(v).tolist() for v in x]
    pdf = pd.DataFrame({"id": [f"u{k}" for k in range(len(x))], "at": at, "value": [v[a].tolist() for v, a in zip(x, at)]})
    return spark.createDataFrame(pdf, "id string, at array<int>, value array<double>").repartition(3)


def plain(x, centres, steps=kmeans.STEPS):
    for _ in range(steps):
        away = ((x[:, None] - centres[None]) ** 2).sum(-1)
        own = away.argmin(1)
        new = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        cost, moved, centres = away.min(1).sum(), ((new - centres) ** 2).sum(), new
        if moved <= kmeans.TOLERANCE:
            break
    return centres, cost


def silhouette(x, own):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for i, c in enumerate(own):
        if (own == c).sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own == c].sum() / ((own == c).sum() - 1)
        b = min(d[i, own == o].mean() for o in set(own) if o != c)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def cloud(n=150, width=9, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, size=(n, 1)) * rng.random((1, width)) * 3 + rng.random((n, width)) * (rng.random((n, width)) < 0.5)
    return x.round(3)


def test_all_models_at_once_equal_plain_steps_from_the_same_seeds(spark):
    x = cloud()
    rows = sparse_rows(spark, x).cache()
    drawn = kmeans.seeds(rows, x.shape[1], 5, 3, 42)
    for sequence in drawn:
        assert len(sequence) == 5 and len(np.unique(sequence, axis=0)) == 5
        assert all((x == s).all(1).any() for s in sequence)
    want = {k: min((plain(x, s[:k]) for s in drawn), key=lambda m: m[1]) for k in (2, 3, 5)}
    got = kmeans.fit_many(rows, x.shape[1], [2, 3, 5], 3, 42)
    assert list(got) == [2, 3, 5]
    for k, (centres, cost) in want.items():
        np.testing.assert_allclose(got[k].centres, centres, atol=1e-9)
        assert got[k].cost == pytest.approx(cost)
        own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        assert got[k].silhouette == pytest.approx(silhouette(x, own)) and got[k].sizes.sum() == len(x)


def test_steps_in_small_groups_and_slices_change_nothing(spark, monkeypatch):
    x = cloud(60)
    rows = sparse_rows(spark, x).cache()
    whole = kmeans.fit_many(rows, x.shape[1], [2, 3], 2)
    monkeypatch.setattr(kmeans, "GROUP", 20)
    monkeypatch.setattr(kmeans, "SLICE", 4)
    parts = kmeans.fit_many(rows, x.shape[1], [2, 3], 2)
    for k in (2, 3):
        np.testing.assert_allclose(parts[k].centres, whole[k].centres, atol=1e-12)
        assert parts[k].silhouette == pytest.approx(whole[k].silhouette)


def test_fewer_distinct_rows_than_clusters(spark):
    x = np.array([[1.0, 0.0]] * 5 + [[0.0, 2.0]] * 4)
    got = kmeans.fit_many(sparse_rows(spark, x), 2, [2, 3, 8], 2)
    assert list(got) == [2] and got[2].cost == pytest.approx(0.0) and got[2].silhouette == pytest.approx(1.0)
    assert kmeans.fit_many(sparse_rows(spark, x).where("false"), 2, [2], 2) == {}


def test_short_rows_over_few_features_are_multiplied_as_one_matrix(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 12)) < 0.5, rng.normal(size=(40, 12)), 0.0)
    x[3] = 0.0
    at = [np.flatnonzero(v).tolist() for v in x]
    rows = kmeans.Rows.of(pd.DataFrame({"at": at, "value": [v[a].tolist() for v, a in zip(x, at)]}))
    turned, wide = rng.normal(size=(12, 7)), rng.normal(size=(4000, 7))
    assert np.allclose(rows.products(wide), x @ wide[:12])  # too wide for a matrix: by entries
    monkeypatch.setattr(kmeans, "ENTRIES", None)  # of no use where rows are not taken apart
    assert np.allclose(rows.products(turned), x @ turned)
