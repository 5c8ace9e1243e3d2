"""Whitening against a plain version with exact integers and numpy's covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, z string, component int, weight int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)


def plain(rows):
    """vec_id, deviation and centred x of whole rows; n; the covariance."""
    own = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
           if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in own})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    return [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), [c - s / n for c, s in zip(x, sums)]) for i, x in own], n, centred.T @ centred / n


def test_whitened_rows_equal_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 20)) * np.linspace(0.2, 2, 20)).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(base)]
    rows += [(1000 + k, base[7]) for k in range(150)]  # a third of all rows are copies
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] + base[0][1:]), (2004, [float("inf")] + base[0][1:]), (2005, base[0][:19]), (None, base[3]), (5, base[5])]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op12_whitening(spark, str(tmp_path)).toPandas()
    want, n, covariance = plain([r for r in rows if r[0] != 2005])
    assert len(got) == 16 * len(want) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    values, axes = np.linalg.eigh(covariance)
    for k in range(1, 17):
        part = got[got["component"] == k].sort_values(["vec_id", "whitened"], na_position="first")
        expected = sorted(((i if i is not None else -1, s, float(np.dot(c, axes[:, -k]) / math.sqrt(values[-k]))) for i, s, c in want))
        assert part["deviation"].tolist() == [s for _, s, _ in expected]
        flip = np.sign(np.dot(part["whitened"], [w for *_, w in expected]))
        np.testing.assert_allclose(part["whitened"] * flip, [w for *_, w in expected], atol=1e-9)
        np.testing.assert_allclose(part["explained"], values[-k] / np.trace(covariance), rtol=1e-9)


def test_counts_as_weights(spark):
    rows = [(k, [float(k % 3), float(k % 2), float(k % 5 == 0)]) for k in range(40)]
    got, model, error = whitening.whiten(vectors(spark, rows), by_count=True)
    x = np.floor(64 * np.array([v for _, v in rows])) + 1_000_000
    np.testing.assert_allclose(model.eigenvalues, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], rtol=1e-9)
    assert model.n == 40 and got.count() == 40 and error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_gives_no_components(spark, tmp_path, rows):
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op12_whitening(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_constant_columns_are_no_components(spark, tmp_path):
    vectors(spark, [(k, [float(k), 3.0, float(k * k % 7)]) for k in range(9)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r[0] for r in whitening.op12_whitening(spark, str(tmp_path)).select("component").distinct().orderBy("component").collect()] == [1, 2]


def test_huge_entries_have_a_defined_result(spark):
    rows = [(1, [3e38, 0.5]), (2, [-3e38, 0.25]), (3, [1.0, 2.0]), (4, [2.0, 1.0])]
    got, model, error = whitening.whiten(vectors(spark, rows))
    assert got.where("deviation IS NULL").count() == 2 and model.n == 4  # the two huge ones
    assert got.where(F.size("z") < 1).count() == 0
