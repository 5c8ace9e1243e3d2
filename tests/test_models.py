from __future__ import annotations

import threading
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.models import neighbours, roles, supervised
from riskweave.models.ensemble import AnomalyEnsemble
from riskweave.models.lof import LocalOutlierFactor, nearest, weighted_quantile
from riskweave.models.neighbours import PointIndex, _meet, distances, distinct_points, neighbours_among
from riskweave.models.vectors import Scaler, points

NAMES = ["f0", "f1", "f2"]


def cloud(spark, n=200, outliers=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:outliers] += 9.0 * np.sign(rng.normal(size=(outliers, 3)))
    rows = [(f"u{i:03d}", *map(float, r), int(i < 30)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "user_id string, f0 double, f1 double, f2 double, label int"), x


def test_scaler_uses_population_deviation(spark):
    df, x = cloud(spark)
    s = Scaler.fit(df.withColumn("f2", F.lit(3.0)), NAMES)
    assert s.means[0] == pytest.approx(x[:, 0].mean()) and s.deviations[1] == pytest.approx(x[:, 1].std()) and s.deviations[2] == 1.0


def test_lof_against_plain_numpy_with_copies(spark):
    df, x = cloud(spark, 80, 2)
    df = df.unionByName(df.where("user_id = 'u050'").withColumn("user_id", F.concat("user_id", F.lit("copy"))))
    model = LocalOutlierFactor.fit(points(df, NAMES), 81, 0.1, k=5)
    rows = model.index.points.join(model.fitted, F.col("pid") == F.col("p")).withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).toPandas()
    fit, k_distance, density = np.stack(rows["x"]), rows["k_distance"].to_numpy(), rows["density"].to_numpy()
    assert len(fit) == 81
    d = np.sqrt(((fit[:, None] - fit[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    near = np.take_along_axis(d, order, 1)
    lrd = 1 / (np.maximum(near, near[:, -1][order]).mean(1) + 1e-10)
    assert np.allclose(k_distance, near[:, -1], atol=1e-6) and np.allclose(density, lrd, rtol=1e-4)
    factor = (lrd[order] / lrd[:, None]).mean(1)
    assert model.offset == pytest.approx(np.quantile(-factor, 0.1), rel=1e-6)
    assert np.allclose(nearest(fit[:3], fit, 1)[0], 0.0)


def vectors_of(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "x": x.tolist()}), "id bigint, x array<double>").repartition(4)


def _visited(spark, n, leaf_points):
    """k-distances held against brute force on a part, and how many points each query meets."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)) + rng.integers(0, 3, size=(n, 1)) * 4.0
    found = distinct_points(vectors_of(spark, x))
    index = PointIndex.build(found, leaf_points)
    sizes = index.points.groupBy("cell").count()
    assert sizes.agg(F.max("count")).first()[0] <= leaf_points and len(index.levels) >= 2
    near = index.nearest(found.select(F.col("pid").alias("q"), "x"), 11)
    far = near.groupBy("q").agg(F.max("d").alias("within"), F.sum("taken").alias("taken")).join(found, F.col("q") == F.col("pid"))
    got = far.toPandas()
    assert len(got) == n and (got["taken"] == 11).all()
    probe = got.iloc[:: n // 300]
    want = np.sort(distances(np.stack(probe["x"]), x), axis=1)[:, 10]
    assert np.allclose(probe["within"], want, atol=1e-12)
    met = index.visits(far.select("q", "x", "within", F.lit(-1).cast("bigint").alias("home")), 11, home=False)
    return met.join(sizes, "cell").agg(F.sum("count")).first()[0] / n


def test_neighbours_are_exact_and_work_grows_with_the_points(spark):
    """Four times the points: each query meets about as many, not four times as many."""
    small, large = _visited(spark, 5_000, 128), _visited(spark, 20_000, 128)
    assert large < 1.6 * small and large < 20_000 / 8


def test_nodes_may_be_joined_instead_of_shared(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(3_000, 3))
    found = distinct_points(vectors_of(spark, x))
    shared = {r.q: r.d for r in neighbours_among(found, PointIndex.build(found, 64), 7).groupBy("q").agg(F.max("d").alias("d")).collect()}
    monkeypatch.setattr("riskweave.models.neighbours.SHARED", 0)
    joined = {r.q: r.d for r in neighbours_among(found, PointIndex.build(found, 64), 7).groupBy("q").agg(F.max("d").alias("d")).collect()}
    assert joined == shared and len(joined) == 3_000


def test_rows_of_many_cells_are_looked_at_together(spark):
    """2,000 rows of 500 cells, 200 of them inner: a step a block, not a step a cell; each row meets its own node."""
    rows = spark.range(2_000).select("id", (F.col("id") % 500).alias("cell"), F.array((F.col("id") % 7).cast("double")).alias("x")).coalesce(1)
    one = lambda *v: F.array(*[F.array(F.lit(float(x))) for x in v])
    nodes = spark.range(0, 400, 2).select(
        F.col("id").alias("cell"), F.array(F.array(F.col("id").cast("double")), F.array(F.lit(1000.0))).alias("pivots"),
        one(0, 0).alias("low"), one(9, 9).alias("high"), F.array(F.lit(1), F.lit(1)).alias("n"))

    def run(part, held):
        here, place = held.at(part["cell"].to_numpy())
        d = held.distances(np.stack(part["x"]), place)
        return pd.DataFrame({"id": part["id"], "rows": len(part), "inner": here, "d": d[:, 0], "pivots": np.isfinite(d).sum(axis=1)})

    got = _meet(rows, nodes, run, "id bigint, rows bigint, inner boolean, d double, pivots bigint").toPandas()
    cell = got["id"] % 500
    assert len(got) == 2_000 and (1 / got["rows"]).sum() < 20
    assert (got["inner"] == ((cell % 2 == 0) & (cell < 400))).all() and (got["pivots"] == 2).all()
    inner = got[got["inner"]]
    assert np.allclose(inner["d"], ((inner["id"] % 7) - cell[got["inner"]]).abs())


def test_the_nearest_within_reach_are_exact_and_ties_stay():
    from riskweave.models.neighbours import reached

    rng = np.random.default_rng(6)
    fit, x = rng.integers(0, 4, size=(500, 3)).astype(float) + 1e6, rng.integers(0, 4, size=(300, 3)).astype(float) + 1e6
    fit[7], x[5] = np.nan, np.nan
    within = np.where(np.arange(300) % 2, 1.5, np.inf)
    x[10:20] += rng.normal(size=(10, 3))  # no two equally far
    row, place, d = reached(x, fit, within, 9)
    far, near = nearest(x, fit, 9)
    for q in range(300):
        there = far[q] <= within[q]
        assert set(place[row == q]) == set(near[q][there]) and sorted(d[row == q]) == far[q][there].tolist()
    assert (row == 0).sum() == 9 and not (row == 5).any()


def test_boxes_rule_out_cells_that_ranges_do_not(spark, monkeypatch):
    """Twelve features of few values each: the distances to pivots are much alike, the sides of the boxes are not."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 2, size=(6_000, 10)) * 3.0, rng.normal(size=(6_000, 2))], axis=1)
    found = distinct_points(vectors_of(spark, x))
    index = PointIndex.build(found, 128)
    passes = []
    monkeypatch.setattr("riskweave.models.neighbours._meet_shared", lambda *a, real=neighbours._meet_shared: (passes.append(1), real(*a))[1])
    far = index.nearest(found.select(F.col("pid").alias("q"), "x"), 3).groupBy("q").agg(F.max("d").alias("within"))
    assert len(index.levels) > 1 and len(passes) == 2  # one way down for all levels, there and again
    asked = found.join(far, F.col("pid") == F.col("q")).select("q", "x", "within", F.lit(-1).cast("bigint").alias("home"))
    met = index.visits(asked, 3, home=False).count()
    ranged = PointIndex(index.points, tuple(level.drop("floor", "ceiling") for level in index.levels))
    assert met < ranged.visits(asked, 3, home=False).count() / 2
    probe = far.join(found, F.col("pid") == F.col("q")).limit(200).toPandas()
    assert np.allclose(probe["within"], np.sort(distances(np.stack(probe["x"]), x), axis=1)[:, 2], atol=1e-12)


def test_fitted_points_are_not_searched_again(spark, monkeypatch):
    df, x = cloud(spark, 120, 4)
    df = df.unionByName(df.where("user_id < 'u030'").withColumn("user_id", F.concat("user_id", F.lit("copy"))))
    model = LocalOutlierFactor.fit(points(df, NAMES), 150, 0.1, k=6)
    searched = {r.id: r.decision for r in replace(model, near=None).score(points(df, NAMES)).collect()}
    new = spark.createDataFrame([("new", 0.3, 0.1, 9.0)], "user_id string, f0 double, f1 double, f2 double")
    want = replace(model, near=None).score(points(new, NAMES)).first().decision
    both = points(df.select("user_id", *NAMES).unionByName(new), NAMES)
    assert {r.id: r.decision for r in model.score(both).collect()} == pytest.approx(searched | {"new": want})

    def none(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(PointIndex, "nearest", none)
    assert {r.id: r.decision for r in model.score(points(df, NAMES)).collect()} == pytest.approx(searched)


def test_neighbours_when_few_points_or_small_leaves(spark):
    x = np.random.default_rng(9).normal(size=(60, 2)).round(1)
    pts = distinct_points(vectors_of(spark, x))
    for k, leaf in ((7, 5), (59, 8), (1, 60)):
        near = neighbours_among(pts, PointIndex.build(pts, leaf), k).groupBy("q").agg(F.max("d").alias("d"), F.sum("taken").alias("n"))
        got = near.join(pts.select("pid", "x"), F.col("q") == F.col("pid")).toPandas()
        assert np.allclose(got["d"], np.sort(distances(np.stack(got["x"]), x), axis=1)[:, k]) and (got["n"] == k).all()


def test_quantile_equals_numpy(spark):
    v = np.round(np.random.default_rng(3).lognormal(size=3000, sigma=3), 2)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "n": 1})).groupBy("v").agg(F.sum("n").alias("n"))
    for share in (0.0, 0.15, 0.5, 1.0):
        assert weighted_quantile(df, share) == pytest.approx(np.quantile(v, share))


def test_ensemble_finds_outliers_is_stable_and_reloads(spark, tmp_path):
    df, _ = cloud(spark)
    model = AnomalyEnsemble.fit(df.repartition(4), NAMES, contamination=0.05)
    out = {r.user_id: r for r in model.predict(df).collect()}
    flagged = {u for u, r in out.items() if r.is_anomaly}
    assert {f"u{i:03d}" for i in range(6)} <= flagged and len(flagged) <= 14
    assert all(0.0 <= r.anomaly_score <= 1.0 for r in out.values())
    again = AnomalyEnsemble.fit(df.coalesce(1), NAMES, contamination=0.05)
    # the scaler's sums may differ in the last digit, the trees' shape and samples may not
    assert np.allclose(again.isolation.nodes.to_numpy(float), model.isolation.nodes.to_numpy(float))
    model.save(spark, str(tmp_path / "m"))
    back = {r.user_id: r.anomaly_score for r in AnomalyEnsemble.load(spark, str(tmp_path / "m")).predict(df).collect()}
    assert back == {u: pytest.approx(r.anomaly_score) for u, r in out.items()}


def test_smote_balances_exactly_between_neighbours(spark):
    df, x = cloud(spark, 100, 0)
    out = supervised.smote(df, NAMES)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 70, 1: 70}
    made = np.array([[r.f0, r.f1, r.f2] for r in out.where("user_id like 'synthetic%'").collect()])
    low, high = x[:30].min(0) - 1e-9, x[:30].max(0) + 1e-9
    assert len(made) == 40 and (made >= low).all() and (made <= high).all()


def test_stratified_holdout_is_exact_and_partition_free(spark):
    df, _ = cloud(spark, 103, 0)
    split = supervised.stratified_holdout(df.repartition(6))
    sizes = {r.label: r["count"] for r in split.where("is_test").groupBy("label").count().collect()}
    assert sizes == {0: 14, 1: 6}
    other = supervised.stratified_holdout(df.coalesce(1)).where("is_test").select("user_id")
    assert split.where("is_test").select("user_id").exceptAll(other).isEmpty()


def test_access_predictor_defaults_to_review_and_accepts_unseen(spark):
    requests = spark.createDataFrame([("Mars", "Pilot", "x", "fly", 0.9)], "department string, job_title string, resource string, action string, peer_access_rate double")
    row = supervised.predict_access(None, requests).first()
    assert (row.predicted_decision, row.predicted_confidence) == ("REVIEW", 0.5)
    train = spark.createDataFrame([("IT", "Eng", f"r{i % 5}", "read", i / 60, "APPROVE" if i > 48 else "REVIEW" if i > 24 else "DENY") for i in range(60)],
                                  "department string, job_title string, resource string, action string, peer_access_rate double, decision string")
    model = supervised.fit_access_predictor(train)
    assert supervised.predict_access(model, requests).first().predicted_decision == "APPROVE"


def test_roles_split_two_groups_and_reload(spark, tmp_path):
    rows = [(f"a{i}", r, "read") for i in range(8) for r in ("db", "wiki")] + [(f"b{i}", r, "write") for i in range(8) for r in ("repo", "ci", "repo")]
    events = spark.createDataFrame(rows, "user_id string, resource string, action string")
    matrix = roles.access_matrix(events)
    shares = {(r.user_id, r.feature): r.share for r in matrix.collect()}
    assert shares["b0", "repo"] == pytest.approx(2 / 3) and shares["a0", "action_diversity"] == 0.5
    assert [(r.feature, r.i) for r in roles.vocabulary(matrix).orderBy("i").collect()] == [(f, k) for k, f in enumerate(sorted({f for _, f in shares}))]
    model, scaled = roles.fit_roles(matrix, max_clusters=4, starts=3)
    assigned = roles.assign_roles(model, scaled)
    got = {r.user_id: r.cluster_id for r in assigned.collect()}
    assert len({got[f"a{i}"] for i in range(8)}) == 1 and got["a0"] != got["b0"]
    labels = {r.label for r in roles.profile_roles(assigned, matrix, roles.grant_counts(events)).collect()}
    assert labels == {"db_read", "repo_write"}
    assert max(r.distance for r in assigned.collect()) < 1e-6
    model.save(str(tmp_path / "roles"))
    back = roles.RoleModel.load(spark, str(tmp_path / "roles"))
    # new users in the places of the fitted vocabulary; a feature that it lacks is left out
    new = spark.createDataFrame([("n", "db", "read"), ("n", "wiki", "read"), ("n", "unseen", "read")], "user_id string, resource string, action string")
    again = back.scaled(roles.access_vectors(roles.access_matrix(new), back.places))
    assert [r.cluster_id for r in roles.assign_roles(back, again).collect()] == [got["a0"]]



def test_the_quality_gate_lets_good_models_pass_and_stops_bad_ones(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=NAMES).assign(user_id=[f"u{k}" for k in range(300)])
    good = spark.createDataFrame(pdf.assign(label=(pdf["f0"] + 0.2 * rng.normal(size=300) > 1.0).astype(int)))
    assert supervised.RiskClassifier.fit(good, NAMES).auc > supervised.MIN_AUC
    with pytest.raises(supervised.ModelQualityError) as stopped:
        supervised.RiskClassifier.fit(spark.createDataFrame(pdf.assign(label=rng.integers(0, 2, 300))), NAMES)
    assert stopped.value.auc < supervised.MIN_AUC


def test_independent_steps_run_side_by_side(spark):
    """Each waits for the other to begin; one after the other they would not end."""
    from riskweave.session import at_once

    met = threading.Barrier(2, timeout=60)

    def step(n):
        met.wait()
        return spark.range(n).count()

    assert at_once(spark, lambda: step(3), lambda: step(5)) == [3, 5]
    with pytest.raises(supervised.ModelQualityError):
        at_once(spark, lambda: 1, lambda: (_ for _ in ()).throw(supervised.ModelQualityError(0.5)))


def test_deep_forest_keeps_the_nodes_of_rows_and_its_predictions(spark):
    from riskweave.models.supervised import base_forests

    rows = [(f"u{k}", float(k % 7), float(k * 37 % 11), int(k % 5 == 0 or k * 37 % 11 > 8)) for k in range(80)]
    train = spark.createDataFrame(rows, "user_id string, a double, b double, label int").coalesce(2).cache()
    bagged, _ = base_forests(train, ["a", "b"])
    forest = bagged.stages[-1]
    assert forest.getCacheNodeIds()
    estimator = forest._java_obj.parent().copy(forest._java_obj.parent().extractParamMap())
    estimator.setCacheNodeIds(False)
    assert len(forest.trees) == 100
    plain = estimator.fit(bagged.stages[0].transform(train).withColumn("w", weight_of(train))._jdf)
    assert plain.toDebugString() == forest.toDebugString


def weight_of(train):
    from riskweave.models.supervised import class_weight

    return class_weight("label", train)
