from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from riskweave.models import extra_trees
from riskweave.models.extra_trees import ExtraTrees

NAMES = [f"f{k}" for k in range(6)]


def two_classes(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).round(3)
    x[:, 4] = 1.0  # constant: never cut
    label = ((x[:, 0] + x[:, 1] ** 2 - 0.5 * x[:, 2] + 0.3 * rng.normal(size=n)) > 1.2).astype(int)
    pdf = pd.DataFrame(x, columns=NAMES).assign(user_id=[f"u{k}" for k in range(n)], label=label)
    return spark.createDataFrame(pdf), x, label


def auc(scores, label):
    order = pd.Series(scores).rank().to_numpy()
    p = label.sum()
    return (order[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_trees_are_pure_random_and_rank_new_rows(spark, tmp_path):
    train, x, label = two_classes(spark, 600)
    model = ExtraTrees.fit(train.repartition(3).cache(), NAMES, trees=30)
    forest = model.forest
    for tree in range(30):
        leaves = forest.leaf_of(x, tree)
        assert set(forest.chance[leaves]) <= {0.0, 1.0}  # grown until every leaf is pure
        assert (forest.chance[leaves] == label).all()
    inner = forest.feature >= 0
    assert 4 not in set(forest.feature[inner])
    # one random cut for each drawn feature: no two trees cut a root alike, and none at the middle of two values, as a search would
    assert len(set(zip(forest.feature[:30], forest.cut[:30]))) == 30
    values = np.sort(np.unique(x[:, 0]))
    roots = forest.cut[:30][forest.feature[:30] == 0]
    assert not np.isin(roots, (values[1:] + values[:-1]) / 2).any()
    new, _, truth = two_classes(spark, 500, seed=4)
    got = model.predict(new).toPandas()
    assert auc(got["extra_probability"], got["label"].to_numpy()) > 0.93
    model.save(spark, str(tmp_path))
    again = ExtraTrees.load(spark, str(tmp_path)).predict(new).toPandas()
    pd.testing.assert_frame_equal(got, again)


def test_the_forest_does_not_depend_on_partitions_and_keeps_its_bounds(spark):
    train, x, _ = two_classes(spark, 300)
    one = ExtraTrees.fit(train.coalesce(1), NAMES, trees=8, max_leaves=12)
    many = ExtraTrees.fit(train.repartition(5), NAMES, trees=8, max_leaves=12)
    for name in ("feature", "cut", "left", "right", "chance"):
        np.testing.assert_array_equal(getattr(one.forest, name), getattr(many.forest, name))
    for tree in range(8):
        assert len(np.unique(one.forest.leaf_of(x, tree))) == 12


def test_a_small_table_takes_one_pass_a_level_and_gives_the_same_forest(spark, monkeypatch):
    train, _, _ = two_classes(spark, 400)
    passes = {}
    for name in ("_level_whole", "_ranges", "_counts"):
        real = getattr(extra_trees, name)
        monkeypatch.setattr(extra_trees, name, lambda *a, name=name, real=real: (passes.update({name: passes.get(name, 0) + 1}), real(*a))[1])
    one = ExtraTrees.fit(train.repartition(3), NAMES, trees=5, max_leaves=20)
    assert set(passes) == {"_level_whole"}
    monkeypatch.setattr(extra_trees, "WHOLE", 400 * 6 - 1)  # too many values for a task
    many = ExtraTrees.fit(train.repartition(3), NAMES, trees=5, max_leaves=20)
    assert passes["_ranges"] == passes["_counts"] == passes["_level_whole"]
    for name in extra_trees.COLUMNS:
        np.testing.assert_array_equal(getattr(one.forest, name), getattr(many.forest, name))


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1]])
def test_one_class_or_no_rows(spark, labels):
    rows = [(f"u{k}", *([float(k)] * 6), v) for k, v in enumerate(labels)]
    train = spark.createDataFrame(rows, "user_id string, " + ", ".join(f"{n} double" for n in NAMES) + ", label int")
    got = ExtraTrees.fit(train, NAMES, trees=3).predict(train).toPandas()
    assert got["extra_probability"].tolist() == [float(v) for v in labels]


def test_copies_with_both_labels_share_a_leaf(spark):
    rows = [(f"u{k}", *([1.0] * 6), k % 2) for k in range(4)] + [(f"v{k}", *([2.0] * 6), 1) for k in range(4)]
    train = spark.createDataFrame(rows, "user_id string, " + ", ".join(f"{n} double" for n in NAMES) + ", label int")
    got = ExtraTrees.fit(train, NAMES, trees=3).predict(train).toPandas()
    assert set(got["extra_probability"].round(6)) == {1.0, 0.25}  # two rows each, weighing 2 and 2/3
