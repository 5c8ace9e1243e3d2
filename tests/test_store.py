from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.models import roles, supervised
from riskweave.models.ensemble import AnomalyEnsemble
from riskweave.models.extra_trees import ExtraTrees
from riskweave.models.supervised import RiskClassifier
from riskweave.sources.store import Store, StoreError

NAMES = ["f0", "f1", "f2"]


def cloud(spark, n=90):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=NAMES).assign(user_id=[f"u{k:03d}" for k in range(n)])
    pdf["label"] = (pdf["f0"] > 0.1).astype(int)
    return spark.createDataFrame(pdf).cache()


def test_runs_are_numbered_and_the_newest_is_read(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.runs().count() == 0
    with pytest.raises(StoreError):
        store.folder("profiles")
    first, second = (spark.createDataFrame([(k, "IT", x)], "id long, department string, x double") for k, x in ((1, 0.5), (2, None)))
    assert [store.save_table("profiles", t, ("department",)) for t in (first, second)] == [1, 2]
    assert store.table("profiles").first()["id"] == 2 and store.table("profiles", 1).first()["x"] == 0.5
    assert store.save_table("others", first.where("false")) == 1 and store.table("others").count() == 0


def test_broken_and_changed_runs_are_never_read(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    good = spark.range(5).toDF("id")
    store.save_table("t", good)

    def breaks_off(folder):
        spark.range(3).toDF("id").write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.save("t", breaks_off, [""])
    assert store.table("t").count() == 5 and store.runs("t").count() == 1
    spark.range(1).toDF("id").write.mode("append").parquet(store.folder("t"))
    with pytest.raises(StoreError):
        store.table("t")
    assert store.save_table("t", good) == 2 and store.table("t").count() == 5


def test_models_come_back_from_their_runs(spark, tmp_path):
    store, df = Store(spark, f"{tmp_path}/s"), cloud(spark)
    trees = ExtraTrees.fit(df, NAMES, trees=3)
    store.save("trees", lambda f: trees.save(spark, f), ["nodes", "meta"])
    again = ExtraTrees.load(spark, store.folder("trees"))
    assert trees.predict(df).exceptAll(again.predict(df)).isEmpty()

    ensemble = AnomalyEnsemble.fit(df, NAMES, contamination=0.1)
    store.save("ensemble", lambda f: ensemble.save(spark, f), ["scaler", "isolation/nodes", "isolation/meta", "boundary", "density/points", "density/fitted", "density/meta"])
    scores = lambda m: {r.user_id: r.anomaly_score for r in m.predict(df).collect()}
    assert scores(AnomalyEnsemble.load(spark, store.folder("ensemble"))) == {u: pytest.approx(s) for u, s in scores(ensemble).items()}

    forest = RiskClassifier.fit(df, NAMES)
    store.save("risk", lambda f: forest.save(f"{f}/model"), [])
    back = RiskClassifier.load(f"{store.folder('risk')}/model", NAMES)
    assert forest.predict(df).select("user_id", "risk_probability").exceptAll(back.predict(df).select("user_id", "risk_probability")).isEmpty()
    assert len(back.top_features()) == 3 and back.top_features()[0][0] == "f0"


def test_access_predictor_and_roles_come_back(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    train = spark.createDataFrame([("IT", "Eng", f"r{i % 5}", "read", i / 60, "APPROVE" if i > 40 else "DENY") for i in range(60)],
                                  "department string, job_title string, resource string, action string, peer_access_rate double, decision string")
    model = supervised.fit_access_predictor(train)
    store.save("access", lambda f: supervised.save_access_predictor(model, f"{f}/model"), [])
    back = supervised.load_access_predictor(f"{store.folder('access')}/model")
    key = ["resource", "peer_access_rate", "predicted_decision", "predicted_confidence"]
    assert supervised.predict_access(model, train).select(key).exceptAll(supervised.predict_access(back, train).select(key)).isEmpty()

    events = spark.createDataFrame([(f"{g}{i}", r, "read") for g, rs in (("a", "xy"), ("b", "zw")) for i in range(4) for r in rs], "user_id string, resource string, action string")
    mined, scaled = roles.fit_roles(roles.access_matrix(events), max_clusters=3, starts=2)
    store.save("roles", mined.save, ["places", "centres", "deviations"])
    again = roles.RoleModel.load(spark, store.folder("roles"))
    assert roles.assign_roles(mined, scaled).exceptAll(roles.assign_roles(again, scaled)).isEmpty()
    assert again.places.where(F.col("feature") == "x").count() == 1
