"""A few registered queries against their SQL on the smallest tables; tools/check_oracles.py runs all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no benchmark tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["event_features_30_90", "cross_system_travel", "attack_chains_72h", "baseline_profiles", "risk_scores", "remediation_plan", "blast_radius"])
def test_query_equals_sql(spark, con, name):
    assert compare(spark, name, SMALL, con).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
