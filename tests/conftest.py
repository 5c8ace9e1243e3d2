from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fixed_now import NOW  # noqa: E402

IDENTITY_SCHEMA = """user_id string, username string, email string, department string, employment_status string,
account_type string, owner_id string, source_system string, job_title string, last_login timestamp, created_at timestamp,
roles array<string>, permissions array<string>, mfa_enabled boolean, sso_linked boolean, systems_count int,
role_changes_90d int, is_privileged boolean, resource_sensitivity string, off_hours_access_pct double, geo_anomaly boolean,
interactive_login boolean, event_count_30d bigint, event_count_90d bigint, unique_resources_accessed bigint,
anomaly_event_count bigint, failed_attempt_count bigint, off_hours_event_pct double, impossible_travel_detected boolean,
cross_system_impossible_travel boolean, bulk_download_detected boolean, max_resources_in_single_session bigint,
max_resources_in_single_day bigint, avg_time_between_events_hours double, has_baseline boolean,
baseline_avg_events_30d double, baseline_std_events_30d double, baseline_avg_unique_resources_30d double,
baseline_p95_events_single_session double, baseline_month_end_multiplier double, baseline_avg_daily_unique_resources double,
peer_deviation_score double, behavior_zscore double, peer_mean double, peer_std double"""

CLEAN = dict(
    username="jo", email="jo@company.com", department="IT", employment_status="active", account_type="human",
    owner_id="m1", source_system="AD", job_title="Engineer", last_login=NOW, created_at=datetime(2020, 1, 1),
    roles=["viewer"], permissions=["read:all"], mfa_enabled=True, sso_linked=True, systems_count=1, role_changes_90d=0,
    is_privileged=False, resource_sensitivity="low", off_hours_access_pct=0.0, geo_anomaly=False, interactive_login=False,
    event_count_30d=10, event_count_90d=20, unique_resources_accessed=1, anomaly_event_count=0, failed_attempt_count=0,
    off_hours_event_pct=0.0, impossible_travel_detected=False, cross_system_impossible_travel=False,
    bulk_download_detected=False, max_resources_in_single_session=1, max_resources_in_single_day=1,
    avg_time_between_events_hours=1.0, has_baseline=True, baseline_avg_events_30d=10.0, baseline_std_events_30d=2.0,
    baseline_avg_unique_resources_30d=3.0, baseline_p95_events_single_session=5.0, baseline_month_end_multiplier=2.0,
    baseline_avg_daily_unique_resources=2.0, peer_deviation_score=0.0, behavior_zscore=0.0, peer_mean=10.0, peer_std=2.0,
)


@pytest.fixture(scope="session")
def spark():
    from tools.session import local_session

    os.environ.setdefault("BENCH_MEMORY", "4g")
    return local_session(cores=4, app="tests")


@pytest.fixture
def identities(spark):
    """Builds an identity table from changes to a clean identity, named by user id."""
    def build(**cases):
        names = [f.split()[0] for f in " ".join(IDENTITY_SCHEMA.split()).split(", ")]
        rows = [[{**CLEAN, **changes, "user_id": uid}[n] for n in names] for uid, changes in cases.items()]
        return spark.createDataFrame(rows, IDENTITY_SCHEMA)

    return build


@pytest.fixture(autouse=True)
def _drop_shared():
    yield
    from riskweave.session import release_shared

    release_shared()
