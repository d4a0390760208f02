"""Counts of the oracle on the adapted sf0.01 data (FIXTURES.md section B)."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import abuse, rfm, sessions
from cohortlens.sources import testdata

SF = "/root/testdata/sf0.01"
P = testdata.TEST_PARAMS


@pytest.fixture(scope="module")
def t(spark):
    return testdata.tables(spark, SF)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_adapter_keeps_every_event(spark, sf):
    path = f"/root/testdata/{sf}"
    assert testdata.events(spark, path).count() == spark.read.parquet(f"{path}/events.parquet").count()


def test_event_and_session_counts(t):
    assert t.events.count() == 10_000
    assert t.events.filter(F.col("user_id").isNull()).count() == 104
    assert sessions.sessions(t.events, P).count() == 8489


def test_rfm_rows_and_recency_split(t):
    scores = rfm.rfm_scores(rfm.rfm_base(sessions.sessions(t.events, P), t.user_info, P), P)
    got = {r.R: r["count"] for r in scores.groupBy("R").count().collect()}
    assert got == {1: 1001, 4: 337}


def test_abuse_groups_and_risk_classes(t):
    assert abuse.serious_cheaters(t.user_info, t.geography, P).count() == 56
    levels = {r.fraud_risk_level: r["count"]
              for r in abuse.account_anomalies(t.user_info, P).groupBy("fraud_risk_level").count().collect()}
    assert levels["Extreme Risk"] == 609 and levels["High Risk"] == 778
    assert levels.get("Medium Risk", 0) + levels["Low Risk"] == 120 + 39
