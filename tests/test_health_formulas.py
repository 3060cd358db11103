"""Sync health, duplicates of new events, resolutions and anomalies on rows worked out by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calltide.operators import entity_resolution as R
from calltide.operators import health as H
from calltide.operators import policies as P

NOW = datetime(2024, 1, 31)
SYNC = "id long, ts timestamp_ntz, network_type string, duration_ms long, processed_items long, failed_items long, queue_after long, success boolean"


def sync(i, hours_ago, network="wifi", ms=1000, items=9, failed=1, queue=5, ok=True):
    return (i, NOW - timedelta(hours=hours_ago), network, ms, items, failed, queue, ok)


def test_drift_of_intervals_items_and_success(spark):
    before = [sync(i, 24 * 13 - 10 * i, items=9, failed=1, ok=i != 0) for i in range(4)]  # every 10 hours, 10 items, 3 of 4
    recent = [sync(10 + i, 24 * 6 - 15 * i, items=10, failed=5, ok=i > 1) for i in range(4)]  # every 15 hours, 15 items, 2 of 4
    alone = [sync(20, 5, "cellular"), sync(21, 24 * 30, "none"), sync(22, 24 * 10, "lone"), sync(23, 24, "lone")]
    df = spark.createDataFrame(before + recent + alone, SYNC).repartition(3)
    got = {r["network_type"]: tuple(r)[1:] for r in H.data_drift(df, "2024-01-31 00:00:00").collect()}
    assert got["wifi"] == (36_000_000.0, 54_000_000.0, 0.5, 10.0, 15.0, 0.5, 75.0, 50.0, 25.0)
    assert got["cellular"] == (0.0,) * 9 and "none" not in got
    assert got["lone"] == (0.0, 0.0, None, 10.0, 10.0, 0.0, 100.0, 100.0, 0.0)
    assert H.data_drift(df.limit(0), "2024-01-31 00:00:00").count() == 0


def test_trends_of_latency_throughput_and_success(spark):
    early, late = 24 * 20, 24 * 5
    rows = [sync(1, early, "a", 1000, 10, 0), sync(2, late, "a", 1201, 10, 0), sync(3, early, "b", 1000, 10, 0), sync(4, late, "b", 790, 10, 0), sync(5, early, "c", 1000, 100, 0), sync(6, late, "c", 1000, 79, 0), sync(7, early, "d", 0, 5, 0), sync(8, late, "d", 1000, 5, 0, ok=False), sync(9, early, "e", 1000), sync(10, late, "e", 1200)]
    got = {r["network_type"]: (r["latency_trend"], r["throughput_trend"], r["success_trend"]) for r in H.performance_trend(spark.createDataFrame(rows, SYNC), "2024-01-31 00:00:00").collect()}
    assert got == {"a": ("degrading", "stable", "stable"), "b": ("improving", "improving", "stable"), "c": ("stable", "degrading", "stable"), "d": ("stable", "stable", "degrading"), "e": ("stable", "stable", "stable")}


def test_an_issue_of_success_begins_under_80(spark):
    rows = [(0.0, 0.0, 0.0, s, "connected", 100.0) for s in (79.9, 80.0, 94.0)]
    df = spark.createDataFrame(rows, "queue_depth double, drift_percentage double, sync_latency double, success_rate double, network_status string, data_quality double")
    got = {r["success_rate"]: ([i["kind"] for i in r["issues"]], r["score"]) for r in H.health_score(H.sync_issues(df)).collect()}
    assert got == {79.9: (["performance_degradation"], 84), 80.0: ([], 94), 94.0: ([], 98)}


CONTEXT = "network_type string, latency_ms double, success_rate double, queue_depth double, drift double, poor_network double, battery double"


def test_health_rules_weigh_by_severity(spark):
    rows = [("good", 30_000.0, 90.0, 1000.0, 15.0, 0.0, 5.0), ("slow", 30_001.0, 90.0, 1001.0, 0.0, 0.0, 0.0), ("bad", 1.0, 89.9, 1.0, 15.1, 100.0, 5.1), ("worst", 1e9, 0.0, 1e9, 99.0, 100.0, 99.0)]
    rules = H.health_rules(spark.createDataFrame(rows, CONTEXT))
    assert {tuple(r) for r in rules.where("network_type = 'bad' AND NOT holds").select("rule", "category", "severity").collect()} == {("sync_success_rate_low", "sync_performance", "high"), ("data_drift_high", "data_quality", "medium"), ("network_connectivity_poor", "network_health", "low"), ("battery_usage_high", "resource_usage", "low")}
    got = {r["network_type"]: tuple(r)[1:] for r in H.weighted_health(rules).collect()}
    # weights: latency 2, success 4, queue 2, drift 2, network 1, battery 1; 12 in all
    assert got == {"good": (100, 0, 100.0, 100.0, 100.0, 100.0), "slow": (67, 2, 33.3333, 100.0, 100.0, 100.0), "bad": (33, 4, 66.6667, 0.0, 0.0, 0.0), "worst": (0, 6, 0.0, 0.0, 0.0, 0.0)}


def test_context_of_health_rules(spark):
    df = spark.createDataFrame([sync(1, 3, "cellular", 1000, 0, 0, 7), sync(2, 2, "cellular", 3000, 0, 0, 8, False), sync(3, 1, "none")], SYNC).withColumn("network_strength", F.when(F.col("id") == 2, 2))
    got = {r["network_type"]: tuple(r)[1:] for r in H.health_context(df, "2024-01-31 00:00:00").collect()}
    assert got["cellular"] == (2000.0, 50.0, 8.0, 0.0, 100.0, 0.004) and got["none"][4] == 100.0
    assert {r["network_type"]: r["poor_network"] for r in H.health_context(df.drop("network_strength"), "2024-01-31 00:00:00").collect()} == {"cellular": 0.0, "none": 100.0}


EVENT = "id long, line_id string, number string, ts timestamp_ntz, direction string, type string, duration int, content string, contact_id string"
BASE = (1, "line-1", "+1234567890", datetime(2023, 1, 1, 10), "inbound", "call", 120, None, None)
SMS = (1, "line-1", "+1234567890", datetime(2023, 1, 1, 10), "inbound", "sms", None, "see you at the station", "c")


@pytest.mark.parametrize(
    ("base", "change", "want"),
    [
        (BASE, {}, (1.0, "exact", True)), (BASE, {"ts": datetime(2023, 1, 1, 10, 0, 1)}, (1.0, "time_variance", True)), (BASE, {"ts": datetime(2023, 1, 1, 10, 0, 1, 1)}, None), (BASE, {"number": "+9876543210"}, None), (BASE, {"line_id": "line-2"}, None),
        (BASE, {"direction": "outbound"}, None), (BASE, {"type": "sms"}, None), (BASE, {"duration": 121}, (1.0, "time_variance", True)), (BASE, {"duration": 122}, (0.9, "time_variance", True)), (BASE, {"duration": None}, (0.9, "time_variance", True)),
        (SMS, {"content": "see you at the stationn", "contact_id": None}, (1.0, "time_variance", True)), (SMS, {"content": "something else"}, (1.0, "time_variance", True)), (SMS, {"content": "something else", "contact_id": None}, (0.9, "time_variance", True)), (SMS, {"content": None, "contact_id": "d"}, (0.9, "time_variance", True)),
    ],
)
def test_new_events_against_existing_ones(spark, base, change, want):
    names = [c.split()[0] for c in EVENT.split(", ")]
    new = dict(zip(names, base, strict=True)) | {"id": 2} | change
    got = P.new_against_existing(spark.createDataFrame([tuple(new[n] for n in names)], EVENT), spark.createDataFrame([base], EVENT)).collect()
    assert [tuple(r) for r in got] == ([] if want is None else [(2, 1, *want)])


def test_the_best_of_several_is_taken(spark):
    other = [(7, *BASE[1:]), (5, *BASE[1:]), (3, *BASE[1:3], datetime(2023, 1, 1, 9, 59, 59), *BASE[4:])]
    got = P.new_against_existing(spark.createDataFrame([(9, *BASE[1:])], EVENT).drop("contact_id"), spark.createDataFrame(other, EVENT)).collect()
    assert [tuple(r) for r in got] == [(9, 5, 1.0, "exact", True)]


def test_a_person_keeps_the_first(spark):
    conflicts = spark.createDataFrame([(1, 2, 0.95), (2, 1, 0.7), (1, 3, 0.85), (4, 5, 0.95)], "id_a long, id_b long, similarity double")
    quality = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.55), (4, 0.4), (5, 0.55)], "id long, quality double")
    got = {(r["id_a"], r["id_b"]): (r["strategy"], r["keep"]) for r in R.resolutions(conflicts, quality).collect()}
    assert got == {(1, 2): ("automatic", 2), (2, 1): ("manual", 2), (1, 3): ("merge", 3), (4, 5): ("manual", 4)}


def test_failing_bulk_operations_and_private_access(spark):
    audit = "id long, ts timestamp_ntz, actor_id long, category string, outcome string, ip_address string, resource_count long, error_count long"
    at = NOW - timedelta(minutes=5)
    at = at.replace(hour=12)
    rows = [(1, at, 1, "bulk_operation", "success", "a", 200, 101), (2, at, 1, "bulk_operation", "success", "a", 200, 100), (3, at, 2, "bulk_operation", "success", "a", 100, 100), (4, at, 3, "data_access", "success", "a", 1, None), (5, at, 3, "data_access", "success", "a", 1, 0), (6, datetime(2023, 1, 1), 3, "data_access", "success", "a", 999, 999)]
    reached = spark.createDataFrame([(4,), (4,), (6,), (1,)], "id long")
    got = {tuple(r) for r in H.anomalies(spark.createDataFrame(rows, audit), "2024-01-31 00:00:00", minutes=24 * 60, private_access=reached).collect()}
    assert got == {("bulk_failures", "1", 1, "medium"), ("privacy_violation", "3", 1, "high")}
