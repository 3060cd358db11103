"""Formulas on single rows whose results are worked out by hand, and the cases that go wrong easily."""

import datetime

import pytest
from pyspark.sql import functions as F

from calltide.functions import normalize as N
from calltide.operators import entity_resolution, health, ingest, matching, policies, vectors
from calltide.sources import readers

EVENT = "id bigint, owner_id int, line_id int, number string, direction string, type string, duration int, content string, ts timestamp"


def event(i, s=0.0, line=1, number="+15550000001", direction="inbound", type="call", duration=10, content=None):
    return (i, 1, line, number, direction, type, duration, content, datetime.datetime(2023, 1, 1, 10) + datetime.timedelta(seconds=s))


def test_conflicts_of_one_line_by_kind(spark):
    near = [event(1), event(2), event(3, 1, duration=11), event(4, 5, duration=40)]
    other = [event(5, line=2), event(6, number="+15550000002"), event(7, type="sms"), event(8, direction="outbound"), event(9, 3600)]
    got = {(r["id_a"], r["id_b"]): (r["conflict"], r["similarity"]) for r in matching.event_conflicts(spark.createDataFrame(near + other, EVENT), 1).collect()}
    assert got == {(1, 2): ("exact", 1.0), (1, 3): ("time_variance", 0.9), (2, 3): ("time_variance", 0.9), (1, 4): ("fuzzy", 0.7), (2, 4): ("fuzzy", 0.7), (3, 4): ("fuzzy", 0.7)}
    sms = [event(1, type="sms", duration=None, content="abcdefgh"), event(2, 5, type="sms", duration=None, content="abcd"), event(3, 0, type="sms", duration=None)]
    got = {(r["id_a"], r["id_b"]): (r["conflict"], r["similarity"]) for r in matching.event_conflicts(spark.createDataFrame(sms, EVENT), 1).collect()}
    assert got == {(1, 2): ("fuzzy", 0.5), (1, 3): ("exact", 0.9), (2, 3): ("fuzzy", 0.7)}


def test_similar_events_count_five_minutes_wholly(spark):
    rows = spark.createDataFrame([event(1), event(2, 120, direction="outbound"), event(3, 500)], EVENT)
    assert [tuple(r) for r in entity_resolution.similar_events(rows).collect()] == [(1, 2, 0.85)]


def test_weighted_similarity_by_relative_duration(spark):
    rows = spark.createDataFrame([event(1, duration=100), event(2, 3000, duration=110), event(3, 80_000, duration=None)], EVENT)
    pairs = matching.near_pairs(rows, ["owner_id", "number"], 86_400)
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in entity_resolution.weighted_similarity(pairs).collect()}
    # .3 number + time + durations + .2 content + .1 type
    assert got == {(1, 2): round(0.3 + 0.4 * 0.25 + 0.7 * 0.15 + 0.3, 4), (1, 3): round(0.3 + 0.2 * 0.25 + 0.1 * 0.15 + 0.3, 4), (2, 3): round(0.3 + 0.2 * 0.25 + 0.1 * 0.15 + 0.3, 4)}


def test_advanced_scores_weigh_what_both_have(spark):
    rows = spark.createDataFrame([event(1), event(2, 0.5), event(3, 0.5, line=2), event(4, 8, duration=300)], EVENT)
    pairs = matching.near_pairs(rows, ["owner_id", "number"], 30)
    got = {(r["id_a"], r["id_b"]): (r["score"], r["conflict"]) for r in policies.advanced_scores(pairs, 10).collect()}
    assert got[1, 2] == (round(0.65 + 0.95 * 0.25 + 0.1, 4), "exact") and got[1, 3] == (0.0, "fuzzy") and got[1, 4] == (0.65, "fuzzy")


def test_quality_penalties(spark):
    n = lambda k: spark.range(k)
    quality = lambda a, b: entity_resolution.dedup_quality(n(a), n(b)).first()["quality"]
    assert (quality(100, 90), quality(100, 20), quality(0, 0)) == (0.83, round(0.8 + 0.8 * 0.3 - 0.3 * 0.4, 4), 1.0)
    records = spark.createDataFrame([([],), ([],), ([],), (["duration:invalid"],)], "errors array<string>")
    assert ingest.batch_quality(records).first()["score"] == 0.5  # 1 - min(.5, 2 * 1 / 4)
    records = spark.createDataFrame([([],)] * 19 + [(["ts:missing"],)], "errors array<string>")
    assert ingest.batch_quality(records).first()["score"] == round(0.95 - 0.1 - 0.25, 4)


def test_health_score_in_proportion(spark):
    schema = "queue_depth double, drift_percentage double, sync_latency double, success_rate double, network_status string, data_quality double"
    score = lambda *row: health.health_score(health.sync_issues(spark.createDataFrame([row], schema))).first()["score"]
    assert score(0.0, 0.0, 0.0, 100.0, "connected", 100.0) == 100
    assert score(500.0, 5.0, 45_000.0, 98.0, "limited", 90.0) == 58  # 15 + 10 + 10 + .6 + 5 + 1.5 = 42.1 off
    assert score(2000.0, 20.0, 90_000.0, 50.0, "disconnected", 50.0) == 0


def test_risk_by_outcome_login_and_address(spark):
    rows = [("failure", "user_login", "10.0.0.1"), ("blocked", "export", "203.0.113.9"), ("warning", "view", "172.20.0.1"), ("success", "login", "172.40.0.1"), ("failure", "view", None)]
    df = spark.createDataFrame(rows, "outcome string, action string, ip string")
    assert [r[0] for r in df.select(health.risk_score(df.outcome, df.action, df.ip)).collect()] == [60, 90, 20, 30, 40]


def test_upsert_takes_one_new_row_whole(spark):
    old = spark.createDataFrame([(1, 5, "x")], "id int, a int, b string")
    new = spark.createDataFrame([(1, 9, "a", 1), (1, 2, "z", 2), (2, 7, None, 1)], "id int, a int, b string, at int")
    assert sorted(map(tuple, ingest.merge_insert(old, new, ["id"], ["a", "b"], "at").collect())) == [(1, 2, "z"), (2, 7, None)]
    assert sorted(map(tuple, ingest.merge_insert(old, new, ["id"], ["a", "b"]).collect())) == [(1, 9, "a"), (2, 7, None)]


def test_csv_with_a_preamble_keeps_rows_without_a_first_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Account report\nnumber,date,duration\n+15550000001,2024-01-01 10:00:00,5\n,2024-01-02 10:00:00,6\n+15550000003,2024-01-03 10:00:00,7\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r["number"] or "", r["duration"]) for r in got.collect()) == [("", "6"), ("+15550000001", "5"), ("+15550000003", "7")]


@pytest.mark.parametrize("sql", ["SELECT /* , secrets as ( */ * FROM secrets", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM secrets WINDOW x AS (ORDER BY 1), secrets AS (ORDER BY 1)",
    "WITH a AS (SELECT * FROM secrets), secrets AS (SELECT 1 AS x) SELECT * FROM a", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM range(5)", "SELECT 1 -- , secrets as (\n FROM secrets",
    r"SELECT r'\', reflect('java.lang.System','getProperty','user.home') AS x, id FROM comm", "SELECT /*+ BROADCAST(comm) */ * FROM comm", "SELECT system.builtin.reflect('a', 'b') FROM comm", "SELECT `reflect`('a', 'b') FROM comm", "SELECT IDENTIFIER('ref' || 'lect')('a', 'b') FROM comm",
    "SELECT * FROM IDENTIFIER('secrets')", "SELECT TRANSFORM(id) USING 'cat' FROM comm", "SET a = 1", "DROP TABLE comm", "INSERT INTO comm SELECT 1", "SHOW TABLES", "TABLE secrets", "SELECT current_user", "SELECT session_user() FROM comm", "SELECT 1; SELECT 2", "EXECUTE IMMEDIATE 'SELECT 1'",
    "SELECT id FROM comm WHERE id = (SELECT max(id) FROM secrets)", "SELECT sum(java_method('a', 'b')) OVER (ORDER BY id) FROM comm", "SELECT id FROM comm ORDER BY reflect('a', 'b')", "SELECT * FROM comm LATERAL VIEW explode(array(1)) t AS x", "SELECT * FROM comm |> WHERE reflect('a', 'b') = 1",
    "WITH a AS (SELECT reflect('a', 'b') AS x FROM comm) SELECT 1 FROM comm", "SELECT id FROM comm GROUP BY id HAVING reflect('a', 'b') = 1", "SELECT $reflect$ FROM comm", "SELECT transform(array(1), v -> reflect('a', 'b')) FROM comm"])
def test_guard_cannot_be_bypassed(spark, sql):
    spark.range(3).createOrReplaceTempView("secrets")
    spark.range(3).createOrReplaceTempView("comm")
    with pytest.raises(vectors.UnsafeQuery):
        vectors.guarded(spark, sql, {"comm": spark.range(2)})
    spark.catalog.dropTempView("secrets")


@pytest.mark.parametrize("sql", ["SELECT * FROM comm;", "WITH a AS (SELECT k, count(*) AS n FROM comm GROUP BY k HAVING count(*) > 1) SELECT * FROM a ORDER BY n DESC LIMIT 3", "SELECT sum(id) OVER w AS s FROM comm WINDOW w AS (ORDER BY id)", "SELECT * FROM (VALUES (1), (2)) AS v(x)",
    "SELECT id, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM comm WHERE id IN (SELECT id FROM comm WHERE k = 1) AND EXISTS (SELECT 1 FROM comm c WHERE c.id = comm.id)", "SELECT a.id FROM comm a LEFT JOIN comm b ON a.id = b.id UNION SELECT 1", "SELECT 'it''s; drop -- \"x\"' AS x FROM comm -- note",
    "SELECT CASE WHEN id > 1 THEN 'x' ELSE 'y' END AS c, CAST(id AS STRING), trim('a'), substring('abc', 1, 1), extract(year FROM DATE '2024-01-01'), date_trunc('day', TIMESTAMP '2024-01-01 01:00:00') FROM comm", "SELECT DISTINCT k FROM (SELECT id, k FROM comm) x(id, k)",
    "SELECT -id, id div 2, id % 2, 'a' || 'b', id IS NOT NULL, NOT (id IN (7)), id IS DISTINCT FROM 3 FROM comm WHERE id BETWEEN 0 AND 9 AND ('abc' LIKE 'a%' OR 'abc' RLIKE 'b' OR 'abc' ILIKE 'A%')"])
def test_guard_lets_questions_pass(spark, sql):
    assert vectors.guarded(spark, sql, {"comm": spark.range(5).selectExpr("id", "id % 2 AS k")}).count() > 0


def test_times_of_each_shape_and_none_else(spark):
    good = ["2024-01-05T10:20:30.5Z", "2024-01-05t10:20:30", "01/05/2024 10:20:30 am", "01/05/2024 10:20", "01-05-2024", "20240105 102030", "20240105102030", "2024-01-05 05:20:30 EST", "1704450030", "1704450030000"]
    day = {"01/05/2024 10:20": 1704450000, "01-05-2024": 1704412800}
    bad = ["2024-13-05", "02/30/2024", "1/5/2024", "2024-01-05 25:00", "01/05/2024 13:20 PM", "2024-01-05 10:20:30 XYZ", "12345", "", "  ", None]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = {r[0]: r[1] for r in df.select("v", F.unix_timestamp(N.event_time(F.col("v")))).collect()}
    assert got == {**{v: day.get(v, 1704450030) for v in good}, **dict.fromkeys(bad)}


def test_durations_beyond_any_number_are_null(spark):
    df = spark.createDataFrame([(v,) for v in ["1000000h", "99999999999999999999", "24:00:00", "1h3s", "5.7", "90 mins", "-5", "h"]], "v string")
    assert [r[0] for r in df.select(N.duration_seconds(F.col("v"))).collect()] == [None, None, 86_400, 3603, 5, 5400, None, None]


def test_stages_of_duplicates(spark):
    sms = lambda i, s, text: event(i, s, type="sms", duration=None, content=text)
    rows = [event(1), event(2), event(3, 1, duration=11), sms(4, 5000, "see you at the station"), sms(5, 90_000, "The station: see you at"), sms(6, 180_000, "short"), sms(7, 270_000, "short")]
    df = spark.createDataFrame(rows, EVENT)
    first = {(2, 1, "exact"), (3, 1, "bucketed")}
    assert set(map(tuple, entity_resolution.staged_duplicates(df).collect())) == first
    assert set(map(tuple, entity_resolution.staged_duplicates(df, by_content=True).collect())) == first | {(5, 4, "content")}
    assert entity_resolution.staged_duplicates(df.limit(0), by_content=True).collect() == []
