"""Vectors, guarded SQL, intents, classification, visibility and chains."""

import pytest
from pyspark.sql import functions as F

from calltide.operators import classify, health, vectors, visibility
from calltide.plans.adapter import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def comm(spark):
    return view(spark, SF, "comm")


@pytest.mark.parametrize("sql", ["DROP TABLE comm", "SELECT 1; DELETE FROM comm", "INSERT INTO comm SELECT * FROM comm", "", "SELECT * FROM secrets", "WITH x AS (SELECT * FROM other) SELECT * FROM x"])
def test_guard_refuses(spark, comm, sql):
    with pytest.raises(vectors.UnsafeQuery):
        vectors.guarded(spark, sql, {"comm": comm})


def test_guard_lets_harmless_names_pass(spark, comm):
    sql = "WITH x AS (SELECT id AS created_at, 'drop table' AS updated_at FROM comm) SELECT * FROM x"
    assert vectors.guarded(spark, sql, {"comm": comm}, 7).count() == 7


def test_templates_and_intents(spark, comm):
    for name, args in (("calls_of_contact", {"contact": 1}), ("events_between", {"start": "2024-01-01", "end": "2024-02-01"}), ("top_contacts", {}), ("daily_volume", {})):
        assert vectors.run_template(spark, name, comm, **args).count() > 0
    assert vectors.intent_of("How many texts?") == "texts"
    assert {vectors.intent_of(q) for q in ("show missed calls", "my top contacts", "whatever")} == {"missed_calls", "top_contacts", "recent"}
    for q in vectors.INTENTS:
        assert vectors.INTENTS[q](comm).count() >= 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id % 20 = 0").withColumnRenamed("id", "ask_id")
    whole = sorted(map(tuple, vectors.similar_vectors(e, asked, 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(map(tuple, vectors.similar_vectors(e, asked, 3).collect())) == whole


def test_cells_find_most_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id % 20 = 0").withColumnRenamed("id", "ask_id")
    exact = {(r["ask_id"], r["id"]) for r in vectors.similar_vectors(e, asked, 5).collect()}
    found = {(r["ask_id"], r["id"]) for r in vectors.search_cells(vectors.kmeans_cells(e, 8), e, asked, 5, probes=6).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_store_or_merge(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0], 4, 10.0), (2, [0.0, 1.0], 1, 5.0)], "id bigint, vector array<double>, runs bigint, mean_ms double")
    n = spark.createDataFrame([(10, [0.999, 0.01], 1, 20.0), (11, [0.7, 0.7], 1, 1.0)], s.schema)
    got = {r["id"]: (r["runs"], r["mean_ms"]) for r in vectors.store_or_merge(s, n).collect()}
    assert got == {1: (5, 12.0), 2: (1, 5.0), 11: (1, 1.0)}


def test_layout_model(spark):
    import random

    rng = random.Random(0)
    rows = []
    for i in range(60):
        n = "".join(rng.choice("0123456789") for _ in range(10))
        rows += [(3 * i, f"CDR|20230101|103000|+1{n}|O|180|C", "att"), (3 * i + 1, f"VZW|2023-01-01|10:30:00|{n}|O|180", "verizon"), (3 * i + 2, f"Date,Number\n2023-01-01,{n}", "csv")]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    model = classify.layout_model(df.where("id < 120"))
    got = classify.classify(model, df.where("id >= 120").drop("label")).join(df, "id")
    assert got.where("predicted = label").count() == got.count() and got.where("confidence > 0.5").count() == got.count()
    assert classify.layout_decision(0.9, 0.9, 0.9, "att", 5) == (0.9, False) and classify.layout_decision(0.9, 0.9, 0.9, "unknown", 5)[1]


def test_templates_match(spark):
    files = spark.createDataFrame([(1, ["Date/Time", "Phone Number", "Duration"]), (2, ["foo", "bar"])], "id bigint, headers array<string>")
    templates = spark.createDataFrame([(7, ["date/time", "phone number", "duration", "type"]), (8, ["x", "y"])], "id bigint, headers array<string>")
    assert [tuple(r) for r in classify.match_templates(files, templates).collect()] == [(1, 7, 1.0)]
    jobs = spark.createDataFrame([(7, "completed"), (7, "failed"), (7, "completed")], "template_id bigint, status string")
    assert {r["template_id"]: (r["uses"], r["success_rate"]) for r in classify.template_success(jobs, templates).collect()} == {7: (3, 66.67), 8: (0, None)}
    t = spark.createDataFrame([(7, 3, 0.9), (8, 1, 0.5)], "id bigint, uses bigint, accuracy double")
    f = spark.createDataFrame([(7, 0.5)], "template_id bigint, accuracy double")
    assert {r["id"]: (r["uses"], r["accuracy"]) for r in classify.updated_accuracy(t, f).collect()} == {7: (4, 0.8), 8: (1, 0.5)}


def test_roles(spark):
    assert visibility.POWER["owner"] - visibility.POWER["admin"] == 1 and visibility.POWER["viewer"] - visibility.POWER["owner"] == -4
    m = {(r["resource"], r["action"], r["role"]): r["allowed"] for r in visibility.permission_matrix(spark).collect()}
    assert m["events", "read", "viewer"] and not m["events", "delete", "analyst"] and m["billing", "write", "owner"]
    moves = {(a, o, n): ok for a, o, n, ok in visibility.role_transitions()}
    assert moves["admin", "member", "analyst"] and not moves["admin", "member", "owner"] and not moves["viewer", "viewer", "owner"]
    roles = spark.createDataFrame([(1, 1, "viewer"), (1, 2, "admin"), (2, 2, "member")], "user_id bigint, org_id bigint, role string")
    assert visibility.user_permissions(roles).where("user_id = 1 AND resource = 'audit'").count() == 1


def test_tampering_is_found(spark):
    entries = spark.createDataFrame([(a, s, f"{a}-{s}") for a in range(3) for s in range(5)], "actor_id bigint, seq bigint, body string")
    chain = health.chained(entries)
    assert health.broken_links(chain).count() == 0
    bad = chain.withColumn("body", F.when((F.col("actor_id") == 1) & (F.col("seq") == 2), "changed").otherwise(F.col("body")))
    assert [tuple(r) for r in health.broken_links(bad).collect()] == [(1, 2, "checksum")]
    gone = chain.where("NOT (actor_id = 2 AND seq = 3)")
    assert [tuple(r) for r in health.broken_links(gone).collect()] == [(2, 4, "link")]
