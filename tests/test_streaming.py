"""Streams run once over files equal the batch operators."""

from pyspark.sql import functions as F

from calltide.operators import entity_resolution as R
from calltide.plans.adapter import view
from calltide.streaming import jobs

SF = "/root/testdata/sf0.001"


def stream(spark, df, tmp_path, files=3):
    at = f"file://{tmp_path}/in"
    df.repartition(files).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def log(spark):
    c = view(spark, SF, "comm")
    return c.withColumn("ts", F.col("ts").cast("timestamp"))


def test_deduplication(spark, tmp_path):
    c = log(spark)
    twice = c.unionByName(c.where("id % 3 = 0"))
    got = run(spark, jobs.deduplicated(stream(spark, twice, tmp_path, 1), ["id"], "60 days"), tmp_path, "dedup")
    assert got.count() == c.count()


def test_anchors_equal_the_batch(spark, tmp_path):
    c = log(spark).repartition(1)
    near = c.unionByName(c.where("id % 4 = 0").withColumns({"id": F.col("id") + 10_000_000, "ts": F.col("ts") + F.expr("INTERVAL '100' SECOND")}))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(spark, jobs.anchored(stream(spark, near, tmp_path, 1)), tmp_path, "anchors")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = R.anchor_clusters(near)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_upserting_sink(spark, tmp_path):
    c = log(spark).select("id", "duration", "source")
    sink = jobs.upsert_sink(f"file://{tmp_path}/out", ["id"], ["duration", "source"])
    sink(c, 0)
    more = c.where("id < 10").withColumns({"duration": F.lit(None).cast("int"), "source": F.lit("new")}).unionByName(spark.createDataFrame([(999_999_999, 5, "x")], c.schema))
    sink(more, 1)
    sink(more, 1)
    now = jobs.current(spark, f"file://{tmp_path}/out")
    assert now.count() == c.count() + 1
    assert now.where("source = 'new'").count() == more.count() - 1
    assert now.where("id < 10 AND duration IS NOT NULL").count() == c.where("id < 10 AND duration IS NOT NULL").count()


def test_windowed_detector(spark, tmp_path):
    rows = [(i, "10.0.0.1" if i < 7 else "10.0.0.2", "authentication", "failure", f"2024-01-01 00:0{i % 5}:00") for i in range(10)] + [(99, "x", "system", "success", "2024-01-03 00:00:00")]
    a = spark.createDataFrame(rows, "id int, ip_address string, category string, outcome string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = run(spark, jobs.failed_logins(stream(spark, a, tmp_path, 1), "15 minutes", "15 minutes", 5), tmp_path, "logins", "update")
    assert [(r["ip_address"], r["failures"]) for r in got.collect()] == [("10.0.0.1", 7)]


def test_dead_letters(spark, tmp_path):
    raw = spark.createDataFrame([("2025550123", "2024-01-01 10:00:00", "5", "call", "in", None), ("x", "2024-01-01 10:00:00", "5", "call", "in", None), (None, None, None, None, None, None)], "number string, ts string, duration string, type string, direction string, content string")
    jobs.with_dead_letters(f"file://{tmp_path}/good", f"file://{tmp_path}/bad")(raw, 0)
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 1
    assert sorted(r["errors"][0] for r in spark.read.parquet(f"file://{tmp_path}/bad").collect()) == ["number:invalid", "number:missing"]


def test_retries(spark):
    items = spark.createDataFrame([(1, 100, 0, 1000), (2, 100, 5, 1000), (3, -700_000, 1, 1000), (4, 100, 3, 1000)], "id int, created bigint, attempts int, failed bigint")
    got = {r["id"]: (r["state"], r["retry_at"]) for r in jobs.next_attempts(items, 1000).collect()}
    assert got == {1: ("retry", 1001), 2: ("dead", None), 3: ("expired", None), 4: ("retry", 1008)}
