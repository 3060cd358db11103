"""Windows over slices against windows over whole keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from calltide.operators.windows import sliced


@pytest.mark.parametrize("back", [1, 2, 4])
def test_slices_see_what_stands_before_them(spark, back):
    rng = random.Random(back)
    rows = [(rng.choice(["a", "b", None]), datetime(2024, 1, 1) + timedelta(hours=rng.choice([0, 1, 30, 31, 32, 100, 500]) + rng.randrange(3)), i, rng.randrange(100) if rng.random() < 0.8 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v long").repartition(3)
    whole = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.lag("v").over(whole), F.sum("v").over(whole.rowsBetween(-back, -1)), F.count("*").over(whole.rowsBetween(-back, -1)))
    out, w, own = sliced(df, ["k"], ["ts", "id"], F.to_date("ts"), back)
    got = out.select("id", F.lag("v").over(w), F.sum("v").over(w.rowsBetween(-back, -1)), F.count("*").over(w.rowsBetween(-back, -1)), own.alias("own")).where("own").drop("own")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    none, w, own = sliced(df.limit(0), ["k"], ["ts", "id"], F.to_date("ts"), back)
    assert none.where(own).count() == 0


def test_keys_are_spread_over_their_slices(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), (F.lit("2024-01-01").cast("date") + (F.col("id") % 50).cast("int")).cast("timestamp_ntz").alias("ts"), "id")
    out, w, own = sliced(df, ["k"], ["ts", "id"], F.to_date("ts"))
    parts = out.repartition(50, "k", "_slice").select(F.spark_partition_id().alias("p")).groupBy("p").count().count()
    assert parts > 20 and out.count() == 1000 + 49
