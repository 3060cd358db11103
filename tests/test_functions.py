"""Column functions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calltide.functions import masks as M
from calltide.functions import normalize as N
from calltide.functions import similarity as S


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_phones(spark):
    got = column(spark, ["1234567890", "(123) 456-7890", "+1-123-456-7890", "11234567890", "+44123456789", "01144123456789", "12", "n/a", None, "000-123-4567"], N.e164)
    assert got == ["+11234567890"] * 4 + ["+44123456789", "+44123456789", None, None, None, None]


def test_durations(spark):
    got = column(spark, ["1:02:03", "2:03", "90", "1h 2m 3s", "5 minutes", "2 hours 5 seconds", "", "x", None, "90000", "12.7"], N.duration_seconds)
    assert got == [3723, 123, 90, 3723, 300, 7205, None, None, None, None, 12]
    assert column(spark, [3723, 123, 59, None], N.format_duration, "int") == ["1:02:03", "2:03", "0:59", None]


def test_times(spark):
    values = ["2023-01-01T10:30:00Z", "2023-01-01 10:30:00", "01/01/2023 10:30", "2023-01-01 05:30:00 EST", "2023-01-01T12:30:00+02:00", "1672569000", "1672569000000", "20230101 103000", "01/01/2023 10:30 AM", "nope", None]
    got = column(spark, values, lambda c: F.unix_timestamp(N.event_time(c)))
    assert got == [1672569000] * 9 + [None, None]


def test_words(spark):
    assert column(spark, ["Voice", "MMS", "incoming", None], N.event_type) == ["call", "sms", None, None]
    assert column(spark, ["Incoming", "O", "sent", "sideways"], N.direction) == ["inbound", "outbound", "outbound", None]
    assert column(spark, ["Yes", "0", "maybe"], N.boolean) == [True, False, None]


@pytest.mark.parametrize("a, b, want", [("Hello World", "hello world", 1.0), ("Hello World how are you", "Hello World how r u", 19 / 23), (None, None, 1.0), (None, "hello", 0.0), ("", "", 1.0)])
def test_text_ratio(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(S.text_ratio(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_other_similarities(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], "a b c", "b c d", 120, 120, 1.0)], "x array<double>, y array<double>, s string, t string, p int, q int, g double")
    r = df.select(S.cosine(F.col("x"), F.col("y")).alias("c"), S.jaccard(S.words(F.col("s")), S.words(F.col("t"))).alias("j"), S.duration_share(F.col("p"), F.col("q")).alias("d"), S.time_decay(F.col("g"), 2).alias("t")).first()
    assert r["c"] == pytest.approx(0.5**0.5) and r["j"] == 0.5 and r["d"] == 1.0 and r["t"] == 0.75


def test_masks(spark):
    assert column(spark, ["+12025550123", "123", None], M.mask_number) == ["+12-***-0123", "***-***-****", "***-***-****"]
    assert column(spark, ["+12025550123", "1234567"], M.partial_mask) == ["+12*****0123", "*******"]
    assert column(spark, [25, 100], lambda c: M.number_range(c, 1), "int") == ["20-29", "100-109"]
    assert len(column(spark, ["a"], M.numeric_token)[0]) == 10
    assert column(spark, ["a", "a"], M.hash_token)[0] == column(spark, ["a", "b"], M.hash_token)[0]
    assert [M.k_level(k) for k in (1, 5, 10, 11, 100)] == [0, 1, 1, 2, 2]
    day = column(spark, [dt.datetime(2024, 3, 5, 7, 8, 9)], lambda c: M.time_range(c, 3), "timestamp")
    assert day == [dt.datetime(2024, 3, 1)]


def test_noise_is_centred_and_repeatable(spark):
    df = spark.range(20_000).repartition(2).select(M.laplace_noise(1.0, 0.5, 3).alias("l"), M.gaussian_noise(2.0, 3).alias("g"))
    r = df.agg(F.avg("l"), F.stddev("l"), F.avg("g"), F.stddev("g")).first()
    assert abs(r[0]) < 0.1 and abs(r[1] - 8**0.5) < 0.2 and abs(r[2]) < 0.1 and abs(r[3] - 2) < 0.1
