"""Pairs of near events, conflicts, and contacts filled in by number.

Times within a tolerance are found by an equi-join on the keys and a time bucket as wide as the tolerance: each row is put in
its bucket once and looks in the next one, too, so no pair is made twice and none beyond two tolerances is made at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(events: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Pairs id_a < id_b with equal keys and times at most ``seconds`` apart, with both sides' fields; null keys match nothing."""
    width = int(seconds * 1_000_000)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    fields = [c for c in ("type", "direction", "duration", "content", "source", "line_id", "contact_id") if c in events.columns and c not in keys]
    e = events.select(*keys, "id", us.alias("us"), *fields).withColumn("bucket", F.floor(F.col("us") / max(width, 1)))
    side = lambda s: e.select(*keys, F.col("id").alias(f"id_{s}"), F.col("us").alias(f"us_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in fields), "bucket")
    first = side("x").withColumnRenamed("bucket", "own").withColumn("bucket", F.explode(F.array("own", F.col("own") + 1)))
    pairs = first.join(side("y").withColumnRenamed("bucket", "bucket_y").withColumn("bucket", F.col("bucket_y")), [*keys, "bucket"])
    near = (F.abs(F.col("us_x") - F.col("us_y")) <= width) & ((F.col("own") < F.col("bucket_y")) | (F.col("id_x") < F.col("id_y")))
    pairs = pairs.where(near)
    swap = F.col("id_x") > F.col("id_y")
    pick = lambda c, a, b: F.when(swap, F.col(f"{c}_{b}")).otherwise(F.col(f"{c}_{a}"))
    both = [pick(c, a, b).alias(f"{c}_{a2}") for c in ("id", *fields) for a, b, a2 in (("x", "y", "a"), ("y", "x", "b"))]
    return pairs.select(*keys, *both, F.abs(F.col("us_x") - F.col("us_y")).alias("gap_us"))


#: What conflicting events share, and how many tolerances lie between them at most.
CONFLICT_KEYS, CONFLICT_REACH = ["owner_id", "line_id", "number", "direction", "type"], 10


def event_conflicts(events: DataFrame, tolerance: float = 1) -> DataFrame:
    """Conflicting pairs of one owner, line, number, direction and type, at most ten tolerances apart, with a similarity.

    exact: equal times and durations (or none); time_variance: within the tolerance, durations (none: 0) at most 1 s apart; else
    fuzzy. The similarity is 1 for equal times and known durations, .9 within the tolerance, else by the lengths of contents (1
    less what the first is longer by, as a share of the longer; over 1 where it's shorter), .7 without contents.
    """
    p = near_pairs(events, CONFLICT_KEYS, tolerance * CONFLICT_REACH)
    a, b = F.col("duration_a"), F.col("duration_b")
    near = F.col("gap_us") <= tolerance * 1_000_000
    exact = (F.col("gap_us") == 0) & a.eqNullSafe(b)
    zero = F.lit(0)
    shifted = near & (F.abs(F.coalesce(a, zero) - F.coalesce(b, zero)) <= 1)
    m, n = F.char_length("content_a"), F.char_length("content_b")
    ratio = F.when(m.isNotNull() & n.isNotNull() & (F.greatest(m, n) > 0), F.greatest(F.lit(0.0), 1.0 - (m - n) / F.greatest(m, n))).when(m.isNotNull() & n.isNotNull(), 1.0).otherwise(0.7)
    return p.select(
        "id_a", "id_b", F.when(exact, "exact").when(shifted, "time_variance").otherwise("fuzzy").alias("conflict"),
        F.when((F.col("gap_us") == 0) & (a == b), 1.0).when(near, 0.9).otherwise(ratio).alias("similarity"),
    )


def fill_contacts(events: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contact ids from numbers, only where they're missing. Of contacts with one number the smallest id is taken."""
    by_number = contacts.where("number IS NOT NULL").groupBy("number").agg(F.min("id").alias("found"))
    e = events.select("id", "number", "contact_id").join(by_number, "number", "left")
    return e.select("id", F.coalesce("contact_id", "found").alias("contact_id"), (F.col("contact_id").isNull() & F.col("found").isNotNull()).alias("filled"))
