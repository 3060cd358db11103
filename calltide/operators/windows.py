"""Windows of a few rows back over keys with very many rows: each key's history is cut into slices, which are partitions of their own.

A slice gets copies of the last rows before it, so that what a window looks back at is there. These come from a small table, a
few rows for each key and slice, whatever the number of rows; so a key with a third of all rows is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def sliced(df: DataFrame, keys: list[str], order: list[str], slice_: Column, back: int = 1) -> tuple[DataFrame, WindowSpec, Column]:
    """(rows, window, own): ``df`` with copies of the ``back`` rows before each slice, a window over a slice in order, and which rows are own.

    ``slice_`` must not fall along ``order``, the day of its first column for example; ``order`` is unique within a key and has no nulls. Frames
    of the window reach back ``back`` rows at most; filter by ``own`` after it, and before anything is counted.
    """
    own = df.select("*", slice_.alias("_slice"), F.lit(True).alias("_own"))
    row = F.struct(*order, *(c for c in df.columns if c not in order))
    group = [*keys, "_slice"]
    if back == 1:
        tails = own.groupBy(*group).agg(F.array(F.max(row)).alias("_tail"))
    else:
        last = Window.partitionBy(*group).orderBy(*(F.desc(c) for c in order))
        ranked = own.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= back)  # tasks drop the others before the shuffle
        tails = ranked.groupBy(*group).agg(F.collect_list(row).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-back, -1)  # a row for each slice
    seen = F.slice(F.sort_array(F.flatten(F.collect_list("_tail").over(before)), asc=False), 1, back)
    copies = tails.select("_slice", seen.alias("_seen")).select("_slice", F.explode("_seen").alias("_r")).select("_r.*", "_slice", F.lit(False).alias("_own"))
    return own.unionByName(copies.select(*own.columns)), Window.partitionBy(*group).orderBy(*order), F.col("_own")
