"""Similarities of phones, times, durations and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1 for two nulls or empties, 0 for one."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def text_ratio(a: Column, b: Column) -> Column:
    """:func:`edit_ratio` without regard to case and outer blanks."""
    return edit_ratio(F.lower(F.trim(a)), F.lower(F.trim(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays' distinct elements; two empties are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\W+"), lambda w: w != ""))


def time_decay(seconds: Column, tolerance: float) -> Column:
    """Linear decay from 1 at equal times to .5 at half of twice the tolerance and 0 beyond."""
    return F.greatest(F.lit(0.0), 1 - F.abs(seconds) / (2.0 * tolerance))


def duration_share(a: Column, b: Column) -> Column:
    """1 - relative difference; two nulls are equal, one null is not."""
    longer = F.greatest(a, b)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).when(longer == 0, 1.0).otherwise(1 - F.abs(a - b) / longer)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
