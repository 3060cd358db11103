"""Filters of the log: optional predicates, named quick filters, pages, and the last rows of each group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.dashboards import count_if, moment


def where_all(df: DataFrame, predicates: list[Column | None]) -> DataFrame:
    """Rows for which all given predicates hold; None stands for no predicate, so that it never reaches the plan."""
    return reduce(lambda d, p: d if p is None else d.where(p), predicates, df)


def filter_events(events: DataFrame, types=None, directions=None, start=None, end=None, contacts=None, sources=None, content=None, min_duration=None, max_duration=None, keep_without_duration=False) -> DataFrame:
    """Every argument is optional; dates are inclusive at both ends; ``content`` matches anywhere, in any case."""
    d = F.col("duration")
    long = lambda p: p | d.isNull() if keep_without_duration else p
    member = lambda c, values: F.col(c).isin(list(values)) if values else None
    return where_all(events, [
        member("type", types), member("direction", directions), member("contact_id", contacts), member("source", sources),
        None if start is None else F.col("ts") >= moment(start), None if end is None else F.col("ts") <= moment(end),
        None if not content else F.col("content").ilike(f"%{content}%"),
        None if min_duration is None else long(d >= min_duration), None if max_duration is None else long(d <= max_duration),
    ])


def client_filter(events: DataFrame, search: str | None = None, min_duration: int | None = None, max_duration: int | None = None) -> DataFrame:
    """Search in numbers and content; durations bind calls only."""
    text = None
    if search:
        has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(search.lower())
        text = has("number") | has("content")
    other, d = F.col("type") != "call", F.col("duration")
    return where_all(events, [text, None if min_duration is None else other | (d >= min_duration), None if max_duration is None else other | (d <= max_duration)])



def sorted_events(events: DataFrame, by: str = "recent") -> DataFrame:
    keys = {"recent": [F.desc("ts")], "oldest": [F.asc("ts")], "longest": [F.desc_nulls_last("duration")], "number": [F.asc("number")]}[by]
    return events.orderBy(*keys, "id")


def quick_filters(today: str, as_of: str) -> dict[str, Column]:
    call = F.col("type") == "call"
    return {
        "today": F.col("ts") >= F.date_trunc("day", moment(today)), "missed_calls": call & (F.col("direction") == "inbound") & (F.col("duration") == 0),
        "recent_week": F.col("ts") >= moment(as_of) - F.expr("INTERVAL '7' DAY"), "outbound_calls": call & (F.col("direction") == "outbound"),
        "long_calls": call & (F.col("duration") >= 300), "text_messages": F.col("type") == "sms",
    }


def quick_filter_counts(events: DataFrame, today: str, as_of: str) -> DataFrame:
    """All quick filters in one scan."""
    named = quick_filters(today, as_of)
    sums = events.agg(*(count_if(p).alias(n) for n, p in named.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("events")) for n in named))).alias("x")).select("x.name", "x.events")


def normalized_filter(kind: str | None, status: str | None, low: int | None, high: int | None) -> dict:
    """Text messages have neither status nor duration; a range the wrong way round collapses to its lower end."""
    if kind == "sms":
        status = low = high = None
    if low is not None and high is not None and low > high:
        high = low
    return {"type": kind, "status": status, "min_duration": low, "max_duration": high}


def page_with_total(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page, newest first, and the number of all rows in each of its rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(F.desc("ts"), "id").offset(offset).limit(limit).crossJoin(total)  # of one row


def last_n(df: DataFrame, group: str, n: int) -> DataFrame:
    """The newest n rows of each group. Spark keeps only n rows a group in each task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(F.desc("ts"), "id")
    return df.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n)
