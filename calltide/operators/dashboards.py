"""Dashboards, time series, heat-maps, gaps, trends and call patterns, for every owner at once or for one.

Each takes the event log and returns a row or rows for each owner: the aggregates are partial in the map stage, so what is
shuffled is a row for each owner (and hour, day, contact) of a task. ``as_of`` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.masks import mask_number
from calltide.operators.windows import sliced


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def of_owner(events: DataFrame, owner: int | None) -> DataFrame:
    return events if owner is None else events.where(F.col("owner_id") == owner)


def is_type(kind: str) -> Column:
    return F.col("type") == kind


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def since(as_of: str, days: int) -> Column:
    return F.col("ts") >= moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")


def hour_of() -> Column:
    return F.hour("ts").cast("bigint")


def dow_of() -> Column:
    """Sunday is 0."""
    return (F.dayofweek("ts") - 1).cast("bigint")


def top_of_group(df: DataFrame, group: str, *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each group; only rows already aggregated go in, so groups are small."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= n)


def dashboard_metrics(events: DataFrame, as_of: str, owner: int | None = None, recent_days: int = 30) -> DataFrame:
    """Totals, unique contacts, mean call minutes, recent events, busiest hour and the masked number of the top contact."""
    e = of_owner(events, owner)
    totals = e.groupBy("owner_id").agg(
        F.count("*").alias("total_events"), count_if(is_type("call")).alias("total_calls"), count_if(is_type("sms")).alias("total_sms"),
        F.countDistinct("contact_id").alias("unique_contacts"), F.round(F.avg(F.when(is_type("call"), F.col("duration"))) / 60, 1).alias("avg_call_minutes"),
        count_if(since(as_of, recent_days)).alias("recent_events"),
    )
    hours = e.groupBy("owner_id", hour_of().alias("busiest_hour")).agg(F.count("*").alias("n"))
    hours = top_of_group(hours, "owner_id", F.desc("n"), F.asc("busiest_hour")).select("owner_id", "busiest_hour")
    tops = e.where("contact_id IS NOT NULL").groupBy("owner_id", "contact_id").agg(F.count("*").alias("n"), F.min("number").alias("number"))
    tops = top_of_group(tops, "owner_id", F.desc("n"), F.asc("contact_id"))
    tops = tops.select("owner_id", mask_number(F.col("number")).alias("top_contact"), F.col("n").alias("top_contact_events"))
    return totals.join(hours, "owner_id", "left").join(tops, "owner_id", "left")


def time_series(events: DataFrame, granularity: str = "day", start: str | None = None, end: str | None = None, owner: int | None = None) -> DataFrame:
    """Counts by period (hour, day or week), both ends inclusive: events, calls, sms, unique contacts, mean duration, label."""
    e = of_owner(events, owner)
    if start is not None:
        e = e.where(F.col("ts") >= moment(start))
    if end is not None:
        e = e.where(F.col("ts") <= moment(end))
    period = F.date_trunc(granularity, "ts")
    label = {"hour": F.date_format("ts", "yyyy-MM-dd HH:00"), "day": F.date_format("ts", "yyyy-MM-dd"), "week": F.concat(F.date_format("ts", "yyyy"), F.lit("-W"), F.lpad(F.ceil(F.dayofyear("ts") / 7).cast("string"), 2, "0"))}[granularity]
    return (
        e.groupBy("owner_id", F.unix_timestamp(period.cast("timestamp")).alias("period"))
        .agg(F.min(label).alias("label"), F.count("*").alias("events"), count_if(is_type("call")).alias("calls"), count_if(is_type("sms")).alias("sms"),
             F.countDistinct("contact_id").alias("contacts"), F.round(F.avg("duration"), 2).alias("avg_duration"))
    )


def series_summary(series: DataFrame) -> DataFrame:
    """Of a time series: periods, total, mean of a period and the peak period (earliest of equals)."""
    peak = F.max_by(F.struct("period", "events"), F.struct("events", -F.col("period")))
    out = series.groupBy("owner_id").agg(F.count("*").alias("periods"), F.sum("events").alias("total"), peak.alias("peak"))
    return out.select("owner_id", "periods", "total", F.round(F.col("total") / F.col("periods"), 2).alias("mean_events"), F.col("peak.period").alias("peak_period"), F.col("peak.events").alias("peak_events"))


def activity_heatmap(events: DataFrame, as_of: str, days: int = 90, owner: int | None = None) -> DataFrame:
    """Events by weekday (0 is Sunday) and hour, and their percentage of the owner's largest cell."""
    cells = of_owner(events, owner).where(since(as_of, days)).groupBy("owner_id", dow_of().alias("dow"), hour_of().alias("hour")).agg(F.count("*").alias("events"))
    most = cells.groupBy("owner_id").agg(F.max("events").alias("most"))
    return cells.join(most, "owner_id").select("owner_id", "dow", "hour", "events", F.round(F.col("events") * 100.0 / F.col("most"), 1).alias("intensity"))


def dense_heatmap(cells: DataFrame, owners: DataFrame) -> DataFrame:
    """The whole 7 x 24 grid of each owner, zeros filled in."""
    spine = owners.select("owner_id", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("cell")).select("owner_id", F.floor(F.col("cell") / 24).alias("dow"), (F.col("cell") % 24).cast("bigint").alias("hour"))
    out = spine.join(cells, ["owner_id", "dow", "hour"], "left")
    return out.select("owner_id", "dow", "hour", F.coalesce("events", F.lit(0).cast("bigint")).alias("events"), F.coalesce("intensity", F.lit(0.0)).alias("intensity"), F.col("events").isNull().alias("is_empty"))


def heatmap_data(events: DataFrame, mode: str, start: str, end: str, types: list[str] | None = None, owner: int | None = None) -> DataFrame:
    """Buckets of a day (hours), week (weekdays) or month (days), with calls, sms, contacts, minutes and intensity of the largest."""
    bucket = {"daily": hour_of(), "weekly": dow_of(), "monthly": F.dayofmonth("ts").cast("bigint")}[mode]
    e = of_owner(events, owner).where((F.col("ts") >= moment(start)) & (F.col("ts") <= moment(end)))
    if types:
        e = e.where(F.col("type").isin(types))
    cells = e.groupBy("owner_id", bucket.alias("bucket")).agg(
        F.count("*").alias("events"), count_if(is_type("call")).alias("calls"), count_if(is_type("sms")).alias("sms"), F.countDistinct("contact_id").alias("contacts"),
        F.coalesce(F.sum(F.when(is_type("call"), F.col("duration").cast("bigint"))), F.lit(0).cast("bigint")).alias("call_seconds"),
    )
    most = cells.groupBy("owner_id").agg(F.max("events").alias("most"))
    return cells.join(most, "owner_id").withColumn("intensity", F.round(F.col("events") / F.greatest("most", F.lit(1)), 2)).drop("most")


def heatmap_summary(events: DataFrame, start: str, end: str, owner: int | None = None) -> DataFrame:
    """Events, events a day, commonest hour and weekday (lowest of equals), and the share of the commonest hour."""
    e = of_owner(events, owner).where((F.col("ts") >= moment(start)) & (F.col("ts") <= moment(end)))
    days = F.lit(max(1, 1))
    span = F.greatest(F.floor((F.unix_timestamp(moment(end).cast("timestamp")) - F.unix_timestamp(moment(start).cast("timestamp"))) / 86_400), days)
    out = e.groupBy("owner_id").agg(F.count("*").alias("events"), F.mode(hour_of(), True).alias("peak_hour"), F.mode(dow_of(), True).alias("peak_dow"))
    hours = e.groupBy("owner_id", hour_of().alias("hour")).agg(F.count("*").alias("n")).groupBy("owner_id").agg(F.max("n").alias("most"))
    return out.join(hours, "owner_id").select("owner_id", "events", F.round(F.col("events") / span, 2).alias("events_a_day"), "peak_hour", "peak_dow", F.round(F.col("most") / F.col("events"), 3).alias("peak_share"))


def data_gaps(events: DataFrame, threshold_hours: float = 24, inclusive: bool = False, top: int | None = None) -> DataFrame:
    """Silences longer than a threshold between an owner's consecutive events; ``inclusive`` keeps those as long, too.

    An owner's events are ordered day by day (:func:`sliced`), so a long history is spread over tasks. Events without a time are left
    out. Severity: under 48 h minor, under 168 h moderate, else major.
    """
    rows, w, own = sliced(events.select("owner_id", "ts", "id").where("ts IS NOT NULL"), ["owner_id"], ["ts", "id"], F.to_date("ts"))
    gaps = rows.select("owner_id", "ts", "_own", F.lag("ts").over(w).alias("before")).where(own & F.col("before").isNotNull())
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("before").cast("timestamp"))
    hours = seconds / 3600.0
    gaps = gaps.select("owner_id", F.unix_timestamp(F.col("before").cast("timestamp")).alias("gap_start"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("gap_end"), seconds.alias("seconds"), F.round(hours, 1).alias("hours"), hours.alias("_hours"))
    gaps = gaps.where(F.col("_hours") >= threshold_hours if inclusive else F.col("_hours") > threshold_hours)
    gaps = gaps.withColumn("severity", F.when(F.col("_hours") < 48, "minor").when(F.col("_hours") < 168, "moderate").otherwise("major")).drop("_hours")
    if top is not None:
        gaps = top_of_group(gaps, "owner_id", F.desc("seconds"), F.asc("gap_start"), n=top).drop("_rank")
    return gaps


def communication_trends(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Mean events of an active day and the least-squares slope of daily counts over the days' ordinals."""
    daily = events.where(since(as_of, days)).groupBy("owner_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    daily = daily.withColumn("x", F.row_number().over(Window.partitionBy("owner_id").orderBy("day")))  # a row for each day
    return daily.groupBy("owner_id").agg(F.count("*").alias("days"), F.sum("n").alias("events"), F.round(F.avg("n"), 2).alias("mean_events"), F.round(F.regr_slope("n", "x"), 2).alias("slope"))


def call_patterns(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Of calls: count, mean, sample deviation, extremes and how many are answered (longer than 0 s)."""
    calls = events.where(since(as_of, days) & is_type("call"))
    d = F.col("duration")
    return calls.groupBy("owner_id").agg(
        F.count("*").alias("calls"), F.round(F.avg(d), 2).alias("mean_duration"), F.round(F.stddev_samp(d), 2).alias("sd_duration"), F.min(d).cast("bigint").alias("shortest"), F.max(d).cast("bigint").alias("longest"),
        count_if(d > 0).alias("answered"), count_if(F.col("direction") == "inbound").alias("inbound"),
    )


#: Upper ends (seconds) of the duration classes.
DURATION_CLASSES = [(30, "0-30s"), (60, "30s-1m"), (180, "1-3m"), (600, "3-10m"), (1800, "10-30m")]


def duration_classes(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Calls by class of duration, with their percentage of the owner's calls."""
    d = F.col("duration")
    place, name = F.lit(len(DURATION_CLASSES)), F.lit("30m+")
    for i, (upto, label) in reversed(list(enumerate(DURATION_CLASSES))):
        place, name = F.when(d <= upto, i).otherwise(place), F.when(d <= upto, label).otherwise(name)
    counts = events.where(since(as_of, days) & is_type("call") & d.isNotNull()).groupBy("owner_id", place.cast("bigint").alias("place"), name.alias("class")).agg(F.count("*").alias("calls"))
    whole = counts.groupBy("owner_id").agg(F.sum("calls").alias("all"))
    return counts.join(whole, "owner_id").select("owner_id", "place", "class", "calls", F.round(F.col("calls") * 100.0 / F.col("all"), 1).alias("percent"))


def top_hours(events: DataFrame, as_of: str, days: int = 30, n: int = 5) -> DataFrame:
    hours = events.where(since(as_of, days) & is_type("call")).groupBy("owner_id", hour_of().alias("hour")).agg(F.count("*").alias("calls"))
    return top_of_group(hours, "owner_id", F.desc("calls"), F.asc("hour"), n=n).select("owner_id", F.col("_rank").cast("bigint").alias("place"), "hour", "calls")


def team_leaderboard(events: DataFrame, roles: DataFrame, n: int = 10) -> DataFrame:
    """Members of each organisation by events, equal counts sharing a rank; idle members count 0."""
    counts = events.groupBy(F.col("owner_id").alias("user_id")).agg(F.count("*").alias("events"), F.countDistinct("contact_id").alias("contacts"))
    zero = F.lit(0).cast("bigint")
    board = roles.join(counts, "user_id", "left").select("org_id", "user_id", "role", F.coalesce("events", zero).alias("events"), F.coalesce("contacts", zero).alias("contacts"))
    by_count = Window.partitionBy("org_id").orderBy(F.desc("events"))
    board = board.withColumn("place", F.rank().over(by_count).cast("bigint")).withColumn("_row", F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc("events"), "user_id")))
    return board.where(F.col("_row") <= n).drop("_row")


def team_metrics(events: DataFrame, roles: DataFrame) -> DataFrame:
    """Of each organisation: members, active members, events, calls, sms and distinct contacts."""
    members = roles.groupBy("org_id").agg(F.count("*").alias("team_size"))
    e = events.join(roles.select(F.col("user_id").alias("owner_id"), "org_id"), "owner_id")
    sums = e.groupBy("org_id").agg(F.count("*").alias("events"), count_if(is_type("call")).alias("calls"), count_if(is_type("sms")).alias("sms"), F.countDistinct("contact_id").alias("contacts"), F.countDistinct("owner_id").alias("active_members"))
    return members.join(sums, "org_id", "left")
