"""Contacts: profiles, patterns, search, metrics, classes and trends of communication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.masks import mask_content, mask_number
from calltide.operators.dashboards import count_if, dow_of, hour_of, is_type, moment, since, top_of_group
from calltide.operators.filters import last_n


def seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def known(events: DataFrame) -> DataFrame:
    return events.where("contact_id IS NOT NULL")


def contact_profile(events: DataFrame, contacts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """For each contact: name, events, mean call minutes, events of the last days, commonest hour, first and last time."""
    sums = known(events).groupBy(F.col("contact_id").alias("id")).agg(
        F.count("*").alias("events"), F.round(F.avg(F.when(is_type("call"), F.col("duration"))) / 60, 1).alias("avg_minutes"), count_if(since(as_of, days)).alias("recent"),
        F.mode(hour_of(), True).alias("peak_hour"), F.min(seconds("ts")).alias("first_at"), F.max(seconds("ts")).alias("last_at"),
    )
    return contacts.select("id", "name", "company").join(sums, "id", "left").withColumn("events", F.coalesce("events", F.lit(0).cast("bigint"))).withColumn("recent", F.coalesce("recent", F.lit(0).cast("bigint")))


def recent_events(events: DataFrame, rules: DataFrame, n: int = 20) -> DataFrame:
    """The newest n events of each contact, content hidden where the contact's rule says so."""
    last = last_n(known(events), "contact_id", n)
    r = rules.select("contact_id", "anonymize_content")
    out = last.join(r, "contact_id", "left")
    return out.select("contact_id", "place", "id", "type", "direction", mask_content(F.col("content"), F.coalesce("anonymize_content", F.lit(False)), "[PRIVATE]").alias("content"))


def communication_summary(events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Of the last days: events, calls, sms, in, out, call seconds, active days, events an active day."""
    e = known(events).where(since(as_of, days)).groupBy("contact_id").agg(
        F.count("*").alias("events"), count_if(is_type("call")).alias("calls"), count_if(is_type("sms")).alias("sms"), count_if(F.col("direction") == "inbound").alias("inbound"),
        count_if(F.col("direction") == "outbound").alias("outbound"), F.coalesce(F.sum(F.col("duration").cast("bigint")), F.lit(0).cast("bigint")).alias("call_seconds"), F.countDistinct(F.to_date("ts")).alias("active_days"),
    )
    return e.withColumn("events_a_day", F.round(F.col("events") / F.greatest("active_days", F.lit(1)), 2))


def active_days(events: DataFrame, as_of: str, days: int = 90, n: int = 30) -> DataFrame:
    """Each contact's last n active days with their counts."""
    d = known(events).where(since(as_of, days)).groupBy("contact_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), count_if(is_type("call")).alias("calls"))
    return top_of_group(d, "contact_id", F.desc("day"), n=n).select("contact_id", "day", "events", "calls")


def enhanced_metrics(events: DataFrame) -> DataFrame:
    """Events, whole days known, events a day and the share of inbound ones."""
    e = known(events).groupBy("contact_id").agg(F.count("*").alias("events"), F.floor((F.max(seconds("ts")) - F.min(seconds("ts"))) / 86_400).alias("days_known"), count_if(F.col("direction") == "inbound").alias("_in"))
    return e.select("contact_id", "events", "days_known", F.round(F.col("events") / F.greatest("days_known", F.lit(1)), 3).alias("events_a_day"), F.round(F.col("_in") / F.greatest(F.lit(1), "events"), 3).alias("inbound_ratio"))


def distributions(events: DataFrame, contacts: DataFrame, as_of: str) -> DataFrame:
    """Zero-filled counts of each contact by hour (24), weekday (7) and month back from ``as_of`` (13)."""
    months = (F.year(moment(as_of)) * 12 + F.month(moment(as_of)) - F.year("ts") * 12 - F.month("ts")).cast("bigint")
    e = known(events).select("contact_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("slot")) for k, v in (("hour", hour_of()), ("dow", dow_of()), ("month", months))))).alias("x"))
    counts = e.groupBy("contact_id", F.col("x.kind").alias("kind"), F.col("x.slot").alias("slot")).agg(F.count("*").alias("n"))
    slots = [(k, i) for k, n in (("hour", 24), ("dow", 7), ("month", 13)) for i in range(n)]
    spine = contacts.select(F.col("id").alias("contact_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).cast("bigint").alias("slot")) for k, i in slots))).alias("s")).select("contact_id", "s.kind", "s.slot")
    return spine.join(counts, ["contact_id", "kind", "slot"], "left").select("contact_id", "kind", "slot", F.coalesce("n", F.lit(0).cast("bigint")).alias("events"))


def direction_breakdown(events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    e = known(events).where(since(as_of, days))
    return e.groupBy("contact_id", "direction", "type").agg(F.count("*").alias("events"), F.round(F.avg("duration"), 2).alias("avg_duration"))


def search_text(*fields: Column) -> Column:
    """The distinct words of some fields, lower case: what stands for a text-search vector (no stems, no weights)."""
    text = F.concat_ws(" ", *fields)
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def text_rank(words: Column, terms: list[str]) -> Column:
    """Hits over 1 + words, if every term is found; else 0."""
    hit = [F.array_contains(words, t) for t in terms]
    every = reduce(lambda a, b: a & b, hit) if hit else F.lit(False)
    return F.when(every, F.lit(float(len(terms))) / (1 + F.size(words))).otherwise(0.0)


def search_contacts(contacts: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """By text rank, plus 1 for a hit in the number and .5 for a tag; best first."""
    terms = [t for t in "".join(c if c.isalnum() else " " for c in q.lower()).split()]
    words = search_text(F.col("name"), F.col("company"), F.col("tag"))
    score = text_rank(words, terms) + F.when(F.col("number").contains(q), 1.0).otherwise(0.0) + F.when(F.lower("tag") == q.lower(), 0.5).otherwise(0.0)
    out = contacts.select("id", "name", "number", F.round(score, 4).alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(limit)


def ranked_contacts(contacts: DataFrame, events: DataFrame, rules: DataFrame, as_of: str, term: str | None = None, tags: list[str] | None = None, sort: str = "relevance", limit: int = 50, offset: int = 0) -> DataFrame:
    """Contacts that aren't private, by relevance x (1 + activity / 1000), recency, activity or name.

    Score: .7 of the events plus 30, 20, 10 or 0 for a last event within 7, 30, 90 days or before.
    """
    act = known(events).groupBy(F.col("contact_id").alias("id")).agg(F.count("*").alias("activity"), F.max(seconds("ts")).alias("last_at"))
    r = rules.select(F.col("contact_id").alias("id"), "visibility", "anonymize_number")
    c = contacts.join(act, "id", "left").join(r, "id", "left").where("visibility IS NULL OR visibility <> 'private'")
    if tags:
        c = c.where(F.col("tag").isin(tags))
    if term:
        c = c.where(F.col("name").ilike(f"%{term}%") | F.col("company").ilike(f"%{term}%") | F.col("number").contains(term))
    age = F.unix_timestamp(moment(as_of).cast("timestamp")) - F.col("last_at")
    recency = F.when(age <= 7 * 86_400, 30).when(age <= 30 * 86_400, 20).when(age <= 90 * 86_400, 10).otherwise(0)
    activity = F.coalesce("activity", F.lit(0).cast("bigint"))
    exact = F.when(F.lower("name") == (term or "").lower(), 2.0).otherwise(1.0) if term else F.lit(1.0)
    c = c.select(
        "id", "name", F.when(F.coalesce("anonymize_number", F.lit(False)), mask_number(F.col("number"))).otherwise(F.col("number")).alias("number"), activity.alias("activity"), "last_at",
        F.round(exact * (1 + activity / 1000), 4).alias("relevance"), F.round(activity * 0.7 + recency, 1).alias("score"),
    )
    keys = {"relevance": [F.desc("relevance")], "recent": [F.desc_nulls_last("last_at")], "most_active": [F.desc("activity")], "alphabetical": [F.asc("name")]}[sort]
    return c.orderBy(*keys, "id").offset(offset).limit(limit)


def contact_metrics(events: DataFrame) -> DataFrame:
    """The aggregate kept for each contact; refreshing it is writing it again."""
    return known(events).groupBy("contact_id").agg(
        F.count("*").alias("events"), count_if(is_type("call")).alias("calls"), count_if(is_type("sms")).alias("sms"), F.round(F.avg("duration"), 2).alias("avg_duration"),
        F.max(seconds("ts")).alias("last_at"), F.round(count_if(F.col("direction") == "inbound") / F.greatest(F.lit(1), F.count("*")), 3).alias("inbound_ratio"), F.mode(hour_of(), True).alias("peak_hour"),
    )


def refresh(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def analyze_contacts(events: DataFrame) -> DataFrame:
    """Totals, times, events a week and class: over 10 frequent, over 3 regular, over 1 occasional, else rare."""
    e = known(events).groupBy("contact_id").agg(F.count("*").alias("events"), F.min(seconds("ts")).alias("first_at"), F.max(seconds("ts")).alias("last_at"))
    weeks = F.greatest(F.lit(1.0), (F.col("last_at") - F.col("first_at")) / 604_800.0)
    rate = F.col("events") / weeks
    return e.withColumn("events_a_week", F.round(rate, 2)).withColumn("class", F.when(rate > 10, "frequent").when(rate > 3, "regular").when(rate > 1, "occasional").otherwise("rare"))


def top_weekdays(events: DataFrame, n: int = 3) -> DataFrame:
    d = known(events).groupBy("contact_id", dow_of().alias("dow")).agg(F.count("*").alias("events"))
    return top_of_group(d, "contact_id", F.desc("events"), F.asc("dow"), n=n).select("contact_id", F.col("_rank").cast("bigint").alias("place"), "dow", "events")


def export_metrics(events: DataFrame) -> DataFrame:
    """Of an owner's whole log: events, unique parties (contact, else number), mean, longest call and busiest day."""
    party = F.coalesce(F.concat(F.lit("c"), F.col("contact_id").cast("string")), F.col("number"))
    sums = events.groupBy("owner_id").agg(F.count("*").alias("events"), F.countDistinct(party).alias("parties"), F.round(F.avg("duration"), 2).alias("mean_duration"), F.max("duration").cast("bigint").alias("longest"))
    day = events.groupBy("owner_id", F.date_format("ts", "yyyy-MM-dd").alias("busiest_day")).agg(F.count("*").alias("n"))
    return sums.join(top_of_group(day, "owner_id", F.desc("n"), F.asc("busiest_day")).select("owner_id", "busiest_day"), "owner_id")


def top_parties(events: DataFrame, n: int = 10) -> DataFrame:
    """The n parties with most events of each owner, with their percentage."""
    p = events.groupBy("owner_id", "number").agg(F.count("*").alias("events"))
    whole = p.groupBy("owner_id").agg(F.sum("events").alias("_all"))
    top = top_of_group(p, "owner_id", F.desc("events"), F.asc("number"), n=n).join(whole, "owner_id")
    return top.select("owner_id", "number", "events", F.round(F.col("events") * 100.0 / F.col("_all"), 2).alias("percent"))


def period_trends(events: DataFrame, period: str) -> DataFrame:
    """By day, week from Sunday, or month: events, calls, sms, distinct contacts."""
    start = {"day": F.to_date("ts"), "week": F.expr("date_sub(to_date(ts), dayofweek(ts) - 1)"), "month": F.trunc(F.to_date("ts"), "month")}[period]
    return events.groupBy("owner_id", F.date_format(start, "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("events"), count_if(is_type("call")).alias("calls"), count_if(is_type("sms")).alias("sms"), F.countDistinct("contact_id").alias("contacts"))


def trend_insights(trends: DataFrame, n: int = 3) -> DataFrame:
    """Preferred medium, peak period, and the mean of the last n periods against the first n (beyond 10 % up or down)."""
    w = Window.partitionBy("owner_id")
    t = trends.withColumn("_up", F.row_number().over(w.orderBy("period"))).withColumn("_down", F.row_number().over(w.orderBy(F.desc("period"))))
    g = t.groupBy("owner_id").agg(
        F.sum("calls").alias("calls"), F.sum("sms").alias("sms"), F.min_by("period", F.struct(-F.col("events"), F.col("period"))).alias("peak"),
        F.avg(F.when(F.col("_up") <= n, F.col("events"))).alias("_first"), F.avg(F.when(F.col("_down") <= n, F.col("events"))).alias("_last"),
    )
    change = F.when(F.col("_last") > F.col("_first") * 1.1, "increasing").when(F.col("_last") < F.col("_first") * 0.9, "decreasing").otherwise("stable")
    return g.select("owner_id", F.when(F.col("calls") >= F.col("sms"), "call").otherwise("sms").alias("medium"), "peak", change.alias("trend"))


def suggestions(contacts: DataFrame, q: str) -> DataFrame:
    """At most 3 contacts by name, and the number itself if it has 3 phone characters or more; at most 5 in all."""
    names = contacts.where(F.col("name").ilike(f"%{q}%")).orderBy("name").limit(3).select(F.col("name").alias("suggestion"), F.lit("contact").alias("kind"))
    if sum(c.isdigit() or c in "+()- " for c in q) >= 3:
        names = names.unionByName(contacts.sparkSession.createDataFrame([(q, "number")], "suggestion string, kind string"))
    return names.limit(5)


def recent_queries(history: DataFrame, n: int = 10) -> DataFrame:
    """Each user's last n distinct queries without regard to case, in their first spelling. ``history``: user_id, query, at."""
    low = F.lower("query")
    q = history.groupBy("user_id", low.alias("k")).agg(F.min_by("query", "at").alias("query"), F.max("at").alias("last_at"))
    return top_of_group(q, "user_id", F.desc("last_at"), F.asc("k"), n=n).select("user_id", "query", "last_at")
