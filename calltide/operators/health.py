"""Sync metrics, drift, trends, health scores and rules, queues, jobs, errors, and audit statistics.

Windows of time are cut by comparison with ``as_of``: each report is one scan with conditional aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.dashboards import count_if, moment, top_of_group
from calltide.operators.windows import sliced


def ago(as_of: str, days: float) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL '{int(days * 86_400)}' SECOND")


def rounded(c: Column | str, places: int) -> Column:
    """A double rounded as doubles are in SQL engines: scaled, rounded, scaled back. Spark's own takes a mean that prints as x.xx5 for a tie."""
    scale = 10.0**places
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def pct(q: float, c: str) -> Column:
    return F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY {c}) AS BIGINT)")


def sync_performance(syncs: DataFrame, *by: str) -> DataFrame:
    """Mean and nearest-rank percentiles of latency, items a second, bytes a second, success and failure rates, queue growth."""
    s = F.sum("duration_ms") / 1000.0
    return syncs.groupBy(*by).agg(
        F.count("*").alias("syncs"), rounded(F.avg("duration_ms"), 2).alias("mean_ms"), pct(0.5, "duration_ms").alias("p50"), pct(0.95, "duration_ms").alias("p95"), pct(0.99, "duration_ms").alias("p99"),
        rounded(F.sum("processed_items") / s, 4).alias("items_a_second"), rounded(F.sum("bytes_transferred") / s, 2).alias("bytes_a_second"), rounded(count_if(F.col("success")) / F.count("*"), 4).alias("success_rate"),
        rounded(F.sum("failed_items") / F.greatest(F.sum("processed_items"), F.lit(1)), 4).alias("error_rate"), F.sum(F.col("queue_after") - F.col("queue_before")).alias("queue_growth"),
    )


def network_metrics(syncs: DataFrame) -> DataFrame:
    return syncs.groupBy("network_type").agg(F.count("*").alias("syncs"), count_if(~F.col("success")).alias("failures"), rounded(F.avg("bytes_transferred"), 2).alias("mean_bytes"))


def disconnections(syncs: DataFrame) -> DataFrame:
    """How often the network went from some type to none, by day; order is kept within a day."""
    s = syncs.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "id", "network_type")
    rows, w, own = sliced(s, ["day"], ["ts", "id"], F.hour("ts"))
    return rows.withColumn("_before", F.lag("network_type").over(w)).where(own).groupBy("day").agg(count_if((F.col("network_type") == "none") & (F.col("_before") != "none")).alias("disconnections"), F.count("*").alias("syncs"))


def data_drift(syncs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The last window against the one before, by network: intervals between syncs (ms), items a sync (processed and failed), and success in percent.

    ``temporal_variance`` and ``data_variance`` are relative changes (null over nothing), ``degradation`` the success before less
    that of the last window, in points. A network without syncs in either window has zeros. The mean of the intervals between
    consecutive syncs is the whole span over their number, so no order is needed.
    """
    recent, before = F.col("ts") >= ago(as_of, days), (F.col("ts") >= ago(as_of, 2 * days)) & (F.col("ts") < ago(as_of, days))
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0

    def parts(p: Column, tag: str) -> list[Column]:
        span = F.max(F.when(p, ms)) - F.min(F.when(p, ms))
        n = count_if(p)
        return [
            n.alias(f"n{tag}"), F.when(n > 1, span / (n - 1)).otherwise(0.0).alias(f"i{tag}"), F.avg(F.when(p, F.col("processed_items") + F.col("failed_items"))).alias(f"t{tag}"),
            (count_if(p & F.col("success")) * 100.0 / F.nullif(n, F.lit(0))).alias(f"s{tag}"),
        ]

    g = syncs.where(recent | before).groupBy("network_type").agg(*parts(recent, "1"), *parts(before, "0"))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    of = lambda c: F.when(both, c).otherwise(0.0)
    change = lambda a, b: F.when(~both, 0.0).otherwise(F.abs(F.col(a) - F.col(b)) / F.nullif(F.col(b), F.lit(0.0)))
    return g.select(
        "network_type", rounded(of(F.col("i0")), 2).alias("expected_interval"), rounded(of(F.col("i1")), 2).alias("actual_interval"), rounded(change("i1", "i0"), 4).alias("temporal_variance"),
        rounded(of(F.col("t0")), 4).alias("expected_throughput"), rounded(of(F.col("t1")), 4).alias("actual_throughput"), rounded(change("t1", "t0"), 4).alias("data_variance"),
        rounded(of(F.col("s0")), 4).alias("baseline_success"), rounded(of(F.col("s1")), 4).alias("current_success"), rounded(of(F.col("s0") - F.col("s1")), 4).alias("degradation"),
    )


def performance_trend(syncs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The later half of a window against the earlier: latency and items a second beyond 20 %, success beyond 5 points.

    Items a second are the mean over syncs that took any time. Over nothing, a trend is stable.
    """
    middle = ago(as_of, days / 2)
    s = syncs.where(F.col("ts") >= ago(as_of, days))
    half = lambda late, c: F.avg(F.when((F.col("ts") >= middle) if late else (F.col("ts") < middle), c))
    ok = F.col("success").cast("double") * 100
    speed = F.when(F.col("duration_ms") > 0, (F.col("processed_items") + F.col("failed_items")) / (F.col("duration_ms") / 1000.0))
    g = s.groupBy("network_type").agg(*(half(late, c).alias(f"{n}{int(late)}") for n, c in (("l", F.col("duration_ms")), ("s", ok), ("t", speed)) for late in (False, True)))
    change = lambda n: (F.col(f"{n}1") - F.col(f"{n}0")) / F.nullif(F.col(f"{n}0"), F.lit(0.0)) * 100
    latency = F.when(change("l") > 20, "degrading").when(change("l") < -20, "improving").otherwise("stable")
    throughput = F.when(change("t") < -20, "degrading").when(change("t") > 20, "improving").otherwise("stable")
    points = F.col("s1") - F.col("s0")
    success = F.when(points < -5, "degrading").when(points > 5, "improving").otherwise("stable")
    return g.select(
        "network_type", rounded("l0", 2).alias("latency_before"), rounded("l1", 2).alias("latency_after"), latency.alias("latency_trend"),
        rounded("t0", 4).alias("throughput_before"), rounded("t1", 4).alias("throughput_after"), throughput.alias("throughput_trend"), success.alias("success_trend"),
    )


#: Alert thresholds of sync health; latency in ms, the others as in the status.
ALERTS = {"queue_depth": 1000.0, "drift_percentage": 10.0, "sync_latency": 30_000.0, "success_rate": 80.0}
#: What an active issue costs by severity.
ISSUE_COST = {"critical": 15, "high": 10, "medium": 5, "low": 2}


def sync_issues(status: DataFrame) -> DataFrame:
    """Adds issues: kind and severity of each threshold that a status has passed (see :func:`health_score` for its columns)."""
    tests = [("queue_backup", "high", F.col("queue_depth") > ALERTS["queue_depth"]), ("data_gap", "medium", F.col("drift_percentage") > ALERTS["drift_percentage"]), ("performance_degradation", "high", F.col("success_rate") < ALERTS["success_rate"]), ("network_issue", "high", F.col("network_status") == "disconnected")]
    found = F.array(*(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("severity"))) for kind, level, test in tests))
    return status.withColumn("issues", F.filter(found, lambda i: i.isNotNull()))


def health_score(status: DataFrame) -> DataFrame:
    """``score``, 0 to 100: 100 less what queue, drift, latency, failures, network, issues and data quality cost.

    ``status`` has queue_depth, drift_percentage, sync_latency (ms), success_rate and data_quality (0 to 100), network_status
    (connected, limited or disconnected) and issues (as :func:`sync_issues` adds them). Penalties are in proportion to ``ALERTS``.
    """
    part = lambda c, most: F.when(F.col(c) > 0, F.least(F.lit(most), F.col(c) / ALERTS[c] * most)).otherwise(0.0)
    late = F.col("sync_latency") - ALERTS["sync_latency"]
    latency = F.when(late > 0, F.least(F.lit(20.0), late / ALERTS["sync_latency"] * 20)).otherwise(0.0)
    below = lambda c, cost: F.when(F.col(c) < 100, (100 - F.col(c)) * cost).otherwise(0.0)
    network = F.when(F.col("network_status") == "limited", 5.0).when(F.col("network_status") == "disconnected", 10.0).otherwise(0.0)
    of = F.create_map(*(x for s, n in ISSUE_COST.items() for x in (F.lit(s), F.lit(float(n)))))
    issues = F.aggregate("issues", F.lit(0.0), lambda a, i: a + F.coalesce(of[i["severity"]], F.lit(0.0)))
    score = 100.0 - part("queue_depth", 30.0) - part("drift_percentage", 20.0) - latency - below("success_rate", 0.3) - network - issues - below("data_quality", 0.15)
    return status.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(score + 0.5))).cast("bigint"))


def sync_status(syncs: DataFrame, *by: str) -> DataFrame:
    """The status of syncs that :func:`health_score` takes: the mean queue, failed items as drift, mean latency, successes, network."""
    network = F.when(F.col("network_type") == "wifi", "connected").when(F.col("network_type") == "cellular", "limited").otherwise("disconnected")
    failed = F.sum("failed_items") / F.greatest(F.sum("processed_items"), F.lit(1)) * 100
    return syncs.groupBy(*by, network.alias("network_status")).agg(
        rounded(F.avg("queue_after"), 4).alias("queue_depth"), rounded(failed, 4).alias("drift_percentage"), rounded(F.avg("duration_ms"), 2).alias("sync_latency"),
        rounded(count_if(F.col("success")) / F.count("*") * 100, 4).alias("success_rate"), rounded(100 - failed, 4).alias("data_quality"),
    )


#: Health rules: name, category, severity, measure, whether it must stay above, threshold.
HEALTH_RULES = [
    ("sync_latency_high", "sync_performance", "medium", "latency_ms", False, 30_000.0), ("sync_success_rate_low", "sync_performance", "high", "success_rate", True, 90.0), ("queue_depth_high", "sync_performance", "medium", "queue_depth", False, 1000.0),
    ("data_drift_high", "data_quality", "medium", "drift", False, 15.0), ("network_connectivity_poor", "network_health", "low", "poor_network", False, 20.0), ("battery_usage_high", "resource_usage", "low", "battery", False, 5.0),
]
#: How much a rule of each severity weighs.
SEVERITY_WEIGHT = {"low": 1, "medium": 2, "high": 4, "critical": 8}


def health_context(syncs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """What the rules look at, by network: mean latency, success in percent, the last queue, the largest drift, connection and battery.

    Drift is the largest of both variances in percent and the absolute degradation. Battery is a hundred-thousandth of the CPU
    time, at most 100, estimated as 100 ln(items + 1) and a tenth of the duration for each sync. ``network_strength``, where the
    syncs have it, makes a cellular connection under 3 poor.
    """
    last = lambda c: F.max_by(c, F.struct("ts", "id"))
    strength = last("network_strength") if "network_strength" in syncs.columns else F.lit(None).cast("double")
    cpu = F.sum(F.log(F.col("processed_items") + 1.0) * 100 + F.col("duration_ms") * 0.1)
    g = syncs.groupBy("network_type").agg(
        F.avg("duration_ms").alias("latency_ms"), (count_if(F.col("success")) * 100.0 / F.count("*")).alias("success_rate"), last("queue_after").cast("double").alias("queue_depth"),
        F.least(F.lit(100.0), cpu / 100_000).alias("battery"), strength.cast("double").alias("_strength"),
    )
    poor = (F.col("network_type") == "none") | ((F.col("network_type") == "cellular") & F.coalesce((F.col("_strength") > 0) & (F.col("_strength") < 3), F.lit(False)))
    drift = data_drift(syncs, as_of, days).select("network_type", F.greatest(F.col("temporal_variance") * 100, F.col("data_variance") * 100, F.abs("degradation")).alias("drift"))
    out = g.join(drift, "network_type", "left").withColumn("poor_network", F.when(poor, 100.0).otherwise(0.0))
    return out.select("network_type", *(rounded(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("latency_ms", "success_rate", "queue_depth", "drift", "poor_network", "battery")))


def health_rules(context: DataFrame) -> DataFrame:
    """A row for each rule and network: category, severity, value, and whether the rule holds."""
    rules = F.array(*(
        F.struct(F.lit(n).alias("rule"), F.lit(kind).alias("category"), F.lit(level).alias("severity"), F.col(c).cast("double").alias("value"), (F.col(c) >= limit if above else F.col(c) <= limit).alias("holds")) for n, kind, level, c, above, limit in HEALTH_RULES
    ))
    return context.select("network_type", F.explode(rules).alias("r")).select("network_type", "r.*")


def weighted_health(rules: DataFrame) -> DataFrame:
    """``health``: the weight of the rules that hold in percent of all weights, rounded to a whole; and each category's share of rules that hold."""
    weight = reduce(lambda w, k: w.when(F.col("severity") == k, SEVERITY_WEIGHT[k]), SEVERITY_WEIGHT, F.when(F.lit(False), 0))
    share = F.floor(F.sum(F.when(F.col("holds"), weight).otherwise(0)) * 100.0 / F.sum(weight) + 0.5).cast("bigint")
    of = lambda kind: rounded(F.avg(F.when(F.col("category") == kind, F.col("holds").cast("double"))) * 100, 4).alias(kind)
    return rules.groupBy("network_type").agg(share.alias("health"), count_if(~F.col("holds")).alias("broken"), *(of(k) for k in dict.fromkeys(kind for _, kind, *_ in HEALTH_RULES)))


def metric_trend(syncs: DataFrame) -> DataFrame:
    """Slope of daily mean latency as a percentage of its mean; beyond 5 % rising or falling."""
    d = syncs.groupBy("network_type", F.to_date("ts").alias("day")).agg(F.avg("duration_ms").alias("v"))
    d = d.withColumn("x", F.row_number().over(Window.partitionBy("network_type").orderBy("day")))
    g = d.groupBy("network_type").agg(F.regr_slope("v", "x").alias("slope"), F.avg("v").alias("mean"))
    p = F.col("slope") / F.col("mean") * 100
    return g.select("network_type", rounded(p, 3).alias("percent"), F.when(p > 5, "up").when(p < -5, "down").otherwise("stable").alias("trend"))


def performance_summary(syncs: DataFrame, target_ms: float) -> DataFrame:
    """Mean and largest latency against a target; a warning above 80 % of it."""
    g = syncs.groupBy("network_type").agg(rounded(F.avg("duration_ms"), 2).alias("mean_ms"), F.max("duration_ms").alias("max_ms"), count_if(F.col("duration_ms") > target_ms).alias("over"))
    return g.withColumn("status", F.when(F.col("mean_ms") > target_ms, "fail").when(F.col("mean_ms") > 0.8 * target_ms, "warning").otherwise("pass"))


def growth_and_spikes(syncs: DataFrame, last: int = 20, factor: float = 1.5) -> DataFrame:
    """Of each network: growth of the queue over the last samples by the minute with its class, and samples over 1.5 x the mean of the 4 before."""
    rows, w, own = sliced(syncs.select("network_type", "ts", "id", "queue_after"), ["network_type"], ["ts", "id"], F.to_date("ts"), 4)
    s = rows.select("*", F.avg("queue_after").over(w.rowsBetween(-4, -1)).alias("before"), F.count("*").over(w.rowsBetween(-4, -1)).alias("n")).where(own)
    spikes = s.groupBy("network_type").agg(count_if((F.col("n") == 4) & (F.col("queue_after") > F.col("before") * factor)).alias("spikes"))
    recent = top_of_group(syncs.select("network_type", "ts", "id", "queue_after"), "network_type", F.desc("ts"), F.desc("id"), n=last)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    g = recent.groupBy("network_type").agg(F.min_by("queue_after", F.struct(t, "id")).alias("a"), F.max_by("queue_after", F.struct(t, "id")).alias("b"), ((F.max(t) - F.min(t)) / 60e6).alias("minutes"))
    rate = (F.col("b") - F.col("a")) / F.col("minutes")
    g = g.select("network_type", rounded(rate, 4).alias("growth"), F.when(rate > 2, "high").when(rate > 1, "medium").when(rate > 0.5, "low").otherwise("none").alias("severity"))
    return g.join(spikes, "network_type")


def sync_report(syncs: DataFrame, as_of: str) -> DataFrame:
    """Of each source: last sync, events of the last day, queue, status (a week without syncs is an error); and the worst overall."""
    age = (F.unix_timestamp(moment(as_of).cast("timestamp")) - F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))) / 3600.0
    g = syncs.groupBy("network_type").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last_sync"), count_if(F.col("ts") >= ago(as_of, 1)).alias("recent"), F.max_by("queue_after", F.struct("ts", "id")).alias("queue"), F.when(age > 168, 3).when(age > 24, 2).otherwise(1).alias("level"))
    return g.select("network_type", "last_sync", "recent", "queue", F.when(F.col("level") == 3, "error").when(F.col("level") == 2, "warning").otherwise("healthy").alias("status"))


#: Order of priorities and what a queue item's class waits for.
PRIORITY = {"critical": 0, "high": 1, "normal": 2, "low": 3}


def queue_order(items: DataFrame, limit: int) -> DataFrame:
    """The next items by priority and then age. ``items``: id, priority, created."""
    weight = reduce(lambda rest, p: F.when(F.col("priority") == p, PRIORITY[p]).otherwise(rest), PRIORITY, F.lit(9))
    return items.orderBy(weight, "created", "id").limit(limit)


def queue_stats(items: DataFrame, as_of_s: int) -> DataFrame:
    """Items by status and priority with oldest and mean age."""
    age = F.lit(as_of_s) - F.col("created")
    return items.groupBy("status", "priority").agg(F.count("*").alias("items"), F.max(age).alias("oldest"), rounded(F.avg(age), 1).alias("mean_age"))


def queue_health(items: DataFrame) -> DataFrame:
    g = items.agg(F.count("*").alias("items"), count_if(F.col("status") == "failed").alias("failed"))
    share = F.col("failed") / F.greatest("items", F.lit(1))
    return g.withColumn("status", F.when((share > 0.5) | (F.col("items") > 100_000), "critical").when((share > 0.2) | (F.col("items") > 10_000), "warning").otherwise("healthy"))


#: Words that tell the class of an error, in order; whether it is tried again.
ERROR_CLASSES = [("timeout", ["timeout", "timed out"], True), ("network", ["connection", "network", "dns"], True), ("database", ["database", "deadlock", "sql"], True), ("memory", ["memory", "oom"], True), ("validation", ["invalid", "validation", "missing"], False), ("format", ["parse", "format", "encoding"], False), ("permission", ["permission", "denied", "unauthorized"], False)]


def error_class(message: Column) -> Column:
    low = F.lower(message)
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return reduce(lambda rest, c: F.when(has(c[1]), c[0]).otherwise(rest), reversed(ERROR_CLASSES), F.lit("unknown"))


def retried(cls: Column) -> Column:
    return cls.isin([n for n, _, again in ERROR_CLASSES if again])


def dead_letters(errors: DataFrame) -> DataFrame:
    """Errors by day and class. ``errors``: at (timestamp), message."""
    e = errors.select(F.date_format("at", "yyyy-MM-dd").alias("day"), error_class(F.col("message")).alias("class"))
    return e.groupBy("day", "class").agg(F.count("*").alias("errors")).withColumn("retried", retried(F.col("class")))


def job_stats(jobs: DataFrame, *by: str) -> DataFrame:
    """Jobs by state with mean seconds and rows a second. ``jobs``: status, seconds, rows, and what ``by`` names."""
    return jobs.groupBy(*by).agg(
        F.count("*").alias("jobs"), count_if(F.col("status") == "completed").alias("completed"), count_if(F.col("status") == "failed").alias("failed"), count_if(F.col("status").isin("pending", "queued")).alias("queued"),
        rounded(F.avg(F.when(F.col("status") == "completed", F.col("seconds"))), 2).alias("mean_seconds"), rounded(F.sum("rows") / F.greatest(F.sum("seconds"), F.lit(1)), 2).alias("rows_a_second"),
    )


def trailing_weeks(rows: DataFrame, as_of: str, value: str, weeks: int = 4) -> DataFrame:
    """Mean of a value in each of the trailing 7-day windows (0 is the last)."""
    week = F.floor((F.unix_timestamp(moment(as_of).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / (7 * 86_400))
    return rows.where((F.col("ts") >= ago(as_of, 7 * weeks)) & (F.col("ts") < moment(as_of))).groupBy(week.alias("week")).agg(F.count("*").alias("n"), rounded(F.avg(value), 3).alias("mean"))


def audit_search(audit: DataFrame, as_of: str, actor: int | None = None, category: str | None = None, outcome: str | None = None, days: int | None = None, limit: int = 100) -> DataFrame:
    """The newest entries that fit; every filter is optional."""
    tests = [None if actor is None else F.col("actor_id") == actor, None if category is None else F.col("category") == category, None if outcome is None else F.col("outcome") == outcome, None if days is None else F.col("ts") >= ago(as_of, days)]
    a = reduce(lambda d, t: d if t is None else d.where(t), tests, audit)
    return a.orderBy(F.desc("ts"), "id").limit(limit)


#: Fixed value: addresses of private networks.
PRIVATE_ADDRESS = r"^(10\.|172\.(1[6-9]|2[0-9]|3[0-1])\.|192\.168\.|127\.)"


def risk_score(outcome: Column, action: Column, address: Column) -> Column:
    """0 to 100: 40, 60 or 20 for a failure, a block or a warning, 20 for a failed login, 30 for an address outside private networks."""
    base = F.when(outcome == "failure", 40).when(outcome == "blocked", 60).when(outcome == "warning", 20).otherwise(0)
    login = F.when(F.coalesce(action.contains("login"), F.lit(False)) & (outcome == "failure"), 20).otherwise(0)
    outside = F.when((address != "") & ~address.rlike(PRIVATE_ADDRESS), 30).otherwise(0)
    return F.least(F.lit(100), base + login + outside).cast("bigint")


def severity(risk: Column) -> Column:
    return F.when(risk >= 75, "critical").when(risk >= 50, "high").when(risk >= 25, "medium").otherwise("low")


def audit_statistics(audit: DataFrame) -> DataFrame:
    """Entries, failures, actors and mean risk by category and severity."""
    risk = risk_score(F.col("outcome"), F.col("action"), F.col("ip_address"))
    a = audit.withColumn("risk", risk).withColumn("severity", severity(risk))
    return a.groupBy("category", "severity").agg(F.count("*").alias("entries"), count_if(F.col("outcome") == "failure").alias("failures"), F.countDistinct("actor_id").alias("actors"), rounded(F.avg("risk"), 2).alias("mean_risk"))


def anomalies(
    audit: DataFrame, as_of: str, minutes: int = 15, per_ip: int = 5, per_actor: int = 3, per_hour: int = 100, bulk: int = 1000, failed_share: float = 0.5, failed_of: int = 100, private_access: DataFrame | None = None
) -> DataFrame:
    """Failed logins by address and by actor, volume by actor and hour, access off hours, bulk operations, bulk operations that mostly
    fail, and private contacts reached from another organisation; one row for each finding.

    ``error_count`` of the audit, where it has one, counts failures of a bulk operation: more than ``failed_share`` of over
    ``failed_of`` resources. ``private_access`` has the ids of entries that reached what they mustn't, as
    ``policies.cross_org_access`` finds them.
    """
    window = F.col("ts") >= moment(as_of) - F.expr(f"INTERVAL '{minutes}' MINUTE")
    failed = audit.where(window & (F.col("category") == "authentication") & (F.col("outcome") == "failure"))
    row = lambda df, kind, key, level: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("subject"), F.col("n"), F.lit(level).alias("level"))
    parts = [
        row(failed.groupBy("ip_address").agg(F.count("*").alias("n")).where(F.col("n") >= per_ip), "failed_logins_ip", "ip_address", "high"),
        row(failed.groupBy("actor_id").agg(F.count("*").alias("n")).where(F.col("n") >= per_actor), "failed_logins_actor", "actor_id", "medium"),
        row(audit.where(window).groupBy("actor_id", F.date_trunc("hour", "ts")).agg(F.count("*").alias("n")).groupBy("actor_id").agg(F.max("n").alias("n")).where(F.col("n") > per_hour), "volume", "actor_id", "medium"),
        row(audit.where(window & F.col("category").isin("data_access", "data_export") & ((F.hour("ts") < 6) | (F.hour("ts") >= 22))).groupBy("actor_id").agg(F.count("*").alias("n")), "off_hours", "actor_id", "low"),
        row(audit.where(window & (F.col("resource_count") > bulk)).groupBy("actor_id").agg(F.count("*").alias("n")), "bulk", "actor_id", "high"),
    ]
    if "error_count" in audit.columns:
        failing = (F.col("resource_count") > failed_of) & (F.col("error_count") > failed_share * F.col("resource_count"))
        parts.append(row(audit.where(window & failing).groupBy("actor_id").agg(F.count("*").alias("n")), "bulk_failures", "actor_id", "medium"))
    if private_access is not None:
        reached = audit.where(window & (F.col("category") == "data_access")).join(private_access.select("id").distinct(), "id", "left_semi")
        parts.append(row(reached.groupBy("actor_id").agg(F.count("*").alias("n")), "privacy_violation", "actor_id", "high"))
    return reduce(DataFrame.unionByName, parts)


def chained(entries: DataFrame) -> DataFrame:
    """Gives each actor's entries (in order of seq) previous_hash and checksum: SHA-256 of the entry and the checksum before.

    A chain is sequential by its nature: an actor's entries are one group, streamed through in order and never held whole.
    """
    import hashlib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actor, last, first = None, "", True
        for b in batches:
            before, sums = [], []
            for a, body in zip(b.column("actor_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                if first or a != actor:
                    actor, last, first = a, "", False
                before.append(last)
                last = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
                sums.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(sums, pa.string())], names=[*b.schema.names, "previous_hash", "checksum"])

    e = entries.select("actor_id", "seq", "body").repartition("actor_id").sortWithinPartitions("actor_id", "seq")
    kinds = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    return e.mapInArrow(run, kinds + ", previous_hash string, checksum string")


def broken_links(chain: DataFrame) -> DataFrame:
    """Entries whose previous_hash isn't the checksum before them, or whose checksum doesn't follow from their body."""
    w = Window.partitionBy("actor_id").orderBy("seq")
    c = chain.withColumn("_before", F.coalesce(F.lag("checksum").over(w), F.lit("")))
    link, sum_ = F.col("previous_hash") != F.col("_before"), F.col("checksum") != F.sha2(F.concat_ws("|", "previous_hash", "body"), 256)
    return c.where(link | sum_).select("actor_id", "seq", F.when(link & sum_, "both").when(link, "link").otherwise("checksum").alias("fault"))


def retention(df: DataFrame, as_of: str, days: int, keep: Column | None = None) -> DataFrame:
    """Rows to keep: younger than ``days``, or held by ``keep``."""
    young = F.col("ts") >= ago(as_of, days)
    return df.where(young if keep is None else young | keep)


def anonymize_user(events: DataFrame, user: int, before: str) -> DataFrame:
    """The log with one user's rows before a moment stripped of number and content."""
    gone = (F.col("owner_id") == user) & (F.col("ts") < moment(before))
    return events.withColumn("number", F.when(gone, F.lit("ANONYMIZED")).otherwise(F.col("number"))).withColumn("content", F.when(gone, F.lit(None)).otherwise(F.col("content")))
