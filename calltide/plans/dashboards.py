"""Queries over the dashboards operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltide.operators import dashboards as D
from calltide.plans.adapter import AS_OF, view, with_views
from calltide.plans.registry import query

NOW = f"TIMESTAMP '{AS_OF}'"
START, END = "2024-01-05 00:00:00", "2024-01-25 23:59:59"
BETWEEN = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
EPOCH = lambda c: f"CAST(epoch({c}) AS BIGINT)"


@query(with_views(f"""
, t AS (SELECT owner_id, count(*) AS total_events, count(*) FILTER (type = 'call') AS total_calls, count(*) FILTER (type = 'sms') AS total_sms,
  count(DISTINCT contact_id) AS unique_contacts, round(avg(duration) FILTER (type = 'call') / 60, 1) AS avg_call_minutes,
  count(*) FILTER (ts >= {NOW} - INTERVAL 30 DAY) AS recent_events FROM comm GROUP BY owner_id),
h AS (SELECT owner_id, hour(ts) AS busiest_hour, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, hour(ts)) AS r FROM comm GROUP BY owner_id, hour(ts)),
c AS (SELECT owner_id, min(number) AS number, count(*) AS n, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, contact_id) AS r FROM comm WHERE contact_id IS NOT NULL GROUP BY owner_id, contact_id)
SELECT t.*, busiest_hour, substr(number, 1, 3) || '-***-' || right(number, 4) AS top_contact, n AS top_contact_events
FROM t LEFT JOIN h ON h.owner_id = t.owner_id AND h.r = 1 LEFT JOIN c ON c.owner_id = t.owner_id AND c.r = 1""", "comm"))
def q01_dashboard_metrics(spark, sf_dir):
    return D.dashboard_metrics(view(spark, sf_dir, "comm"), AS_OF)


@query(with_views("""
, s AS (SELECT org_id, count(*) AS team_size FROM roles GROUP BY org_id),
e AS (SELECT org_id, count(*) AS events, count(*) FILTER (type = 'call') AS calls, count(*) FILTER (type = 'sms') AS sms, count(DISTINCT contact_id) AS contacts, count(DISTINCT owner_id) AS active_members
  FROM comm JOIN roles ON user_id = owner_id GROUP BY org_id)
SELECT * FROM s LEFT JOIN e USING (org_id)""", "comm", "roles"))
def q02_team_metrics(spark, sf_dir):
    return D.team_metrics(view(spark, sf_dir, "comm"), view(spark, sf_dir, "roles"))


@query(with_views("""
, c AS (SELECT owner_id, count(*) AS events, count(DISTINCT contact_id) AS contacts FROM comm GROUP BY owner_id),
b AS (SELECT org_id, user_id, role, coalesce(events, 0) AS events, coalesce(contacts, 0) AS contacts FROM roles LEFT JOIN c ON user_id = owner_id)
SELECT org_id, user_id, role, events, contacts, place FROM (SELECT *, rank() OVER (PARTITION BY org_id ORDER BY events DESC) AS place, row_number() OVER (PARTITION BY org_id ORDER BY events DESC, user_id) AS r FROM b) WHERE r <= 10""", "comm", "roles"))
def q02_team_leaderboard(spark, sf_dir):
    return D.team_leaderboard(view(spark, sf_dir, "comm"), view(spark, sf_dir, "roles"))


GAPS = """, g AS (SELECT owner_id, ts, lag(ts) OVER (PARTITION BY owner_id ORDER BY ts, id) AS b FROM comm),
s AS (SELECT owner_id, CAST(floor(epoch(b)) AS BIGINT) AS gap_start, CAST(floor(epoch(ts)) AS BIGINT) AS gap_end, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(b)) AS BIGINT) AS seconds FROM g WHERE b IS NOT NULL),
f AS (SELECT *, round(seconds / 3600.0, 1) AS hours, CASE WHEN seconds / 3600.0 < 48 THEN 'minor' WHEN seconds / 3600.0 < 168 THEN 'moderate' ELSE 'major' END AS severity,
  row_number() OVER (PARTITION BY owner_id ORDER BY seconds DESC, gap_start) AS r FROM s WHERE {0})
SELECT owner_id, gap_start, gap_end, seconds, hours, severity FROM f WHERE r <= {1}"""


@query(with_views(GAPS.format("seconds / 3600.0 > 1", 20), "comm"))
def q04_data_gaps(spark, sf_dir):
    return D.data_gaps(view(spark, sf_dir, "comm"), 1, top=20)


@query(with_views(GAPS.format("seconds / 3600.0 >= 0.5", 1000000000), "comm"))
def r13_data_gaps_inclusive(spark, sf_dir):
    return D.data_gaps(view(spark, sf_dir, "comm"), 0.5, inclusive=True)


@query(with_views(f"""
, d AS (SELECT owner_id, CAST(ts AS DATE) AS day, count(*) AS n FROM comm WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY day) AS x FROM d)
SELECT owner_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS events, round(avg(n), 2) AS mean_events, round(regr_slope(n, x), 2) + 0.0 AS slope FROM x GROUP BY owner_id""", "comm"))
def q06_communication_trends(spark, sf_dir):
    return D.communication_trends(view(spark, sf_dir, "comm"), AS_OF)


SERIES = """SELECT owner_id, CAST(epoch(date_trunc('{0}', ts)) AS BIGINT) AS period, min({1}) AS label, count(*) AS events, count(*) FILTER (type = 'call') AS calls,
 count(*) FILTER (type = 'sms') AS sms, count(DISTINCT contact_id) AS contacts, round(avg(duration), 2) AS avg_duration FROM comm WHERE {2} GROUP BY 1, 2"""
WEEK_LABEL = "strftime(ts, '%Y') || '-W' || lpad(CAST(CAST(ceil(dayofyear(ts) / 7.0) AS INT) AS VARCHAR), 2, '0')"


@query(with_views(SERIES.format("day", "strftime(ts, '%Y-%m-%d')", BETWEEN), "comm"))
def q07_time_series_daily(spark, sf_dir):
    return D.time_series(view(spark, sf_dir, "comm"), "day", START, END)


@query(with_views(SERIES.format("hour", "strftime(ts, '%Y-%m-%d %H:00')", "true"), "comm"))
def q07_time_series_hourly(spark, sf_dir):
    return D.time_series(view(spark, sf_dir, "comm"), "hour")


@query(with_views(SERIES.format("week", WEEK_LABEL, "true"), "comm"))
def q07_time_series_weekly(spark, sf_dir):
    return D.time_series(view(spark, sf_dir, "comm"), "week")


@query(with_views(", s AS (" + SERIES.format("day", "''", "true") + """)
SELECT owner_id, count(*) AS periods, CAST(sum(events) AS BIGINT) AS total, round(sum(events) / count(*), 2) AS mean_events, (array_agg(period ORDER BY events DESC, period))[1] AS peak_period, max(events) AS peak_events FROM s GROUP BY owner_id""", "comm"))
def q07_time_series_summary(spark, sf_dir):
    return D.series_summary(D.time_series(view(spark, sf_dir, "comm"), "day"))


HEAT = f"""c AS (SELECT owner_id, dayofweek(ts) AS dow, hour(ts) AS hour, count(*) AS events FROM comm WHERE ts >= {NOW} - INTERVAL 90 DAY GROUP BY ALL),
i AS (SELECT *, round(events * 100.0 / max(events) OVER (PARTITION BY owner_id), 1) AS intensity FROM c)"""


@query(with_views(f", {HEAT} SELECT * FROM i", "comm"))
def q08_activity_heatmap(spark, sf_dir):
    return D.activity_heatmap(view(spark, sf_dir, "comm"), AS_OF)


@query(with_views(f""", {HEAT}, o AS (SELECT DISTINCT owner_id FROM comm), s AS (SELECT owner_id, d.r AS dow, h.r AS hour FROM o, range(7) d(r), range(24) h(r))
SELECT owner_id, dow, hour, coalesce(events, 0) AS events, coalesce(intensity, 0.0) AS intensity, events IS NULL AS is_empty FROM s LEFT JOIN i USING (owner_id, dow, hour)""", "comm"))
def q11_dense_heatmap(spark, sf_dir):
    comm = view(spark, sf_dir, "comm")
    return D.dense_heatmap(D.activity_heatmap(comm, AS_OF), comm.select("owner_id").distinct())


BUCKETS = """, c AS (SELECT owner_id, {0} AS bucket, count(*) AS events, count(*) FILTER (type = 'call') AS calls, count(*) FILTER (type = 'sms') AS sms, count(DISTINCT contact_id) AS contacts,
  CAST(coalesce(sum(duration) FILTER (type = 'call'), 0) AS BIGINT) AS call_seconds FROM comm WHERE {1} GROUP BY 1, 2)
SELECT *, round(events / greatest(max(events) OVER (PARTITION BY owner_id), 1), 2) AS intensity FROM c"""


@query(with_views(BUCKETS.format("hour(ts)", BETWEEN), "comm"))
def q09_heatmap_daily(spark, sf_dir):
    return D.heatmap_data(view(spark, sf_dir, "comm"), "daily", START, END)


@query(with_views(BUCKETS.format("dayofweek(ts)", BETWEEN), "comm"))
def q09_heatmap_weekly(spark, sf_dir):
    return D.heatmap_data(view(spark, sf_dir, "comm"), "weekly", START, END)


@query(with_views(BUCKETS.format("dayofmonth(ts)", BETWEEN + " AND type = 'call'"), "comm"))
def q09_heatmap_monthly(spark, sf_dir):
    return D.heatmap_data(view(spark, sf_dir, "comm"), "monthly", START, END, ["call"])


@query(with_views(f"""
, h AS (SELECT owner_id, hour(ts) AS v, count(*) AS n, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, hour(ts)) AS r FROM comm WHERE {BETWEEN} GROUP BY 1, 2),
d AS (SELECT owner_id, dayofweek(ts) AS v, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, dayofweek(ts)) AS r FROM comm WHERE {BETWEEN} GROUP BY 1, 2),
t AS (SELECT owner_id, count(*) AS events FROM comm WHERE {BETWEEN} GROUP BY 1)
SELECT t.owner_id, events, round(events / 20, 2) AS events_a_day, h.v AS peak_hour, d.v AS peak_dow, round(n / events, 3) AS peak_share
FROM t JOIN h ON h.owner_id = t.owner_id AND h.r = 1 JOIN d ON d.owner_id = t.owner_id AND d.r = 1""", "comm"))
def q10_heatmap_summary(spark, sf_dir):
    return D.heatmap_summary(view(spark, sf_dir, "comm"), START, END)


CALLS = f"ts >= {NOW} - INTERVAL 30 DAY AND type = 'call'"


@query(with_views(f"""SELECT owner_id, count(*) AS calls, round(avg(duration), 2) AS mean_duration, round(stddev_samp(duration), 2) AS sd_duration, CAST(min(duration) AS BIGINT) AS shortest,
 CAST(max(duration) AS BIGINT) AS longest, count(*) FILTER (duration > 0) AS answered, count(*) FILTER (direction = 'inbound') AS inbound FROM comm WHERE {CALLS} GROUP BY owner_id""", "comm"))
def q12_call_patterns(spark, sf_dir):
    return D.call_patterns(view(spark, sf_dir, "comm"), AS_OF)


@query(with_views(f"""
, c AS (SELECT owner_id, CASE WHEN duration <= 30 THEN 0 WHEN duration <= 60 THEN 1 WHEN duration <= 180 THEN 2 WHEN duration <= 600 THEN 3 WHEN duration <= 1800 THEN 4 ELSE 5 END AS place, count(*) AS calls
  FROM comm WHERE {CALLS} AND duration IS NOT NULL GROUP BY 1, 2)
SELECT owner_id, CAST(place AS BIGINT) AS place, ['0-30s', '30s-1m', '1-3m', '3-10m', '10-30m', '30m+'][place + 1] AS class, calls, round(calls * 100.0 / sum(calls) OVER (PARTITION BY owner_id), 1) AS percent FROM c""", "comm"))
def q12_duration_classes(spark, sf_dir):
    return D.duration_classes(view(spark, sf_dir, "comm"), AS_OF)


@query(with_views(f"""
SELECT owner_id, place, hour, calls FROM (SELECT owner_id, hour(ts) AS hour, count(*) AS calls, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, hour(ts)) AS place
FROM comm WHERE {CALLS} GROUP BY 1, 2) WHERE place <= 5""", "comm"))
def q12_top_hours(spark, sf_dir):
    return D.top_hours(view(spark, sf_dir, "comm"), AS_OF)
