"""Queries over contacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltide.operators import contacts as C
from calltide.plans.adapter import AS_OF, view, with_views
from calltide.plans.registry import query, table

NOW = f"TIMESTAMP '{AS_OF}'"
S = lambda c: f"CAST(floor(epoch({c})) AS BIGINT)"
MODE = "(SELECT contact_id, h AS peak_hour FROM (SELECT contact_id, hour(ts) AS h, row_number() OVER (PARTITION BY contact_id ORDER BY count(*) DESC, hour(ts)) AS r FROM comm GROUP BY 1, 2) WHERE r = 1)"


@query(with_views(f""", s AS (SELECT contact_id AS id, count(*) AS events, round(avg(duration) FILTER (type = 'call') / 60, 1) AS avg_minutes, count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) AS recent, min({S('ts')}) AS first_at, max({S('ts')}) AS last_at FROM comm WHERE contact_id IS NOT NULL GROUP BY 1)
SELECT id, name, company, coalesce(events, 0) AS events, avg_minutes, coalesce(recent, 0) AS recent, peak_hour, first_at, last_at FROM contacts LEFT JOIN s USING (id) LEFT JOIN {MODE} m ON m.contact_id = id""", "contacts", "comm"))
def q03_contact_profile(spark, sf_dir):
    return C.contact_profile(view(spark, sf_dir, "comm"), view(spark, sf_dir, "contacts"), AS_OF)


@query(with_views("""SELECT l.contact_id, place, id, type, direction, CASE WHEN coalesce(anonymize_content, false) AND content IS NOT NULL THEN '[PRIVATE]' ELSE content END AS content
FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY ts DESC, id) AS place FROM comm WHERE contact_id IS NOT NULL) l LEFT JOIN rules ON rules.contact_id = l.contact_id WHERE place <= 20""", "comm", "rules"))
def q03_recent_events(spark, sf_dir):
    return C.recent_events(view(spark, sf_dir, "comm"), view(spark, sf_dir, "rules"))


@query(with_views(f"""SELECT contact_id, count(*) AS events, count(*) FILTER (type = 'call') AS calls, count(*) FILTER (type = 'sms') AS sms, count(*) FILTER (direction = 'inbound') AS inbound, count(*) FILTER (direction = 'outbound') AS outbound,
 CAST(coalesce(sum(duration), 0) AS BIGINT) AS call_seconds, count(DISTINCT CAST(ts AS DATE)) AS active_days, round(count(*) / greatest(count(DISTINCT CAST(ts AS DATE)), 1), 2) AS events_a_day FROM comm WHERE contact_id IS NOT NULL AND ts >= {NOW} - INTERVAL 90 DAY GROUP BY 1""", "comm"))
def q13_communication_summary(spark, sf_dir):
    return C.communication_summary(view(spark, sf_dir, "comm"), AS_OF)


@query(with_views(f"""SELECT contact_id, day, events, calls FROM (SELECT contact_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (type = 'call') AS calls, row_number() OVER (PARTITION BY contact_id ORDER BY strftime(ts, '%Y-%m-%d') DESC) AS r FROM comm WHERE contact_id IS NOT NULL AND ts >= {NOW} - INTERVAL 90 DAY GROUP BY 1, 2) WHERE r <= 10""", "comm"))
def q13_active_days(spark, sf_dir):
    return C.active_days(view(spark, sf_dir, "comm"), AS_OF, n=10)


@query(with_views(f", e AS (SELECT contact_id, count(*) AS events, CAST(floor((max({S('ts')}) - min({S('ts')})) / 86400) AS BIGINT) AS days_known, count(*) FILTER (direction = 'inbound') AS i FROM comm WHERE contact_id IS NOT NULL GROUP BY 1) SELECT contact_id, events, days_known, round(events / greatest(days_known, 1), 3) AS events_a_day, round(i / greatest(1, events), 3) AS inbound_ratio FROM e", "comm"))
def q14_enhanced_metrics(spark, sf_dir):
    return C.enhanced_metrics(view(spark, sf_dir, "comm"))


@query(with_views("""
, x AS (SELECT contact_id, 'hour' AS kind, hour(ts) AS slot FROM comm WHERE contact_id IS NOT NULL UNION ALL SELECT contact_id, 'dow', dayofweek(ts) FROM comm WHERE contact_id IS NOT NULL UNION ALL SELECT contact_id, 'month', (2024 * 12 + 1) - (year(ts) * 12 + month(ts)) FROM comm WHERE contact_id IS NOT NULL),
n AS (SELECT contact_id, kind, slot, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT 'hour' AS kind, range AS slot FROM range(24) UNION ALL SELECT 'dow', range FROM range(7) UNION ALL SELECT 'month', range FROM range(13))
SELECT contacts.id AS contact_id, k.kind, k.slot, coalesce(n, 0) AS events FROM contacts CROSS JOIN k LEFT JOIN n ON n.contact_id = contacts.id AND n.kind = k.kind AND n.slot = k.slot""", "contacts", "comm"))
def q14_distributions(spark, sf_dir):
    return C.distributions(view(spark, sf_dir, "comm"), view(spark, sf_dir, "contacts"), AS_OF)


@query(with_views(f"SELECT contact_id, direction, type, count(*) AS events, round(avg(duration), 2) AS avg_duration FROM comm WHERE contact_id IS NOT NULL AND ts >= {NOW} - INTERVAL 90 DAY GROUP BY 1, 2, 3", "comm"))
def q15_direction_breakdown(spark, sf_dir):
    return C.direction_breakdown(view(spark, sf_dir, "comm"), AS_OF)


@query(with_views("""
, w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', name, company, tag)), '[^a-z0-9]+'), lambda x: x <> '')) AS words FROM contacts),
s AS (SELECT id, name, number, round(CASE WHEN list_contains(words, 'work') THEN 1.0::DOUBLE / (1 + len(words)) ELSE 0.0 END + CASE WHEN contains(number, 'work') THEN 1.0 ELSE 0.0 END + CASE WHEN lower(tag) = 'work' THEN 0.5 ELSE 0.0 END, 4) AS score FROM w)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 50""", "contacts"))
def q16_search_contacts(spark, sf_dir):
    return C.search_contacts(view(spark, sf_dir, "contacts"), "work")


RANKED = f"""
, a AS (SELECT contact_id AS id, count(*) AS activity, max({S('ts')}) AS last_at FROM comm WHERE contact_id IS NOT NULL GROUP BY 1),
s AS (SELECT contacts.id, name, CASE WHEN coalesce(anonymize_number, false) THEN substr(number, 1, 3) || '-***-' || right(number, 4) ELSE number END AS number, coalesce(activity, 0) AS activity, last_at, round(1.0::DOUBLE * (1 + coalesce(activity, 0) / 1000), 4) AS relevance,
 round(coalesce(activity, 0) * 0.7::DOUBLE + CASE WHEN epoch({NOW}) - last_at <= 7 * 86400 THEN 30 WHEN epoch({NOW}) - last_at <= 30 * 86400 THEN 20 WHEN epoch({NOW}) - last_at <= 90 * 86400 THEN 10 ELSE 0 END, 1) AS score
 FROM contacts LEFT JOIN a USING (id) LEFT JOIN rules ON rules.contact_id = contacts.id WHERE (visibility IS NULL OR visibility <> 'private') AND (name ILIKE '%contact%' OR company ILIKE '%contact%' OR contains(number, 'contact')))
SELECT * FROM s ORDER BY {{0}}, id LIMIT 50"""


@query(with_views(RANKED.format("relevance DESC"), "contacts", "comm", "rules"))
def q17_ranked_contacts(spark, sf_dir):
    return C.ranked_contacts(*(view(spark, sf_dir, v) for v in ("contacts", "comm", "rules")), AS_OF, term="contact")


@query(with_views(RANKED.format("last_at DESC NULLS LAST"), "contacts", "comm", "rules"))
def t02_dynamic_sort(spark, sf_dir):
    return C.ranked_contacts(*(view(spark, sf_dir, v) for v in ("contacts", "comm", "rules")), AS_OF, term="contact", sort="recent")


@query(with_views(f"""SELECT c.contact_id, count(*) AS events, count(*) FILTER (type = 'call') AS calls, count(*) FILTER (type = 'sms') AS sms, round(avg(duration), 2) AS avg_duration, max({S('ts')}) AS last_at, round(count(*) FILTER (direction = 'inbound') / greatest(1, count(*)), 3) AS inbound_ratio, max(peak_hour) AS peak_hour
FROM comm c JOIN {MODE} m ON m.contact_id = c.contact_id GROUP BY 1""", "comm"))
def m01_contact_metrics(spark, sf_dir):
    return C.contact_metrics(view(spark, sf_dir, "comm"))


@query(with_views(f", e AS (SELECT contact_id, count(*) AS events, min({S('ts')}) AS first_at, max({S('ts')}) AS last_at FROM comm WHERE contact_id IS NOT NULL GROUP BY 1), r AS (SELECT *, events / greatest(1.0::DOUBLE, (last_at - first_at) / 604800.0::DOUBLE) AS rate FROM e) SELECT contact_id, events, first_at, last_at, round(rate, 2) AS events_a_week, CASE WHEN rate > 10 THEN 'frequent' WHEN rate > 3 THEN 'regular' WHEN rate > 1 THEN 'occasional' ELSE 'rare' END AS class FROM r", "comm"))
def q19_analyze_contacts(spark, sf_dir):
    return C.analyze_contacts(view(spark, sf_dir, "comm"))


@query(with_views("SELECT contact_id, place, dow, events FROM (SELECT contact_id, dayofweek(ts) AS dow, count(*) AS events, row_number() OVER (PARTITION BY contact_id ORDER BY count(*) DESC, dayofweek(ts)) AS place FROM comm WHERE contact_id IS NOT NULL GROUP BY 1, 2) WHERE place <= 3", "comm"))
def q19_top_weekdays(spark, sf_dir):
    return C.top_weekdays(view(spark, sf_dir, "comm"))


@query(with_views("""
, d AS (SELECT owner_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, strftime(ts, '%Y-%m-%d')) AS r FROM comm GROUP BY 1, 2)
SELECT comm.owner_id, count(*) AS events, count(DISTINCT coalesce('c' || CAST(contact_id AS VARCHAR), number)) AS parties, round(avg(duration), 2) AS mean_duration, CAST(max(duration) AS BIGINT) AS longest, max(day) AS busiest_day FROM comm JOIN d ON d.owner_id = comm.owner_id AND r = 1 GROUP BY 1""", "comm"))
def q18_export_metrics(spark, sf_dir):
    return C.export_metrics(view(spark, sf_dir, "comm"))


@query(with_views("SELECT owner_id, number, events, percent FROM (SELECT owner_id, number, count(*) AS events, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY owner_id), 2) AS percent, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, number) AS r FROM comm GROUP BY 1, 2) WHERE r <= 10", "comm"))
def q18_top_parties(spark, sf_dir):
    return C.top_parties(view(spark, sf_dir, "comm"))


TRENDS = "SELECT owner_id, strftime({0}, '%Y-%m-%d') AS period, count(*) AS events, count(*) FILTER (type = 'call') AS calls, count(*) FILTER (type = 'sms') AS sms, count(DISTINCT contact_id) AS contacts FROM comm GROUP BY 1, 2"


@query(with_views(TRENDS.format("CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT)"), "comm"))
def q20_weekly_trends(spark, sf_dir):
    return C.period_trends(view(spark, sf_dir, "comm"), "week")


@query(with_views(TRENDS.format("date_trunc('month', ts)"), "comm"))
def q20_monthly_trends(spark, sf_dir):
    return C.period_trends(view(spark, sf_dir, "comm"), "month")


@query(with_views(", t AS (" + TRENDS.format("ts") + """), r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY period) AS u, row_number() OVER (PARTITION BY owner_id ORDER BY period DESC) AS d FROM t),
g AS (SELECT owner_id, sum(calls) AS calls, sum(sms) AS sms, (array_agg(period ORDER BY events DESC, period))[1] AS peak, avg(events) FILTER (u <= 3) AS a, avg(events) FILTER (d <= 3) AS b FROM r GROUP BY 1)
SELECT owner_id, CASE WHEN calls >= sms THEN 'call' ELSE 'sms' END AS medium, peak, CASE WHEN b > a * 1.1 THEN 'increasing' WHEN b < a * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM g""", "comm"))
def q21_trend_insights(spark, sf_dir):
    return C.trend_insights(C.period_trends(view(spark, sf_dir, "comm"), "day"))


@query(with_views("SELECT id, name, company, last_seen_s, events FROM (SELECT id, name, company, CAST(floor(epoch(last_seen)) AS BIGINT) AS last_seen_s, total_calls + total_sms AS events FROM contacts WHERE (name ILIKE '%1%' OR company ILIKE '%1%' OR number LIKE '%1%' OR tag ILIKE '%1%') AND tag IN ('friend')) ORDER BY events DESC, id LIMIT 20 OFFSET 5", "contacts"))
def q36_contact_list(spark, sf_dir):
    c = view(spark, sf_dir, "contacts").withColumn("last_seen_s", F.unix_timestamp(F.col("last_seen").cast("timestamp"))).withColumn("events", F.col("total_calls") + F.col("total_sms"))
    hit = F.col("name").ilike("%1%") | F.col("company").ilike("%1%") | F.col("number").like("%1%") | F.col("tag").ilike("%1%")
    return c.where(hit & F.col("tag").isin("friend")).select("id", "name", "company", "last_seen_s", "events").orderBy(F.desc("events"), "id").offset(5).limit(20)


@query(with_views("SELECT * FROM (SELECT name AS suggestion, 'contact' AS kind FROM contacts WHERE name ILIKE '%120%' ORDER BY name LIMIT 3) UNION ALL SELECT '120', 'number'", "contacts"))
def q37_suggestions(spark, sf_dir):
    return C.suggestions(view(spark, sf_dir, "contacts"), "120")


@query("""WITH h AS (SELECT conv_id AS user_id, text AS query, turn AS pos FROM conversations WHERE text IS NOT NULL), g AS (SELECT user_id, lower(query) AS k, arg_min(query, pos) AS query, max(pos) AS last_at FROM h GROUP BY 1, 2)
SELECT user_id, query, last_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, k) AS r FROM g) WHERE r <= 3""")
def q38_recent_queries(spark, sf_dir):
    h = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("user_id"), F.col("text").alias("query"), F.col("turn").alias("at"))
    return C.recent_queries(h, 3)
