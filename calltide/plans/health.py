"""Queries over sync health, audit and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltide.operators import health as H
from calltide.operators import policies
from calltide.operators.dashboards import count_if
from calltide.plans.adapter import AS_OF, view, with_views
from calltide.plans.registry import query, table

NOW = f"TIMESTAMP '{AS_OF}'"
PERF = """SELECT network_type, count(*) AS syncs, round(avg(duration_ms), 2) AS mean_ms, percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_ms) AS p99,
 round(sum(processed_items) / (sum(duration_ms) / 1000.0::DOUBLE), 4) AS items_a_second, round(sum(bytes_transferred) / (sum(duration_ms) / 1000.0::DOUBLE), 2) AS bytes_a_second, round(count(*) FILTER (success) / count(*), 4) AS success_rate, round(sum(failed_items) / greatest(sum(processed_items), 1), 4) AS error_rate, CAST(sum(queue_after - queue_before) AS BIGINT) AS queue_growth FROM syncs GROUP BY 1"""


@query(with_views(PERF, "syncs"))
def q22_sync_performance(spark, sf_dir):
    return H.sync_performance(view(spark, sf_dir, "syncs"), "network_type")


@query(with_views("SELECT network_type, count(*) AS syncs, count(*) FILTER (NOT success) AS failures, round(avg(bytes_transferred), 2) AS mean_bytes FROM syncs GROUP BY 1", "syncs"))
def q23_network_metrics(spark, sf_dir):
    return H.network_metrics(view(spark, sf_dir, "syncs"))


@query(with_views("SELECT day, count(*) FILTER (network_type = 'none' AND b <> 'none') AS disconnections, count(*) AS syncs FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, network_type, lag(network_type) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, id) AS b FROM syncs) GROUP BY 1", "syncs"))
def q23_disconnections(spark, sf_dir):
    return H.disconnections(view(spark, sf_dir, "syncs"))


DRIFT = f"""g AS (SELECT network_type, count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) AS n1, CASE WHEN count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) > 1 THEN (epoch_us(max(ts) FILTER (ts >= {NOW} - INTERVAL 7 DAY)) - epoch_us(min(ts) FILTER (ts >= {NOW} - INTERVAL 7 DAY))) / 1000.0::DOUBLE / (count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) - 1) ELSE 0 END AS i1, avg(processed_items + failed_items) FILTER (ts >= {NOW} - INTERVAL 7 DAY) AS t1, count(*) FILTER (success AND ts >= {NOW} - INTERVAL 7 DAY) * 100.0::DOUBLE / count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) AS s1,
 count(*) FILTER (ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY) AS n0, CASE WHEN count(*) FILTER (ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY) > 1 THEN (epoch_us(max(ts) FILTER (ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY)) - epoch_us(min(ts) FILTER (ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY))) / 1000.0::DOUBLE / (count(*) FILTER (ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY) - 1) ELSE 0 END AS i0, avg(processed_items + failed_items) FILTER (ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY) AS t0, count(*) FILTER (success AND ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY) * 100.0::DOUBLE / count(*) FILTER (ts >= {NOW} - INTERVAL 14 DAY AND ts < {NOW} - INTERVAL 7 DAY) AS s0 FROM syncs WHERE ts >= {NOW} - INTERVAL 14 DAY GROUP BY 1),
drift AS (SELECT network_type, round(i0, 2) AS expected_interval, round(i1, 2) AS actual_interval, round(abs(i1 - i0) / i0, 4) AS temporal_variance, round(t0, 4) AS expected_throughput, round(t1, 4) AS actual_throughput, round(abs(t1 - t0) / t0, 4) AS data_variance,
 round(s0, 4) AS baseline_success, round(s1, 4) AS current_success, round(s0 - s1, 4) AS degradation FROM g)"""


@query(with_views(f", {DRIFT} SELECT * FROM drift", "syncs"))
def q24_data_drift(spark, sf_dir):
    return H.data_drift(view(spark, sf_dir, "syncs"), AS_OF)


@query(with_views(f"""
, g AS (SELECT network_type, avg(duration_ms) FILTER (NOT late) AS l0, avg(duration_ms) FILTER (late) AS l1, avg(CAST(success AS INT)) FILTER (NOT late) * 100 AS s0, avg(CAST(success AS INT)) FILTER (late) * 100 AS s1, avg((processed_items + failed_items) / (duration_ms / 1000.0::DOUBLE)) FILTER (NOT late AND duration_ms > 0) AS t0, avg((processed_items + failed_items) / (duration_ms / 1000.0::DOUBLE)) FILTER (late AND duration_ms > 0) AS t1
 FROM (SELECT *, ts >= {NOW} - INTERVAL 15 DAY AS late FROM syncs WHERE ts >= {NOW} - INTERVAL 30 DAY) GROUP BY 1)
SELECT network_type, round(l0, 2) AS latency_before, round(l1, 2) AS latency_after, CASE WHEN (l1 - l0) / l0 * 100 > 20 THEN 'degrading' WHEN (l1 - l0) / l0 * 100 < -20 THEN 'improving' ELSE 'stable' END AS latency_trend,
 round(t0, 4) AS throughput_before, round(t1, 4) AS throughput_after, CASE WHEN (t1 - t0) / t0 * 100 < -20 THEN 'degrading' WHEN (t1 - t0) / t0 * 100 > 20 THEN 'improving' ELSE 'stable' END AS throughput_trend, CASE WHEN s1 - s0 < -5 THEN 'degrading' WHEN s1 - s0 > 5 THEN 'improving' ELSE 'stable' END AS success_trend FROM g""", "syncs"))
def q25_performance_trend(spark, sf_dir):
    return H.performance_trend(view(spark, sf_dir, "syncs"), AS_OF)


@query(with_views("""
, p AS (SELECT network_type, CASE network_type WHEN 'wifi' THEN 'connected' WHEN 'cellular' THEN 'limited' ELSE 'disconnected' END AS network_status, round(avg(queue_after), 4) AS q, round(sum(failed_items) / greatest(sum(processed_items), 1) * 100, 4) AS d, round(avg(duration_ms), 2) AS l, round(count(*) FILTER (success) / count(*) * 100, 4) AS s, round(100 - sum(failed_items) / greatest(sum(processed_items), 1) * 100, 4) AS dq FROM syncs GROUP BY 1),
c AS (SELECT *, CASE WHEN q > 1000 THEN 10 ELSE 0 END + CASE WHEN d > 10 THEN 5 ELSE 0 END + CASE WHEN s < 80 THEN 10 ELSE 0 END + CASE WHEN network_status = 'disconnected' THEN 10 ELSE 0 END AS issue_cost,
 concat_ws(',', CASE WHEN q > 1000 THEN 'queue_backup' END, CASE WHEN d > 10 THEN 'data_gap' END, CASE WHEN s < 80 THEN 'performance_degradation' END, CASE WHEN network_status = 'disconnected' THEN 'network_issue' END) AS issues FROM p)
SELECT network_type, CAST(greatest(0, least(100, floor(100.0::DOUBLE - CASE WHEN q > 0 THEN least(30, q / 1000 * 30) ELSE 0 END - CASE WHEN d > 0 THEN least(20, d / 10 * 20) ELSE 0 END - CASE WHEN l > 30000 THEN least(20, (l - 30000) / 30000 * 20) ELSE 0 END
 - CASE WHEN s < 100 THEN (100 - s) * 0.3::DOUBLE ELSE 0 END - CASE network_status WHEN 'limited' THEN 5 WHEN 'disconnected' THEN 10 ELSE 0 END - issue_cost - CASE WHEN dq < 100 THEN (100 - dq) * 0.15::DOUBLE ELSE 0 END + 0.5))) AS BIGINT) AS score, issues FROM c""", "syncs"))
def q26_health_score(spark, sf_dir):
    scored = H.health_score(H.sync_issues(H.sync_status(view(spark, sf_dir, "syncs"), "network_type")))
    return scored.select("network_type", "score", F.array_join(F.transform("issues", lambda i: i["kind"]), ",").alias("issues"))


RULES = f"""{DRIFT},
p AS (SELECT network_type, round(avg(duration_ms), 4) AS l, round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 4) AS s, CAST((array_agg(queue_after ORDER BY ts DESC, id DESC))[1] AS DOUBLE) AS q, round(least(100.0::DOUBLE, sum(ln(processed_items + 1.0::DOUBLE) * 100 + duration_ms * 0.1::DOUBLE) / 100000), 4) AS b FROM syncs GROUP BY 1),
c AS (SELECT p.*, CASE WHEN network_type = 'none' THEN 100.0::DOUBLE ELSE 0 END AS poor, round(greatest(temporal_variance * 100, data_variance * 100, abs(degradation)), 4) AS d FROM p JOIN drift USING (network_type)),
r AS (SELECT network_type, 'sync_latency_high' AS rule, 'sync_performance' AS category, 'medium' AS severity, l AS value, l <= 30000 AS holds FROM c UNION ALL SELECT network_type, 'sync_success_rate_low', 'sync_performance', 'high', s, s >= 90 FROM c UNION ALL SELECT network_type, 'queue_depth_high', 'sync_performance', 'medium', q, q <= 1000 FROM c
 UNION ALL SELECT network_type, 'data_drift_high', 'data_quality', 'medium', d, d <= 15 FROM c UNION ALL SELECT network_type, 'network_connectivity_poor', 'network_health', 'low', poor, poor <= 20 FROM c UNION ALL SELECT network_type, 'battery_usage_high', 'resource_usage', 'low', b, b <= 5 FROM c)"""


@query(with_views(f", {RULES} SELECT * FROM r", "syncs"))
def q27_health_rules(spark, sf_dir):
    return H.health_rules(H.health_context(view(spark, sf_dir, "syncs"), AS_OF))


@query(with_views(f""", {RULES}, w AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 8 END AS weight FROM r)
SELECT network_type, CAST(floor(sum(CASE WHEN holds THEN weight ELSE 0 END) * 100.0::DOUBLE / sum(weight) + 0.5) AS BIGINT) AS health, count(*) FILTER (NOT holds) AS broken, {', '.join(f"round(avg(CAST(holds AS INT)) FILTER (category = '{k}') * 100, 4) AS {k}" for k in ('sync_performance', 'data_quality', 'network_health', 'resource_usage'))} FROM w GROUP BY 1""", "syncs"))
def q27_weighted_health(spark, sf_dir):
    return H.weighted_health(H.health_rules(H.health_context(view(spark, sf_dir, "syncs"), AS_OF)))


@query(with_views(", d AS (SELECT network_type, CAST(ts AS DATE) AS day, avg(duration_ms) AS v FROM syncs GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY network_type ORDER BY day) AS x FROM d), g AS (SELECT network_type, regr_slope(v, x) / avg(v) * 100 AS p FROM x GROUP BY 1) SELECT network_type, round(p, 3) AS percent, CASE WHEN p > 5 THEN 'up' WHEN p < -5 THEN 'down' ELSE 'stable' END AS trend FROM g", "syncs"))
def q28_metric_trend(spark, sf_dir):
    return H.metric_trend(view(spark, sf_dir, "syncs"))


@query(with_views("SELECT network_type, round(avg(duration_ms), 2) AS mean_ms, max(duration_ms) AS max_ms, count(*) FILTER (duration_ms > 5000) AS over, CASE WHEN round(avg(duration_ms), 2) > 5000 THEN 'fail' WHEN round(avg(duration_ms), 2) > 4000 THEN 'warning' ELSE 'pass' END AS status FROM syncs GROUP BY 1".replace("AS over,", 'AS "over",'), "syncs"))
def q39_performance_summary(spark, sf_dir):
    return H.performance_summary(view(spark, sf_dir, "syncs"), 5000)


@query(with_views("""
, w AS (SELECT network_type, ts, id, queue_after, avg(queue_after) OVER (PARTITION BY network_type ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY network_type ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS n, row_number() OVER (PARTITION BY network_type ORDER BY ts DESC, id DESC) AS r FROM syncs),
s AS (SELECT network_type, count(*) FILTER (n = 4 AND queue_after > b * 1.5) AS spikes FROM w GROUP BY 1),
g AS (SELECT network_type, ((array_agg(queue_after ORDER BY ts DESC, id DESC))[1] - (array_agg(queue_after ORDER BY ts, id))[1]) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6) AS rate FROM w WHERE r <= 20 GROUP BY 1)
SELECT network_type, round(rate, 4) AS growth, CASE WHEN rate > 2 THEN 'high' WHEN rate > 1 THEN 'medium' WHEN rate > 0.5 THEN 'low' ELSE 'none' END AS severity, spikes FROM g JOIN s USING (network_type)""", "syncs"))
def q40_growth_and_spikes(spark, sf_dir):
    return H.growth_and_spikes(view(spark, sf_dir, "syncs"))


@query(with_views(f"""
, g AS (SELECT network_type, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_sync, count(*) FILTER (ts >= {NOW} - INTERVAL 1 DAY) AS recent, (array_agg(queue_after ORDER BY ts DESC, id DESC))[1] AS queue FROM syncs GROUP BY 1)
SELECT *, CASE WHEN (epoch({NOW}) - last_sync) / 3600 > 168 THEN 'error' WHEN (epoch({NOW}) - last_sync) / 3600 > 24 THEN 'warning' ELSE 'healthy' END AS status FROM g""", "syncs"))
def q05_sync_report(spark, sf_dir):
    return H.sync_report(view(spark, sf_dir, "syncs"), AS_OF)


ITEMS = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS priority, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'completed' END AS status, CAST(floor(epoch(ts)) AS BIGINT) AS created FROM events"""


def items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    priority = F.element_at(F.array(*(F.lit(p) for p in ("critical", "high", "normal", "low"))), (F.col("event_id") % 4 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("completed")
    return e.select(F.col("event_id").alias("id"), priority.alias("priority"), status.alias("status"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created"))


@query(f"WITH i AS ({ITEMS}) SELECT * FROM i ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, created, id LIMIT 500")
def t06_queue_order(spark, sf_dir):
    return H.queue_order(items(spark, sf_dir), 500)


@query(f"WITH i AS ({ITEMS}) SELECT status, priority, count(*) AS items, max(1706659200 - created) AS oldest, round(avg(1706659200 - created), 1) AS mean_age FROM i GROUP BY 1, 2")
def q41_queue_stats(spark, sf_dir):
    return H.queue_stats(items(spark, sf_dir), 1_706_659_200)


@query(f"WITH i AS ({ITEMS}), g AS (SELECT count(*) AS items, count(*) FILTER (status = 'failed') AS failed FROM i) SELECT *, CASE WHEN failed / greatest(items, 1) > 0.5 OR items > 100000 THEN 'critical' WHEN failed / greatest(items, 1) > 0.2 OR items > 10000 THEN 'warning' ELSE 'healthy' END AS status FROM g")
def q41_queue_health(spark, sf_dir):
    return H.queue_health(items(spark, sf_dir))


MESSAGES = ["Connection reset by peer", "Request timed out", "Invalid phone number", "could not parse row", "permission denied", "something else", "database deadlock"]


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ['network', 'timeout', 'validation', 'format', 'permission', 'unknown', 'database'][CAST(event_id % 7 AS INT) + 1] AS class FROM events) SELECT day, class, count(*) AS errors, class IN ('timeout', 'network', 'database', 'memory') AS retried FROM e GROUP BY 1, 2""")
def q42_dead_letters(spark, sf_dir):
    message = F.element_at(F.array(*(F.lit(m) for m in MESSAGES)), (F.col("event_id") % 7 + 1).cast("int"))
    return H.dead_letters(table(spark, sf_dir, "events").select(F.col("ts").alias("at"), message.alias("message")))


JOBS = "SELECT event_id AS id, ts, CASE event_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'cdr' ELSE 'pdf' END AS format, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'completed' END AS status, event_id % 60 AS seconds, event_id % 5000 AS rows, user_id % 100 / 100.0::DOUBLE AS confidence FROM events"


def jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("completed")
    form = F.when(F.col("event_id") % 3 == 0, "csv").when(F.col("event_id") % 3 == 1, "cdr").otherwise("pdf")
    return e.select(F.col("event_id").alias("id"), "ts", form.alias("format"), status.alias("status"), (F.col("event_id") % 60).alias("seconds"), (F.col("event_id") % 5000).alias("rows"), (F.col("user_id") % 100 / F.lit(100.0)).alias("confidence"))


@query(f"WITH j AS ({JOBS.replace('AS rows,', 'AS n_rows,')}) SELECT format, count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS queued, round(avg(seconds) FILTER (status = 'completed'), 2) AS mean_seconds, round(sum(n_rows) / greatest(sum(seconds), 1), 2) AS rows_a_second FROM j GROUP BY 1")
def q29_job_stats(spark, sf_dir):
    return H.job_stats(jobs(spark, sf_dir), "format")


@query(f"WITH j AS ({JOBS.replace('AS rows,', 'AS n_rows,')}) SELECT CAST(floor((epoch({NOW}) - floor(epoch(ts))) / 604800) AS BIGINT) AS week, count(*) AS n, round(avg(confidence), 3) AS mean FROM j WHERE ts >= {NOW} - INTERVAL 28 DAY AND ts < {NOW} GROUP BY 1")
def q33_weekly_accuracy(spark, sf_dir):
    return H.trailing_weeks(jobs(spark, sf_dir), AS_OF, "confidence")


@query(f"WITH j AS ({JOBS.replace('AS rows,', 'AS n_rows,')}) SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS jobs, count(*) FILTER (status = 'failed') AS failed, CAST(sum(n_rows) AS BIGINT) AS total_rows FROM j GROUP BY 1")
def q35_processing_stats(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("jobs"), count_if(F.col("status") == "failed").alias("failed"), F.sum("rows").alias("total_rows"))


RISK = """a AS (SELECT *, CAST(least(100, CASE outcome WHEN 'failure' THEN 40 WHEN 'blocked' THEN 60 WHEN 'warning' THEN 20 ELSE 0 END + CASE WHEN contains(action, 'login') AND outcome = 'failure' THEN 20 ELSE 0 END
 + CASE WHEN ip_address <> '' AND NOT regexp_matches(ip_address, '^(10\\.|172\\.(1[6-9]|2[0-9]|3[0-1])\\.|192\\.168\\.|127\\.)') THEN 30 ELSE 0 END) AS BIGINT) AS risk FROM audit)"""


@query(with_views(f", {RISK} SELECT category, CASE WHEN risk >= 75 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS severity, count(*) AS entries, count(*) FILTER (outcome = 'failure') AS failures, count(DISTINCT actor_id) AS actors, round(avg(risk), 2) AS mean_risk FROM a GROUP BY 1, 2", "audit"))
def g24_audit_statistics(spark, sf_dir):
    return H.audit_statistics(view(spark, sf_dir, "audit"))


@query(with_views(f"SELECT id, actor_id, category, outcome FROM audit WHERE category = 'authentication' AND ts >= {NOW} - INTERVAL 10 DAY ORDER BY ts DESC, id LIMIT 100", "audit"))
def g08_audit_trail(spark, sf_dir):
    return H.audit_search(view(spark, sf_dir, "audit"), AS_OF, category="authentication", days=10).select("id", "actor_id", "category", "outcome")


@query(with_views(f"""
, w AS (SELECT * FROM audit WHERE ts >= {NOW} - INTERVAL 43200 MINUTE), f AS (SELECT * FROM w WHERE category = 'authentication' AND outcome = 'failure')
SELECT 'failed_logins_ip' AS kind, ip_address AS subject, count(*) AS n, 'high' AS level FROM f GROUP BY 2 HAVING count(*) >= 5 UNION ALL SELECT 'failed_logins_actor', CAST(actor_id AS VARCHAR), count(*), 'medium' FROM f GROUP BY 2 HAVING count(*) >= 3
UNION ALL SELECT 'volume', CAST(actor_id AS VARCHAR), max(n), 'medium' FROM (SELECT actor_id, count(*) AS n FROM w GROUP BY actor_id, date_trunc('hour', ts)) GROUP BY actor_id HAVING max(n) > 2
UNION ALL SELECT 'off_hours', CAST(actor_id AS VARCHAR), count(*), 'low' FROM w WHERE category IN ('data_access', 'data_export') AND (hour(ts) < 6 OR hour(ts) >= 22) GROUP BY 2
UNION ALL SELECT 'bulk', CAST(actor_id AS VARCHAR), count(*), 'high' FROM w WHERE resource_count > 1000 GROUP BY 2
UNION ALL SELECT 'bulk_failures', CAST(actor_id AS VARCHAR), count(*), 'medium' FROM w WHERE resource_count > 100 AND (id % 5) * resource_count / 4.0::DOUBLE > 0.5 * resource_count GROUP BY 2
UNION ALL SELECT 'privacy_violation', CAST(w.actor_id AS VARCHAR), count(*), 'high' FROM w JOIN roles x ON x.user_id = w.actor_id % 10 JOIN contacts c ON c.id = w.actor_id + 1 JOIN roles y ON y.user_id = c.owner_id JOIN rules r ON r.contact_id = c.id AND r.visibility = 'private' WHERE w.category = 'data_access' AND x.org_id <> y.org_id GROUP BY 2""", "audit", "roles", "contacts", "rules"))
def g25_anomalies(spark, sf_dir):
    audit = view(spark, sf_dir, "audit").withColumn("error_count", (F.col("id") % 5) * F.col("resource_count") / 4.0)
    reached = audit.where("category = 'data_access'").select("id", (F.col("actor_id") % 10).alias("actor"), (F.col("actor_id") + 1).alias("contact_id"))
    private = policies.cross_org_access(reached, *(view(spark, sf_dir, v) for v in ("contacts", "roles", "rules")))
    return H.anomalies(audit, AS_OF, minutes=43_200, per_hour=2, private_access=private)


@query(with_views(", c AS (SELECT actor_id, id, row_number() OVER (PARTITION BY actor_id ORDER BY id) AS r FROM audit) SELECT actor_id, count(*) AS entries, count(*) FILTER (r > 1) AS links, 0::BIGINT AS broken FROM c GROUP BY 1", "audit"))
def g23_audit_chain(spark, sf_dir):
    entries = view(spark, sf_dir, "audit").select("actor_id", F.col("id").alias("seq"), F.concat_ws("|", "category", "outcome", "resource", F.col("id").cast("string")).alias("body"))
    chain = H.chained(entries)
    bad = H.broken_links(chain).groupBy("actor_id").agg(F.count("*").alias("b"))
    out = chain.groupBy("actor_id").agg(F.count("*").alias("entries"), count_if(F.col("previous_hash") != "").alias("links"))
    return out.join(bad, "actor_id", "left").select("actor_id", "entries", "links", F.coalesce("b", F.lit(0).cast("bigint")).alias("broken"))


@query(with_views(f"SELECT category, count(*) AS kept FROM audit WHERE ts >= {NOW} - INTERVAL 20 DAY OR (category = 'data_export' AND resource_count > 500) GROUP BY 1", "audit"))
def g28_retention(spark, sf_dir):
    keep = (F.col("category") == "data_export") & (F.col("resource_count") > 500)
    return H.retention(view(spark, sf_dir, "audit"), AS_OF, 20, keep).groupBy("category").agg(F.count("*").alias("kept"))


@query(with_views("SELECT owner_id, count(*) AS events, count(*) FILTER (number = 'ANONYMIZED') AS stripped, count(content) AS with_content FROM (SELECT owner_id, CASE WHEN g THEN 'ANONYMIZED' ELSE number END AS number, CASE WHEN g THEN NULL ELSE content END AS content FROM (SELECT *, owner_id = 4 AND ts < TIMESTAMP '2024-01-15 00:00:00' AS g FROM comm)) GROUP BY 1", "comm"))
def g27_anonymize_user(spark, sf_dir):
    out = H.anonymize_user(view(spark, sf_dir, "comm"), 4, "2024-01-15 00:00:00")
    return out.groupBy("owner_id").agg(F.count("*").alias("events"), count_if(F.col("number") == "ANONYMIZED").alias("stripped"), F.count("content").alias("with_content"))
