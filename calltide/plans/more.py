"""Further queries: scalar families, policies, exports, templates and compliance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calltide.functions import masks as M
from calltide.functions import normalize as N
from calltide.operators import classify, health, ingest, matching, policies, vectors, visibility
from calltide.operators.dashboards import count_if
from calltide.plans.adapter import AS_OF, view, with_views
from calltide.plans.events import COPIES, PAIRS, with_copies
from calltide.plans.registry import query, table
from calltide.sources import sinks
from calltide.streaming import jobs

NOW = f"TIMESTAMP '{AS_OF}'"


@query("SELECT c_mktsegment, round(avg(c_acctbal), 1) AS mean, round(stddev_samp(c_acctbal), 2) AS sd, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
def a04_spread(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(b), 1).alias("mean"), F.round(F.stddev_samp(b), 2).alias("sd"), F.min(b).alias("low"), F.max(b).alias("high"))


@query("SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice) AS largest FROM orders GROUP BY 1")
def a07_argmax(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("largest"))


@query("SELECT o_orderstatus, round(regr_slope(n, x), 4) + 0.0 AS slope FROM (SELECT o_orderstatus, n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY d) AS x FROM (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1, 2)) GROUP BY 1")
def a08_slope(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    d = d.withColumn("x", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("d")))
    return d.groupBy("o_orderstatus").agg(F.round(F.regr_slope("n", "x"), 4).alias("slope"))


@query(with_views("SELECT owner_id, round(avg(CASE WHEN type = 'call' THEN 1.0 ELSE 0.0 END), 4) AS call_rate, round(count(*) FILTER (direction = 'inbound') / greatest(1, count(*)), 4) AS in_ratio FROM comm GROUP BY 1", "comm"))
def a15_rates(spark, sf_dir):
    return view(spark, sf_dir, "comm").groupBy("owner_id").agg(F.round(F.avg(F.when(F.col("type") == "call", 1.0).otherwise(0.0)), 4).alias("call_rate"), F.round(count_if(F.col("direction") == "inbound") / F.greatest(F.lit(1), F.count("*")), 4).alias("in_ratio"))


@query(with_views("SELECT ip_address, count(*) AS failures FROM audit WHERE outcome = 'failure' GROUP BY 1 HAVING count(*) >= 5", "audit"))
def a16_thresholds(spark, sf_dir):
    return view(spark, sf_dir, "audit").where("outcome = 'failure'").groupBy("ip_address").agg(F.count("*").alias("failures")).where("failures >= 5")


@query(with_views("SELECT network_type, count(*) AS n, round(avg(gap), 3) AS mean_gap FROM (SELECT network_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY network_type ORDER BY ts, id))) / 1e6 AS gap FROM syncs) WHERE gap IS NOT NULL GROUP BY 1", "syncs"))
def w07_intervals(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = view(spark, sf_dir, "syncs").groupBy("network_type").agg((F.count("*") - 1).alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("span")).where("n > 0")
    return s.select("network_type", "n", F.round(F.col("span") / F.col("n"), 3).alias("mean_gap"))  # intervals between consecutive ones add up to the span


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate < TIMESTAMP '1995-01-01' AS early FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def s21_table_scan(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early"))


def exported(spark, sf_dir):
    rules = view(spark, sf_dir, "rules").select("contact_id", "visibility")
    return view(spark, sf_dir, "comm").join(rules, "contact_id", "left").withColumn("visibility", F.coalesce("visibility", F.lit("team")))


EXPORT = ", x AS (SELECT comm.*, coalesce(visibility, 'team') AS visibility FROM comm LEFT JOIN rules ON rules.contact_id = comm.contact_id)"


@query(with_views(EXPORT + " SELECT CAST(id AS VARCHAR) AS id, CASE WHEN visibility = 'private' THEN 'Private' ELSE number END AS number, CASE WHEN visibility = 'private' THEN 'Private' ELSE content END AS content, visibility FROM x", "comm", "rules"))
def s25_export_rows(spark, sf_dir):
    return sinks.export_frame(exported(spark, sf_dir)).select("id", "number", "content", "visibility")


@query(with_views("SELECT unnest(['events', 'calls', 'sms', 'contacts', 'call_seconds']) AS name, unnest([count(*), count(*) FILTER (type = 'call'), count(*) FILTER (type = 'sms'), count(DISTINCT contact_id), CAST(coalesce(sum(duration), 0) AS BIGINT)]) AS value FROM comm", "comm"))
def s27_export_summary(spark, sf_dir):
    return sinks.export_summary(view(spark, sf_dir, "comm"))


@query(with_views("SELECT contact_id, count(*) AS events FROM comm WHERE contact_id IS NOT NULL GROUP BY 1 ORDER BY events DESC, contact_id LIMIT 20", "comm"))
def s28_top_contacts(spark, sf_dir):
    return sinks.contact_counts(view(spark, sf_dir, "comm"))


@query()
def s32_export_size(spark, sf_dir):
    return sinks.export_size(exported(spark, sf_dir))


@query(with_views("SELECT id, CASE WHEN substr(number, 3, 3) IN ('214', '210', '512', '713') THEN 'att' WHEN substr(number, 3, 3) IN ('201', '202', '212', '917') THEN 'verizon' WHEN substr(number, 3, 3) IN ('206', '253', '425') THEN 'tmobile' WHEN substr(number, 3, 3) IN ('913', '816', '785') THEN 'sprint' ELSE 'unknown' END AS carrier FROM contacts", "contacts"))
def e12_carrier(spark, sf_dir):
    return view(spark, sf_dir, "contacts").select("id", policies.carrier_of(F.col("number")).alias("carrier"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS at_s FROM orders")
def e13_event_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, f = F.col("o_orderkey"), lambda p: F.date_format("o_orderdate", p)
    text = F.when(k % 4 == 0, f("yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, f("MM/dd/yyyy HH:mm:ss")).when(k % 4 == 2, f("yyyyMMdd HHmmss")).otherwise(f("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", F.unix_timestamp(N.event_time(text)).alias("at_s"))


@query(with_views("SELECT id, CAST(duration AS BIGINT) AS seconds FROM comm", "comm"))
def e14_durations(spark, sf_dir):
    d = F.col("duration")
    text = F.when(F.col("id") % 3 == 0, N.format_duration(d)).when(F.col("id") % 3 == 1, F.concat(d.cast("string"), F.lit(" seconds"))).otherwise(F.concat(F.floor(d / 60).cast("string"), F.lit(" min "), (d % 60).cast("string"), F.lit(" sec")))
    return view(spark, sf_dir, "comm").select("id", N.duration_seconds(text).cast("bigint").alias("seconds"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 1 THEN false END AS flag, CAST(p_size AS BIGINT) AS size FROM part")
def e15_generic_types(spark, sf_dir):
    k = F.col("p_partkey")
    flag = F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "off").otherwise("perhaps")
    return table(spark, sf_dir, "part").select("p_partkey", N.boolean(flag).alias("flag"), F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).try_cast("bigint").alias("size"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN regexp_full_match(c_name, '.*[0-9]+.*') THEN 1.0 ELSE 0.0 END), 4) AS with_digits, round(avg(CASE WHEN length(c_mktsegment) BETWEEN 5 AND 20 THEN 1.0 ELSE 0.0 END), 4) AS good_segment FROM customer")
def e26_content_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rate = lambda p: F.round(F.avg(F.when(p, 1.0).otherwise(0.0)), 4)
    return c.agg(F.count("*").alias("n"), rate(F.col("c_name").rlike("[0-9]+")).alias("with_digits"), rate(F.char_length("c_mktsegment").between(5, 20)).alias("good_segment"))


@query(with_views("SELECT comm.id, CASE WHEN coalesce(anonymize_number, false) THEN substr(number, 1, 3) || '-***-' || right(number, 4) ELSE number END AS number, CASE WHEN coalesce(anonymize_content, false) AND content IS NOT NULL THEN '[Content Hidden]' ELSE content END AS content FROM comm LEFT JOIN rules ON rules.contact_id = comm.contact_id", "comm", "rules"))
def e29_masked_insert(spark, sf_dir):
    return policies.masked_insert(view(spark, sf_dir, "comm"), view(spark, sf_dir, "rules"))


@query(with_views(COPIES + """, m AS (SELECT owner_id, number, direction, arg_max(content, (CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) AS content, CAST(max(duration) AS BIGINT) AS duration, arg_max(source, (CAST(CASE source WHEN 'carrier' THEN 9 WHEN 'device' THEN 7 ELSE 5 END AS HUGEINT) * 10000000000000000000000000 + CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) AS source, arg_min(type, (CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) AS type, count(*) AS merged FROM twice GROUP BY 1, 2, 3) SELECT * FROM m""", "comm"))
def r09_merge_policies(spark, sf_dir):
    how = {"content": "newest", "duration": "max", "source": "trusted", "type": "oldest"}
    return policies.merge_by_policy(with_copies(spark, sf_dir), ["owner_id", "number", "direction"], how).withColumn("duration", F.col("duration").cast("bigint"))


@query(with_views(COPIES + """
, t AS (SELECT *, owner_id % 3 AS line, epoch_us(ts) AS us FROM twice), p AS (SELECT n.id, e.id AS other, n.us = e.us AND n.duration IS NOT DISTINCT FROM e.duration AND n.content IS NOT DISTINCT FROM e.content AS same,
 CASE WHEN n.type = 'call' AND abs(coalesce(n.duration, 0) - coalesce(e.duration, 0)) <= 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n.type = 'sms' AND n.content <> '' AND e.content <> '' AND 1 - levenshtein(n.content, e.content) / greatest(length(n.content), length(e.content)) > 0.8 THEN 0.1::DOUBLE ELSE 0 END AS more
 FROM t n JOIN t e ON n.id >= 10000000 AND e.id < 10000000 AND n.line = e.line AND n.number = e.number AND n.type = e.type AND n.direction = e.direction AND abs(n.us - e.us) <= 1000000),
s AS (SELECT id, other, CASE WHEN same THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 0.9::DOUBLE + more), 4) END AS score, CASE WHEN same THEN 'exact' ELSE 'time_variance' END AS conflict FROM p)
SELECT id, other, score, conflict, score >= 0.8 AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, conflict, other) AS r FROM s) WHERE r = 1""", "comm"))
def r20_new_against_existing(spark, sf_dir):
    t = with_copies(spark, sf_dir).withColumn("line_id", F.col("owner_id") % 3)
    return policies.new_against_existing(t.where("id >= 10000000"), t.where("id < 10000000"))


@query(with_views(COPIES + PAIRS.format(30) + """, s AS (SELECT *, greatest(0.0::DOUBLE, CASE WHEN gap_us / 1e6 <= 10 THEN 1 - gap_us / 1e6 / 10.0::DOUBLE ELSE 1 - gap_us / 1e6 / 100.0::DOUBLE END) AS t,
 CASE WHEN content_a IS NULL AND content_b IS NULL THEN 1.0::DOUBLE WHEN content_a IS NULL OR content_b IS NULL THEN 0.0 WHEN greatest(length(trim(content_a)), length(trim(content_b))) = 0 THEN 1.0 ELSE 1 - levenshtein(lower(trim(content_a)), lower(trim(content_b))) / greatest(length(trim(content_a)), length(trim(content_b))) END AS c,
 CASE WHEN duration_a IS NULL AND duration_b IS NULL THEN 1.0::DOUBLE WHEN duration_a IS NULL OR duration_b IS NULL THEN 0.0 WHEN abs(duration_a - duration_b) <= 1 THEN 1.0 ELSE greatest(0.0, 1 - abs(duration_a - duration_b) / greatest((duration_a + duration_b) / 2, 1.0)) END AS d FROM pairs),
w AS (SELECT *, CASE WHEN line_id_a = line_id_b AND (direction_a = direction_b OR type_a = type_b) THEN (0.2::DOUBLE + CASE WHEN direction_a = direction_b THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN type_a = type_b THEN 0.1::DOUBLE ELSE 0 END + 0.25::DOUBLE + CASE WHEN t > 0.5 THEN t * 0.25::DOUBLE ELSE 0 END
 + CASE WHEN type_a = 'call' AND type_b = 'call' AND d > 0.5 THEN d * 0.1::DOUBLE ELSE 0 END + CASE WHEN type_a = 'sms' AND type_b = 'sms' AND c > 0.85 THEN c * 0.1::DOUBLE ELSE 0 END) / (0.9::DOUBLE + CASE WHEN type_a = type_b THEN 0.1::DOUBLE ELSE 0 END) ELSE 0 END AS x FROM s)
SELECT id_a, id_b, round(x, 4) AS score, CASE WHEN round(x, 4) >= 0.95 AND gap_us <= 1000000 THEN 'exact' WHEN round(x, 4) >= 0.85 AND gap_us <= 10000000 THEN 'time_variance' ELSE 'fuzzy' END AS conflict FROM w""", "comm"))
def r22_advanced_scores(spark, sf_dir):
    return policies.advanced_scores(matching.near_pairs(with_copies(spark, sf_dir), ["owner_id", "number"], 30), 10)


KINDS = {"events": "viewer", "contacts": "viewer", "rules": "analyst", "audit": "admin", "billing": "owner"}


@query(with_views("""SELECT user_id, role, kind, CASE role WHEN 'owner' THEN 5 WHEN 'admin' THEN 4 WHEN 'analyst' THEN 3 WHEN 'member' THEN 2 ELSE 1 END >= least AS allowed FROM (SELECT user_id, max(role) AS role FROM roles GROUP BY 1) CROSS JOIN (VALUES ('events', 1), ('contacts', 1), ('rules', 3), ('audit', 4), ('billing', 5)) k(kind, least)""", "roles"))
def g06_resource_access(spark, sf_dir):
    return policies.access_by_kind(view(spark, sf_dir, "roles"), KINDS)


@query(with_views("SELECT role, count(*) AS granted FROM (SELECT r.role, l.least FROM (VALUES ('owner', 5), ('admin', 4), ('analyst', 3), ('member', 2), ('viewer', 1)) r(role, p) JOIN (VALUES (1), (2), (4), (3), (1), (2), (4), (3), (4), (3), (4), (4), (5), (4)) l(least) ON r.p >= l.least) GROUP BY 1".replace("SELECT role", "SELECT role"), "roles"))
def g10_permission_matrix(spark, sf_dir):
    return visibility.permission_matrix(spark).where("allowed").groupBy("role").agg(F.count("*").alias("granted"))


@query(with_views(", c AS (SELECT id AS contact_id, CASE WHEN id % 2 = 0 THEN 'private' ELSE 'public' END AS visibility FROM contacts WHERE id % 3 = 0) SELECT coalesce(r.contact_id, c.contact_id) AS contact_id, coalesce(c.visibility, r.visibility) AS visibility, CASE WHEN c.visibility IS NULL THEN 'kept' WHEN r.visibility IS NULL THEN 'added' ELSE 'changed' END AS action FROM rules r FULL JOIN c ON r.contact_id = c.contact_id", "contacts", "rules"))
def g14_bulk_rules(spark, sf_dir):
    c = view(spark, sf_dir, "contacts").where("id % 3 = 0").select(F.col("id").alias("contact_id"), F.when(F.col("id") % 2 == 0, "private").otherwise("public").alias("visibility"))
    return policies.apply_rules(view(spark, sf_dir, "rules"), c)


@query(with_views("SELECT id, '***-***-****' AS full_mask, substr(number, 1, 3) || repeat('*', 5) || right(number, 4) AS partial, substr(number, 1, 5) || '***' || right(number, 4) AS smart, repeat('*', 8) || right(number, 4) AS simple, left(sha256('k' || number), 12) AS token FROM contacts", "contacts"))
def g17_number_modes(spark, sf_dir):
    n = F.col("number")
    return view(spark, sf_dir, "contacts").select("id", policies.anonymize_number(n, "full").alias("full_mask"), *(policies.anonymize_number(n, m, "k").alias(m) for m in ("partial", "smart", "simple", "token")))


@query("SELECT count(*) AS n, true AS centred, true AS spread, true AS apart FROM orders")
def g19_noise(spark, sf_dir):
    """Noise of scale 200: that its mean is near 0, its mean size near 200, and that amounts differ from those without it."""
    noise = M.laplace_noise(100.0, 0.5, 11)
    o = table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_totalprice") + noise).alias("noisy")).withColumn("d", F.col("noisy") - F.col("o_totalprice"))
    return o.agg(F.count("*").alias("n"), (F.abs(F.avg("d")) < 30).alias("centred"), F.avg(F.abs("d")).between(180, 220).alias("spread"), (F.count_if(F.col("d") != 0) > 0.99 * F.count("*")).alias("apart"))


@query(with_views("SELECT id, left(sha256('s' || number), 16) AS hash_token, length(number) AS n FROM contacts", "contacts"))
def g21_tokens(spark, sf_dir):
    return view(spark, sf_dir, "contacts").select("id", M.hash_token(F.col("number"), "s").alias("hash_token"), F.char_length("number").cast("bigint").alias("n"))


@query(with_views("SELECT id, left(sha256(number), 16) AS number FROM contacts", "contacts"))
def g22_policy(spark, sf_dir):
    return policies.apply_policy(view(spark, sf_dir, "contacts").select("id", "number"), "number", "number", "analytics")


@query(f"""WITH r AS (SELECT CASE event_id % 3 WHEN 0 THEN 'access' WHEN 1 THEN 'erasure' ELSE 'portability' END AS kind, CASE WHEN event_type = 'error' THEN 'open' ELSE 'done' END AS status, CAST(floor(epoch(ts)) AS BIGINT) AS created, CASE WHEN event_type <> 'error' THEN CAST(floor(epoch(ts)) AS BIGINT) + user_id * 3600 END AS completed FROM events)
SELECT kind, status, count(*) AS requests, round(avg((completed - created) / 86400.0), 2) AS mean_days, count(*) FILTER (completed IS NULL AND created + 864000 < epoch({NOW})) AS overdue FROM r GROUP BY 1, 2""")
def g26_request_statistics(spark, sf_dir):
    e, s = table(spark, sf_dir, "events"), F.unix_timestamp(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_id") % 3 == 0, "access").when(F.col("event_id") % 3 == 1, "erasure").otherwise("portability")
    open_ = F.col("event_type") == "error"
    r = e.select(kind.alias("kind"), F.when(open_, "open").otherwise("done").alias("status"), s.alias("created"), F.when(~open_, s + F.col("user_id") * 3600).alias("completed"), (s + 864_000).alias("due"))
    return policies.request_statistics(r, 1_706_659_200)


@query(with_views("""
, a AS (SELECT id, actor_id % 10 AS user_id, actor_id AS contact_id FROM audit WHERE category = 'data_access')
SELECT a.id, a.user_id, a.contact_id FROM a JOIN roles x ON x.user_id = a.user_id JOIN contacts c ON c.id = a.contact_id + 1 JOIN roles y ON y.user_id = c.owner_id JOIN rules r ON r.contact_id = c.id AND r.visibility = 'private' WHERE x.org_id <> y.org_id""".replace("a.contact_id\nFROM", "a.contact_id FROM"), "audit", "roles", "contacts", "rules"))
def j13_cross_org_access(spark, sf_dir):
    a = view(spark, sf_dir, "audit").where("category = 'data_access'").select("id", (F.col("actor_id") % 10).alias("actor"), (F.col("actor_id") + 1).alias("contact_id"))
    out = policies.cross_org_access(a, view(spark, sf_dir, "contacts"), view(spark, sf_dir, "roles"), view(spark, sf_dir, "rules"))
    return out.withColumn("contact_id", F.col("contact_id") - 1)


@query()
def v03_store_or_merge(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.lit(1).cast("bigint").alias("runs"), F.lit(10.0).alias("mean_ms"))
    return vectors.store_or_merge(e.where("id % 20 <> 0"), e.where("id % 20 = 0")).select("id", "runs", "mean_ms")


@query("SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def v06_guarded_sql(spark, sf_dir):
    return vectors.guarded(spark, "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey", {"nation": table(spark, sf_dir, "nation")})


@query("SELECT event_id % 9 AS template_id, count(*) AS uses, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) * 100, 2) AS success_rate FROM events GROUP BY 1 UNION ALL SELECT 9, 0, NULL UNION ALL SELECT 10, 0, NULL")
def q30_template_success(spark, sf_dir):
    j = table(spark, sf_dir, "events").select((F.col("event_id") % 9).alias("template_id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    return classify.template_success(j, spark.range(11))


@query(with_views("SELECT 'type' AS chart, type AS label, count(*) AS value FROM comm GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM comm GROUP BY 2 UNION ALL SELECT 'direction', direction, count(*) FROM comm GROUP BY 2", "comm"))
def q31_chart_series(spark, sf_dir):
    c = view(spark, sf_dir, "comm").select(F.explode(F.array(*(F.struct(F.lit(k).alias("chart"), F.col(k).alias("label")) for k in ("type", "source", "direction")))).alias("x"))
    return c.groupBy("x.chart", "x.label").agg(F.count("*").alias("value"))


@query(f"SELECT count(*) FILTER (event_type = 'view') AS active, count(*) FILTER (event_type = 'click') AS queued, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, round(avg(value) FILTER (event_type = 'purchase'), 2) AS mean_value FROM events WHERE ts >= date_trunc('day', {NOW} - INTERVAL 2 DAY)")
def q34_system_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.date_trunc("day", F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL '2' DAY")))
    kind = lambda k: F.col("event_type") == k
    return e.agg(count_if(kind("view")).alias("active"), count_if(kind("click")).alias("queued"), count_if(kind("purchase")).alias("completed"), count_if(kind("error")).alias("failed"), F.round(F.avg(F.when(kind("purchase"), F.col("value"))), 2).alias("mean_value"))


@query(f"SELECT event_type AS kind, count(*) AS tokens, count(DISTINCT user_id) AS subjects, round(avg(epoch({NOW}) - floor(epoch(ts))) / 3600, 2) AS mean_age_h, round(count(*) FILTER (event_id % 4 = 0) / count(*), 4) AS hit_ratio FROM events GROUP BY 1")
def q43_token_statistics(spark, sf_dir):
    age = 1_706_659_200 - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("tokens"), F.countDistinct("user_id").alias("subjects"), F.round(F.avg(age) / 3600, 2).alias("mean_age_h"), F.round(count_if(F.col("event_id") % 4 == 0) / F.count("*"), 4).alias("hit_ratio"))


@query("SELECT event_id AS id, CASE WHEN 1706659200 - CAST(floor(epoch(ts)) AS BIGINT) > 604800 THEN 'expired' WHEN event_id % 7 >= 5 THEN 'dead' ELSE 'retry' END AS state, CASE WHEN 1706659200 - CAST(floor(epoch(ts)) AS BIGINT) <= 604800 AND event_id % 7 < 5 THEN CAST(floor(epoch(ts)) AS BIGINT) + 60 + CAST(least(300.0, pow(2, event_id % 7)) AS BIGINT) END AS retry_at FROM events WHERE event_type = 'error'")
def x01_retries(spark, sf_dir):
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    items = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), s.alias("created"), (F.col("event_id") % 7).alias("attempts"), (s + 60).alias("failed"))
    return jobs.next_attempts(items, 1_706_659_200)


@query("SELECT o_orderkey, upper(o_orderpriority) AS up, substr(o_orderpriority, 1, 3) || '..' || right(o_orderstatus, 1) AS cut, trim(lower(o_orderpriority)) AS low, coalesce(nullif(o_orderstatus, 'F'), '-') AS status FROM orders")
def c01_strings(spark, sf_dir):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.upper(p).alias("up"), F.concat(F.substring(p, 1, 3), F.lit(".."), F.right(s, F.lit(1))).alias("cut"), F.trim(F.lower(p)).alias("low"), F.coalesce(F.nullif(s, F.lit("F")), F.lit("-")).alias("status"))


@query("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS masked, regexp_extract(c_name, '([0-9]+)', 1) AS number, sha256(c_name) AS sha, md5(c_name) AS md FROM customer")
def c02_regex_and_hashes(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(n, "[0-9]+", "#").alias("masked"), F.regexp_extract(n, "([0-9]+)", 1).alias("number"), F.sha2(n, 256).alias("sha"), F.md5(n).alias("md"))


@query("SELECT o_orderkey, CAST(epoch(date_trunc('week', o_orderdate)) AS BIGINT) AS week_s, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS month_s, dayofweek(o_orderdate) AS dow, strftime(o_orderdate, '%Y/%m') AS label, CAST(epoch(o_orderdate + INTERVAL 36 HOUR) AS BIGINT) AS later_s FROM orders")
def c04_dates(spark, sf_dir):
    d, s = F.col("o_orderdate"), lambda c: F.unix_timestamp(c.cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s(F.date_trunc("week", d)).alias("week_s"), s(F.date_trunc("month", d)).alias("month_s"), (F.dayofweek(d) - 1).cast("bigint").alias("dow"), F.date_format(d, "yyyy/MM").alias("label"), s(d + F.expr("INTERVAL '36' HOUR")).alias("later_s"))


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS far, greatest(l_tax, l_discount) AS most, least(l_tax, l_discount) AS least_, floor(l_extendedprice / 1000) * 1000 AS band, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS class FROM lineitem")
def c05_math_and_cases(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.abs(q - 25).alias("far"), F.greatest("l_tax", "l_discount").alias("most"), F.least("l_tax", "l_discount").alias("least_"), (F.floor(F.col("l_extendedprice") / 1000) * 1000).cast("double").alias("band"), F.when(q > 40, "high").when(q > 20, "mid").otherwise("low").alias("class"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || CAST(event_id AS VARCHAR) || ',\"type\":\"' || event_type || '\"}' AS made FROM events")
def c08_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("made"))


@query("SELECT n_nationkey, unnest(range(n_nationkey % 4 + 1)) AS step FROM nation")
def c09_generators(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n_nationkey") % 4).cast("bigint"))).alias("step"))


@query("SELECT c_custkey, true AS same FROM customer")
def c14_encryption(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    sealed = F.aes_encrypt(F.col("c_name"), key, F.lit("GCM"))
    return table(spark, sf_dir, "customer").select("c_custkey", (F.aes_decrypt(sealed, key, F.lit("GCM")).cast("string") == F.col("c_name")).alias("same"))


@query("SELECT count(*) AS n, count(*) FILTER (x % 10 = 0) AS tens FROM range(1000) t(x)")
def ud01_sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_ten(x BIGINT) RETURNS BOOLEAN RETURN x % 10 = 0")
    return spark.range(1000).withColumnRenamed("id", "x").selectExpr("count(*) AS n", "count_if(is_ten(x)) AS tens")


@query("SELECT segment, round(mean, 2) AS mean, n FROM (SELECT c_mktsegment AS segment, avg(c_acctbal) AS mean, count(*) AS n FROM customer GROUP BY 1) WHERE n > 10")
def f07_optional_predicates(spark, sf_dir):
    from calltide.operators.filters import where_all

    low, high = 10, None
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.avg("c_acctbal"), 2).alias("mean"), F.count("*").alias("n"))
    return where_all(g, [None if low is None else F.col("n") > low, None if high is None else F.col("n") <= high])


@query()
def e01_field_mapping(spark, sf_dir):
    m = ingest.map_fields(["Call Date", "Phone Number", "Dur", "Direction", "Call Type", "Other"])
    return spark.createDataFrame([(f, h, c) for f, (h, c) in m.items()], "field string, header string, confidence double")


@query()
def e06_layout_features(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return ingest.layout_features(lines)


@query()
def s04_column_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ingest.column_types(o.select(*(F.col(c).cast("string").alias(c) for c in o.columns)))


@query(with_views("SELECT network_type, count(*) AS n FROM syncs WHERE duration_ms > 5000 GROUP BY 1", "syncs"))
def q26_issue_counts(spark, sf_dir):
    return health.performance_summary(view(spark, sf_dir, "syncs"), 5000).select("network_type", F.col("over").alias("n")).where("n > 0")


@query(with_views("SELECT owner_id, count(DISTINCT contact_id) AS contacts, count(DISTINCT number) FILTER (type = 'call') AS numbers_called FROM comm GROUP BY 1", "comm"))
def a02_distinct_counts(spark, sf_dir):
    called = F.when(F.col("type") == "call", F.col("number"))
    return view(spark, sf_dir, "comm").groupBy("owner_id").agg(F.countDistinct("contact_id").alias("contacts"), F.countDistinct(called).alias("numbers_called"))


@query(with_views("SELECT owner_id, round(avg(duration) FILTER (type = 'call') / 60.0::DOUBLE, 1) AS mean_minutes FROM comm GROUP BY 1", "comm"))
def a03_mean_minutes(spark, sf_dir):
    mean = F.avg(F.when(F.col("type") == "call", F.col("duration")))
    return view(spark, sf_dir, "comm").groupBy("owner_id").agg(health.rounded(mean / 60.0, 1).alias("mean_minutes"))


@query("""SELECT user_id, len(list_distinct(list(event_type))) AS kinds, list_has_any(list(event_type), ['error', 'signup']) AS any_of, list_contains(list(event_type), 'purchase') AS bought
FROM events GROUP BY 1""")
def c07_arrays(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    wanted = F.array(F.lit("error"), F.lit("signup"))
    return kinds.select("user_id", F.size("types").cast("long").alias("kinds"), F.arrays_overlap("types", wanted).alias("any_of"), F.array_contains("types", "purchase").alias("bought"))


@query("""WITH s AS (SELECT o_orderkey, reverse(CAST(o_orderkey AS VARCHAR)) AS r FROM orders), d AS (SELECT o_orderkey, i, CAST(substr(r, CAST(i AS INT), 1) AS INT) AS v FROM (SELECT o_orderkey, r, unnest(range(1, length(r) + 1)) AS i FROM s))
SELECT o_orderkey, sum(CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END) % 10 = 0 AS valid FROM d GROUP BY 1""")
def c16_luhn(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("luhn_check(CAST(o_orderkey AS STRING))").alias("valid"))
