"""Filters, joins, aggregates, windows, sorts and unions over the log, and visibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators import filters, matching, visibility
from calltide.operators.dashboards import count_if
from calltide.operators.windows import sliced
from calltide.plans.adapter import AS_OF, view, with_views
from calltide.plans.registry import query, table

NOW = f"TIMESTAMP '{AS_OF}'"
ROLE = """(SELECT user_id, role, org_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE role WHEN 'owner' THEN 5 WHEN 'admin' THEN 4 WHEN 'analyst' THEN 3 WHEN 'member' THEN 2 ELSE 1 END DESC, org_id) AS r FROM roles) WHERE r = 1)"""
POWER = "CASE role WHEN 'owner' THEN 5 WHEN 'admin' THEN 4 WHEN 'analyst' THEN 3 WHEN 'member' THEN 2 WHEN 'viewer' THEN 1 ELSE 0 END"

VISIBLE = f"""
, top AS {ROLE}, me AS (SELECT role AS my_role, org_id AS my_org FROM top WHERE user_id = {{0}}),
seen AS (SELECT id, comm.owner_id, comm.contact_id, CAST(epoch_us(ts) AS BIGINT) AS at_us, type, direction, CAST(duration AS BIGINT) AS duration,
  CASE WHEN comm.owner_id <> {{0}} AND anonymize_number THEN substr(number, 1, 3) || '-***-' || right(number, 4) ELSE number END AS number,
  CASE WHEN comm.owner_id <> {{0}} AND anonymize_content AND content IS NOT NULL THEN '[Content Hidden]' ELSE content END AS content, coalesce(visibility, 'team') AS visibility
  FROM comm JOIN top ON top.user_id = comm.owner_id JOIN me ON me.my_org = top.org_id LEFT JOIN rules ON rules.contact_id = comm.contact_id
  WHERE comm.owner_id = {{0}} OR my_role IN ('admin', 'owner') OR visibility IS NULL OR visibility IN ('team', 'public'))
"""


def micros(df: DataFrame) -> DataFrame:
    return df.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts").withColumn("duration", F.col("duration").cast("bigint"))


@query(with_views(VISIBLE.format(4) + "SELECT * FROM seen ORDER BY at_us DESC, id LIMIT 1000 OFFSET 10", "comm", "rules", "roles"))
def f01_filtered_events(spark, sf_dir):
    seen = visibility.visible_events(view(spark, sf_dir, "comm"), view(spark, sf_dir, "rules"), view(spark, sf_dir, "roles"), 4)
    return micros(visibility.newest(seen, 1000, 10))


@query(with_views(VISIBLE.format(3) + "SELECT owner_id, visibility, count(*) AS events, count(*) FILTER (content = '[Content Hidden]') AS hidden, count(*) FILTER (number LIKE '%***%') AS masked FROM seen GROUP BY 1, 2", "comm", "rules", "roles"))
def g01_visible_counts(spark, sf_dir):
    seen = visibility.visible_events(view(spark, sf_dir, "comm"), view(spark, sf_dir, "rules"), view(spark, sf_dir, "roles"), 3)
    return seen.groupBy("owner_id", "visibility").agg(F.count("*").alias("events"), count_if(F.col("content") == "[Content Hidden]").alias("hidden"), count_if(F.col("number").contains("***")).alias("masked"))


@query(with_views("""SELECT id, owner_id, type, direction, source, CAST(duration AS BIGINT) AS duration FROM comm WHERE type IN ('call', 'sms') AND direction = 'inbound' AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
 AND source IN ('carrier', 'device') AND (duration IS NULL OR duration >= 5) AND (duration IS NULL OR duration <= 120)""", "comm"))
def f02_filter_events(spark, sf_dir):
    out = filters.filter_events(view(spark, sf_dir, "comm"), types=["call", "sms"], directions=["inbound"], start="2024-01-03 00:00:00", end="2024-01-20 00:00:00", sources=["carrier", "device"], min_duration=5, max_duration=120, keep_without_duration=True)
    return out.select("id", "owner_id", "type", "direction", "source", F.col("duration").cast("bigint").alias("duration"))


@query(with_views("""SELECT id, number, CAST(duration AS BIGINT) AS duration, type FROM comm WHERE (lower(number) LIKE '%791%' OR lower(coalesce(content, '')) LIKE '%791%') AND (type <> 'call' OR (duration >= 10 AND duration <= 400))""", "comm"))
def f03_search_events(spark, sf_dir):
    return filters.client_filter(view(spark, sf_dir, "comm"), search="791", min_duration=10, max_duration=400).select("id", "number", F.col("duration").cast("bigint").alias("duration"), "type")


@query(with_views(f"""
SELECT 'today' AS name, count(*) FILTER (ts >= date_trunc('day', {NOW} - INTERVAL 1 SECOND)) AS events FROM comm UNION ALL
SELECT 'missed_calls', count(*) FILTER (type = 'call' AND direction = 'inbound' AND duration = 0) FROM comm UNION ALL
SELECT 'recent_week', count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) FROM comm UNION ALL
SELECT 'outbound_calls', count(*) FILTER (type = 'call' AND direction = 'outbound') FROM comm UNION ALL
SELECT 'long_calls', count(*) FILTER (type = 'call' AND duration >= 300) FROM comm UNION ALL
SELECT 'text_messages', count(*) FILTER (type = 'sms') FROM comm""", "comm"))
def f04_quick_filters(spark, sf_dir):
    return filters.quick_filter_counts(view(spark, sf_dir, "comm"), "2024-01-30 23:59:59", AS_OF)


@query(with_views("SELECT id, type, direction, (SELECT count(*) FROM comm WHERE type = 'sms' AND direction = 'outbound') AS total FROM comm WHERE type = 'sms' AND direction = 'outbound' ORDER BY ts DESC, id LIMIT 50 OFFSET 100", "comm"))
def f06_paged_events(spark, sf_dir):
    return filters.page_with_total(filters.filter_events(view(spark, sf_dir, "comm"), types=["sms"], directions=["outbound"]), 50, 100).select("id", "type", "direction", "total")


@query(with_views("SELECT owner_id, count(*) AS events FROM comm WHERE owner_id IN (SELECT user_id FROM roles WHERE org_id = 1) GROUP BY 1", "comm", "roles"))
def f08_in_subquery(spark, sf_dir):
    team = view(spark, sf_dir, "roles").where("org_id = 1").select(F.col("user_id").alias("owner_id"))
    return view(spark, sf_dir, "comm").join(team, "owner_id", "left_semi").groupBy("owner_id").agg(F.count("*").alias("events"))


@query(with_views("""SELECT id, EXISTS (SELECT 1 FROM rules r WHERE r.contact_id = contacts.id AND visibility = 'private') AS has_private, NOT EXISTS (SELECT 1 FROM comm c WHERE c.contact_id = contacts.id AND duration > 500) AS no_long_call FROM contacts""", "contacts", "rules", "comm"))
def f09_exists(spark, sf_dir):
    contacts, rules, comm = (view(spark, sf_dir, v) for v in ("contacts", "rules", "comm"))
    private = rules.where("visibility = 'private'").select(F.col("contact_id").alias("id")).distinct().withColumn("p", F.lit(True))
    long = comm.where("duration > 500").select(F.col("contact_id").alias("id")).distinct().withColumn("l", F.lit(True))
    return contacts.select("id").join(private, "id", "left").join(long, "id", "left").select("id", F.coalesce("p", F.lit(False)).alias("has_private"), F.col("l").isNull().alias("no_long_call"))


@query("SELECT p_partkey, p_name, p_brand LIKE 'Brand#1%' AS brand_one, regexp_matches(p_type, '^[A-Z]+ ') AS upper_type, p_name ILIKE '%A%' AS has_a FROM part")
def f10_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", F.col("p_brand").startswith("Brand#1").alias("brand_one"), F.col("p_type").rlike("^[A-Z]+ ").alias("upper_type"), F.col("p_name").ilike("%A%").alias("has_a"))


@query(with_views("SELECT id, list_has_any([tag, company], ['friend', 'Company 3']) AS overlaps, list_contains([tag, company], 'work') AS at_work FROM contacts", "contacts"))
def f11_arrays(spark, sf_dir):
    tags = F.array("tag", "company")
    return view(spark, sf_dir, "contacts").select("id", F.arrays_overlap(tags, F.array(F.lit("friend"), F.lit("Company 3"))).alias("overlaps"), F.array_contains(tags, "work").alias("at_work"))


@query(with_views("SELECT network_type, count(*) AS syncs, count(*) FILTER (success) AS ok FROM syncs WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND network_type IN ('wifi', 'none') GROUP BY 1", "syncs"))
def f12_sync_filter(spark, sf_dir):
    s = view(spark, sf_dir, "syncs").where((F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) & F.col("network_type").isin("wifi", "none"))
    return s.groupBy("network_type").agg(F.count("*").alias("syncs"), count_if(F.col("success")).alias("ok"))


@query(with_views("SELECT comm.id, comm.number, name, visibility FROM comm LEFT JOIN contacts ON contacts.id = comm.contact_id LEFT JOIN rules ON rules.contact_id = contacts.id", "comm", "contacts", "rules"))
def j01_events_contacts_rules(spark, sf_dir):
    comm, contacts, rules = (view(spark, sf_dir, v) for v in ("comm", "contacts", "rules"))
    return comm.select("id", "number", "contact_id").join(contacts.select(F.col("id").alias("contact_id"), "name"), "contact_id", "left").join(rules.select("contact_id", "visibility"), "contact_id", "left").drop("contact_id")


@query(with_views("SELECT comm.id, visibility FROM comm LEFT JOIN rules ON rules.contact_id = comm.contact_id AND rules.owner_id = comm.owner_id AND visibility <> 'public'", "comm", "rules"))
def j02_compound_left_join(spark, sf_dir):
    comm, rules = view(spark, sf_dir, "comm"), view(spark, sf_dir, "rules").where("visibility <> 'public'")
    return comm.select("id", "contact_id", "owner_id").join(rules.select("contact_id", "owner_id", "visibility"), ["contact_id", "owner_id"], "left").select("id", "visibility")


@query(with_views("SELECT contacts.id, visibility FROM rules RIGHT JOIN contacts ON contacts.id = rules.contact_id", "contacts", "rules"))
def j03_right_join(spark, sf_dir):
    return view(spark, sf_dir, "rules").select(F.col("contact_id").alias("id"), "visibility").join(view(spark, sf_dir, "contacts").select("id"), "id", "right")


#: The log with copies a little later, so that near pairs exist.
COPIES = """, twice AS (SELECT id, owner_id, line_id, number, type, direction, duration, content, source, ts FROM comm UNION ALL
SELECT id + 10000000, owner_id, line_id, number, type, direction, duration, content, 'carrier', ts + INTERVAL 1 SECOND FROM comm WHERE id % 5 = 0 UNION ALL
SELECT id + 20000000, owner_id, line_id, number, type, direction, duration + 1, content, 'device', ts + INTERVAL 200 SECOND FROM comm WHERE id % 7 = 0 UNION ALL
SELECT id + 30000000, owner_id, line_id, number, 'sms', direction, NULL, 'other', 'manual', ts + INTERVAL 20 SECOND FROM comm WHERE id % 11 = 0)"""


def with_copies(spark, sf_dir) -> DataFrame:
    c = view(spark, sf_dir, "comm").select("id", "owner_id", "line_id", "number", "type", "direction", "duration", "content", "source", "ts")
    later = lambda n, s: {"id": F.col("id") + n, "ts": F.col("ts") + F.expr(f"INTERVAL '{s}' SECOND")}
    a = c.where("id % 5 = 0").withColumns(later(10_000_000, 1) | {"source": F.lit("carrier")})
    b = c.where("id % 7 = 0").withColumns(later(20_000_000, 200) | {"source": F.lit("device"), "duration": F.col("duration") + 1})
    d = c.where("id % 11 = 0").withColumns(later(30_000_000, 20) | {"source": F.lit("manual"), "type": F.lit("sms"), "duration": F.lit(None).cast("int"), "content": F.lit("other")})
    return reduce(DataFrame.unionByName, [c, a, b, d])


PAIRS = """, pairs AS (SELECT a.id AS id_a, b.id AS id_b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap_us, a.line_id AS line_id_a, b.line_id AS line_id_b, a.type AS type_a, b.type AS type_b, a.direction AS direction_a, b.direction AS direction_b, a.duration AS duration_a, b.duration AS duration_b,
 a.content AS content_a, b.content AS content_b FROM twice a JOIN twice b ON a.owner_id = b.owner_id AND a.number = b.number AND a.id < b.id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {0} * 1000000)"""
#: Pairs that may conflict: within ten times a tolerance of 1 s.
CONFLICT_PAIRS = PAIRS.format(10).replace("a.owner_id = b.owner_id", "a.owner_id = b.owner_id AND a.line_id = b.line_id AND a.direction = b.direction AND a.type = b.type")
CONFLICT_CASES = """CASE WHEN gap_us = 0 AND duration_a IS NOT DISTINCT FROM duration_b THEN 'exact' WHEN gap_us <= 1000000 AND abs(coalesce(duration_a, 0) - coalesce(duration_b, 0)) <= 1 THEN 'time_variance' ELSE 'fuzzy' END AS conflict,
 CASE WHEN gap_us = 0 AND duration_a = duration_b THEN 1.0::DOUBLE WHEN gap_us <= 1000000 THEN 0.9::DOUBLE
 WHEN content_a IS NOT NULL AND content_b IS NOT NULL THEN CASE WHEN greatest(length(content_a), length(content_b)) = 0 THEN 1.0::DOUBLE ELSE greatest(0.0, 1.0 - (length(content_a) - length(content_b)) / greatest(length(content_a), length(content_b))) END ELSE 0.7::DOUBLE END AS similarity"""


@query(with_views(COPIES + PAIRS.format(1) + "SELECT id_a, id_b, CAST(gap_us AS BIGINT) AS gap_us FROM pairs", "comm"))
def j04_near_pairs(spark, sf_dir):
    return matching.near_pairs(with_copies(spark, sf_dir), ["owner_id", "number"], 1).select("id_a", "id_b", "gap_us")


@query(with_views(COPIES + PAIRS.format(10) + "SELECT owner_id, count(DISTINCT id) AS potential FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs) p JOIN twice USING (id) GROUP BY 1", "comm"))
def j05_potential_duplicates(spark, sf_dir):
    twice = with_copies(spark, sf_dir)
    pairs = matching.near_pairs(twice, ["owner_id", "number"], 10)
    ids = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct()
    return twice.join(ids, "id", "left_semi").groupBy("owner_id").agg(F.count("*").alias("potential"))


@query(with_views("SELECT DISTINCT a.user_id AS user_a, b.user_id AS user_b FROM roles a JOIN roles b ON a.org_id = b.org_id AND a.user_id < b.user_id", "roles"))
def j06_same_organization(spark, sf_dir):
    return visibility.same_organization(view(spark, sf_dir, "roles"))


@query(with_views("""SELECT owner_id, d.day AS day, count(id) AS events FROM (SELECT DISTINCT owner_id FROM comm) o CROSS JOIN (SELECT strftime(CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE), '%Y-%m-%d') AS day) d
 LEFT JOIN comm ON comm.owner_id = o.owner_id AND strftime(ts, '%Y-%m-%d') = d.day GROUP BY o.owner_id, d.day""".replace("SELECT owner_id, d.day", "SELECT o.owner_id, d.day"), "comm"))
def j07_zero_filled_days(spark, sf_dir):
    comm = view(spark, sf_dir, "comm")
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-05").cast("date")))
    spine = comm.select("owner_id").distinct().select("owner_id", days.alias("d")).select("owner_id", F.date_format("d", "yyyy-MM-dd").alias("day"))
    counts = comm.groupBy("owner_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["owner_id", "day"], "left").select("owner_id", "day", F.coalesce("n", F.lit(0).cast("bigint")).alias("events"))


@query(with_views("SELECT (SELECT count(*) FROM comm) AS events, (SELECT count(*) FROM contacts) AS contacts, (SELECT count(*) FROM rules) AS rules", "comm", "contacts", "rules"))
def j08_one_row_frames(spark, sf_dir):
    parts = [view(spark, sf_dir, v).agg(F.count("*").alias(n)) for v, n in (("comm", "events"), ("contacts", "contacts"), ("rules", "rules"))]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # of one row each


@query(with_views(f"SELECT id, (SELECT count(*) FROM comm c WHERE c.contact_id = contacts.id AND ts >= {NOW} - INTERVAL 7 DAY) AS recent, (SELECT max(duration) FROM comm c WHERE c.contact_id = contacts.id) AS longest FROM contacts", "contacts", "comm"))
def j09_scalar_subqueries(spark, sf_dir):
    comm = view(spark, sf_dir, "comm")
    recent = F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL '7' DAY")
    sums = comm.where("contact_id IS NOT NULL").groupBy(F.col("contact_id").alias("id")).agg(count_if(recent).alias("recent"), F.max("duration").alias("longest"))
    return view(spark, sf_dir, "contacts").select("id").join(sums, "id", "left").select("id", F.coalesce("recent", F.lit(0).cast("bigint")).alias("recent"), "longest")


@query(with_views("SELECT comm.id, coalesce(contact_id, contacts.id) AS contact_id, contact_id IS NULL AND contacts.id IS NOT NULL AS filled FROM comm LEFT JOIN contacts ON contacts.number = comm.number", "comm", "contacts"))
def j10_fill_contacts(spark, sf_dir):
    return matching.fill_contacts(view(spark, sf_dir, "comm"), view(spark, sf_dir, "contacts"))


@query(with_views(COPIES + PAIRS.format(30) + "SELECT id_a, id_b FROM pairs WHERE type_a <> type_b", "comm"))
def r24_cross_type_duplicates(spark, sf_dir):
    return matching.near_pairs(with_copies(spark, sf_dir), ["owner_id", "number"], 30).where("type_a <> type_b").select("id_a", "id_b")


@query(with_views(COPIES + CONFLICT_PAIRS + "SELECT id_a, id_b, " + CONFLICT_CASES + " FROM pairs", "comm"))
def r14_event_conflicts(spark, sf_dir):
    return matching.event_conflicts(with_copies(spark, sf_dir), 1)


@query(with_views("SELECT count(*) AS events, count(*) FILTER (type = 'call') AS calls, count(DISTINCT number) AS numbers, count(DISTINCT number) FILTER (type = 'sms') AS sms_numbers, round(avg(duration) / 60, 1) AS minutes, round(stddev_samp(duration), 3) AS sd, min(duration) AS low, max(duration) FILTER (direction = 'inbound') AS high, CAST(coalesce(sum(duration) FILTER (source = 'none'), 0) AS BIGINT) AS none, round(avg(CASE WHEN direction = 'inbound' THEN 1.0 ELSE 0.0 END), 4) AS inbound_rate, round(count(*) FILTER (type = 'call') / greatest(1, count(*)), 4) AS call_ratio FROM comm", "comm"))
def a01_global_aggregates(spark, sf_dir):
    d, call, inbound = F.col("duration"), F.col("type") == "call", F.col("direction") == "inbound"
    return view(spark, sf_dir, "comm").agg(
        F.count("*").alias("events"), count_if(call).alias("calls"), F.countDistinct("number").alias("numbers"), F.countDistinct(F.when(~call, F.col("number"))).alias("sms_numbers"), F.round(F.avg(d) / 60, 1).alias("minutes"), F.round(F.stddev_samp(d), 3).alias("sd"),
        F.min(d).alias("low"), F.max(F.when(inbound, d)).alias("high"), F.coalesce(F.sum(F.when(F.col("source") == "none", d)), F.lit(0)).cast("bigint").alias("none"), F.round(F.avg(F.when(inbound, 1.0).otherwise(0.0)), 4).alias("inbound_rate"), F.round(count_if(call) / F.greatest(F.lit(1), F.count("*")), 4).alias("call_ratio"),
    )


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, round(avg(l_discount), 4) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def a05_pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("discount"))


@query(with_views("SELECT owner_id, arg_min(h, (-n) * 100 + h) AS peak FROM (SELECT owner_id, hour(ts) AS h, count(*) AS n FROM comm GROUP BY 1, 2) GROUP BY 1", "comm"))
def a06_mode_hour(spark, sf_dir):
    return view(spark, sf_dir, "comm").groupBy("owner_id").agg(F.mode(F.hour("ts").cast("bigint"), True).alias("peak"))


@query(with_views("SELECT owner_id, array_to_string(list_transform(list_sort(list({'d': day, 'n': n})), lambda x: x.d || '=' || CAST(x.n AS VARCHAR)), ';') AS days FROM (SELECT owner_id, strftime(ts, '%d') AS day, count(*) AS n FROM comm GROUP BY 1, 2) GROUP BY 1", "comm"))
def a09_ordered_array(spark, sf_dir):
    d = view(spark, sf_dir, "comm").groupBy("owner_id", F.date_format("ts", "dd").alias("d")).agg(F.count("*").alias("n"))
    return d.groupBy("owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "n"))), lambda x: F.concat(x["d"], F.lit("="), x["n"].cast("string"))), ";").alias("days"))


@query(with_views("SELECT owner_id, map_from_entries(list({'k': source, 'v': n}))['carrier'] AS carrier, map_from_entries(list({'k': source, 'v': n}))['device'] AS device FROM (SELECT owner_id, source, count(*) AS n FROM comm GROUP BY 1, 2) GROUP BY 1", "comm"))
def a10_object_aggregate(spark, sf_dir):
    s = view(spark, sf_dir, "comm").groupBy("owner_id", "source").agg(F.count("*").alias("n")).groupBy("owner_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    return s.select("owner_id", F.col("m")["carrier"].alias("carrier"), F.col("m")["device"].alias("device"))


@query(with_views("SELECT network_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_ms) AS p99 FROM syncs GROUP BY 1", "syncs"))
def a11_percentiles(spark, sf_dir):
    p = lambda q: F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY duration_ms) AS BIGINT)")
    return view(spark, sf_dir, "syncs").groupBy("network_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query(with_views("SELECT owner_id, CAST(list_sort(list(duration))[CAST(floor(count(duration) / 2) AS BIGINT) + 1] AS BIGINT) AS median FROM comm WHERE duration IS NOT NULL GROUP BY 1", "comm"))
def a12_upper_median(spark, sf_dir):
    w = Window.partitionBy("owner_id").orderBy("duration")
    counts = view(spark, sf_dir, "comm").where("duration IS NOT NULL").groupBy("owner_id", "duration").agg(F.count("*").alias("n"))  # of distinct values, not of rows
    upto = counts.withColumn("upto", F.sum("n").over(w)).withColumn("whole", F.sum("n").over(Window.partitionBy("owner_id")))
    return upto.where(F.col("upto") > F.floor(F.col("whole") / 2)).groupBy("owner_id").agg(F.min("duration").cast("bigint").alias("median"))


@query(with_views("SELECT number, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) FILTER (type = 'call') AS calls, count(*) FILTER (type = 'sms') AS sms FROM comm GROUP BY 1", "comm"))
def a13_contact_extraction(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return view(spark, sf_dir, "comm").groupBy("number").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), count_if(F.col("type") == "call").alias("calls"), count_if(F.col("type") == "sms").alias("sms"))


@query(with_views("SELECT actor_id, array_to_string(list_sort(list(DISTINCT resource)), ',') AS resources, count(*) AS n FROM audit WHERE outcome = 'failure' GROUP BY 1 HAVING count(*) >= 3", "audit"))
def a17_resource_sets(spark, sf_dir):
    a = view(spark, sf_dir, "audit").where("outcome = 'failure'").groupBy("actor_id").agg(F.array_join(F.array_sort(F.collect_set("resource")), ",").alias("resources"), F.count("*").alias("n"))
    return a.where("n >= 3")


@query(with_views("SELECT owner_id, id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY owner_id ORDER BY ts, id)) AS since_us FROM comm", "comm"))
def w01_lag(spark, sf_dir):
    us, w = F.unix_micros(F.col("ts").cast("timestamp")), Window.partitionBy("owner_id").orderBy("ts", "id")
    return view(spark, sf_dir, "comm").select("owner_id", "id", (us - F.lag(us).over(w)).alias("since_us"))


@query(with_views("SELECT owner_id, day, n, row_number() OVER (PARTITION BY owner_id ORDER BY day) AS ordinal, rank() OVER (PARTITION BY owner_id ORDER BY n DESC) AS place, round(n * 100.0 / sum(n) OVER (PARTITION BY owner_id), 2) AS share FROM (SELECT owner_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM comm GROUP BY 1, 2)", "comm"))
def w02_ranks_and_shares(spark, sf_dir):
    d, own = view(spark, sf_dir, "comm").groupBy("owner_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")), Window.partitionBy("owner_id")
    return d.select("owner_id", "day", "n", F.row_number().over(own.orderBy("day")).cast("bigint").alias("ordinal"), F.rank().over(own.orderBy(F.desc("n"))).cast("bigint").alias("place"), F.round(F.col("n") * 100.0 / F.sum("n").over(own), 2).alias("share"))


@query(with_views("SELECT contact_id, id, r FROM (SELECT contact_id, id, row_number() OVER (PARTITION BY contact_id ORDER BY ts DESC, id) AS r FROM comm WHERE contact_id IS NOT NULL) WHERE r <= 10", "comm"))
def w05_last_ten(spark, sf_dir):
    return filters.last_n(view(spark, sf_dir, "comm").where("contact_id IS NOT NULL"), "contact_id", 10).select("contact_id", "id", F.col("place").alias("r"))


@query(with_views("SELECT network_type, id, round(avg(duration_ms) OVER (PARTITION BY network_type ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 3) AS before FROM syncs", "syncs"))
def w09_trailing_mean(spark, sf_dir):
    rows, w, own = sliced(view(spark, sf_dir, "syncs").select("network_type", "ts", "id", "duration_ms"), ["network_type"], ["ts", "id"], F.to_date("ts"), 4)
    return rows.select("network_type", "id", "_own", F.round(F.avg("duration_ms").over(w.rowsBetween(-4, -1)), 3).alias("before")).where(own).drop("_own")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def t01_order_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(25)


@query(with_views(f"SELECT org_id, user_id, role, CAST({POWER} AS BIGINT) AS power, rank() OVER (PARTITION BY org_id ORDER BY {POWER} DESC) - 1 AS above FROM roles", "roles"))
def t03_role_power(spark, sf_dir):
    return visibility.hierarchy(view(spark, sf_dir, "roles"))


@query("SELECT c_custkey, o_orderstatus, n, place FROM (SELECT c_custkey, o_orderstatus, count(*) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, c_custkey) AS place FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) WHERE place <= 10")
def t04_top_customers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").agg(F.count("*").alias("n"))
    o = o.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return o.withColumn("place", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("n"), "c_custkey")).cast("bigint")).where("place <= 10")


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def u01_union_all(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(r.select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query(with_views("SELECT DISTINCT number, type FROM comm", "comm"))
def u02_distinct(spark, sf_dir):
    return view(spark, sf_dir, "comm").select("number", "type").distinct()


@query(with_views(f"""
, top AS {ROLE}, me AS (SELECT role, org_id AS my_org FROM top WHERE user_id = 3),
w AS (SELECT contacts.id, CASE WHEN contacts.owner_id = 3 THEN 'own' WHEN top.org_id IS DISTINCT FROM my_org THEN 'organization' WHEN me.role IN ('owner', 'admin') THEN 'role' WHEN visibility IS NULL THEN 'default' ELSE 'rule:' || visibility END AS reason
 FROM contacts CROSS JOIN me LEFT JOIN top ON top.user_id = contacts.owner_id LEFT JOIN rules ON rules.contact_id = contacts.id)
SELECT id, reason, reason NOT IN ('organization', 'rule:private') AS allowed FROM w""", "contacts", "rules", "roles"))
def g02_contact_access(spark, sf_dir):
    return visibility.can_access(view(spark, sf_dir, "contacts"), view(spark, sf_dir, "rules"), view(spark, sf_dir, "roles"), 3)


@query(with_views(f"SELECT user_id, role, org_id FROM {ROLE}", "roles"))
def g04_highest_role(spark, sf_dir):
    return visibility.highest_role(view(spark, sf_dir, "roles"))


@query(with_views("SELECT role, count(*) AS users, count(DISTINCT org_id) AS orgs FROM roles GROUP BY 1", "roles"))
def g09_role_counts(spark, sf_dir):
    return view(spark, sf_dir, "roles").groupBy("role").agg(F.count("*").alias("users"), F.countDistinct("org_id").alias("orgs"))


RULES = """, more AS (SELECT contact_id AS id, 'contact' AS scope, contact_id, NULL AS pattern, NULL::BIGINT AS org_id, 10 AS priority, visibility, contact_id % 6 <> 0 AS active, contact_id AS created FROM rules UNION ALL
SELECT 100000, 'organization', NULL, NULL, 1, 20, 'private', true, 5 UNION ALL SELECT 100001, 'global', NULL, NULL, NULL, 5, 'public', true, 1 UNION ALL SELECT 100002, 'pattern', NULL, '+120', NULL, 15, 'team', true, 2)"""


def many_rules(spark, sf_dir) -> DataFrame:
    own = view(spark, sf_dir, "rules").selectExpr("contact_id AS id", "'contact' AS scope", "contact_id", "CAST(NULL AS STRING) AS pattern", "CAST(NULL AS BIGINT) AS org_id", "10 AS priority", "visibility", "contact_id % 6 <> 0 AS active", "contact_id AS created")
    more = spark.createDataFrame([(100000, "organization", None, None, 1, 20, "private", True, 5), (100001, "global", None, None, None, 5, "public", True, 1), (100002, "pattern", None, "+120", None, 15, "team", True, 2)], own.schema)
    return own.unionByName(more)


@query(with_views(RULES + """, c AS (SELECT id, number, owner_id % 2 AS org_id FROM contacts),
every AS (SELECT c.id, m.id AS rule_id, scope, visibility, row_number() OVER (PARTITION BY c.id ORDER BY priority DESC, created, m.id) AS r FROM c JOIN more m ON active AND (scope = 'global' OR (scope = 'contact' AND m.contact_id = c.id) OR (scope = 'organization' AND m.org_id = c.org_id) OR (scope = 'pattern' AND c.number LIKE pattern || '%')))
SELECT c.id, CAST(rule_id AS BIGINT) AS rule_id, coalesce(scope, 'default') AS scope, coalesce(visibility, 'team') AS visibility FROM c LEFT JOIN every ON every.id = c.id AND r = 1""", "contacts", "rules"))
def g13_effective_rules(spark, sf_dir):
    contacts = view(spark, sf_dir, "contacts").select("id", "number", (F.col("owner_id") % 2).alias("org_id"))
    return visibility.effective_rules(contacts, many_rules(spark, sf_dir))


