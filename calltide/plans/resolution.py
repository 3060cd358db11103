"""Queries over entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltide.functions import similarity as S
from calltide.operators import entity_resolution as R
from calltide.operators import matching
from calltide.operators.set_join import similar_sets
from calltide.plans.adapter import AS_OF, view, with_views
from calltide.plans.events import CONFLICT_CASES, CONFLICT_PAIRS, COPIES, PAIRS, with_copies
from calltide.plans.registry import query, table

NOW = f"TIMESTAMP '{AS_OF}'"
T = "CAST(floor(epoch(ts)) AS BIGINT)"
EXACT = f"sha256(concat_ws('|', CAST(owner_id AS VARCHAR), number, CAST({T} AS VARCHAR), type, direction))"
BUCKET = f"""left(sha256(concat_ws('|', CAST(owner_id AS VARCHAR), regexp_replace(number, '[^0-9]', '', 'g'), CAST(CAST(floor({T} / 300 + 0.5) AS BIGINT) * 300 AS VARCHAR), type, direction,
 CASE WHEN type = 'call' THEN CAST(CAST(floor(coalesce(duration, 0) / 30.0 + 0.5) AS BIGINT) * 30 AS VARCHAR) ELSE '' END)), 16)"""


def first_sql(key: str) -> str:
    return COPIES + f", k AS (SELECT id, ts, {key} AS k FROM twice) SELECT arg_min(id, (CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) AS id, count(*) AS copies FROM k GROUP BY k"


@query(with_views(first_sql(EXACT), "comm"))
def r01_composite_key_dedup(spark, sf_dir):
    return R.first_of_key(with_copies(spark, sf_dir), R.composite_key()).select("id", "copies")


@query(with_views(first_sql(BUCKET), "comm"))
def r10_bucketed_key_dedup(spark, sf_dir):
    return R.first_of_key(with_copies(spark, sf_dir), R.bucketed_key()).select("id", "copies")


@query(with_views(first_sql("md5(concat_ws('|', CAST(owner_id AS VARCHAR), number, type, lower(trim(coalesce(content, '')))))"), "comm"))
def r03_content_key_dedup(spark, sf_dir):
    return R.first_of_key(with_copies(spark, sf_dir), R.content_key()).select("id", "copies")


@query(with_views(f"SELECT id, {EXACT} AS standard_key, {BUCKET} AS bucketed_key FROM comm", "comm"))
def r06_keys(spark, sf_dir):
    return view(spark, sf_dir, "comm").select("id", R.composite_key().alias("standard_key"), R.bucketed_key().alias("bucketed_key"))


CLUSTERS = COPIES + f""",
o AS (SELECT owner_id, number, type, direction, id, {T} AS t, row_number() OVER (PARTITION BY owner_id, number, type, direction ORDER BY {T}, id) AS r FROM twice),
f AS (SELECT *, id AS anchor, t AS at FROM o WHERE r = 1 UNION ALL
 SELECT o.*, CASE WHEN o.t - f.at > 300 THEN o.id ELSE f.anchor END, CASE WHEN o.t - f.at > 300 THEN o.t ELSE f.at END FROM f JOIN o ON o.owner_id = f.owner_id AND o.number = f.number AND o.type = f.type AND o.direction = f.direction AND o.r = f.r + 1)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(with_views(CLUSTERS + " SELECT id, anchor FROM f", "comm")))
def r02_anchor_clusters(spark, sf_dir):
    return R.anchor_clusters(with_copies(spark, sf_dir))


@query(recursive(with_views(CLUSTERS + f"""
SELECT anchor, min({T}) AS first_at, CAST(max(duration) AS BIGINT) AS duration, arg_max(content, lpad(CAST(length(content) AS VARCHAR), 9, '0') || content) AS content,
 arg_max(source, CASE source WHEN 'carrier' THEN 0.9 WHEN 'device' THEN 0.7 ELSE 0.5 END) AS source, count(*) AS merged FROM f JOIN twice USING (id) GROUP BY anchor""", "comm")))
def r02_merged_clusters(spark, sf_dir):
    events = with_copies(spark, sf_dir)
    return R.merge_clusters(events, R.anchor_clusters(events))


@query(with_views("""
, twice AS (SELECT * FROM contacts UNION ALL SELECT id, owner_id, number, name || ' Jr', company, 'extra', first_seen - INTERVAL 1 DAY, last_seen, 1, 2 FROM contacts WHERE id % 3 = 0)
SELECT owner_id, number, arg_max(name, lpad(CAST(length(name) AS VARCHAR), 9, '0') || name) AS name, CAST(epoch_us(min(first_seen)) AS BIGINT) AS first_us, CAST(epoch_us(max(last_seen)) AS BIGINT) AS last_us, CAST(sum(total_calls) AS BIGINT) AS total_calls, CAST(sum(total_sms) AS BIGINT) AS total_sms, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM twice GROUP BY 1, 2""", "contacts"))
def r04_merge_contacts(spark, sf_dir):
    c = view(spark, sf_dir, "contacts")
    more = c.where("id % 3 = 0").withColumns({"name": F.concat("name", F.lit(" Jr")), "tag": F.lit("extra"), "first_seen": F.col("first_seen") - F.expr("INTERVAL '1' DAY"), "total_calls": F.lit(1).cast("bigint"), "total_sms": F.lit(2).cast("bigint")})
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    return R.merge_contacts(c.unionByName(more)).select("owner_id", "number", "name", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "total_calls", "total_sms", F.array_join("tags", ",").alias("tags"))


QUALITY = f"""q AS (SELECT id, (7 + CASE WHEN duration IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(content, '') <> '' THEN 1 ELSE 0 END + {{0}}) / 10 AS completeness,
 CASE source WHEN 'carrier' THEN 0.9::DOUBLE WHEN 'device' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS trust, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - (epoch({NOW}) - floor(epoch(ts))) / 86400.0::DOUBLE / 7)) AS f FROM {{1}}),
quality AS (SELECT id, completeness, trust, round(f, 3) AS freshness, round(completeness * 0.4::DOUBLE + trust * 0.4::DOUBLE + f * 0.2::DOUBLE, 3) AS quality FROM q)"""


@query(with_views(", " + QUALITY.format("CASE WHEN contact_id IS NOT NULL THEN 1 ELSE 0 END", "comm") + " SELECT * FROM quality", "comm"))
def r15_event_quality(spark, sf_dir):
    return R.event_quality(view(spark, sf_dir, "comm"), AS_OF)


WEIGHTED = """, s AS (SELECT id_a, id_b, gap_us, type_a, type_b, 0.30::DOUBLE + CASE WHEN gap_us = 0 THEN 1.0::DOUBLE WHEN gap_us / 1e6 <= 60 THEN 0.9 WHEN gap_us / 1e6 <= 300 THEN 0.8 WHEN gap_us / 1e6 <= 900 THEN 0.6 WHEN gap_us / 1e6 <= 3600 THEN 0.4 WHEN gap_us / 1e6 <= 86400 THEN 0.2 ELSE 0.0 END * 0.25::DOUBLE
 + CASE WHEN coalesce(duration_a, 0) = coalesce(duration_b, 0) THEN 1.0::DOUBLE ELSE (SELECT CASE WHEN x <= 0.05 THEN 0.9::DOUBLE WHEN x <= 0.15 THEN 0.7 WHEN x <= 0.3 THEN 0.5 WHEN x <= 0.5 THEN 0.3 ELSE 0.1 END FROM (SELECT abs(coalesce(duration_a, 0) - coalesce(duration_b, 0)) / greatest(coalesce(duration_a, 0), coalesce(duration_b, 0)) AS x)) END * 0.15::DOUBLE
 + CASE WHEN content_a IS NULL AND content_b IS NULL THEN 1.0::DOUBLE WHEN len(list_distinct(wa || wb)) = 0 THEN 1.0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(wa || wb)) END * 0.20::DOUBLE + CASE WHEN type_a = type_b THEN 1.0::DOUBLE ELSE 0.0 END * 0.10::DOUBLE AS s
 FROM (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(coalesce(content_a, '')), '\\W+')), lambda w: w <> '') AS wa, list_filter(list_distinct(regexp_split_to_array(lower(coalesce(content_b, '')), '\\W+')), lambda w: w <> '') AS wb FROM pairs))"""


@query(with_views(COPIES + PAIRS.format(300) + WEIGHTED + " SELECT id_a, id_b, round(s, 4) AS similarity FROM s", "comm"))
def r07_weighted_similarity(spark, sf_dir):
    return R.weighted_similarity(matching.near_pairs(with_copies(spark, sf_dir), ["owner_id", "number"], 300)).select("id_a", "id_b", "similarity")


@query(with_views(COPIES + PAIRS.format(300) + """, s AS (SELECT id_a, id_b, round(0.4::DOUBLE + 0.3::DOUBLE + CASE WHEN type_a = type_b THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN direction_a = direction_b THEN 0.15::DOUBLE ELSE 0 END, 4) AS similarity FROM pairs)
SELECT * FROM s WHERE similarity >= 0.85""", "comm"))
def r11_similar_events(spark, sf_dir):
    return R.similar_events(with_copies(spark, sf_dir))


def conflicts_and_quality(spark, sf_dir):
    events = with_copies(spark, sf_dir).withColumn("contact_id", F.lit(None).cast("bigint"))
    return events, matching.event_conflicts(events, 1), R.event_quality(events, AS_OF)


CONFLICTS = ", c AS (SELECT id_a, id_b, " + CONFLICT_CASES + """ FROM pairs), """ + QUALITY.format("0", "twice") + """,
res AS (SELECT c.*, a.quality AS quality_a, b.quality AS quality_b, CASE WHEN similarity >= 0.9 AND abs(a.quality - b.quality) > 0.2 THEN 'automatic' WHEN similarity >= 0.8 AND abs(a.quality - b.quality) <= 0.1 THEN 'merge' ELSE 'manual' END AS strategy, CASE WHEN strategy = 'manual' OR a.quality >= b.quality THEN id_a ELSE id_b END AS keep
 FROM c JOIN quality a ON a.id = id_a JOIN quality b ON b.id = id_b)"""


@query(with_views(COPIES + CONFLICT_PAIRS + CONFLICTS + " SELECT * FROM res", "comm"))
def r16_resolutions(spark, sf_dir):
    _, conflicts, quality = conflicts_and_quality(spark, sf_dir)
    return R.resolutions(conflicts, quality)


@query(with_views(COPIES + CONFLICT_PAIRS + CONFLICTS + " SELECT conflict, count(*) AS conflicts, count(*) FILTER (strategy = 'automatic') AS automatic, count(*) FILTER (strategy = 'merge') AS merged, count(*) FILTER (strategy = 'manual') AS manual, round(avg(similarity), 4) AS similarity FROM res GROUP BY 1", "comm"))
def r17_conflict_metrics(spark, sf_dir):
    _, conflicts, quality = conflicts_and_quality(spark, sf_dir)
    return R.conflict_metrics(R.resolutions(conflicts, quality))


@query(with_views(COPIES + CONFLICT_PAIRS + CONFLICTS + """, m AS (SELECT res.*, CASE WHEN keep = id_a THEN a.duration ELSE b.duration END AS d1, CASE WHEN keep = id_a THEN b.duration ELSE a.duration END AS d2, CASE WHEN keep = id_a THEN a.content ELSE b.content END AS c1, CASE WHEN keep = id_a THEN b.content ELSE a.content END AS c2,
 CASE WHEN keep = id_a THEN a.source ELSE b.source END AS source FROM res JOIN twice a ON a.id = id_a JOIN twice b ON b.id = id_b)
SELECT id_a, id_b, keep, CAST(CASE WHEN abs(d1 - d2) <= 2 THEN greatest(d1, d2) ELSE coalesce(d1, d2) END AS BIGINT) AS duration, coalesce(c1, c2) AS content, source FROM m""", "comm"))
def r19_merged_pairs(spark, sf_dir):
    events, conflicts, quality = conflicts_and_quality(spark, sf_dir)
    return R.merged_pairs(events, R.resolutions(conflicts, quality)).drop("contact_id")


@query(with_views("SELECT id, CAST(CASE WHEN there THEN duration + 5 ELSE duration END AS BIGINT) AS duration, CASE WHEN there THEN NULL ELSE content END AS content, CASE WHEN there THEN 'carrier' ELSE source END AS source, CASE WHEN there THEN 'remote' ELSE 'local' END AS origin FROM (SELECT *, id % 4 = 0 AS there FROM comm)", "comm"))
def r21_server_wins(spark, sf_dir):
    local = view(spark, sf_dir, "comm")
    remote = local.where("id % 4 = 0").select("id", (F.col("duration") + 5).alias("duration"), F.lit(None).cast("string").alias("content"), F.lit("carrier").alias("source"))
    return R.server_wins(local, remote).withColumn("duration", F.col("duration").cast("bigint"))


@query(with_views(COPIES + CONFLICT_PAIRS + CONFLICTS + " SELECT id_a, id_b, conflict, CASE conflict WHEN 'exact' THEN 'critical' WHEN 'time_variance' THEN 'high' ELSE 'medium' END AS priority, conflict = 'fuzzy' AS manual, CAST((row_number() OVER (PARTITION BY priority ORDER BY id_a % 64, id_a, id_b) - 1) // 50 AS BIGINT) AS batch FROM c", "comm"))
def r23_triage(spark, sf_dir):
    return R.triage(matching.event_conflicts(with_copies(spark, sf_dir), 1))


@query(with_views(COPIES + f", k AS (SELECT count(*) AS before, count(DISTINCT {EXACT}) AS after FROM twice), r AS (SELECT *, (before - after) / greatest(before, 1) AS rate FROM k) SELECT before, after, round(greatest(0.0, least(1.0, 0.8::DOUBLE + rate * 0.3::DOUBLE - CASE WHEN rate > 0.5 THEN (rate - 0.5) * 0.4 ELSE 0 END)), 4) AS quality FROM r", "comm"))
def r05_dedup_quality(spark, sf_dir):
    events = with_copies(spark, sf_dir)
    return R.dedup_quality(events, R.first_of_key(events, R.composite_key()))


#: Contents that say something: the words of a message beside its number, so that owners have like ones.
TOLD = """, told AS (SELECT * REPLACE (CASE WHEN content IS NOT NULL THEN concat_ws(' ', 'message', 'about', 'order', content, CASE WHEN id % 3 = 0 THEN 'again' END, CASE WHEN id % 4 = 0 THEN 'please call back soon' END) END AS content) FROM twice)"""


def told(spark, sf_dir):
    e, i = with_copies(spark, sf_dir), F.col("id")
    said = F.concat_ws(" ", F.lit("message"), F.lit("about"), F.lit("order"), "content", F.when(i % 3 == 0, "again"), F.when(i % 4 == 0, "please call back soon"))
    return e.withColumn("content", F.when(F.col("content").isNotNull(), said))


SAID = "list_filter(list_distinct(regexp_split_to_array(lower(content), '\\W+')), lambda w: w <> '') AS w"


@query(recursive(with_views(COPIES + TOLD + f""", x AS (SELECT *, sha256(concat_ws('|', CAST(owner_id AS VARCHAR), number, CAST({T} AS VARCHAR), type, direction, coalesce(CAST(duration AS VARCHAR), '-'))) AS k FROM told),
e AS (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY ts, id) AS d FROM x), left1 AS (SELECT * FROM told WHERE id IN (SELECT id FROM e WHERE id = d)),
y AS (SELECT *, {BUCKET} AS k FROM left1), b AS (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY ts, id) AS d FROM y), left2 AS (SELECT * FROM left1 WHERE id IN (SELECT id FROM b WHERE id = d))"""
+ PAIRS.format(300).replace("FROM twice a JOIN twice b", "FROM left2 a JOIN left2 b") + WEIGHTED + f""",
fuzzy AS (SELECT id_b AS id, min(id_a) AS d FROM s WHERE round(s, 4) >= 0.7 GROUP BY id_b),
texts AS (SELECT owner_id, w, list(id) AS ids FROM (SELECT id, owner_id, list_sort(w) AS w FROM (SELECT id, owner_id, {SAID} FROM left2 WHERE length(content) > 10 AND id NOT IN (SELECT id FROM fuzzy))) GROUP BY 1, 2),
near AS (SELECT unnest(b.ids) AS id, list_min(a.ids) AS d FROM texts a JOIN texts b ON a.owner_id = b.owner_id AND len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(a.w || b.w))),
links AS (SELECT id, d, 'exact' AS stage FROM e WHERE id <> d UNION ALL SELECT id, d, 'bucketed' FROM b WHERE id <> d UNION ALL SELECT id, d, 'fuzzy' FROM fuzzy UNION ALL SELECT id, min(d), 'content' FROM near WHERE d < id GROUP BY id),
r AS (SELECT id, d, stage FROM links UNION ALL SELECT r.id, links.d, r.stage FROM r JOIN links ON links.id = r.d)
SELECT id, d AS duplicate_of, stage FROM r WHERE d NOT IN (SELECT id FROM links)""", "comm")))
def r08_staged_duplicates(spark, sf_dir):
    return R.staged_duplicates(told(spark, sf_dir), by_content=True)


@query("""WITH m AS (SELECT doc_id AS id, lang, list_sort(list_filter(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\W+')), lambda w: w <> '')) AS w FROM documents),
c AS (SELECT min(id) AS rep, lang, w, len(w) AS n FROM m WHERE len(w) > 0 GROUP BY lang, w)
SELECT a.rep AS id_a, b.rep AS id_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS similarity FROM c a JOIN c b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rep < b.rep AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
WHERE len(list_intersect(a.w, b.w)) >= 0.8 * len(list_distinct(a.w || b.w))""")
def r08_similar_texts(spark, sf_dir):
    """Classes of texts of one language that share four fifths of their distinct words or more."""
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", S.words(F.col("text")).alias("words"))
    _, pairs = similar_sets(m, 0.8, ("lang",))
    return pairs.select(F.col("rep_a").alias("id_a"), F.col("rep_b").alias("id_b"), F.round("similarity", 6).alias("similarity"))
