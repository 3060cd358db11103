"""Queries over schema rules, error records and scores of batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltide.operators import ingest as I
from calltide.operators import mapping as M
from calltide.operators import schema as R
from calltide.plans.adapter import with_views
from calltide.plans.ingest import NORM, RAW_SQL, raw
from calltide.plans.registry import query

#: Rules of users beside those that events come with: two custom ones and one of another column.
EXTRA = [
    {"entity": "event", "field": "duration", "kind": "custom", "validator": "plain_number", "message": "Duration isn't written as seconds", "position": 20},
    {"entity": "event", "field": "number", "kind": "custom", "validator": "not_blank", "message": "Number is blank", "position": 21},
    {"entity": "event", "field": "id", "kind": "range", "low": 100.0, "message": "Row out of range", "position": 22},
]
MAPPINGS = [
    ("number", "number", "string", "phone_normalize", True), ("ts", "ts", "date", "timestamp_normalize", True), ("duration", "duration", "string", "duration_seconds", False),
    ("type", "type", "string", "lowercase", True), ("direction", "direction", "string", "lowercase", True), ("place", "place", "string", None, False), ("content", "note", "string", "unknown", False),
]


def event_rules(spark):
    return R.default_rules(spark).unionByName(R.rules_table(spark, EXTRA))


def checked(spark, sf_dir):
    return R.check(raw(spark, sf_dir), event_rules(spark), "event", {"plain_number": lambda c: c.rlike(r"^\d*$")})


CHECKED = RAW_SQL + r""", k AS (SELECT *, TRY_CAST(ts AS TIMESTAMP) IS NOT NULL OR try_strptime(ts, '%m/%d/%Y %H:%M') IS NOT NULL AS time_ok, regexp_matches(number, '^\+?1?[0-9]{10,15}$') AS number_ok,
 CASE WHEN duration = '' THEN 0.0 ELSE TRY_CAST(duration AS DOUBLE) END AS d FROM raw),
c AS (SELECT *, concat_ws(',', CASE WHEN NOT time_ok THEN 'ts:format' END, CASE WHEN NOT number_ok THEN 'number:format' END, 'type:format', 'direction:format',
 CASE WHEN d IS NULL OR d < 0 OR d > 86400 THEN 'duration:range' END, CASE WHEN NOT regexp_matches(duration, '^[0-9]*$') THEN 'duration:custom' END, CASE WHEN id < 100 THEN 'id:range' END) AS errors FROM k)"""


@query(with_views(CHECKED + " SELECT id, errors, CASE WHEN content IS NULL THEN 0 ELSE 1 END AS warnings, errors = '' AS is_valid FROM c", "comm"))
def e17_schema_rules(spark, sf_dir):
    c = checked(spark, sf_dir)
    return c.select("id", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["kind"])), ",").alias("errors"), F.size("warnings").alias("warnings"), "is_valid")


@query(with_views(CHECKED + ", e AS (SELECT unnest(string_split(errors, ',')) AS e FROM c WHERE errors <> '') SELECT split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS kind, count(*) AS records FROM e GROUP BY 1, 2 ORDER BY records DESC, field, kind LIMIT 10", "comm"))
def e17_rule_statistics(spark, sf_dir):
    return R.rule_statistics(checked(spark, sf_dir)).drop("message")


MAPPED = RAW_SQL + r""", digits AS (SELECT *, regexp_replace(number, '[^0-9]', '', 'g') AS n, CASE WHEN duration LIKE '%:%' THEN CAST(split_part(duration, ':', 1) AS DOUBLE) * 60 + CAST(split_part(duration, ':', 2) AS DOUBLE) ELSE coalesce(TRY_CAST(regexp_extract(duration, '^[0-9]+') AS DOUBLE), 0) END AS d,
 TRY_CAST(ts AS TIMESTAMP) IS NOT NULL OR try_strptime(ts, '%m/%d/%Y %H:%M') IS NOT NULL AS time_ok FROM raw),
c AS (SELECT id, CASE WHEN length(n) = 10 THEN '+1' || n ELSE '+' || n END AS number, d, concat_ws(',', CASE WHEN NOT time_ok THEN 'ts:format' END, CASE WHEN length(n) < 10 THEN 'number:format' END, CASE WHEN lower(type) <> 'sms' THEN 'type:format' END, CASE WHEN lower(direction) <> 'incoming' THEN 'direction:format' END, CASE WHEN d > 86400 THEN 'duration:range' END) AS errors, content FROM digits)"""


@query(with_views(MAPPED + " SELECT id, number, CAST(d AS BIGINT) AS duration, errors, CASE WHEN content IS NULL THEN 0 ELSE 1 END AS warnings FROM c", "comm"))
def e17_mapped_records(spark, sf_dir):
    """Fields by a table of mappings with named transformations, then the rules that events come with."""
    m = R.map_record(raw(spark, sf_dir), spark.createDataFrame(MAPPINGS, R.MAPPINGS), keep=("id",))
    c = R.check(m, R.default_rules(spark), "event", known=("id",))
    return c.select("id", "number", F.col("duration").cast("bigint").alias("duration"), F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["kind"])), ",").alias("errors"), F.size("warnings").alias("warnings"))


@query(with_views(CHECKED + """, e AS (SELECT id AS row, e FROM (SELECT id, unnest(string_split(errors, ',')) AS e FROM c WHERE errors <> '') UNION ALL SELECT id, 'content:warning' FROM c WHERE content IS NOT NULL)
SELECT e.row, split_part(e, ':', 1) AS field, CASE WHEN e = 'ts:format' THEN 'invalid_data_type' WHEN e = 'duration:range' THEN CASE WHEN d IS NULL THEN 'invalid_data_type' ELSE 'constraint_violation' END WHEN e = 'id:range' THEN 'constraint_violation' ELSE 'validation_error' END AS type,
 CASE WHEN e = 'content:warning' THEN 'warning' ELSE 'error' END AS severity, 'job-1' AS job FROM e JOIN c ON c.id = e.row""", "comm"))
def e25_error_records(spark, sf_dir):
    return R.error_records(checked(spark, sf_dir), "job-1", "id").select("row", "field", "type", "severity", "job")


@query(with_views(NORM + """, b AS (SELECT id % 10 AS batch, count(*) AS total, count(*) FILTER (NOT bad_number AND NOT bad_ts) AS parsed, count(*) FILTER (NOT bad_number AND NOT bad_ts AND coalesce(bad_duration, false)) AS validation_errors,
 count(DISTINCT number || '|' || at_s || '|' || type) FILTER (NOT bad_number AND NOT bad_ts) AS uniques, count(*) FILTER (bad_number OR bad_ts) * 100.0::DOUBLE / count(*) AS error_rate,
 avg(round((filled - CAST(bad_number AS INT) - CAST(bad_ts AS INT) - CAST(coalesce(bad_duration, false) AS INT)) / filled, 4)) AS normalization, avg((2 + CASE WHEN number IS NULL THEN 0 ELSE 1 END + CASE WHEN at_s IS NULL THEN 0 ELSE 1 END) / 4.0::DOUBLE) AS completeness FROM err GROUP BY 1),
s AS (SELECT *, parsed - uniques AS duplicates, CASE WHEN batch = 3 THEN 60.0::DOUBLE END AS gap_score FROM b)
SELECT batch, total, parsed, duplicates, round(0.4::DOUBLE * parsed / total + 0.4::DOUBLE * (parsed - validation_errors) / parsed + 0.2::DOUBLE * (1 - duplicates / parsed), 6) AS parse_score,
 round(least(100 - 0.5::DOUBLE * error_rate - CASE WHEN duplicates > 0 THEN least(0.3::DOUBLE * duplicates * 100 / uniques, 20.0::DOUBLE) ELSE 0 END, coalesce(gap_score, 100)), 6) AS etl_score,
 round(0.25::DOUBLE * 0.9::DOUBLE + 0.3::DOUBLE * normalization + 0.25::DOUBLE * 0.99::DOUBLE + 0.2::DOUBLE * completeness, 6) AS pipeline_score FROM s""", "comm"))
def e22_batch_scores(spark, sf_dir):
    n = I.normalize_records(raw(spark, sf_dir))
    bad = lambda f: F.exists("errors", lambda e: e.startswith(f))
    read = ~bad("number:") & ~bad("ts:")
    key = F.concat_ws("|", "number", F.unix_timestamp("ts").cast("string"), "type")
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("ts", "number", "type", "direction")) / 4
    b = n.groupBy((F.col("id") % 10).alias("batch")).agg(
        F.count("*").alias("total"), F.count_if(read).alias("parsed"), F.count_if(read & bad("duration:")).alias("validation_errors"), F.countDistinct(F.when(read, key)).alias("unique"),
        (F.count_if(~read) * 100.0 / F.count("*")).alias("error_rate"), F.avg("quality").alias("normalization"), F.avg(filled).alias("completeness"),
    )
    b = b.withColumns({"duplicates": F.col("parsed") - F.col("unique"), "gap_score": F.when(F.col("batch") == 3, 60.0), "mapping": F.lit(0.9), "duplicate_accuracy": F.lit(0.99)})
    return R.batch_scores(b).select("batch", "total", "parsed", "duplicates", *(F.round(c, 6).alias(c) for c in ("parse_score", "etl_score", "pipeline_score")))


@query(with_views(RAW_SQL + """, n AS (SELECT avg(CASE WHEN trim(ts) <> '' THEN CAST(regexp_matches(lower(ts), '\\d{4}[-/]\\d{2}[-/]\\d{2}|\\d{2}[-/]\\d{2}[-/]\\d{4}|\\d{1,2}:\\d{2}(:\\d{2})?|\\d{10,13}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec') AS INT) END) AS ts,
 avg(CASE WHEN trim(number) <> '' THEN CAST(regexp_matches(lower(number), '\\+?1?\\d{10}|\\(\\d{3}\\)\\s?\\d{3}-\\d{4}|\\d{3}[-\\.]\\d{3}[-\\.]\\d{4}') AS INT) END) AS number, avg(CASE WHEN trim(duration) <> '' THEN CAST(regexp_matches(lower(duration), '\\d+:\\d{2}(:\\d{2})?|\\d+(\\.\\d+)?\\s*(min|sec|hr|hours?|minutes?|seconds?)|^\\d+$') AS INT) END) AS duration,
 avg(CASE WHEN trim(direction) <> '' THEN CAST(regexp_matches(lower(direction), 'in|out|incoming|outgoing|inbound|outbound|received|sent|[io]') AS INT) END) AS direction FROM raw)
SELECT 'Date/Time' AS source, 'ts' AS target, round(0.95::DOUBLE * 0.3 + ts * 0.25 + 0.9::DOUBLE * 0.2 + 0.7::DOUBLE * 0.15 + 0.05 - 0.0, 4) AS confidence FROM n UNION ALL SELECT 'Phone Number', 'number', round(0.95::DOUBLE * 0.3 + number * 0.25 + 0.9::DOUBLE * 0.2 + 0.7::DOUBLE * 0.15 + 0.05, 4) FROM n
UNION ALL SELECT 'Duration', 'duration', round(0.95::DOUBLE * 0.3 + duration * 0.25 + 0.9::DOUBLE * 0.2 + 0.7::DOUBLE * 0.15 + 0.05, 4) FROM n UNION ALL SELECT 'Direction', 'direction', round(0.95::DOUBLE * 0.3 + direction * 0.25 + 0.9::DOUBLE * 0.2 + 0.7::DOUBLE * 0.15 + 0.05, 4) FROM n""", "comm"))
def e02_mapping_confidence(spark, sf_dir):
    """A carrier's file whose columns its default template names: how sure each mapping is by names and all values."""
    names = {"ts": "Date/Time", "number": "Phone Number", "duration": "Duration", "direction": "Direction"}
    file = raw(spark, sf_dir).select(*(F.col(k).alias(v) for k, v in names.items()))
    found, _ = M.suggest_mappings(file, "att")
    return found.select("source", "target", "confidence")
