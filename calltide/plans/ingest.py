"""Queries over ingestion, personal data and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from calltide.functions import masks as M
from calltide.functions import normalize as N
from calltide.functions import similarity as S
from calltide.operators import ingest as I
from calltide.operators import personal_data as PD
from calltide.operators import vectors as V
from calltide.plans.adapter import view, with_views
from calltide.plans.registry import query, table

#: Raw records made of the log: every field in several spellings, some of them bad.
RAW_SQL = """, raw AS (SELECT id, CASE id % 5 WHEN 0 THEN number WHEN 1 THEN substr(number, 3) WHEN 2 THEN '(' || substr(number, 3, 3) || ') ' || substr(number, 6, 3) || '-' || substr(number, 9) WHEN 3 THEN '1-' || substr(number, 3) ELSE CASE WHEN id % 35 = 4 THEN 'n/a' ELSE number END END AS number,
 CASE id % 4 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%m/%d/%Y %H:%M') WHEN 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) ELSE CASE WHEN id % 44 = 3 THEN 'soon' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END END AS ts,
 CASE WHEN duration IS NULL THEN '' WHEN id % 3 = 0 THEN CAST(duration AS VARCHAR) WHEN id % 3 = 1 THEN CAST(duration // 60 AS VARCHAR) || ':' || lpad(CAST(duration % 60 AS VARCHAR), 2, '0') ELSE CAST(duration // 60 AS VARCHAR) || 'm ' || CAST(duration % 60 AS VARCHAR) || 's' END AS duration,
 CASE WHEN type = 'call' THEN 'Voice' ELSE 'SMS' END AS type, CASE WHEN direction = 'inbound' THEN 'Incoming' ELSE 'sent' END AS direction, content FROM comm)"""


def raw(spark, sf_dir):
    c, n, d = view(spark, sf_dir, "comm"), F.col("number"), F.col("duration")
    at = F.col("ts").cast("timestamp")
    fmt = lambda f: F.date_format("ts", f)
    number = (
        F.when(F.col("id") % 5 == 0, n).when(F.col("id") % 5 == 1, F.substring(n, 3, 20)).when(F.col("id") % 5 == 2, F.concat(F.lit("("), F.substring(n, 3, 3), F.lit(") "), F.substring(n, 6, 3), F.lit("-"), F.substring(n, 9, 9)))
        .when(F.col("id") % 5 == 3, F.concat(F.lit("1-"), F.substring(n, 3, 20))).when(F.col("id") % 35 == 4, "n/a").otherwise(n)
    )
    ts = F.when(F.col("id") % 4 == 0, fmt("yyyy-MM-dd HH:mm:ss")).when(F.col("id") % 4 == 1, fmt("MM/dd/yyyy HH:mm")).when(F.col("id") % 4 == 2, F.unix_timestamp(at).cast("string")).when(F.col("id") % 44 == 3, "soon").otherwise(fmt("yyyy-MM-dd'T'HH:mm:ss"))
    minutes = F.floor(d / 60).cast("string")
    duration = F.when(d.isNull(), "").when(F.col("id") % 3 == 0, d.cast("string")).when(F.col("id") % 3 == 1, F.concat(minutes, F.lit(":"), F.lpad((d % 60).cast("string"), 2, "0"))).otherwise(F.concat(minutes, F.lit("m "), (d % 60).cast("string"), F.lit("s")))
    return c.select("id", number.alias("number"), ts.alias("ts"), duration.alias("duration"), F.when(F.col("type") == "call", "Voice").otherwise("SMS").alias("type"), F.when(F.col("direction") == "inbound", "Incoming").otherwise("sent").alias("direction"), "content")


NORM = RAW_SQL + """, norm AS (SELECT id, CASE WHEN id % 35 = 4 AND id % 5 = 4 THEN NULL ELSE number END AS number, CASE WHEN id % 44 = 3 AND id % 4 = 3 THEN NULL WHEN id % 4 = 1 THEN CAST(floor(epoch(date_trunc('minute', ts))) AS BIGINT) ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS at,
 CAST(duration AS BIGINT) AS duration, type, direction, content FROM comm),
err AS (SELECT *, number IS NULL AS bad_number, at IS NULL AS bad_ts, duration > 86400 AS bad_duration, 4 + CASE WHEN duration IS NULL THEN 0 ELSE 1 END AS filled FROM norm)""".replace(" AS at,", " AS at_s,").replace("at IS NULL", "at_s IS NULL")


@query(with_views(NORM + " SELECT id, number, at_s, CASE WHEN bad_duration THEN NULL ELSE duration END AS duration, type, direction, concat_ws(',', CASE WHEN bad_number THEN 'number:invalid' END, CASE WHEN bad_ts THEN 'ts:invalid' END, CASE WHEN bad_duration THEN 'duration:invalid' END) AS errors, round((filled - CAST(bad_number AS INT) - CAST(bad_ts AS INT) - CAST(coalesce(bad_duration, false) AS INT)) / filled, 4) AS quality FROM err", "comm"))
def e16_normalize_records(spark, sf_dir):
    n = I.normalize_records(raw(spark, sf_dir))
    return n.select("id", "number", F.unix_timestamp("ts").alias("at_s"), F.col("duration").cast("bigint").alias("duration"), "type", "direction", F.array_join("errors", ",").alias("errors"), "quality")


@query(with_views(NORM + " SELECT 'number' AS field, 'invalid' AS reason, count(*) AS records FROM err WHERE bad_number UNION ALL SELECT 'ts', 'invalid', count(*) FROM err WHERE bad_ts", "comm"))
def e18_validation_stats(spark, sf_dir):
    return I.validation_stats(I.validate(I.normalize_records(raw(spark, sf_dir))))


@query(with_views(NORM + ", g AS (SELECT count(*) AS records, count(*) FILTER (NOT bad_number AND NOT bad_ts) AS valid, CAST(sum(CAST(bad_number AS INT) + CAST(bad_ts AS INT) + CAST(coalesce(bad_duration, false) AS INT)) AS BIGINT) AS errors, count(*) FILTER (bad_number OR bad_ts) AS critical FROM err) SELECT records, valid, errors, round(greatest(0.0, valid / records - least(0.5, 2 * errors / records) - least(0.3, 5 * critical / records)), 4) AS score FROM g", "comm"))
def e21_batch_quality(spark, sf_dir):
    return I.batch_quality(I.validate(I.normalize_records(raw(spark, sf_dir))))


@query(with_views(NORM + ", v AS (SELECT * FROM err WHERE NOT bad_number AND NOT bad_ts) SELECT number, min(at_s) AS first_s, max(at_s) AS last_s, count(*) FILTER (type = 'call') AS total_calls, count(*) FILTER (type = 'sms') AS total_sms FROM v GROUP BY 1", "comm"))
def e23_extract_contacts(spark, sf_dir):
    valid, _ = I.split_valid(I.validate(I.normalize_records(raw(spark, sf_dir))))
    c = I.extract_contacts(valid)
    return c.select("number", F.unix_timestamp("first_seen").alias("first_s"), F.unix_timestamp("last_seen").alias("last_s"), "total_calls", "total_sms")


@query(with_views("SELECT id, '(' || substr(number, 3, 3) || ') ' || substr(number, 6, 3) || '-' || substr(number, 9) AS shown, CASE WHEN duration >= 3600 THEN CAST(duration // 3600 AS VARCHAR) || ':' || lpad(CAST((duration // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(duration % 60 AS VARCHAR), 2, '0') WHEN duration IS NOT NULL THEN CAST(duration // 60 AS VARCHAR) || ':' || lpad(CAST(duration % 60 AS VARCHAR), 2, '0') END AS length FROM comm", "comm"))
def c12_formats(spark, sf_dir):
    return view(spark, sf_dir, "comm").select("id", N.format_phone(F.col("number")).alias("shown"), N.format_duration(F.col("duration")).alias("length"))


@query(with_views("""SELECT id, substr(number, 1, 3) || '-***-' || right(number, 4) AS masked, substr(number, 1, 3) || repeat('*', length(number) - 7) || right(number, 4) AS partial, CAST(CAST(floor(duration / 10) AS BIGINT) * 10 AS VARCHAR) || '-' || CAST(CAST(floor(duration / 10) AS BIGINT) * 10 + 9 AS VARCHAR) AS tens,
 CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS day_s, left(sha256('salt' || number), 16) AS token FROM comm""", "comm"))
def g18_masks(spark, sf_dir):
    n = F.col("number")
    return view(spark, sf_dir, "comm").select("id", M.mask_number(n).alias("masked"), M.partial_mask(n).alias("partial"), M.number_range(F.col("duration"), 1).alias("tens"), F.unix_timestamp(M.time_range(F.col("ts"), 2).cast("timestamp")).alias("day_s"), M.hash_token(n, "salt").alias("token"))


@query(with_views("SELECT tens, day, count(*) AS n, count(*) >= 5 AS anonymous FROM (SELECT floor(coalesce(duration, -1) / 10) * 10 AS tens, strftime(ts, '%d') AS day FROM comm) GROUP BY 1, 2".replace("floor(coalesce(duration, -1) / 10) * 10", "CAST(floor(coalesce(duration, -1) / 10) AS BIGINT) * 10"), "comm"))
def g20_k_anonymity(spark, sf_dir):
    c = view(spark, sf_dir, "comm").select((F.floor(F.coalesce("duration", F.lit(-1)) / 10**M.k_level(5)) * 10).alias("tens"), F.date_format("ts", "dd").alias("day"))
    return c.groupBy("tens", "day").agg(F.count("*").alias("n"), (F.count("*") >= 5).alias("anonymous"))


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS email, len(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s<>"]+')) AS url FROM documents""")
def g15_pii_counts(spark, sf_dir):
    return I.pii_counts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "email", "url")


@query()
def g15_pii_spans(spark, sf_dir):
    return I.pii_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '\\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\\.[A-Za-z]{2,24}\\b', '[EMAIL]', 'gi'), '\\b[A-Za-z0-9._%+-]{1,64}\\s{0,4}@\\s{0,4}[A-Za-z0-9-]{1,63}\\s{0,4}\\.\\s{0,4}[A-Za-z]{2,24}\\b', '[EMAIL]', 'gi')) AS redacted FROM documents")
def g16_redact_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(PD.masked_kind(F.coalesce("text", F.lit("")), "email_address")).alias("redacted"))


@query()
def g16_anonymized_texts(spark, sf_dir):
    """All texts with every kind of personal data rewritten by its strategy, and what that preserves."""
    out = PD.anonymize_texts(table(spark, sf_dir, "documents"), "doc_id", "text", key=b"an example's key")
    return out.select("doc_id", F.sha2("anonymized", 256).alias("anonymized_sha256"), F.size("spans").alias("spans"), "quality", "length_ratio", "structure", "context")


@query()
def g15_kinds_of_personal_data(spark, sf_dir):
    return PD.span_counts(PD.find_spans(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(lower(text), 'winner|free|prize|click here|congratulations|urgent') THEN 'spam' WHEN regexp_matches(lower(text), 'meeting|invoice|project|deadline|client|report') THEN 'business' WHEN regexp_matches(lower(text), 'love|mom|dad|dinner|birthday|home') THEN 'personal' ELSE 'general' END AS class FROM conversations""")
def e24_content_class(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", I.content_class(F.col("text")).alias("class"))


@query()
def e24_content_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", I.content_language(F.col("text")).alias("found")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0 ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END, 4) AS ratio FROM part")
def c11_edit_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"), F.round(S.edit_ratio(F.col("p_name"), F.col("p_type")), 4).alias("ratio"))


@query(with_views("""
, n AS (SELECT id, CASE WHEN id % 2 = 0 THEN duration + 1 END AS duration, 'new' AS source FROM comm WHERE id % 3 = 0 UNION ALL SELECT id + 50000000, duration, 'new' FROM comm WHERE id % 9 = 0)
SELECT coalesce(c.id, n.id) AS id, CAST(coalesce(n.duration, c.duration) AS BIGINT) AS duration, coalesce(n.source, c.source) AS source FROM comm c FULL JOIN n ON c.id = n.id""", "comm"))
def s22_upsert_events(spark, sf_dir):
    c = view(spark, sf_dir, "comm").select("id", "duration", "source")
    n = c.where("id % 3 = 0").withColumns({"duration": F.when(F.col("id") % 2 == 0, F.col("duration") + 1), "source": F.lit("new")})
    n = n.unionByName(c.where("id % 9 = 0").withColumns({"id": F.col("id") + 50_000_000, "source": F.lit("new")}))
    return I.merge_insert(c, n, ["id"], ["duration", "source"]).withColumn("duration", F.col("duration").cast("bigint"))


@query(with_views("SELECT 'taken' AS part, count(*) AS events FROM comm WHERE id % 5 <> 0 UNION ALL SELECT 'again', count(*) FROM comm WHERE id % 5 = 0 AND id % 3 = 0", "comm"))
def s23_insert_new(spark, sf_dir):
    c = view(spark, sf_dir, "comm").select("owner_id", "line_id", "ts", "number", "direction", "duration", "id")
    everything, again = I.insert_new(c.where("id % 5 = 0"), c.where("id % 5 <> 0 OR id % 3 = 0"), ["owner_id", "line_id", "ts", "number", "direction", "duration"])
    return everything.where("id % 5 <> 0").agg(F.lit("taken").alias("part"), F.count("*").alias("events")).unionByName(again.agg(F.lit("again").alias("part"), F.count("*").alias("events")))


@query(with_views("""
, n AS (SELECT owner_id, number, CASE WHEN id % 2 = 0 THEN 'New ' || name END AS name, first_seen + INTERVAL 1 DAY AS first_seen, last_seen + INTERVAL 1 DAY AS last_seen, 5::BIGINT AS total_calls, 7::BIGINT AS total_sms FROM contacts WHERE id % 3 = 0)
SELECT c.owner_id, c.number, coalesce(n.name, c.name) AS name, CAST(epoch_us(least(c.first_seen, coalesce(n.first_seen, c.first_seen))) AS BIGINT) AS first_us, CAST(epoch_us(greatest(c.last_seen, coalesce(n.last_seen, c.last_seen))) AS BIGINT) AS last_us, c.total_calls + coalesce(n.total_calls, 0) AS total_calls, c.total_sms + coalesce(n.total_sms, 0) AS total_sms FROM contacts c LEFT JOIN n USING (owner_id, number)""", "contacts"))
def s24_upsert_contacts(spark, sf_dir):
    c = view(spark, sf_dir, "contacts").select("id", "owner_id", "number", "name", "first_seen", "last_seen", "total_calls", "total_sms")
    day = F.expr("INTERVAL '1' DAY")
    n = c.where("id % 3 = 0").withColumns({"name": F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), F.col("name"))), "first_seen": F.col("first_seen") + day, "last_seen": F.col("last_seen") + day, "total_calls": F.lit(5).cast("bigint"), "total_sms": F.lit(7).cast("bigint")})
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    return I.upsert_contacts(c.drop("id"), n.drop("id")).select("owner_id", "number", "name", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "total_calls", "total_sms")


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.id AS ask_id, b.id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.id % 20 = 0 AND a.id <> b.id)
SELECT ask_id, id, place, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY s DESC, id) AS place FROM p) WHERE place <= 5""")
def v01_similar_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.similar_vectors(e, e.where("id % 20 = 0").withColumnRenamed("id", "ask_id"), 5).withColumn("similarity", F.round("similarity", 6))


@query("""WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.id AS ask_id, b.id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.id % 20 = 0 AND a.id <> b.id AND a.label = b.label WHERE list_cosine_similarity(a.v, b.v) >= 0.2)
SELECT ask_id, id, place, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY s DESC, id) AS place FROM p) WHERE place <= 3""")
def v02_template_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return V.similar_vectors(e, e.where("id % 20 = 0").withColumnRenamed("id", "ask_id"), 3, 0.2, same="label").withColumn("similarity", F.round("similarity", 6))


@query("""SELECT * FROM (SELECT 'query' AS kind, c_mktsegment AS text, count(*) AS uses FROM customer GROUP BY 2 ORDER BY uses DESC, text LIMIT 3) UNION ALL SELECT * FROM (SELECT 'template' AS kind, o_orderpriority AS text, count(*) AS uses FROM orders GROUP BY 2 ORDER BY uses DESC, text LIMIT 3)""")
def v05_popular(spark, sf_dir):
    uses = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("text")).agg(F.count("*").alias("uses"))
    return V.popular(uses("customer", "c_mktsegment"), uses("orders", "o_orderpriority"), 3)


@query(with_views("SELECT id, contact_id, CAST(duration AS BIGINT) AS duration FROM comm WHERE type = 'call' AND duration >= 300", "comm"))
def v07_template_long_calls(spark, sf_dir):
    return V.run_template(spark, "long_calls", view(spark, sf_dir, "comm"), 10_000_000, seconds=300).withColumn("duration", F.col("duration").cast("bigint"))


@query(with_views("SELECT contact_id, count(*) AS calls FROM comm WHERE type = 'call' AND dayofweek(ts) IN (0, 6) GROUP BY 1", "comm"))
def v08_weekend_calls(spark, sf_dir):
    return V.answer(view(spark, sf_dir, "comm"), "Who do I call on weekends?")
