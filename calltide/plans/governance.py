"""Queries over row policies, tokens, merges with their log, and changes of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.operators import provenance as P
from calltide.operators import row_policies as G
from calltide.operators import tokens as K
from calltide.plans.adapter import view, with_views
from calltide.plans.events import COPIES, with_copies
from calltide.plans.registry import query

ASKERS = [0, 1, 2, 3, 4]
KEY = b"an example's key"


@query(with_views("""
, me AS (SELECT r.user_id AS me, r.org_id AS org, r.role AS my_role FROM roles r WHERE r.user_id < 5),
c AS (SELECT me.me, contacts.id, contacts.owner_id, coalesce(contacts.owner_id = me.me OR (o.org_id = me.org AND (rules.visibility IS NULL OR rules.visibility IN ('team', 'public') OR o.role IN ('owner', 'admin'))), false) AS open FROM me CROSS JOIN contacts LEFT JOIN roles o ON o.user_id = contacts.owner_id LEFT JOIN rules ON rules.contact_id = contacts.id),
n AS (SELECT me.me AS asker, 'events' AS table_name, comm.id FROM me CROSS JOIN comm JOIN roles o ON o.user_id = comm.owner_id LEFT JOIN c ON c.me = me.me AND c.id = comm.contact_id WHERE comm.owner_id = me.me OR (o.org_id = me.org AND (comm.contact_id IS NULL OR coalesce(c.open, false)))
UNION ALL SELECT me, 'contacts', c.id FROM c JOIN roles o ON o.user_id = c.owner_id JOIN me USING (me) WHERE c.owner_id = c.me OR (o.org_id = me.org AND c.open)
UNION ALL SELECT me, 'privacy_rules', rules.contact_id FROM me CROSS JOIN rules JOIN roles o ON o.user_id = rules.owner_id WHERE rules.owner_id = me OR (o.org_id = me.org AND o.role IN ('owner', 'admin', 'analyst'))
UNION ALL SELECT me, 'org_roles', r.user_id FROM me CROSS JOIN roles r WHERE r.user_id = me OR (my_role IN ('owner', 'admin') AND r.org_id = org)
UNION ALL SELECT me, 'audit_log', audit.id FROM me CROSS JOIN audit LEFT JOIN roles o ON o.user_id = audit.actor_id WHERE audit.actor_id = me OR (my_role IN ('owner', 'admin', 'analyst') AND o.org_id = org))
SELECT asker, table_name, count(*) AS visible, CAST(sum(id) AS BIGINT) AS ids FROM n GROUP BY 1, 2""", "comm", "contacts", "rules", "roles", "audit"))
def g03_secured_tables(spark, sf_dir):
    """What each of five users may see of five tables."""
    contacts, rules, roles, policies = view(spark, sf_dir, "contacts"), view(spark, sf_dir, "rules"), view(spark, sf_dir, "roles"), G.default_policies(spark)
    tables = [("events", view(spark, sf_dir, "comm"), "owner_id", "contact_id", "id"), ("contacts", contacts, "owner_id", "id", "id"), ("privacy_rules", rules, "owner_id", "contact_id", "contact_id"), ("org_roles", roles, "user_id", "user_id", "user_id"), ("audit_log", view(spark, sf_dir, "audit").withColumn("resource_id", F.lit(None).cast("long")).withColumn("contact", F.lit(-1).cast("long")), "actor_id", "contact", "id")]
    parts = [
        G.secured(rows, name, policies, roles, asker, owner=owner, contact=contact, contacts=contacts, rules=rules).agg(F.lit(asker).alias("asker"), F.lit(name).alias("table_name"), F.count("*").alias("visible"), F.sum(key).alias("ids"))
        for asker in ASKERS for name, rows, owner, contact, key in tables
    ]
    return reduce(DataFrame.unionByName, parts).where("visible > 0")


BYTES = lambda alphabet, n: " || ".join(f"substr('{alphabet}', CAST(CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER) % {len(alphabet)} AS INTEGER) + 1, 1)" for i in range(n))


@query(with_views(f"SELECT id, {BYTES(K.DIGITS, 10)} AS numeric_token, {BYTES(K.ALPHANUMERIC, 8)} AS short_token, 'T-' || substr(h, 1, 16) || left(md5('T-' || substr(h, 1, 16)), 4) AS checked_token FROM (SELECT id, sha256(number) AS h FROM contacts)", "contacts"))
def g21_hashed_tokens(spark, sf_dir):
    n = F.col("number")
    return view(spark, sf_dir, "contacts").select("id", K.numeric(n).alias("numeric_token"), K.alphanumeric(n).alias("short_token"), K.dressed(K.hashed(n), "T-", "", True).alias("checked_token"))


@query(with_views("SELECT id, true AS restored, true AS same_form, true AS decrypted, (SELECT count(DISTINCT number) FROM comm) AS tokens FROM comm", "comm"))
def g21_reversible_tokens(spark, sf_dir):
    """Numbers as tokens of their form and back, encrypted and back, and how many different tokens all numbers have."""
    c = view(spark, sf_dir, "comm").select("id", "number")
    t = K.format_preserving(K.format_preserving(c, {"number": "token"}, KEY), {"token": "value"}, KEY, back=True)
    form = lambda x: F.regexp_replace(x, "[0-9]", "0")
    n = t.agg(F.countDistinct("token").alias("tokens"))
    key = "0123456789abcdef0123456789abcdef"
    each = t.select("id", (F.col("value") == F.col("number")).alias("restored"), (form("token") == form("number")).alias("same_form"), (K.decrypted(K.encrypted(F.col("number"), key), key) == F.col("number")).alias("decrypted"))
    return each.crossJoin(n)  # of one row


MERGED = COPIES + """, r AS (SELECT id % 10000000 AS entity, id, ts, type, duration, content, source FROM twice),
g AS (SELECT entity, arg_min(id, (CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) AS id, arg_min(type, (CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) AS type, CAST(max(duration) AS BIGINT) AS duration, arg_min(content, (-CAST(length(content) AS HUGEINT) * 10000000000000000000000000 + CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) FILTER (content IS NOT NULL) AS content,
 arg_max(source, (CAST(epoch_us(ts) AS HUGEINT) * 100000000 + id)) AS source, count(*) AS merged, min(type) <> max(type) AS t, coalesce(min(duration) <> max(duration), false) AS d, coalesce(min(content) <> max(content), false) AS c, min(source) <> max(source) AS s, min(ts) <> max(ts) AS ts_differs, min(ts) AS ts FROM r GROUP BY entity)"""


def entities(spark, sf_dir):
    e = with_copies(spark, sf_dir).select((F.col("id") % 10_000_000).alias("entity"), "id", "ts", "type", "duration", "content", "source")
    return P.merge_with_log(e, ["entity"], P.EVENT_RULES | {"source": "last"})


@query(with_views(MERGED + " SELECT entity, id, type, duration, content, source, merged, concat_ws(',', CASE WHEN ts_differs THEN 'ts' END, CASE WHEN t THEN 'type' END, CASE WHEN d THEN 'duration' END, CASE WHEN c THEN 'content' END, CASE WHEN s THEN 'source' END) AS conflicts FROM g", "comm"))
def r12_merged_events(spark, sf_dir):
    merged, _ = entities(spark, sf_dir)
    return merged.drop("ts").withColumns({"conflicts": F.array_join("conflicts", ","), "duration": F.col("duration").cast("bigint")})


@query(with_views(MERGED + """ SELECT r.entity, g.id AS kept_id, 'type' AS field, 'first' AS rule, r.id, r.type AS value, r.type = g.type AS kept FROM g JOIN r USING (entity) WHERE t UNION ALL SELECT r.entity, g.id, 'duration', 'max', r.id, CAST(r.duration AS VARCHAR), r.duration = g.duration FROM g JOIN r USING (entity) WHERE d AND r.duration IS NOT NULL
UNION ALL SELECT r.entity, g.id, 'content', 'longest', r.id, r.content, r.content = g.content FROM g JOIN r USING (entity) WHERE c AND r.content IS NOT NULL UNION ALL SELECT r.entity, g.id, 'source', 'last', r.id, r.source, r.source = g.source FROM g JOIN r USING (entity) WHERE s""", "comm"))
def r12_conflict_log(spark, sf_dir):
    _, log = entities(spark, sf_dir)
    return log.where("field <> 'ts'")


@query(with_views("""
, a AS (SELECT id AS contact_id, CASE WHEN id % 5 = 0 THEN 'team' ELSE visibility END AS visibility FROM (SELECT contact_id AS id, visibility FROM rules) WHERE id % 7 <> 0 UNION ALL SELECT id, 'private' FROM contacts WHERE id % 4 = 0)
SELECT coalesce(b.contact_id, a.contact_id) AS contact_id, CASE WHEN b.contact_id IS NULL THEN 'insert' WHEN a.contact_id IS NULL THEN 'delete' ELSE 'update' END AS action, b.visibility AS old_visibility, a.visibility AS new_visibility, true AS linked
FROM rules b FULL JOIN a ON a.contact_id = b.contact_id WHERE b.visibility IS DISTINCT FROM a.visibility""", "contacts", "rules"))
def ud06_rule_changes(spark, sf_dir):
    """Changes between two versions of the rules as a chained audit, read back from its entries."""
    before = view(spark, sf_dir, "rules").select("contact_id", "visibility")
    after = before.where("contact_id % 7 <> 0").withColumn("visibility", F.when(F.col("contact_id") % 5 == 0, "team").otherwise(F.col("visibility")))
    after = after.unionByName(view(spark, sf_dir, "contacts").where("id % 4 = 0").select(F.col("id").alias("contact_id"), F.lit("private").alias("visibility")))
    audit = P.change_audit(before, after, ["contact_id"], "privacy_rule")
    body = lambda path: F.get_json_object("body", path)
    linked = F.sha2(F.concat_ws("|", "previous_hash", "body"), 256) == F.col("checksum")
    return audit.select(
        F.get_json_object(body("$.key"), "$.contact_id").cast("bigint").alias("contact_id"), body("$.action").alias("action"), F.get_json_object(body("$.old"), "$.visibility").alias("old_visibility"), F.get_json_object(body("$.new"), "$.visibility").alias("new_visibility"), linked.alias("linked"),
    )
