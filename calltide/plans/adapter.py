"""The communication log, contacts, rules and roles, as views over the driver's tables.

The tables hold no call log, so these views derive one from ``events``. The same SELECTs are used by Spark and by the SQL that
checks the queries; both dialects accept them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The moment at which "now" is taken, so that results can be repeated.
AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "comm": """
SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS contact_id, user_id % 10 AS owner_id, user_id % 3 AS line_id,
       '+1' || lpad(CAST(2000000000 + user_id * 7919 AS VARCHAR(20)), 10, '0') AS number,
       CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'call' ELSE 'sms' END AS type, ts,
       CASE WHEN event_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction,
       CASE WHEN event_type IN ('click', 'view', 'signup') THEN CAST(floor(value) AS INTEGER) END AS duration,
       CASE WHEN event_type IN ('click', 'view', 'signup') THEN NULL ELSE props END AS content,
       CASE event_id % 3 WHEN 0 THEN 'carrier' WHEN 1 THEN 'device' ELSE 'manual' END AS source
FROM events""",
    "contacts": """
SELECT contact_id AS id, max(owner_id) AS owner_id, max(number) AS number, 'Contact ' || CAST(contact_id AS VARCHAR(20)) AS name,
       'Company ' || CAST(contact_id % 7 AS VARCHAR(20)) AS company, CASE WHEN contact_id % 2 = 0 THEN 'friend' ELSE 'work' END AS tag,
       min(ts) AS first_seen, max(ts) AS last_seen, count(CASE WHEN type = 'call' THEN 1 END) AS total_calls, count(CASE WHEN type = 'sms' THEN 1 END) AS total_sms
FROM comm WHERE contact_id IS NOT NULL GROUP BY contact_id""",
    "rules": """
SELECT id AS contact_id, owner_id, CASE id % 4 WHEN 1 THEN 'private' WHEN 2 THEN 'team' ELSE 'public' END AS visibility,
       id % 3 = 0 AS anonymize_number, id % 5 = 0 AS anonymize_content
FROM contacts WHERE id % 4 <> 0""",
    "roles": """
SELECT DISTINCT owner_id AS user_id, owner_id % 2 AS org_id,
       CASE owner_id % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'analyst' WHEN 3 THEN 'member' ELSE 'viewer' END AS role
FROM comm""",
    "audit": """
SELECT event_id AS id, user_id AS actor_id, ts, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
       CASE event_type WHEN 'signup' THEN 'authentication' WHEN 'error' THEN 'authentication' WHEN 'view' THEN 'data_access' WHEN 'click' THEN 'data_export' ELSE 'system' END AS category,
       CASE event_type WHEN 'signup' THEN 'user_login' WHEN 'error' THEN 'user_login' ELSE event_type END AS action,
       CASE event_id % 4 WHEN 0 THEN 'contacts' WHEN 1 THEN 'events' WHEN 2 THEN 'rules' ELSE 'exports' END AS resource,
       CASE WHEN user_id % 4 = 3 THEN '203.0.113.' ELSE '10.0.0.' END || CAST(user_id % 50 AS VARCHAR(20)) AS ip_address, CAST(floor(value * 10) AS BIGINT) AS resource_count
FROM events""",
    "syncs": """
SELECT event_id AS id, ts, CAST(floor(value * 100) AS BIGINT) AS duration_ms, event_id % 40 + 1 AS processed_items, CASE WHEN event_type = 'error' THEN event_id % 5 + 1 ELSE 0 END AS failed_items,
       user_id * 1000 AS bytes_transferred, CASE user_id % 3 WHEN 0 THEN 'wifi' WHEN 1 THEN 'cellular' ELSE 'none' END AS network_type,
       event_id % 100 AS queue_before, event_id % 90 AS queue_after, event_type <> 'error' AS success
FROM events""",
}

NEEDS = {"comm": [], "contacts": ["comm"], "rules": ["comm", "contacts"], "roles": ["comm"], "audit": [], "syncs": []}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, as a DataFrame; only the columns a query reads reach the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = {"events": events}
    for need in [*NEEDS[name], name]:
        text = VIEWS[need].strip()
        source = text.split("FROM ")[1].split()[0]
        made[need] = spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=made[source])
    return made[name]


def with_views(sql: str, *names: str) -> str:
    """The check's SQL with the views it needs in front; ``sql`` may begin with further named queries (``, name AS (...)``)."""
    order = [v for v in VIEWS if v in names or any(v in NEEDS[n] for n in names)]
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in order) + "\n" + sql.strip()
