"""Row policies of any table: rows of policies composed into one filter over a few semi-joins.

A policy is a row: table, name, command (select, insert, update, delete or all) and tests, all of which must hold; a row of the
table is allowed if any policy of its table and command lets it. Tests look at the row, its owner's role and organisation, and
the contact it's about. Who asks is one row of roles; owners and contacts are joined once each, only if some test needs them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators.visibility import POWER, highest_role, power

POLICIES = "table_name string, policy string, command string, tests array<string>"
#: The policies that the platform's tables come with. Tests: own; same_org; owner_role:ROLES and my_role:ROLES; contact
#: (none, or one that may be seen); about_me:COLUMN; value:COLUMN=VALUES; org_member and org_role:ROLES (of the row's organisation);
#: role_not_above (the row's role isn't above one's own, or one is an owner); anyone; system (nobody asks).
DEFAULTS = [
    ("events", "own", "all", ["own"]), ("events", "team", "select", ["same_org", "contact"]),
    ("contacts", "own", "all", ["own"]), ("contacts", "team", "select", ["same_org", "contact"]),
    ("privacy_rules", "own", "all", ["own"]), ("privacy_rules", "team", "select", ["same_org", "owner_role:owner,admin,analyst"]),
    ("sync_health", "own", "all", ["own"]), ("sync_health", "team", "select", ["same_org", "owner_role:owner,admin,analyst"]),
    ("org_roles", "own", "select", ["own"]), ("org_roles", "grant", "insert", ["my_role:owner,admin", "role_not_above"]), ("org_roles", "change", "update", ["my_role:owner,admin", "role_not_above"]), ("org_roles", "team", "select", ["my_role:owner,admin", "same_org"]), ("org_roles", "remove", "delete", ["my_role:owner,admin", "same_org"]),
    ("audit_log", "own", "select", ["own"]), ("audit_log", "team", "select", ["my_role:owner,admin,analyst", "same_org"]), ("audit_log", "about me", "select", ["value:resource=user", "about_me:resource_id"]), ("audit_log", "contacts", "select", ["value:resource=contact,event,privacy_rule", "contact"]), ("audit_log", "system", "insert", ["anyone"]),
    ("incidents", "own", "select", ["own"]), ("incidents", "admins", "select", ["same_org", "owner_role:owner,admin"]), ("incidents", "report", "insert", ["own"]), ("incidents", "lead", "update", ["my_role:owner,admin"]), ("incidents", "own change", "update", ["own"]),
    ("tickets", "own", "all", ["own"]), ("tickets", "support", "select", ["my_role:owner,admin"]),
    ("file_uploads", "own", "all", ["own"]), ("file_uploads", "admins", "select", ["same_org", "owner_role:owner,admin"]),
    ("nlq_queries", "own", "all", ["own"]), ("nlq_queries", "team", "select", ["same_org", "my_role:owner,admin,analyst"]),
    ("webhook_endpoints", "own", "all", ["own"]), ("webhook_endpoints", "admins", "select", ["same_org", "owner_role:owner,admin"]),
    ("billing_subscriptions", "members", "select", ["org_member"]), ("billing_subscriptions", "owners", "all", ["org_role:owner"]), ("billing_subscriptions", "admins", "update", ["org_role:owner,admin"]),
    ("i18n_strings", "read", "select", ["anyone"]), ("i18n_strings", "admins", "all", ["my_role:owner,admin"]),
    ("outbox", "system", "all", ["system"]), ("outbox", "admins", "all", ["my_role:owner,admin"]),
]


def default_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULTS, POLICIES)


def open_contacts(contacts: DataFrame, rules: DataFrame, owners: DataFrame, requester, my_org) -> DataFrame:
    """contact_id and whether the requester may see it: one's own; else of one's organisation, with a team or public rule, none, or an
    admin or owner as its owner."""
    r = rules.groupBy(F.col("contact_id").alias("_contact")).agg(F.max(F.col("visibility").isin("team", "public")).alias("_open"), F.lit(True).alias("_ruled"))
    c = contacts.select(F.col("id").alias("_contact"), F.col("owner_id").alias("_owner")).join(owners, "_owner", "left").join(r, "_contact", "left")
    seen = F.coalesce("_open", F.lit(False)) | F.col("_ruled").isNull() | F.col("_role").isin("owner", "admin")
    return c.select("_contact", F.coalesce((F.col("_owner") == F.lit(requester)) | (F.col("_org").eqNullSafe(F.lit(my_org)) & F.lit(my_org is not None) & seen), F.lit(False)).alias("_open"))


def secured(
    rows: DataFrame, table: str, policies: DataFrame, roles: DataFrame, requester, command: str = "select", owner: str = "user_id", contact: str = "contact_id", contacts: DataFrame | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """The rows of ``rows`` that ``requester`` (None: the system) may use with ``command``; all columns, and no others.

    ``owner`` names the column with the user a row belongs to, ``contact`` that of the contact it's about; ``contacts`` (id, owner_id)
    and ``rules`` (contact_id, visibility) are wanted if some test looks at contacts. ``roles``: user_id, org_id, role; of several
    roles the most powerful counts. A table without policies, a user without roles and unknown owners see and show nothing but
    what tests without them allow. A test of no known name raises a ValueError.
    """
    own = policies.where(F.col("table_name") == table).where(F.col("command").isin(command, "all")).orderBy("policy").collect()
    best = highest_role(roles)
    me = best.where(F.col("user_id") == F.lit(requester)).first() if requester is not None else None
    my_role, my_org = (me["role"], me["org_id"]) if me else (None, None)
    mine = {(r["org_id"], r["role"]) for r in roles.where(F.col("user_id") == F.lit(requester)).select("org_id", "role").distinct().collect()} if requester is not None else set()  # of one user
    tests = {t for p in own for t in p["tests"]}
    owners = best.select(F.col("user_id").alias("_owner"), F.col("role").alias("_role"), F.col("org_id").alias("_org"))
    out = rows
    if any(t == "same_org" or t.startswith("owner_role:") for t in tests):
        out = out.join(owners.withColumnsRenamed({"_owner": "_row_owner", "_role": "_row_role", "_org": "_row_org"}), F.col(owner) == F.col("_row_owner"), "left")
    if "contact" in tests:
        seen = open_contacts(contacts, rules, owners, requester, my_org).withColumnsRenamed({"_contact": "_row_contact", "_open": "_row_open"})
        out = out.join(seen, F.col(contact) == F.col("_row_contact"), "left")

    def holds(test: str) -> Column:
        name, _, arg = test.partition(":")
        values = arg.split(",")
        if name == "own":
            return F.col(owner) == F.lit(requester)
        if name == "same_org":
            return (F.col("_row_org") == F.lit(my_org)) if my_org is not None else F.lit(False)
        if name == "owner_role":
            return F.col("_row_role").isin(*values)
        if name == "my_role":
            return F.lit(my_role in values)
        if name == "contact":
            return F.col(contact).isNull() | F.coalesce("_row_open", F.lit(False))
        if name == "about_me":
            return F.col(arg) == F.lit(requester)
        if name == "value":
            column, _, allowed = arg.partition("=")
            return F.col(column).isin(*allowed.split(","))
        if name in ("org_member", "org_role"):
            orgs = sorted({o for o, r in mine if name == "org_member" or r in values})
            return F.col("org_id").isin(*orgs) if orgs else F.lit(False)
        if name == "role_not_above":
            return F.lit(my_role == "owner") | (power(F.col("role")) <= POWER.get(my_role, 0))
        if name in ("anyone", "system"):
            return F.lit(name == "anyone" or requester is None)
        raise ValueError(f"a test of no known name: {test}")

    allowed = [reduce(lambda a, b: a & b, [F.coalesce(holds(t), F.lit(False)) for t in p["tests"]], F.lit(True)) for p in own]
    return out.where(reduce(lambda a, b: a | b, allowed, F.lit(False))).select(*(rows[c] for c in rows.columns))
