"""Who sees what: roles, organisations, rules of privacy, and masked views of events.

Roles and rules are joined without a broadcast hint, so that Spark decides by their size; ids of hot contacts are split by
adaptive skew joins, as both sides are plain shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions.masks import mask_content, mask_number

#: Roles and their power.
POWER = {"owner": 5, "admin": 4, "analyst": 3, "member": 2, "viewer": 1}
#: The lowest role that may do an action on a resource.
PERMISSIONS = {
    ("events", "read"): "viewer", ("events", "write"): "member", ("events", "delete"): "admin", ("events", "export"): "analyst",
    ("contacts", "read"): "viewer", ("contacts", "write"): "member", ("contacts", "delete"): "admin",
    ("rules", "read"): "analyst", ("rules", "write"): "admin", ("team", "read"): "analyst", ("team", "write"): "admin",
    ("billing", "read"): "admin", ("billing", "write"): "owner", ("audit", "read"): "admin",
}


def power(role: Column) -> Column:
    return reduce(lambda rest, r: F.when(role == r, POWER[r]).otherwise(rest), POWER, F.lit(0)).cast("bigint")


def highest_role(roles: DataFrame) -> DataFrame:
    """Each user's most powerful role and its organisation (the smaller id of equals)."""
    return roles.groupBy("user_id").agg(F.max_by(F.struct("role", "org_id"), F.struct(power(F.col("role")), -F.col("org_id"))).alias("r")).select("user_id", "r.role", "r.org_id")


def permission_matrix(spark) -> DataFrame:
    rows = [(resource, action, role, POWER[role] >= POWER[least]) for (resource, action), least in PERMISSIONS.items() for role in POWER]
    return spark.createDataFrame(rows, "resource string, action string, role string, allowed boolean")


def user_permissions(roles: DataFrame) -> DataFrame:
    """What each user may do, by the highest role."""
    spark = roles.sparkSession
    return highest_role(roles).join(permission_matrix(spark).where("allowed"), "role").select("user_id", "role", "resource", "action")


def same_organization(roles: DataFrame) -> DataFrame:
    """Ordered pairs of members of one organisation, for each org's few members; not to be used as a filter over events."""
    a, b = roles.select("org_id", F.col("user_id").alias("user_a")), roles.select("org_id", F.col("user_id").alias("user_b"))
    return a.join(b, "org_id").where("user_a < user_b").select("user_a", "user_b").distinct()


def visible_events(events: DataFrame, rules: DataFrame, roles: DataFrame, requester: int) -> DataFrame:
    """Events of the requester's organisation that rules let the requester see, with masks applied.

    Own events are always seen and never masked. Those of others need an admin's or owner's role, a rule of team or public
    visibility, or no rule.
    """
    me = highest_role(roles).where(F.col("user_id") == requester).select(F.col("role").alias("my_role"), F.col("org_id").alias("my_org"))
    peers = highest_role(roles).join(me, F.col("org_id") == F.col("my_org")).select(F.col("user_id").alias("owner_id"), "my_role")
    r = rules.select("contact_id", "visibility", "anonymize_number", "anonymize_content")
    e = events.join(peers, "owner_id").join(r, "contact_id", "left")
    own = F.col("owner_id") == requester
    seen = own | F.col("my_role").isin("admin", "owner") | F.col("visibility").isNull() | F.col("visibility").isin("team", "public")
    hide = lambda c: ~own & F.coalesce(F.col(c), F.lit(False))
    return e.where(seen).select(
        "id", "owner_id", "contact_id", "ts", "type", "direction", "duration", F.when(hide("anonymize_number"), mask_number(F.col("number"))).otherwise(F.col("number")).alias("number"),
        mask_content(F.col("content"), hide("anonymize_content")).alias("content"), F.coalesce("visibility", F.lit("team")).alias("visibility"),
    )


def newest(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of a log, newest first; equal times by id."""
    return df.orderBy(F.desc("ts"), "id").offset(offset).limit(limit)


def effective_rules(contacts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that holds for each contact: active and in effect, highest priority, then oldest; without any: team.

    ``rules``: id, scope (contact, pattern, organization, global), contact_id, pattern, org_id, priority, visibility,
    active, created. Pattern rules are few and are matched by a join on the pattern; the others are equi-joins.
    """
    active = rules.where("active")
    c = contacts.select("id", "number", "org_id")
    parts = [
        c.join(active.where("scope = 'contact'").withColumnRenamed("id", "rule_id").drop("org_id"), F.col("id") == F.col("contact_id")),
        c.join(active.where("scope = 'organization'").withColumnRenamed("id", "rule_id").withColumnRenamed("org_id", "rule_org"), F.col("org_id") == F.col("rule_org")),
        c.withColumn("_k", F.lit(1)).join(active.where("scope = 'global'").withColumnRenamed("id", "rule_id").drop("org_id").withColumn("_k", F.lit(1)), "_k"),
        c.withColumn("prefix", F.substring("number", 1, 4)).join(active.where("scope = 'pattern'").withColumnRenamed("id", "rule_id").drop("org_id"), F.col("prefix") == F.col("pattern")),
    ]
    every = reduce(DataFrame.unionByName, [p.select("id", "rule_id", "scope", "visibility", "priority", "created") for p in parts])
    best = every.groupBy("id").agg(F.max_by(F.struct("rule_id", "scope", "visibility"), F.struct("priority", -F.col("created"), -F.col("rule_id"))).alias("r"))
    return contacts.select("id").join(best, "id", "left").select("id", F.col("r.rule_id").alias("rule_id"), F.coalesce("r.scope", F.lit("default")).alias("scope"), F.coalesce("r.visibility", F.lit("team")).alias("visibility"))


def can_access(contacts: DataFrame, rules: DataFrame, roles: DataFrame, requester: int) -> DataFrame:
    """For each contact: whether the requester may see it and why (own, role, rule, default, organization)."""
    me = highest_role(roles).where(F.col("user_id") == requester).select("role", F.col("org_id").alias("my_org"))
    owners = highest_role(roles).select(F.col("user_id").alias("owner_id"), F.col("org_id").alias("owner_org"))
    r = rules.select(F.col("contact_id").alias("id"), "visibility")
    c = contacts.select("id", "owner_id").join(owners, "owner_id", "left").join(r, "id", "left").withColumn("_k", F.lit(1)).join(me.withColumn("_k", F.lit(1)), "_k")
    why = (
        F.when(F.col("owner_id") == requester, "own").when(~F.col("owner_org").eqNullSafe(F.col("my_org")), "organization")
        .when(F.col("role").isin("owner", "admin"), "role").when(F.col("visibility").isNull(), "default").otherwise(F.concat(F.lit("rule:"), F.col("visibility")))
    )
    return c.select("id", why.alias("reason"), (~why.isin("organization", "rule:private")).alias("allowed"))


def role_transitions() -> list[tuple[str, str, str, bool]]:
    """(actor, from, to, allowed): an actor may change roles below its own to ones below its own; owners may also give their own."""
    out = []
    for actor in POWER:
        for old in POWER:
            for new in POWER:
                ok = POWER[actor] >= POWER["admin"] and POWER[old] < POWER[actor] and (POWER[new] < POWER[actor] or actor == "owner")
                out.append((actor, old, new, ok))
    return out


def hierarchy(roles: DataFrame) -> DataFrame:
    """Members of each organisation by power, with how many stand above."""
    w = Window.partitionBy("org_id").orderBy(F.desc("power"))
    return roles.select("org_id", "user_id", "role", power(F.col("role")).alias("power")).withColumn("above", F.rank().over(w).cast("bigint") - 1)
