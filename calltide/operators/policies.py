"""Merge policies, advanced duplicate scores, phone modes, anonymisation policies, resource access and compliance reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions import masks as M
from calltide.functions import similarity as S
from calltide.functions.normalize import digits
from calltide.operators.entity_resolution import source_trust
from calltide.operators.visibility import POWER, highest_role, power

#: Carriers by area code, for numbers of country 1.
AREA_CARRIERS = {"att": ["214", "210", "512", "713"], "verizon": ["201", "202", "212", "917"], "tmobile": ["206", "253", "425"], "sprint": ["913", "816", "785"]}


def carrier_of(number: Column) -> Column:
    area = F.when(number.startswith("+1") & (F.char_length(number) == 12), F.substring(number, 3, 3))
    return reduce(lambda rest, c: F.when(area.isin(AREA_CARRIERS[c]), c).otherwise(rest), AREA_CARRIERS, F.lit("unknown"))


def merge_by_policy(events: DataFrame, key: list[str], policies: dict[str, str]) -> DataFrame:
    """One row for each key; each field by its policy: newest, oldest, longest, shortest, max, min or trusted (best source)."""
    n = lambda c: F.char_length(F.col(c).cast("string"))
    there = lambda c, order: F.when(F.col(c).isNotNull(), order)
    how = {
        "newest": lambda c: F.max_by(c, there(c, F.struct("ts", "id"))), "oldest": lambda c: F.min_by(c, there(c, F.struct("ts", "id"))), "longest": lambda c: F.max_by(c, there(c, F.struct(n(c), F.col(c)))),
        "shortest": lambda c: F.min_by(c, there(c, F.struct(n(c), F.col(c)))), "max": F.max, "min": F.min, "trusted": lambda c: F.max_by(c, there(c, F.struct(source_trust(F.col("source")), "ts", "id"))),
    }
    return events.groupBy(*key).agg(*(how[p](c).alias(c) for c, p in policies.items()), F.count("*").alias("merged"))


def digit_overlap(a: Column, b: Column) -> Column:
    """The longest common suffix of digits over the longer number, from equal to 4 last digits; else 0."""
    x, y = digits(a), digits(b)
    longer = F.greatest(F.char_length(x), F.char_length(y))
    steps = reduce(lambda rest, k: F.when(F.right(x, F.lit(k)) == F.right(y, F.lit(k)), F.lit(float(k)) / longer).otherwise(rest), range(4, 11), F.lit(0.0))
    return F.when(x == y, 1.0).otherwise(steps)


def advanced_scores(pairs: DataFrame, tolerance: float = 1, duration_tolerance: float = 1, content_threshold: float = 0.85) -> DataFrame:
    """score (0 to 1) and conflict of pairs of one number: fields that match, over the weights of those that both events have.

    Line .2, direction .1, type .1 (a pair that has under .3 of these scores 0), number .25, time .25 by its decay if over .5,
    durations of calls .1 by their difference if over .5, contents of messages .1 by edits if over the threshold, contacts .1.
    Time decays over the tolerance within it, over ten tolerances beyond it.
    """
    both = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    gap = F.col("gap_us") / 1e6
    core = F.when(both("line_id"), 0.2).otherwise(0.0) + F.when(both("direction"), 0.1).otherwise(0.0) + F.when(both("type"), 0.1).otherwise(0.0)
    time = F.greatest(F.lit(0.0), F.when(gap <= tolerance, 1 - gap / tolerance).otherwise(1 - gap / (tolerance * 10)))
    x, y = F.col("duration_a"), F.col("duration_b")
    length = F.when(x.isNull() & y.isNull(), 1.0).when(x.isNull() | y.isNull(), 0.0).when(F.abs(x - y) <= duration_tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest((x + y) / 2, F.lit(1.0))))
    content = S.text_ratio(F.col("content_a"), F.col("content_b"))
    of = lambda kind: (F.col("type_a") == kind) & (F.col("type_b") == kind)
    named = F.col("contact_id_a").isNotNull() & F.col("contact_id_b").isNotNull() if "contact_id_a" in pairs.columns else F.lit(False)
    contact = F.when(named & both("contact_id"), 0.1).otherwise(0.0) if "contact_id_a" in pairs.columns else F.lit(0.0)
    total = core + 0.25 + F.when(time > 0.5, time * 0.25).otherwise(0.0) + F.when(of("call") & (length > 0.5), length * 0.1).otherwise(0.0) + F.when(of("sms") & (content > content_threshold), content * 0.1).otherwise(0.0) + contact
    weights = F.lit(0.9) + F.when(of("call"), 0.1).otherwise(0.0) + F.when(of("sms"), 0.1).otherwise(0.0) + F.when(named, 0.1).otherwise(0.0)
    enough = both("line_id") & (both("direction") | both("type"))
    score = F.round(F.when(enough, total / weights).otherwise(0.0), 4)
    kind = F.when((score >= 0.95) & (gap <= 1), "exact").when((score >= 0.85) & (gap <= tolerance), "time_variance").otherwise("fuzzy")
    return pairs.select("id_a", "id_b", score.alias("score"), kind.alias("conflict"))


def new_against_existing(new: DataFrame, existing: DataFrame, seconds: int = 1, duration_seconds: int = 1, least: float = 0.8) -> DataFrame:
    """For each new event the best existing one it may repeat: other, score, conflict, duplicate (``score`` of ``least`` or more).

    Line, number, direction and type must be equal and times at most ``seconds`` apart (.2, .2, .1, .1 and .3). Calls whose
    durations are at most ``duration_seconds`` apart (none: 0) get .1, an equal contact .1, messages whose texts' edit ratio is
    over .8 another .1; at most 1. Events with equal line, time, number, direction, type, duration and content are ``exact`` and
    score 1; others are ``time_variance``, as they lie within the tolerance. Ties go to exact ones, then to the smallest other. Joined on keys and
    time buckets. Contacts are compared where both tables have them.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    keys, more = ["line_id", "number", "direction", "type"], ["duration", "content", *(["contact_id"] if {"contact_id"} <= {*new.columns} & {*existing.columns} else [])]
    width = max(seconds, 1) * 1_000_000
    side = lambda df, tag: df.select(*keys, F.col("id").alias("id" if tag == "1" else "other"), us.alias(f"t{tag}"), *(F.col(c).alias(f"{c}{tag}") for c in more))
    e = side(existing, "2").withColumn("b", F.floor(F.col("t2") / width))
    n = side(new, "1").withColumn("b", F.explode(F.array(*(F.floor(F.col("t1") / width) + k for k in (-1, 0, 1)))))
    p = n.join(e, [*keys, "b"]).where((F.abs(F.col("t1") - F.col("t2")) <= seconds * 1_000_000) & (F.col("id") != F.col("other")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tenth = lambda test: F.when(F.coalesce(test, F.lit(False)), 0.1).otherwise(0.0)
    length = tenth((F.col("type") == "call") & (F.abs(zero("duration1") - zero("duration2")) <= duration_seconds))
    longer = F.greatest(F.char_length("content1"), F.char_length("content2"))
    text = tenth((F.col("type") == "sms") & (longer > 0) & ((longer - F.levenshtein("content1", "content2")) / longer > 0.8) & (F.col("content1") != "") & (F.col("content2") != ""))
    contact = tenth(F.col("contact_id1") == F.col("contact_id2")) if "contact_id" in more else F.lit(0.0)
    same = (F.col("t1") == F.col("t2")) & F.col("duration1").eqNullSafe(F.col("duration2")) & F.col("content1").eqNullSafe(F.col("content2"))
    score = F.when(same, 1.0).otherwise(F.round(F.least(F.lit(1.0), F.lit(0.9) + length + contact + text), 4))
    p = p.select("id", "other", score.alias("score"), F.when(same, "exact").otherwise("time_variance").alias("conflict"))
    best = p.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "conflict", "other")).alias("b"))
    return best.select("id", "b.other", (-F.col("b.s")).alias("score"), "b.conflict", (-F.col("b.s") >= least).alias("duplicate"))


def anonymize_number(number: Column, mode: str, salt: str = "") -> Column:
    """full: all hidden; partial: middle masked; smart: country and area kept; simple: last four kept; token: a hash."""
    return {
        "full": lambda: F.when(number.isNotNull(), M.HIDDEN_NUMBER), "partial": lambda: M.partial_mask(number), "smart": lambda: F.regexp_replace(number, r"^(\+1\d{3})\d{3}(\d{4})$", "$1***$2"),
        "simple": lambda: F.concat(F.repeat(F.lit("*"), F.greatest(F.char_length(number) - 4, F.lit(0))), F.right(number, F.lit(4))), "token": lambda: M.hash_token(number, salt, 12),
    }[mode]()


#: Policies: name, the kinds of data and purposes they bind, and the strategy; * binds all.
POLICIES = [("gdpr_default", "*", "*", "mask"), ("analytics", "number", "analytics", "token"), ("support", "number", "support", "partial"), ("export_content", "content", "export", "suppress"), ("research", "duration", "research", "generalize")]


def choose_policy(kind: str, purpose: str) -> tuple[str, str]:
    """The policy that fits best: 10 for the kind, 5 for the purpose, 3 for a wildcard kind, less 2 for a wildcard purpose."""
    scored = [((10 if k == kind else 3) + (5 if p == purpose else -2), name, strategy) for name, k, p, strategy in POLICIES if k in (kind, "*") and p in (purpose, "*")]
    _, name, strategy = max(scored, key=lambda x: x[0])
    return name, strategy


def apply_policy(df: DataFrame, column: str, kind: str, purpose: str) -> DataFrame:
    c = F.col(column)
    text = c.cast("string")
    out = {"mask": M.partial_mask(text), "token": M.hash_token(text), "partial": M.partial_mask(text), "suppress": F.lit(None).cast("string"), "generalize": M.number_range(c, 1) if dict(df.dtypes)[column] in ("int", "bigint", "double") else text}
    return df.withColumn(column, out[choose_policy(kind, purpose)[1]])


def access_by_kind(roles: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Which users may reach which kind of resource, by the least role each kind asks for."""
    r = highest_role(roles)
    return r.select("user_id", "role", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), (power(F.col("role")) >= POWER[least]).alias("allowed")) for k, least in kinds.items()))).alias("x")).select("user_id", "role", "x.kind", "x.allowed")


def apply_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with a batch of changes (contact_id, visibility) laid over them: changed, added or as they were."""
    c = changes.groupBy("contact_id").agg(F.max("visibility").alias("_new"))
    out = rules.select("contact_id", "visibility").join(c, "contact_id", "full")
    return out.select("contact_id", F.coalesce("_new", "visibility").alias("visibility"), F.when(F.col("_new").isNull(), "kept").when(F.col("visibility").isNull(), "added").otherwise("changed").alias("action"))


def masked_insert(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Numbers and content masked by the contact's rule before they are stored; null contacts have no rule."""
    r = rules.select("contact_id", "anonymize_number", "anonymize_content")
    e = events.join(r, "contact_id", "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return e.select("id", F.when(on("anonymize_number"), M.mask_number(F.col("number"))).otherwise(F.col("number")).alias("number"), M.mask_content(F.col("content"), on("anonymize_content")).alias("content"))


def cross_org_access(audit: DataFrame, contacts: DataFrame, roles: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries of the audit whose actor has reached a private contact of another organisation."""
    org = highest_role(roles)
    a = audit.select("id", F.col("actor").alias("user_id"), "contact_id").join(org.select("user_id", F.col("org_id").alias("actor_org")), "user_id")
    c = contacts.select(F.col("id").alias("contact_id"), "owner_id").join(org.select(F.col("user_id").alias("owner_id"), F.col("org_id").alias("owner_org")), "owner_id")
    private = rules.where("visibility = 'private'").select("contact_id").distinct()
    return a.join(c, "contact_id").join(private, "contact_id", "left_semi").where("actor_org <> owner_org").select("id", "user_id", "contact_id")


def request_statistics(requests: DataFrame, as_of_s: int) -> DataFrame:
    """Requests by kind and status: count, mean days to completion, overdue. ``requests``: kind, status, created, completed, due (seconds)."""
    days = (F.col("completed") - F.col("created")) / 86_400.0
    overdue = F.col("completed").isNull() & (F.col("due") < as_of_s)
    return requests.groupBy("kind", "status").agg(F.count("*").alias("requests"), F.round(F.avg(days), 2).alias("mean_days"), F.count(F.when(overdue, 1)).alias("overdue"))
