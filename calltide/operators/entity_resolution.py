"""Duplicates of events and contacts: keys, clusters, similarities, quality, merges and resolutions.

Exact stages group by a key. Fuzzy stages join on what the threshold makes necessary (an equal number and a bounded time gap),
so no pair is made that couldn't match. Clusters of one key are cut at gaps over the tolerance before anything is collected,
because an anchor never reaches over such a gap: what is collected is a burst, not a number's whole history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.functions import similarity as S
from calltide.functions.normalize import digits
from calltide.operators.dashboards import moment
from calltide.operators.lineage import cut
from calltide.operators.matching import near_pairs
from calltide.operators.set_join import similar_sets

#: How far a source is trusted.
SOURCE_TRUST = {"carrier": 0.9, "device": 0.7, "manual": 0.5}
#: Weights of the field-wise similarity.
WEIGHTS = {"phone": 0.30, "time": 0.25, "duration": 0.15, "content": 0.20, "type": 0.10}


def epoch(c: str = "ts") -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def composite_key(*extra: Column) -> Column:
    """SHA-256 of owner, number, second, type and direction (and more)."""
    return F.sha2(F.concat_ws("|", F.col("owner_id").cast("string"), "number", epoch().cast("string"), "type", "direction", *extra), 256)


def bucketed_key(seconds: int = 300) -> Column:
    """16 hex digits over the owner, the digits, the time rounded to a bucket, type, direction and (calls) duration to 30 s."""
    bucket = (F.floor(epoch() / seconds + 0.5) * seconds).cast("string")
    length = F.when(F.col("type") == "call", (F.floor(F.coalesce("duration", F.lit(0)) / 30.0 + 0.5) * 30).cast("string")).otherwise("")
    return F.left(F.sha2(F.concat_ws("|", F.col("owner_id").cast("string"), digits(F.col("number")), bucket, "type", "direction", length), 256), F.lit(16))


def content_key() -> Column:
    return F.md5(F.concat_ws("|", F.col("owner_id").cast("string"), "number", "type", F.lower(F.trim(F.coalesce("content", F.lit(""))))))


def first_of_key(events: DataFrame, key: Column) -> DataFrame:
    """The earliest event (then smallest id) of each key, and how many it stands for."""
    keyed = events.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min_by("id", F.struct("ts", "id")).alias("id"), F.count("*").alias("copies"))
    return events.join(first.drop("_key"), "id")


def anchor_clusters(events: DataFrame, tolerance: int = 300, keys: tuple[str, ...] = ("owner_id", "number", "type", "direction")) -> DataFrame:
    """id and anchor: events in time order join the anchor at most ``tolerance`` seconds before them, or become one.

    Each key's history is cut into bursts at gaps over the tolerance; a burst is folded in order.
    """
    w = Window.partitionBy(*keys).orderBy("t", "id")
    e = events.select(*keys, "id", epoch().alias("t"))
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > tolerance).cast("int"), F.lit(1))
    bursts = e.withColumn("cut", cut).withColumn("burst", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = bursts.groupBy(*keys, "burst").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("rows"))
    start = F.struct(F.lit(-(10**15)).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("anchor"), F.expr("CAST(array() AS array<struct<id:bigint,anchor:bigint>>)").alias("out"))

    def step(a, x):
        fresh = x["t"] - a["at"] > tolerance
        anchor = F.when(fresh, x["id"]).otherwise(a["anchor"])
        return F.struct(F.when(fresh, x["t"]).otherwise(a["at"]).alias("at"), anchor.alias("anchor"), F.concat(a["out"], F.array(F.struct(x["id"].alias("id"), anchor.alias("anchor")))).alias("out"))

    return group.select(F.explode(F.aggregate("rows", start, step, lambda a: a["out"])).alias("x")).select("x.id", "x.anchor")


def merge_clusters(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """One event for each anchor: earliest time, longest duration and content, most trusted source, and the number merged."""
    e = events.join(clusters, "id")
    trust = source_trust(F.col("source"))
    return e.groupBy("anchor").agg(
        F.min(epoch()).alias("first_at"), F.max("duration").cast("bigint").alias("duration"), F.max_by("content", F.struct(F.char_length("content"), "content")).alias("content"),
        F.max_by("source", F.struct(trust, "source")).alias("source"), F.count("*").alias("merged"),
    )


def merge_contacts(contacts: DataFrame) -> DataFrame:
    """One contact for each owner and number: longest name, earliest and latest times, summed counters, all tags."""
    return contacts.groupBy("owner_id", "number").agg(
        F.max_by("name", F.struct(F.char_length("name"), "name")).alias("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("total_calls").alias("total_calls"), F.sum("total_sms").alias("total_sms"), F.array_sort(F.collect_set("tag")).alias("tags"),
    )


def source_trust(source: Column) -> Column:
    return reduce(lambda rest, s: F.when(source == s, SOURCE_TRUST[s]).otherwise(rest), SOURCE_TRUST, F.lit(0.5))


def event_quality(events: DataFrame, as_of: str, freshness_days: float = 7) -> DataFrame:
    """Completeness ((7 + optional fields filled) / 10), trust and freshness, and .4, .4, .2 of them rounded to 3 places."""
    filled = sum((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int") for c in ("duration", "content", "contact_id"))
    completeness = (filled + 7) / 10
    age = (F.unix_timestamp(moment(as_of).cast("timestamp")) - epoch()) / 86_400.0
    freshness = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / freshness_days))
    e = events.select("id", completeness.alias("completeness"), source_trust(F.col("source")).alias("trust"), F.round(freshness, 3).alias("freshness"), freshness.alias("_f"))
    return e.withColumn("quality", F.round(F.col("completeness") * 0.4 + F.col("trust") * 0.4 + F.col("_f") * 0.2, 3)).drop("_f")


def ladder(value: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    """The score of the first step whose bound the value doesn't exceed."""
    return reduce(lambda out, s: F.when(value <= s[0], s[1]).otherwise(out), reversed(steps), F.lit(rest))


def weighted_similarity(pairs: DataFrame) -> DataFrame:
    """Field-wise similarity of pairs of one number: time, and durations' relative difference (none: 0), by steps, content by words, type by equality."""
    gap = F.col("gap_us") / 1e6
    time = ladder(gap, [(0, 1.0), (60, 0.9), (300, 0.8), (900, 0.6), (3600, 0.4), (86_400, 0.2)], 0.0)
    a, b = (F.coalesce(f"duration_{s}", F.lit(0)) for s in "ab")
    duration = F.when(a == b, 1.0).otherwise(ladder(F.abs(a - b) / F.greatest(a, b), [(0.05, 0.9), (0.15, 0.7), (0.3, 0.5), (0.5, 0.3)], 0.1))
    content = F.when(F.col("content_a").isNull() & F.col("content_b").isNull(), 1.0).otherwise(S.jaccard(S.words(F.col("content_a")), S.words(F.col("content_b"))))
    kind = F.when(F.col("type_a") == F.col("type_b"), 1.0).otherwise(0.0)
    total = WEIGHTS["phone"] + time * WEIGHTS["time"] + duration * WEIGHTS["duration"] + content * WEIGHTS["content"] + kind * WEIGHTS["type"]
    return pairs.withColumn("similarity", F.round(total, 4))


def similar_events(events: DataFrame, threshold: float = 0.85, seconds: float = 300) -> DataFrame:
    """Pairs of one owner and number at ``threshold`` or more by phone .4, time .3, type .15, direction .15.

    The threshold asks for an equal number and at most 300 s between, which is what the join makes: each counts wholly.
    """
    p = near_pairs(events.withColumn("number", digits(F.col("number"))), ["owner_id", "number"], seconds)
    score = F.round(F.lit(0.4) + F.lit(0.3) + (F.col("type_a") == F.col("type_b")).cast("int") * 0.15 + (F.col("direction_a") == F.col("direction_b")).cast("int") * 0.15, 4)
    return p.select("id_a", "id_b", score.alias("similarity")).where(F.col("similarity") >= threshold)


def resolve_strategy(similarity: Column, quality_a: Column, quality_b: Column) -> Column:
    """Automatic above .9 with a clear better, merge from .8 with equal quality, else manual."""
    d = F.abs(quality_a - quality_b)
    return F.when((similarity >= 0.9) & (d > 0.2), "automatic").when((similarity >= 0.8) & (d <= 0.1), "merge").otherwise("manual")


def resolutions(conflicts: DataFrame, quality: DataFrame) -> DataFrame:
    """For each conflict: both qualities, the strategy, and the event to keep: the better (the first of equals), the first if a person must decide."""
    q = lambda s: quality.select(F.col("id").alias(f"id_{s}"), F.col("quality").alias(f"quality_{s}"))
    out = conflicts.join(q("a"), "id_a").join(q("b"), "id_b")
    return out.withColumn("strategy", resolve_strategy(F.col("similarity"), F.col("quality_a"), F.col("quality_b"))).withColumn("keep", F.when((F.col("strategy") == "manual") | (F.col("quality_a") >= F.col("quality_b")), F.col("id_a")).otherwise(F.col("id_b")))


def merged_pairs(events: DataFrame, resolved: DataFrame, seconds: int = 2) -> DataFrame:
    """The merged event of each pair: the better one, its blanks filled from the other; the longer duration if at most ``seconds`` apart."""
    fields = ["duration", "content", "contact_id", "source"]
    e = events.select("id", *fields)
    side = lambda s: e.select(F.col("id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in fields))
    p = resolved.select("id_a", "id_b", "keep").join(side("a"), "id_a").join(side("b"), "id_b")
    first = F.col("keep") == F.col("id_a")
    pick = lambda c: F.coalesce(F.when(first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")), F.when(first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
    near = F.abs(F.col("duration_a") - F.col("duration_b")) <= seconds
    longest = F.when(near, F.greatest("duration_a", "duration_b")).otherwise(pick("duration"))
    return p.select("id_a", "id_b", "keep", longest.cast("bigint").alias("duration"), pick("content").alias("content"), pick("contact_id").alias("contact_id"), pick("source").alias("source"))


def conflict_metrics(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("conflict").agg(
        F.count("*").alias("conflicts"), F.count(F.when(F.col("strategy") == "automatic", 1)).alias("automatic"), F.count(F.when(F.col("strategy") == "merge", 1)).alias("merged"),
        F.count(F.when(F.col("strategy") == "manual", 1)).alias("manual"), F.round(F.avg("similarity"), 4).alias("similarity"),
    )


def triage(conflicts: DataFrame, size: int = 50, slices: int = 64) -> DataFrame:
    """Priority of each conflict by its kind, whether a person has to look at it, and the batch of its priority, of ``size`` conflicts at most.

    Conflicts are numbered slice by slice (id_a modulo ``slices``), then by id_a and id_b: a slice's first number is the count of those before it, so
    that no priority is ordered in one task.
    """
    priority = F.when(F.col("conflict") == "exact", "critical").when(F.col("conflict") == "time_variance", "high").otherwise("medium")
    c = conflicts.select("id_a", "id_b", "conflict", priority.alias("priority"), (F.col("conflict") == "fuzzy").alias("manual"), F.pmod("id_a", F.lit(slices)).alias("_slice"))
    counts = c.groupBy("priority", "_slice").agg(F.count("*").alias("_n"))  # a row for each priority and slice
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("priority").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("priority", "_slice").orderBy("id_a", "id_b"))
    return c.withColumn("_place", place).join(before, ["priority", "_slice"]).select("id_a", "id_b", "conflict", "priority", "manual", F.floor((F.col("_before") + F.col("_place") - 1) / size).cast("bigint").alias("batch"))


def dedup_quality(events: DataFrame, kept: DataFrame) -> DataFrame:
    """.8 + .3 of the share removed, less .4 of what it exceeds one half by, between 0 and 1; 1 for no events."""
    n = events.agg(F.count("*").alias("before")).crossJoin(kept.agg(F.count("*").alias("after")))  # of one row each
    rate = (F.col("before") - F.col("after")) / F.greatest("before", F.lit(1))
    penalty = F.when(rate > 0.5, (rate - 0.5) * 0.4).otherwise(0.0)
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.8 + rate * 0.3 - penalty))
    return n.select("before", "after", F.round(F.when(F.col("before") == 0, 1.0).otherwise(quality), 4).alias("quality"))


def server_wins(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local rows, with the remote's fields where the remote has the row, and where each came from."""
    r = remote.select("id", F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in ("duration", "content", "source")))
    out = local.join(r, "id", "left")
    pick = lambda c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return out.select("id", pick("duration"), pick("content"), pick("source"), F.when(F.col("_there"), "remote").otherwise("local").alias("origin"))


def to_roots(links: DataFrame) -> DataFrame:
    """id, duplicate_of and stage with each ``duplicate_of`` followed to an event that is no duplicate itself.

    Each pass puts the target's own target in the place of the target, so the way doubles; links have no circle.
    """
    at = cut(links.select("id", "duplicate_of", "stage"))
    while True:
        step = at.select(F.col("id").alias("duplicate_of"), F.col("duplicate_of").alias("next"))
        at = cut(at.drop("more").join(step, "duplicate_of", "left").select("id", F.coalesce("next", "duplicate_of").alias("duplicate_of"), "stage", F.col("next").isNotNull().alias("more")))
        if at.where("more").isEmpty():
            return at.drop("more")


def similar_contents(events: DataFrame, threshold: float = 0.8, min_chars: int = 10) -> DataFrame:
    """id and duplicate_of, the smallest id of the owner's events whose contents share ``threshold`` of their distinct words or more.

    Only contents of over ``min_chars`` characters that have words are compared, and only events with a smaller similar one are returned.
    """
    long = events.where(F.char_length("content") > min_chars).select("id", "owner_id", S.words(F.col("content")).alias("words")).where(F.size("words") > 0)
    members, pairs = similar_sets(long, threshold, ("owner_id",))
    smaller = pairs.groupBy(F.col("rep_b").alias("rep")).agg(F.min("rep_a").alias("least"))  # a class's smallest id stands for it
    found = members.join(smaller, "rep", "left").select("id", F.coalesce("least", "rep").alias("duplicate_of"))
    return found.where("duplicate_of < id")


def staged_duplicates(events: DataFrame, tolerance: int = 300, threshold: float = 0.7, by_content: bool = False, content_threshold: float = 0.8, min_chars: int = 10) -> DataFrame:
    """id, duplicate_of and stage of events found by the exact key, the bucketed key, weighted similarity, and (``by_content``) contents.

    Each stage sees what the earlier ones have left; an event is a duplicate of the earliest of its key, of a pair's smaller id,
    or of the smallest id with similar contents (:func:`similar_contents`); all of these are followed to events that are no
    duplicates. Events of one exact key have one bucketed key, too, so each stage works on the first events that the one before
    it has grouped: rows with copies are aggregated in their tasks and shuffled once.
    """
    fields = ["ts", "id", "owner_id", "number", "type", "direction", "duration", "content"]
    first = lambda df, key, more: df.groupBy(key).agg(F.min(F.struct(*fields, *more)).alias("f"))
    keyed = events.select(*fields, composite_key(F.coalesce(F.col("duration").cast("string"), F.lit("-"))).alias("k1"))
    firsts = first(keyed, "k1", [])
    exact = keyed.select("id", "k1").join(firsts.select("k1", F.col("f.id").alias("duplicate_of")), "k1").where("id <> duplicate_of")
    one = firsts.select("f.*").withColumn("k2", bucketed_key(tolerance))
    seconds = first(one, "k2", [])
    bucketed = one.select("id", "k2").join(seconds.select("k2", F.col("f.id").alias("duplicate_of")), "k2").where("id <> duplicate_of")
    two = cut(seconds.select("f.*"))  # two stages work on it, one of them through several joins
    pairs = weighted_similarity(near_pairs(two, ["owner_id", "number"], tolerance)).where(F.col("similarity") >= threshold)
    fuzzy = cut(pairs.groupBy(F.col("id_b").alias("id")).agg(F.min("id_a").alias("duplicate_of")))
    stages = [("exact", exact), ("bucketed", bucketed), ("fuzzy", fuzzy)]
    if by_content:
        stages.append(("content", similar_contents(two.join(fuzzy.select("id"), "id", "left_anti"), content_threshold, min_chars)))
    return to_roots(reduce(DataFrame.unionByName, [df.select("id", "duplicate_of", F.lit(stage).alias("stage")) for stage, df in stages]))
