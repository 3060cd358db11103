"""Merges that say what they did, and changes of tables: who disagreed in a merge and which rule chose, what a new version changed.

Groups are aggregated, never collected: a group of any size costs its tasks a few values a field. The log of a merge joins the
rows back, one row of the log for each value of a field in dispute.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.operators.health import chained

#: The rules by which fields of events and contacts are merged.
EVENT_RULES = {"ts": "first", "number": "first", "type": "first", "direction": "first", "duration": "max", "content": "longest"}
CONTACT_RULES = {"number": "first", "name": "longest", "email": "first", "avatar_url": "first", "is_blocked": "last", "total_events": "max", "last_event_at": "last"}


def chosen(field: str, rule: str, order: Column) -> Column:
    """The value that a rule takes from a group's values (nulls never), ties by ``order``."""
    value = F.col(field)
    if rule == "max":
        return F.max(value)
    if rule == "min":
        return F.min(value)
    n = F.char_length(value.cast("string"))
    there = value.isNotNull()
    by = {"first": order, "manual": order, "last": order, "longest": F.struct(-n, order), "shortest": F.struct(n, order)}
    if rule not in by:
        raise ValueError(f"no rule: {rule}")
    return (F.max_by if rule == "last" else F.min_by)(value, F.when(there, by[rule]))


def merge_with_log(rows: DataFrame, keys: list[str], rules: dict[str, str], order: str = "ts", id_col: str = "id", default: str = "first") -> tuple[DataFrame, DataFrame]:
    """(merged; log) of rows that share ``keys`` (null equals null).

    Merged: the keys, ``id_col`` (the first row's), every other field by its rule (``rules``, else ``default``: first, last, longest,
    shortest, max, min, manual), ``merged`` (rows) and ``conflicts``, the fields whose values that aren't null differed, in order. First
    and last are by ``order``, then ``id_col``; a null order is the earliest. Log: the keys, kept_id, field, rule, ``id_col``, value (as
    text) and kept, for each value of a field in conflict: which row had it, and whether it is the one kept; a rule manual keeps the
    first and waits for a person.
    """
    fields = [c for c in rows.columns if c not in (*keys, id_col)]
    of = {f: rules.get(f, default) for f in fields}
    place = F.struct(F.col(order), F.col(id_col))
    first_id = F.min_by(id_col, place)
    differ = lambda f: F.coalesce(F.min(f) != F.max(f), F.lit(False))
    groups = rows.groupBy(*keys).agg(
        first_id.alias(id_col), *(chosen(f, r, place).alias(f) for f, r in of.items()), F.count("*").alias("merged"), F.array_compact(F.array(*(F.when(differ(f), F.lit(f)) for f in fields))).alias("conflicts"),
    )
    disputed = groups.where(F.size("conflicts") > 0).alias("g")
    on = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    both = disputed.join(rows.alias("r"), on)
    entries = F.array(*(
        F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), F.col(f"r.{f}").cast("string").alias("value"), F.col(f"r.{f}").eqNullSafe(F.col(f"g.{f}")).alias("kept")) for f, r in of.items()
    ))
    entries = F.filter(entries, lambda e: F.array_contains(F.col("g.conflicts"), e["field"]) & e["value"].isNotNull())
    log = both.select(*(F.col(f"g.{k}").alias(k) for k in keys), F.col(f"g.{id_col}").alias("kept_id"), F.col(f"r.{id_col}").alias(id_col), F.explode(entries).alias("e"))
    return groups, log.select(*keys, "kept_id", "e.field", "e.rule", id_col, "e.value", "e.kept")


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The feed of changes from one version of a table to the next: keys, action (insert, update, delete), old and new.

    ``old`` and ``new`` are maps from the fields that changed to their values as text (null for null): all fields of an inserted or
    deleted row, only the changed ones of an updated row. Rows that are equal aren't in the feed. Null keys equal one another; keys
    are unique in each version. Fields of one version only count as null in the other.
    """
    fields = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c not in keys]
    row = lambda df: F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f"`{f}`").cast("string") if f in df.columns else F.lit(None).cast("string")))) if fields else F.lit(None).cast("map<string,string>")
    side = lambda df, s: df.select(*(F.col(k).alias(f"{k}_{s}") for k in keys), F.lit(True).alias(f"there_{s}"), row(df).alias(f"map_{s}"))
    on = reduce(lambda a, b: a & b, [F.col(f"{k}_old").eqNullSafe(F.col(f"{k}_new")) for k in keys])
    both = side(before, "old").join(side(after, "new"), on, "full")
    inserted, deleted = F.col("there_old").isNull(), F.col("there_new").isNull()
    action = F.when(inserted, "insert").when(deleted, "delete").otherwise("update")
    changed = lambda mine, other: F.when(inserted | deleted, F.col(mine)).otherwise(F.map_filter(mine, lambda k, v: ~v.eqNullSafe(F.element_at(other, k))))
    out = both.select(*(F.when(inserted, F.col(f"{k}_new")).otherwise(F.col(f"{k}_old")).alias(k) for k in keys), action.alias("action"), changed("map_old", "map_new").alias("old"), changed("map_new", "map_old").alias("new"))
    return out.where((F.col("action") != "update") | (F.size("new") > 0))


def change_audit(before: DataFrame, after: DataFrame, keys: list[str], resource: str, actor: Column | None = None) -> DataFrame:
    """The feed as entries of an audit whose checksums chain: actor_id, seq, body (JSON: resource, key, action, old, new), previous_hash, checksum.

    ``actor`` is a column over the keys (by default one chain for each of 64 hashes of the keys, so that no chain holds the whole feed); seq is
    the SHA-256 of the key, so that the order of a chain doesn't depend on how the tables lie.
    """
    feed = changes(before, after, keys)
    key = F.to_json(F.struct(*(F.col(k) for k in keys)), {"ignoreNullFields": "false"})
    sorted_map = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))), {"ignoreNullFields": "false"})
    body = F.to_json(F.struct(F.lit(resource).alias("resource"), key.alias("key"), F.col("action").alias("action"), sorted_map("old").alias("old"), sorted_map("new").alias("new")))
    who = actor if actor is not None else F.pmod(F.xxhash64(key), F.lit(64))
    return chained(feed.select(who.alias("actor_id"), F.sha2(key, 256).alias("seq"), body.alias("body")))
