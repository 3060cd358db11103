"""Ingestion: mapping of fields, normalisation, validation, quality, and content checks of raw records.

Records come as text columns. Each step is one select: values and errors are worked out side by side, so that a record is
read once and split into valid and rejected rows by a filter.
"""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions import normalize as N

FIELDS = ["number", "ts", "duration", "type", "direction", "content"]
#: Names that headers give the fields.
SYNONYMS = {
    "number": ["number", "phone", "phone number", "phone_number", "caller", "called number", "to", "from", "msisdn", "contact"],
    "ts": ["ts", "timestamp", "date", "time", "datetime", "date/time", "start time", "call date", "call time"],
    "duration": ["duration", "length", "seconds", "minutes", "call duration", "dur"],
    "type": ["type", "call type", "event type", "kind", "service"],
    "direction": ["direction", "dir", "in/out", "flow", "call direction"],
    "content": ["content", "message", "text", "body", "sms"],
}
PATTERNS = {"number": r"^\+?[0-9() .-]{7,20}$", "ts": r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|^\d{10,13}$", "duration": r"^\d+$|^\d+:\d{2}(:\d{2})?$", "type": r"(?i)^(call|voice|sms|text|mms)$", "direction": r"(?i)^(in|out|inbound|outbound|incoming|outgoing)$"}


def header_similarity(header: str, name: str) -> float:
    a, b = header.strip().lower(), name.lower()
    return 1.0 if a == b else 0.95 if a.replace("_", " ") == b else difflib.SequenceMatcher(None, a, b).ratio()


def map_fields(headers: list[str], least: float = 0.6) -> dict[str, tuple[str, float]]:
    """field -> (header, confidence), each header once, best matches first. Works on headers only: no data is read."""
    scored = sorted(((max(header_similarity(h, s) for s in names), f, h) for f, names in SYNONYMS.items() for h in headers), key=lambda x: (-x[0], x[1], x[2]))
    out: dict[str, tuple[str, float]] = {}
    used: set[str] = set()
    for score, f, h in scored:
        if score >= least and f not in out and h not in used:
            out[f] = (h, round(score if score == 1.0 else score * 0.9, 3))
            used.add(h)
    return out


def mapping_confidence(mapping: dict[str, tuple[str, float]], required: tuple[str, ...] = ("number", "ts")) -> float:
    """.4 of the coverage, .6 of the mean confidence, up to .2 for required fields; at most 1."""
    if not mapping:
        return 0.0
    coverage, mean = len(mapping) / len(SYNONYMS), sum(c for _, c in mapping.values()) / len(mapping)
    return round(min(1.0, 0.4 * coverage + 0.6 * mean + 0.2 * sum(f in mapping for f in required) / len(required)), 4)


def column_types(df: DataFrame) -> DataFrame:
    """For each text column: the type that most of its values look like, and their share; one scan."""
    tests = {"integer": r"^[+-]?\d+$", "decimal": r"^[+-]?\d+\.\d+$", "phone": r"^(\+\d[\d() .-]{6,18}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\d{10,11})$", "date": r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}", "time": r"^\d{1,2}:\d{2}(:\d{2})?$", "boolean": r"(?i)^(true|false|yes|no)$"}
    order = ["phone", "date", "time", "boolean", "integer", "decimal"]

    def one(c: str) -> Column:
        v = F.trim(F.col(c))
        there = v.isNotNull() & (v != "")
        n = F.greatest(F.count(F.when(there, 1)), F.lit(1))
        shares = F.array(*(F.struct((F.count(F.when(there & v.rlike(tests[t]), 1)) / n).alias("share"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(order)))
        best = F.array_max(shares)
        kind = F.when(best["share"] > 0.5, best["t"]).otherwise("string")
        return F.struct(F.lit(c).alias("column"), kind.alias("type"), F.round(F.when(best["share"] > 0.5, best["share"]).otherwise(1 - best["share"]), 4).alias("confidence"))

    found = df.agg(F.array(*(one(c) for c in df.columns)).alias("x"))
    return found.select(F.explode("x").alias("x")).select("x.*")


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The fields of the log as text, from the mapped columns; unmapped fields are null."""
    return df.select(*(F.col(f"`{mapping[f]}`").cast("string").alias(f) if f in mapping else F.lit(None).cast("string").alias(f) for f in FIELDS))


def normalize_records(raw: DataFrame) -> DataFrame:
    """Fields, an array of errors (field:reason) and quality: the share of filled fields that could be read. Other columns stay."""
    given = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    rest = [c for c in raw.columns if c not in FIELDS]
    content = F.substring(F.regexp_replace("content", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, 10_000)
    # Texts, then shapes, then values, then errors: what a later step uses more than once is worked out in an earlier one.
    texts = raw.select(*rest, *(F.col(c) for c in FIELDS), N.time_zone(F.col("ts")).alias("_zone"), N.phone_clean(F.col("number")).alias("_phone"), N.duration_parts(F.col("duration")).alias("_hms"))
    bare = texts.withColumn("_bare", N.time_bare(F.col("ts"), F.col("_zone")))
    shaped = bare.withColumn("_shape", N.time_shape(F.col("_bare")))
    shaped = shaped.withColumn("_iso", N.time_iso(F.col("_bare"), F.col("_shape")))
    values = shaped.select(
        *rest, *(given(c).alias(f"_given_{c}") for c in FIELDS if c != "content"), N.e164_of(F.col("_phone")).alias("number"), N.time_of(F.col("_iso"), F.col("_zone"), F.col("_bare"), F.col("_shape")).alias("ts"),
        N.duration_of(F.col("_hms")).alias("duration"), N.event_type(F.col("type")).alias("type"), N.direction(F.col("direction")).alias("direction"), content.alias("content"),
    )
    bad = [(c, F.col(f"_given_{c}") & F.col(c).isNull()) for c in ("number", "ts", "duration", "type", "direction")]
    missing = [(c, ~F.col(f"_given_{c}")) for c in ("number", "ts")]
    errors = F.array_compact(F.array(*(F.when(p, F.lit(f"{c}:invalid")) for c, p in bad), *(F.when(p, F.lit(f"{c}:missing")) for c, p in missing)))
    filled = sum(F.col(f"_given_{c}").cast("int") for c, _ in bad)
    failed = sum(p.cast("int") for _, p in bad)
    return values.select(
        *rest, "number", "ts", "duration", F.coalesce("type", F.lit("call")).alias("type"), F.coalesce("direction", F.lit("outbound")).alias("direction"), "content",
        errors.alias("errors"), F.round((filled - failed) / F.greatest(filled, F.lit(1)), 4).alias("quality"),
    )


def validate(records: DataFrame, low_year: int = 1990, high_year: int = 2050) -> DataFrame:
    """Adds rules of range to the errors of normalised records: years and durations."""
    more = F.filter(F.array(F.when((F.year("ts") < low_year) | (F.year("ts") > high_year), F.lit("ts:range")), F.when((F.col("type") == "sms") & (F.col("duration") > 0), F.lit("duration:unexpected"))), lambda e: e.isNotNull())
    return records.withColumn("errors", F.concat("errors", more))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    fatal = F.exists("errors", lambda e: e.isin("number:missing", "number:invalid", "ts:missing", "ts:invalid", "ts:range"))
    # As a generated row: a filter on the errors themselves would be pushed below their steps, with each step written out at each use.
    marked = records.select("*", F.explode(F.array(fatal)).alias("_fatal"))
    return marked.where(~F.col("_fatal")).drop("_fatal"), marked.where("_fatal").drop("_fatal")


def validation_stats(records: DataFrame) -> DataFrame:
    """Errors by field and reason with the records they concern."""
    # Outer, with nulls dropped later: explode would filter empty arrays below the steps that the errors are made in (see split_valid).
    e = records.select(F.explode_outer("errors").alias("e")).where("e IS NOT NULL").groupBy("e").agg(F.count("*").alias("records"))
    return e.select(F.split("e", ":")[0].alias("field"), F.split("e", ":")[1].alias("reason"), "records")


def batch_quality(records: DataFrame) -> DataFrame:
    """Records, valid ones, and valid share less min(.5, 2 x errors) and min(.3, 5 x critical errors) a record."""
    fatal = F.exists("errors", lambda e: e.isin("number:missing", "number:invalid", "ts:missing", "ts:invalid", "ts:range"))
    g = records.agg(F.count("*").alias("records"), F.count(F.when(~fatal, 1)).alias("valid"), F.sum(F.size("errors")).alias("errors"), F.count(F.when(fatal, 1)).alias("critical"))
    n = F.greatest("records", F.lit(1))
    score = F.col("valid") / n - F.least(F.lit(0.5), 2 * F.col("errors") / n) - F.least(F.lit(0.3), 5 * F.col("critical") / n)
    return g.select("records", "valid", "errors", F.round(F.greatest(F.lit(0.0), score), 4).alias("score"))


def validate_contacts(contacts: DataFrame) -> DataFrame:
    """Names cut to 255, counts not under 0, at most 20 distinct lower-case tags of letters, digits, _ and -."""
    tags = F.slice(F.array_distinct(F.transform(F.filter("tags", lambda t: t.rlike("^[A-Za-z0-9_-]{1,50}$")), F.lower)), 1, 20)
    zero = F.lit(0).cast("bigint")
    return contacts.withColumns({"name": F.substring(F.trim("name"), 1, 255), "tags": tags, "total_calls": F.greatest("total_calls", zero), "total_sms": F.greatest("total_sms", zero)})


def extract_contacts(events: DataFrame) -> DataFrame:
    """A contact for each number of valid events: first and last time and counters. Partial sums are made in each task."""
    n = F.count("number").alias("_n")  # 0 for the group of null alone; a filter on the number would be pushed below its steps
    return events.groupBy("number").agg(n, F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.when(F.col("type") == "call", 1)).alias("total_calls"), F.count(F.when(F.col("type") == "sms", 1)).alias("total_sms")).where("_n > 0").drop("_n")


#: Words that tell the class and language of a message.
CLASS_WORDS = {"spam": ["winner", "free", "prize", "click here", "congratulations", "urgent"], "business": ["meeting", "invoice", "project", "deadline", "client", "report"], "personal": ["love", "mom", "dad", "dinner", "birthday", "home"]}
ENGLISH, SPANISH = ["the", "and", "is", "of", "to", "in", "that"], ["el", "la", "de", "que", "en", "los", "las"]


def content_class(content: Column) -> Column:
    low = F.lower(content)
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return F.when(content.isNull(), None).otherwise(reduce(lambda rest, k: F.when(has(CLASS_WORDS[k]), k).otherwise(rest), reversed(list(CLASS_WORDS)), F.lit("general")))


def content_language(content: Column) -> Column:
    """en or es, by which has more of its commonest words; unknown with none or as many."""
    count = lambda words: F.regexp_count(F.lower(content), F.lit(r"\b(" + "|".join(words) + r")\b"))
    en, es = count(ENGLISH), count(SPANISH)
    return F.when(en > es, "en").when(es > en, "es").otherwise("unknown")


#: Kinds of personal data and their patterns, in order of precedence.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "credit_card": r"\b(?:\d{4}[ -]?){3}\d{4}\b", "phone": r"(?:\+?1[ .-]?)?\(?\b\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "url": r"https?://[^\s<>\"]+", "zip": r"\b\d{5}-\d{4}\b",
}


def pii_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """How often each kind of personal data occurs in each text; null texts count 0."""
    return texts.select(id_col, *(F.coalesce(F.regexp_count(text_col, F.lit(p)), F.lit(0)).cast("bigint").alias(k) for k, p in PII.items()))


def redact_pii(text: Column) -> Column:
    """Personal data replaced by [KIND], kind by kind in order of precedence."""
    return reduce(lambda t, k: F.regexp_replace(t, PII[k], f"[{k.upper()}]"), PII, text)


def pii_spans(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind, start, end, confidence of spans that don't overlap: surer first, then longer, then leftmost; cards must pass Luhn.

    Positions aren't to be had from SQL's regular expressions, so one Arrow function finds all kinds of a text at once.
    """
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    patterns = [(k, re.compile(p)) for k, p in PII.items()]
    sure = {"email": 0.95, "ssn": 0.9, "credit_card": 0.9, "phone": 0.8, "ip_address": 0.85, "url": 0.9, "zip": 0.6}

    def find(text: str) -> list[tuple[int, int, str, float]]:
        hits = []
        for kind, p in patterns:
            for m in p.finditer(text):
                c = sure[kind]
                if kind == "credit_card":
                    if not luhn(m[0]):
                        continue
                elif kind == "phone" and re.search(r"(?i)call|phone|tel|mobile", text[max(0, m.start() - 20) : m.start()]):
                    c += 0.1
                hits.append((m.start(), m.end(), kind, c))
        kept: list[tuple[int, int, str, float]] = []
        for h in sorted(hits, key=lambda h: (-h[3], h[0] - h[1], h[0])):
            if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
                kept.append(h)
        return sorted(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *h) for i, t in enumerate(b.column(1)) for h in find(t.as_py() or "")]  # one text at a time: a batch may hold long ones
            take = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([take, pa.array([r[3] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())], names=["id", "kind", "start", "end", "confidence"])

    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return t.mapInArrow(run, f"id {t.dtypes[0][1]}, kind string, start bigint, end bigint, confidence double").withColumnRenamed("id", id_col)


def luhn(number: str) -> bool:
    d = [int(c) for c in reversed(number) if c.isdigit()]
    return len(d) > 1 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def layout_features(lines: DataFrame) -> DataFrame:
    """Of a file's lines: count, mean length, and how many hold a phone, a date, a time and each delimiter."""
    v = F.col("value")
    has = lambda p: F.count(F.when(v.rlike(p), 1))
    return lines.agg(F.count("*").alias("lines"), F.round(F.avg(F.char_length(v)), 2).alias("mean_length"), has(r"\+?\d{10,11}|\d{3}[ .-]\d{3}[ .-]\d{4}").alias("phones"), has(r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\b20\d{6}\b").alias("dates"), has(r"\d{1,2}:\d{2}").alias("times"), has(",").alias("commas"), has(r"\|").alias("pipes"), has("\t").alias("tabs"))


def merge_insert(existing: DataFrame, new: DataFrame, keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """Upsert: rows of both by null-safe keys; a new value replaces the old one unless it is null.

    Of new rows that repeat a key, one is taken whole: the one with the greatest ``order`` (a null is least) and, of equals or
    without an order, the greatest by its values.
    """
    on = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    row = F.struct(*([F.col(order).alias("_order")] if order else []), *values)
    n = new.groupBy(*keys).agg(F.max(row).alias("_row")).select(*keys, *(F.col("_row")[v].alias(v) for v in values))
    e = existing.select(*keys, *values, F.lit(True).alias("_e")).alias("e")
    out = e.join(n.select(*keys, *values, F.lit(True).alias("_n")).alias("n"), on, "full")
    return out.select(*(F.when(F.col("e._e"), F.col(f"e.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys), *(F.coalesce(f"n.{v}", f"e.{v}").alias(v) for v in values))


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows that weren't taken): a new row is taken if no existing row has its keys (null equals null)."""
    on = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    fresh = new.alias("n").join(existing.select(*keys).distinct().alias("e"), on, "left_anti")
    again = new.alias("n").join(existing.select(*keys).distinct().alias("e"), on, "left_semi")
    return existing.unionByName(fresh), again


def upsert_contacts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Contacts of both by owner and number: new name if there is one, earliest and latest times, counters added."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("owner_id", "number").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("_new"))).alias("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("total_calls").alias("total_calls"), F.sum("total_sms").alias("total_sms"))
