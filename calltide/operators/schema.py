"""Schema rules as data: rows of rules become one expression, records split into good and error rows in one pass, and scores of batches.

A rule is a row of ``RULES``; a table of them is configuration, a few rows to a few thousand. All rules of an entity are
evaluated in one select over the records, whatever their number: nothing is joined and nothing is read twice. Users' own
validators and transformations are functions from columns to columns, looked up by the name that a rule or a mapping has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

#: A table of rules. ``kind``: required, format (pattern, lengths, allowed values, type 'datetime'), range, or custom (validator's name).
RULES = (
    "entity string, field string, kind string, message string, pattern string, min_length int, max_length int, allowed array<string>, type string, low double, high double, optional boolean, validator string, position int"
)
#: A table of mappings from the columns of a file to fields.
MAPPINGS = "source string, target string, data_type string, transformation string, required boolean"

#: The rules that events and contacts come with.
PHONE = r"^\+?1?[0-9]{10,15}$"
DEFAULTS = [
    {"entity": "event", "field": "ts", "kind": "required", "message": "Timestamp is required"},
    {"entity": "event", "field": "ts", "kind": "format", "type": "datetime", "message": "Invalid timestamp format"},
    {"entity": "event", "field": "number", "kind": "required", "message": "Phone number is required"},
    {"entity": "event", "field": "number", "kind": "format", "pattern": PHONE, "min_length": 10, "max_length": 15, "message": "Invalid phone number format"},
    {"entity": "event", "field": "type", "kind": "format", "allowed": ["call", "sms", "mms", "voicemail", "missed_call"], "message": "Invalid event type"},
    {"entity": "event", "field": "direction", "kind": "format", "allowed": ["incoming", "outgoing"], "message": "Invalid direction - must be incoming or outgoing"},
    {"entity": "event", "field": "duration", "kind": "range", "low": 0.0, "high": 86400.0, "message": "Duration must be between 0 and 86400 seconds (24 hours)"},
    {"entity": "contact", "field": "phone_number", "kind": "required", "message": "Phone number is required for contact"},
    {"entity": "contact", "field": "phone_number", "kind": "format", "pattern": PHONE, "min_length": 10, "max_length": 15, "message": "Invalid contact phone number format"},
    {"entity": "contact", "field": "name", "kind": "format", "min_length": 1, "max_length": 255, "message": "Contact name must be 1-255 characters"},
    {"entity": "contact", "field": "email", "kind": "format", "pattern": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "optional": True, "message": "Invalid email format"},
]
#: How grave an error of each type is.
SEVERITY = {
    "file_format_error": "critical", "parsing_error": "error", "validation_error": "error", "database_error": "critical", "system_error": "critical",
    "duplicate_data": "warning", "missing_required_field": "error", "invalid_data_type": "error", "constraint_violation": "error",
}

ERROR = "struct<field:string,kind:string,type:string,message:string,value:string>"
Validator = Callable[[Column], Column]


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_table(spark, DEFAULTS)


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a table; what a rule doesn't say is null, and ``position`` is its place in the list."""
    names = [part.split()[0] for part in RULES.split(", ")]
    return spark.createDataFrame([tuple({"position": i, **r}.get(n) for n in names) for i, r in enumerate(rules)], RULES)


def shown(number: float) -> str:
    return str(int(number)) if float(number).is_integer() else str(number)


def text(c: Column) -> Column:
    return c.cast("string")


def is_time(c: Column) -> Column:
    """ISO dates and times, and month/day/year with or without a time."""
    american = [F.try_to_timestamp(text(c), F.lit(f)).isNotNull() for f in ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")]
    return text(c).try_cast("timestamp").isNotNull() | reduce(lambda a, b: a | b, american)


def as_number(c: Column) -> Column:
    """The number that a text is; an empty or null one is 0, any other text null."""
    t = F.trim(text(c))
    return F.when(t.isNull() | (t == ""), F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


#: Validators that rules of kind custom may name: a column is good where the validator is true.
VALIDATORS: dict[str, Validator] = {
    "no_control_characters": lambda c: ~text(c).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"),
    "not_blank": lambda c: F.trim(text(c)) != "",
    "luhn": lambda c: luhn(text(c)),
}


def luhn(c: Column) -> Column:
    """Digits whose check digit is right."""
    digits = F.reverse(F.split(F.regexp_replace(c, "[^0-9]", ""), ""))
    double = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(double(d.cast("int"))))
    return (F.size(values) > 1) & (F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0)


def iso_time(c: Column) -> Column:
    at = F.coalesce(text(c).try_cast("timestamp"), *(F.try_to_timestamp(text(c), F.lit(f)) for f in ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss")))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), text(c))


def plus_phone(c: Column) -> Column:
    """Digits after a +; ten digits are of country 1."""
    digits = F.regexp_replace(text(c), r"\D", "")
    return F.when(F.char_length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(F.concat(F.lit("+"), digits))


def seconds_of(c: Column) -> Column:
    """minutes:seconds, or the number that a text begins with; 0 for others."""
    clock = F.regexp_extract(text(c), r"^(\d+):(\d{2})$", 1)
    parts = F.split(text(c), ":")
    leading = F.regexp_extract(text(c), r"^\s*([+-]?\d*\.?\d+)", 1)
    value = F.when(clock != "", F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double")).otherwise(F.coalesce(leading.try_cast("double"), F.lit(0.0)))
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


#: Transformations that mappings may name; an unknown name leaves the value as it is.
TRANSFORMATIONS: dict[str, Validator] = {
    "phone_normalize": plus_phone, "timestamp_normalize": iso_time, "duration_seconds": seconds_of,
    "trim_whitespace": lambda c: F.trim(text(c)), "uppercase": lambda c: F.upper(text(c)), "lowercase": lambda c: F.lower(text(c)),
}


def typed(c: Column, data_type: str | None) -> Column:
    """The value's text as its type writes it, or as it is where it can't be read so."""
    low = F.lower(text(c))
    if data_type == "number":
        n = as_number(c)
        return F.coalesce(F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string")), text(c))
    if data_type == "date":
        return iso_time(c)
    if data_type == "boolean":
        return F.when(low.isin("true", "1", "yes"), "true").when(low.isin("false", "0", "no", ""), "false").otherwise("true")
    return text(c)


def map_record(records: DataFrame, mappings: DataFrame | list[Row], transformations: Mapping[str, Validator] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Target fields as text, typed and then transformed; ``keep`` names columns that stay as they are.

    A null source gives a null field. A source that the records lack gives a null field if it's required, and none otherwise.
    Of several mappings to one target the last holds.
    """
    known = TRANSFORMATIONS | dict(transformations or {})
    out: dict[str, Column] = {}
    for m in mappings.collect() if isinstance(mappings, DataFrame) else mappings:
        if m["source"] in records.columns:
            value = typed(F.col(f"`{m['source']}`"), m["data_type"])
            out[m["target"]] = F.when(F.col(f"`{m['source']}`").isNotNull(), known.get(m["transformation"], lambda c: c)(value))
        elif m["required"]:
            out[m["target"]] = F.lit(None).cast("string")
    return records.select(*(F.col(f"`{k}`") for k in keep), *(v.alias(k) for k, v in out.items()))


def rule_error(rule: Row, there: bool, validators: Mapping[str, Validator]) -> Column | None:
    """null where the field keeps the rule, else (field, kind, type, message, value). ``there``: the records have that column."""
    value = F.col(f"`{rule['field']}`") if there else F.lit(None).cast("string")
    field, kind = rule["field"], rule["kind"]

    def error(message: str, type_: str) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(type_).alias("type"), F.lit(message).alias("message"), text(value).alias("value"))

    if kind == "required":
        return F.when(value.isNull() | (text(value) == ""), error(rule["message"], "missing_required_field"))
    if kind == "format":
        steps: list[tuple[Column, Column]] = []
        if not rule["optional"]:
            steps.append((value.isNull(), error(f"{field} is required", "missing_required_field")))
        if rule["pattern"]:
            steps.append((~text(value).rlike(rule["pattern"]), error(rule["message"], "validation_error")))
        if rule["min_length"]:
            steps.append((F.char_length(text(value)) < rule["min_length"], error(f"{field} must be at least {rule['min_length']} characters", "constraint_violation")))
        if rule["max_length"]:
            steps.append((F.char_length(text(value)) > rule["max_length"], error(f"{field} must be at most {rule['max_length']} characters", "constraint_violation")))
        if rule["allowed"] is not None:
            steps.append((~text(value).isin(*rule["allowed"]) if rule["allowed"] else value.isNotNull(), error(rule["message"], "validation_error")))
        if rule["type"] == "datetime":
            steps.append((value.isNotNull() & ~is_time(value), error(rule["message"], "invalid_data_type")))
        if not steps:
            return None
        first, *rest = steps  # a rule gives the first of its errors
        return reduce(lambda w, s: w.when(*s), rest, F.when(*first))
    if kind == "range":
        number = as_number(value) if there else F.lit(None).cast("double")
        out = F.when(number.isNull(), error(f"{field} must be a number", "invalid_data_type"))
        if rule["low"] is not None:
            out = out.when(number < rule["low"], error(f"{field} must be at least {shown(rule['low'])}", "constraint_violation"))
        return out.when(number > rule["high"], error(f"{field} must be at most {shown(rule['high'])}", "constraint_violation")) if rule["high"] is not None else out
    if kind == "custom":
        if rule["validator"] not in validators:
            raise ValueError(f"no validator is called {rule['validator']}")
        return F.when(~F.coalesce(validators[rule["validator"]](value), F.lit(False)), error(rule["message"], "validation_error"))
    raise ValueError(f"a rule of no known kind: {kind}")


def check(records: DataFrame, rules: DataFrame, entity: str, validators: Mapping[str, Validator] | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """All columns, and ``errors`` (field, kind, type, message, value), ``warnings`` (field, message) and ``is_valid``.

    ``rules`` has the columns of ``RULES``; errors come in the order of ``position``. ``validators`` adds to ``VALIDATORS``, and
    replaces those of the same name; a custom rule that gives null counts as broken. A null number is 0 in a range, as an empty
    text is; a column that the records lack breaks every rule about it but optional ones. Fields that no rule of the entity
    names and that aren't null give a warning, except those in ``known``. Columns called errors, warnings or is_valid are
    replaced.
    """
    own = [r for r in rules.where(F.col("entity") == entity).orderBy("position", "field", "kind").collect()]
    own_validators = VALIDATORS | dict(validators or {})
    records = records.drop("errors", "warnings", "is_valid")
    errors = [e for r in own if (e := rule_error(r, r["field"] in records.columns, own_validators)) is not None]
    expected = {r["field"] for r in own} | set(known)
    odd = [c for c in records.columns if c not in expected]
    warnings = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("field"), F.lit(f"Unexpected field '{c}' found in {entity}").alias("message"))) for c in odd]
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = records.select(
        "*",
        (F.array_compact(F.array(*errors)).cast(f"array<{ERROR}>") if errors else none(ERROR)).alias("errors"),
        (F.array_compact(F.array(*warnings)) if warnings else none("struct<field:string,message:string>")).alias("warnings"),
    )
    return out.withColumn("is_valid", F.size("errors") == 0)


def rule_statistics(checked: DataFrame, top: int = 10) -> DataFrame:
    """field, kind, message and how many records broke that rule, of the ``top`` commonest (ties by field and kind)."""
    e = checked.select(F.explode("errors").alias("e")).groupBy("e.field", "e.kind").agg(F.count("*").alias("records"), F.min("e.message").alias("message"))
    return e.orderBy(F.desc("records"), "field", "kind").limit(top).select("field", "kind", "message", "records")


def summary(checked: DataFrame) -> DataFrame:
    """total, valid, invalid, error_rate in percent (0 for none), warnings: one row."""
    n = F.count("*")
    return checked.agg(
        n.alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"),
        F.coalesce(F.count_if(~F.col("is_valid")) * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("error_rate"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
    )


def severity(type_: Column) -> Column:
    return reduce(lambda w, k: w.when(type_ == k, SEVERITY[k]), list(SEVERITY)[1:], F.when(type_ == next(iter(SEVERITY)), SEVERITY[next(iter(SEVERITY))])).otherwise("error")


def error_records(checked: DataFrame, job: str, row_col: str, warnings: bool = True) -> DataFrame:
    """A row for each error (and warning): job, row, field, type, message, severity, and the record as JSON."""
    fields = [c for c in checked.columns if c not in ("errors", "warnings", "is_valid")]
    all_ = F.transform("errors", lambda e: F.struct(e["field"].alias("field"), e["type"].alias("type"), e["message"].alias("message"), severity(e["type"]).alias("severity")))
    if warnings:
        all_ = F.concat(all_, F.transform("warnings", lambda w: F.struct(w["field"].alias("field"), F.lit("validation_error").alias("type"), w["message"].alias("message"), F.lit("warning").alias("severity"))))
    rows = checked.select(F.lit(job).alias("job"), F.col(f"`{row_col}`").alias("row"), all_.alias("e"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in fields))).alias("raw"))
    return rows.select("job", "row", F.explode("e").alias("e"), "raw").select("job", "row", "e.*", "raw")


def write_split(checked: DataFrame, path: str, job: str, row_col: str, mode: str = "errorifexists") -> tuple[DataFrame, DataFrame, dict]:
    """Good records and error rows, written in one pass over the input, and the counts that this pass observed.

    A record is a row of the part ``good`` if it's valid, and of the part ``error`` once for each of its errors and warnings.
    Both parts are folders of one Parquet table, so a lost task is run again and its files are committed once. The counts are
    total, valid, invalid, errors and warnings.
    """
    seen = Observation()
    fields = [c for c in checked.columns if c not in ("errors", "warnings", "is_valid")]
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    watched = checked.observe(seen, F.count("*").alias("total"), n(F.col("is_valid").cast("int")).alias("valid"), n((~F.col("is_valid")).cast("int")).alias("invalid"), n(F.size("errors")).alias("errors"), n(F.size("warnings")).alias("warnings"))
    record = F.struct(*(F.col(f"`{c}`") for c in fields))
    kind = "struct<field:string,type:string,message:string,severity:string>"
    errors = F.concat(
        F.transform("errors", lambda e: F.struct(e["field"].alias("field"), e["type"].alias("type"), e["message"].alias("message"), severity(e["type"]).alias("severity"))),
        F.transform("warnings", lambda w: F.struct(w["field"].alias("field"), F.lit("validation_error").alias("type"), w["message"].alias("message"), F.lit("warning").alias("severity"))),
    )
    outcomes = F.concat(
        F.when(F.col("is_valid"), F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(f"array<{kind}>")),
        errors,
    )
    rows = watched.select(record.alias("record"), F.col(f"`{row_col}`").alias("row"), F.explode(outcomes).alias("error"))
    good = F.col("error").isNull()
    rows = rows.select(F.when(good, F.col("record")).alias("record"), F.when(~good, F.col("row")).alias("row"), "error", F.when(~good, F.to_json("record")).alias("raw"), F.when(good, "good").otherwise("error").alias("part"))
    schema = rows.schema
    rows.write.mode(mode).partitionBy("part").parquet(path)
    back = checked.sparkSession.read.schema(schema).parquet(path)
    return back.where("part = 'good'").select("record.*"), back.where("part = 'error'").select(F.lit(job).alias("job"), "row", "error.*", "raw"), seen.get


def batch_scores(batches: DataFrame) -> DataFrame:
    """``batches`` (total, parsed, validation_errors, duplicates, unique, error_rate in percent, gap_score or null, mapping, normalization,
    duplicate_accuracy, completeness), and three scores of each:

    ``parse_score`` (0 to 1): .4 of the parsed share, .4 of the parsed without errors, .2 of those that aren't duplicates; a part
    over no parsed rows counts 0 (but .2 for no duplicates), no rows at all score 0. ``etl_score`` (0 to 100): 100 less half the
    error rate, less .3 of the duplicates in percent of unique rows (20 at most), no more than the score of gaps.
    ``pipeline_score`` (0 to 1): .25 mapping, .30 normalization, .25 duplicate_accuracy, .20 completeness; nulls count 0.
    """
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0.0))
    parse = 0.4 * share(c("parsed"), c("total")) + 0.4 * share(c("parsed") - c("validation_errors"), c("parsed")) + 0.2 * (1 - share(c("duplicates"), c("parsed")))
    duplicates = F.when(c("duplicates") > 0, F.least(0.3 * F.coalesce(c("duplicates") * 100.0 / F.nullif(c("unique"), F.lit(0)), F.lit(float("inf"))), F.lit(20.0))).otherwise(0.0)
    etl = 100 - 0.5 * c("error_rate") - duplicates
    etl = F.least(etl, F.coalesce(c("gap_score"), etl))
    within = lambda x, high: F.greatest(F.lit(0.0), F.least(F.lit(high), x))
    return batches.select(
        "*", F.when(c("total") == 0, 0.0).otherwise(within(parse, 1.0)).alias("parse_score"), within(etl, 100.0).alias("etl_score"),
        (0.25 * zero("mapping") + 0.30 * zero("normalization") + 0.25 * zero("duplicate_accuracy") + 0.20 * zero("completeness")).alias("pipeline_score"),
    )
