"""Which column of a file is which field, and how sure that is: carriers' templates first, then names and values.

Values are looked at in one aggregate over the whole table, whatever the number of columns; names and weights are literals of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators.ingest import map_fields

#: Weights of the confidence's parts, patterns of fields' values, words of their names, penalties for names.
WEIGHTS = {"ml": 0.30, "pattern": 0.25, "semantic": 0.20, "template": 0.15, "feedback": 0.10}
PATTERNS = {
    "ts": r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}|\d{1,2}:\d{2}(:\d{2})?|\d{10,13}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec",
    "number": r"\+?1?\d{10}|\(\d{3}\)\s?\d{3}-\d{4}|\d{3}[-\.]\d{3}[-\.]\d{4}",
    "duration": r"\d+:\d{2}(:\d{2})?|\d+(\.\d+)?\s*(min|sec|hr|hours?|minutes?|seconds?)|^\d+$",
    "type": r"call|sms|text|voice|data|video|incoming|outgoing|inbound|outbound",
    "direction": r"in|out|incoming|outgoing|inbound|outbound|received|sent|[io]",
}
KEYWORDS = {
    "ts": ["date", "time", "timestamp", "datetime", "when", "occurred"], "number": ["phone", "number", "contact", "caller", "recipient"], "duration": ["duration", "length", "time", "minutes", "seconds"],
    "type": ["type", "kind", "category", "service", "call"], "direction": ["direction", "flow", "way", "incoming", "outgoing"], "content": ["message", "text", "content", "body", "description"],
    "cost": ["cost", "charge", "price", "fee", "amount", "bill"], "location": ["location", "area", "city", "region", "place"],
}
GENERIC = ["field", "column", "data", "value", "item"]
REQUIRED = ["ts", "number", "type", "direction"]
#: The templates that carriers come with: source, target, type, required, confidence.
TEMPLATES = {
    "att": [("Date/Time", "ts", "date", True, 0.95), ("Phone Number", "number", "string", True, 0.98), ("Direction", "direction", "string", True, 0.92), ("Duration", "duration", "number", False, 0.88)],
    "verizon": [("Date", "ts", "date", True, 0.93), ("Number Called", "number", "string", True, 0.96), ("Type", "type", "string", True, 0.90), ("Minutes", "duration", "number", False, 0.85)],
}


def carrier_templates(spark: SparkSession) -> DataFrame:
    """template_id, carrier, format and headers of the default templates, as ``templates.match_lists`` takes them."""
    rows = [(f"{c}_default", c, "csv", [f for f, *_ in fields]) for c, fields in TEMPLATES.items()]
    return spark.createDataFrame(rows, "template_id string, carrier string, format string, headers array<string>")


def semantic_similarity(source: str, target: str) -> float:
    """.9 if a word of the field stands in the name, else .1 for each word of which some letter does, .8 at most; .3 for unknown fields."""
    name = source.lower().replace("_", " ").replace("-", " ")
    words = KEYWORDS.get(target)
    if words is None:
        return 0.3
    if any(w in name for w in words):
        return 0.9
    return min(0.8, round(0.1 * sum(any(c in name for c in w) for w in words), 1))


def penalties(source: str, target: str) -> float:
    """.1 for names under 3 characters, .2 for generic ones, .3 for a number called a date."""
    low = source.lower()
    return round(0.1 * (len(source) < 3) + 0.2 * any(g in low for g in GENERIC) + 0.3 * (target == "number" and "date" in low), 1)


def pattern_share(column: str, target: str) -> Column:
    """The share of the column's filled values that look like the field's; .5 without a pattern or a value."""
    if target not in PATTERNS:
        return F.lit(0.5)
    v = F.lower(F.trim(F.col(f"`{column}`").cast("string")))
    there = v.isNotNull() & (v != "")
    return F.coalesce(F.avg(F.when(there, v.rlike(PATTERNS[target]).cast("double"))), F.lit(0.5))


def mapping_confidence(df: DataFrame, pairs: list[tuple[str, str, float]], carrier: str = "unknown", feedback: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """source, target, the five parts, penalty and confidence of each of ``pairs`` (column, field, model's confidence); one pass over ``df``.

    Confidence is the weighted sum of the parts less the penalty, between 0 and 1. ``feedback`` is what users have said of a pair (.5 if nothing);
    a known carrier counts .7, others .3.
    """
    said = feedback or {}

    def row(source: str, target: str, ml: float) -> Column:
        parts = {"ml": F.lit(float(ml)), "pattern": F.col(f"p{pairs.index((source, target, ml))}"), "semantic": F.lit(semantic_similarity(source, target)), "template": F.lit(0.7 if carrier != "unknown" else 0.3), "feedback": F.lit(float(said.get((source, target), 0.5)))}
        total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) - penalties(source, target)
        return F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), *(c.alias(k) for k, c in parts.items()), F.lit(penalties(source, target)).alias("penalty"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("confidence"))

    if not pairs:
        return df.sparkSession.createDataFrame([], "source string, target string, ml double, pattern double, semantic double, template double, feedback double, penalty double, confidence double")
    shares = df.agg(*(pattern_share(source, target).alias(f"p{i}") for i, (source, target, _) in enumerate(pairs)))
    return shares.select(F.explode(F.array(*(row(*p) for p in pairs))).alias("r")).select("r.*")


def suggest_mappings(df: DataFrame, carrier: str = "unknown", feedback: dict[tuple[str, str], float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(suggestions: as :func:`mapping_confidence`, and required; quality: completeness, mean_confidence, quality, template).

    Columns that the carrier's template names take its fields, .1 surer (.95 at most); others those that their names say. A field is suggested once.
    Completeness is the share of required fields suggested, quality .6 of it and .4 of the mean confidence.
    """
    known = {s: (t, min(0.95, c + 0.1)) for s, t, _, _, c in TEMPLATES.get(carrier, [])}
    pairs = [(c, *known[c]) for c in df.columns if c in known]
    taken = {t for _, t, _ in pairs}
    rest = map_fields([c for c in df.columns if c not in known])
    pairs += [(source, target, sure) for target, (source, sure) in rest.items() if target not in taken]
    found = mapping_confidence(df, pairs, carrier, feedback).withColumn("required", F.col("target").isin(*REQUIRED))
    share = F.size(F.collect_set(F.when(F.col("required"), F.col("target")))) / len(REQUIRED)
    quality = found.agg(share.alias("completeness"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    return found, quality.select("completeness", F.round("mean_confidence", 4).alias("mean_confidence"), F.round(F.col("completeness") * 0.6 + F.col("mean_confidence") * 0.4, 4).alias("quality"), F.lit(f"{carrier}_default" if any(c in known for c in df.columns) else None).cast("string").alias("template"))
