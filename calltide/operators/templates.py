"""Layouts of files: templates by the likeness of their headers, new templates from clusters of files, and the structure of tables.

Header lists are compared as distinct lists of a carrier and format, whatever the number of their files. Two lists meet through
an inverted index of the pairs of characters in their names, and are compared only if enough names meet for the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.operators.ingest import map_fields
from calltide.operators.lineage import cut

LEAST = 0.7
#: Fields that a template should have, and how the parts of its confidence weigh.
REQUIRED = ("ts", "number", "type")
DELIMITERS = (",", "|", "\t", ";")


def grams_of(name: str, low: int = 2, high: int = 4) -> Counter:
    text = re.sub(r"\s\s+", " ", name.lower())
    return Counter(text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1))


def field_similarity(a: list[str], b: list[str]) -> float:
    """The mean over ``a`` of each name's best cosine with a name of ``b``, by TF-IDF of 2- to 4-grams over both lists' names.

    Inverse frequencies are smoothed: ln((1 + names) / (1 + names with the gram)) + 1. Names too short for any gram count by
    equality if no name of either list has one.
    """
    if not a or not b:
        return 0.0
    counts = [grams_of(x) for x in (*a, *b)]
    df = Counter(g for c in counts for g in c)
    if not df:
        low = {x.lower() for x in b}
        return sum(x.lower() in low for x in a) / max(len(a), len(b))
    idf = {g: math.log((1 + len(counts)) / (1 + n)) + 1 for g, n in df.items()}
    vectors = []
    for c in counts:
        v = {g: n * idf[g] for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({g: x / norm for g, x in v.items()})
    best = [max(sum(x * w.get(g, 0.0) for g, x in v.items()) for w in vectors[len(a) :]) for v in vectors[: len(a)]]
    return sum(best) / len(best)


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("headers_a").to_pylist(), batch.column("headers_b").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([field_similarity(x, y) for x, y in zip(a, b, strict=True)], pa.float64())], names=["a", "b", "similarity"])


def pairs_of_characters(name: Column) -> Column:
    low = F.regexp_replace(F.lower(name), r"\s\s+", " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2))))


def header_pairs(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b and similarity (of a's headers to b's) that reach ``least``; both sides: key, carrier, format, headers.

    A name that shares no two neighbouring characters with any of b's adds nothing, so at least ``least`` of a's names must.
    """
    index = lambda df, k: df.select(F.col("key").alias(k), "carrier", "format", F.size("headers").alias("n"), F.posexplode("headers").alias("i", "name"))
    a = index(left, "a").select("a", "carrier", "format", "n", "i", F.explode(pairs_of_characters(F.col("name"))).alias("g"))
    b = index(right, "b").select("b", "carrier", "format", F.explode(pairs_of_characters(F.col("name"))).alias("g")).distinct()
    met = a.join(b, ["carrier", "format", "g"]).select("a", "b", "n", "i").distinct()
    enough = met.groupBy("a", "b", "n").agg(F.count("*").alias("names")).where(F.col("names") >= least * F.col("n") - 1e-9)
    side = lambda df, k: df.select(F.col("key").alias(k), F.col("headers").alias(f"headers_{k}"))
    both = enough.select("a", "b").join(side(left, "a"), "a").join(side(right, "b"), "b")
    return both.mapInArrow(_similarities, "a string, b string, similarity double").where(F.col("similarity") >= least - 1e-12)


def header_lists(files: DataFrame) -> DataFrame:
    """The distinct header lists (sorted; nulls and blanks left out) of each carrier and format: key, carrier, format, headers, delimiter, files."""
    rows = files.select(
        F.coalesce("carrier", F.lit("unknown")).alias("carrier"), F.coalesce("format", F.lit("unknown")).alias("format"),
        F.array_sort(F.filter("headers", lambda h: h.isNotNull() & (F.trim(h) != ""))).alias("headers"), "delimiter",
    ).where(F.size("headers") > 0)
    sets = rows.groupBy("carrier", "format", "headers").agg(F.max("delimiter").alias("delimiter"), F.count("*").alias("files"))
    return sets.select(list_key().alias("key"), "*")


def list_key() -> Column:
    return F.md5(F.to_json(F.struct("carrier", "format", "headers")))


def match_lists(lists: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """The best template of each list of :func:`header_lists`, of those of its carrier and format that reach ``least``.

    ``templates``: template_id, carrier, format, headers. Gives key, template_id, similarity; ties go to the smallest template_id.
    """
    known = templates.select(F.col("template_id").alias("key"), "carrier", "format", "headers")
    best = header_pairs(lists, known, least).groupBy(F.col("a").alias("key")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("b"))).alias("m"))
    return best.select("key", F.col("m.b").alias("template_id"), (-F.col("m.s")).alias("similarity"))


def clusters(lists: DataFrame, least: float = LEAST) -> DataFrame:
    """key and cluster (the smallest key) of lists that are alike in both directions, directly or over others."""
    pairs = header_pairs(lists, lists, least).where("a <> b")
    links = cut(pairs.select("a", "b").intersect(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    at = lists.select("key", F.col("key").alias("cluster"))
    while True:
        # The least cluster among neighbours, and then that cluster's own: the way doubles.
        seen = links.join(at.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("cluster").alias("near"))
        nearer = at.join(seen, "key", "left").select("key", F.least("cluster", F.coalesce("near", "cluster")).alias("new"), "cluster")
        own = nearer.select(F.col("key").alias("new"), F.col("new").alias("far"))
        moved = cut(nearer.join(own, "new").select("key", F.least("new", "far").alias("cluster"), (F.least("new", "far") < F.col("cluster")).alias("moved")))
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def template_id(carrier: str, form: str, headers: list[str]) -> str:
    return f"{carrier}_{form}_{hashlib.md5(f'{carrier}_{form}_{chr(95).join(sorted(headers))}'.encode()).hexdigest()[:8]}"


def template_confidence(fields: dict[str, tuple[str, float]], delimiter: str | None, carrier: str) -> float:
    """.4 of the fields' mean confidence, .3 of required fields found, .2 for structure (.8 with a delimiter, else .4), .1 for the carrier (.9 if known, else .3)."""
    if not fields:
        return 0.0
    mean = sum(c for _, c in fields.values()) / len(fields)
    found = sum(f in fields for f in REQUIRED) / len(REQUIRED)
    return min(1.0, 0.4 * mean + 0.3 * found + 0.2 * (0.8 if delimiter else 0.4) + 0.1 * (0.9 if carrier != "unknown" else 0.3))


def _templates(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    names = ["cluster", "template_id", "carrier", "format", "headers", "mapping", "confidence"]
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.float64()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            fields = map_fields(r["headers"])
            rows.append((r["cluster"], template_id(r["carrier"], r["format"], r["headers"]), r["carrier"], r["format"], r["headers"], [(f, h) for f, (h, _) in fields.items()], round(template_confidence(fields, r["delimiter"], r["carrier"]), 4)))
        rows = [r for r in rows if r[-1] >= least]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def discover_templates(files: DataFrame, templates: DataFrame | None = None, least: float = LEAST, least_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(new templates; which list belongs to which template) of files that no template of ``templates`` matches.

    ``files``: carrier, format, headers, delimiter. Unmatched header lists are clustered; the list that most files of a cluster
    have (ties: the smallest key) is its template, with the fields that its headers map to and the confidence in it. Templates:
    template_id, carrier, format, headers, mapping, confidence, files, lists. Membership: key, template_id, files, new. Files
    without headers are left out.
    """
    lists = cut(header_lists(files))
    known = match_lists(lists, templates, least) if templates is not None else None
    rest = lists.join(known, "key", "left_anti") if known is not None else lists
    rest = cut(rest)
    own = rest.join(clusters(rest, least), "key")
    best = own.groupBy("cluster").agg(F.min(F.struct((-F.col("files")).alias("f"), "key", "carrier", "format", "headers", "delimiter")).alias("b"), F.sum("files").alias("files"), F.count("*").alias("lists"))
    made = best.select("cluster", "b.carrier", "b.format", "b.headers", "b.delimiter").mapInArrow(partial(_templates, least=least_confidence), "cluster string, template_id string, carrier string, format string, headers array<string>, mapping map<string,string>, confidence double")
    new = cut(made.join(best.select("cluster", "files", "lists"), "cluster"))
    members = own.join(new.select("cluster", "template_id"), "cluster").select("key", "template_id", "files", F.lit(True).alias("new"))
    if known is not None:
        members = members.unionByName(lists.join(known, "key").select("key", "template_id", "files", F.lit(False).alias("new")))
    return new.drop("cluster"), members


# -- The structure of tables


def cells(line: Column, delimiter: Column | str) -> Column:
    """The cells of a line, without outer quotes and blanks; a delimiter inside double quotes doesn't part."""
    if isinstance(delimiter, str):
        d = re.escape(delimiter)
        quoted = F.regexp_extract_all(line, F.lit(f'(?:^|{d})(\\s*"[^"]*+(?:""[^"]*+)*+"[^{d}]*+|[^{d}]*+)'), 1)
        parts = F.when(line.contains('"'), quoted).otherwise(F.split(line, d, -1))
        return F.transform(parts, lambda c: F.btrim(F.trim(c), F.lit("\"' ")))
    return reduce(lambda w, d: w.when(delimiter == d, cells(line, d)), DELIMITERS[1:], F.when(delimiter == DELIMITERS[0], cells(line, DELIMITERS[0])))


def cell_kind(cell: Column) -> Column:
    """e empty, n number, d date or time, t text."""
    date = r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2})"
    return F.when(cell == "", "e").when(cell.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "n").when(cell.rlike(date), "d").otherwise("t")


TOTAL = r"(?i)^(grand |sub)?\s?total\b|^(sum|count)\b"


def delimiters_of(lines: DataFrame) -> DataFrame:
    """file_id, delimiter and columns: the delimiter that gives most lines one number of cells (2 or more; ties: more cells, then as listed)."""
    n = F.array(*(F.struct(F.lit(-i).alias("place"), F.lit(d).alias("delimiter"), F.size(cells(F.col("value"), d)).alias("columns")) for i, d in enumerate(DELIMITERS)))
    counts = lines.select("file_id", F.explode(n).alias("d")).select("file_id", "d.*").where("columns > 1").groupBy("file_id", "place", "delimiter", "columns").agg(F.count("*").alias("lines"))
    best = counts.groupBy("file_id").agg(F.max(F.struct("lines", "columns", "place", "delimiter")).alias("b"))
    return best.select("file_id", "b.delimiter", "b.columns")


def shaped_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Each line's cells, and its kind by their shapes: body (as many cells as columns, a number or date among them), head (as many, all
    text), total, or other."""
    rows = lines.join(found, "file_id").withColumn("cells", cells(F.col("value"), F.col("delimiter")))
    rows = rows.withColumn("shape", F.array_join(F.transform("cells", cell_kind), ""))
    first = F.coalesce(F.get(F.filter("cells", lambda c: c != ""), F.lit(0)), F.lit(""))
    whole, told = F.size("cells") == F.col("columns"), F.col("shape").rlike("[nd]")
    kind = F.when(first.rlike(TOTAL), "total").when(whole & told, "body").when(whole & F.col("shape").rlike("^t+$"), "head").otherwise("other")
    return rows.withColumn("kind", kind)


def table_structure(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables; columns) of files given as lines (file_id, line, value), wherever their table stands in them.

    Lines align into columns by the delimiter that gives most of them one number of cells. The body is all lines with that
    number of cells, a number or a date among them; the header the last line of text cells before it; totals begin with such a
    word, or with a number and more than half of their cells empty after the last full line. Files whose cells are all text
    have their first whole line as header and the rest as body. Tables: file_id, delimiter, columns, header_line, first_line,
    last_line (of the body; null without one), body, totals, others (lines inside the body's stretch that aren't of it).
    Columns: file_id, place (from 0), name (null without a header), type (number over 80 % of filled cells, date over 60 %, else
    string), filled and empty. Everything is aggregated, so a file of any length is spread over tasks. Files without two cells in
    any line are left out, as are null values.
    """
    own = lines.where(F.col("value").isNotNull() & F.col("file_id").isNotNull()).select("file_id", "line", "value")
    shaped = shaped_lines(own, delimiters_of(own))
    body, head = F.col("kind") == "body", F.col("kind") == "head"
    empties = F.regexp_count("shape", F.lit("e")) * 2 > F.size("cells")
    at = F.col("line")
    spans = shaped.groupBy("file_id").agg(
        F.min(F.when(body & ~empties, at)).alias("first_body"), F.max(F.when(body & ~empties, at)).alias("last_body"), F.min(F.when(head, at)).alias("first_head"), F.max(F.when(head, at)).alias("last_head"),
    )
    text = F.col("first_body").isNull()  # no line has a number or a date
    spans = spans.select("file_id", text.alias("text"), "first_head", F.coalesce("first_body", F.col("first_head") + 1).alias("low"), F.when(text, F.col("last_head")).otherwise(F.col("last_body")).alias("high"))
    rows = shaped.join(spans, "file_id")
    header = F.when(F.col("text"), F.when(at == F.col("first_head"), at)).otherwise(F.when(head & (at < F.col("low")), at))
    inside = at.between(F.col("low"), F.col("high"))
    is_body = inside & F.when(F.col("text"), head).otherwise(body)
    is_total = (F.col("kind") == "total") | (~F.col("text") & body & empties & (at > F.col("high")))
    tables = rows.groupBy("file_id", "delimiter", F.col("columns")).agg(
        F.max(F.struct(header.alias("line"), F.col("cells"))).alias("h"), F.min(F.when(is_body, at)).alias("first_line"), F.max(F.when(is_body, at)).alias("last_line"),
        F.count_if(is_body).alias("body"), F.count_if(is_total).alias("totals"), F.count_if(inside & ~is_body & ~is_total).alias("others"),
    )
    names = F.when(F.col("h.line").isNotNull(), F.col("h.cells"))
    tables = tables.select("file_id", "delimiter", "columns", F.col("h.line").alias("header_line"), names.alias("names"), "first_line", "last_line", "body", "totals", "others")
    each = rows.where(is_body).select("file_id", F.posexplode("cells").alias("place", "cell")).withColumn("k", cell_kind(F.col("cell")))
    columns = each.groupBy("file_id", "place").agg(*(F.count_if(F.expr(p)).alias(n) for p, n in (("k = 'n'", "numbers"), ("k = 'd'", "dates"), ("k <> 'e'", "filled"), ("k = 'e'", "empty"))))
    kind = F.when((F.col("filled") > 0) & (F.col("numbers") > 0.8 * F.col("filled")), "number").when((F.col("filled") > 0) & (F.col("dates") > 0.6 * F.col("filled")), "date").otherwise("string")
    columns = columns.join(tables.select("file_id", "names"), "file_id").select("file_id", "place", F.get("names", F.col("place")).alias("name"), kind.alias("type"), "filled", "empty")
    return tables.drop("names"), columns
