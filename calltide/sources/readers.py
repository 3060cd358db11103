"""Readers of carriers' files into the log's fields. The driver looks at a sample; Spark reads the files, split by split."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators.ingest import FIELDS, apply_mapping, map_fields
from calltide.sources import detect

SAMPLE = 50
#: The forms of carriers' records, two each: number, date, time, direction, duration, type are the groups.
CARRIER_LINES = {
    "att": [
        r"^CDR\|(?<date>\d{8})\|(?<time>\d{6})\|(?<number>\+?\d+)\|(?<way>[OI])\|(?<length>\d+)\|(?<kind>[CS])$",
        r"^(?<date>\d{2}/\d{2}/\d{4}),(?<time>\d{2}:\d{2}:\d{2}),(?<number>[0-9+() -]+),(?<way>[OI][A-Za-z]*),(?<length>\d+)$",
    ],
    "verizon": [
        r"^VZW\|(?<date>\d{4}-\d{2}-\d{2})\|(?<time>\d{2}:\d{2}:\d{2})\|(?<number>\+?\d+)\|(?<way>[OI])\|(?<length>\d+)$",
        r"^(?<date>\d{8})(?<time>\d{6})(?<number>[0-9+()-]+?) *(?<way>[IO])(?<length>\d{6})(?<kind>[CV])$",
    ],
    "tmobile": [
        r"^TMO:(?<date>\d{4}-\d{2}-\d{2}):(?<time>\d{2}:\d{2}:\d{2}):(?<number>\+?\d+):(?<way>[OI]):(?<length>\d+)$",
        r"^(?<date>\d{2}/\d{2}/\d{4})\s+(?<time>\d{2}:\d{2}:\d{2})\s+(?<number>[0-9+()-]+)\s+(?<way>[IO])\s+(?<length>\d+)$",
    ],
    "sprint": [
        r"^SPR\|(?<date>\d{8})\|(?<time>\d{6})\|(?<number>\+?\d+)\|(?<way>[OI])\|(?<length>\d+)\|(?<kind>[CS])$",
        r"^(?<date>\d{8})(?<time>\d{6})(?<number>\d{10})(?<way>[IO])(?<length>\d{5})(?<kind>[CV])$",
    ],
}
GROUPS = ["date", "time", "number", "way", "length", "kind"]


class TooManyErrors(ValueError):
    """More rows of a file are malformed than the reader takes."""


def sample_lines(spark: SparkSession, path: str | list[str], n: int = SAMPLE, charset: str = "UTF-8") -> list[str]:
    if charset.startswith("UTF-16"):  # its lines can't be parted byte by byte
        whole = spark.read.format("binaryFile").load(path).select(F.decode(F.substring("content", 1, 1 << 16), charset).alias("t")).limit(1).collect()
        return [line.removesuffix("\r") for line in (whole[0]["t"] if whole else "").lstrip("\ufeff").split("\n")[:n]]
    value = F.col("value") if charset == "UTF-8" else widened(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), charset)
    return [r["value"] for r in spark.read.text(path).select(value.alias("value")).limit(n).collect()]


def widened(text: Column, charset: str) -> Column:
    """A text read as ISO-8859-1 with the marks that windows-1252 has in the place of control characters; others as they are."""
    marks = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
    return F.translate(text, "".join(marks), "".join(marks.values())) if charset == "windows-1252" else text


def file_report(spark: SparkSession, path: str | list[str], max_bytes: int = detect.MAX_BYTES, max_rows: int = detect.MAX_ROWS) -> DataFrame:
    """For each text file: file, bytes, rows, first_line, charset, accepted and reason (null, empty, too large, too many rows).

    One pass over all bytes, spread over tasks, that leaves a row a file. A file is UTF-16 if it has null bytes, UTF-8 if all its lines are
    valid, else windows-1252 if some byte lies in the range 80 to 9F, else ISO-8859-1. An empty file has no rows to report.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    valid = F.is_valid_utf8("value")
    high = ~valid & F.hex(F.col("value").cast("binary")).rlike("^(?:..)*?[89][0-9A-F]")
    first = F.min_by(F.hex(F.col("value").cast("binary")), F.struct("block", "at"))
    g = lines.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"), first.alias("_first"), F.bool_or(F.col("value").contains("\x00")).alias("_null"), F.bool_and(valid).alias("_valid"), F.bool_or(high).alias("_high"))
    charset = F.when(F.col("_null"), "UTF-16").when(F.col("_valid"), "UTF-8").when(F.col("_high"), "windows-1252").otherwise("ISO-8859-1")
    reason = F.when(F.col("bytes") == 0, "empty").when(F.col("bytes") > max_bytes, "too large").when(F.col("rows") > max_rows, "too many rows")
    return g.select("file", "bytes", "rows", F.col("_first").alias("first_line"), charset.alias("charset"), reason.isNull().alias("accepted"), reason.alias("reason"))


def read_csv_files(spark: SparkSession, path: str | list[str], mapping: dict[str, str] | None = None, max_bytes: int = detect.MAX_BYTES, max_rows: int = detect.MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows; report) of many CSV files of several charsets and headers: rows have the fields, ``corrupt`` and ``file``.

    Files of one charset and first line are one read, so that there are as many reads as kinds of files, not as files. Files over the limits
    are left out whole and stand in the report (see :func:`file_report`) with the reason.
    """
    report = file_report(spark, path, max_bytes, max_rows)
    kinds: dict[tuple[str, str], list[str]] = {}
    for r in report.where("accepted").select("file", "charset", "first_line").collect():  # a row a file, as Spark's own listing has
        kinds.setdefault((r["charset"], r["first_line"]), []).append(r["file"])
    parts = [read_csv(spark, sorted(files), mapping, charset=charset).select("*", F.col("_metadata.file_path").alias("file")) for (charset, _), files in sorted(kinds.items())]
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in [*FIELDS, "corrupt", "file"]))
    return reduce(DataFrame.unionByName, parts, none), report


def read_csv(spark: SparkSession, path: str | list[str], mapping: dict[str, str] | None = None, max_errors: float = 0.1, check: bool = False, charset: str | None = None) -> DataFrame:
    """Delimiter and header are found in a sample, columns mapped by name if no mapping is given; so is the charset, in all of the file.

    Malformed rows are read permissively: their text is in ``corrupt``. With ``check``, a share of them over ``max_errors``
    raises; that is a pass over the file. Rows without number and time stay: validation tells them.
    """
    charset = charset or next((r["charset"] for r in file_report(spark, path).groupBy("charset").count().orderBy(F.desc("count"), "charset").collect()), "UTF-8")
    lines = sample_lines(spark, path, charset=charset)
    sep, _ = detect.delimiter(lines)
    rows = [detect.fields(line, sep) for line in lines]
    at = detect.header_row(rows)
    names = [c.strip() or f"column{i}" for i, c in enumerate(rows[at])] if at is not None else [f"column{i}" for i in range(max(map(len, rows), default=1))]
    schema = ", ".join(f"`{n}` string" for n in [*names, "corrupt"])
    raw = spark.read.schema(schema).option("sep", sep).option("encoding", "ISO-8859-1" if charset == "windows-1252" else charset).option("multiLine", charset.startswith("UTF-16")).option("header", at == 0).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").csv(path)
    if at:
        # The header, and what stands before it, are known lines of the sample: rows equal to one of them go, all others stay.
        width = len(names)
        known = [[v or None for v in (row + [None] * width)[:width]] for row in rows[: at + 1]]
        same = lambda row: reduce(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.lit(v)) for n, v in zip(names, row, strict=True)])
        raw = raw.where(~reduce(lambda a, b: a | b, map(same, known)))
    if mapping is None:
        mapping = {f: h for f, (h, _) in map_fields(names).items()}
    out = raw.select(*(widened(F.col(f"`{mapping[f]}`"), charset).alias(f) if f in mapping else F.lit(None).cast("string").alias(f) for f in FIELDS), "corrupt")
    if check:
        n = raw.agg(F.count("*").alias("n"), F.count("corrupt").alias("bad"), *(F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(names))).first()  # a parsed column must be read, too
        if n["n"] and n["bad"] / n["n"] > max_errors:
            raise TooManyErrors(f"{n['bad']} of {n['n']} rows are malformed")
    return out


def carrier_of_lines(lines: list[str]) -> str | None:
    """The carrier whose pattern fits most sampled lines, if it fits over 30 % of them."""
    import re

    share = {c: sum(any(re.match(p.replace("(?<", "(?P<"), line) for p in forms) for line in lines) / max(len(lines), 1) for c, forms in CARRIER_LINES.items()}
    best = max(share, key=share.get)
    return best if share[best] > 0.3 else None


def group_of(forms: list[str], name: str) -> Column:
    """The group of the first form that a line fits; null without."""
    parts = []
    for form in forms:
        names = [p.split(">")[0] for p in form.split("(?<")[1:]]
        parts.append(F.when(F.col("value").rlike(form), F.regexp_extract("value", form, names.index(name) + 1) if name in names else F.lit(None)))
    return F.coalesce(*parts)


def read_cdr(spark: SparkSession, path: str) -> DataFrame:
    """A carrier's records, else delimited, fixed-width or free text; the fields as text, and the line."""
    lines = [line for line in sample_lines(spark, path) if line.strip()]
    text = spark.read.text(path).where(F.trim("value") != "")
    carrier = carrier_of_lines(lines)
    if carrier:
        g = {n: group_of(CARRIER_LINES[carrier], n) for n in GROUPS}
        fits = text.where(reduce(lambda a, b: a | b, [F.col("value").rlike(form) for form in CARRIER_LINES[carrier]]))
        date, time = g["date"], g["time"]
        compact = F.concat(date, F.lit(" "), time)
        kind = F.when(g["kind"] == "S", "sms").otherwise("call")
        return fits.select(g["number"].alias("number"), compact.alias("ts"), g["length"].alias("duration"), kind.alias("type"), F.when(g["way"].startswith("I"), "inbound").otherwise("outbound").alias("direction"), F.lit(None).cast("string").alias("content"), F.col("value").alias("line"))
    sep, score = detect.delimiter(lines)
    if score > 0.5 and not (sep == ":" and detect.fixed_width(lines)):
        return by_looks(text, F.split("value", "\\" + sep if sep in "|" else sep))
    if detect.fixed_width(lines):
        cuts = detect.columns_of_blanks(lines)
        return by_looks(text, F.array(*(F.trim(F.substring("value", a, n)) for a, n in cuts)))
    return by_patterns(text)


def by_looks(text: DataFrame, cells: Column) -> DataFrame:
    """Each field is the first cell that looks like it."""
    t = text.withColumn("_c", F.transform(cells, F.trim))
    first = lambda p: F.get(F.filter("_c", lambda x: x.rlike(p)), F.lit(0))
    date, time = first(r"^\d{4}-\d{2}-\d{2}"), first(r"^\d{1,2}:\d{2}:\d{2}$")
    ts = F.when(F.char_length(date) == 10, F.concat_ws(" ", date, time)).otherwise(date)
    return t.select(
        first(r"^\+?\d{10,12}$|^\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$").alias("number"), ts.alias("ts"), first(r"^\d{1,5}$").alias("duration"), first("(?i)^(call|voice|sms|text|mms)$").alias("type"),
        first("(?i)^(in|out|inbound|outbound|incoming|outgoing|i|o)$").alias("direction"), F.lit(None).cast("string").alias("content"), F.col("value").alias("line"),
    )


def by_patterns(text: DataFrame) -> DataFrame:
    """Each field is the first match of its pattern anywhere in the line."""
    v = F.col("value")
    hit = lambda p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    return text.select(
        hit(r"(\+?\d{10,12}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})").alias("number"), hit(r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?|\d{1,2}/\d{1,2}/\d{4}(?: \d{1,2}:\d{2})?)").alias("ts"), hit(r"\b(\d{1,5}) ?(?:s|sec|seconds)\b").alias("duration"),
        hit(r"(?i)\b(call|voice|sms|text|mms)\b").alias("type"), hit(r"(?i)\b(inbound|outbound|incoming|outgoing)\b").alias("direction"), F.lit(None).cast("string").alias("content"), v.alias("line"),
    )


def read_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    raw = spark.read.option("multiLine", multi_line).json(path)
    return apply_mapping(raw, {f: h for f, (h, _) in map_fields(raw.columns).items()})


def read_sms_xml(spark: SparkSession, path: str) -> DataFrame:
    """<sms address date type body .../> rows of a backup; type 1 was received."""
    schema = "_address string, _date string, _type string, _body string"
    raw = spark.read.format("xml").option("rowTag", "sms").schema(schema).load(path)
    return raw.select(F.col("_address").alias("number"), F.col("_date").alias("ts"), F.lit(None).cast("string").alias("duration"), F.lit("sms").alias("type"), F.when(F.col("_type") == "1", "inbound").otherwise("outbound").alias("direction"), F.col("_body").alias("content"))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of workbooks, one task for each file; needs openpyxl on the executors."""
    import importlib.util
    import io
    from collections.abc import Iterator

    import pyarrow as pa

    if importlib.util.find_spec("openpyxl") is None:
        raise ImportError("reading workbooks needs openpyxl")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import openpyxl

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                book = openpyxl.load_workbook(io.BytesIO(data), read_only=True, data_only=True)
                for sheet in book.worksheets:
                    lines = ["\t".join("" if c is None else str(c) for c in row) for row in sheet.iter_rows(values_only=True)]
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([sheet.title] * n), pa.array(lines, pa.string())], names=["file", "sheet", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, sheet string, value string")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of PDF files, then fields by their patterns; needs pdfplumber on the executors. No OCR."""
    import importlib.util
    import io
    from collections.abc import Iterator

    import pyarrow as pa

    if importlib.util.find_spec("pdfplumber") is None:
        raise ImportError("reading PDF files needs pdfplumber")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pdfplumber

        for b in batches:
            for data in b.column(0).to_pylist():
                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    for page in pdf.pages:
                        yield pa.RecordBatch.from_arrays([pa.array((page.extract_text() or "").split("\n"), pa.string())], names=["value"])

    return by_patterns(spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "value string"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"csv": read_csv, "cdr": read_cdr, "json": read_json, "xml": read_sms_xml, "xlsx": read_excel, "xls": read_excel, "pdf": read_pdf}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reads by what the first bytes and the name of ``path`` say."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096).alias("head"), "length", "path").first()
    if head is None:
        raise FileNotFoundError(path)
    return READERS[detect.file_format(path, bytes(head["head"]))](spark, path)


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The fields of several files of any formats, with the file each row is from."""
    return reduce(DataFrame.unionByName, [read_any(spark, p).select(*FIELDS, F.lit(p).alias("file")) for p in paths])
