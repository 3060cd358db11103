"""Schema rules as data, error records in one pass, and scores of batches."""

import json

import pytest
from pyspark.sql import functions as F

from calltide.operators import schema as R

RECORD = "row long, ts string, number string, type string, direction string, duration string, note string"
GOOD = ("2024-01-05T10:00:00", "+15551234567", "call", "incoming", "60")


@pytest.fixture(scope="module")
def rules(spark):
    return R.default_rules(spark)


def errors_of(df):
    return {r["row"]: [(e["field"], e["kind"], e["message"]) for e in r["errors"]] for r in df.collect()}


CASES = [
    (GOOD, []),
    ((None, *GOOD[1:]), [("ts", "required", "Timestamp is required"), ("ts", "format", "ts is required")]),
    (("", *GOOD[1:]), [("ts", "required", "Timestamp is required"), ("ts", "format", "Invalid timestamp format")]),
    (("soon", *GOOD[1:]), [("ts", "format", "Invalid timestamp format")]),
    (("1/5/2024 9:30", *GOOD[1:]), []),
    ((GOOD[0], "555-1234", *GOOD[2:]), [("number", "format", "Invalid phone number format")]),
    ((GOOD[0], "+1234567890123456", *GOOD[2:]), [("number", "format", "number must be at most 15 characters")]),
    ((*GOOD[:2], "Call", *GOOD[3:]), [("type", "format", "Invalid event type")]),
    ((*GOOD[:3], None, "60"), [("direction", "format", "direction is required")]),
    ((*GOOD[:4], "-1"), [("duration", "range", "duration must be at least 0")]),
    ((*GOOD[:4], "86401"), [("duration", "range", "duration must be at most 86400")]),
    ((*GOOD[:4], "2m"), [("duration", "range", "duration must be a number")]),
    ((*GOOD[:4], None), []),
    ((*GOOD[:4], ""), []),
    ((*GOOD[:4], " 1.5e3 "), []),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(i, *values, None) for i, (values, _) in enumerate(CASES)], RECORD)


def test_default_rules(spark, records, rules):
    got = R.check(records, rules, "event", known=("row",))
    assert errors_of(got) == {i: want for i, (_, want) in enumerate(CASES)}
    assert {r["row"]: r["is_valid"] for r in got.collect()} == {i: not want for i, (_, want) in enumerate(CASES)}
    total = got.transform(R.summary).collect()[0]
    bad = sum(bool(want) for _, want in CASES)
    assert (total["total"], total["valid"], total["invalid"], total["warnings"]) == (len(CASES), len(CASES) - bad, bad, 0) and total["error_rate"] == pytest.approx(bad * 100 / len(CASES))
    none = R.summary(R.check(records.limit(0), rules, "event")).collect()[0]
    assert tuple(none) == (0, 0, 0, 0.0, 0)


def test_one_scan_whatever_the_number_of_rules(spark, rules, records, tmp_path):
    records.write.parquet(str(tmp_path / "r"))
    many = rules.unionByName(R.rules_table(spark, [{"entity": "event", "field": "note", "kind": "format", "optional": True, "pattern": f"^{i}", "message": f"no {i}"} for i in range(60)]))
    plan = R.check(spark.read.parquet(str(tmp_path / "r")), many, "event")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_contact_rules_and_optional_fields(spark, rules):
    rows = [(0, "+15551234567", "Ann", "a@b.co"), (1, "5551234567", "", None), (2, None, "x" * 256, "a b@c"), (3, "5551234567", "Bob", "no")]
    got = R.check(spark.createDataFrame(rows, "row long, phone_number string, name string, email string"), rules, "contact", known=("row",))
    assert errors_of(got) == {
        0: [],
        1: [("name", "format", "name must be at least 1 characters")],
        2: [("phone_number", "required", "Phone number is required for contact"), ("phone_number", "format", "phone_number is required"), ("name", "format", "name must be at most 255 characters"), ("email", "format", "Invalid email format")],
        3: [("email", "format", "Invalid email format")],
    }


def test_columns_that_are_missing_unknown_or_clash(spark, rules):
    df = spark.createDataFrame([(1, "x", "+15551234567", None), (2, None, None, 7)], "row int, errors string, number string, `odd name` int")
    got = R.check(df, rules, "event", known=("row",))
    assert got.columns == ["row", "number", "odd name", "errors", "warnings", "is_valid"]
    by = {r["row"]: r for r in got.collect()}
    assert [e["field"] for e in by[1]["errors"]] == ["ts", "ts", "type", "direction", "duration"]
    assert by[1]["warnings"] == [] and [tuple(w) for w in by[2]["warnings"]] == [("odd name", "Unexpected field 'odd name' found in event")]
    nothing = R.check(df, rules, "invoice").collect()[0]
    assert nothing["errors"] == [] and nothing["is_valid"] and len(nothing["warnings"]) == 2


def test_validators_of_users(spark, rules):
    own = R.rules_table(spark, [{"entity": "card", "field": "n", "kind": "custom", "validator": "luhn", "message": "no card"}, {"entity": "card", "field": "n", "kind": "custom", "validator": "short", "message": "long"}, {"entity": "card", "field": "n", "kind": "custom", "validator": "not_blank", "message": "blank"}])
    df = spark.createDataFrame([(0, "4111 1111 1111 1111"), (1, "4111111111111112"), (2, None), (3, "  ")], "row long, n string")
    got = errors_of(R.check(df, own, "card", {"short": lambda c: F.char_length(c) < 20}, known=("row",)))
    assert {k: [m for *_, m in v] for k, v in got.items()} == {0: [], 1: ["no card"], 2: ["no card", "long", "blank"], 3: ["no card", "blank"]}
    with pytest.raises(ValueError, match="short"):
        R.check(df, own, "card")
    with pytest.raises(ValueError, match="magic"):
        R.check(df, R.rules_table(spark, [{"entity": "card", "field": "n", "kind": "magic"}]), "card")


def test_mappings_with_named_transformations(spark):
    rows = [(1, "(555) 123-4567", "2:05", " x ", "yes", "12.50", "1/5/2024 9:30"), (2, "15551234567", "90.5 s", None, "off", "abc", "soon"), (3, "44 20", "none", "", "0", "7.0", "2024-01-05")]
    df = spark.createDataFrame(rows, "row long, Phone string, Len string, Text string, Flag string, Amount string, At string")
    m = [("Phone", "number", "string", "phone_normalize", True), ("Len", "duration", "string", "duration_seconds", True), ("Text", "content", "string", "shout", False), ("Flag", "flag", "boolean", None, False), ("Amount", "amount", "number", None, False), ("At", "ts", "date", None, True), ("Nowhere", "place", "string", None, True), ("Nowhere", "gone", "string", None, False)]
    got = R.map_record(df, spark.createDataFrame(m, R.MAPPINGS), {"shout": lambda c: F.concat(F.upper(c), F.lit("!"))}, keep=("row",))
    assert got.columns == ["row", "number", "duration", "content", "flag", "amount", "ts", "place"]
    assert [tuple(r) for r in got.orderBy("row").collect()] == [
        (1, "+15551234567", "125", " X !", "true", "12.5", "2024-01-05T09:30:00.000Z", None),
        (2, "+15551234567", "90.5", None, "true", "abc", "soon", None),
        (3, "+4420", "0", "!", "false", "7", "2024-01-05T00:00:00.000Z", None),
    ]


def test_error_records_and_severity(spark, records, rules):
    got = R.error_records(R.check(records, rules, "event"), "j", "row").collect()
    by = {}
    for r in got:
        by.setdefault(r["row"], []).append((r["field"], r["type"], r["severity"]))
        assert r["job"] == "j" and json.loads(r["raw"])["row"] == r["row"]
    assert by[1] == [("ts", "missing_required_field", "error"), ("ts", "missing_required_field", "error"), ("row", "validation_error", "warning")]
    assert by[3][0] == ("ts", "invalid_data_type", "error") and by[9][0] == ("duration", "constraint_violation", "error")
    assert sum(r["severity"] == "warning" for r in got) == len(CASES)
    grave = spark.createDataFrame([(k,) for k in [*R.SEVERITY, "other"]], "t string").select("t", R.severity(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in grave.collect()} == {**R.SEVERITY, "other": "error"}


def test_good_and_error_rows_in_one_pass(spark, records, rules, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    checked = R.check(records.mapInArrow(count, records.schema), rules, "event", known=("row",))
    good, bad, seen = R.write_split(checked, str(tmp_path / "out"), "j", "row")
    assert passes.value == len(CASES)
    want = [i for i, (_, e) in enumerate(CASES) if not e]
    assert sorted(r["row"] for r in good.collect()) == want and good.columns == records.columns
    assert sorted((r["row"], r["field"], r["message"]) for r in bad.collect()) == sorted((i, f, m) for i, (_, e) in enumerate(CASES) for f, _, m in e)
    assert seen == {"total": len(CASES), "valid": len(want), "invalid": len(CASES) - len(want), "errors": sum(len(e) for _, e in CASES), "warnings": 0}
    assert passes.value == len(CASES)
    same = {(r["row"], r["field"], r["type"], r["message"], r["severity"], r["raw"]) for r in R.error_records(checked, "j", "row").collect()}
    assert {(r["row"], r["field"], r["type"], r["message"], r["severity"], r["raw"]) for r in bad.collect()} == same
    nothing = R.write_split(R.check(records.limit(0), rules, "event"), str(tmp_path / "none"), "j", "row")
    assert (nothing[0].count(), nothing[1].count(), nothing[2]["total"]) == (0, 0, 0)


def test_scores_of_batches(spark):
    names = "name string, total long, parsed long, validation_errors long, duplicates long, `unique` long, error_rate double, gap_score double, mapping double, normalization double, duplicate_accuracy double, completeness double"
    rows = [
        ("plain", 100, 90, 9, 18, 72, 10.0, None, 0.8, 0.5, 0.99, 1.0), ("none", 0, 0, 0, 0, 0, 0.0, None, None, None, None, None), ("gaps", 100, 100, 0, 0, 100, 0.0, 42.0, 1.0, 1.0, 1.0, 1.0),
        ("worst", 10, 0, 0, 5, 0, 100.0, None, 0.0, 0.0, 0.0, 0.0), ("many", 100, 100, 0, 90, 10, 0.0, 99.0, 0.0, 0.0, 0.0, 0.0),
    ]
    got = {r["name"]: (round(r["parse_score"], 6), round(r["etl_score"], 6), round(r["pipeline_score"], 6)) for r in R.batch_scores(spark.createDataFrame(rows, names)).collect()}
    assert got["plain"] == (round(0.4 * 0.9 + 0.4 * 0.9 + 0.2 * 0.8, 6), 100 - 5 - 7.5, round(0.2 + 0.15 + 0.2475 + 0.2, 6))
    assert got["none"] == (0.0, 100.0, 0.0) and got["gaps"] == (1.0, 42.0, 1.0)
    assert got["worst"] == (0.2, 30.0, 0.0) and got["many"] == (round(0.8 + 0.2 * 0.1, 6), 80.0, 0.0)
