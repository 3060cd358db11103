"""Confidence of mappings and the carriers' default templates, on columns worked out by hand."""

import pytest

from calltide.operators import mapping as M
from calltide.operators import templates as T


def test_parts_of_confidence(spark):
    assert M.semantic_similarity("Call_Date", "ts") == 0.9 and M.semantic_similarity("xyz", "place") == 0.3 and M.semantic_similarity("q", "cost") == 0.0
    assert M.semantic_similarity("zz m", "number") == 0.1 and M.semantic_similarity("aeiou", "location") == 0.5
    assert (M.penalties("ab", "ts"), M.penalties("Data date", "number"), M.penalties("Phone", "number")) == (0.1, 0.5, 0.0)
    df = spark.createDataFrame([("2024-01-05", "x", None), ("soon", "5551234567", ""), (None, "555-123-4567", None), ("10:30", "  ", None)], "When string, No string, Empty string")
    got = {r["source"]: r for r in M.mapping_confidence(df, [("When", "ts", 1.0), ("No", "number", 0.5), ("Empty", "duration", 0.2), ("Empty", "cost", 0.2)], "att", {("No", "number"): 1.0}).collect()}
    assert got["When"]["pattern"] == pytest.approx(2 / 3) and got["When"]["confidence"] == pytest.approx(0.3 + 0.25 * 2 / 3 + 0.18 + 0.105 + 0.05, abs=1e-4)
    assert got["No"]["confidence"] == pytest.approx(0.15 + 0.25 * 2 / 3 + 0.2 * M.semantic_similarity("No", "number") + 0.105 + 0.1 - 0.1, abs=1e-4) and got["Empty"]["pattern"] == 0.5
    assert M.mapping_confidence(df, []).count() == 0


def test_templates_come_first(spark):
    df = spark.createDataFrame([("1/5/2024", "5551234567", "Call", "3", "in")], "Date string, `Number Called` string, Type string, Minutes string, Flow string")
    found, quality = M.suggest_mappings(df, "verizon")
    got = {r["source"]: (r["target"], r["ml"], r["required"]) for r in found.collect()}
    assert got == {"Date": ("ts", 0.95, True), "Number Called": ("number", 0.95, True), "Type": ("type", 0.95, True), "Minutes": ("duration", 0.95, False), "Flow": ("direction", 1.0, True)}
    q = quality.collect()[0]
    assert q["completeness"] == 1.0 and q["template"] == "verizon_default" and q["quality"] == pytest.approx(0.6 + 0.4 * q["mean_confidence"], abs=1e-4)
    none = M.suggest_mappings(df.select("Minutes").withColumnRenamed("Minutes", "qqq"))[1].collect()[0]
    assert tuple(none) == (0.0, 0.0, 0.0, None)
    empty = M.suggest_mappings(df.limit(0), "verizon")[0].collect()
    assert {r["pattern"] for r in empty} == {0.5}


def test_default_templates_match_their_files(spark):
    files = spark.createDataFrame([("att", "csv", ["Date/Time", "Phone Number", "Direction", "Duration"], ","), ("verizon", "csv", ["Date", "Number Called", "Type", "Minutes used"], ",")], "carrier string, format string, headers array<string>, delimiter string")
    lists = T.header_lists(files)
    got = {r["template_id"] for r in T.match_lists(lists, M.carrier_templates(spark)).collect()}
    assert got == {"att_default", "verizon_default"}
