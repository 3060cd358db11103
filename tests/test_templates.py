"""Templates by headers and the structure of tables, against plain loops over small files."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from calltide.operators import templates as T

FILES = "carrier string, format string, headers array<string>, delimiter string, key string, n int"


def plain_similarity(a, b):
    """TF-IDF and cosines written out with vectors over all grams."""
    docs = [[t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] for t in (x.lower() for x in a + b)]
    grams = sorted({g for d in docs for g in d})
    idf = {g: math.log((1 + len(docs)) / (1 + sum(g in d for d in docs))) + 1 for g in grams}
    rows = []
    for d in docs:
        v = [d.count(g) * idf[g] for g in grams]
        norm = math.sqrt(sum(x * x for x in v)) or 1
        rows.append([x / norm for x in v])
    return sum(max(sum(x * y for x, y in zip(u, w, strict=True)) for w in rows[len(a) :]) for u in rows[: len(a)]) / len(a)


LISTS = [
    ["Date", "Phone Number", "Duration", "Call Type"], ["date", "phone number", "duration", "call type"], ["Date/Time", "Phone Number", "Duration (sec)", "Call Type"], ["Timestamp", "MSISDN", "Seconds", "Service"],
    ["Timestamp", "MSISDN", "Secs", "Service", "Cell"], ["x"], ["Call Date", "Call Time", "Number", "Minutes"], ["Name", "Amount", "Balance"], ["Names", "Amounts", "Balances"],
]


def test_similarity_is_that_of_plain_vectors():
    for a in LISTS[:5]:
        for b in LISTS:
            assert T.field_similarity(a, b) == pytest.approx(plain_similarity(a, b) if b != ["x"] else 0.0)
    assert T.field_similarity(["a", "B"], ["b"]) == 0.5 and T.field_similarity([], ["a"]) == 0.0 and T.field_similarity(LISTS[0], LISTS[0]) == pytest.approx(1)


@pytest.fixture(scope="module")
def files(spark):
    rows = [(c, f, h, d, "clash", 1) for i, h in enumerate(LISTS) for c, f, d in (("att", "csv", ","), ("verizon", "csv", None)) for _ in range(i + 1)]
    rows += [("att", "csv", list(reversed(LISTS[0])), ",", None, None), ("att", "txt", LISTS[0], "|", None, None), (None, None, LISTS[7], None, None, None), ("att", "csv", None, ",", "", 0), ("att", "csv", [None, " "], ",", "", 0)]
    return spark.createDataFrame(rows, FILES)


KNOWN = [("t2", "att", "csv", LISTS[1]), ("t1", "att", "csv", LISTS[0]), ("t3", "verizon", "csv", LISTS[3]), ("t4", "att", "txt", LISTS[3])]


def test_matches_equal_a_loop_over_all_templates(spark, files):
    lists = T.header_lists(files)
    got = {r["key"]: (r["template_id"], round(r["similarity"], 9)) for r in T.match_lists(lists, spark.createDataFrame(KNOWN, "template_id string, carrier string, format string, headers array<string>")).collect()}
    want = {}
    for r in lists.collect():
        scored = [(-round(T.field_similarity(r["headers"], h), 9), t) for t, c, f, h in KNOWN if (c, f) == (r["carrier"], r["format"])]
        best = min(((s, t) for s, t in scored if -s >= 0.7), default=None)
        if best:
            want[r["key"]] = (best[1], -best[0])
    assert got == want and len(want) >= 4
    assert {r["files"] for r in lists.where("carrier = 'att' AND format = 'csv'").collect()} >= {2}


def test_new_templates_are_clusters_of_what_no_template_matches(spark, files):
    known = spark.createDataFrame(KNOWN, "template_id string, carrier string, format string, headers array<string>")
    new, members = T.discover_templates(files, known)
    lists = {r["key"]: r for r in T.header_lists(files).collect()}
    by = {r["key"]: (r["template_id"], r["new"]) for r in members.collect()}
    assert set(by) == set(lists)
    matched = {r["key"] for r in T.match_lists(T.header_lists(files), known).collect()}
    rest = [k for k in lists if k not in matched]
    near = {k: {o for o in rest if (lists[o]["carrier"], lists[o]["format"]) == (lists[k]["carrier"], lists[k]["format"]) and min(T.field_similarity(lists[k]["headers"], lists[o]["headers"]), T.field_similarity(lists[o]["headers"], lists[k]["headers"])) >= 0.7} for k in rest}
    left, groups = set(rest), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += near[k]
        left -= group
        groups.append(group)
    got = {}
    for k, (t, is_new) in by.items():
        assert is_new == (k not in matched)
        if is_new:
            got.setdefault(t, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups)) and any(len(g) > 1 for g in groups)
    rows = {r["template_id"]: r for r in new.collect()}
    assert set(rows) == set(got)
    for t, group in got.items():
        best = min(group, key=lambda k: (-lists[k]["files"], k))
        r, own = rows[t], lists[best]
        assert r["headers"] == own["headers"] and t == T.template_id(own["carrier"], own["format"], own["headers"])
        assert r["files"] == sum(lists[k]["files"] for k in group) and r["lists"] == len(group)
        fields = T.map_fields(own["headers"])
        assert r["mapping"] == {f: h for f, (h, _) in fields.items()} and r["confidence"] == pytest.approx(T.template_confidence(fields, own["delimiter"], own["carrier"]), abs=1e-4)
    none = T.discover_templates(files.limit(0), known)
    assert none[0].count() == 0 and none[1].count() == 0
    everything, _ = T.discover_templates(files.where("carrier = 'att'"))
    assert everything.count() > 3 and T.discover_templates(files, least_confidence=1.1)[0].count() == 0


def test_confidence_of_templates():
    fields = {"ts": ("Date", 1.0), "number": ("Phone", 0.8)}
    assert T.template_confidence(fields, ",", "att") == pytest.approx(0.4 * 0.9 + 0.3 * 2 / 3 + 0.16 + 0.09)
    assert T.template_confidence(fields, None, "unknown") == pytest.approx(0.4 * 0.9 + 0.3 * 2 / 3 + 0.08 + 0.03)
    assert T.template_confidence({}, ",", "att") == 0.0


TEXTS = {
    "plain": ["Date,Phone,Seconds,Kind", "2024-01-01,+15551234567,60,call", "2024-01-02,+15551234568,,sms", "1/3/2024,5551234567,7,call"],
    "around": ["Account report", "", "for May, 2024", "Date|Phone|Note", "2024-01-01|555|hello", "-- page 2 --", "2024-01-02|556|\"a|b\"", "2024-01-02||only a date", "Total|2|", "printed by x"],
    "text": ["Name;City", "Ann;Rome", "Bob;Oslo", "x"],
    "quoted": ['"When","Who, what","How long"', '"2024-01-01","Smith, ""J""",5', "'2024-01-02',Ann,6", ",,11"],
    "tabs": ["10:30\t5\t6", "10:31:02\t7\t8"],
    "none": ["nothing here", "at all"], "empty": [""],
}


def test_structure_of_tables(spark):
    rows = [(f, i, v, "clash") for f, lines in TEXTS.items() for i, v in enumerate(lines)] + [("plain", 9, None, ""), (None, 0, "a,b", "")]
    tables, columns = T.table_structure(spark.createDataFrame(rows, "file_id string, line long, value string, cells string"))
    got = {r["file_id"]: tuple(r)[1:] for r in tables.collect()}
    assert got == {
        "plain": (",", 4, 0, 1, 3, 3, 0, 0), "around": ("|", 3, 3, 4, 7, 3, 1, 1), "text": (";", 2, 0, 1, 2, 2, 0, 0), "quoted": (",", 3, 0, 1, 2, 2, 1, 0), "tabs": ("\t", 3, None, 0, 1, 2, 0, 0),
    }
    by = {}
    for r in columns.orderBy("file_id", "place").collect():
        by.setdefault(r["file_id"], []).append(tuple(r)[2:])
    assert by["plain"] == [("Date", "date", 3, 0), ("Phone", "number", 3, 0), ("Seconds", "number", 2, 1), ("Kind", "string", 3, 0)]
    assert by["quoted"] == [("When", "date", 2, 0), ("Who, what", "string", 2, 0), ("How long", "number", 2, 0)]
    assert by["tabs"] == [(None, "date", 2, 0), (None, "number", 2, 0), (None, "number", 2, 0)] and by["around"][1] == ("Phone", "number", 2, 1)
    none = T.table_structure(spark.createDataFrame([], "file_id string, line long, value string"))
    assert none[0].count() == 0 and none[1].count() == 0


def test_lines_with_many_quotes_take_no_time(spark):
    line = ",".join(f'"a{i}, ""b"""' for i in range(30_000))
    out = spark.createDataFrame([(line,)], "v string").select(F.size(T.cells(F.col("v"), ",")).alias("n")).collect()[0]["n"]
    assert out == 30_000
    assert Counter(T.grams_of("ab  c")) == {"ab": 1, "b ": 1, " c": 1, "ab ": 1, "b c": 1, "ab c": 1}
