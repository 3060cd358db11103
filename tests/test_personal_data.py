"""Spans of personal data, strategies by kind, and what a rewrite preserves."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calltide.operators import ingest as I
from calltide.operators import personal_data as D

TEXTS = {
    0: "Call me: +1 (555) 123-4567 or mail ann.smith@example.com today.", 1: "SSN 123-45-6789, card 4111 1111 1111 1111, bad card 4111 1111 1111 1112", 2: "My name is Dr Ann Smith, born 12/31/1980; I live at 12 Main Street, Springfield, IL",
    3: "passport AB1234567 for travel; driver license B12345678", 4: "server ip 10.20.30.40 and 2001:0db8:0000:0000:0000:ff00:0042:8329", 5: "", 6: None, 7: "nothing here, 42 apples", 8: "code ZX-99 and P.O. Box 77", 9: "12345678 alone", 10: "bank account 123456789012",
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([*[(i, t, "clash") for i, t in TEXTS.items()], (0, TEXTS[0], "")], "doc long, body string, spans string").repartition(3)


def kinds(spans, text):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in spans]


def test_spans_of_every_kind(table):
    got = {}
    for r in D.find_spans(table, "doc", "body", D.Detector()).collect():
        assert all(a["end"] <= b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False)) and all(s["confidence"] >= D.THRESHOLD for s in r["spans"])
        got[r["doc"]] = kinds(r["spans"], TEXTS[r["doc"]] or "")
    assert got[0] == [("phone_number", "+1 (555) 123-4567"), ("email_address", "ann.smith@example.com")]
    assert got[1][:2] == [("ssn", "123-45-6789"), ("credit_card", "4111 1111 1111 1111")] and "4111 1111 1111 1112" not in [v for _, v in got[1]]
    assert got[2] == [("person_name", "Dr Ann Smith"), ("date_of_birth", "12/31/1980"), ("address", "12 Main Street, Springfield, IL")]
    assert got[3] == [("passport", "AB1234567"), ("driver_license", "B12345678")] and got[10] == [("bank_account", "123456789012")]
    assert got[4] == [("ip_address", "10.20.30.40"), ("ip_address", "2001:0db8:0000:0000:0000:ff00:0042:8329")]
    assert got[5] == got[6] == got[7] == got[9] == [] and got[8] == [("address", "P.O. Box 77")]
    counts = {r["kind"]: (r["spans"], r["texts"]) for r in D.span_counts(D.find_spans(table, "doc", "body")).collect()}
    assert counts["ip_address"] == (2, 1) and counts["email_address"] == (2, 2)


def test_kinds_of_users(table):
    d = D.Detector(custom={"badge": [r"\b[A-Z]{2}-\d{2}\b"], "address": [r"42 apples"]}, kinds=("badge", "address"))
    got = {r["doc"]: kinds(r["spans"], TEXTS[r["doc"]] or "") for r in D.find_spans(table, "doc", "body", d).collect()}
    assert got[8] == [("badge", "ZX-99"), ("address", "P.O. Box 77")] and got[7] == [("address", "42 apples")] and got[0] == []


def test_strategies_and_quality(table):
    got = {r["doc"]: r for r in D.anonymize_texts(table, "doc", "body", key=b"k").collect()}
    assert got[0]["anonymized"] == "Call me: [PHONE] or mail [EMAIL] today." and got[5]["anonymized"] == "" and got[6]["anonymized"] is None and got[7]["anonymized"] == TEXTS[7]
    assert got[2]["anonymized"].startswith("My name is NAME_") and ", born 1980; I live at Springfield, IL" in got[2]["anonymized"]
    assert (got[7]["quality"], got[7]["length_ratio"], got[7]["structure"], got[7]["context"]) == (1.0, 1.0, True, True)
    assert got[0]["length_ratio"] == round(len(got[0]["anonymized"]) / len(TEXTS[0]), 4) and got[0]["context"] and 0 < got[0]["quality"] < 1
    other = {r["doc"]: r["anonymized"] for r in D.anonymize_texts(table, "doc", "body", {"phone_number": "tokenization", "email_address": "mask", "person_name": "suppression", "address": "suppression"}, key=b"k").collect()}
    assert "X" * len("ann.smith@example.com") in other[0] and other[2].startswith("My name is [NAME], born 1980; I live at [ADDRESS]")
    token = other[0][9:26]
    assert D.preserving_token(token, b"k", back=True) == "+1 (555) 123-4567"
    with pytest.raises(ValueError):
        D.anonymize_texts(table, "doc", "body", {"ssn": "magic"})
    assert D.anonymize_texts(table.limit(0), "doc", "body").count() == 0


def test_preservation():
    assert D.preserved("One. Two. Three. Four.", "One.", 1.0) == (0.8, round(4 / 22, 4), False, True)
    assert D.preserved("call the meeting today", "x the meeting today", 0.9)[3] is False
    assert D.preserved("", "", 1.0) == (1.0, 1.0, True, True)


def test_unchanged_texts_are_not_compared_by_words():
    class Text(str):
        def lower(self):
            raise AssertionError("its words were compared")

    assert D.preserved(Text("Call me today. Or not."), "Call me today. Or not.", 0.9) == (0.99, 1.0, True, True)
    assert D.preserved(Text(" "), " ", 0.9) == (0.9, 1.0, True, True)


def test_long_texts_take_linear_time():
    patterns = D.Detector().patterns()
    for text in ("7 Aa" + " Bb" * 100_000, "a." * 200_000, "1" * 300_000, "+1 " * 100_000, "Ann Smith " * 30_000):
        D.spans_of(text, patterns)


class Counted:
    """A pattern that adds up the places it is tried at."""

    def __init__(self, p, seen):
        self.p, self.pattern, self.seen = p, p.pattern, seen

    def _on(self, how, text, pos=0, endpos=None):
        end = len(text) if endpos is None else min(endpos, len(text))
        self.seen[0] += 1 if how == "match" else end - pos
        return getattr(self.p, how)(text, pos, end)

    def __getattr__(self, how):
        return lambda *a: self._on(how, *a)


def test_patterns_are_tried_where_they_can_match():
    seen, plain = [0], "Little of this text holds a number: 12 apples, at most, in 2019. " * 500
    patterns = [(k, Counted(p, seen)) for k, p in D.Detector().patterns()]
    assert D.spans_of(plain + TEXTS[0] + plain, patterns) == [(len(plain) + a, len(plain) + b, k, c) for a, b, k, c in D.spans_of(TEXTS[0], D.Detector().patterns())]
    assert seen[0] < 2 * len(2 * plain)


def test_matches_are_those_of_every_pattern():
    patterns, rnd = D.Detector(custom={"badge": [r"\b[A-Z]{2}-\d{2}\b"], "address": [r"42 apples"]}).patterns(), random.Random(3)
    atoms = ["+", "(", ")", "1", "12", "555", "4567", "-", ".", "/", " ", "  ", "\n", "\u3000", "\u0660", "\u017f", "\u212a", "A", "b", "AB", "5B", "é", "Main", "Street", "st", ", ", "IL", "Ann", "Smith", "McDonald", "J.", "@", ".com", "x", "a" * 63, "c" * 24, "b." * 127, ":", "::", "0db8", "1:2:3:4:5:6:7:8", "P.O. Box ", "box ", "42 apples"]
    texts = [*filter(None, TEXTS.values()), *("".join(rnd.choice(some) for _ in range(rnd.choice((4, 12, 40)))) for some in (rnd.sample(atoms, rnd.choice((5, 12, len(atoms)))) for _ in range(1500)))]
    found = 0
    for text in texts:
        want = sorted((k, p.pattern, m.span()) for k, p in patterns for m in p.finditer(text))
        assert sorted((k, m.re.pattern, m.span()) for k, m in D.matches(text, patterns)) == want
        found += len(want)
    assert found > 1000


@pytest.mark.parametrize("job", [lambda t: I.pii_spans(t, "doc", "body"), lambda t: D.find_spans(t, "doc", "body"), lambda t: D.anonymize_texts(t, "doc", "body")])
def test_few_texts_of_a_batch_are_strings_at_a_time(table, monkeypatch, job):
    work = []
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, f, schema: work.append(f) or self)
    job(table)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["mail ann@example.com " + "x " * 5000] * 1000)], names=["id", "text"])
    tracemalloc.start()
    try:
        rows = sum(part.num_rows for part in work[0](iter([batch])))
        assert rows == 1000 and tracemalloc.get_traced_memory()[1] < 6_000_000
    finally:
        tracemalloc.stop()


def test_column_form(spark):
    df = spark.createDataFrame([(TEXTS[0],), (None,)], "t string")
    assert [r[0] for r in df.select(D.masked_kind(F.col("t"), "email_address")).collect()] == [TEXTS[0].replace("ann.smith@example.com", "[EMAIL]"), None]
