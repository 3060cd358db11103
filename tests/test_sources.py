"""Detection, readers and sinks on files made here."""

import json

import pytest
from pyspark.sql import functions as F

from calltide.operators import ingest as I
from calltide.sources import detect, readers, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{path}"


def test_detection():
    assert detect.file_format("a.bin", b"%PDF-1.7") == "pdf"
    assert detect.file_format("x.CSV") == "csv"
    assert detect.file_format("noext", b' {"a": 1}') == "json"
    assert detect.carrier_of_name("2024_VZW_log.csv") == "verizon"
    assert detect.carrier_of_name("summary_batteries.csv") == "unknown"
    assert detect.encoding("é".encode("latin-1") * 20) == "ISO-8859-1"
    assert detect.delimiter(["a;b;c", '1;"x;y";3'])[0] == ";"
    assert detect.header_row([["Date", "Phone Number"], ["2023-01-01", "+15551234567"]]) == 0
    assert detect.header_row([["1", "2"], ["3", "4"]]) is None
    assert detect.fixed_width(["20230101 103000 5551234567  180"] * 3)
    assert detect.columns_of_blanks(["ab  cd", "ef  gh"]) == [(1, 2), (5, 2)]


def test_csv(spark, tmp_path):
    rows = "Date/Time,Phone Number,Duration,Direction,Call Type\n" + "".join(f"2023-01-0{i} 10:30:00,+1202555012{i},{i * 60},{'Inbound' if i % 2 else 'Outbound'},{'Voice' if i < 5 else 'SMS'}\n" for i in range(1, 8))
    got = readers.read_csv(spark, put(tmp_path, "a.csv", rows))
    n = I.validate(I.normalize_records(got)).orderBy("ts").collect()
    assert [r["duration"] for r in n] == [i * 60 for i in range(1, 8)]
    assert [r["direction"] for r in n][:2] == ["inbound", "outbound"] and n[6]["type"] == "sms"
    assert n[0]["number"] == "+12025550121" and n[0]["quality"] == 1.0
    assert [list(r["errors"]) for r in n] == [[]] * 4 + [["duration:unexpected"]] * 3


def test_csv_with_too_many_errors(spark, tmp_path):
    path = put(tmp_path, "bad.csv", "date,number\n" + "2023-01-01,+12025550121\n" * 3 + "x,y,z,w\n" * 3)
    assert readers.read_csv(spark, path).count() == 6
    with pytest.raises(readers.TooManyErrors):
        readers.read_csv(spark, path, check=True)


@pytest.mark.parametrize("line", ["CDR|20230101|103000|+12025551234|O|180|C", "VZW|2023-01-01|10:30:00|2025551234|O|180", "TMO:2023-01-01:10:30:00:2025551234:O:180", "SPR|20230101|103000|+12025551234|O|180|C"])
def test_carriers(spark, tmp_path, line):
    got = readers.read_cdr(spark, put(tmp_path, "a.cdr", (line + "\n") * 5))
    r = I.normalize_records(got).first()
    assert (r["number"], r["duration"], r["direction"], r["type"]) == ("+12025551234", 180, "outbound", "call")
    assert r["ts"].strftime("%Y-%m-%d %H:%M:%S") == "2023-01-01 10:30:00"


@pytest.mark.parametrize("text", ["2025551234;2023-01-01 10:30:00;180;call;in\n" * 4, "2025551234  2023-01-01 10:30:00  180  call  in\n" * 4, "on 2023-01-01 10:30:00 an inbound call from 202-555-1234 took 180 seconds\nanother inbound call, 2023-01-01 10:30:00: 2025551234 (180 s), it was\n"])
def test_other_cdr(spark, tmp_path, text):
    rows = I.normalize_records(readers.read_cdr(spark, put(tmp_path, "a.txt", text))).collect()
    assert {(r["number"], r["duration"], r["direction"]) for r in rows} == {("+12025551234", 180, "inbound")}


def test_json_and_xml(spark, tmp_path):
    j = put(tmp_path, "a.json", json.dumps([{"phone": "2025551234", "timestamp": "2023-01-01 10:30:00", "duration": 5}]))
    assert I.normalize_records(readers.read_any(spark, j)).first()["duration"] == 5
    x = put(tmp_path, "b.xml", '<smses><sms address="+12025551234" date="1672569000000" type="1" body="hi &amp; bye"/><sms address="+12025551235" date="1672569000000" type="2" body="x"/></smses>')
    got = {r["number"]: r for r in I.normalize_records(readers.read_any(spark, x)).collect()}
    assert got["+12025551234"]["content"] == "hi & bye" and got["+12025551234"]["direction"] == "inbound" and got["+12025551235"]["direction"] == "outbound"
    assert readers.union_files(spark, [j, x]).count() == 3


def test_optional_formats_say_what_they_need(spark, tmp_path):
    import importlib.util

    for name, module, f in (("a.xlsx", "openpyxl", readers.read_excel), ("a.pdf", "pdfplumber", readers.read_pdf)):
        if importlib.util.find_spec(module) is None:
            with pytest.raises(ImportError):
                f(spark, put(tmp_path, name, b"x"))


def test_mapping():
    m = I.map_fields(["Call Date", "Phone Number", "Dur", "Direction", "Other"])
    assert {k: v[0] for k, v in m.items()} == {"ts": "Call Date", "number": "Phone Number", "duration": "Dur", "direction": "Direction"}
    assert 0.8 < I.mapping_confidence(m) <= 1.0 and I.mapping_confidence({}) == 0.0


def test_column_types(spark):
    df = spark.createDataFrame([("2025551234", "2023-01-01", "5", "true", "x1"), ("202-555-1234", "2023-01-02", "7", "no", "y")], "a string, b string, c string, d string, e string")
    assert {r["column"]: r["type"] for r in I.column_types(df).collect()} == {"a": "phone", "b": "date", "c": "integer", "d": "boolean", "e": "string"}


def test_contacts_are_cleaned(spark):
    df = spark.createDataFrame([(" x" * 200, ["A", "a", "bad tag", "ok_1"], -5, 3)], "name string, tags array<string>, total_calls bigint, total_sms bigint")
    r = I.validate_contacts(df).first()
    assert len(r["name"]) == 255 and r["tags"] == ["a", "ok_1"] and (r["total_calls"], r["total_sms"]) == (0, 3)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, f"+1202555{i:04d}", "call" if i % 2 else "sms", "inbound", i, 'said "a,b"\nthen', "device", 1, i % 3 if i % 3 else None, "private" if i % 5 == 0 else "team") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, number string, type string, direction string, duration int, content string, source string, owner_id bigint, contact_id bigint, visibility string")
    return df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_exports(spark, log, tmp_path):
    sinks.export_csv(log, f"file://{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/csv")
    assert back.columns == sinks.COLUMNS and back.count() == 20
    assert back.where("number = 'Private'").count() == 4 and back.where("id = '1'").first()["content"] == 'said "a,b"\nthen'
    sinks.export_json(log, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 20
    sinks.export_by_contact(log, f"file://{tmp_path}/by", files=3)
    by = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/by")
    assert {str(r["contact"]) for r in by.select("contact").distinct().collect()} == {"1", "2", "unknown"}
    assert {r["name"]: r["value"] for r in sinks.export_summary(log).collect()} == {"events": 20, "calls": 10, "sms": 10, "contacts": 2, "call_seconds": 190}
    assert sinks.export_size(log).first()["events"] == 20
    assert [r["events"] for r in sinks.contact_counts(log).collect()] == [7, 6]


def test_pii(spark):
    text = "mail a.b@c.org or call 202-555-0199; card 4111 1111 1111 1111, not 4111 1111 1111 1112; ip 10.0.0.1"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id bigint, text string")
    spans = [(r["kind"], text[r["start"] : r["end"]]) for r in I.pii_spans(df, "id", "text").collect()]
    assert spans == [("email", "a.b@c.org"), ("phone", "202-555-0199"), ("credit_card", "4111 1111 1111 1111"), ("ip_address", "10.0.0.1")]
    assert df.select(I.redact_pii(F.col("text")).alias("t")).first()["t"].startswith("mail [EMAIL] or call [PHONE]; card [CREDIT_CARD]")
    counts = {r["id"]: r for r in I.pii_counts(df, "id", "text").collect()}
    assert counts[1]["email"] == 1 and counts[2]["email"] == counts[3]["phone"] == 0
    assert I.luhn("4111111111111111") and not I.luhn("4111111111111112")


def test_files_of_many_charsets_and_limits(spark, tmp_path):
    rows = "number,date,message\n+15550000001,2024-01-01 10:00:00,café à {}\n+15550000002,2024-01-02 10:00:00,plain\n"
    for name, charset in (("utf8", "utf-8"), ("latin", "iso-8859-1"), ("win", "windows-1252"), ("wide", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes(rows.format("€" if name in ("win", "utf8", "wide") else "é").encode(charset))
    (tmp_path / "other.csv").write_text("Caller;Date/Time;Duration\n+15550000003;2024-01-03 10:00:00;7\n")
    (tmp_path / "long.csv").write_text("number,date\n" + "+15550000009,2024-01-09 10:00:00\n" * 50)
    (tmp_path / "empty.csv").write_text("")
    got, report = readers.read_csv_files(spark, str(tmp_path), max_rows=40)
    name = lambda f: f.rsplit("/", 1)[-1].removesuffix(".csv")
    told = {name(r["file"]): (r["charset"], r["accepted"], r["reason"]) for r in report.collect()}
    assert {k: v[0] for k, v in told.items()} == {"utf8": "UTF-8", "latin": "ISO-8859-1", "win": "windows-1252", "wide": "UTF-16", "other": "UTF-8", "long": "UTF-8"}
    assert told["long"][1:] == (False, "too many rows") and all(v[1] for k, v in told.items() if k != "long")
    by = {}
    for r in got.collect():
        by.setdefault(name(r["file"]), []).append((r["number"], r["content"], r["duration"]))
    assert set(by) == {"utf8", "latin", "win", "wide", "other"} and by["other"] == [("+15550000003", None, "7")]
    for k in ("utf8", "latin", "win", "wide"):
        assert sorted(by[k]) == [("+15550000001", "café à " + ("é" if k == "latin" else "€"), None), ("+15550000002", "plain", None)], k
    assert readers.file_report(spark, str(tmp_path / "long.csv"), max_bytes=100).collect()[0]["reason"] == "too large"
    one = readers.read_csv(spark, str(tmp_path / "latin.csv")).collect()
    assert {r["content"] for r in one} == {"café à é", "plain"}


@pytest.mark.parametrize(("carrier", "line", "want"), [
    ("att", "01/31/2023,10:30:00,+12025551234,Outgoing,180", ("+12025551234", "01/31/2023 10:30:00", "180", "call", "outbound")), ("verizon", "20230131103000+12025551234   I000180V", ("+12025551234", "20230131 103000", "000180", "call", "inbound")),
    ("tmobile", "01/31/2023  10:30:00  2025551234  I  180", ("2025551234", "01/31/2023 10:30:00", "180", "call", "inbound")), ("sprint", "202301311030002025551234O00180C", ("2025551234", "20230131 103000", "00180", "call", "outbound")),
])
def test_second_forms_of_carriers(spark, tmp_path, carrier, line, want):
    """Files may hold both forms; lines of neither are left out."""
    first = {"att": "CDR|20230101|103000|+12025551234|O|180|S", "verizon": "VZW|2023-01-01|10:30:00|2025551234|O|180", "tmobile": "TMO:2023-01-01:10:30:00:2025551234:O:180", "sprint": "SPR|20230101|103000|+12025551234|O|180|S"}[carrier]
    (tmp_path / "f.cdr").write_text("\n".join([line] * 3 + [first, "end of file"]))
    assert readers.carrier_of_lines([line] * 3) == carrier
    got = readers.read_cdr(spark, str(tmp_path / "f.cdr")).collect()
    assert [tuple(r)[:5] for r in got[:3]] == [want] * 3 and len(got) == 4
    assert got[3]["type"] == ("sms" if carrier in ("att", "sprint") else "call")
