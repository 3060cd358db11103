"""Normalisers of phones, times and durations, as column expressions. A value that can't be read gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of dates that logs use, in the order in which they are tried.
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy hh:mm a", "MM/dd/yyyy", "MM-dd-yyyy HH:mm:ss", "MM-dd-yyyy", "yyyyMMdd HHmmss", "yyyyMMddHHmmss", "yyyyMMdd"]
#: Hours from UTC of zone abbreviations.
ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
#: Area codes that the numbering plan doesn't give out.
INVALID_AREA = ["000", "111", "911"]
#: Words for the canonical types and directions.
TYPE_WORDS = {"call": ["call", "voice", "phone", "audio", "video"], "sms": ["sms", "text", "message", "mms", "txt", "msg", "im"]}
DIRECTION_WORDS = {"inbound": ["inbound", "incoming", "in", "received", "recv", "i"], "outbound": ["outbound", "outgoing", "out", "sent", "dialed", "o"]}
UNIX_LOW, UNIX_MS = 0, 10_000_000_000


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_clean(phone: Column) -> Column:
    return F.regexp_replace(phone, "[^0-9+]", "")


def e164(phone: Column) -> Column:
    """E.164: keeps a leading +, reads 011 as +, takes 10 digits (or 11 after a 1) as of country 1; 7 to 15 digits, no invalid area."""
    return e164_of(phone_clean(phone))


def e164_of(clean: Column) -> Column:
    d = F.replace(clean, F.lit("+"), F.lit(""))
    n = F.char_length(d)
    plus = (
        F.when(clean.startswith("+"), F.concat(F.lit("+"), d))
        .when(clean.startswith("011") & (n > 10), F.concat(F.lit("+"), F.substring(d, 4, 20)))
        .when(n == 10, F.concat(F.lit("+1"), d))
        .when((n == 11) & d.startswith("1"), F.concat(F.lit("+"), d))
        .when((n >= 7) & (n <= 15), F.concat(F.lit("+"), d))
    )
    # The pattern is of 7 to 15 digits after the +, and of no invalid area where these are 1 and ten more.
    return F.when(plus.rlike(r"^\+(?!1(" + "|".join(INVALID_AREA) + r")\d{7}$)\d{7,15}$"), plus)


def format_phone(phone: Column) -> Column:
    """(xxx) xxx-xxxx for numbers of country 1, others as they are."""
    d = F.regexp_extract(phone, r"^\+1(\d{10})$", 1)
    return F.when(d == "", phone).otherwise(F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4)))


def shapes(form: str) -> list[str]:
    """What texts of a format look like with every digit as 0 and letters in capitals."""
    out = [reduce(lambda s, letter: s.replace(letter, "0"), "yMdHhms", form.replace("'T'", "T"))]
    for part, texts in (("SSS", ["0", "00", "000"]), ("XXX", ["Z", "+00:00", "-00:00"]), (" a", [" AM", " PM"])):
        out = [s.replace(part, t) for s in out for t in texts] if part in form else out
    return out


def time_zone(c: Column) -> Column:
    """The known zone abbreviation at the end, in capitals, or null."""
    zone = F.upper(F.right(F.trim(c), F.lit(3)))
    return F.when(zone.isin(*ZONES) & F.trim(c).rlike(r"\s[A-Za-z]{3}$"), zone)


def time_bare(c: Column, zone: Column) -> Column:
    return F.when(zone.isNull(), F.trim(c)).otherwise(F.substring(F.trim(c), F.lit(1), F.char_length(F.trim(c)) - 4))


def time_shape(bare: Column) -> Column:
    return F.upper(F.translate(bare, "123456789", "000000000"))


def time_iso(bare: Column, shape: Column) -> Column:
    """Text of a known shape as ISO 8601 (with a half of the day if it has one), else null."""
    t, cut = F.upper(bare), lambda i, n: F.substring(bare, i, n)
    clock = F.replace(F.substring(bare, 9, 7), F.lit(" "), F.lit(""))
    compact = F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2))
    return (
        F.when(~shape.isin(sorted({s for f in TIME_FORMATS for s in shapes(f)})), None)
        .when(shape.startswith("0000-"), t)
        .when(~shape.startswith("0000"), F.concat(F.concat_ws("-", cut(7, 4), cut(1, 2), cut(4, 2)), F.substring(t, 11, 20)))
        .when(clock == "", compact)
        .otherwise(F.concat(compact, F.lit(" "), F.concat_ws(":", F.substring(clock, 1, 2), F.substring(clock, 3, 2), F.substring(clock, 5, 2))))
    )


def time_of(iso: Column, zone: Column, bare: Column, shape: Column) -> Column:
    """The shape tells the only format a text can have, so that nothing is tried in vain: a failed parse costs an exception."""
    halves = F.when(F.char_length(iso) == 19, F.concat(F.left(iso, F.lit(16)), F.lit(":00"), F.right(iso, F.lit(3)))).otherwise(iso)
    parsed = F.when(iso.endswith("M"), F.try_to_timestamp(halves, F.lit("yyyy-MM-dd hh:mm:ss a"))).otherwise(iso.try_cast("timestamp"))
    hours = reduce(lambda rest, z: F.when(zone == z, F.lit(ZONES[z])).otherwise(rest), ZONES, F.lit(0))
    number = F.when(zone.isNull() & shape.isin(["0" * n for n in range(9, 14)]), bare.cast("bigint"))
    unix = F.when(number < UNIX_MS, F.timestamp_seconds(number)).otherwise(F.timestamp_millis(number))
    return F.when(number.isNotNull(), unix).when(zone.isNotNull(), F.timestamp_seconds(F.unix_timestamp(parsed) - hours * 3600)).otherwise(parsed)


def event_time(c: Column) -> Column:
    """A timestamp from text in any known format, with a zone abbreviation or offset, or from Unix seconds or milliseconds."""
    zone = time_zone(c)
    bare = time_bare(c, zone)
    shape = time_shape(bare)
    return time_of(time_iso(bare, shape), zone, bare, shape)


def duration_parts(c: Column) -> Column:
    """Texts of hours, minutes and whole seconds, of ``H:M:S``, ``M:S``, ``1h 2m 3s``, unit words or a plain number; else null."""
    text = F.lower(F.trim(c))
    units = r"^(?:(\d+)\s*h(?:ours?|rs?)?)?\s*(?:(\d+)\s*m(?:in(?:ute)?s?)?)?\s*(?:(\d+)\s*s(?:ec(?:ond)?s?)?)?$"
    hms = (
        F.when(text.rlike(r"^\d{1,4}:\d{1,2}:\d{1,2}$"), text).when(text.rlike(r"^\d{1,4}:\d{1,2}$"), F.concat(F.lit(":"), text))
        .when(text.rlike(r"^\d+(\.\d+)?$"), F.concat(F.lit("::"), F.split_part(text, F.lit("."), F.lit(1)))).when((text != "") & text.rlike(units), F.regexp_replace(text, units, "$1:$2:$3"))
    )
    return F.split(hms, ":")


def duration_of(parts: Column) -> Column:
    """Seconds; outside a day, or beyond any number: null."""
    whole = lambda i: F.when(parts[i] == "", F.lit(0).cast("bigint")).otherwise(parts[i].try_cast("int").cast("bigint"))
    out = whole(0) * 3600 + whole(1) * 60 + whole(2)
    return F.when((out >= 0) & (out <= 86_400), out.cast("int"))


def duration_seconds(c: Column) -> Column:
    return duration_of(duration_parts(c))


def format_duration(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    h, m, s = F.floor(seconds / 3600).cast("string"), F.floor(seconds / 60) % 60, F.lpad((seconds % 60).cast("string"), 2, "0")
    return F.when(seconds >= 3600, F.concat(h, F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), s)).otherwise(F.concat(m.cast("string"), F.lit(":"), s))


def word_class(c: Column, words: dict[str, list[str]]) -> Column:
    low = F.lower(F.trim(c))
    return reduce(lambda rest, k: F.when(low.isin(words[k]), k).otherwise(rest), words, F.lit(None).cast("string"))


def event_type(c: Column) -> Column:
    return word_class(c, TYPE_WORDS)


def direction(c: Column) -> Column:
    return word_class(c, DIRECTION_WORDS)


def boolean(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "yes", "1", "y", "on"), True).when(low.isin("false", "no", "0", "n", "off"), False)
