"""Personal data in texts: spans of eleven kinds and of users' own, a strategy for each kind, and how much of a text a rewrite preserves.

Spans are found once, all kinds in one pass of one Arrow function over whole texts, and a text is rewritten from its spans: what
stands between them is never looked at again, so that one replacement can't be taken for another kind.

Little of a text can hold a built-in kind. One scan for capitalised words, one for digits and the places of @ and : show where its
patterns are tried; patterns of users are tried everywhere.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.operators.ingest import luhn
from calltide.operators.tokens import preserving_token

#: The kinds and their patterns; letters in either case but for names. Parts that repeat have a bound, so that a
#: long text costs no more than its length.
KINDS: dict[str, list[str]] = {
    "person_name": [r"\b[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+\b", r"\b[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+\b", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"],
    "phone_number": [r"\+?1[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", r"\(?\b[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", r"\+[1-9][0-9]{1,14}\b"],
    "email_address": [r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,24}\b", r"\b[A-Za-z0-9._%+-]{1,64}\s{0,4}@\s{0,4}[A-Za-z0-9-]{1,63}\s{0,4}\.\s{0,4}[A-Za-z]{2,24}\b"],
    "ssn": [r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"\b[0-9]{3}\s[0-9]{2}\s[0-9]{4}\b", r"\b[0-9]{9}\b"],
    "credit_card": [r"\b(?:[0-9]{4}[ -]){3}[0-9]{4}\b", r"\b[0-9]{13,19}\b"],
    "address": [r"\b[0-9]{1,6}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl)\b(?:, [A-Z][a-z]+(?:, [A-Z]{2})?)?", r"\bP\.?O\.?\s{1,4}Box\s{1,4}[0-9]{1,9}\b", r"\b[0-9]{5}(?:-[0-9]{4})?\b"],
    "date_of_birth": [r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)[0-9]{2}\b", r"\b(?:19|20)[0-9]{2}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01])\b"],
    "driver_license": [r"\b[A-Z][0-9]{7,13}\b", r"\b[0-9]{8,12}\b"],
    "passport": [r"\b[A-Z]{1,2}[0-9]{6,9}\b", r"\b[0-9]{9}\b"],
    "bank_account": [r"\b[0-9]{8,17}\b"],
    "ip_address": [r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"],
}
#: Words near a span that make its kind surer, in two groups.
CONTEXT: dict[str, list[str]] = {
    "person_name": ["name|called|known as|aka", "mr|mrs|ms|dr|prof"], "phone_number": ["phone|tel|call|number|mobile|cell", "contact|reach|dial"], "email_address": ["email|e-mail|contact|send", "at"],
    "ssn": ["ssn|social|security|number", "social security"], "credit_card": ["card|credit|visa|mastercard|amex|discover", "payment|billing|charge"], "address": ["address|location|home|residence", "street|avenue|road|drive|lane"],
    "date_of_birth": ["born|birth|dob|birthday", "age|years old"], "driver_license": ["driver|license|dl|id", "state id|identification"], "passport": ["passport|travel|document", "international|border"],
    "bank_account": ["account|bank|routing|checking|savings", "deposit|withdrawal|transfer"], "ip_address": ["ip|address|server|network", "internet|connection|host"],
}
#: What each kind's spans become if no user says otherwise.
STRATEGIES = {"person_name": "tokenization", "address": "generalization", "date_of_birth": "generalization"}
LABELS = {"person_name": "NAME", "phone_number": "PHONE", "email_address": "EMAIL"}
COMMON = ("Call", "Text", "Message", "Phone", "Number", "Time", "Date")
WINDOW, THRESHOLD = 50, 0.7
#: Kinds of bare digits whose pattern says little: alone they're only taken with a word of their context near.
LOOSE = {"driver_license", "passport", "bank_account", "person_name"}

#: The first word of any name; digits with the marks that numbers have among them; a part of a long address, and all its characters.
NAME, NUMBER, PART, PARTS = re.compile(r"[A-Z][a-z]+(?= [A-Z])"), re.compile(r"[0-9](?:[0-9().+/\s-]*[0-9])?"), re.compile(r":[0-9a-fA-F]{1,4}(?=:)"), re.compile(r"[0-9a-fA-F:]*")
#: Where built-in patterns are tried; the others are numbers.
PLACES = {(k, p): k for k in ("person_name", "email_address") for p in KINDS[k]} | {("address", KINDS["address"][0]): "street", ("address", KINDS["address"][1]): "box", ("phone_number", KINDS["phone_number"][2]): "anywhere", ("ip_address", KINDS["ip_address"][1]): "long"}
PLACES = {(k, p): "number" for k, ps in KINDS.items() for p in ps} | PLACES


@dataclass(frozen=True)
class Detector:
    """``custom`` adds kinds, or patterns to kinds; ``kinds`` restricts to some; spans under ``threshold`` aren't reported."""

    custom: Mapping[str, list[str]] = field(default_factory=dict)
    kinds: tuple[str, ...] | None = None
    threshold: float = THRESHOLD

    def patterns(self) -> list[tuple[str, re.Pattern]]:
        every = {k: [*KINDS.get(k, []), *self.custom.get(k, [])] for k in [*KINDS, *(k for k in self.custom if k not in KINDS)]}
        return [(k, re.compile(p, 0 if k == "person_name" or k in self.custom and k not in KINDS else re.I)) for k, ps in every.items() if self.kinds is None or k in self.kinds for p in ps]


def confidence(kind: str, found: str, around: str) -> float:
    """.8, .1 more for each group of context words near, and what the form adds or takes: full phones and e-mails .1, cards .15 with a
    right check digit and half without, bare social security numbers .7 of it; kinds of bare digits and names begin at .6."""
    words = sum(bool(re.search(rf"\b(?:{g})\b", around, re.I)) for g in CONTEXT.get(kind, []))
    out = min(1.0, (0.6 if kind in LOOSE else 0.8) + 0.1 * words)
    if kind == "phone_number" and re.fullmatch(r"\+?1[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", found) or kind == "email_address" and re.search(r"@.+\..+", found):
        out = min(1.0, out + 0.1)
    if kind == "ssn" and not re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", found):
        out *= 0.7
    if kind == "credit_card":
        out = min(1.0, out + 0.15) if luhn(found) else out * 0.5
    if kind == "person_name" and any(w in found for w in COMMON):
        out *= 0.3
    return round(out, 4)


def _names(text: str, ps: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, re.Match]]:
    ends = [0] * len(ps)
    for word in NAME.finditer(text):
        for i, (kind, p) in enumerate(ps):
            if word.start() >= ends[i] and (m := p.match(text, word.start())):
                ends[i] = m.end()
                yield kind, m


def _emails(text: str, ps: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, re.Match]]:
    """One @ each, at most 68 characters before it and 280 behind; the next one shows whether a word ends there."""
    ends, at = [0] * len(ps), text.find("@")
    while at >= 0:
        for i, (kind, p) in enumerate(ps):
            if (m := p.search(text, max(ends[i], at - 68), at + 282)) and m.start() < at < m.end():
                ends[i] = m.end()
                yield kind, m
        at = text.find("@", at + 1)


def _long_addresses(text: str, ps: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, re.Match]]:
    end = 0
    for part in PART.finditer(text) if text.count(":") >= 7 else ():
        if part.start() >= end:
            begin, end = max(end, part.start() - 4), PARTS.match(text, part.start()).end()
            for kind, p in ps:
                yield from ((kind, m) for m in p.finditer(text, begin, end + 1))


def _numbers(text: str, ps: list[tuple[str, re.Pattern]], streets: list[tuple[str, re.Pattern]], boxes: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, re.Match]]:
    """Numbers lie among digits and marks, but for two characters before; a street begins with the last digits there, a box 15 before the first."""
    ends = [0] * len(streets + boxes)
    for zone in NUMBER.finditer(text):
        at, end = zone.span()
        if end - at > 4:  # the shortest has five
            for kind, p in ps:
                yield from ((kind, m) for m in p.finditer(text, max(0, at - 2), end + 1))
        first = at + len(zone[0].rstrip("0123456789"))
        for i, (kind, p) in enumerate(streets + boxes):
            if i < len(streets):
                m = p.match(text, first) if text[end : end + 1].isspace() and first >= ends[i] else None
            else:
                m = p.search(text, max(ends[i], at - 15), end + 1) if text[at - 1 : at].isspace() else None
            if m:
                ends[i] = m.end()
                yield kind, m


def matches(text: str, patterns: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, re.Match]]:
    """(kind, match) for all that ``finditer`` of each pattern finds, in no order."""
    at: dict[str, list[tuple[str, re.Pattern]]] = {k: [] for k in ("person_name", "email_address", "long", "number", "street", "box", "anywhere")}
    for kind, p in patterns:
        at[PLACES.get((kind, p.pattern), "anywhere")].append((kind, p))
    for kind, p in at["anywhere"]:
        yield from ((kind, m) for m in p.finditer(text))
    if at["person_name"]:
        yield from _names(text, at["person_name"])
    if at["email_address"]:
        yield from _emails(text, at["email_address"])
    if at["long"]:
        yield from _long_addresses(text, at["long"])
    if at["number"] or at["street"] or at["box"]:
        yield from _numbers(text, at["number"], at["street"], at["box"])


def spans_of(text: str, patterns: list[tuple[str, re.Pattern]], threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, confidence) by place, without overlaps: surer spans first, then longer, then leftmost, then as kinds are listed."""
    rank = {k: i for i, (k, _) in reversed(list(enumerate(patterns)))}
    hits: dict[tuple[int, int, str], float] = {}
    for kind, m in matches(text, patterns):
        c = confidence(kind, m[0], text[max(0, m.start() - WINDOW) : m.start()] + " " + text[m.end() : m.end() + WINDOW])
        if c >= threshold and m.end() > m.start():
            hits[m.start(), m.end(), kind] = c
    order = sorted(hits, key=lambda h: (-hits[h], h[0] - h[1], h[0], rank[h[2]]))
    taken, out = bytearray(len(text)), []
    for a, b, kind in order:
        if not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, kind, hits[a, b, kind]))
    return sorted(out)


def generalized(kind: str, found: str) -> str:
    if kind == "address":
        parts = [p.strip() for p in found.split(",")]
        return ", ".join(parts[-2:]) if len(parts) > 2 else parts[-1] if len(parts) == 2 else "[CITY, STATE]"
    if kind == "date_of_birth":
        return m[0] if (m := re.search(r"\b(?:19|20)\d{2}\b", found)) else "[YEAR]"
    return f"[{LABELS.get(kind, kind.upper())}]"


def replacement(kind: str, found: str, strategy: str, key: bytes) -> str:
    """suppression: the kind in brackets; tokenization: names by a keyed hash, others in their format; generalization: city or year;
    mask: as many marks as characters."""
    if strategy == "tokenization":
        return f"{LABELS.get(kind, kind.upper())}_{hmac.new(key, found.encode(), hashlib.sha256).hexdigest()[:8]}" if kind == "person_name" else preserving_token(found, key)
    if strategy == "mask":
        return "X" * len(found)
    return generalized(kind, found) if strategy == "generalization" else f"[{LABELS.get(kind, kind.upper())}]"


def rewrite(text: str, spans: list[tuple[int, int, str, float]], strategies: Mapping[str, str], key: bytes) -> str:
    out, last = [], 0
    for a, b, kind, _ in spans:
        out += [text[last:a], replacement(kind, text[a:b], strategies.get(kind, "suppression"), key)]
        last = b
    return "".join([*out, text[last:]])


def preserved(before: str, after: str, sure: float) -> tuple[float, float, bool, bool]:
    """(score, length ratio, structure, context): the score is 1, less .2 if the length changes by over a fifth, and .1 more if words change by
    under a tenth, times the mean confidence, at most 1; structure holds if sentences change by one at most; context if 70 % of telling words stay."""
    if before == after:
        return round(max(0.0, min(1.0, (1.1 if before.split(None, 1) else 1.0) * sure)), 4), 1.0, True, True
    ratio = len(after) / len(before) if before else 1.0
    words = len(after.split()) / max(len(before.split()), 1)
    score = max(0.0, min(1.0, (1.0 - 0.2 * (abs(ratio - 1) > 0.2) + 0.1 * (abs(words - 1) < 0.1)) * sure))
    sentences = lambda t: sum(bool(s.strip()) for s in re.split(r"[.!?]+", t))
    telling = [w for w in ("meeting", "appointment", "call", "text", "message", "today", "tomorrow", "yesterday") if w in before.lower()]
    kept = sum(w in after.lower() for w in telling)
    return round(score, 4), round(ratio, 4), abs(sentences(before) - sentences(after)) <= 1, not telling or kept / len(telling) >= 0.7


#: Texts of a batch that are Python strings at a time.
PART_ROWS = 256
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("confidence", pa.float64())])
SPANS = "array<struct<start:bigint,end:bigint,kind:string,confidence:double>>"


def _run(batches: Iterator[pa.RecordBatch], detector: Detector, work: Callable) -> Iterator[pa.RecordBatch]:
    patterns = detector.patterns()
    for batch in batches:
        for part in (batch.slice(i, PART_ROWS) for i in range(0, batch.num_rows, PART_ROWS)):
            texts = part.column("text").to_pylist()
            found = [spans_of(t, patterns, detector.threshold) if t else [] for t in texts]
            spans = pa.array([[{"start": a, "end": b, "kind": k, "confidence": c} for a, b, k, c in s] for s in found], pa.list_(SPAN))
            yield work(part, texts, found, spans)


def _spans(batch, texts, found, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("id"), spans], names=["id", "spans"])


def find_spans(texts: DataFrame, id_col: str, text_col: str, detector: Detector = Detector()) -> DataFrame:
    """``id_col`` and spans (start, end: code points; kind; confidence) of each text; null and empty texts have none."""
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return t.mapInArrow(partial(_run, detector=detector, work=_spans), f"id {t.dtypes[0][1]}, spans {SPANS}").withColumnRenamed("id", id_col)


def _anonymize(batch, texts, found, spans, strategies, key) -> pa.RecordBatch:
    out = [None if t is None else rewrite(t, s, strategies, key) for t, s in zip(texts, found, strict=True)]
    marks = [preserved(t or "", o or "", sum(c for *_, c in s) / len(s) if s else 1.0) for t, o, s in zip(texts, out, found, strict=True)]
    columns = [pa.array(out, pa.string()), spans, *(pa.array([m[k] for m in marks], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.bool_())))]
    return pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "anonymized", "spans", "quality", "length_ratio", "structure", "context"])


def anonymize_texts(texts: DataFrame, id_col: str, text_col: str, strategies: Mapping[str, str] | None = None, detector: Detector = Detector(), key: bytes = b"") -> DataFrame:
    """``id_col``, anonymized, spans (of the text before), quality, length_ratio, structure and context of each text.

    ``strategies`` maps kinds to suppression (the default), tokenization, generalization or mask, over ``STRATEGIES``; ``key`` is that of
    tokens: equal values have equal tokens under one key. A null text stays null; repeated rows are rewritten each.
    """
    own = STRATEGIES | dict(strategies or {})
    if unknown := {*own.values()} - {"suppression", "tokenization", "generalization", "mask"}:
        raise ValueError(f"no such strategy: {', '.join(sorted(unknown))}")
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {t.dtypes[0][1]}, anonymized string, spans {SPANS}, quality double, length_ratio double, structure boolean, context boolean"
    return t.mapInArrow(partial(_run, detector=detector, work=partial(_anonymize, strategies=own, key=key)), schema).withColumnRenamed("id", id_col)


def span_counts(found: DataFrame) -> DataFrame:
    """kind and how many spans of it, and in how many texts, stand in the result of :func:`find_spans` or :func:`anonymize_texts`."""
    kinds = F.transform("spans", lambda s: s["kind"])
    each = found.select(F.explode(F.transform(F.array_distinct(kinds), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n")))).alias("k"))
    return each.groupBy("k.kind").agg(F.sum("k.n").alias("spans"), F.count("*").alias("texts"))


def masked_kind(text: Column, kind: str) -> Column:
    """One kind's patterns replaced as a column expression, without looking at others or at confidence."""
    out = text
    for p in KINDS[kind]:
        out = F.regexp_replace(out, ("" if kind == "person_name" else "(?i)") + p, f"[{LABELS.get(kind, kind.upper())}]")
    return out
