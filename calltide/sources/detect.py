"""What a file is: format, carrier, delimiter, header row. Works on a name and a small sample, on the driver."""

from __future__ import annotations

import re

MAX_BYTES, MAX_ROWS = 100 << 20, 1_000_000
#: First bytes of formats, extensions, delimiters and their priorities, carriers' names in file names.
MAGIC = [(b"%PDF", "pdf"), (b"PK\x03\x04", "xlsx"), (b"\xd0\xcf\x11\xe0", "xls")]
EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "cdr", "cdr": "cdr", "log": "cdr", "json": "json", "jsonl": "json", "xml": "xml", "pdf": "pdf", "xlsx": "xlsx", "xls": "xls"}
DELIMITERS = {",": 1.0, "\t": 0.9, ";": 0.8, "|": 0.7, ":": 0.3}
CARRIERS = {"att": ["att", "at&t"], "verizon": ["verizon", "vzw"], "tmobile": ["tmobile", "t-mobile", "tmo"], "sprint": ["sprint", "spr"]}


def file_format(name: str, head: bytes = b"") -> str:
    """By the first bytes, else the extension, else what the text looks like."""
    for magic, form in MAGIC:
        if head.startswith(magic):
            return form
    ext = name.rpartition(".")[2].lower()
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    text = head.lstrip()[:1]
    return "json" if text in (b"{", b"[") else "xml" if text == b"<" else "csv" if b"," in head else "cdr"


def carrier_of_name(name: str) -> str:
    low = name.lower()
    return next((c for c, words in CARRIERS.items() if any(re.search(rf"(^|[^a-z]){re.escape(w)}([^a-z]|$)", low) for w in words)), "unknown")


def encoding(head: bytes) -> str:
    if head.startswith(b"\xff\xfe") or head.startswith(b"\xfe\xff"):
        return "UTF-16"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start > len(head) - 4 else "ISO-8859-1"
    return "UTF-8"


def fields(line: str, delimiter: str) -> list[str]:
    """Fields of a line; delimiters in double quotes don't cut."""
    out, now, quoted = [], "", False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def delimiter(lines: list[str]) -> tuple[str, float]:
    """The delimiter with the best score: .5 hits (up to 10 a line), .4 consistency, .1 priority; (",", 0) without any."""
    best = (",", 0.0)
    for d, priority in DELIMITERS.items():
        counts = [len(fields(line, d)) - 1 for line in lines if line.strip()]
        if not counts or not sum(counts):
            continue
        mean = sum(counts) / len(counts)
        spread = sum((c - mean) ** 2 for c in counts) / len(counts)
        score = 0.5 * min(mean / 10, 1) + 0.4 / (1 + spread) + 0.1 * priority
        if score > best[1]:
            best = (d, round(score, 4))
    return best


def header_row(rows: list[list[str]]) -> int | None:
    """The row, among the first five, that reads as names over data: letters without digits here, digits in the row below."""
    best, score = None, 0.5
    for i, row in enumerate(rows[:5]):
        if i + 1 >= len(rows) or len(row) < 2 or len(set(row)) < len(row):
            continue
        named = sum(bool(re.match(r"^[A-Za-z][A-Za-z /_-]*$", c.strip())) for c in row) / len(row)
        data = sum(any(ch.isdigit() for ch in c) for c in rows[i + 1]) / len(rows[i + 1])
        if named * 0.7 + data * 0.3 > score and named > 0.5:
            best, score = i, named * 0.7 + data * 0.3
    return best


def fixed_width(lines: list[str]) -> bool:
    """Lines of nearly one length over 20 characters, without delimiters."""
    lengths = [len(line) for line in lines if line.strip()]
    if not lengths:
        return False
    mean = sum(lengths) / len(lengths)
    return mean > 20 and sum((n - mean) ** 2 for n in lengths) / len(lengths) < 10 and not any(d in line for line in lines for d in "|,\t;")


def columns_of_blanks(lines: list[str]) -> list[tuple[int, int]]:
    """Start and length (from 1) of the columns that places blank in every line separate."""
    width = max(map(len, lines), default=0)
    blank = [all(i >= len(line) or line[i] == " " for line in lines) for i in range(width)] + [True]
    out, start = [], None
    for i, b in enumerate(blank):
        if not b and start is None:
            start = i
        elif b and start is not None:
            out.append((start + 1, i - start))
            start = None
    return out
