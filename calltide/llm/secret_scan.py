"""Secret scans: known forms, and a battery of randomness tests for tokens of other forms.

A token's encoding is inferred from its characters (digits, hex, letters, base32, letters and digits, base64); one that mixes the
marks of both kinds of base64 is tested in its parts of either kind, and '=' parts a name from its value. Each distinct token is
judged once, whatever its copies. Numbers with the right check digit of a card are personal data, not secrets, and are left out.

* Battery. Under the hypothesis that a token's characters are independent and uniform over its alphabet, three tests give
  p-values: chi-squared uniformity, runs about the median, and serial correlation at lag one; Fisher's method combines them.
  Benjamini-Hochberg at ``q``, apart for each class of encoding and length, rejects tokens that aren't random (repeats, counters,
  patterns), so that at most a share q of the rejected are truly random ones.
* Statistic of what is reported. Here the hypothesis is that a token is ordinary. The battery's combined p is uniform for random
  tokens; how it is distributed for ordinary ones is counted in each class, over the corpus's tokens that its own short words
  explain as well as chance does. The ratio of the two densities at a token's p is the battery's evidence; as covariate it is
  multiplied by the likelihood of the token as uniform over its alphabet against that as ordinary text, in which the
  characters of the corpus's short words follow one another.
* Length-aware control. Of a class's tokens those are reported whose evidence passes the e-value form of Benjamini-Hochberg (the k
  largest are m / (q k) or more) and that the battery hasn't rejected. So at most a share ``q`` of the reported are expected to be
  ordinary *if* ordinary tokens are as both models say: the bound is no better than these, and identifiers made of rare words
  may exceed it.

Both cuts need all tokens of the corpus, as histograms of fixed size; the model of ordinary text is a table of counts of fixed size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import Stored

KINDS = ["assign", "access", "hex", "random"]
#: The three base forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # the runs of [0-9a-f] that are long enough
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{12,}(?:=+(?![A-Za-z0-9+/_=-]))?")  # with its padding; an '=' before more is a separator
JOINED = re.compile(r"[A-Z]?[a-z]{3,10}|[A-Z]{4,11}")  # the words that a token may be put together of
PARTS = [re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*")]
ENCODINGS = [("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"), ("digits", "0123456789"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")]
#: What each encoding weighs among secrets, as minus log2: letters and digits a fourth, hex and base64 an eighth, others a sixteenth; letters of
#: one case, which nearly all are words, a thousandth.
ODDS = [3, 4, 4, 2, 3, 3, 4, 10, 10, 4]
NARROWEST = sorted(range(len(ENCODINGS)), key=lambda i: len(ENCODINGS[i][1]))  # the order in which they are inferred
LENGTHS = [12, 14, 16, 20, 28, 40, 64, 128]  # lower ends of the length classes
Q = 0.05
#: Histogram bins to a factor of two, of p-values and of e-values, and the largest bin.
STEPS, LAST = 8, 8191
#: Bins of -log2 p for the densities of ordinary tokens' p-values, and how many uniform ones are counted beside these.
DENSITY, PRIOR = 24, 20.0
#: Symbols of tokens, letters of either case alike; the last is what stands before a word. How much chance unseen pairs share, and new words.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/_-"
OTHER, SMOOTH, JOIN = len(SYMBOLS), 0.02, 0.1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base forms, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> tuple[int, float] | None:
    """The class of encoding and length, and the combined p-value of the three tests; None for a token of no known alphabet."""
    token = token.rstrip("=")
    n = len(token)
    code = next((i for i in NARROWEST if not set(token) - set(ENCODINGS[i][1])), None)
    if code is None or n < LENGTHS[0]:
        return None
    alphabet = ENCODINGS[code][1]
    a, x = len(alphabet), [alphabet.index(c) for c in token]
    counts = [x.count(i) for i in set(x)]
    chi = (sum(c * c for c in counts) * a / n - n - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
    p = [0.5 * math.erfc(chi / math.sqrt(2))]  # uneven counts alone speak against randomness
    high = [v >= a / 2 for v in x]
    n1 = sum(high)
    n2 = n - n1
    if n1 and n2:
        runs, mean = 1 + sum(u != v for u, v in zip(high, high[1:], strict=False)), 1 + 2 * n1 * n2 / n
        p.append(two_sided((runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-12))))
    else:
        p.append(2.0 ** (1 - n))
    mid = sum(x) / n
    var = sum((v - mid) ** 2 for v in x)
    r = sum((u - mid) * (v - mid) for u, v in zip(x, x[1:], strict=False)) / var if var else 1.0
    p.append(two_sided((r + 1 / n) * math.sqrt(n)))
    half = -sum(math.log(max(v, 1e-300)) for v in p)  # half of Fisher's statistic, chi-squared with 6 degrees of freedom
    length = sum(n >= low for low in LENGTHS)
    return code * 10 + length, math.exp(-half) * (1 + half + half * half / 2)


def outside(start: int, end: int, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What spans (by start) leave of a stretch."""
    for a, _, b in taken:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def tokens(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What of each token lies outside base spans; its parts, where no alphabet has all of it. Both lists are walked once."""
    low = 0  # spans before it end before the token
    furthest = []  # the largest end up to each span
    for _, _, b in taken:
        furthest.append(max(b, furthest[-1] if furthest else 0))
    for m in TOKEN.finditer(text):
        while low < len(taken) and furthest[low] <= m.start():
            low += 1
        high = low
        while high < len(taken) and taken[high][0] < m.end():
            high += 1
        for start, end in outside(*m.span(), taken[low:high]):
            piece = text[start:end]
            mixed = ("/" in piece or "+" in piece) and ("-" in piece or "_" in piece)
            parts = {(start + x.start(), start + x.end()) for p in PARTS for x in p.finditer(piece)} if mixed else [(start, end)]
            yield from sorted(parts)


@dataclass
class Ordinary:
    """Ordinary text's characters: chances of a symbol after another, and of a letter's case after another's (lower, upper, none before).

    A token is one word or an identifier, with even chances; in an identifier a new word may begin at each character, with chance
    ``JOIN``, in either case.
    """

    symbol: list[list[float]]
    case: list[list[float]]

    def bits(self, token: str) -> float:
        """Minus log2 of a token's likelihood."""
        before, how, word, put, first = OTHER, 2, 0.0, 0.0, self.symbol[OTHER]
        for c in token:
            at = _PLACE[ord(c)]
            going, new = self.symbol[before][at], first[at]
            if at < 26:
                upper = int(c < "a")
                going, new, how = going * self.case[how][upper], 0.5 * new, upper
            else:
                how = 2
            word -= math.log2(going)
            put -= math.log2((1 - JOIN) * going + JOIN * new)
            before = at
        low = min(word, put)
        return low + 1 - math.log2(1 + 2.0 ** (low - max(word, put)))


#: Each byte's symbol.
_AT = np.full(256, OTHER, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _AT[ord(_c)] = _AT[ord(_c.upper())] = _i
_PLACE = _AT.tolist()
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def word_counts(data: bytes, longest: int = LENGTHS[0] - 1) -> tuple[np.ndarray, np.ndarray]:
    """How often symbols, and cases of letters, follow one another in the words of up to ``longest`` symbols: shorter than tokens to be judged."""
    raw = np.frombuffer(data, np.uint8)
    sym, n = _AT[raw], OTHER + 1
    inside = sym < OTHER
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts > longest
    if long.any():
        drop = np.zeros(len(raw) + 1, np.int64)
        drop[starts[long]], drop[ends[long]] = 1, -1  # runs don't touch
        inside &= np.cumsum(drop[:-1]) == 0
    at = np.flatnonzero(inside)
    before = np.concatenate([[OTHER], sym[:-1]])[at]
    letter = at[sym[at] < 26]
    case = np.where(sym < 26, _UPPER[raw], 2)
    case_before = np.concatenate([[2], case[:-1]])[letter]
    return np.bincount(before * n + sym[at], minlength=n * n), np.bincount(case_before * 2 + _UPPER[raw][letter], minlength=6)


def _cells(symbol: np.ndarray, case: np.ndarray) -> pa.RecordBatch:
    cells = np.concatenate([symbol, case])
    at = np.flatnonzero(cells)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], names=["cell", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol, case = np.zeros((OTHER + 1) ** 2, np.int64), np.zeros(6, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            data = text.encode()
            for i in range(0, len(data), 1 << 22):  # of very long texts a block at a time
                s, c = word_counts(data[i : i + (1 << 22)])
                symbol += s
                case += c
    yield _cells(symbol, case)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that each distinct token of a task is put together of, and in how many of its tokens they stand."""
    counts: Counter = Counter()
    for batch in batches:
        tokens = {m for text in batch.column("text").to_pylist() for m in TOKEN.findall(text)}
        for token in tokens:
            counts.update(set(JOINED.findall(token)))
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def _joined_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol, case = np.zeros((OTHER + 1) ** 2, np.int64), np.zeros(6, np.int64)
    for batch in batches:
        by: dict[int, list[str]] = {}
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            by.setdefault(n, []).append(word)
        for n, words in by.items():
            s, c = word_counts(" ".join(words).encode())
            symbol += n * s
            case += n * c
    yield _cells(symbol, case)


def ordinary(docs: DataFrame, text_col: str = "text") -> Ordinary:
    """The model of all texts of ``docs``: of their short words, and of the words that stand in several long tokens, as identifiers have them
    and random tokens don't. What comes to the driver has a fixed size."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    again = rows.mapInArrow(_joined, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    every = rows.mapInArrow(_counts, "cell int, n bigint").unionByName(again.mapInArrow(_joined_counts, "cell int, n bigint"))
    cells = np.zeros((OTHER + 1) ** 2 + 6)
    for r in every.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    symbol, case = cells[:-6].reshape(OTHER + 1, OTHER + 1)[:, :OTHER], cells[-6:].reshape(3, 2)

    def smooth(counts: np.ndarray) -> np.ndarray:
        whole = counts.sum(axis=1, keepdims=True)
        k = counts.shape[1]
        return (1 - SMOOTH) * (counts + 1) / (whole + k) + SMOOTH / k

    return Ordinary(smooth(symbol).tolist(), smooth(case).tolist())


def evidence(token: str, code: int, model: Ordinary) -> float:
    """log2 of the e-value; the encodings share the alternative's weight (``ODDS``), as a token's is inferred."""
    token = token.rstrip("=")
    return model.bits(token) - len(token) * math.log2(len(ENCODINGS[code][1])) - ODDS[code]


def card_number(token: str) -> bool:
    """13 to 19 digits whose last is the right check digit."""
    if not (13 <= len(token) <= 19 and token.isdigit()):
        return False
    digits = [int(c) for c in reversed(token)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def candidates(text: str, taken: list[tuple[int, int, int]], model: Ordinary | None = None) -> list[tuple[int, int, int, float, float]]:
    """(start, end, class, p, log2 of the likelihood ratio: 0 without a model) of each token that has an encoding and is no card number."""
    out = []
    for i, j in tokens(text, taken):
        if not card_number(text[i:j]) and (got := battery(text[i:j])):
            out.append((i, j, *got, evidence(text[i:j], got[0] // 10, model) if model else 0.0))
    return out


def density_bin(p: float) -> int:
    return min(DENSITY - 1, int(-math.log2(max(p, 1e-300))))


def battery_evidence(histogram: list[tuple[int, int, int]]) -> dict[int, list[float]]:
    """For each class, log2 of the density of random tokens' p-values over that of ordinary ones, by :func:`density_bin`.

    ``histogram``: class, bin, count of ordinary tokens. ``PRIOR`` uniform ones are counted beside them, so that few say little.
    """
    by: dict[int, dict[int, int]] = {}
    for cls, b, n in histogram:
        by.setdefault(cls, {})[b] = n
    width = [2.0**-b - (2.0 ** -(b + 1) if b < DENSITY - 1 else 0) for b in range(DENSITY)]
    return {cls: [math.log2(w * (sum(bins.values()) + PRIOR) / (bins.get(b, 0) + PRIOR * w)) for b, w in enumerate(width)] for cls, bins in by.items()}


@dataclass
class Decision:
    """What the corpus has decided: its ordinary text, the battery's evidence by class, and both cuts of each class."""

    model: Ordinary
    battery: dict[int, list[float]]
    rejected: dict[int, int]
    least: dict[int, int]

    def total(self, cls: int, p: float, e: float) -> float:
        """log2 of a token's evidence by battery and likelihood together."""
        by = self.battery.get(cls)
        return e + (by[density_bin(p)] if by else 0.0)

    def reports(self, cls: int, p: float, e: float) -> bool:
        return p_bin(p) < self.rejected.get(cls, LAST + 1) and math.floor(self.total(cls, p, e) * STEPS) >= self.least.get(cls, LAST + 1)


_SCAN = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,class:int,p:double,e:double,token:bigint>>"


def token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big", signed=True)


def _scan(batches: Iterator[pa.RecordBatch], model: Ordinary) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("p", pa.float64()), ("e", pa.float64()), ("token", pa.int64())]))
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
            found = candidates(text, base, model)
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, [{"start": a, "kind": k, "end": b} for a, k, b in base], [dict(zip(("start", "end", "class", "p", "e"), f, strict=True), token=token_hash(text[f[0] : f[1]])) for f in found]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), base_type, found_type]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])


def p_bin(p: float) -> int:
    """Bins of equal width in log p; a bin's p-values are 2 ** (-bin / STEPS) at most."""
    return min(LAST, int(-math.log2(max(p, 1e-300)) * STEPS))


def rejection_cuts(histogram: list[tuple[int, int, int]], q: float = Q) -> dict[int, int]:
    """For each class the bin of p-values from which on Benjamini-Hochberg rejects; ``histogram``: class, bin, count. Bins count at their upper ends."""
    by: dict[int, list[tuple[int, int]]] = {}
    for cls, b, n in histogram:
        by.setdefault(cls, []).append((b, n))
    out = {}
    for cls, rows in by.items():
        m, rank, out[cls] = sum(n for _, n in rows), 0, LAST + 1
        for b, n in sorted(rows, reverse=True):
            rank += n
            if 2.0 ** (-b / STEPS) <= q * rank / m:
                out[cls] = b
    return out


def report_cuts(histogram: list[tuple[int, int, int]], totals: dict[int, int], q: float = Q) -> dict[int, int]:
    """For each class the least bin of e-values that is reported; ``histogram``: class, bin (log2 e times ``STEPS``, rounded down), count.

    Benjamini-Hochberg for e-values: the k largest are reported for the largest k at which the k-th is ``totals[class]`` / (q k) or
    more; ``totals`` counts all tokens of a class, also those that the battery has rejected, whose evidence counts as 0.
    """
    by: dict[int, list[tuple[int, int]]] = {}
    for cls, b, n in histogram:
        by.setdefault(cls, []).append((b, n))
    out = {}
    for cls, rows in by.items():
        rank, out[cls] = 0, LAST + 1
        for b, n in sorted(rows, reverse=True):
            rank += n
            if b / STEPS >= math.log2(totals[cls] / (q * rank)):
                out[cls] = b
    return out


def _totals(batches: Iterator[pa.RecordBatch], battery: dict[int, list[float]], rejected: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The bins of all evidence together, of tokens that the battery hasn't rejected, counted in each task."""
    own, counts = Decision(None, battery, rejected, {}), {}
    for batch in batches:
        for cls, p, e in zip(*(batch.column(c).to_pylist() for c in ("class", "p", "e")), strict=True):
            if p_bin(p) < rejected.get(cls, LAST + 1):
                key = cls, max(-1, min(LAST, math.floor(own.total(cls, p, e) * STEPS)))
                counts[key] = counts.get(key, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())], names=["class", "b", "n"])


def _decided(docs: DataFrame, id_col: str, text_col: str, q: float) -> tuple[DataFrame, Decision]:
    """All rows scanned, and what the corpus's distinct tokens decide."""
    kept = Stored(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = ordinary(rows)
    scanned = kept.write(rows.mapInArrow(partial(_scan, model=model), f"id {rows.dtypes[0][1]}, {_SCAN}"), "scanned")
    found = scanned.select(F.explode("found").alias("f")).select("f.token", "f.class", "f.p", "f.e")
    distinct = kept.write(found.groupBy("token").agg(*(F.first(c).alias(c) for c in ("class", "p", "e"))), "tokens")  # equal tokens have equal values
    bits = F.lit(0.0) - F.log2(F.greatest("p", F.lit(1e-300)))
    by = lambda df, most, steps: [tuple(r) for r in df.groupBy("class", F.least(F.floor(bits * steps), F.lit(most)).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()]  # noqa: E731  classes x bins at most
    every = by(distinct, LAST, STEPS)
    rejected, evidence_of_battery = rejection_cuts(every, q), battery_evidence(by(distinct.where("e <= 0"), DENSITY - 1, 1))
    totals = {c: sum(n for k, _, n in every if k == c) for c in rejected}
    bins = distinct.mapInArrow(partial(_totals, battery=evidence_of_battery, rejected=rejected), "class int, b int, n bigint").groupBy("class", "b").agg(F.sum("n").alias("n")).collect()
    kept.drop(distinct)
    return scanned, Decision(model, evidence_of_battery, rejected, report_cuts([tuple(r) for r in bins], totals, q))


def _report(batches: Iterator[pa.RecordBatch], decision: Decision) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
            added = [{"start": f["start"], "kind": 3, "end": f["end"]} for f in found if decision.reports(f["class"], f["p"], f["e"])]
            out.append(sorted(base + added, key=lambda s: (s["start"], s["kind"], s["end"])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_assign", "n_access", "n_hex", "base_sha256")), pa.array(out, kind)], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "secrets"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """``id_col``, n_assign, n_access, n_hex, base_sha256 and secrets: an array of (start, kind, end), by start and then kind.

    Positions are code points, the end exclusive. A null text is empty and has no secrets. Repeated rows are scanned each, but a
    token counts once in the control, whatever its copies; a null id stays null; an empty table gives no rows; other columns
    aren't read.
    """
    scanned, decision = _decided(docs, id_col, text_col, q)
    schema = f"id {dict(scanned.dtypes)['id']}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, secrets array<struct<start:int,kind:int,end:int>>"
    return scanned.mapInArrow(partial(_report, decision=decision), schema).withColumnRenamed("id", id_col)


def span_text(secrets):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, decision: Decision, mask: str) -> str:
    """A text with each of its secrets replaced; overlapping ones become one."""
    base = base_spans(text)
    spans = [(a, b) for a, _, b in base] + [(a, b) for a, b, cls, p, e in candidates(text, base, decision.model) if decision.reports(cls, p, e)]
    out, reach = [], 0
    for a, b in sorted(spans):
        if a >= reach:
            out += [text[reach:a], mask]
        reach = max(reach, b)
    return "".join([*out, text[reach:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", q: float = Q) -> DataFrame:
    """All columns of ``docs``, each secret replaced by ``mask``; overlapping spans become one. Null texts stay null.

    Once the corpus has given its cuts, each row is masked by itself, without a join: also rows without an id, and rows of one id.
    """
    _, decision = _decided(docs, id_col, text_col, q)

    def mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([t and masked(t, decision, mask) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(mask_rows, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
