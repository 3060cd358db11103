"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words, hashed to a fixed number of columns with damped counts of unit length together, and statistics
of its structure (shares of kinds of characters, repetition, lines) and of numeric columns beside it, each as one of a few
quantile bins. Besides a weight, every feature has a short vector; the product of two features' vectors is what their meeting
adds. All pairs together cost no more than the features themselves, as the sum over pairs is half of the square of the sum
less the sum of squares.

Training reads at most about ``max_rows_per_class`` labelled rows of each class, picked by a hash of the id, so that samples
and model have a bounded size; a fifth of these is kept back to fit the logistic curve that turns sums into scores, weighted
as the classes stand in all labels. Every document is scored whole, where it lies: no shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Words after which a worker's memo of their columns is emptied.
MEMO = 300_000


@dataclass(frozen=True)
class QualityConfig:
    columns: int = 4_096  # of hashed words
    bins: int = 8  # of each statistic
    rank: int = 6
    max_rows_per_class: int = 3_000
    epochs: int = 24
    batch: int = 256
    rate: float = 0.02
    decay: float = 2e-4
    seed: int = 5


@dataclass
class Machine:
    """``edges``: bins' inner edges by statistic; a machine without both labels gives ``base`` for every text."""

    config: QualityConfig
    base: float = 0.0
    edges: np.ndarray | None = None
    bias: float = 0.0
    weights: np.ndarray | None = None  # by feature: words' columns, then each statistic's bins
    factors: np.ndarray | None = None  # features x rank
    curve: tuple[float, float] = (1.0, 0.0)
    memo: dict[str, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


_KIND = np.zeros(256, np.int64)  # of a byte: 0 else, 1 capital, 2 digit, 3 blank, 4 mark of sentences, 5 other mark, 6 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 6 if _b > 127 else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:?'\"-()" else 5 if _c.isprintable() and not _c.isalpha() else 0
STATISTICS = ["words", "distinct", "commonest", "again", "length", "wordless", "capitals", "digits", "blanks", "marks", "odd", "foreign", "lines", "distinct_lines", "words_a_line", "begun"]


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """One number for each of ``STATISTICS``; an empty text has zeros."""
    if not words:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7) / len(data)
    lines = [line for line in text.split("\n") if line]
    n = len(words)
    again = sum(map(str.__eq__, words, words[1:]))
    wordless = n - sum(map(str.isalpha, (w[0] for w in words)))
    begun = sum(line[0].isupper() for line in lines)
    return [
        float(np.log1p(n)), len(counts) / n, max(counts.values()) / n, again / n, sum(map(len, words)) / n, wordless / n,
        *kinds[1:].tolist(), float(np.log1p(len(lines))), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), begun / max(len(lines), 1),
    ]


def hashed(counts: Counter, c: QualityConfig, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a text's words, ascending, and what stands there: damped counts, of length one together."""
    if len(memo) > MEMO:
        memo.clear()
    at = np.empty(len(counts), np.int64)
    for i, w in enumerate(counts):
        if (k := memo.get(w)) is None:
            k = memo[w] = zlib.crc32(w.encode("utf-8", "replace")) % c.columns
        at[i] = k
    sums = np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)), c.columns) if len(at) else np.zeros(c.columns)
    used = np.flatnonzero(sums)
    value = np.log1p(sums[used])
    return used, value / (np.sqrt((value**2).sum()) or 1)


def features(text: str, beside: Sequence[float | None], c: QualityConfig, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    words = text.lower().split()
    counts = Counter(words)
    return *hashed(counts, c, memo), [*statistics(text, words, counts), *(float("nan") if v is None else float(v) for v in beside)]


def binned(numbers: np.ndarray, m: Machine) -> np.ndarray:
    """Feature of each statistic (texts x statistics); the last bin of a statistic is for what is missing."""
    c, out = m.config, np.empty(numbers.shape, np.int64)
    for k, edges in enumerate(m.edges):
        out[:, k] = c.columns + k * (c.bins + 1) + np.where(np.isnan(numbers[:, k]), c.bins, np.searchsorted(edges, numbers[:, k], side="right"))
    return out


def sums(at: np.ndarray, value: np.ndarray, m: Machine) -> float:
    """The machine's output in time linear in the text's features: half of (square of the sum - sum of squares), factor by factor."""
    v = m.factors[at] * value[:, None]
    total = v.sum(axis=0)
    return m.bias + float(m.weights[at] @ value) + 0.5 * float((total * total).sum() - (v * v).sum())


def curve_score(z: np.ndarray | float, m: Machine) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(m.curve[0] * z + m.curve[1], -30, 30)))


def text_score(text: str, beside: Sequence[float | None], m: Machine) -> float:
    if m.weights is None:
        return m.base
    at, value, numbers = features(text, beside, m.config, m.memo)
    bins = binned(np.array([numbers]), m)[0]
    return float(curve_score(sums(np.concatenate([at, bins]), np.concatenate([value, np.ones(len(bins))]), m), m))


def dense(rows: list[tuple[np.ndarray, np.ndarray]], numbers: np.ndarray, m: Machine) -> np.ndarray:
    c = m.config
    x = np.zeros((len(rows), c.columns + numbers.shape[1] * (c.bins + 1)), np.float32)
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    x[np.arange(len(rows))[:, None], binned(numbers, m)] = 1
    return x


def forward(x: np.ndarray, m: Machine) -> tuple[np.ndarray, np.ndarray]:
    total = x @ m.factors
    return m.bias + x @ m.weights + 0.5 * ((total**2).sum(axis=1) - (x**2) @ (m.factors**2).sum(axis=1)), total


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, m: Machine) -> None:
    """Adam on the weighted logistic loss, in batches of a seeded order."""
    c, rng = m.config, np.random.default_rng(m.config.seed)
    m.bias, m.weights, m.factors = 0.0, np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], c.rank)).astype(np.float32)
    first, second, step = [np.zeros_like(m.weights), np.zeros_like(m.factors), 0.0], [np.zeros_like(m.weights), np.zeros_like(m.factors), 0.0], 0
    for _ in range(c.epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), c.batch):
            use, step = order[k : k + c.batch], step + 1
            part = x[use]
            z, total = forward(part, m)
            off = (weight[use] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[use]) / weight[use].sum()).astype(np.float32)
            slopes = [part.T @ off + c.decay * m.weights, part.T @ (off[:, None] * total) - m.factors * ((part**2).T @ off)[:, None] + c.decay * m.factors, float(off.sum())]
            moves = []
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                moves.append(c.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8))
            m.weights, m.factors, m.bias = m.weights - moves[0].astype(np.float32), m.factors - moves[1].astype(np.float32), float(m.bias - moves[2])


def fit_curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on sums by Newton steps, held near the sums as they are by a slight ridge."""
    x, w, start = np.column_stack([z, np.ones_like(z)]).astype(np.float64), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (weight * (p - y)) + (w - start))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _sample(batches: Iterator[pa.RecordBatch], c: QualityConfig) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}
    for batch in batches:
        beside = list(zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns)), strict=True)) or [()] * batch.num_rows
        made = [features(t, b, c, memo) for t, b in zip(batch.column("text").to_pylist(), beside, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("back"), pa.array([a for a, _, _ in made], pa.list_(pa.int32())), pa.array([v for _, v, _ in made], pa.list_(pa.float32())), pa.array([s for *_, s in made], pa.list_(pa.float64()))], names=["label", "back", "at", "value", "numbers"])


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[str] = ("n_chars",)) -> Machine:
    """A machine from the texts of ``docs`` that ``labels`` (id, 0 or 1) marks; ``metadata`` names numeric columns of ``docs``.

    Of several labels of one id the lowest holds, of several rows of one id the one with the smallest text; null ids, labels and
    texts are left out. With labels of one class or none, every text gets the share of label 1 (0 without any).
    """
    c, scale = config, 1 << 30
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    found = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not found.get(0) or not found.get(1):
        return Machine(c, base=float(bool(found.get(1))))
    share = {k: min(1.0, c.max_rows_per_class / n) for k, n in found.items()}
    marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < F.when(F.col("label") == 1, int(share[1] * scale)).otherwise(int(share[0] * scale)))
    beside = [F.col(x).cast("double").alias(f"m{k}") for k, x in enumerate(metadata)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *beside).where("text IS NOT NULL").join(F.broadcast(marks), "id")  # about 2 * max_rows_per_class labels at most
    rows = rows.groupBy("id", "label").agg(F.min(F.struct("text", *(f"m{k}" for k in range(len(beside))))).alias("r"))
    rows = rows.select("label", (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(5)) == 0).alias("back"), "r.*")
    got = rows.mapInArrow(partial(_sample, c=c), "label int, back boolean, at array<int>, value array<float>, numbers array<double>").toArrow()
    if len(set(got.column("label").to_pylist())) < 2:
        return Machine(c, base=float(found[1] / (found[0] + found[1])))
    numbers = np.array(got.column("numbers").to_pylist(), np.float64)
    order = np.lexsort(numbers.T)  # doesn't depend on partitions
    got, numbers = got.take(order), numbers[order]
    y, back = np.asarray(got.column("label")).astype(np.float32), got.column("back").to_numpy().astype(bool)
    m = Machine(c)
    m.edges = np.array([np.nanquantile(v, np.arange(1, c.bins) / c.bins) if not np.isnan(v).all() else np.zeros(c.bins - 1) for v in numbers.T])
    x = dense(list(zip((np.array(a, np.int64) for a in got.column("at").to_pylist()), got.column("value").to_pylist(), strict=True)), numbers, m)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0]).astype(np.float32)
    if len(set(y[~back].tolist())) < 2 or len(set(y[back].tolist())) < 2:
        back = np.zeros(len(y), bool)
    learn(x[~back], y[~back], weight[~back], m)
    m.curve = fit_curve(forward(x[back], m)[0], y[back], weight[back]) if back.any() else m.curve
    return m


def score(docs: DataFrame, model: Machine, text_col: str = "text", metadata: Sequence[str] = ("n_chars",)) -> DataFrame:
    """All of ``docs``' columns and ``quality`` (0 to 1). A null text counts as empty; a null in ``metadata`` is a bin of its own.

    Repeated rows are scored each; a column named ``quality`` is replaced; an empty table gives no rows. Ids are no input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("quality") if "quality" in docs.columns else docs
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, numbers = batch.column(text_col).to_pylist(), [batch.column(k).to_pylist() for k in range(width, batch.num_columns)]
            beside = list(zip(*numbers, strict=True)) or [()] * len(texts)
            scores = [text_score(t or "", b, m) for t, b in zip(texts, beside, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(scores, pa.float64())], names=[*batch.schema.names[:width], "quality"])

    beside = [F.col(x).cast("double").alias(f"metadata {k}") for k, x in enumerate(metadata)]
    return rows.select("*", *beside).mapInArrow(run, StructType([*rows.schema.fields]).add("quality", DoubleType()))
