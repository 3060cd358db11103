"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary text, predict each character of a word from those before
it in the word. Orders up to ``shared_order`` are estimated from the pooled counts of both classes, so a rare expression backs
off to the same estimate in either; higher orders have counts of their class. A text's evidence is the difference of its
log-likelihoods over its number of characters; a logistic curve, fitted on documents that the scoring model hasn't seen
(two-fold), turns this into a score.

Training reads at most about ``max_rows_per_class`` labelled rows of each class, picked by a hash of the id: with that bound
the model has a bounded size and can be broadcast. Every document is scored whole, where it lies: no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = 2, 3
#: Words after which a worker's memo is emptied.
MEMO = 300_000


@dataclass(frozen=True)
class ToxicityConfig:
    order: int = 6
    shared_order: int = 2
    discount: float = 0.75
    max_rows_per_class: int = 6_000
    alphabet: int = 256  # the uniform estimate below the lowest order
    strong: float = 2.0  # a word's evidence beyond this also counts apart: its mean over the text is the curve's second input


@dataclass
class Order:
    """N-grams of one order: sorted hashes, alpha (2 x n: what a class gives one beyond its backoff), lam (2 x n: the backoff weight after one)."""

    keys: np.ndarray
    alpha: np.ndarray
    lam: np.ndarray


@dataclass
class KneserNey:
    """``orders`` from 1 up, and the backoff weight after nothing."""

    config: ToxicityConfig
    orders: list[Order]
    lam0: np.ndarray
    curve: tuple[float, ...] = (0.0,) * 5
    base: float = 0.0
    trained: bool = False
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


def words_of(text: str) -> list[str]:
    return text.lower().replace(",", " ").replace(".", " ").split()


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' characters with a begin and an end mark, each character's place in its word, and words' first places."""
    joined = "".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]]).astype(np.int64)
    out = np.full(int((lengths + 2).sum()), END, np.uint64)
    offset = np.arange(len(out)) - np.repeat(starts, lengths + 2)
    inner = (offset > 0) & (offset <= np.repeat(lengths, lengths + 2))
    out[inner] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    out[starts] = BEGIN
    return out, offset, starts


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[k][i]: the (k + 1)-gram that ends at i. Its context is hashes[k - 1][i - 1], its suffix hashes[k - 1][i]."""
    out = [_mix(chars + np.uint64(1))]
    for k in range(1, order):
        before = np.concatenate([[np.uint64(0)], out[-1][:-1]])
        out.append(_mix(before * np.uint64(0xD6E8FEB86659FD93) + chars + np.uint64(0x51 + (k << 24))))
    return out


GRAMS = ["kind", "gram", "context", "suffix", "half0", "half1"]


def _grams(batches: Iterator[pa.RecordBatch], c: ToxicityConfig) -> Iterator[pa.RecordBatch]:
    """Counts of hashed n-grams by class and half, for a partition's labelled rows: what a map-side combiner would send.

    ``kind`` is twice the order's index, plus one for an n-gram that begins its word; ``half0`` and ``half1`` pack the counts of
    ordinary and toxic text. Packed counts add up as they are, since a bounded sample has under 2**31 n-grams.
    """
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = list({w for w, _ in counts})
        at = {w: i for i, w in enumerate(words)}
        by = np.zeros((len(words), 4), np.int64)
        for (w, cell), n in counts.items():
            by[at[w], cell] += n
        counts.clear()
        chars, offset, starts = symbols(words)
        of_word = np.cumsum(offset == 0) - 1
        hashes, parts = gram_hashes(chars, c.order), []
        for k in range(c.order):
            use = np.flatnonzero((offset >= k) & (offset > 0))
            grams, one, where = np.unique(hashes[k][use], return_index=True, return_inverse=True)
            n = by[of_word[use]]
            sums = [np.bincount(where, n[:, j]).astype(np.int64) for j in range(4)]
            at = use[one]
            none = np.zeros(len(at), np.uint64)
            kind = np.full(len(at), 2 * k) + (offset[at] == k)  # odd: begins its word, so nothing can stand before it
            parts.append((kind, grams, hashes[k - 1][at - 1] if k else none, hashes[k - 1][at] if k else none, sums[0] << 32 | sums[1], sums[2] << 32 | sums[3]))
        columns = [np.concatenate([p[i] for p in parts]) for i in range(6)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in columns[1:])], names=GRAMS)

    for batch in batches:
        for text, cell in zip(batch.column("text").to_pylist(), batch.column("cell").to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                counts[word, cell] += n
            if len(counts) > 300_000:
                yield flush()
    if counts:
        yield flush()


def unpacked(got: pa.Table | pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The n-grams' hashes, and their counts: ordinary and toxic of half 0, then of half 1."""
    kind = got.column("kind").to_numpy()
    table = {"k": kind >> 1, "first": kind & 1 == 1} | {x: got.column(x).to_numpy().astype(np.int64, copy=True).view(np.uint64) for x in GRAMS[1:4]}
    return table, np.column_stack([f(got.column(h).to_numpy()) for h in GRAMS[4:] for f in (lambda v: v >> 32, lambda v: v & 0xFFFFFFFF)])


def estimate(table: dict[str, np.ndarray], counts: np.ndarray, c: ToxicityConfig) -> KneserNey:
    """The two models from n-gram counts; ``counts``: rows x (ordinary, toxic).

    The highest order, and n-grams that begin their word, count as often as they occur; others by how many characters stand
    before them. Up to ``shared_order`` both classes have the counts of both.
    """
    rows = [np.flatnonzero(table["k"] == k) for k in range(c.order)]
    keys = [np.unique(np.concatenate([table["gram"][rows[k]], table["context"][rows[k + 1]] if k + 1 < c.order else np.zeros(0, np.uint64)])) for k in range(c.order)]
    orders = [Order(x, np.zeros((2, len(x)), np.float32), np.ones((2, len(x)), np.float32)) for x in keys]
    lam0 = np.ones(2, np.float32)
    for k in range(c.order):
        at = np.searchsorted(keys[k], table["gram"][rows[k]])
        raw = counts[rows[k]].astype(float)
        if k + 1 < c.order:
            raw[~table["first"][rows[k]]] = 0
        n = np.stack([np.bincount(at, raw[:, cls], len(keys[k])) for cls in range(2)])
        shared = k < c.shared_order
        if k + 1 < c.order:
            suffix, above = np.searchsorted(keys[k], table["suffix"][rows[k + 1]]), counts[rows[k + 1]]
            seen = [above.sum(axis=1) > 0] * 2 if shared else [above[:, cls] > 0 for cls in range(2)]
            more = [np.bincount(suffix, seen[cls], len(keys[k])) for cls in range(2)]
            n = np.stack([n.sum(axis=0) + more[0]] * 2) if shared else n + np.stack(more)
        elif shared:
            n = np.stack([n.sum(axis=0)] * 2)
        n = n[:, at]
        context = np.searchsorted(keys[k - 1], table["context"][rows[k]]) if k else np.zeros(len(at), np.int64)
        for cls in range(2):
            whole, spare = np.bincount(context, n[cls]), np.bincount(context, np.minimum(n[cls], c.discount))
            orders[k].alpha[cls, at] = np.maximum(n[cls] - c.discount, 0) / np.maximum(whole[context], 1e-9)
            known = np.flatnonzero(whole > 0)
            weight = (spare[known] / whole[known]).astype(np.float32)
            if k:
                orders[k - 1].lam[cls, known] = weight
            elif len(known):
                lam0[cls] = weight[0]
    return KneserNey(c, orders, lam0)


def word_evidence(words: list[str], m: KneserNey) -> np.ndarray:
    """For each word: the log of its likelihood as toxic over that as ordinary text."""
    c = m.config
    chars, offset, starts = symbols(words)
    p = np.full((2, len(chars)), 1 / c.alphabet, np.float32)
    lam = np.repeat(m.lam0[:, None], len(chars), axis=1)  # what a place's shorter estimate weighs
    for k, (order, h) in enumerate(zip(m.orders, gram_hashes(chars, c.order), strict=True)):
        use = np.flatnonzero(offset >= k)
        at = np.minimum(np.searchsorted(order.keys, h[use]), len(order.keys) - 1)
        hit = order.keys[at] == h[use]
        predicted = offset[use] > 0
        alpha, after = np.where(hit, order.alpha[:, at], 0), np.where(hit, order.lam[:, at], 1)
        p[:, use[predicted]] = alpha[:, predicted] + lam[:, use[predicted]] * p[:, use[predicted]]
        lam[:, 1:] = 1
        inner = use[use + 1 < len(chars)]
        lam[:, inner + 1] = after[:, : len(inner)]
    ratio = np.log(p[1] + 1e-12) - np.log(p[0] + 1e-12)
    ratio[starts] = 0
    return np.add.reduceat(ratio.astype(np.float64), starts)


def text_evidence(text: str, m: KneserNey) -> tuple[float, float, int]:
    """Mean evidence of a character, mean of what words have beyond ``strong``, and how many characters were predicted; zeros for a text without words."""
    words = words_of(text)
    if not words:
        return 0.0, 0.0, 0
    if missing := set(words).difference(m.memo):
        learn(missing, m)
    n, found = sum(map(len, words)) + len(words), list(map(m.memo.__getitem__, words))
    limit = m.config.strong
    return sum(found) / n, sum([v - limit for v in found if v > limit]) / n, n


def learn(words: set[str], m: KneserNey) -> None:
    """Takes words' evidence into the memo, some thousands at a time."""
    new = list(words)
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        m.memo.update(zip(part, word_evidence(part, m).tolist(), strict=True))


def texts_evidence(texts: list[str], m: KneserNey) -> list[tuple[float, float, int]]:
    """:func:`text_evidence` of each; words new to the memo are worked out for many texts at once."""
    out = []
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        missing = set().union(*map(words_of, part)).difference(m.memo)
        if len(m.memo) + len(missing) > MEMO:
            m.memo.clear()
        learn(missing, m)
        out += [text_evidence(t, m) for t in part]
    return out


def curve_inputs(d: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean evidence, and the same against the spread that a text of that length has by chance; likewise for strong evidence."""
    return np.column_stack([np.ones_like(d), 10 * d, d * np.sqrt(n), 10 * s, s * np.sqrt(n)])


def fit_curve(d: np.ndarray, s: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a slight ridge."""
    x, w = curve_inputs(d, s, n), np.zeros(5)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-2 * np.eye(5)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def curve_score(d: float, s: float, n: int, m: KneserNey) -> float:
    if not m.trained:
        return m.base
    w, root = m.curve, n**0.5
    z = w[0] + 10 * d * w[1] + d * root * w[2] + 10 * s * w[3] + s * root * w[4]
    return 1 / (1 + 2.718281828459045 ** -max(-30.0, min(30.0, z)))


def _evidence(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    models = shared.value
    for batch in batches:
        texts, halves = batch.column("text").to_pylist(), batch.column("half").to_pylist()
        got: list = [None] * len(texts)
        for half in (0, 1):
            of = [i for i, h in enumerate(halves) if h == half]
            for i, g in zip(of, texts_evidence([texts[i] for i in of], models[half]), strict=True):
                got[i] = g
        yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int64())))], names=["label", "d", "s", "n"])


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> KneserNey:
    """A model from the texts of ``docs`` that ``labels`` (id, 0 or 1) marks.

    Of several labels of one id the highest holds; null ids, labels and texts are left out. With labels of one class or none,
    the model gives every text the share of toxic labels (0 without any).
    """
    spark, c = docs.sparkSession, config
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    found = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = found.get(0, 0), found.get(1, 0)
    if not n0 or not n1:
        return KneserNey(c, [], np.ones(2, np.float32), base=float(n1 > 0))
    scale = 1 << 30
    share = {k: min(1.0, c.max_rows_per_class / n) for k, n in ((0, n0), (1, n1))}
    pick = F.pmod(F.xxhash64("id"), F.lit(scale))
    marks = marks.where(pick < F.when(F.col("label") == 1, int(share[1] * scale)).otherwise(int(share[0] * scale)))
    marks = marks.withColumn("half", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2))).cast("int"))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    picked = picked.join(F.broadcast(marks), "id")  # about 2 * max_rows_per_class labels at most
    cells = picked.select("text", (F.col("half") * 2 + F.col("label")).alias("cell"))
    counted = cells.mapInArrow(lambda it: _grams(it, c), "kind int, gram bigint, context bigint, suffix bigint, half0 bigint, half1 bigint")
    table, cell = unpacked(counted.groupBy(*GRAMS[:4]).agg(F.sum("half0").alias("half0"), F.sum("half1").alias("half1")).toArrow())
    halves = [estimate(table, cell[:, 2:], c), estimate(table, cell[:, :2], c)]  # half 0's texts are scored by half 1's model
    shared = spark.sparkContext.broadcast(halves)
    seen = picked.select("text", "label", "half").mapInArrow(lambda it: _evidence(it, shared), "label int, d double, s double, n bigint").toArrow()
    shared.unpersist()
    y, d, s, n = (seen.column(x).to_numpy() for x in ("label", "d", "s", "n"))
    model = estimate(table, cell[:, :2] + cell[:, 2:], c)
    model.trained = True
    model.curve = fit_curve(d, s, n.astype(float), y.astype(float), np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of ``docs``' columns and ``toxicity`` (0 to 1). A null text counts as empty; an empty text gets what no evidence gives.

    Repeated rows are scored each; a column named ``toxicity`` is replaced; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            scores = [curve_score(*e, m) for e in texts_evidence(texts, m)] if m.trained else [m.base] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"])

    rows = docs.drop("toxicity") if "toxicity" in docs.columns else docs
    from pyspark.sql.types import DoubleType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("toxicity", DoubleType()))
