"""Spelling variants by a symmetric-delete join.

Every word emits a key for itself and one for each of its distinct single deletions. Words whose keys meet are candidates: one
is the other with a code point deleted (a word's own key meets a deletion's), or both lose one code point to become the same
(two deletions meet), which is one replacement if both can lose it at the same place and a farther pair (as a swap of
neighbours) if not. What meets is verified by the words' edit distance. A key's group is bounded by its length times the
alphabet, however many rows the table has. A word's form is its commonest near word, if that is common enough; roots
follow forms, doubling the way at each join.

Keys are 64-bit hashes, so a word of a million letters emits a million numbers and no text; words of over ``CARRIED`` code
points are verified by a join with their texts. Tasks count the words of their documents before anything is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import UPPER, Stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWERED = str.maketrans(UPPER, UPPER.lower())
MIN_CHARS, MIN_COUNT, TIMES = 7, 2, 10
#: One run of a document in so many loses a code point.
NOISE = 31
#: Words longer than this don't travel with their keys.
CARRIED = 64
#: Distinct words after which a task hands on what it has counted; key rows that are made at a time.
COUNTED, MADE = 200_000, 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def noisy(run: str, document: str, noise: int) -> str:
    """The run, without one code point if the hash of document and run says so."""
    h = zlib.crc32(f"{document}:{run}".encode())
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch], min_chars: int, noise: int | None) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur, counted over many documents at a time."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for run, n in Counter(RUN.findall(text.translate(LOWERED))).items():
                if len(run) >= min_chars:
                    word = noisy(run, doc, noise) if noise else run
                    if len(word) >= min_chars:
                        counts[word] += n
            if len(counts) > COUNTED:
                yield flush()
    if counts:
        yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int | None = NOISE) -> DataFrame:
    """Distinct words (maximal runs of Latin letters, A-Z lowered) of ``min_chars`` code points or more that occur ``min_count``
    times or more, with their counts; see :func:`spelling_variants` for ``noise``."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_counts, min_chars=min_chars, noise=noise), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each key which word it's of, its hash, and the first and last place whose deletion gives it (-1: the word itself).

    Deletions inside a run of one letter give one string, so each run gives one key. A hash is that of the string's code points
    as digits, and of its length.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    start = np.concatenate([[0], np.cumsum(lengths)])
    of = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - start[of]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(int(lengths.max(initial=1)), 1), BASE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[place], dtype=np.uint64)])
    whole = sums[start[1:]] - sums[start[:-1]]
    first = np.flatnonzero((place == 0) | (codes != np.concatenate([[np.uint64(0)], codes[:-1]])))
    last = np.concatenate([first[1:], [len(codes)]]) - 1
    w = of[first]
    before = sums[first] - sums[start[w]]
    after = (sums[start[w + 1]] - sums[first + 1]) * INVERSE
    keys = np.concatenate([whole, before + after])
    sizes = np.concatenate([lengths, lengths[w] - 1]).astype(np.uint64)
    x = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sizes * np.uint64(0x94D049BB133111EB)
    own = np.full(len(words), -1)
    return np.concatenate([np.arange(len(words)), w]), (x ^ (x >> np.uint64(32))).view(np.int64), np.concatenate([own, place[first]]), np.concatenate([own, place[last]])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        at = 0
        while at < len(words):
            to, made = at, 0
            while to < len(words) and (to == at or made + len(words[to]) < MADE):
                made, to = made + len(words[to]) + 1, to + 1
            of, keys, low, high = word_keys(words[at:to])
            part = batch.slice(at, to - at)
            carried = pa.array([w if len(w) <= CARRIED else None for w in words[at:to]], pa.string())
            for k in range(0, len(of), MADE):
                take = pa.array(of[k : k + MADE])
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), carried.take(take), part.column("n").take(take), *(pa.array(c[k : k + MADE], kind) for c, kind in ((keys, pa.int64()), (low, pa.int32()), (high, pa.int32())))], names=["id", "word", "n", "key", "low", "high"])
            at = to


def near_words(words: DataFrame) -> DataFrame:
    """Ordered pairs of words that differ by one code point: id and n of the first, word and n of the second; ``words``: id, word, n."""
    keys = words.mapInArrow(_keys, "id bigint, word string, n bigint, key bigint, low int, high int")
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "word", "n", "low", "high"))) for side in "ab")
    own_a, own_b = F.col("low_a") < 0, F.col("low_b") < 0
    met = (F.col("id_a") != F.col("id_b")) & ((own_a != own_b) | (~own_a & (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))))
    one = F.levenshtein("word_a", "word_b", 1) == 1
    pairs = a.hint("merge").join(b, (a["key"] == b["key"]) & met & F.coalesce(one, F.lit(True))).drop(b["key"])
    short = pairs.where("word_a IS NOT NULL AND word_b IS NOT NULL").select("id_a", "n_a", "word_b", "n_b")
    long = pairs.where("word_a IS NULL OR word_b IS NULL").select("id_a", "n_a", "id_b", "n_b")
    texts = words.where(F.char_length("word") >= CARRIED)
    for side in "ab":
        long = long.join(texts.select(F.col("id").alias(f"id_{side}"), F.col("word").alias(f"word_{side}")).hint("merge"), f"id_{side}")
    return short.unionByName(long.where(one).select("id_a", "n_a", "word_b", "n_b"))


def roots(forms: DataFrame, kept: Stored) -> DataFrame:
    """``forms``: word and form, only words that have one; gives word and root, where no further form follows.

    Each pass replaces a root by that root's own root, so the way doubles; counts grow along it, so it has no circle.
    """
    at = kept.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        moved = kept.write(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        kept.drop(at)
        at, more = moved.drop("moved"), moved.where("moved").limit(1).count()
        at._stored_at = moved._stored_at
        if not more:
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, noise: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``docs`` (see :func:`word_counts`).

    ``n_near`` counts the words one insertion, deletion or replacement of a code point away. The commonest of these (ties: the
    smallest in code-point order) is the word's ``form`` if it's at least ``times`` as common, else form and form_n are null.
    ``root`` is where forms lead to, the word itself if it has none. With ``noise``, a run of a document loses one code point
    where the CRC-32 of "id:run" is divisible by it, at that number modulo the run's length: misspellings to find again. Null
    texts have no words; a null id counts as an empty one; repeated rows count each; an empty table gives no rows; other columns
    aren't read.
    """
    kept = Stored(docs.sparkSession, "spelling")
    words = kept.write(word_counts(docs, id_col, text_col, min_chars, min_count, noise).withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.min(F.struct((-F.col("n_b")).alias("m"), F.col("word_b").alias("word")))  # the largest n, then the smallest word
    near = near_words(words).groupBy("id_a").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near.withColumnRenamed("id_a", "id").hint("merge"), "id", "left")
    good = -F.col("best.m") >= times * F.col("n")
    found = kept.write(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "forms")
    kept.drop(words)
    ends = roots(found.where("form IS NOT NULL"), kept)
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
