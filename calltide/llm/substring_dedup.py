"""Substring deduplication by level-wise doubling of repeated windows.

Levels are window lengths, each twice the one before (or one word more): 12, 25 and 50 for windows of 50 words. A window of 2n
words can repeat only where the windows of n words inside it do, so only windows that repeat at a level (*survivors*) are
extended to the next; the levels end when none survive.

* Level 1 needn't count every short window: each whole window picks the short one inside it with the smallest mixed hash, which
  is the same in every copy of it; about one in twenty words is picked. The picked window is extended forward where its whole
  window goes on that far, else backward, which is the same in every copy, too.
* Each level counts its candidates, finds the first document of each that repeats, and gives these to the next level: a whole
  window can start in a smaller document only if what it has picked does, so only such windows are looked up in the end.
* Texts that are copies of a smaller document's as a whole are settled before level 1.

Texts are read once for the hashes of all picked places (a level's hash is made of two of the level before), and again at the last
level, for documents with survivors alone. What travels is the picked places' hashes, level by level the survivors, and the
texts of documents that have some left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from calltide.llm.common import Stored

WINDOW = 50
#: Words of a window at the first level, at least.
SHORTEST = 12
BASE, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of one document that are hashed at a time; blocks overlap by a window.
BLOCK = 1 << 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of each window of ``length`` words: a polynomial of the words' hashes, modulo 2**64, mixed. Doubles the length by squaring."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out, have = None, 0  # windows of ``have`` words so far
    part, size = h, 1  # windows of ``size`` words; ``step``: base ** size
    n = length
    step = np.asarray([base])  # arrays wrap around silently
    while n:
        if n & 1:
            out, have = (part, size) if out is None else (out[: len(part) - have] * step + part[have:], have + size)
        n >>= 1
        if n:
            part, step, size = part[: len(part) - size] * step + part[size:], step * step, size * 2
    return mix(out[: len(h) - length + 1])


def picked(h: np.ndarray, inside: int) -> np.ndarray:
    """For each ``inside`` consecutive windows the place of the smallest (by its upper 43 bits), leftmost first.

    The lower bits of a hash give way to its place. The minimum over a stretch is that of the end of one block of ``inside``
    places and of the start of the next, so two running minima do for all stretches.
    """
    out, low = [], np.uint64((1 << 21) - 1)
    for at in range(0, len(h) - inside + 1, BLOCK):
        part = h[at : at + BLOCK + inside - 1]
        key = np.full(-(-len(part) // inside) * inside, np.iinfo(np.uint64).max, np.uint64)
        key[: len(part)] = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        blocks, n = key.reshape(-1, inside), len(part) - inside + 1
        start = np.minimum.accumulate(blocks, axis=1).ravel()
        end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        out.append((np.minimum(end[:n], start[inside - 1 : inside - 1 + n]) & low).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """The lengths of windows, each half of the next (rounded down), from ``shortest`` words or more up to ``window``."""
    out = [window]
    while out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


def picks(h: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """For each whole window of a text (``h``: its words' hashes) the place of the short window that it has picked, and how many
    words of the whole window follow that place."""
    inside = window - short + 1
    at = picked(window_hashes(h, short), inside)
    return at, np.arange(len(at)) + window - at


def extended(at: np.ndarray, follow: np.ndarray, short: int, length: int) -> np.ndarray:
    """Where the window of ``length`` words starts that the one picked at ``at`` is extended to: there, or as to end where it ends."""
    return np.where(follow >= length, at, at + short - length)


def whole_hashes(h: np.ndarray) -> tuple[int, int]:
    """128 bits over a whole text's words."""
    n = len(h)
    one = mix(window_hashes(h, n, BASE2) + np.uint64(n)) if n else np.zeros(1, np.uint64)
    two = window_hashes(h, n) if n else one
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def places_of(words: list[bytes], window: int, lengths: list[int]) -> tuple[list[np.ndarray], tuple[int, int]]:
    """For each distinct extended place of a text, its start and hash at each level below the last; and the text's whole hash."""
    h = word_hashes(words)
    if len(words) < window:
        return [np.zeros(0, np.int64)] * (2 * len(lengths) - 2), whole_hashes(h)
    at, follow = picks(h, window, lengths[0])
    key = at * (1 << len(lengths)) + sum((follow >= n).astype(np.int64) << k for k, n in enumerate(lengths[:-1]))  # what decides how it's extended
    use = np.unique(key, return_index=True)[1]
    starts = [extended(at[use], follow[use], lengths[0], n) for n in lengths[:-1]]
    return [x for n, start in zip(lengths, starts, strict=False) for x in (start, window_hashes(h, n)[start].view(np.int64))], whole_hashes(h)


def _scan(batches: Iterator[pa.RecordBatch], window: int, lengths: list[int], digest: bool) -> Iterator[pa.RecordBatch]:
    """A row for each text: words, what is kept of it if nothing goes, its hash, and its places level by level."""
    for batch in batches:
        found, n, kept, whole = [], [], [], []
        for text in batch.column("text").to_pylist():
            words = text.encode().split()
            places, w = places_of(words, window, lengths)
            found.append(places), n.append(len(words)), kept.append(keep(words, digest)), whole.append(w)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in found])]).astype(np.int32))
        columns = []
        for k in range(len(lengths) - 1):
            start, h = (np.concatenate([p[2 * k + i] for p in found] or [np.zeros(0, np.int64)]) for i in range(2))
            columns += [pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(h.astype(np.int64)))]
        names = [f"{x}{k}" for k in range(len(lengths) - 1) for x in ("at", "h")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array([w[0] for w in whole], pa.int64()), pa.array([w[1] for w in whole], pa.int64()), *columns],
            names=["id", "t", "n_words", "kept", "w1", "w2", *names],
        )


def _last_level(batches: Iterator[pa.RecordBatch], window: int, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """The whole windows whose extended place has survived: where they start, two hashes, and whether to look them up."""
    for batch in batches:
        rows = []
        for doc, text, marks in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            h = word_hashes(text.encode().split())
            at, follow = picks(h, window, lengths[0])
            place = extended(at, follow, lengths[0], lengths[-2])
            order = np.argsort(np.asarray([m["at"] for m in marks], np.int64), kind="stable")
            known, first = (np.asarray([m[k] for m in marks], np.int64)[order] for k in ("at", "first"))
            where = np.minimum(np.searchsorted(known, place), len(known) - 1)
            use = np.flatnonzero(known[where] == place)
            h1, h2 = window_hashes(h, window)[use], window_hashes(h, window, BASE2)[use] >> np.uint64(33)
            rows.append((use, h1.view(np.int64), h2.astype(np.int32), first[where[use]] < doc))
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["id", "t", "at", "h1", "h2", "look"])


def keep(words: list[bytes], digest: bool) -> str:
    text = b" ".join(words)
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + window, n), -1)
    return np.cumsum(mark[:n]) > 0


def _cut(batches: Iterator[pa.RecordBatch], window: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            words = text.encode().split()
            gone = covered(np.asarray(starts, np.int64), window, len(words))
            left = [words[i] for i in np.flatnonzero(~gone)]
            out.append((len(words) - len(left), keep(left, digest)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["id", "t", "n_removed", "left"])


def firsts(windows: DataFrame, *key: str) -> DataFrame:
    """Of windows that stand in several documents the first of these. Few rows in all: a window once, whatever its copies."""
    return windows.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shortest: int = SHORTEST, digest: bool = False, seen: dict[int, int] | None = None) -> DataFrame:
    """``id_col``, n_words, n_removed and kept (the kept words, joined by one space), or kept_sha256 with ``digest``.

    Words are runs of anything but U+0020 and U+0009 to U+000D, unchanged. Each word that a window of ``window`` words covers
    goes if the window's words also start somewhere in a document with a smaller id; windows are judged on the texts as given.
    Ids are whole numbers (a TypeError else). Null texts are empty. Rows of one id are one document; a row with a null id is no document: it keeps
    all its words and removes none of others. Other columns aren't read. ``window`` is at least twice ``shortest``. ``seen``
    takes, for each level's length, how many places had survived it.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is no column of whole numbers")
    lengths, spark, kept = levels(window, shortest), docs.sparkSession, Stored(docs.sparkSession, "substring-dedup")
    if len(lengths) < 2:
        raise ValueError(f"a window of {window} words has no level of {shortest} words or more below it")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.hash(text).alias("t"), text.alias("text"))  # t tells rows of one id apart
    lists = "".join(f", at{k} array<int>, h{k} array<bigint>" for k in range(len(lengths) - 1))
    scan = kept.write(rows.mapInArrow(partial(_scan, window=window, lengths=lengths, digest=digest), f"id bigint, t int, n_words bigint, kept string, w1 bigint, w2 bigint{lists}"), "scan")

    long = scan.where(F.col("id").isNotNull() & (F.col("n_words") >= window))
    whole = kept.write(firsts(long, "w1", "w2"), "whole")  # stored, so that a text of very many copies can be split in the join
    copies = kept.write(long.select("id", "t", "w1", "w2").join(whole.hint("merge"), ["w1", "w2"]).where("id > first").select("id", "t").distinct(), "copies")
    places = F.explode(F.arrays_zip(*(c for k in range(len(lengths) - 1) for c in (f"at{k}", f"h{k}"))))
    alive = long.join(copies.hint("merge"), ["id", "t"], "left_anti").select("id", "t", places.alias("p")).select("id", "t", "p.*", F.lit(None).cast("bigint").alias("first"))
    before: list[DataFrame] = []
    for k, length in enumerate(lengths[:-1]):
        # One document may hold a window often; rows of a very common one are split in the join, as its first is a stored row.
        # Merge joins at any size: the plan is the same for small tables and large ones.
        again = kept.write(firsts(alive, f"h{k}"), f"firsts-{length}")
        alive = kept.write(alive.drop("first").join(again.hint("merge"), f"h{k}").drop(f"h{k}"), f"alive-{length}")
        kept.drop(again, *before)
        before, n = [alive], alive.count()
        if seen is not None:
            seen[length] = n
        if not n:
            break
    marks = alive.groupBy("id", "t").agg(F.collect_list(F.struct(F.col(f"at{len(lengths) - 2}").alias("at"), "first")).alias("marks"))  # no more than a document's words
    marks = kept.write(marks, "marks")
    texts = rows.where("id IS NOT NULL").join(marks.hint("merge"), ["id", "t"])
    texts = kept.write_bucketed(texts, "texts", int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "t")  # texts aren't shuffled again
    try:  # the catalog's entry for the texts goes, whatever happens
        found = texts.mapInArrow(partial(_last_level, window=window, lengths=lengths), "id bigint, t int, at array<int>, h1 array<bigint>, h2 array<int>, look array<boolean>")
        windows = kept.write(found.select("id", "t", F.explode(F.arrays_zip("at", "h1", "h2", "look")).alias("w")).select("id", "t", "w.*"), f"windows-{window}")
        first = kept.write(firsts(windows, "h1", "h2"), f"firsts-{window}")
        again = windows.where("look").select("id", "t", "at", "h1", "h2").join(first.hint("merge"), ["h1", "h2"]).where("id > first")
        starts = kept.write(again.groupBy("id", "t").agg(F.array_sort(F.collect_set("at")).alias("starts")), "starts")
        kept.drop(alive, marks, windows, first)
        cut = texts.select("id", "t", "text").join(starts.hint("merge"), ["id", "t"]).mapInArrow(partial(_cut, window=window, digest=digest), "id bigint, t int, n_removed bigint, left string")
        cut = kept.write(cut, "cut")
        kept.drop(starts)
    finally:
        kept.drop(texts)
    gone = cut.unionByName(copies.select("id", "t", F.lit(None).cast("bigint").alias("n_removed"), F.lit(keep([], digest)).alias("left")))
    out = scan.select("id", "t", "n_words", "kept").join(gone.dropDuplicates(["id", "t"]).hint("merge"), ["id", "t"], "left")
    removed = F.when(F.col("left").isNull(), 0).otherwise(F.coalesce("n_removed", "n_words")).cast("bigint")
    kind = docs.select(id_col).dtypes[0][1]
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", removed.alias("n_removed"), F.coalesce("left", "kept").alias("kept_sha256" if digest else "kept"))
