"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised word n-grams against training text windows.

Native: DataFrame functions only. Each document's windows are made next to its text and probed in the same task against the
hashes of the benchmark's windows; only hits travel. A hit is verified by its words, not by its hash. The set is broadcast
only up to ``max_broadcast_bytes``, which are summed first; beyond that hashes alone are shuffled, and hits are verified by a
join with their documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import Stored, ascii_lower, fresh

WINDOW = 10
#: Bytes of the benchmark's distinct windows (their words, and ``ROW_BYTES`` each for hash and row) up to which they're broadcast.
MAX_BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: Fixed value: what stands between the words of the contract, after A-Z is lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text. It's cut at what stands between them, which costs a fifteenth of matching each word does."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN, -1), "")


def _at(words: Column, at: Column, length: int) -> list[Column]:
    """The words of a window. Single elements are read, as a slice would copy the whole array each time."""
    return [F.get(words, at + i) for i in range(length)]


def _gram_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *_at(words, at, length))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """length, h, gram (its words, space-joined) and the sorted items of each distinct window; an item of fewer words is one window."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = items.select("item", "w", n.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    gram = F.array_join(F.slice("w", F.col("at") + 1, F.col("length")), " ")
    grams = starts.select("item", "length", gram.alias("gram")).groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    words = F.split("gram", " ")
    h = reduce(lambda rest, k: F.when(F.col("length") == k, _gram_hash(words, F.lit(0), k)).otherwise(rest), range(1, window), _gram_hash(words, F.lit(0), window))
    return grams.withColumn("h", h)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``id_col``, n_words, n_hit, items (whose windows occur, sorted as strings) and hits (sorted starts and ends, in words).

    Null texts and texts without words give 0, 0 and empty arrays; null and wordless items are never found. Rows of one id
    are taken for one document with one text, so repeated rows give equal rows. Null ids are no document's id: such rows get
    their counts of words and no hits. Empty tables of either kind are fine.
    """
    spark = docs.sparkSession
    kept = Stored(spark, "decontamination")
    grams = kept.write(benchmark_windows(benchmark, item_col, bench_text_col, window), "windows")
    size = {r["length"]: r["n"] for r in grams.groupBy("length").agg(F.sum(F.octet_length("gram") + ROW_BYTES).alias("n")).collect()}  # at most ``window`` rows
    small = sum(size.values()) <= max_broadcast_bytes
    probe = grams.select("length", "h", "gram", F.monotonically_increasing_id().alias("g"))
    probe = kept.write(probe.join(grams.select("length", "gram", "items"), ["length", "gram"]), "set")
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    found = None
    for length in sorted(size):  # one length unless items are shorter than the window
        # An outer explode, as a plain one makes the optimizer cut the text again to test for words.
        at = F.explode_outer(F.when(F.size("w") >= length, F.sequence(F.lit(0), F.size("w") - length)))
        starts = rows.where("id IS NOT NULL").select("id", "w", at.alias("at")).where("at IS NOT NULL")
        side = probe.where(F.col("length") == length).select("h", "gram", "g")
        here = F.concat_ws(" ", *_at(F.col("w"), F.col("at"), length))
        verified = F.coalesce(here == F.col("gram"), F.lit(False))  # no key of the join, so that only hits' words are put together
        if small:
            part = starts.withColumn("h", _gram_hash(F.col("w"), F.col("at"), length)).join(F.broadcast(side), "h").where(verified)
        else:
            hit = starts.select("id", "at", _gram_hash(F.col("w"), F.col("at"), length).alias("h")).join(side.hint("merge"), "h")
            hit = kept.write(hit.select("id", "at", "gram", "g"), "to-verify")
            part = rows.join(hit, "id").where(verified)
        part = part.select("id", "at", (F.col("at") + length).alias("end"), "g")
        found = part if found is None else found.unionByName(part)
    counted = docs.select(F.col(id_col).alias("id"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    if found is None:
        none = "CAST(array() AS array<struct<at:int,end:int>>)"
        return counted.select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.expr("CAST(array() AS array<string>)").alias("items"), F.expr(none).alias("hits"))
    hits = kept.write(found, "hits")
    # A document's hits number at most its words; their union is a fold over the starts in order.
    spans = hits.groupBy("id", "at").agg(F.max("end").alias("end")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("hits"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], a["upto"]))).cast("long").alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
        lambda a: a["n"],
    )
    items = hits.select("id", "g").distinct().join(probe.select("g", "items"), "g").select("id", F.explode("items").alias("item")).distinct()
    items = items.groupBy("id").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    by_doc = spans.select("id", "hits", covered.alias("n_hit")).join(items, "id", "left")
    out = counted.join(by_doc, "id", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"), F.coalesce("hits", F.expr("CAST(array() AS array<struct<at:int,end:int>>)")).alias("hits"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Documents that hold no window of the benchmark; all columns, rows as they were. Null ids stay."""
    bad = contamination(docs, benchmark, id_col, **how).where("n_hit > 0").select(id_col)
    return docs.join(bad, id_col, "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All documents, with hit words (as lowered for matching) left out of contaminated texts, whose other words are space-joined."""
    name = fresh(docs, "hits")
    hit = contamination(docs, benchmark, id_col, text_col, **how).where("n_hit > 0").select(F.col(id_col), F.col("hits").alias(name)).dropDuplicates([id_col])
    words = words_of(F.col(text_col))
    keep = F.filter(words, lambda w, i: ~F.exists(name, lambda s: (s["at"] <= i) & (i < s["end"])))
    rest = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(F.array_join(keep, " "))
    return docs.join(hit, id_col, "left").withColumn(text_col, rest).drop(name)
