"""Line deduplication with levelled sorted runs of line hashes.

Native: DataFrame functions only. Documents come in batches of ascending ids. A batch's line hashes are merge-anti-joined with
the runs of all earlier batches: what a run holds has been seen in a smaller document. Hashes new to the runs become a sorted
run of level 0; when a level has ``fan_in`` runs they're compacted into one of the next level, so a batch meets a logarithmic
number of runs. Runs are tables in the shared folder, bucketed by hash and sorted in each bucket: joins with them and their
compaction neither shuffle nor sort them again.

A hash is two 64-bit numbers, 128 bits in all. Texts are read once for hashes, which are stored by batch, and shuffled once, to
drop lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from calltide.llm.common import BLANKS, Stored, ascii_lower, fresh

MIN_CHARS, FAN_IN = 10, 2
#: Batches: so many at least, and one for so many rows.
BATCHES, BATCH_ROWS = 4, 100_000_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Lets Spark rely on the order in buckets of one file, as runs have them."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Runs:
    """Levels of sorted runs: (h1, h2, first: the smallest document), each hash in one run only; ``buckets`` as shuffles have partitions."""

    def __init__(self, kept: Stored, fan_in: int):
        self.kept, self.fan_in, self.levels = kept, fan_in, []
        self.buckets = int(kept.spark.conf.get("spark.sql.shuffle.partitions"))

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Hashes that no run holds: a merge join with one run after the other."""
        for run in self.all():
            hashes = hashes.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, hashes: DataFrame, level: int = 0) -> DataFrame:
        """Takes hashes as a run and gives that run; compaction of its level is left to :meth:`compact`."""
        while len(self.levels) <= level:
            self.levels.append([])
        run = self.kept.write_bucketed(hashes, f"run-{level}", self.buckets, "h1", "h2")
        self.levels[level].append(run)
        return run

    def compact(self) -> None:
        """Merges the runs of each level that has ``fan_in`` of them, bucket by bucket: runs share no hash, so a full join is their union."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan_in:
                merged, self.levels[level] = self.levels[level], []
                whole = merged[0].select("h1", "h2", "first")
                for other in merged[1:]:
                    whole = whole.join(other.select("h1", "h2", F.col("first").alias("other")).hint("merge"), ["h1", "h2"], "full")
                    whole = whole.select("h1", "h2", F.coalesce("first", "other").alias("first"))
                self.add(whole, level + 1)
                self.kept.drop(*merged)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """Lines to drop: id and places (ascending, from 0) for each document that has any; see :func:`dedup_lines`."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is no column of whole numbers")
    kept = Stored(spark, "line-dedup")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    batches = max(batches, -(-rows.count() // BATCH_ROWS))
    cuts = rows.approxQuantile("id", [i / batches for i in range(1, batches)], min(0.01, 0.25 / batches)) if batches > 1 else []
    edges = sorted({int(c) for c in cuts})
    lines = rows.select("id", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).select("id", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("id", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    # A document's lines of one hash become one row before anything is shuffled by the hash.
    lines = lines.groupBy("id", "h1", "h2").agg(F.collect_list("at").alias("at"))
    batch = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("id"))) if edges else F.lit(0)
    schema = "id bigint, h1 bigint, h2 bigint, at array<int>, batch int"
    at = kept.path("lines")
    lines.withColumn("batch", batch).write.option("compression", "zstd").partitionBy("batch").parquet(at)
    stored = spark.read.schema(schema).option("basePath", at).parquet(at)
    runs, drops = Runs(kept, fan_in), None
    with sorted_buckets(spark):
        for k in range(len(edges) + 1):
            lines = stored.where(F.col("batch") == k).drop("batch")
            first = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"))
            run = runs.add(runs.unseen(first))
            # Read as a plain table, so that lines of a very common hash can be split in the join.
            new = spark.read.schema("h1 bigint, h2 bigint, first bigint").parquet(run._stored_at)
            own = lines.join(new, ["h1", "h2"], "left")  # a hash that isn't new has been seen in an earlier batch
            part = kept.write(own.where("first IS NULL OR id > first").select("id", "at"), "again")
            drops = part if drops is None else drops.unionByName(part)
            if k < len(edges):  # no batch meets the runs after the last one
                runs.compact()
    kept.drop(*runs.all())
    return drops.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("drop"))  # no more than a document's lines


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """All columns of ``docs``, with repeated lines taken out of the text, and n_lines (before) and n_dropped.

    A line's key is the line without blanks at both ends and with A-Z lowered. Keys of ``min_chars`` code points or more that
    stand in two documents or more keep their lines (all of them) in the document with the smallest id only. Null and empty
    texts have one empty line; a null text becomes empty. Rows of one id are one document. Rows with a null id, and lines with
    short keys, stay as they are. Ids are whole numbers (a TypeError else). Columns named n_lines, n_dropped are replaced; all
    others stay, whatever they're called. ``batches`` is the least number of batches (see ``BATCH_ROWS``).
    """
    drop = fresh(docs, "drop")
    drops = repeated_lines(docs, id_col, text_col, min_chars, batches, fan_in).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("drop").alias(drop))
    out = docs.drop("n_lines", "n_dropped").join(drops, id_col, "left")
    lines = lines_of(F.col(text_col))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i))
    text = F.when(F.col(drop).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(left, "\n"))
    return out.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )
