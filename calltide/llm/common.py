"""What the corpus operators share: reading tables, the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the columns of ``documents``; every pipeline stage but the last returns these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space as the contracts define it: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary one, but for a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="calltide-"))


class Stored:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those that nothing reads any more, ``close`` all.

    Results are lazy and may still read what is left, in ``root``; close once they have been written.

    A lost executor costs a re-read of files that all executors share, never a recomputation from the source.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", 0
        self.known: set[str] = set()

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._stored_at = at
        return out

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
        """A table in the shared folder whose buckets, by ``keys``, are sorted by them; ``drop`` takes it out of the catalog again."""
        at, known_as = self.path(name), f"calltide_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", at).option("compression", "zstd").format("parquet").saveAsTable(known_as)
        out = self.spark.table(known_as)
        out._stored_at, out._known_as = at, known_as
        self.known.add(known_as)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if hasattr(t, "_known_as"):
                self.spark.sql(f"DROP TABLE IF EXISTS {t._known_as}")
                self.known.discard(t._known_as)
            self.remove(t._stored_at)

    def close(self) -> None:
        for name in self.known:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.remove(self.root)

    def remove(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else; texts without other characters take the plain lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def text_or_empty(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
