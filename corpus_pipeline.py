"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing; each stage works on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.llm import decontamination, line_dedup, packing, queries, simhash, toxicity
from calltide.llm.common import DOCUMENT_COLUMNS, Stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; the model learns from the labelled rows of its input that aren't held out."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    model = toxicity.train(rows, table(spark, sf_dir, "labels").where(~queries.held_out()))
    return toxicity.score(rows, model).where("toxicity < 0.5").drop("toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a smaller document holds."""
    out = line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates."""
    return simhash.one_of_each(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontamination.clean_documents(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: Stages 1, 3 and 5 (a trained model, reachability over near fingerprints, a library's tokens and a search) can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), Stored(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
