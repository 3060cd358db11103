"""Exports of the log: CSV, JSON, a file for each contact, summaries, sizes, and a delivery log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIVATE = "Private"
COLUMNS = ["id", "ts", "type", "direction", "number", "contact_id", "duration", "content", "source", "owner_id", "visibility"]


def export_frame(events: DataFrame) -> DataFrame:
    """The 11 columns of an export, as text; numbers and content of private rows read "Private"."""
    private = F.col("visibility") == "private"
    hide = lambda c: F.when(private, PRIVATE).otherwise(F.col(c).cast("string"))
    shown: dict[str, Column] = {c: F.col(c).cast("string") for c in COLUMNS} | {"number": hide("number"), "content": hide("content")}
    return events.select(*(shown[c].alias(c) for c in COLUMNS))


def export_csv(events: DataFrame, path: str) -> None:
    export_frame(events).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def export_json(events: DataFrame, path: str) -> None:
    export_frame(events).write.mode("overwrite").json(path)


def export_by_contact(events: DataFrame, path: str, files: int = 64) -> None:
    """A folder for each contact. Rows are dealt by contact and a salt, so that one contact's rows don't meet in one task."""
    e = export_frame(events).withColumn("contact", F.coalesce("contact_id", F.lit("unknown")))
    e.repartition(files, "contact", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("contact").option("header", True).csv(path)


def export_summary(events: DataFrame) -> DataFrame:
    """Name and value of the totals of an export."""
    e = events.agg(F.count("*").alias("events"), F.count(F.when(F.col("type") == "call", 1)).alias("calls"), F.count(F.when(F.col("type") == "sms", 1)).alias("sms"), F.countDistinct("contact_id").alias("contacts"), F.coalesce(F.sum(F.col("duration").cast("bigint")), F.lit(0).cast("bigint")).alias("call_seconds"))
    return e.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in e.columns))).alias("x")).select("x.*")


def contact_counts(events: DataFrame, n: int = 20) -> DataFrame:
    return events.where("contact_id IS NOT NULL").groupBy("contact_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "contact_id").limit(n)


def export_size(events: DataFrame) -> DataFrame:
    """Characters of the JSON export, rows, and mean characters of a row."""
    e = export_frame(events)
    size = F.char_length(F.to_json(F.struct(*COLUMNS)))
    return e.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("chars"), F.count("*").alias("events"))


def delivery_log(batch: DataFrame, batch_id: int, path: str) -> None:
    """For ``foreachBatch``: appends a batch's deliveries once; a batch that runs again replaces its own folder."""
    batch.withColumn("delivered", F.lit(True)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
