"""Streaming: deduplication within a watermark, upserting sinks, windowed detectors, anchors with state, dead letters, policies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from calltide.operators.ingest import merge_insert, normalize_records, split_valid, validate

KEYS = ["owner_id", "line_id", "ts", "number", "direction", "duration"]


def deduplicated(events: DataFrame, keys: list[str] = KEYS, delay: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its copies come within the watermark's delay; state older than that is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def failed_logins(audit: DataFrame, window: str = "15 minutes", slide: str = "5 minutes", least: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Addresses with ``least`` failed logins or more in a sliding window."""
    bad = audit.where((F.col("category") == "authentication") & (F.col("outcome") == "failure")).withWatermark("ts", delay)
    counts = bad.groupBy(F.window("ts", window, slide), "ip_address").agg(F.count("*").alias("failures"))
    return counts.where(F.col("failures") >= least).select("ip_address", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "failures")


def volume(audit: DataFrame, window: str = "60 minutes", more_than: int = 100, delay: str = "10 minutes") -> DataFrame:
    counts = audit.withWatermark("ts", delay).groupBy(F.window("ts", window), "actor_id").agg(F.count("*").alias("entries"))
    return counts.where(F.col("entries") > more_than).select("actor_id", F.col("window.start").alias("start"), "entries")


class Anchors(StatefulProcessor):
    """The anchor clustering of one key with state: an event over ``tolerance`` seconds after the anchor becomes the next one.

    State is one pair (time, id) for each key. Within a batch a key's rows are put in order of time.
    """

    def __init__(self, tolerance: int):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("anchor", "at bigint, id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        at, anchor = (held[0], held[1]) if held else (None, None)
        frame = pd.concat(list(rows)).sort_values(["t", "id"])
        out = []
        for t, i in zip(frame["t"].tolist(), frame["id"].tolist(), strict=True):
            if at is None or t - at > self.tolerance:
                at, anchor = t, i
            out.append((i, anchor))
        self.state.update((at, anchor))
        yield pd.DataFrame(out, columns=["id", "anchor"])

    def close(self) -> None: ...


def anchored(events: DataFrame, tolerance: int = 300, keys: tuple[str, ...] = ("owner_id", "number", "type", "direction")) -> DataFrame:
    e = events.select(*keys, "id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return e.groupBy(*keys).transformWithStateInPandas(Anchors(tolerance), "id bigint, anchor bigint", "Append", "none")


def upsert_sink(path: str, keys: list[str], values: list[str]):
    """For ``foreachBatch``: merges a batch into the table at ``path``, by versions: a batch that runs again writes the same version.

    Version n is the table after batch n; readers take the highest version (see :func:`current`).
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/version={batch_id - 1}") if batch_id else batch.limit(0).select(*keys, *values)
        merge_insert(before, batch, keys, values).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return sink


def current(spark, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("version").alias("v")).first()["v"]
    return spark.read.parquet(f"{path}/version={last}")


def with_dead_letters(good: str, bad: str):
    """For ``foreachBatch``: normalised valid records to one folder, rejected ones with their errors to another."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        records = validate(normalize_records(batch)).persist()
        valid, rejected = split_valid(records)
        valid.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        records.unpersist()

    return sink


class Progress(StreamingQueryListener):
    """Keeps the last progress of each query: batch, rows, rows a second."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.last[p.name or str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond}

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def backoff_seconds(attempts: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Exponential: base x 2^attempts, at most ``most``; jitter is left to the caller, so that results can be repeated."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempts))


def next_attempts(items: DataFrame, now_s: int, most_attempts: int = 5, expire_s: int = 7 * 86_400) -> DataFrame:
    """What becomes of failed queue items: retry at a time, expired after a week, or dead after the last attempt."""
    state = F.when(F.lit(now_s) - F.col("created") > expire_s, "expired").when(F.col("attempts") >= most_attempts, "dead").otherwise("retry")
    return items.select("id", state.alias("state"), F.when(state == "retry", F.col("failed") + backoff_seconds(F.col("attempts")).cast("bigint")).alias("retry_at"))


#: Files a trigger takes by the quality of the network, for maxFilesPerTrigger.
BATCH_FILES = {"excellent": 100, "good": 50, "fair": 20, "poor": 5, "none": 1}
