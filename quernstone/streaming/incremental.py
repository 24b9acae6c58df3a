"""Structured Streaming forms of the periodic and stateful jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.functions import fixed
from quernstone.functions import text as T
from quernstone.operators import curation as K


def ingest_stream(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: str = "source", config_hash: str = ""):
    """Runs all new JSON files of a folder into a table at ``target``, newest text of a
    source winning, and stops. Run again, it takes what has come since. A row without a
    text deletes its source; rows are marked with the configuration they were made under."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("content_hash", T.content_hash("text")).withColumn("batch", F.lit(number).cast("long"))
        rows = rows.withColumn("config_hash", F.lit(config_hash))
        rows = rows.groupBy(key).agg(F.max_by(F.struct("text", "content_hash", "batch", "config_hash"), "ts").alias("r")).select(key, "r.*")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "source", config_hash: str = "") -> DataFrame:
    """The current row of each source over all batches of this configuration, deleted
    sources left out."""
    rows = spark.read.parquet(target).where(F.col("config_hash") == config_hash)
    rows = rows.groupBy(key).agg(F.max_by(F.struct("text", "content_hash"), "batch").alias("r")).select(key, "r.*")
    return rows.where("text IS NOT NULL")


def changed_sources(rows: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to ingest, sources that went): what differs from a manifest (source,
    content_hash), so that a run takes up only what is new or changed."""
    now = rows.withColumn("content_hash", T.content_hash("text"))
    same = manifest.select("source", F.col("content_hash"))
    return now.join(same, ["source", "content_hash"], "left_anti"), manifest.select("source").join(rows.select("source"), "source", "left_anti")


def janitor_cycle(rows: DataFrame, manifest: DataFrame, web: DataFrame, training: DataFrame, lessons: DataFrame, now: Column, position: str = "pos") -> dict[str, DataFrame]:
    """One round of upkeep: what to ingest and what went, web rows still fresh, training
    rows kept, lessons due for review. ``now`` and times are Unix seconds."""
    fresh, gone = changed_sources(rows, manifest)
    old = K.outdated_web(web, now, fixed.JANITOR_WEB_DAYS).select("source")
    return {
        "ingest": fresh, "gone": gone, "web": web.join(old, "source", "left_anti"),
        "training": K.keep_last_rows(training, position, fixed.JANITOR_KEEP_ROWS),
        "review": lessons.where(F.col("reviewed") <= now - fixed.JANITOR_REVIEW_DAYS * 86_400),
    }


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls and mean value of each event type by time window; later events are dropped."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("w.start", "event_type", "n", "mean")


GUARD = "user_id long, ts timestamp, event_type string, at long, blocked boolean"


def guard_stream(calls: DataFrame, n: int = 5) -> DataFrame:
    """Loop guard over a stream (user_id, ts, event_type): the state of a session is the
    last call and how often it came in a row."""
    n = min(20, max(2, n))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for ts, kind in zip(rows["ts"], rows["event_type"], strict=True):
            at = at + 1 if kind == last else 1
            last = kind
            out.append((key[0], ts, kind, at, at % n == 0))
        state.update((last, at))
        yield pd.DataFrame(out, columns=["user_id", "ts", "event_type", "at", "blocked"])

    return calls.groupBy("user_id").applyInPandasWithState(fold, GUARD, "last string, at long", "append", GroupStateTimeout.NoTimeout)


def first_of_log(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark; older repeats need the exact merge."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def log_merge(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str):
    """Keeps the first row of each key of an endless log, exactly: a batch adds the rows
    whose keys no earlier batch has."""

    def merge(batch: DataFrame, number: int) -> None:
        one = K.keep_one(batch, keys, [order])
        try:
            seen = spark.read.parquet(target).where(F.col("batch") < number).select(*keys)
            one = one.join(seen, keys, "left_anti")
        except AnalysisException:
            pass  # the first batch
        one.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks dropped into a folder as JSON files; the payload stays JSON."""
    schema = "id string, type string, payload string, created_at timestamp, priority int"
    return spark.readStream.schema(schema).json(folder)
