"""State of agent loops kept across calls, and a cache kept across batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quernstone.operators import curation as K

CALL = "user_id long, event_id long, ts timestamp, tool string, args string, failed boolean, score double"
LOOP = "user_id long, event_id long, iteration long, best double, stagnation long, failures long, dead_end boolean, status string, halted_at long"


class LoopProcessor(StatefulProcessor):
    """The loop of one user: best score and how long nothing has beaten it, failures of each
    tool with the same arguments since it last succeeded, and the first iteration at which
    the loop had an end. With ``idle_ms``, a loop without calls for so long is stopped: its
    state goes, and the next call starts another one."""

    def __init__(self, epsilon: float = 1e-6, converged: float = 0.95, patience: int = 3, most: int = 20, dead: int = 2, idle_ms: int | None = None):
        self.epsilon, self.converged, self.patience, self.most, self.dead, self.idle_ms = epsilon, converged, patience, most, dead, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loop = handle.getValueState("loop", "iteration long, best double, stagnation long, halted long")
        self.failures = handle.getMapState("failures", "tool string, args string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        iteration, best, stagnation, halted = self.loop.get() if self.loop.exists() else (0, 0.0, 0, 0)
        # a batch's rows of one user come in any order
        calls = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        counts = {k: v[0] for k, v in self.failures.iterator()}
        out = []
        for r in calls.itertuples():
            iteration += 1
            better = r.score > best + self.epsilon
            best, stagnation = max(best, r.score), 0 if better else stagnation + 1
            place = (r.tool, r.args)
            if r.failed:
                counts[place] = counts.get(place, 0) + 1
            else:  # a success clears what the tool has failed at
                for other in [k for k in counts if k[0] == r.tool]:
                    del counts[other]
            failed = counts.get(place, 0)
            status = "converged" if best >= self.converged else "stagnated" if stagnation >= self.patience else "halted" if iteration >= self.most else "running"
            halted = halted or (iteration if status != "running" else 0)
            out.append((key[0], r.event_id, iteration, best, stagnation, failed, bool(r.failed and failed >= self.dead), status, halted or None))
        self.loop.update((iteration, float(best), stagnation, halted))
        self.failures.clear()
        for place, n in counts.items():
            self.failures.updateValue(place, (n,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOOP.split(", ")]).astype({"halted_at": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        iteration, best, stagnation, halted = self.loop.get()
        self.loop.clear()
        self.failures.clear()
        yield pd.DataFrame([(key[0], None, iteration, best, stagnation, 0, False, "stopped", halted or None)], columns=[c.split()[0] for c in LOOP.split(", ")]).astype({"halted_at": "Int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in the store that has maps and timers."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def loop_stream(calls: DataFrame, **limits) -> DataFrame:
    """The loop's state after each call of a stream (``CALL``). A user's calls have to come
    in the order of their times, batch after batch. With ``idle_ms`` the stream has to run
    on, as it waits for timers."""
    mode = "None" if limits.get("idle_ms") is None else "ProcessingTime"
    return calls.groupBy("user_id").transformWithStateInPandas(LoopProcessor(**limits), outputStructType=LOOP, outputMode="append", timeMode=mode)


def cache_stream(spark: SparkSession, entries: DataFrame, target: str, checkpoint: str, most: int, ttl_s: int, created: str = "created_at", key: str = "id"):
    """Keeps the newest ``most`` entries of a stream that are no older than ``ttl_s`` before
    its newest one. The cache is bounded, so each batch writes it anew and leaves the one
    before it to readers; a batch that runs again writes the same."""

    def merge(batch: DataFrame, number: int) -> None:
        held = batch
        with contextlib.suppress(AnalysisException):  # the first batch
            held = batch.unionByName(cached(spark, target, number))
        newest = held.agg(F.max(created)).first()[0]
        if newest is not None:
            held = K.pruned_cache(held, most, F.lit(newest) - F.expr(f"INTERVAL {ttl_s} SECONDS"), created, key)
        held.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The cache as of the last batch, or of the last one before a number."""
    rows = spark.read.parquet(target)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")
