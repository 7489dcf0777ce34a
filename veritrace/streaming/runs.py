"""Streams: state of runs, progress, guardrails, verdicts under a deadline, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veritrace.functions import columns as C
from veritrace.functions import fixed

#: The store that keeps entries, timers and expiry apart; sessions of timed streams name it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_state(updates: DataFrame) -> DataFrame:
    """The last value of each (run_id, key) of a changelog (run_id, key, value, seq); for update mode, or over a batch."""
    return updates.groupBy("run_id", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def progress(updates: DataFrame) -> DataFrame:
    """(run_id, pct): the furthest stage that a run (run_id, node) has come to; it never falls back."""
    pct = C.lookup("node", {n: p for n, _, p in fixed.STAGES}, 0)
    return updates.groupBy("run_id").agg(F.max(pct).alias("pct"))


def spending(calls: DataFrame) -> DataFrame:
    """(run_id, calls, cost, halted) so far."""
    out = calls.groupBy("run_id").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))
    return out.withColumn("halted", C.guardrail_exceeded("calls", "cost", F.lit(0.0)))


def _needs_timers(spark) -> None:
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"state with timers needs spark.sql.streaming.stateStore.providerClass={STATE_STORE}")


class _Review(StatefulProcessor):
    """A run's verdicts: an entry for each signal asked about, and a timer at the deadline."""

    def __init__(self, seconds: int, keep_partial: bool):
        self.seconds, self.keep_partial = seconds, keep_partial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at long")
        self.asked = handle.getMapState("asked", "id string", "verdict string")

    def _told(self, key: tuple, status: str, asked: int, given: dict) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "n_asked": [asked], "n_given": [len(given)], "verdicts": [",".join(f"{k}={v}" for k, v in sorted(given.items()))]})

    def _end(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.deadline.clear()
        self.asked.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if not self.deadline.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.seconds * 1000
            self.deadline.update((at,))
            self.handle.registerTimer(at)
        rows = pd.concat(list(rows)).sort_values("kind", kind="stable")  # what is asked stands before verdicts of the same batch
        for r in rows.itertuples():
            if r.id is None or pd.isna(r.id):
                continue
            if r.kind == "ask":
                if not self.asked.containsKey((r.id,)):
                    self.asked.updateValue((r.id,), ("",))
            elif self.asked.containsKey((r.id,)) and (v := fixed.VERDICTS.get(str(r.verdict).strip().lower())):
                self.asked.updateValue((r.id,), (v,))
        held = {k[0]: v[0] for k, v in self.asked.iterator()}
        given = {k: v for k, v in held.items() if v}
        whole = bool(held) and len(given) == len(held)
        if whole:
            self._end()
        yield self._told(key, "complete" if whole else "reviewing", len(held), given)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.asked.iterator()}
        given = {k: v for k, v in held.items() if v}
        self._end()
        yield self._told(key, "timed_out", len(held), given if self.keep_partial else {})

    def close(self) -> None:
        pass


def collect_verdicts(rows: DataFrame, seconds: int, keep_partial: bool = True) -> DataFrame:
    """(run_id, status, n_asked, n_given, verdicts) for each change of a review.

    rows (run_id, kind, id, verdict), kind ask or verdict; rows without an id say nothing. Verdicts for
    what was not asked are refused. A review is complete when all are in, and timed out so many seconds
    after it began, whatever came in between; then partial verdicts are kept or dropped. State and
    timers are in the state store, so a query that starts again keeps both;
    its timers count from its first batch, for which it waits.
    """
    _needs_timers(rows.sparkSession)
    told = "run_id string, status string, n_asked long, n_given long, verdicts string"
    return rows.groupBy("run_id").transformWithStateInPandas(_Review(seconds, keep_partial), told, "Update", "ProcessingTime")


class _Cache(StatefulProcessor):
    """The last document of a key, which the state store forgets after its time."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "json_blob string", ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.kind == "set":
                self.held.update((r.json_blob,))
            else:
                hit = self.held.get() if self.held.exists() else None
                out.append((key[0], r.seq, hit is not None, hit[0] if hit else None))
        yield pd.DataFrame(out, columns=["cache_key", "seq", "hit", "json_blob"]).astype({"seq": "int64", "hit": "bool", "json_blob": "object"})

    def close(self) -> None:
        pass


def cache_lookups(rows: DataFrame, seconds: int) -> DataFrame:
    """(cache_key, seq, hit, json_blob) for each row of kind get: what the last row of kind set has put there, if not longer ago than that.

    rows (cache_key, seq, kind, json_blob), in order of seq within a batch. The state store drops what is too old.
    """
    _needs_timers(rows.sparkSession)
    return rows.groupBy("cache_key").transformWithStateInPandas(_Cache(seconds), "cache_key string, seq long, hit boolean, json_blob string", "Update", "ProcessingTime")


def windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(start, end, *by, n, total) of event-time windows; rows later than the watermark are dropped by a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """(start, end, by, n, total): runs of a user's events with no gap that long."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def fan_out(stream: DataFrame, sinks: list, checkpoint: str):
    """Write each batch to every sink, a function of (DataFrame, batch number); the batch is read once."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
