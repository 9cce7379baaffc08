"""Job progress as a keyed stream: each job's state is kept with an expiry, and a timer fails a job that stands still.

The rules are those of the batch forms (`records.progress`, `dml.watchdog`). Needs the RocksDB state store, which
`with_state_store` sets; timers run in processing time, so a job fails while its stream is idle too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UPDATES = "job string, status string, stage string, done long, total long"
OUT = "job string, status string, stage string, progress int, timed_out boolean"
STATE = "status string, stage string, done long, total long, at long"
#: Working statuses, and what a job that stands still in one becomes.
STUCK = {"pending": "failed", "processing": "failed", "deleting": "failed_delete"}


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class JobProcessor(StatefulProcessor):
    """One row for each update and for each job that times out. An update without a status, stage or count keeps the one before."""

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE, self.keep_ms)

    def _row(self, key, status, stage, done, total, timed_out) -> tuple:
        share = 100 if status == "completed" else min(99, int(100 * (done or 0) / total)) if total else 0
        return (key[0], status, stage, share, timed_out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, stage, done, total, _ = self.state.get() if self.state.exists() else ("pending", None, None, None, 0)
        out = []
        for f in rows:
            for r in f.itertuples():
                known = lambda new, old: old if new is None or new != new else new
                status, stage = known(r.status, status), known(r.stage, stage)
                done, total = known(r.done, done), known(r.total, total)
                out.append(self._row(key, status, stage, done, total, False))
        now = timerValues.getCurrentProcessingTimeInMs()
        self.state.update((status, stage, None if done is None else int(done), None if total is None else int(total), now))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if status in STUCK:
            self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(out, columns=["job", "status", "stage", "progress", "timed_out"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, stage, done, total, at = self.state.get()
            if status in STUCK:
                self.state.update((STUCK[status], stage, done, total, at))
                yield pd.DataFrame([self._row(key, STUCK[status], stage, done, total, True)], columns=["job", "status", "stage", "progress", "timed_out"])

    def close(self) -> None:
        pass


def job_states(updates: DataFrame, idle_minutes: float = 15, keep_hours: float = 24) -> DataFrame:
    """job, status, stage, progress (0-100), timed_out of a stream of updates (columns of UPDATES)."""
    processor = JobProcessor(int(idle_minutes * 60_000), int(keep_hours * 3_600_000))
    return updates.groupBy("job").transformWithStateInPandas(processor, OUT, "update", "processingTime")


def joined_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Two streams joined where right comes up to `minutes` after left. Rows behind a watermark are dropped (and counted in the
    query's progress), and state that no row can meet any more is let go."""
    from pyspark.sql import functions as F

    a, b = left.withWatermark(left_ts, late).alias("a"), right.withWatermark(right_ts, late).alias("b")
    near = F.expr(f"b.{right_ts} >= a.{left_ts} AND b.{right_ts} <= a.{left_ts} + INTERVAL {minutes} MINUTES")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near)
