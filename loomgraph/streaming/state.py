"""Stateful behaviours over event tables: as windows for batches, and as folds where order decides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """before: requests of the key in the seconds up to each request, rejected ones too; limited: before >= limit."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    # requests of one instant count each other in order of their ids
    tie = Window.partitionBy(key, "_us").orderBy("event_id")
    same = Window.partitionBy(key, "_us")
    x = events.withColumn("_us", micros).withColumn("_all", F.count("*").over(w))
    return x.withColumn("before", F.col("_all") - F.count("*").over(same) + F.row_number().over(tie) - 1).withColumn("limited", F.col("before") >= limit).drop("_us", "_all")


def daily_quota(events: DataFrame, ts: str, quota: int = 50) -> DataFrame:
    """day, used, healthy by UTC day."""
    return events.groupBy(F.date_format(F.date_trunc("day", F.col(ts)), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("used")).withColumn("healthy", F.col("used") < quota)


def latest_status(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The last value of each key, ties by event_id; an aggregate, so no sort of a hot key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, "event_id")).alias("last"), F.max(ts).alias("at"))


def windows(events: DataFrame, ts: str, length: str, slide: str | None = None) -> DataFrame:
    """start (ISO), event_type, n, total of tumbling or sliding windows."""
    w = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, stop (last event plus gap), n of runs of events without a gap."""
    return events.groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), F.date_format("w.end", "yyyy-MM-dd'T'HH:mm:ss").alias("stop"), "n")


class Breaker:
    """Closed, open after `most` failures in a row, half-open after `rest` seconds, closed again after successes.

    The count of successes is shared with the closed state: neither opening nor probing resets it, only closing does.
    """

    def __init__(self, most: int = 5, rest: float = 30.0, probes: int = 3):
        self.most, self.rest, self.probes = most, rest, probes
        self.state, self.failures, self.successes, self.since = "CLOSED", 0, 0, 0.0

    def step(self, at: float, ok: bool) -> str:
        if self.state == "OPEN" and at - self.since >= self.rest:
            self.state = "HALF_OPEN"
        if self.state == "OPEN":
            return self.state
        if ok:
            self.failures = 0
            self.successes += 1
            if self.state == "HALF_OPEN" and self.successes >= self.probes:
                self.state, self.successes = "CLOSED", 0
        else:
            self.failures += 1
            if self.state == "HALF_OPEN" or self.failures >= self.most:
                self.state, self.since, self.failures = "OPEN", at, 0
        return self.state


def circuit_breaker(events: DataFrame, key: str, ts: str, failed: str, most: int = 5, rest: float = 30.0) -> DataFrame:
    """key, event_id, state after each event of a dependency, in order of time. One key's events are one fold."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["at", "event_id"], ignore_index=True)
        b = Breaker(most, rest)
        return pd.DataFrame({key: f[key], "event_id": f["event_id"], "state": [b.step(a, not bad) for a, bad in zip(f["at"], f["bad"], strict=True)]})

    x = events.select(key, "event_id", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), F.expr(failed).alias("bad"))
    return x.groupBy(key).applyInPandas(run, f"{key} long, event_id long, state string")
