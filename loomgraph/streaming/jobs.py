"""The same behaviours as Structured Streaming queries. Event times are cast to timestamps, which watermarks need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of event files as they come."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def daily_quota(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("used"))


def rate_limits(stream: DataFrame, seconds: int = 60, limit: int = 5) -> DataFrame:
    """user_id, event_id, limited; the times within the window are each key's state, dropped when idle."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            times = [t for t in times if t > at - seconds]
            out.append((key[0], event_id, len(times) >= limit))
            times.append(float(at))
        state.update((times,))
        state.setTimeoutDuration((seconds + 5) * 1000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "limited"])

    keyed = stream.select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, limited boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_into(path: str, key: str, order: list[str]):
    """foreachBatch function that keeps the last row of each key in a table below path.

    A key whose last row is a deletion has no row in `latest`; the row itself stays as a tombstone, so that
    older rows which come late don't bring the key back. A batch only writes its own last rows, in a folder
    of its epoch; a batch that is run again overwrites its folder, so the table is the same.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def latest(spark: SparkSession, path: str, key: str, order: list[str], deleted: str = "status = 'deleted'") -> DataFrame:
    """The last row of each key over all batches that `latest_into` has written, without those for which `deleted` holds."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order, "epoch")).alias("r")).select("r.*")
    return last.where(~F.coalesce(F.expr(deleted), F.lit(False))).drop("epoch")


def compact(spark: SparkSession, path: str, key: str, order: list[str], to: str) -> None:
    """The epochs of path as one table below another folder, tombstones included; for tables of many batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order, "epoch")).alias("r")).select("r.*")
    last.drop("epoch").write.mode("overwrite").parquet(f"{to}/epoch={rows.agg(F.max('epoch')).first()[0] or 0}")
