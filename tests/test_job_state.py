"""Streams with state: job progress with timers, and a join of two streams with late rows."""

import time

from pyspark.sql import functions as F

from loomgraph.streaming import job_state


def test_jobs_progress_and_time_out(spark, tmp_path):
    job_state.with_state_store(spark)
    folder = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, job_state.UPDATES).coalesce(1).write.mode("append").parquet(folder)
    put([("a", "processing", "parse", 0, 10), ("b", "processing", "parse", 1, 4), ("c", "deleting", None, None, None)])
    updates = spark.readStream.schema(job_state.UPDATES).parquet(folder)
    out = job_state.job_states(updates, idle_minutes=0.15)
    q = out.writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        rows = lambda: {(r.job, r.status, r.progress, r.timed_out) for r in spark.sql("SELECT * FROM job_states").collect()}
        until = time.time() + 60
        while len(rows()) < 3 and time.time() < until:
            time.sleep(0.5)
        put([("a", "completed", "done", None, None)])
        while not {r[0] for r in rows() if r[3]} >= {"b", "c"} and time.time() < until:
            time.sleep(0.5)
        assert q.exception() is None
        assert rows() == {("a", "processing", 0, False), ("b", "processing", 25, False), ("c", "deleting", 0, False), ("a", "completed", 100, False), ("b", "failed", 25, True), ("c", "failed_delete", 0, True)}
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_join_of_streams_drops_late_rows(spark, tmp_path):
    schema = "k long, at timestamp"

    def put(side, rows):
        spark.createDataFrame([(k, t) for k, t in rows], "k long, t string").select("k", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / side))

    put("l", [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:00:00")])
    put("r", [(1, "2024-01-01 10:05:00"), (2, "2024-01-01 10:30:00")])
    read = lambda side: spark.readStream.schema(schema).parquet(str(tmp_path / side))
    out = job_state.joined_within(read("l"), read("r").withColumnRenamed("at", "then"), "k", "at", "then").select(F.col("a.k").alias("k"), "at", "then")

    def go():
        q = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "met")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert q.exception() is None
        return sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])

    dropped = go()
    met = lambda: [r.k for r in spark.read.parquet(str(tmp_path / "met")).collect()]
    assert met() == [1] and dropped == 0
    put("l", [(5, "2024-01-01 12:00:00")])
    put("r", [(5, "2024-01-01 12:01:00")])
    go()
    put("l", [(6, "2024-01-01 09:00:00")])  # behind the watermark of 11:50
    put("r", [(6, "2024-01-01 09:01:00"), (7, "2024-01-01 12:05:00")])
    assert go() >= 1
    assert sorted(met()) == [1, 5]
