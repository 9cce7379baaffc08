"""Positions and order statistics within groups of any size: rows are dealt by ranges, so no task needs a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of one range.
RANGE_ROWS = 100_000


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """df with each row's position, from 1, among the rows that are equal in `by`, in `order`.

    Rows are dealt by ranges of (by, order); each is numbered within its range, and a range adds how many rows of the
    group stand in the ranges before it. The ranges are written once: numbers and counts must be of the same ones.
    """
    n = max(1, -(-df.count() // RANGE_ROWS))
    dealt = checkpointed(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    within = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = within["_range"] == before["_r"]
    for i, c in enumerate(by):
        same &= within[c].eqNullSafe(before[f"_by{i}"])
    return within.join(before, same).select(*df.columns, (F.col("_before") + F.col("_nth")).alias(name))


def median_and_p95(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, p50, p95: the median, and the exclusive 95th percentile, which extrapolates between order statistics."""
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"))
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    at = 0.95 * (F.col("n") + 1)
    j = F.least(F.greatest(F.floor(at), F.lit(1)), F.col("n") - 1)
    places = n.select(by, "n", at.alias("at"), j.alias("j"), F.floor((F.col("n") + 1) / 2).alias("low"), F.ceil((F.col("n") + 1) / 2).alias("high"))
    nth = lambda c: F.max(F.when(F.col("nth") == F.col(c), F.col("v")))
    found = numbered(rows, [by], ["v"]).join(F.broadcast(places), by).groupBy(by, "at", "j").agg(((nth("low") + nth("high")) / 2).alias("p50"), nth("j").alias("x"), F.max(F.when(F.col("nth") == F.col("j") + 1, F.col("v"))).alias("y"))
    return found.select(by, "p50", (F.col("x") + (F.col("at") - F.col("j")) * (F.col("y") - F.col("x"))).alias("p95"))
