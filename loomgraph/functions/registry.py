"""SQL access to the library's functions: `register_functions(spark)` adds them to the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: SQL functions that Catalyst inlines; no Python runs for them.
FUNCTIONS = {
    "normalize_name": "(x STRING) RETURNS STRING RETURN regexp_replace(lower(x), '[- ]', '')",
    "cosine": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / (sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)))",
    "content_hash": "(x STRING) RETURNS STRING RETURN sha2(x, 256)",
}


def register_functions(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
