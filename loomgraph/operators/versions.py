"""Tables with versions: a version is a commit file that names the folders of its rows.

A write puts its rows into a new folder first and then creates the next commit file, which only one of several writers can;
readers take the newest whole commit, so they see the old version until then and never half of a new one. Old versions
stay readable by number. Everything goes through Spark's own file systems, so any store will do that creates files exclusively.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .dml import latest


class Conflict(RuntimeError):
    """Another writer has made the version; read again and repeat."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commit_path(self, version: int) -> str:
        return f"{self.path}/_commits/{version:012}.json"

    def _folders(self, version: int) -> list[str] | None:
        """None for a version that isn't there, or not whole yet."""
        at = self._path(self._commit_path(version))
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)["folders"]
        except ValueError:
            return None

    def version(self) -> int:
        """The newest whole version; 0 is the empty table."""
        folder = self._path(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        for n in sorted((int(x.removesuffix(".json")) for x in names if x.endswith(".json")), reverse=True):
            if self._folders(n) is not None:
                return n
        return 0

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        folders = [] if version == 0 else self._folders(version)
        if folders is None:
            raise ValueError(f"{self.path} has no version {version}")
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _stage(self, rows: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*columns).write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, folders: list[str], base: int) -> int:
        if base + 1 <= self.version():
            raise Conflict(f"{self.path} is past version {base}")
        try:
            stream = self._fs.create(self._path(self._commit_path(base + 1)), False)
        except Exception as e:  # the file is there: another writer was first
            if "exist" in str(e):
                raise Conflict(f"{self.path} has version {base + 1}") from e
            raise
        try:
            stream.write(bytearray(json.dumps({"folders": folders}).encode()))
        finally:
            stream.close()
        return base + 1

    def overwrite(self, rows: DataFrame, base: int | None = None) -> int:
        """rows in the place of version base (default: the newest); returns the new version."""
        base = self.version() if base is None else base
        return self._commit([self._stage(rows)], base)

    def append(self, rows: DataFrame) -> int:
        """Rows of an audit or a log: one folder more. If another writer is first, the commit alone is repeated."""
        folder = self._stage(rows)
        while True:
            base = self.version()
            try:
                return self._commit([*(self._folders(base) or [] if base else []), folder], base)
            except Conflict:
                continue

    def merge(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """change(rows of the newest version) as the next version, repeated on the newer one if another writer was first."""
        while True:
            base = self.version()
            try:
                return self.overwrite(change(self.read(base)), base)
            except Conflict:
                continue


def merged_maps(old: Column, new: Column) -> Column:
    """Properties of both; of a key that both have, the new value."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


NODES = "tenant string, canonical_id string, label string, name string, confidence double, method string, properties map<string,string>"
EDGES = "tenant string, src string, dst string, rel_type string, confidence double, properties map<string,string>"


def _last_wins(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """new over old by keys: a new value that isn't null counts, properties are merged. Keys are equal as text."""
    o, n = old.withColumnsRenamed({c: f"{c}_old" for c in columns}), new.select(*keys, *columns)
    both = o.join(n, keys, "full_outer")
    pick = lambda c: merged_maps(F.col(f"{c}_old"), F.col(c)) if c == "properties" else F.coalesce(c, f"{c}_old")
    return both.select(*keys, *(pick(c).alias(c) for c in columns))


def upsert_graph(nodes: VersionedTable, edges: VersionedTable, entities: DataFrame, rels: DataFrame, tenant: str) -> dict[str, int]:
    """Merges a tenant's entities and relationships into the tables; gives the versions made.

    entities: nth (order of arrival), canonical_id, label, name, confidence, method, properties; of one id the last row counts; a new
    node's defaults are confidence 0.8 and method llm. rels: nth, src, dst, rel_type, confidence, properties; default 0.7.
    Rows without an id go, and so do relationships from a node to itself or with an end that the tenant hasn't got. Nodes are written
    first, so that no relationship is lost to the order of batches.
    """
    mine = F.lit(tenant)
    new = latest(entities.where("canonical_id IS NOT NULL"), ["canonical_id"], [F.desc("nth")]).withColumn("tenant", mine)

    def with_nodes(old: DataFrame) -> DataFrame:
        rows = _last_wins(old, new, ["tenant", "canonical_id"], ["label", "name", "confidence", "method", "properties"])
        return rows.withColumns({"confidence": F.coalesce("confidence", F.lit(0.8)), "method": F.coalesce("method", F.lit("llm"))})

    made = {"nodes": nodes.merge(with_nodes)}
    known = nodes.read(made["nodes"]).where(F.col("tenant") == mine).select(F.col("canonical_id").alias("id"))
    kept = rels.where("src <> dst AND rel_type IS NOT NULL").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    last = latest(kept, ["src", "dst", "rel_type"], [F.desc("nth")]).withColumn("tenant", mine)

    def with_edges(old: DataFrame) -> DataFrame:
        rows = _last_wins(old, last, ["tenant", "src", "dst", "rel_type"], ["confidence", "properties"])
        return rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.7)))

    made["edges"] = edges.merge(with_edges)
    return made


METRICS = "run string, stage string, rows long, seconds double, attempts int, failed string"


def run_stages(docs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], to: str, metrics: VersionedTable, run: str, retries: int = 1) -> DataFrame:
    """Each stage's rows written below `to` and read by the next; a row of metrics is appended for each stage, also for one that fails.

    Rows are counted by an observation while they are written, so counting is no pass of its own.
    """
    spark = docs.sparkSession
    for name, stage in stages:
        for attempt in range(1, retries + 2):
            seen, began, why = Observation(f"{run}-{name}-{attempt}"), time.time(), None
            try:
                out = stage(docs)
                out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{to}/{name}")
            except Exception as e:
                why = f"{type(e).__name__}: {e}"[:500]
            if why is None or attempt > retries:
                row = (run, name, None if why else seen.get["rows"], time.time() - began, attempt, why)
                metrics.append(spark.createDataFrame([row], METRICS))
                break
        if why is not None:
            raise RuntimeError(f"stage {name}: {why}")
        docs = spark.read.schema(out.schema).parquet(f"{to}/{name}")
    return docs
