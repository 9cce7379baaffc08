"""Session defaults, tenant-filtered views and the written cut of long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TENANT = "default"


def build_session(app: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and last-wins maps; conf overrides."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Batches for Python workers end after so many bytes, in this session from now on; a limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "2147483647", "2147483647b"):
        spark.conf.set(key, most)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder; iterative operators call it every few rounds."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table below the shared checkpoint folder, read again: lineage ends as with `checkpointed`, and the size is
    known, so that small sides of joins are broadcast and large ones are shuffled."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a local master gets a local one, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class TenantCatalog:
    """Registers views of tables that show one tenant's rows; queries over the views never see others'.

    The filter is an equality on tenant_id, which Catalyst pushes into scans and uses to prune partitions.
    """

    def __init__(self, spark: SparkSession, tenant_id: str = DEFAULT_TENANT):
        self.spark, self.tenant_id = spark, tenant_id

    def register(self, name: str, table: DataFrame) -> DataFrame:
        view = table.where(F.col("tenant_id") == self.tenant_id)
        view.createOrReplaceTempView(name)
        return view
