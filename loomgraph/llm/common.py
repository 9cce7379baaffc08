"""What the operators of this subpackage share: tables, the shared folder, hashes, blocks of documents."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of one batch that Spark sends to a Python worker. By default only rows are counted (10,000), so long texts
#: would make batches of any size, which JVM and worker each hold several times.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers end after BATCH_BYTES, in this session from now on; a limit that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "2147483647", "2147483647b"):
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given table; only Spark's reader touches the path, so any store that Spark knows will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local master (tests) gets a local one; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which driver and executors share."""
    return f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as a table below the checkpoint folder and read again.

    The lineage ends here, so a lost executor costs nothing that was done before; Parquet keeps it small.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(column: str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


_pack = _unpack = None
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:
    _libc = None


def pack(data: bytes) -> bytes:
    """zstd level 1; one compressor in each worker."""
    global _pack
    if _pack is None:
        _pack = zstandard.ZstdCompressor(level=1)
    return _pack.compress(data)


def unpack(data: bytes) -> bytes:
    global _unpack
    if _unpack is None:
        _unpack = zstandard.ZstdDecompressor()
    return _unpack.decompress(data)


@F.arrow_udf(T.BinaryType())
def packed_text(text: pa.Array) -> pa.Array:
    """Texts as zstd frames, so that a shuffle moves about a third of the bytes. Null stays null."""
    return pa.array((None if t is None else pack(t) for t in (x.as_buffer() for x in text.cast(pa.large_binary()))), pa.binary())


def release() -> None:
    """Gives memory that a worker has freed back to the system: a worker outlives many groups, and what one
    large group took would else count against all that run later."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def releasing(run):
    """run (a function of the batches of a task) that gives freed memory back when its task ends."""

    def until_end(batches):
        yield from run(batches)
        release()

    return until_end


def text_of(data) -> str | None:
    return None if data is None else unpack(bytes(data)).decode("utf-8", "surrogatepass")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, in one pass of Spark's own functions."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def blocks_of(size: int, block_bytes: int) -> int:
    """The number of blocks for so many bytes of text."""
    return max(1, -(-size // block_bytes))


def in_blocks(docs: DataFrame, n: int, *columns: str) -> DataFrame:
    """columns, the packed text as `z` and a block number from 0 to n - 1.

    A block is dealt by a hash of id and text, so blocks have about the same size whatever source or group of
    copies holds most rows. Rows that repeat both id and text are in one block.
    """
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), *columns, packed_text("text").alias("z")
    )
