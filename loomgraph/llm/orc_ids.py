"""Token ids in ORC: stripes with run-length encoded integers, row indexes and Bloom filters on doc_id.

`write_ids` encodes every whole text and writes the rows in ascending doc_id order (equal ids: by a hash of
the text; null ids first), one file for each range of ids. `read_ids` reads stripes in parallel; `lookup`
prunes stripes and row groups by their statistics and Bloom filters; `digest` derives each document's
start, length and checksum from what was read back.

Null and empty texts have only the end id. Repeated rows stay repeated. An empty table gives no rows.
Extra columns are not read. A long text is one row; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32, releasing, text_bytes
from .tokens import DEFAULT, encoder, vocabulary_path

#: Text bytes that go to one file, and bytes of one stripe.
FILE_BYTES, STRIPE_BYTES = 24 << 20, 8 << 20
#: Rows that a task encodes at once.
ROWS = 500
SCHEMA = "part int, row long, doc_id long, n_tokens long, ids array<int>"


def encode_batches(path: str, end_id: int):
    """mapInArrow function from (doc_id, text) to SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids, offsets = enc.encode_all(batch.column(1).to_pylist())
            n = batch.num_rows
            # one end id behind each document
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(n + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(row, row + n)),
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                names=["part", "row", "doc_id", "n_tokens", "ids"],
            )
            row += n

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str = DEFAULT, end_id: int = 2) -> None:
    """Encode docs (doc_id, text) into ORC files below path."""
    n = max(1, -(-text_bytes(docs) // FILE_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(releasing(encode_batches(vocabulary_path(tokenizer), end_id)), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All rows; Spark splits the files at stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """The ids of some documents; the pushed-down filter skips stripes and row groups that can't hold them."""
    return read_ids(spark, path).where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4").view(np.uint8)
        offsets = ids.offsets.to_numpy()
        crcs = [crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        lengths = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), lengths, pa.array(crcs, pa.int64())], names=["part", "row", "doc_id", "n_tokens", "ids_crc32"])


def digest(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows of `read_ids`.

    start is a prefix sum in two steps: over the files' totals (one small row each, from the stored
    lengths alone), and over the rows within each file.
    """
    files = ids.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    rows = ids.mapInArrow(_checksums, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    return rows.join(files, "part").select("doc_id", (F.col("before") + F.coalesce(within, F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
