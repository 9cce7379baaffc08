"""Best-fit packing with certified bin counts.

`pieces` turns each document into token pieces of at most `capacity`. `pack` deals the pieces into partitions by
a hash, packs each best-fit decreasing, and takes a lower bound from dual-feasible functions. A partition whose
bin count meets its bound is certified: no packing of its pieces needs fewer bins. A partition with a gap
exchanges all its bins that have room, a certified one only those more than half empty (two of which make one). The
exchanged pieces meet in new partitions, are packed anew, and the result stands where it needs fewer bins.

Null and empty texts have one piece with the end id. Repeated rows are packed as often as they come. An
empty table gives no rows. Extra columns are not read. Longer documents are cut at multiples of capacity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32, cut, release, releasing
from .tokens import DEFAULT, encoder, vocabulary_path

#: Pieces of one group: what a task packs at once, whatever the input's size.
GROUP_ROWS = 40_000
#: A bin with more than this share free takes part in the exchange.
OPEN_SHARE = 0.02
#: Rows that a task encodes at once.
ROWS = 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, free int, gap long"


def pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str = DEFAULT, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document; the texts don't leave the task that reads them."""
    path = vocabulary_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids, offsets = enc.encode_all(batch.column(1).to_pylist())
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = (offsets + np.arange(len(offsets))).tolist()
            data = ids.view(np.uint8)
            rows: list[tuple] = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                for k, at in enumerate(range(a, b, capacity)):
                    stop = min(at + capacity, b)
                    rows.append((doc_id, k, at - a, stop - at, crc32(data[4 * at : 4 * stop])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions."""
    if not len(lengths):
        return 0
    s = np.sort(lengths.astype(np.int64))
    sums = np.concatenate([[0], np.cumsum(s)])
    best = math.ceil(int(sums[-1]) / capacity)
    # for each threshold e: items over capacity - e fill a bin, items under e vanish
    e = np.unique(np.minimum(s, capacity - s))
    e = e[e > 0]
    if len(e):
        low, high = np.searchsorted(s, e, "left"), np.searchsorted(s, capacity - e, "right")
        best = max(best, -(-int(((len(s) - high) * capacity + sums[high] - sums[low]).max()) // capacity))
    # lengths rounded to k-ths of a bin, exact multiples kept
    for k in range(1, 12):
        whole, rest = np.divmod((k + 1) * lengths, capacity)
        v = np.where(rest == 0, lengths * k, whole * capacity)  # in units of 1 / (k * capacity)
        best = max(best, math.ceil(int(v.sum()) / (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, free room of each bin).

    Bins are kept by their free room; a bit mask of the rooms that occur finds the tightest that fits.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = left = room - size
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def _packer(capacity: int, round_: int):
    """applyInPandas function: packs one partition; later rounds keep the old places unless they save bins.

    `gap` is by how many bins the partition is over its bound: 0 certifies it.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bound = lower_bound(lengths, capacity)
        if round_:
            had = rows["sequence_id"].nunique()
            if had <= bound:
                return rows.assign(gap=0)[PACKED_COLUMNS]
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        if round_ and len(free) >= had:
            return rows.assign(gap=had - bound)[PACKED_COLUMNS]
        release()
        group = int(key[0])
        return rows.assign(sequence_id=(round_ << 60) + (group << 24) + bins, offset=offsets, free=free[bins].astype(np.int32), gap=len(free) - bound)[PACKED_COLUMNS]

    return run


PACKED_COLUMNS = [x.split()[0] for x in PACKED.split(", ")]


def pack(rows: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS, rounds: int = 2) -> DataFrame:
    """rows (as from `pieces`) with sequence_id and offset. Rows are dealt by a hash of their values and their place, so
    that equal rows, however many, are spread too; the place is written once and so stays when a task runs again."""
    rows = cut(rows.withColumn("place", F.monotonically_increasing_id()))
    full = rows.where(F.col("length") >= capacity)
    n = max(1, -(-(rows.count()) // group_rows))
    if n >= 1 << 36:
        raise ValueError("too many groups for the sequence ids")
    spread = F.xxhash64("doc_id", "piece", "ids_crc32", "place")
    # a full piece is a sequence of its own; its id is made from its task and place, below all others
    alone = full.drop("place").select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.where(F.col("length") < capacity).select("*", F.pmod(spread, F.lit(n)).alias("group")).drop("place")
    packed = cut(part.groupBy("group").applyInPandas(_packer(capacity, 0), PACKED))
    done = [alone]
    for r in range(1, rounds + 1):
        gives = F.when(F.col("gap") > 0, F.col("free") > capacity * OPEN_SHARE).otherwise(2 * F.col("free") > capacity)
        done.append(packed.where(~gives))
        open_ = packed.where(gives)
        n = max(1, -(-open_.count() // group_rows))
        grouped = open_.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(r)), F.lit(n)))
        packed = cut(grouped.groupBy("group").applyInPandas(_packer(capacity, r), PACKED))
        if n == 1:
            break
    done.append(packed)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x.select(*out.columns))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
