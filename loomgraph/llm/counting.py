"""Corpus counts for blocks of documents: each block asks for the totals of the distinct hashes that it holds.

A block is some megabytes of text. It sends its distinct 64-bit hashes with their counts, sorted and cut into
ranges of values, as columns of packed numbers: a shuffle moves a few bytes for each distinct hash of a block and
nothing for its repetitions.

Adding up goes in levels. At each level a node is a group of blocks and a range of values: it gets that range from
at most FAN nodes of smaller groups, adds up, and sends each of at most FAN parts of the range to the node of the next
larger group. The last level has one group of all blocks; from there the totals go back the same way. So no node gets
a hash more often than FAN times, however frequent it is, and a level moves at most FAN rows for each block each way
(`shape`, `most_rows`): the rows grow with the input times the number of levels, which is 1 up to FAN blocks, 2 up to
FAN ** 2 and so on. What goes up is written where it is needed on the way back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pack, release, unpack

#: Distinct hashes of one bucket, added over the blocks: what one task adds up at once.
BUCKET_HASHES = 1_000_000
#: Nodes that send to one node, and parts that a node sends its range in, at most.
FAN = 1024
#: Rows to a node (part, range) from its child, and rows to a child (part, range) from a node of range `sub`.
ASKED = "part int, range long, child int, n int, keys binary, counts binary"
ANSWERED = "part int, range long, sub long, totals binary, kinds long, occurrences long"


def packed(a: np.ndarray) -> bytes:
    """Numbers as byte planes (all first bytes, all second bytes, ...), which zstd then shrinks."""
    a = np.ascontiguousarray(a)
    return pack(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def unpacked(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(unpack(bytes(data)), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def distinct(hashes: np.ndarray, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, how often each occurs in `counted`, a part of them; default: all)."""
    s = np.sort(hashes)
    if not len(s):
        return s, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    keys = s[first]
    if counted is None:
        return keys, np.diff(np.append(first, len(s)))
    c = np.sort(counted)
    return keys, np.searchsorted(c, keys, "right") - np.searchsorted(c, keys, "left")


def root_of(n: int, levels: int) -> int:
    """The smallest whole number whose power is n at least."""
    r = max(1, round(n ** (1 / levels)) - 1)
    while r**levels < n:
        r += 1
    return r


def shape(blocks: int, buckets: int, fan: int) -> tuple[int, int, int]:
    """(levels, nodes that one node adds up, parts of a node's range) so that no more than fan meet or leave."""
    levels = 1
    while root_of(max(blocks, buckets), levels) > fan:
        levels += 1
    return levels, root_of(blocks, levels), root_of(buckets, levels)


def most_rows(blocks: int, buckets: int, fan: int) -> int:
    """Rows that the levels send up, at most; as many come back. Every block sends once at the first level, every node once at the next ones."""
    levels, group, parts = shape(blocks, buckets, fan)
    return sum(-(-blocks // group**i) * parts ** (i + 1) for i in range(levels))


def cuts(keys: np.ndarray, parts: int, range_: int = 0, ranges: int = 1) -> np.ndarray:
    """Where the sorted keys of one of the equal ranges of all values are cut into equal parts of it."""
    bounds = np.array([((range_ * parts + i) << 64) // (ranges * parts) for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of their counts)."""
    order = np.argsort(keys)
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.add.reduceat(counts[order], first, dtype=np.int64)


def totals(blocks: DataFrame, number: int, ask: Callable[..., tuple[np.ndarray, np.ndarray]], buckets: int, kind: np.uint64 | None = None, known: DataFrame | None = None, fan: int | None = None) -> DataFrame:
    """For each block and range of values (`bucket`) the totals of the block's hashes; written to the checkpoint folder.

    blocks: rows with a column `block`, of 0 to number - 1; ask(rows of one block) gives its sorted distinct hashes and
    counts. With known (rows with a column `block` too), ask gets the block's rows of it as well. With kind, `kinds`
    and `occurrences` of the rows of block -1 have the number and the sum of the totals over 0 of the hashes whose
    last bit is kind.
    """
    levels, group, parts = shape(number, buckets, fan or FAN)

    def sent(child: int, range_: int, level: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """Rows of a node's range for the nodes of the level above."""
        at, made = cuts(keys, parts, range_, parts**level), []
        for i in range(parts):
            k, c = keys[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]
            if len(k):
                made.append((child // group, range_ * parts + i, child, len(k), packed(np.diff(k, prepend=np.uint64(0))), packed(c.astype(np.int64 if level else np.uint32))))
        return made

    def got_keys(rows: pd.DataFrame) -> list[np.ndarray]:
        return [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]

    def got_counts(rows: pd.DataFrame, level: int) -> np.ndarray:
        return np.concatenate([unpacked(c, np.int64 if level > 1 else np.uint32) for c in rows["counts"]])

    def asked(rows: pd.DataFrame, *more: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(rows):
            keys, counts = ask(rows, *more)
            made = sent(int(rows["block"].iloc[0]), 0, 0, keys, counts)
            del keys, counts
        release()
        return pd.DataFrame(made, columns=names(ASKED))

    def passed_up(level: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("child", ignore_index=True)
            keys, counts = summed(np.concatenate(got_keys(rows)), got_counts(rows, level))
            made = sent(int(rows["part"].iloc[0]), int(rows["range"].iloc[0]), level, keys, counts)
            del keys, counts
            release()
            return pd.DataFrame(made, columns=names(ASKED))

        return run

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child", ignore_index=True)
        keys, counts = np.concatenate(got_keys(rows)), got_counts(rows, levels)
        order = np.argsort(keys)  # half the memory of a hash table of so many keys
        s, n_keys = keys[order], len(keys)
        del keys
        first = np.concatenate([[True], s[1:] != s[:-1]])
        known = s[first]
        each = np.add.reduceat(counts[order], np.flatnonzero(first), dtype=np.int64)
        total = np.empty(n_keys, np.int64)
        total[order] = each[np.cumsum(first, dtype=np.int32) - 1]
        del s, order, counts, first
        range_, made, at = int(rows["range"].iloc[0]), [], 0
        for child, n in zip(rows["child"], rows["n"], strict=True):
            made.append((int(child), range_ // parts, range_, packed(total[at : at + n]), 0, 0))
            at += n
        if kind is not None:
            mine = (known & np.uint64(1) == kind) & (each > 0)
            made.append((-1, 0, range_, b"", int(mine.sum()), int(each[mine].sum())))
        del total
        release()
        return pd.DataFrame(made, columns=names(ANSWERED))

    def passed_down(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(rows):
            rows = rows.sort_values("child", ignore_index=True)
            each, range_ = got_keys(rows), int(rows["range"].iloc[0])
            keys = np.unique(np.concatenate(each))
            total = in_order(got, len(keys), "sub")
            made = [(int(child), range_ // parts, range_, packed(total[np.searchsorted(keys, k)]), 0, 0) for child, k in zip(rows["child"], each, strict=True)]
            del each, keys, total
        release()
        return pd.DataFrame(made, columns=names(ANSWERED))

    blocked, node = blocks.groupBy("block"), ["part", "range"]
    up = [blocked.applyInPandas(lambda rows: asked(rows), ASKED) if known is None else blocked.cogroup(known.groupBy("block")).applyInPandas(lambda rows, got: asked(rows, got), ASKED)]
    for level in range(1, levels):
        up[-1] = cut(up[-1])
        up.append(up[-1].groupBy(*node).applyInPandas(passed_up(level), ASKED))
    answers = last = cut(up.pop().groupBy(*node).applyInPandas(added, ANSWERED))
    while up:
        answers = cut(up.pop().groupBy(*node).cogroup(answers.where("part >= 0").groupBy(*node)).applyInPandas(passed_down, ANSWERED))
    if levels > 1:
        answers = answers.unionByName(last.where("part < 0"))
    return answers.select(F.col("part").alias("block"), F.col("sub").alias("bucket"), "totals", "kinds", "occurrences")


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def in_order(answers: pd.DataFrame, n: int, by: str = "bucket") -> np.ndarray:
    """The totals of one block in the order of its sorted hashes."""
    parts = [unpacked(t, np.int64) for t in answers.sort_values(by)["totals"]]
    found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(found) != n:
        raise ValueError(f"{len(found)} totals for {n} hashes")
    return found


def answers_for(totals_: DataFrame, number: int = 0) -> DataFrame:
    """The answers to the blocks; number tells the rounds of asking apart."""
    return totals_.where(F.col("block") >= 0).select("block", "bucket", "totals", F.lit(number).alias("number"))
