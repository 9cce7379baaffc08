"""Benchmark decontamination with suffix arrays of the training texts.

The documents are cut into shards (the batches of a task). Each shard's suffixes are sorted by their first
`window` words; every suffix of every benchmark item is then found there by binary search, which gives all
places of each window, and from them the longest verbatim match. Equal suffixes are searched for once; their
places and their items are lists that never multiply. Longest matches are followed from where two texts begin
to agree only. Only suffixes whose first words all occur in
the benchmark can match, so only those are sorted: the array is sparse but loses no match.

Words are compared by 64-bit hashes. The benchmark is sent to the tasks in blocks of at most BLOCK_BYTES of
text: a size that is checked, not assumed. With more than one block, the documents are read once for each and
the hits are united.

Null texts and texts without words have no words and no hits. Items without words have no windows. Repeated
documents are each reported. Empty tables give no rows, or no hits. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import releasing, text_bytes
from .textvec import chain, word_hashes

BLOCK_BYTES = 8 << 20
WINDOW = 10
HITS = "doc_id long, check long, n_words long, spans array<int>, item_ids array<string>, longest long"


class Benchmark:
    """The suffixes of one block of items, ready to be searched for."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int):
        h, o = word_hashes(texts, "word")
        self.window, self.item_ids = window, item_ids
        self.vocabulary, ranks = np.unique(h, return_inverse=True)
        self.ranks = np.append(ranks.astype(np.int64) + 1, 0)  # 0: no word
        starts, items, lengths = [], [], []
        for k, (a, b) in enumerate(zip(o[:-1].tolist(), o[1:].tolist(), strict=True)):
            n = b - a
            if n:
                w = min(window, n)
                starts.extend(range(a, b - w + 1))
                items.extend([k] * (n - w + 1))
                lengths.extend([w] * (n - w + 1))
        self.starts, self.items, self.lengths = (np.array(x, np.int64) for x in (starts, items, lengths))
        self.ends = o[1:][self.items] if len(items) else np.zeros(0, np.int64)
        self.keys = _keys(self.ranks, self.starts, self.lengths, window)
        # distinct windows in order; where each one's suffixes are in `at`; its items in `of`
        self.windows, code = np.unique(self.keys, return_inverse=True)
        code = code.ravel().astype(np.int64)
        self.at = np.argsort(code, kind="stable")
        self.first = np.searchsorted(code[self.at], np.arange(len(self.windows) + 1))
        self.window_length = self.lengths[self.at[self.first[:-1]]] if len(self.windows) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([code, self.items]), axis=1) if len(code) else np.zeros((2, 0), np.int64)
        self.of, self.first_of = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.windows) + 1))
        # the word before each suffix, -1 at an item's beginning, which equals nothing
        begins = np.isin(self.starts, o[:-1])
        self.before = np.where(begins, -1, self.ranks[np.maximum(self.starts - 1, 0)]) if len(self.starts) else np.zeros(0, np.int64)
        self.shortest = int(self.lengths.min()) if len(lengths) else 0


def _keys(ranks: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """The first `lengths` words at each start as byte strings that sort as the words do."""
    at = starts[:, None] + np.arange(window)
    words = np.where(np.arange(window) < lengths[:, None], ranks[np.minimum(at, len(ranks) - 1)], 0)
    return np.ascontiguousarray(words.astype(">u4")).view(f"S{4 * window}").ravel()


#: Pairs of places whose common length is followed at once.
FOLLOWED = 1 << 18
#: Words that a long match is followed by at once.
LEAP = 32


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values of the ranges [low, high)."""
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    return which, np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - low, many)


def _longest(ranks: np.ndarray, place: np.ndarray, stop: np.ndarray, window: np.ndarray, before: np.ndarray, bench: Benchmark) -> np.ndarray:
    """For each place (with the window that stands there) the longest match that begins to agree there, in words."""
    best = bench.window_length[window].copy()
    step = max(1, FOLLOWED // max(1, int(np.diff(bench.first).max(initial=1))))
    for a in range(0, len(place), step):
        which, k = _spread(bench.first[window[a : a + step]], bench.first[window[a : a + step] + 1])
        test, which = bench.at[k], which + a
        begins = (bench.before[test] < 0) | (bench.before[test] != before[which])  # else a longer match began one word before
        test, which = test[begins], which[begins]
        length, going = bench.window_length[window[which]].copy(), np.arange(len(which))
        steps = 0
        while len(going):
            if steps == LEAP:  # long matches go on by hashes of LEAP words
                h, g = (chain(x.astype(np.uint64), LEAP) for x in (ranks, bench.ranks))
                far = going
                while len(far):
                    d, b = place[which[far]] + length[far], bench.starts[test[far]] + length[far]
                    same = (d + LEAP <= stop[which[far]]) & (b + LEAP <= bench.ends[test[far]])
                    far, d, b = far[same], d[same], b[same]
                    far = far[h[d] == g[b]]
                    length[far] += LEAP
            d, b = place[which[going]] + length[going], bench.starts[test[going]] + length[going]
            same = (d < stop[which[going]]) & (b < bench.ends[test[going]])
            same &= ranks[np.where(same, d, len(ranks) - 1)] == bench.ranks[np.where(same, b, 0)]
            going = going[same]
            length[going] += 1
            steps += 1
        np.maximum.at(best, which, length)
    return best


def shard_hits(texts: list[str | None], bench: Benchmark) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[int], int]]]:
    """(number of words of each text, text -> (hit spans in words, items, longest match))."""
    h, o = word_hashes(texts, "word")
    n_words = np.diff(o)
    found: dict[int, tuple[list[tuple[int, int]], set[int], int]] = {}
    if not len(bench.starts) or not len(h):
        return n_words, found
    at = np.minimum(np.searchsorted(bench.vocabulary, h), len(bench.vocabulary) - 1)
    ranks = np.append(np.where(bench.vocabulary[at] == h, at + 1, 0), 0)
    # how many known words follow each place within its text
    stops = np.union1d(np.flatnonzero(ranks == 0), o[1:])
    run = stops[np.searchsorted(stops, np.arange(len(h)), side="right")] - np.arange(len(h))
    run = np.where(ranks[:-1] == 0, 0, run)
    suffixes = np.flatnonzero(run >= bench.shortest)
    if not len(suffixes):
        return n_words, found
    for w in np.unique(bench.lengths).tolist():  # items shorter than the window have windows of their own length
        mine = suffixes[run[suffixes] >= w]
        keys = _keys(ranks, mine, np.full(len(mine), w), bench.window)
        order = np.argsort(keys, kind="stable")
        mine, keys = mine[order], keys[order]
        tests = np.flatnonzero(bench.window_length == w)
        which, k = _spread(*(np.searchsorted(keys, bench.windows[tests], side) for side in ("left", "right")))
        if not len(k):
            continue
        place, window = mine[k], tests[which]
        doc = np.searchsorted(o, place, side="right") - 1
        before = np.where(place == o[doc], -2, ranks[place - 1])
        length = _longest(ranks, place, o[doc + 1], window, before, bench)
        for d, p, n in zip(doc.tolist(), (place - o[doc]).tolist(), length.tolist(), strict=True):
            spans, items, longest = found.get(d, ([], set(), 0))
            spans.append((p, p + w))
            found[d] = (spans, items, max(longest, n))
        d, v = np.unique(np.stack([doc, window]), axis=1)  # each window once for each text, however often it stands there
        which, k = _spread(bench.first_of[v], bench.first_of[v + 1])
        for x, i in zip(d[which].tolist(), bench.of[k].tolist(), strict=True):
            found[x][1].add(i)
    return n_words, found


def united(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans as a flat list of starts and ends."""
    out: list[int] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, check, n_words, n_hit, item_ids (sorted as strings), spans, longest: one row for each document.

    docs: doc_id, text; bench: item_id, text. `check` is the text's hash. `spans` are the hit words as [start, end) pairs in a flat
    array; `longest` is the longest verbatim match in words.
    """
    spark = docs.sparkSession
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = max(1, -(-text_bytes(bench) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("check"))
    found = None
    for b in range(n):
        items = bench.where(block == b).collect()
        sent = spark.sparkContext.broadcast(Benchmark([r.item_id for r in items], [r.text for r in items], window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    n_words, hits = shard_hits(batch.column(1).to_pylist(), sent.value)
                    rows = [hits.get(k, ((), (), 0)) for k in range(batch.num_rows)]
                    ids = sent.value.item_ids
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(2), pa.array(n_words), pa.array([united(list(s)) for s, _, _ in rows], pa.list_(pa.int32())), pa.array([sorted({ids[i] for i in x if ids[i] is not None}) for _, x, _ in rows], pa.list_(pa.string())), pa.array([x for _, _, x in rows], pa.int64())],
                        names=["doc_id", "check", "n_words", "spans", "item_ids", "longest"],
                    )

        part = source.mapInArrow(releasing(run), HITS)
        found = part if found is None else found.unionByName(part)
    if n > 1:
        found = _over_blocks(found, n)
    hit = F.expr("aggregate(sequence(0, int(size(spans) / 2) - 1), 0L, (s, i) -> s + spans[2 * i + 1] - spans[2 * i])")
    return found.select("doc_id", "check", "n_words", F.when(F.size("spans") > 0, hit).otherwise(F.lit(0)).cast("long").alias("n_hit"), "item_ids", "spans", "longest")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _unite(spans):
    return spans.map(lambda x: united([(int(s[i]), int(s[i + 1])) for s in x for i in range(0, len(s), 2)]))


def _over_blocks(found: DataFrame, n: int) -> DataFrame:
    """What several passes found, by document; equal rows of docs come out as often as they went in."""
    return (
        found.groupBy("doc_id", "check", "n_words")
        .agg(
            F.collect_set(F.when(F.size("spans") > 0, F.col("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
            F.max("longest").alias("longest"),
            (F.count("*") / n).cast("int").alias("copies"),
        )
        .select("doc_id", "check", "n_words", _unite("spans").alias("spans"), "item_ids", "longest", F.explode(F.expr("sequence(1, copies)")))
        .drop("col")
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


def item_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold any benchmark window; all columns stay.

    The verdict is by text: documents with equal texts go or stay together, and rows that share an id, or have none,
    go only for their own text.
    """
    bad = matches(docs, bench, window).where(F.col("n_hit") > 0).select(F.col("doc_id").alias("_bad"), F.col("check").alias("_bad_check")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_check"]), "left_anti")
