"""Phrase collocations, counted in a HAT-trie.

Every phrase of up to five words is counted by language. In a task phrases go into a trie over word ids (64-bit hashes of
language and word): a shallow trie of nodes whose leaves are containers, bulk tables of the rests of phrases with their
counts; a container that grows too large bursts into a node by the next word. When the trie is over its budget, its largest
subtrees are written out whole, each a sorted run. The runs of all tasks are dealt by ranges of the word ids, so that a
range is a set of prefixes (a hot prefix has several, cut by its next words), and each range adds up its runs.

A phrase can only be frequent if its parts are. So words are counted first, then pairs of frequent words, then triples
both of whose pairs are frequent, then longer phrases all of whose triples are. What is frequent is sent to the tasks as a bitmap of bounded size; where it
says yes wrongly, which only costs work, the exact count settles it. Every count is over all texts, and score and order are
exact (decimals of 38 digits).

A null lang is `und`. Null and empty texts have no words. Repeated rows count as often as they come. Equal scores are
ordered by count, then by the phrase in byte order. Empty tables give no rows. Extra columns are not read. A long text is read
in slices that overlap by four words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, releasing
from .textvec import LOWER, SLICE, mix, span_hashes

MOST_WORDS, LEAST, TOP = 5, 100, 2000
UNKNOWN = "und"
#: Entries of a task's trie before subtrees are written out, and of a container before it bursts.
BUDGET, BURST = 1_500_000, 32_768
#: Bytes of text whose phrases are put into a trie at once.
BATCH_BYTES = 2 << 20
#: Distinct words that a task holds before it gives their counts away.
HELD_WORDS = 300_000
#: Entries of runs that one range adds up, and the most ranges; beyond that ranges grow, which Spark's aggregation spills.
RANGE_ROWS, MOST_RANGES = 500_000, 20_000
#: Bits of a bitmap: 32 for each member, at most so many (16 MB).
MOST_BITS = 1 << 27
#: Languages whose totals are broadcast; more are joined.
MOST_LANGS = 100_000
#: Parts that each language's best are first taken from.
SALTS = 32

_BLANK, _STOP = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)], _KIND[list(_STOP)] = 1, 2
_ALL_BLANK = bytes.maketrans(_BLANK + _STOP, b" " * (len(_BLANK) + len(_STOP)))


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def slices(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(part, words at its begin that the part before had already): parts of about SLICE bytes, cut between words."""
    again = 0
    while len(data) > 2 * SLICE:
        flat = data[SLICE : 2 * SLICE].translate(_ALL_BLANK)
        at = flat.find(b" ")
        if at < 0:
            at = data[2 * SLICE :].translate(_ALL_BLANK).find(b" ")
            if at < 0:
                break
            at += SLICE
        words = data[: SLICE + at].translate(_ALL_BLANK).rsplit(None, MOST_WORDS - 1)
        if len(words) < MOST_WORDS:
            break  # a few giant words
        yield data[: SLICE + at], again
        again, data = MOST_WORDS - 1, data[len(words[0]) :]
    yield data, again


class Words:
    """The words of a batch: ids, whether each is new (not in the part before), whether its next is of the same piece."""

    def __init__(self, parts: list[bytes], langs: list[str], again: list[int]):
        self.buffer = (b"\n".join(parts) + b"\n").translate(LOWER)
        kind = _KIND[np.frombuffer(self.buffer, np.uint8)]
        edges = np.flatnonzero(np.diff(kind > 0, prepend=True))
        self.starts, self.ends = edges[0::2], edges[1::2]
        piece = np.cumsum(kind == 2)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        first_byte = np.zeros(len(parts), np.int64)
        np.cumsum([len(p) + 1 for p in parts[:-1]], out=first_byte[1:])
        before = np.append(np.searchsorted(self.starts, first_byte), len(self.starts))
        self.langs, self.lang = langs, np.repeat(np.arange(len(parts)), np.diff(before))
        seeds = np.array([lang_hash(x) for x in langs], np.uint64)
        self.ids = mix(span_hashes(self.buffer, self.starts, self.ends) ^ seeds[self.lang])
        self.ids[self.ids == 0] = 1
        nth = np.arange(len(self.starts)) - before[self.lang]
        self.new = nth >= np.array(again, np.int64)[self.lang]
        self.joined = piece[1:] == piece[:-1]

    def text(self, i: int) -> str:
        return self.buffer[self.starts[i] : self.ends[i]].decode("utf-8", "surrogatepass")


def batches_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Of columns lang, text."""
    parts: list[bytes] = []
    langs: list[str] = []
    again: list[int] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part, n in slices(text.encode("utf-8", "surrogatepass")) if text else ():
                if parts and size + len(part) > BATCH_BYTES:
                    yield Words(parts, langs, again)
                    parts, langs, again, size = [], [], [], 0
                parts.append(part)
                langs.append(lang)
                again.append(n)
                size += len(part) + 1
    if parts:
        yield Words(parts, langs, again)


def phrases_of(words: Words, known: np.ndarray, *frequent: np.ndarray) -> np.ndarray:
    """Word ids of the batch's phrases, a row each: pairs of known words; with a bitmap of pairs the triples whose
    pairs are in it; with one of triples too all longer phrases whose triples are in that. Shorter ones end in zeros."""
    ids = words.ids
    sizes = [(2,), (3,), range(4, MOST_WORDS + 1)][len(frequent)]
    made = [np.zeros((0, sizes[-1]), np.uint64)]
    have = within(known, ids)
    run, size = words.joined & have[1:] & have[:-1] if len(ids) else np.zeros(0, bool), 2
    for bits in frequent:  # run: where a phrase of `size` words may begin
        at = np.flatnonzero(run)
        run[at[~within(bits, phrase_hash(*(ids[at + i] for i in range(size))))]] = False
        run, size = run[:-1] & run[1:], size + 1
    for k in sizes:
        if k > size:
            run, size = run[:-1] & run[1:], k
        at = np.flatnonzero(run)
        at = at[words.new[at + k - 1]]
        rows = np.zeros((len(at), sizes[-1]), np.uint64)
        for i in range(k):
            rows[:, i] = ids[at + i]
        made.append(rows)
    return np.concatenate(made)


def phrase_hash(*ids: np.ndarray) -> np.ndarray:
    h = ids[0]
    for x in ids[1:]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h


def within(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order with their summed counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(counts, first)


def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, those of one first word together, and how often each occurs."""
    codes, _ = pd.factorize(phrase_hash(*rows.T))
    first = np.zeros(codes.max() + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    if (rows[first[codes]] != rows).any():  # two phrases with one hash
        return summed(rows, np.ones(len(rows), np.int64))
    order = np.argsort(rows[first, 0])
    return rows[first[order]], np.bincount(codes)[order]


class HatTrie:
    """Counts of rows of word ids: nodes by the first words, below them containers of the rests."""

    class Container:
        __slots__ = ("chunks", "size", "settled")

        def __init__(self):
            self.chunks: list[tuple[np.ndarray, np.ndarray]] = []
            self.size = self.settled = 0

    def __init__(self, width: int, burst: int = 0):
        self.width, self.burst = width, burst or BURST
        self.children: dict[int, HatTrie | HatTrie.Container] = {}

    def size(self) -> int:
        return sum(x.size() if isinstance(x, HatTrie) else x.size for x in self.children.values())

    def add(self, rows: np.ndarray, counts: np.ndarray) -> int:
        """Takes rows of which those of one first word are together; returns how many entries the trie has more."""
        heads = rows[:, 0]
        cuts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])).tolist() + [len(rows)]
        rests, more = rows[:, 1:], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            head = int(heads[a])
            child = self.children.get(head)
            if child is None:
                child = self.children[head] = HatTrie.Container()
            if isinstance(child, HatTrie):
                more += child.add(rests[a:b], counts[a:b])
                continue
            child.chunks.append((rests[a:b].copy(), counts[a:b].copy()))
            child.size += b - a
            more += b - a
            if len(child.chunks) >= 16 and child.size > 2 * child.settled:
                more -= self._settle(head, child)
        return more

    def _settle(self, head: int, child: Container) -> int:
        """Adds up a container's chunks, and bursts it if it is still large; returns by how many entries it shrank."""
        had = child.size
        rows, counts = summed(np.concatenate([c[0] for c in child.chunks]), np.concatenate([c[1] for c in child.chunks]))
        child.chunks, child.size, child.settled = [(rows, counts)], len(rows), len(rows)
        if len(rows) > self.burst and self.width > 2:
            node = self.children[head] = HatTrie(self.width - 1, self.burst)
            node.add(rows, counts)
        return had - len(rows)

    def taken(self, heads: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole subtrees of the given first words (default: all), in order; they leave the trie."""
        for head in sorted(self.children if heads is None else heads):
            child = self.children.pop(head)
            if isinstance(child, HatTrie):
                parts: Iterator = child.taken()
            else:
                parts = iter([summed(np.concatenate([c[0] for c in child.chunks]), np.concatenate([c[1] for c in child.chunks]))])
            for rows, counts in parts:
                yield np.concatenate([np.full((len(rows), 1), head, np.uint64), rows], axis=1), counts

    def largest(self, entries: int) -> list[int]:
        """First words of the largest subtrees that hold at least so many entries together."""
        sizes = sorted(((x.size() if isinstance(x, HatTrie) else x.size, head) for head, x in self.children.items()), reverse=True)
        got, total = [], 0
        for size, head in sizes:
            if total >= entries:
                break
            got.append(head)
            total += size
        return got


def counted_in_tries(docs: DataFrame, known: np.ndarray, *frequent: np.ndarray, budget: int = 0) -> DataFrame:
    """w1, ..., n: sorted runs of phrases (see phrases_of), written to the checkpoint folder."""
    width, budget = (2, 3, MOST_WORDS)[len(frequent)], budget or BUDGET
    names = [f"w{i}" for i in range(1, width + 1)]
    sent = docs.sparkSession.sparkContext.broadcast((known, *frequent))

    def out(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part[1])
            if size >= 1 << 16:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def made(held: list) -> pa.RecordBatch:
        rows, counts = np.concatenate([h[0] for h in held]).view(np.int64), np.concatenate([h[1] for h in held])
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(width)), pa.array(counts, pa.int64())], names=[*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, entries = HatTrie(width), 0
        for words in batches_of_words(batches):
            rows = phrases_of(words, *sent.value)
            if len(rows):
                entries += trie.add(*gathered(rows))
            if entries > budget:
                yield from out(trie.taken(trie.largest(entries - budget // 2)))
                entries = trie.size()
        yield from out(trie.taken())

    return cut(docs.select("lang", "text").mapInArrow(releasing(run), ", ".join(f"{c} long" for c in [*names, "n"])))


def merged(runs: DataFrame, least: int) -> DataFrame:
    """The phrases that occur at least so often, with n; each range of prefixes adds up its runs."""
    cols = [c for c in runs.columns if c != "n"]
    parts = min(MOST_RANGES, max(1, -(-runs.count() // RANGE_ROWS)))
    return cut(runs.repartitionByRange(parts, *cols).groupBy(*cols).agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def bitmap(rows: DataFrame, hashed) -> np.ndarray:
    """The bits of hashed(columns of rows); the driver gets a row for each 64 bits that has any, MOST_BITS / 64 at most."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (32 * rows.count() - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = hashed(*(c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)) & np.uint64(bits - 1)
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["at", "bit"])

    found = rows.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def counted_words(docs: DataFrame) -> DataFrame:
    """lang, word, id, n of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for words in batches_of_words(batches):
            new = np.flatnonzero(words.new)
            codes, uniques = pd.factorize(words.ids[new])
            at = np.zeros(len(uniques), np.int64)
            at[codes[::-1]] = new[::-1]
            for key, n, i in zip(uniques.tolist(), np.bincount(codes, minlength=len(uniques)).tolist(), at.tolist(), strict=True):
                if key in held:
                    held[key][2] += n
                else:
                    held[key] = [words.langs[words.lang[i]], words.text(i), n]
            if len(held) > HELD_WORDS:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        rows = list(held.items())
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            keys = np.array([k for k, _ in part], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for _, v in part]), pa.array([v[1] for _, v in part]), pa.array(keys), pa.array([v[2] for _, v in part], pa.int64())], names=["lang", "word", "id", "n"])

    rows = docs.select("lang", "text").mapInArrow(releasing(run), "lang string, word string, id long, n long")
    return cut(rows.groupBy("lang", "word").agg(F.first("id").alias("id"), F.sum("n").alias("n")))


def path(width: int) -> Column:
    return F.filter(F.array(*(F.col(f"w{i}") for i in range(1, width + 1))), lambda x: x != 0)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, id, n of those with n >= least; totals: lang, total of all words; phrases: path, n of two words and more)."""
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    every = counted_words(docs)
    totals = cut(every.groupBy("lang").agg(F.sum("n").alias("total")))
    words = cut(every.where(F.col("n") >= least))
    known = bitmap(words.select("id"), phrase_hash)
    two = merged(counted_in_tries(docs, known), least)
    pairs = bitmap(two.select("w1", "w2"), phrase_hash)
    three = merged(counted_in_tries(docs, known, pairs), least)
    more = merged(counted_in_tries(docs, known, pairs, bitmap(three.select("w1", "w2", "w3"), phrase_hash)), least)
    found = two.select(path(2).alias("path"), "n").unionByName(three.select(path(3).alias("path"), "n"))
    return words, totals, found.unionByName(more.select(path(MOST_WORDS).alias("path"), "n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to five words, as the README has it."""
    words, totals, phrases = frequent_phrases(docs, least)
    if totals.count() <= MOST_LANGS:
        totals = F.broadcast(totals)
    parts = words.select(F.array("id").alias("path"), "n").unionByName(phrases)
    m = F.size("path")
    # of each phrase that lies in longer ones, the count of the most frequent of those
    lengths = F.sequence(F.lit(2), m - 1)
    inner = F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.size("path") - k + 1), lambda i: F.slice("path", i, k))))
    covered = phrases.where(m > 2).select(F.explode_outer(F.array_distinct(inner)).alias("path"), "n").groupBy("path").agg(F.max("n").alias("longer"))
    left = phrases.join(covered, "path", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n"))).select("path", F.col("n").alias("a"))
    left = cut(left)
    cuts = left.select("path", "a", F.explode_outer(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("path", "a", "k", F.slice("path", F.lit(1), F.col("k")).alias("first"), F.slice("path", F.col("k") + 1, m).alias("rest"))
    cuts = cuts.join(parts.select(F.col("path").alias("first"), F.col("n").alias("l")), "first").join(parts.select(F.col("path").alias("rest"), F.col("n").alias("r")), "rest")
    names = words.select("lang", "id", "word").join(totals, "lang")
    texts = left.select("path", F.posexplode("path").alias("at", "id")).join(names, "id")
    texts = texts.groupBy("path").agg(F.first("lang").alias("lang"), F.first("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.join(texts, "path").select("path", "lang", "phrase", "a", "k", "l", "r", F.col("total").alias("n"), (F.lit(1000).cast("decimal(4,0)") * big("a") * big("total")).alias("up"), (big("l") * big("r")).alias("down"))
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("path").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
