"""Jaccard join of documents' shingle sets, with set relations to skip work, and the components of its links.

1. Equal sets are one set. Its copies never meet.
2. All sets share one order of shingles: rare first, by corpus counts (`counting.totals`). Two sets that are
   similar enough share a shingle within both prefixes, of n - ceil(t n) + 1 shingles. Shingles that only one
   document has can't be shared and are left out, so that most documents without a partner send nothing.
3. The index lists (shingle, size band) hold sets whose sizes allow a link; the places of the shingle in two
   sets bound their overlap. Each list is compared with a few pivots at first, so a family of near copies of any
   size takes some rows for each member, not one for each two; members of one component need no more.
4. The lists that still span components are sorted by place and cut into blocks of about LIST_BLOCK sets. Two blocks
   are skipped whole if their places and sizes leave no room for a link, or if one component has both. What
   is left is dealt by pairs of blocks, so no list has to meet in one task. Parity bitmaps, which bound from below
   what two sets differ by, rule most pairs out there.
5. Answers are derived from those computed before: two sets differ by at least the difference of what each differs
   by from a third. Only pairs that no such answer rules out are compared shingle by shingle. So no link between
   components is lost.

Null, empty and white-space texts have an empty set, linked with nothing. Equal ids are kept as rows of their
own. A null id is never a component's smallest; a component of null ids only has a null one. Empty tables
give no rows. Extra columns are not read. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_of, cut, in_blocks, release, text_bytes, text_of
from .counting import BUCKET_HASHES, answers_for, distinct, in_order, totals
from .textvec import shingle_sets

WORDS = 3
#: Least similarity in hundredths.
PERCENT = 90
BLOCK_BYTES = 3 << 20
#: Pivots of each list in a round, and rounds; later rounds only see lists that still span components.
PIVOTS, ROUNDS = 6, 2
#: Answers of each set that others' answers are derived from.
THIRDS = 8
#: Sets of one block of a list, about.
LIST_BLOCK = 1000
#: Packed bytes of texts whose sets are in memory at once when pairs are compared.
PAIR_BYTES = 512 << 10
#: Longs of a set's parity bitmap.
LONGS = 16


def shortened(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of sorted hashes. Hashes that meet there count as one, which only changes the order."""
    return hashes & np.uint64((2**64 - 1) ^ (2 ** (64 - bits) - 1))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of the bitmap's places, whether an odd number of shingles falls there.

    Two sets' bitmaps differ in at most as many places as the sets differ in elements.
    """
    odd = np.bincount((shingles & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which one is shared with every set that is similar enough; 0 if only an equal set is."""
    if n * 100 // percent == n:
        return 0
    return n - -(-percent * n // 100) + 1


PREPARED = "doc_id long, check long, n long, node binary, tokens array<long>, places array<int>, parity array<long>, z binary"


def prepare(docs: DataFrame, words: int, percent: int, block_bytes: int) -> DataFrame:
    """One row for each document; tokens, places and z only for the first of a set in its block, and only if
    its prefix has a shingle that other documents have too."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("check"))
    size = text_bytes(source)
    number = blocks_of(size, block_bytes)
    blocks = in_blocks(source, number, "doc_id", "check")
    bits = min(64, 13 + math.ceil(math.log2(max(2, size / 5))))
    buckets = max(1, size // 6 // BUCKET_HASHES)

    def of(rows: pd.DataFrame) -> list[np.ndarray]:
        return shingle_sets([text_of(z) for z in rows["z"]], words)[0]

    def ask(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sets = of(rows)
        return distinct(shortened(np.concatenate(sets), bits))

    answers = totals(blocks, number, ask, buckets)

    def prefixes(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        sets = of(rows)
        keys = distinct(shortened(np.concatenate(sets), bits))[0]
        count = in_order(got, len(keys))
        seen: set[bytes] = set()
        made = []
        for doc_id, check, z, s in zip(rows["doc_id"], rows["check"], rows["z"], sets, strict=True):
            node = set_digest(s)
            n, row = len(s), (None, None, None, None)
            p = prefix_size(n, percent)
            if p and node not in seen:
                seen.add(node)
                often = count[np.searchsorted(keys, shortened(s, bits))]
                if p < n:  # the p first in order of (count, hash)
                    near = np.flatnonzero(often <= np.partition(often, p - 1)[p - 1])
                else:
                    near = np.arange(n)
                order = near[np.lexsort((s[near], often[near]))][:p]
                shared = np.flatnonzero(often[order] > 1)
                if len(shared):
                    row = (s[order[shared]].view(np.int64), shared.astype(np.int32), parity(s), z)
            made.append((doc_id, check, n, node, *row))
        out = pd.DataFrame(made, columns=[x.split()[0] for x in PREPARED.split(", ")])
        del sets, keys, count
        release()
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return cut(blocks.groupBy("block").cogroup(answers_for(answers).groupBy("block")).applyInPandas(prefixes, PREPARED))


def _band(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent))).cast("int")


def _lists(sets: DataFrame, percent: int) -> DataFrame:
    """(token, band, place, node, n): every set stands in the lists of its own size band and the next."""
    band = _band(F.col("n"), percent)
    return sets.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t"), band.alias("b")).select(F.col("t.tokens").alias("token"), F.explode(F.array("b", F.col("b") + 1)).alias("band"), F.col("t.places").alias("place"), "node", "n")


def _can_link(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sizes and places of a shared shingle leave room for enough overlap."""
    overlap = F.least(i, j) + 1 + F.least(n - 1 - i, m - 1 - j)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * overlap >= percent * (n + m))


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose sizes add up to about `most`; one row at least."""
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _compare(pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, differ, linked) of pairs (a, b) of nodes, from their whole texts; differ counts the shingles that only one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = sum(pc.binary_length(whole.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            for batch in slices(whole, sizes, PAIR_BYTES):
                a, b, za, zb = (batch.column(i).to_pylist() for i in range(4))
                texts = dict(zip(a, za, strict=True)) | dict(zip(b, zb, strict=True))
                made = dict(zip(texts, shingle_sets([text_of(z) for z in texts.values()], words)[0], strict=True))
                differ, linked = [], []
                for x, y in zip(a, b, strict=True):
                    s, t = made[x], made[y]
                    both = np.concatenate([s, t])
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    differ.append(len(both) - 2 * same)
                    linked.append(100 * same >= percent * (len(both) - same))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(differ, pa.int32()), pa.array(linked, pa.bool_())], names=["a", "b", "differ", "linked"])
            release()

    text = sets.select("node", "z")
    both = pairs.join(text.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(text.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    return cut(both.select("a", "b", "za", "zb").mapInArrow(run, "a binary, b binary, differ int, linked boolean"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of edges (a, b), by contraction.

    In a round every node points to its smallest neighbour, pointers jump to their ends, and the ends become the nodes of the
    edges that are left. So an edge within what has come together is not moved again, however many rounds others take.
    """
    edges = cut(edges.select("a", "b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
        moved = True
        while moved:
            up = to.select(F.col("node").alias("label"), F.col("label").alias("above"))
            jumped = cut(to.select("node", "label").join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") < F.col("label")).alias("moved")))
            moved, to = not jumped.where("moved").isEmpty(), jumped.select("node", "label")
        labels = to if labels is None else cut(_relabelled(labels, to))
        edges = cut(_between(edges, to))
    return labels


def _relabelled(labels: DataFrame, to: DataFrame) -> DataFrame:
    """labels (node, label) with the labels of those labels in `to`, where they have one."""
    return labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct edges (a, b) between the labels of the given edges' ends; an end without a label stands for itself."""
    of_a, of_b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
    ends = edges.join(of_a, "a", "left").select(F.coalesce("la", "a").alias("a"), "b").join(of_b, "b", "left").select("a", F.coalesce("lb", "b").alias("b"))
    return ends.where("a <> b").distinct()


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels, as of `connected`, when edges (a, b) are added: only those between components are looked at again."""
    more = connected(_between(edges, labels))
    new = more.select("node").join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return cut(_relabelled(labels.unionByName(new), more))


def _pivots(lists: DataFrame, seeds: range) -> DataFrame:
    """(token, band, ps): one row for each list, whatever its length; ps are its sets that hash least under each seed."""
    return lists.groupBy("token", "band").agg(F.array(*(F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), "node", "n", "place")) for i in seeds)).alias("ps"))


def links(prepared: DataFrame, words: int = WORDS, percent: int = PERCENT, pivots: int = PIVOTS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(compared pairs of nodes with differ and linked, labels of the components of the linked ones)."""
    own = prepared.where(F.col("z").isNotNull()).groupBy("node").agg(F.min_by(F.struct("n", "tokens", "places", "parity", "z"), F.xxhash64("doc_id")).alias("s"))
    sets = cut(own.select("node", "s.*"))
    lists = _lists(sets, percent)
    crowded = lists.groupBy("token", "band").agg(F.count("*").alias("c")).where("c > 1").select("token", "band")
    lists = cut(lists.join(crowded, ["token", "band"], "left_semi"))
    done = labels = None
    for r in range(rounds):
        chosen = _pivots(lists, range(r * pivots, (r + 1) * pivots))
        able = F.filter(F.array_distinct("ps"), lambda p: (p["node"] != F.col("node")) & _can_link(F.col("n"), p["n"], F.col("place"), p["place"], percent))
        pairs = lists.join(chosen, ["token", "band"]).select("node", F.explode(able).alias("p")).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        if done is None:
            done = _compare(pairs, sets, words, percent)
            labels = connected(done.where("linked"))
        else:
            more = _compare(_apart(pairs, labels).join(done, ["a", "b"], "left_anti"), sets, words, percent)
            done = done.unionByName(more)
            labels = joined_labels(labels, more.where("linked"))
        labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = labelled.groupBy("token", "band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token", "band")
        lists = cut(lists.join(mixed, ["token", "band"], "left_semi"))
    last = _compare(_undecided(lists, sets, labels, done, percent), sets, words, percent)
    done = done.unionByName(last)
    if not last.where("linked").isEmpty():
        labels = joined_labels(labels, last.where("linked"))
    return done, labels


def _undecided(lists: DataFrame, sets: DataFrame, labels: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one list and different components that no bound rules out and that weren't compared."""
    lists = cut(lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    # blocks of neighbouring places; a list has no more rows here than places, and a crowded place has several parts
    crowd = lists.groupBy("token", "band", "place").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("token", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crowd = crowd.select("token", "band", "place", F.floor(before / LIST_BLOCK).cast("int").alias("block"), F.ceil(F.col("c") / LIST_BLOCK).alias("parts"))
    held = cut(lists.join(crowd, ["token", "band", "place"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("n", "place", "label") for f in (F.min, F.max)]
    blocks = cut(held.groupBy("token", "band", "block", "part").agg(*ends))
    p, q = blocks.alias("p"), blocks.alias("q")
    room = F.least("p.max_place", "q.max_place") + 1 + F.least(F.col("p.max_n") - 1 - F.col("p.min_place"), F.col("q.max_n") - 1 - F.col("q.min_place"))
    able = (100 * F.least("p.max_n", "q.max_n") >= percent * F.greatest("p.min_n", "q.min_n")) & ((100 + percent) * room >= percent * (F.col("p.min_n") + F.col("q.min_n")))
    several = F.least("p.min_label", "q.min_label") < F.greatest("p.max_label", "q.max_label")
    order = F.struct("p.block", "p.part") <= F.struct("q.block", "q.part")
    meet = p.join(q, [F.col("p.token") == F.col("q.token"), F.col("p.band") == F.col("q.band"), order, able, several])
    meet = cut(meet.select("p.token", "p.band", "p.block", "p.part", F.col("q.block").alias("q_block"), F.col("q.part").alias("q_part")))
    met = meet.select("token", "band", F.col("q_block").alias("block"), F.col("q_part").alias("part")).distinct()
    bits = sets.select("node", "tokens", *(F.element_at("parity", i + 1).alias(f"w{i}") for i in range(LONGS)))
    x = held.join(meet, ["token", "band", "block", "part"]).join(bits, "node").alias("x")
    y = held.join(met, ["token", "band", "block", "part"], "left_semi").join(bits, "node").alias("y")
    apart = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(LONGS)), F.lit(0))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    # a pair is met in the list of its first common shingle and larger band only; both orders of tokens are the same
    first = (F.element_at(F.array_intersect("x.tokens", "y.tokens"), 1) == F.col("x.token")) & (F.col("x.band") == F.greatest(_band(F.col("x.n"), percent), _band(F.col("y.n"), percent)))
    once = (F.col("x.block") != F.col("y.block")) | (F.col("x.part") != F.col("y.part")) | (F.col("x.node") < F.col("y.node"))
    on = [F.col("x.token") == F.col("y.token"), F.col("x.band") == F.col("y.band"), F.col("x.q_block") == F.col("y.block"), F.col("x.q_part") == F.col("y.part")]
    pairs = x.join(y, [*on, once, F.col("x.label") != F.col("y.label"), _can_link(F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place"), percent), near, first])
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), (F.col("x.n") + F.col("y.n")).alias("size")).distinct()
    return _not_derived(cut(pairs.join(done, ["a", "b"], "left_anti")), done, percent)


def _not_derived(pairs: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose answer doesn't follow from answers to one of both: what a and b differ by is at least the
    difference of what each differs by from a third set."""
    known = done.select(F.col("a").alias("node"), F.col("b").alias("third"), "differ").unionByName(done.select(F.col("b").alias("node"), F.col("a").alias("third"), "differ"))
    # of each node one answer for each seed, whatever their number: sets that share partners mostly keep the same ones
    kept = known.groupBy("node").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "third").alias("h"), "third", "differ")).alias(f"t{i}") for i in range(THIRDS)))
    of_a, of_b = (kept.select(F.col("node").alias(c), *(F.col(f"t{i}").alias(f"{c}{i}") for i in range(THIRDS))) for c in ("a", "b"))
    far = F.lit(False)
    for i in range(THIRDS):
        apart = F.abs(F.col(f"a{i}.differ") - F.col(f"b{i}.differ"))
        far |= F.coalesce((F.col(f"a{i}.third") == F.col(f"b{i}.third")) & ((100 + percent) * apart > (100 - percent) * F.col("size")), F.lit(False))
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(~far).select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes aren't in one component yet: the others' answers follow from what is known."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") != F.col("lb"))).select("a", "b")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    prepared = prepare(docs, words, percent, block_bytes)
    _, labels = links(prepared, words, percent)
    rows = prepared.where("n > 0").select("doc_id", "n", "node").join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("root"))
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = rows.join(smallest, "root").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(prepared.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: one with the smallest id. Rows without an id stay.

    Rows are told apart by id and text, so rows that share an id go or stay by their own texts.
    """
    prepared = prepare(docs, words, percent, BLOCK_BYTES)
    _, labels = links(prepared, words, percent)
    rows = prepared.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "check", "node").join(labels, "node", "left")
    first = rows.groupBy(F.coalesce("label", "node").alias("root")).agg(F.min(F.struct("doc_id", "check")).alias("m"))
    empty = prepared.where("doc_id IS NOT NULL AND n = 0").select("doc_id", "check")
    own = first.select("m.doc_id", "m.check").unionByName(empty).withColumnRenamed("check", "_check").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).withColumn("_check", F.xxhash64("text")).join(own, ["doc_id", "_check"], "left_semi").dropDuplicates(["doc_id", "_check"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
