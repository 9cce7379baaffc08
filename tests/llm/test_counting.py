"""Corpus counts over several levels against plain sums, the rows that they move, and operators that use them."""

from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import backoff_lm, counting, set_join


def made():
    """hashes, as a function that tasks get whole: they can't import this module."""

    def hashes(block: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of a block and counts: one that all blocks have, the least and largest value, common and own ones. Each fifth block is empty."""
        if block % 5 == 4:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rng = np.random.default_rng(block)
        common = np.random.default_rng(99).integers(0, 2**64, 200, np.uint64)
        keys = np.unique(np.concatenate([common[rng.random(200) < 0.3], rng.integers(0, 2**64, 20, np.uint64), np.array([0, 7, 2**64 - 1], np.uint64)]))
        return keys, rng.integers(0, 2**31, len(keys)) * (rng.random(len(keys)) < 0.8)

    return hashes


hashes = made()


@pytest.mark.parametrize(("blocks", "buckets", "fan", "levels"), [(1, 1, 1024, 1), (9, 4, 16, 1), (37, 20, 7, 2), (30, 25, 3, 4)])
def test_totals(spark, blocks, buckets, fan, levels):
    assert counting.shape(blocks, buckets, fan)[0] == levels
    df, hashes = spark.range(blocks).selectExpr("cast(id as int) as block"), made()
    out = counting.totals(df, blocks, lambda rows: hashes(int(rows["block"].iloc[0])), buckets, kind=np.uint64(1), fan=fan).toPandas()
    want = Counter()
    for b in range(blocks):
        for k, c in zip(*hashes(b), strict=True):
            want[int(k)] += int(c)
    for b in range(blocks):
        keys = hashes(b)[0]
        assert counting.in_order(out[out["block"] == b], len(keys)).tolist() == [want[int(k)] for k in keys]
    odd = [c for k, c in want.items() if k % 2 and c]
    ends = out[out["block"] < 0]
    assert (ends["kinds"].sum(), ends["occurrences"].sum()) == (len(odd), sum(odd))


def test_no_rows(spark):
    df, hashes = spark.createDataFrame([], "block int"), made()
    assert counting.totals(df, 40, lambda rows: hashes(0), 30, fan=4).count() == 0


def test_rows_grow_with_blocks():
    for blocks in (10**3, 10**5, 10**7, 33 * 10**6):
        levels, group, parts = counting.shape(blocks, blocks // 2, counting.FAN)
        assert group <= counting.FAN and parts <= counting.FAN
        assert group**levels >= blocks and parts**levels >= blocks // 2
        assert counting.most_rows(blocks, blocks // 2, counting.FAN) <= 1.1 * levels * counting.FAN * blocks
    assert [counting.shape(n, n // 2, counting.FAN)[0] for n in (1024, 1025, 2**20, 2**20 + 1)] == [1, 2, 2, 3]


def test_root_of():
    for levels in (1, 2, 3, 4):
        for n in (1, 2, 3, 7, 8, 9, 80, 81, 82, 10**6, 10**9 + 1):
            r = counting.root_of(n, levels)
            assert r**levels >= n and (r == 1 or (r - 1) ** levels < n)


def test_levels_change_no_result(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(24)]
    texts += [f"{t} more" for t in texts[:6]] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = docs.selectExpr("*", "doc_id % 7 = 2 as held_out")
    results = []
    for fan, size in ((1024, 1 << 20), (2, 400)):
        monkeypatch.setattr(counting, "FAN", fan)
        monkeypatch.setattr(counting, "BUCKET_HASHES", size)
        for m in (set_join, backoff_lm):
            monkeypatch.setattr(m, "BUCKET_HASHES", size)
        a = set_join.components(docs, 3, 80, size)
        b = backoff_lm.score(held, block_bytes=size)
        results.append(({tuple(r) for r in a.collect()}, {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect()}))
    assert results[0] == results[1]
    assert any(r[2] != r[0] for r in results[0][0])
