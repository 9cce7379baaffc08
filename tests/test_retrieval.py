"""Ranking of chunks against plain loops: BM25 of many queries, fusion by text, diversity, ranks with graph nodes."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.operators import retrieval as R

RNG = np.random.default_rng(5)
WORDS = ["the", "pump", "Valve", "seal", "leak", "p-101", "oil", "is", "hot", "rare"]
WEIGHTS = np.array([30, 8, 8, 6, 5, 3, 5, 20, 4, 1]) / 90
CHUNKS = [(i, " ".join(RNG.choice(WORDS, RNG.integers(1, 25), p=WEIGHTS))) for i in range(60)]
CHUNKS += [(60, None), (61, ""), (62, "  \n"), (63, CHUNKS[0][1]), (64, CHUNKS[0][1] + " ")]
QUERIES = [(i, " ".join(RNG.choice(WORDS, 3))) for i in range(20)] + [(20, "seal seal leak"), (21, "nothing here"), (22, ""), (23, None), (24, "THE the")]


def bm25_by_hand():
    texts = {i: (t or "").lower().split() for i, t in CHUNKS}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, said in QUERIES:
        for i, t in texts.items():
            tf = Counter(t)
            s = sum((raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in (said or "").lower().split() if tf[w])
            if s > 0:
                out[q, i] = s
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(*c, 1, "x") for c in CHUNKS], "id long, text string, n int, t string"), spark.createDataFrame([(*q, 2.0) for q in QUERIES], "query_id long, query string, len double")


def test_bm25(tables):
    want = bm25_by_hand()
    got = {(r.query_id, r.id): r.score for r in R.bm25(*tables).collect()}
    assert got.keys() == want.keys() and len({q for q, _ in got}) > 15
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_chunks_or_queries(tables):
    chunks, queries = tables
    assert R.bm25(chunks.where("id < 0"), queries).count() == 0
    assert R.bm25(chunks, queries.where("query_id < 0")).count() == 0


def test_fusion_by_text(tables):
    chunks, queries = tables
    one = R.top_k(R.bm25(chunks, queries), 30)
    two = R.top_k(R.bm25(chunks, queries.selectExpr("query_id", "concat(query, ' pump') as query")), 30)
    texts = {i: t.strip(" ") for i, t in CHUNKS if t and t.strip(" ")}
    score, first = defaultdict(float), {}
    for arm in (one, two):
        best = {}
        for r in arm.collect():
            if r.id in texts:
                key = (r.query_id, texts[r.id])
                best[key] = min(best.get(key, r["rank"]), r["rank"])
                first[key] = min(first.get(key, r.id), r.id)
        for key, rank in best.items():
            score[key] += 1 / (60 + rank)
    got = {(r.query_id, r.text): (r.id, r.rrf) for r in R.fuse(chunks, one, two).collect()}
    assert got.keys() == score.keys() and len({i for i, _ in got.values()}) < len(got)
    assert all(got[k][0] == first[k] and abs(got[k][1] - score[k]) < 1e-12 for k in score)
    assert all(i not in (63, 64) for i, _ in got.values())  # the first of equal texts stands for them


def unit(v):
    size = math.sqrt(sum(x * x for x in v))
    return [x / max(size, 1e-12) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def test_diversity(spark):
    rows = []
    for q in range(4):
        asked = [float(x) for x in RNG.normal(size=6)]
        rows += [(q, i, [float(x) for x in RNG.normal(size=6)], asked) for i in RNG.permutation(25).tolist()]
        rows += [(q, 90, rows[-1][2], asked), (q, 91, rows[-2][2], asked), (q, 92, None, asked)]
    rows += [(7, 2, [1.0, 0.0], [1.0, 0.0]), (7, 1, [1.0, 0.0], [1.0, 0.0]), (7, 3, [0.0, 1.0], [1.0, 0.0]), (8, 5, [1.0, 2.0], None), (8, 4, None, None), (9, 1, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "query_id long, id long, embedding array<double>, query_vector array<double>, place string")
    want = {}
    for q in {r[0] for r in rows}:
        size = 6 if q < 4 else 2 if q < 9 else 1
        mine = {r[1]: unit(r[2] or [0.0] * size) for r in rows if r[0] == q}
        near = {i: dot(v, unit(next(r[3] for r in rows if r[0] == q) or [0.0] * size)) for i, v in mine.items()}
        taken = []
        while len(taken) < min(10, len(mine)):
            value = {i: round(0.6 * near[i] - 0.4 * max((dot(v, mine[c]) for c in taken), default=0), 12) if taken else round(near[i], 12) for i, v in mine.items() if i not in taken}
            taken.append(min(value, key=lambda i: (-value[i], i)))
        want[q] = taken
    got = defaultdict(list)
    for r in R.mmr(df, 10).orderBy("query_id", "place").collect():
        assert r.place == len(got[r.query_id])
        got[r.query_id].append(r.id)
    assert got == want and got[7] == [1, 2, 3]
    assert R.mmr(df.where("id < 0"), 10).count() == 0


def test_ranks_with_graph_nodes(spark):
    ranked = [(q, i, round(float(RNG.random()), 3)) for q in range(5) for i in range(9)] + [(6, 1, 0.5), (6, 2, 0.5)]
    nodes = [(f"n{i:02}", [1.0, 0.5][i % 2], None if i % 4 == 0 else round(float(RNG.random()), 3)) for i in range(30)]
    got = defaultdict(dict)
    for r in R.hybrid_rank(spark.createDataFrame(ranked, "query_id long, id long, score double"), spark.createDataFrame(nodes, "node_id string, score double, rank double")).collect():
        got[r.query_id][r.item] = r.score
    graph = [(n, 0.15 * s + 0.35 * (r or 0.0)) for n, s, r in nodes]
    for q in {r[0] for r in ranked}:
        both = [(str(i), s) for x, i, s in ranked if x == q] + graph
        want = dict(sorted(both, key=lambda x: (-x[1], x[0]))[:12])
        assert got[q].keys() == want.keys() and all(abs(got[q][k] - want[k]) < 1e-12 for k in want)
