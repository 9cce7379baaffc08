"""Retrieval over chunks: BM25, exact vector search, rank fusion, diversity, reranking, compression.

Queries are a table. They meet the chunks by term, or as vectors in blocks of a bounded number, each a pass over the
chunks; the chunks are never collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TAG, intent
from ..session import checkpointed
from ..vocab import INTENT_SECTIONS

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score > 0. chunks: id, text; queries: query_id, query.

    Only terms of the queries are counted by document; length, number and negative-idf statistics are over
    all chunks. Repeated query terms count repeatedly.
    """
    words = chunks.select("id", terms(F.coalesce("text", F.lit(""))).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg_len"))
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("times"))
    df = words.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(stats)).select("t", raw.alias("raw"))
    mean = idf.agg((EPSILON * F.avg("raw")).alias("floor"))
    needed = asked.select("t").distinct()
    weight = idf.join(needed, "t", "left_semi").crossJoin(F.broadcast(mean)).select("t", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    tf = words.select("id", F.size("w").alias("len"), F.explode("w").alias("t")).join(needed, "t", "left_semi").groupBy("id", "len", "t").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(weight, "t").join(asked, "t").crossJoin(F.broadcast(stats)).groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return scored.where("score > 0")


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query, ties by id, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(vector: Column, query: list[float]) -> Column:
    """Similarity of a column with a literal vector, in the JVM."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm * F.lit(float(np.linalg.norm(query))))


def dense(vectors: DataFrame, query: list[float], k: int, id_column: str = "vec_id") -> DataFrame:
    """Exact nearest neighbours by cosine: one scan, then the k best of each task meet."""
    return vectors.where(F.col("embedding").isNotNull()).select(F.col(id_column).alias("id"), cosine(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Query vectors of one pass over the vectors.
BLOCK = 4096


def dense_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of the k nearest of each query. vectors: id, embedding; queries: query_id, embedding.

    Exact: a block of queries is a matrix that every batch of vectors is multiplied with; each batch gives its k best.
    """
    queries = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    n = max(1, -(-queries.count() // BLOCK))
    vectors = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    found = None
    for b in range(n):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).collect()
        if not mine:
            continue
        ids = np.array([r["query_id"] for r in mine])
        matrix = np.array([r["embedding"] for r in mine], float)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

        def run(frames: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = np.stack(f["embedding"].to_numpy()).astype(float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                f = f.assign(order=f["id"].rank(method="first"))
                for i, near in zip(ids, matrix @ x.T, strict=True):
                    best = np.lexsort((f["order"], -near))[:k]
                    yield pd.DataFrame({"query_id": i, "id": f["id"].to_numpy()[best], "score": near[best]})

        part = vectors.mapInPandas(run, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return top_k(found, k)


def rrf(*ranked: DataFrame, key: list[str] | str = "id") -> DataFrame:
    """Reciprocal rank fusion of frames with the key's columns and rank (from 1)."""
    key = [key] if isinstance(key, str) else key
    arms = [r.select(*key, (1.0 / (RRF_K + F.col("rank"))).alias("s")) for r in ranked]
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out.groupBy(*key).agg(F.sum("s").alias("rrf"))


def fuse(chunks: DataFrame, *ranked: DataFrame) -> DataFrame:
    """query_id, text, id, rrf: fusion by text, as equal texts are one answer; the smallest id stands for them."""
    texts = chunks.select("id", F.trim("text").alias("text")).where("text <> ''")
    arms = [r.select("query_id", "id", "rank").join(texts, "id").groupBy("query_id", "text").agg(F.min("rank").alias("rank"), F.min("id").alias("id")) for r in ranked]
    ids = arms[0].select("query_id", "text", "id")
    for a in arms[1:]:
        ids = ids.unionByName(a.select("query_id", "text", "id"))
    ids = ids.groupBy("query_id", "text").agg(F.min("id").alias("id"))
    return rrf(*arms, key=["query_id", "text"]).join(ids, ["query_id", "text"])


def section_filter(found: DataFrame, chunks: DataFrame, queries: DataFrame, kind: Column | None = None) -> DataFrame:
    """found without chunks whose section_type doesn't go with the query's intent (or the given one); other intents take any."""
    allowed = F.coalesce(*(F.when(F.col("intent") == k, F.col("section_type").isin(v)) for k, v in INTENT_SECTIONS.items()), F.lit(True))
    kinds = chunks.select("id", F.coalesce("section_type", F.lit("general")).alias("section_type"))
    asked = queries.select("query_id", (intent(F.col("query")) if kind is None else kind).alias("intent"))
    return found.join(kinds, "id").join(asked, "query_id").where(allowed).drop("section_type", "intent")


def mmr(candidates: DataFrame, k: int, weight: float = 0.6) -> DataFrame:
    """query_id, id, place: greedy choice of similar yet diverse candidates (query_id, id, embedding, query_vector).

    Candidates are the few tens that earlier steps left of each query. One without a vector is like nothing.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        q = rows["query_vector"].iloc[0]
        size = len(q) if q is not None else next((len(e) for e in rows["embedding"] if e is not None), 1)
        m = np.array([e if e is not None else np.zeros(size) for e in rows["embedding"]], float)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        q = np.zeros(size) if q is None else np.asarray(q, float)
        near = m @ (q / max(np.linalg.norm(q), 1e-12))
        chosen = [int(near.argmax())]
        while len(chosen) < min(k, len(m)):
            value = weight * near - (1 - weight) * (m @ m[chosen].T).max(axis=1)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "id": rows["id"].iloc[chosen].to_numpy(), "place": range(len(chosen))})

    return candidates.select("query_id", "id", "embedding", "query_vector").groupBy("query_id").applyInPandas(pick, "query_id long, id long, place long")


def graph_chunks(found: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: int = 5, limit: int = 50) -> DataFrame:
    """query_id, node_id, text: what the graph says of the tags in a query and its chunks (query_id, text).

    The first `seeds` tags in order name the nodes; their neighbours come along, `limit` nodes for each query.
    """
    tags = lambda c: F.regexp_extract_all(c, F.lit(TAG), F.lit(1))
    said = found.select("query_id", F.explode(tags(F.col("text"))).alias("tag")).unionByName(queries.select("query_id", F.explode(tags(F.col("query"))).alias("tag"))).distinct()
    said = said.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("tag"))).where(F.col("n") <= seeds)
    named = nodes.select("node_id", F.explode(F.array_distinct(F.concat(tags(F.col("name")), F.array("name")))).alias("tag"))
    start = said.join(named, "tag").select("query_id", "node_id").distinct()
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    near = start.join(both, "node_id").select("query_id", F.col("other").alias("node_id"))
    rows = start.withColumn("hops", F.lit(0)).unionByName(near.withColumn("hops", F.lit(1))).groupBy("query_id", "node_id").agg(F.min("hops").alias("hops")).join(nodes.select("node_id", "name", "label"), "node_id")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("hops", "node_id"))).where(F.col("n") <= limit)
    return rows.select("query_id", "node_id", F.concat(F.lit("Graph Node ("), "label", F.lit("): "), "name", F.lit(".")).alias("text"))


def query_words(query: Column) -> Column:
    """A query's distinct words of three letters and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w{3,})"), F.lit(1)))


def overlap_of(words: Column, text: Column) -> Column:
    """Share of the words that a text has; 0 without words."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(query_words(text), words)) / F.size(words)).otherwise(F.lit(0.0))


def overlap(query: str, text: Column) -> Column:
    """Share of a given query's words that a text has."""
    return overlap_of(query_words(F.lit(query)), text)


def rerank(ranked: DataFrame, query: str, k: int) -> DataFrame:
    """The default reranker: by keyword overlap, then by the rank before."""
    return ranked.withColumn("rerank", overlap(query, F.col("text"))).orderBy(F.desc("rerank"), "rank", "id").limit(k)


def compress(chunks: DataFrame, query: str | None = None, least: float = 0.2) -> DataFrame:
    """id, text of the sentences whose overlap with the query (or each row's `words`) reaches least; at least the best two, in their order.

    Texts under 50 words or 3 sentences stay whole.
    """
    if query is not None:
        chunks = chunks.withColumn("words", query_words(F.lit(query)))
    sentences = F.split("text", r"(?<=[.!?]) +")
    short = (F.size(terms(F.col("text"))) < 50) | (F.size(sentences) < 3)
    rows = chunks.where(~short).select("id", "words", F.posexplode(sentences).alias("i", "s")).withColumn("o", overlap_of(F.col("words"), F.col("s")))
    w = Window.partitionBy("id").orderBy(F.desc("o"), "i")
    kept = rows.withColumn("r", F.row_number().over(w)).where((F.col("o") >= least) | (F.col("r") <= 2))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ")
    return kept.groupBy("id").agg(text.alias("text")).unionByName(chunks.where(short).select("id", "text"))


def hybrid_rank(ranked: DataFrame, graph_nodes: DataFrame, top: int = 12) -> DataFrame:
    """query_id, item, score: a query's chunks keep their score; graph nodes (the same for all queries) score 0.15 * proximity + 0.35 * pagerank."""
    nodes = graph_nodes.select(F.col("node_id").alias("item"), (0.15 * F.col("score") + 0.35 * F.coalesce("rank", F.lit(0.0))).alias("score"))
    nodes = top_k(nodes.withColumn("one", F.lit(1)).withColumnRenamed("item", "id"), top, "one").select(F.col("id").alias("item"), "score")  # others can't be among the best
    both = ranked.select("query_id", F.col("id").cast("string").alias("item"), "score").unionByName(ranked.select("query_id").distinct().crossJoin(F.broadcast(nodes)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item"))).where(F.col("_r") <= top).drop("_r")


def fulltext(nodes: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Nodes whose name, without case, hyphens and spaces, holds the term or lies in it."""
    t = re.sub("[- ]", "", term.lower())
    n = F.regexp_replace(F.lower("name"), "[- ]", "")
    return nodes.where(F.contains(n, F.lit(t)) | F.contains(F.lit(t), n)).select("node_id", "name", "label").orderBy("node_id").limit(limit)


def merge_queries(found: DataFrame, top: int = 8) -> DataFrame:
    """Chunks that several queries found (id, rerank, rrf): each once, the best first."""
    each = found.groupBy("id").agg(F.max(F.struct("rerank", "rrf")).alias("b"), F.min("text").alias("text"))
    return each.select("id", "text", "b.rerank", "b.rrf").orderBy(F.desc("rerank"), F.desc("rrf"), "id").limit(top)


def citations(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """query_id, citation, id, snippet: the position of each chunk from documents in the whole ranking, and its first 180 characters."""
    w = Window.partitionBy(by).orderBy(F.desc("rerank"), F.desc("rrf"), "item")
    rows = ranked.withColumn("citation", F.row_number().over(w)).where("id IS NOT NULL")
    return rows.select(by, "citation", "id", F.concat(F.substring("text", 1, 180), F.lit("...")).alias("snippet"))


def retrieve(chunks: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 20, top: int = 8, kind: Column | None = None) -> DataFrame:
    """query_id, item, id, text, rrf, rerank: the whole path for each query (query_id, query, embedding); kind: an intent for all.

    chunks: id, text, embedding, section_type. Dense search within the sections that go with the query's intent, BM25, fusion by
    text, diversity, graph nodes of the tags met, rerank by words, compression. id is null for graph nodes; item
    names both.
    """
    near = section_filter(dense_many(chunks, queries, k), chunks, queries, kind)
    near = top_k(near.drop("rank"), k)
    fused = checkpointed(fuse(chunks, near, top_k(bm25(chunks, queries), k)))
    asked = queries.select("query_id", "query", F.col("embedding").alias("query_vector"))
    vectors = chunks.select("id", "embedding")
    diverse = mmr(fused.join(vectors, "id").join(asked, "query_id"), k)
    chosen = checkpointed(fused.join(diverse, ["query_id", "id"]))
    extra = graph_chunks(chosen, queries, nodes, edges)
    items = chosen.select("query_id", F.concat(F.lit("chunk_"), F.col("id").cast("string")).alias("item"), "id", "text", "rrf", "place")
    items = items.unionByName(extra.select("query_id", F.concat(F.lit("graph_"), "node_id").alias("item"), F.lit(None).cast("long").alias("id"), "text", F.lit(0.0).alias("rrf"), F.lit(k).cast("long").alias("place")))
    scored = items.join(asked.select("query_id", query_words(F.col("query")).alias("words")), "query_id").withColumn("rerank", overlap_of(F.col("words"), F.col("text")))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "place", "item"))).where(F.col("_r") <= top)
    short = compress(best.select(F.struct("query_id", "item").alias("id"), "text", "words"))
    return best.drop("text").join(short.select("id.query_id", "id.item", "text"), ["query_id", "item"]).select("query_id", "item", "id", "text", "rrf", "rerank")


def recall_at(got: DataFrame, good: DataFrame, ks: list[int]) -> DataFrame:
    """k, recall, queries: the mean share of a query's relevant rows (query_id, id) among the first k got (query_id, id, rank). Queries
    without relevant rows have no recall and don't count."""
    good = good.select("query_id", "id").distinct()
    rank = good.join(got.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), ["query_id", "id"], "left")
    per = rank.select("query_id", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k")).groupBy("query_id", "k").agg((F.count_if(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))) / F.count("*")).alias("recall"))
    return per.groupBy("k").agg(F.avg("recall").alias("recall"), F.count("*").alias("queries"))
