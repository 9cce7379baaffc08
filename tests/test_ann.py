"""The vector index against exact search."""

from pyspark.sql import functions as F

from loomgraph.operators import ann, retrieval


def test_recall_and_rows_read(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in retrieval.dense_many(vectors, queries, 10).collect()}
    centroids = ann.fit(vectors)
    lists = ann.assign(vectors, centroids)
    assert lists.count() == vectors.where("embedding IS NOT NULL").count()
    got = {(r.query_id, r.id) for r in ann.search(lists, centroids, queries, 10).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)
    read = ann.probes(queries, centroids).join(lists, "list").count()
    assert read < 0.75 * queries.count() * lists.count()
    every = {(r.query_id, r.id) for r in ann.search(lists, centroids, queries, 10, share=1.0).collect()}
    assert len(every & exact) >= len(exact) - 2  # ties in the last digits


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id long, embedding array<double>")
    q = df.withColumnRenamed("id", "query_id")
    centroids = ann.fit(df)
    got = ann.search(ann.assign(df, centroids), centroids, q, 2).where("query_id = 1").collect()
    assert sorted(r.id for r in got) == [1, 4]
    none = df.where("false")
    assert ann.search(ann.assign(none, ann.fit(none)), ann.fit(none), q, 2).collect() == []
