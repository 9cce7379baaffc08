"""Single nodes, deletes, merged answers, reports and case files; windows and sessions as streams against batches."""

import datetime
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loomgraph.operators import dml, graph, retrieval
from loomgraph.sources import files
from loomgraph.streaming import jobs


def test_find_and_delete_nodes(spark):
    nodes = spark.createDataFrame([("b", "Equipment", "P-1"), ("a", "Equipment", "P-1"), ("c", "SOP", "P-1"), ("d", "SOP", None), (None, "SOP", "x")], "node_id string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2"), ("c", "d", "3"), ("d", "d", "4"), ("c", "c", "5"), ("c", None, "6"), ("a", "c", "7"), ("c", "a", "8")], "src string, dst string, edge_id string")
    assert [r.node_id for r in graph.find_node(nodes, "Equipment", "P-1").collect()] == ["a"]
    assert graph.find_node(nodes, "Person", "P-1").count() == 0
    gone = spark.createDataFrame([("a",), ("d",), ("missing",)], "node_id string")
    left_nodes, left_edges = dml.delete_nodes(nodes, edges, gone)
    assert {r.node_id for r in left_nodes.collect()} == {"b", "c", None}
    assert {r.edge_id for r in left_edges.collect()} == {"5", "6"}
    same_nodes, same_edges = dml.delete_nodes(nodes, edges, gone.where("false"))
    assert (same_nodes.count(), same_edges.count()) == (5, 8)


def test_answers_of_several_queries_are_merged(spark):
    found = [(1, 7, "x", 0.5, 0.01), (2, 7, "x", 0.5, 0.03), (3, 7, "x", 0.4, 0.09), (1, 8, "y", 0.5, 0.03), (2, 9, "z", 0.9, None), (3, 5, None, 0.1, 0.2)]
    df = spark.createDataFrame(found, "query_id long, id long, text string, rerank double, rrf double")
    got = [tuple(r) for r in retrieval.merge_queries(df, 3).collect()]
    assert got == [(9, "z", 0.9, None), (7, "x", 0.5, 0.03), (8, "y", 0.5, 0.03)]
    assert retrieval.merge_queries(df, 10).count() == 4
    assert retrieval.merge_queries(df.where("id < 0")).count() == 0


def test_one_vector_as_many(spark):
    """A literal query finds what a table of one query does; rows without a vector aren't found."""
    rows = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 3)] if i % 5 else None) for i in range(1, 40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [1.0, -2.0, 0.5]
    one = {r.id: round(r.score, 6) for r in retrieval.dense(vectors.where("vec_id % 7 <> 0"), asked, 100).collect()}
    many = retrieval.dense_many(vectors.where("vec_id % 7 <> 0").withColumnRenamed("vec_id", "id"), spark.createDataFrame([(1, asked)], "query_id long, embedding array<float>"), 100)
    assert one == {r.id: round(r.score, 6) for r in many.collect()} and all(i % 5 for i in one)


def test_reports_and_cases(spark, tmp_path):
    cases = [{"id": 1, "question": "Why?", "tags": ["a"]}, {"id": 2, "question": None, "tags": []}]
    (tmp_path / "cases.json").write_text(json.dumps({"version": 1, "cases": cases}, indent=2))
    got = files.read_cases(spark, str(tmp_path / "cases.json"), "cases")
    assert sorted((r.id, r.question, list(r.tags)) for r in got.collect()) == [(1, "Why?", ["a"]), (2, None, [])]
    files.write_report(got, str(tmp_path / "report"))
    assert {(r.id, r.question) for r in spark.read.json(str(tmp_path / "report")).collect()} == {(1, "Why?"), (2, None)}
    with pytest.raises(AnalysisException):  # an earlier report is never replaced
        files.write_report(got, str(tmp_path / "report"))


def streamed(spark, tmp_path, events, query, name):
    """Rows of a query over events that come in two batches, the later ones last."""
    for i, batch in enumerate(events):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"{i}"))
    source = spark.readStream.schema(events[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    run = query(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    run.awaitTermination(90)
    return spark.table(name)


@pytest.mark.parametrize("name", ["windows", "sessions"])
def test_streams_equal_batches(spark, tmp_path, name):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=17 * i), ["view", "error"][i % 2], i % 3, float(i)) for i in range(300)]
    end = [(start + datetime.timedelta(days=30), "view", 9, 0.0)]  # moves the watermark past all others
    schema = "ts timestamp, event_type string, user_id long, value double"
    events = [spark.createDataFrame(r, schema) for r in (rows, end)]
    query = jobs.windowed_counts if name == "windows" else jobs.session_counts
    last = F.lit(start + datetime.timedelta(days=29))
    want = {tuple(r) for r in query(events[0].unionByName(events[1])).where(F.col("w.end") < last).collect()}
    got = streamed(spark, tmp_path, events, query, name)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5
