"""Versions of tables, graph upserts and stage metrics."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import versions as V


def test_readers_see_whole_versions(spark, tmp_path):
    t = V.VersionedTable(spark, str(tmp_path / "t"), "k long, v string")
    make = lambda *rows: spark.createDataFrame(list(rows), "v string, k long")
    rows = lambda n=None: sorted(map(tuple, t.read(n).collect()))
    assert rows() == [] and t.overwrite(make(("a", 1))) == 1 and t.append(make(("b", 2), ("b", 2))) == 2
    seen = {}

    def change(old):
        t._stage(make(("half", 9)))  # rows of a writer that hasn't committed, or died
        seen["during"] = rows()
        if "other" not in seen:
            seen["other"] = t.append(make(("c", 3)))  # another writer is first
        return old.withColumn("v", F.upper("v"))

    assert t.merge(change) == 4 and seen["during"] == [(1, "a"), (2, "b"), (2, "b"), (3, "c")]
    assert rows() == [(1, "A"), (2, "B"), (2, "B"), (3, "C")] and rows(1) == [(1, "a")] and rows(3) == seen["during"]
    with pytest.raises(V.Conflict):
        t.overwrite(make(("z", 0)), base=2)
    with pytest.raises(ValueError):
        t.read(7)
    (tmp_path / "t" / "_commits" / "000000000005.json").write_text('{"fold')  # a commit that isn't whole
    assert t.version() == 4


def test_graph_upserts(spark, tmp_path):
    nodes, edges = V.VersionedTable(spark, str(tmp_path / "n"), V.NODES), V.VersionedTable(spark, str(tmp_path / "e"), V.EDGES)
    entity = lambda *rows: spark.createDataFrame(list(rows), "nth int, canonical_id string, label string, name string, confidence double, method string, properties map<string,string>")
    rel = lambda *rows: spark.createDataFrame(list(rows), "nth int, src string, dst string, rel_type string, confidence double, properties map<string,string>")
    first = entity((0, "P1", "Equipment", "Pump", None, None, {"a": "1", "b": "1"}), (1, "P1", "Equipment", "Pump 1", 0.9, None, {"a": "2"}), (2, "V1", "Equipment", "Valve", None, "regex", None), (3, None, "X", "none", None, None, None))
    made = V.upsert_graph(nodes, edges, first, rel((0, "P1", "V1", "FEEDS", None, {"x": "1"}), (1, "P1", "P1", "FEEDS", 0.9, None), (2, "P1", "gone", "FEEDS", 0.9, None)), "t1")
    assert made == {"nodes": 1, "edges": 1}
    V.upsert_graph(nodes, edges, entity((0, "P1", None, None, 0.5, None, {"b": "9"}), (1, "W1", "WorkOrder", "W", None, None, {})), rel((0, "P1", "V1", "FEEDS", 0.3, {"y": "2"}), (1, "W1", "P1", "PERFORMED_ON", None, None)), "t1")
    V.upsert_graph(nodes, edges, entity((0, "P1", "Equipment", "other tenant", None, None, None)), rel((0, "P1", "V1", "FEEDS", 0.3, None)), "t2")
    got = {(r.tenant, r.canonical_id): (r.name, r.confidence, r.method, dict(r.properties)) for r in nodes.read().collect()}
    assert got == {("t1", "P1"): ("Pump 1", 0.5, "llm", {"a": "2", "b": "9"}), ("t1", "V1"): ("Valve", 0.8, "regex", {}), ("t1", "W1"): ("W", 0.8, "llm", {}), ("t2", "P1"): ("other tenant", 0.8, "llm", {})}
    links = {(r.tenant, r.src, r.dst, r.rel_type): (r.confidence, dict(r.properties)) for r in edges.read().collect()}
    assert links == {("t1", "P1", "V1", "FEEDS"): (0.3, {"x": "1", "y": "2"}), ("t1", "W1", "P1", "PERFORMED_ON"): (0.7, {})}
    assert dict(edges.read(1).first().properties) == {"x": "1"}


def test_stage_metrics(spark, tmp_path):
    metrics = V.VersionedTable(spark, str(tmp_path / "m"), V.METRICS)
    tries = []

    def flaky(d):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("lost")
        return d.where("id % 2 = 0")

    out = V.run_stages(spark.range(100), [("all", lambda d: d), ("even", flaky)], str(tmp_path / "out"), metrics, "r1")
    with pytest.raises(RuntimeError, match="stage bad"):
        V.run_stages(spark.range(3), [("bad", lambda d: d.select("nothing"))], str(tmp_path / "out"), metrics, "r2", retries=0)
    got = {(r.run, r.stage): (r.rows, r.attempts, r.failed is None) for r in metrics.read().collect()}
    assert got == {("r1", "all"): (100, 1, True), ("r1", "even"): (out.count(), 2, True), ("r2", "bad"): (None, 1, False)} and out.count() == 50
