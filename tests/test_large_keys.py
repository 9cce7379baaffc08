"""What only shows with longer keys, longer paths and texts that end at a limit."""

from loomgraph.functions import text as X
from loomgraph.operators import paths
from loomgraph.operators import records as RC
from loomgraph.plans import queries


def test_relations_keep_tags_of_any_length(spark):
    text = "C-17152 feeds V-20. C-17152 is maintained by Ann Lee.\nWO-110000 maintenance on C-17152 done.\nSOP-12 covers C-17152.\nEmergency shutdown of C-17152."
    got = {tuple(r) for r in X.rule_relationships(spark.createDataFrame([(1, text)], "id long, text string")).select("source", "target", "type").collect()}
    assert got == {("C-17152", "V-20", "FEEDS"), ("Ann Lee", "C-17152", "KNOWLEDGE_OWNER"), ("WO-110000", "C-17152", "PERFORMED_ON"), ("SOP-12", "C-17152", "REFERENCES"), ("C-17152", "Emergency Event", "AFFECTED_BY")}


def test_merged_relations_keep_tags_of_any_length(spark):
    docs = spark.createDataFrame([(i, f"C-1715{i} is maintained by Ann Lee.") for i in range(3)], "id long, text string")
    got = {(r.target, r.n_texts) for r in X.merge_relationships(X.rule_relationships(docs)).collect()}
    assert got == {(f"Compressor C-1715{i}", 1) for i in range(3)}


def test_paths_of_limited_length(spark):
    long = [(f"n{i}", f"n{i + 1}") for i in range(6)]
    edges = spark.createDataFrame([(a, b, "FEEDS", a + b) for a, b in [*long, ("n0", "n3"), ("n3", "n6")]], "src string, dst string, rel_type string, edge_id string")
    got = lambda most: [tuple(r) for r in paths.k_shortest(edges, "n0", "n6", 5, most=most).collect()]
    every = [(2, "n0>n3>n6"), (4, "n0>n1>n2>n3>n6"), (4, "n0>n3>n4>n5>n6"), (6, "n0>n1>n2>n3>n4>n5>n6")]
    assert got(None) == every and got(5) == every[:3]


def test_context_at_its_limit(spark):
    rows = [(1, 0, "abcd"), (1, 1, "efgh"), (2, None, "last"), (2, 5, "first"), (3, 0, None), (4, 0, None), (4, 1, "x")]
    got = {r.document_id: r.text for r in RC.context(spark.createDataFrame(rows, "document_id long, chunk_index int, text string"), 5).collect()}
    assert got == {1: "abcd\n", 2: "first", 3: "", 4: "x"}


def test_compliance_context_without_texts(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", None), (2, 0, "user", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r.document_id, r.n_chars) for r in queries.queries()["compliance_context"](spark, str(tmp_path)).collect()) == [(1, None), (2, 0)]
