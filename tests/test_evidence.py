"""Evidence, extraction with a cache, files to chunks, whole deletes: small cases with nulls, ties and repeated rows."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import analytics, community, estimates
from loomgraph.operators import algorithms as A
from loomgraph.operators import dml as D
from loomgraph.operators import evidence as E
from loomgraph.operators import extraction as EX
from loomgraph.operators import graph as G
from loomgraph.operators import names as N
from loomgraph.operators import records as RC
from loomgraph.operators import retrieval as R
from loomgraph.operators import scoring as S
from loomgraph.sources import files

NODES = "node_id string, name string, label string, canonical_id string, source_doc_id long, description string"
EDGES = "src string, dst string, rel_type string, edge_id string, source_doc_id long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def graph_of(spark):
    nodes = [
        ("1", "Pump P-12", "Equipment", "P12", 1, None), ("2", "Seal leak", "FailureMode", "SL", 1, None), ("3", "Seal change", "Procedure", "SC", 2, None), ("4", "Flush", "Procedure", "F", 2, "after a Bearing wear"),
        ("5", "ISO 9001", "Regulation", "I9", 3, None), ("6", "OSHA 1910", "Regulation", "O1", 3, None), ("7", "Incident 7", "Incident", "I7", 4, None), ("8", None, "Person", None, None, None),
    ]
    edges = [("2", "3"), ("2", "1"), ("1", "6"), ("7", "1"), ("7", "1"), ("4", "5"), ("1", "1")]
    return frame(spark, nodes, NODES), frame(spark, [(a, b, "RELATED_TO", f"{a}>{b}>{i}", 1) for i, (a, b) in enumerate(edges)], EDGES)


def test_procedures_fall_back(spark):
    asked = frame(spark, [(1, "Seal leak"), (1, "Seal leak"), (2, "Bearing wear"), (3, "unknown"), (4, None), (5, "")], "query_id long, mode string")
    got = sorted(tuple(r) for r in E.procedures(asked, *graph_of(spark), otherwise=["Z", "Y"]).select("query_id", "name", "arm").collect())
    rest = [(q, n, 2) for q in (3, 4, 5) for n in ("Y", "Z")]
    assert got == [(1, "Seal change", 0), (2, "Flush", 1), *rest]
    assert {r.query_id for r in E.procedures(asked, *graph_of(spark)).collect()} == {1, 2}


def test_regulations_fall_back(spark):
    asked = frame(spark, [(1, None), (1, None), (2, "osha"), (4, "iso"), (9, "none")], "source_doc_id long, scope string")
    got = sorted(tuple(r) for r in E.regulations(asked, *graph_of(spark), otherwise=["Z"]).select("source_doc_id", "name", "arm").collect())
    # document 2's only regulation is ISO 9001, which the scope rules out; 4 has none next to it and asks all
    assert got == [(1, "OSHA 1910", 0), (2, "Z", 2), (4, "ISO 9001", 1), (9, "Z", 2)]


def test_seeds_in_order(spark):
    nodes, _ = graph_of(spark)
    rows = [(1, "Why does Pump P-12 leak", None), (2, "ISO rules", ["about ISO 9001", "about OSHA 1910"]), (3, "change Flush", None), (4, None, None), (5, "zzz", [None]), (6, "R-99 and P-12, R-99", [])]
    queries = frame(spark, rows, "query_id long, query string, sub_queries array<string>")
    got: dict[int, list[str]] = {}
    for r in E.seeds(queries, nodes).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.name)
    # 3 holds a name; 6's tags come first, and no name is in its text, so its keywords find the pump
    assert got == {1: ["P-12", "Pump P-12"], 2: ["ISO 9001", "OSHA 1910"], 3: ["Flush"], 6: ["R-99", "P-12", "Pump P-12"]}


def test_around_stops_when_full(spark):
    star = [("hub", f"n{i:02}") for i in range(30)] + [(f"n{i:02}", f"far{i:02}") for i in range(30)]
    edges = frame(spark, [(a, b, "FEEDS", f"{a}>{b}", 1) for a, b in star], EDGES)
    starts = frame(spark, [(1, "hub"), (1, "hub"), (2, "far03")], "query_id long, node_id string")
    got = {q: [] for q in (1, 2)}
    for r in E.around(starts, edges, 3, 10).orderBy("query_id", "hops", "node_id").collect():
        got[r.query_id].append((r.hops, r.node_id))
    assert got[1] == [(0, "hub")] + [(1, f"n{i:02}") for i in range(9)]
    assert got[2] == [(0, "far03"), (1, "n03"), (2, "hub")] + [(3, f"n{i:02}") for i in range(8) if i != 3]


def test_subgraph_edges_once(spark):
    nodes, edges = graph_of(spark)
    near, inside = E.subgraph(frame(spark, [(1, "Incident 7"), (1, "nothing")], "query_id long, name string"), nodes, edges, depth=1)
    assert sorted((r.node_id, r.score) for r in near.collect()) == [("1", 0.5), ("7", 1.0)]
    assert sorted((r.src, r.dst) for r in inside.collect()) == [("1", "1"), ("1", "7")]


def test_routes_and_listing(spark):
    q = frame(spark, [("how many documents are there",), ("P-101 and P-102",), (None,), ("one two three four five six seven eight nine ten eleven",)], "q string")
    a, b = E.widths(F.col("q"))
    assert [tuple(r) for r in q.select(E.route(F.col("q")), a, b).collect()] == [("registry", 20, 8), ("search", 30, 15), ("search", 20, 8), ("search", 30, 15)]
    docs = frame(spark, [(1, "a.pdf", "completed", "pdf", "2024-01-02"), (2, "b", "deleted", "x", None), (3, None, "failed", None, None), (4, "d", None, None, None)], "id long, filename string, status string, file_type string, uploaded string")
    got = {r.id: r.line for r in E.listing(docs.withColumn("uploaded", F.col("uploaded").cast("timestamp_ntz"))).collect()}
    assert got == {1: "- a.pdf (Status: completed, Type: pdf, Uploaded: 2024-01-02)", 3: "-  (Status: failed, Type: , Uploaded: )"}


def test_similar_incidents(spark):
    kinds = ["rca", "procedure", "work_order", None, "rca", "rca", "compliance"]
    texts = ["pump seal leak found", "pump seal leak procedure", "seal leak again", "pump hum", "boiler noise", "pump seal", "pump seal leak rule"]
    chunks = frame(spark, [(i, t, [1.0, float(i)], k) for i, (t, k) in enumerate(zip(texts, kinds, strict=True))], "id long, text string, embedding array<double>, section_type string")
    asked = frame(spark, [(1, "pump seal leak procedure steps", [1.0, 0.5])], "query_id long, query string, embedding array<double>")
    got = [r.id for r in E.similar_incidents(chunks, asked, *graph_of(spark)).orderBy("rank").collect()]
    words = lambda t: len({"pump", "seal", "leak", "procedure", "steps"} & set(t.split()))
    assert len(got) == 3 and {kinds[i] for i in got} <= {"rca", "work_order", None}
    assert sorted((words(texts[i]) for i in got), reverse=True) == [3, 2, 2]


def test_lessons(spark):
    hits = frame(spark, [(1, 10, 1), (1, 11, 2), (1, 12, 6), (2, 13, 1)], "query_id long, id long, rank int")
    topics = frame(spark, [(1, "Pump"), (3, "")], "query_id long, topic string")
    got = sorted(tuple(r) for r in E.lessons(topics, hits, *graph_of(spark)).collect())
    assert got == [(1, "chunk", "10", 1), (1, "chunk", "11", 2), (1, "incident", "7", 1)]


def test_extraction_cache(spark):
    docs = frame(spark, [(1, "C-17 feeds V-301"), (2, "C-17 feeds V-301"), (3, None), (4, ""), (5, "ISO 9001 C17 C-17")], "id long, text string")
    empty = frame(spark, [], "file_hash string, result string")
    h = lambda i: docs.where(f"id = {i}").select(EX.content_hash(F.col("text"))).first()[0]
    model = frame(spark, [(h(1), 0, "Hal", "Robot", None), (h(1), 1, "C-17", "Person", 0.1), (h(1), 2, None, "Person", 0.1), (h(1), 3, "", None, 0.2)], "file_hash string, nth int, name string, type string, confidence double")
    rels = frame(spark, [(h(1), 0, "Hal", "C-17", "works on", 0.6), (h(1), 1, "Hal", "", "X", None)], "file_hash string, nth int, source string, target string, type string, confidence double")
    answers, new = EX.extract_once(docs, empty, model, rels)
    got = {r.id: (r.cached, [tuple(e) for e in r.result.entities], [tuple(e) for e in r.result.relationships]) for r in answers.collect()}
    assert got[1] == got[2] == (False, [("Compressor C-17", "Equipment", 0.85), ("Vessel V-301", "Equipment", 0.85), ("Hal", "Entity", 1.0)], [("Hal", "Compressor C-17", "PERFORMED_ON", 0.6)])
    assert got[3] == got[4] == (False, [], []) and [e[0] for e in got[5][1]] == ["Compressor C-17", "ISO 9001"]
    assert new.count() == 3  # equal texts once
    again, more = EX.extract_once(docs, new.unionByName(new), model, rels)
    rows = again.collect()
    assert all(r.cached for r in rows) and len(rows) == 5 and more.count() == 0
    assert {r.id: [tuple(e) for e in r.result.entities] for r in rows} == {i: g[1] for i, g in got.items()}
    broken = frame(spark, [(h(1), "{"), (h(5), "7"), (h(3), None)], "file_hash string, result string")
    plain, none = EX.extract_once(docs, broken)
    assert not any(r.cached for r in plain.collect()) and none.count() == 0


def test_files_to_chunks(spark, tmp_path):
    sentence = "This sentence has exactly seven words here. "
    (tmp_path / "a.txt").write_text("WARNING: hot\n" + sentence * 200)
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.xls").write_bytes(b"\xd0\xcf\x11\xe0 binary")
    (tmp_path / "d.txt").write_text("  \n ")
    (tmp_path / "e.csv").write_text("k,v\n" + "".join(f"{i},five words are in here\n" for i in range(250)))
    rows = files.parse_files(spark, str(tmp_path)).collect()
    assert {(r.source_file, r.error.split(":")[0]) for r in rows if r.error} == {("b.docx", "BadZipFile"), ("c.xls", "BadZipFile")}
    assert all(r.page is None and r.text is None for r in rows if r.error)
    chunks = files.file_chunks(files.read_files(spark, str(tmp_path))).orderBy("source_file", "chunk_index").collect()
    for name, pages in (("a.txt", {1}), ("e.csv", {1, 2, 3})):
        mine = [r for r in chunks if r.source_file == name]
        assert [r.chunk_index for r in mine] == list(range(len(mine))) and {r.page for r in mine} == pages
        assert [r.page for r in mine] == sorted(r.page for r in mine)
    assert {r.source_file for r in chunks} == {"a.txt", "e.csv"}


def test_sheets_by_relationship():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="A" r:id="r9"/><sheet name="B" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r9" Target="/xl/worksheets/other.xml"/></Relationships>')
        for name, value in (("sheet1", "one"), ("other", "two")):
            z.writestr(f"xl/worksheets/{name}.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>{value}</t></is></c></row></sheetData></worksheet>')
    assert [text.splitlines()[-1] for _, text in files.parse_xlsx(out.getvalue())] == ["In sheet 'A', row 1: k=two.", "In sheet 'B', row 1: k=one."]


def test_uploads(spark):
    batch = frame(spark, [(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h2"), (4, "d", "h3"), (5, "e", None), (6, None, "h4"), (7, "f", "h1")], "place long, filename string, file_hash string")
    docs = frame(spark, [("a", None), ("a", "h9"), (None, "h3"), ("z", "h3")], "filename string, file_hash string")
    # 7 has the hash of 1, but 1 was ruled out by its name
    assert {r.place: r.outcome for r in D.new_uploads(batch, docs).collect()} == {1: "name", 2: "upload", 3: "batch", 4: "server", 5: "upload", 6: "upload", 7: "upload"}


def test_cascade(spark):
    docs = frame(spark, [(1, "completed"), (2, "completed"), (None, None)], "document_id long, status string")
    chunks = frame(spark, [(1,), (1,), (2,), (None,)], "document_id long")
    before = D.audited(frame(spark, [("me", "login", None, "t0", 5, None)], "actor string, action string, query string, at string, n int, x int"))
    left = D.cascade(1, "t1", *graph_of(spark), docs, chunks, chunks, before)
    assert sorted((r.document_id or 0, r.status or "") for r in left["documents"].collect()) == [(0, ""), (1, "deleted"), (2, "completed")]
    assert left["chunks"].count() == left["points"].count() == 2 and left["edges"].count() == 0
    assert {r.node_id for r in left["nodes"].collect()} == {"3", "4", "5", "6", "7", "8"}
    assert [(r.action, json.loads(r.details)) for r in left["audit"].orderBy("at").collect()] == [("login", {"n": 5}), ("delete_document", {"chunks": 2, "points": 2})]


def test_scores(spark):
    found = frame(spark, [(1, "Pump P-12"), (1, "x"), (2, "q"), (3, None)], "id long, name string")
    expected = frame(spark, [(1, " p-12 "), (4, "z")], "id long, name string")
    got = N.fuzzy_scores(found, expected).first()
    assert (got.texts, got.precision, got.recall) == (4, 0.125, 0.25) and abs(got.f1 - 2 * 0.125 * 0.25 / 0.375) < 1e-9
    assert tuple(N.fuzzy_scores(found.limit(0), expected.limit(0)).first()) == (0, 0.0, 0.0, 0.0)
    top = frame(spark, [(1, 5, 1), (1, 6, 3), (2, 5, 1)], "query_id long, id long, rank int")
    good = frame(spark, [(1, 5), (1, 6), (1, 6), (3, 9)], "query_id long, id long")
    assert sorted(tuple(r) for r in R.recall_at(top, good, [1, 3]).collect()) == [(1, 0.25, 2), (3, 0.5, 2)]


def test_health_of_nothing(spark):
    nodes, edges = (df.limit(0) for df in graph_of(spark))
    groups = frame(spark, [], "node_id string, community string")
    got = G.health_report(nodes, edges.withColumn("confidence", F.lit(0.1)), groups).collect()
    assert [(r.n, r.samples) for r in got] == [(0, "")] * 4


def test_risk_profiles(spark):
    nodes, edges = graph_of(spark)
    nodes = nodes.withColumn("retirement_risk", F.lit(None).cast("string")).unionByName(frame(spark, [("9", "Ann", "Person", "A", 1, None, "HIGH")], NODES + ", retirement_risk string"))
    edges = edges.unionByName(frame(spark, [("9", "1", "MAINTAINED_BY", "e", 1), ("1", "3", "FOLLOWS", "f", 1)], EDGES))
    dates = frame(spark, [("3", "2024-01-01 12:00:00"), ("3", "2024-02-01 12:00:00"), ("3", None)], "node_id string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = S.risk_profiles(nodes, edges, frame(spark, [("1", 0.1)], "node_id string, rank double"), dates, "2024-02-03 00:00:00").first()
    assert (got.node_id, got.retiring, got.sop_age, got.pagerank) == ("1", "Ann", 1, 0.1)
    assert got.reason.startswith("1 recent incidents + ") and got.reason.endswith("High systemic connectivity (Hub)") and got.action.endswith("Review incident root causes")


def test_full_analytics(spark, tmp_path):
    pairs = [("1", "2"), ("2", "3"), ("3", "1"), ("4", "5"), ("3", "4")]
    edges = frame(spark, [(a, b, "FEEDS", f"{a}>{b}", 1) for a, b in pairs], EDGES)
    nodes = frame(spark, [(str(i),) for i in range(1, 7)], "node_id string")
    to = str(tmp_path / "metrics")
    row = analytics.full_analytics(nodes, edges, to)
    table = {r.node_id: r for r in spark.read.parquet(to).collect()}
    ranks = {r.node_id: r["rank"] for r in A.pagerank(nodes, edges).collect()}
    groups = {r.node_id: r.community for r in community.communities(nodes, edges).collect()}
    close = {r.node_id: r.closeness for r in estimates.closeness(edges, 6).collect()}
    assert row.first().asDict() == {"nodes": 6, "ranked": 6, "communities": len(set(groups.values())), "close": len(close), "between": row.first().between}
    for k, r in table.items():
        assert abs(r.pagerank - ranks[k]) < 1e-9 and r.community == groups[k] and r.closeness == close.get(k)
    assert table["6"].betweenness is None and table["3"].betweenness > 0


def test_trail_edges(spark):
    chain = [(str(i), str(i + 1)) for i in range(6)]
    edges = frame(spark, [(a, b, "FEEDS", f"{a}>{b}", 1) for a, b in chain], EDGES)
    nodes = frame(spark, [(str(i), f"n{i}") for i in range(7)], "node_id string, name string")
    assert [(r.edge_id, r.hops) for r in G.trail_edges(nodes, edges, ["n0"], 3).orderBy("hops").collect()] == [("0>1", 0), ("1>2", 1), ("2>3", 2)]


def test_context_and_aliases(spark):
    chunks = frame(spark, [(1, i, "x" * 30) for i in range(1000)] + [(2, 0, None), (2, 1, None), (3, 0, "y" * 9000), (3, 1, "z"), (4, 0, None), (4, 1, "a"), (4, 1, "b"), (None, 0, "n"), (5, 0, "")], "document_id long, chunk_index int, text string")
    got = {r.document_id: r.text for r in RC.context(chunks, 100).collect()}
    assert got == {1: "\n".join(["x" * 30] * 4)[:100], 2: "", 3: "y" * 100, 4: "a\nb", None: "n", 5: ""}
    rows = frame(spark, [("E", "1", 0.5, "b", ["p", "q", None])] * 3 + [("E", "1", 0.9, "a", ["q", "o"]), ("E", "1", 0.9, "c", None), ("E", "2", None, None, []), ("P", "1", 0.1, "z", ["p"])], "label string, canonical_id string, confidence double, name string, aliases array<string>")
    got = sorted((r.label, r.canonical_id, r.confidence, r.name, r.aliases) for r in D.upsert_entities(rows).collect())
    assert got == [("E", "1", 0.9, "c", "o|p|q"), ("E", "2", None, None, ""), ("P", "1", 0.1, "z", "p")]


def test_budget_usage_gaps(spark):
    rows = frame(spark, [("abcdefghij", None), ("abcdefghij", "s"), ("abcdefghij", "s" * 20), (None, "s"), ("", None)], "p string, s string")
    assert [r[0] for r in rows.select(X.within_budget(F.col("p"), F.col("s"), 2)).collect()] == ["...fghij", "...ghij", "abcdefghij", None, ""]
    assert tuple(RC.token_usage(frame(spark, [(1, None), (None, 5)], "prompt_tokens long, completion_tokens long")).first()) == (1, 5, 6)
    gaps = frame(spark, [([("Low",), (None,)],), ([("High",)],), ([],), (None,)], "gaps array<struct<risk_level:string>>")
    assert [r[0] for r in gaps.select(RC.has_serious_gap(F.col("gaps"))).collect()] == [False, True, False, False]


def test_around_a_hub_takes_the_first_of_each_query(spark):
    """A hub has more neighbours than a query can hold; those seen already don't count among its first."""
    pairs = [("hub", f"n{i:02}") for i in range(40)] + [("n00", "n01"), ("n30", "z")]
    edges = spark.createDataFrame([(a, b, "R", f"{a}>{b}") for a, b in pairs], "src string, dst string, rel_type string, edge_id string")
    starts = spark.createDataFrame([(1, "n00"), (1, "n02"), (2, "z")], "query_id long, node_id string")
    got = sorted(tuple(r) for r in E.around(starts, edges, 3, 6).collect())
    first = [(1, "hub", 1), (1, "n00", 0), (1, "n01", 1), (1, "n02", 0), (1, "n03", 2), (1, "n04", 2)]
    assert got == first + [(2, "hub", 2), (2, "n00", 3), (2, "n01", 3), (2, "n02", 3), (2, "n30", 1), (2, "z", 0)]
