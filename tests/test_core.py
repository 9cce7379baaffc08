"""Every registered query against its SQL on the smallest tables, and the parts that SQL can't express."""

import decimal
import io
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.registry import register_functions
from loomgraph.operators import algorithms as A
from loomgraph.operators import dml as D
from loomgraph.operators import graph as G
from loomgraph.operators import retrieval as R
from loomgraph.plans import fixture as FX
from loomgraph.plans import oracle, queries
from loomgraph.session import TenantCatalog
from loomgraph.sources import files
from loomgraph.streaming import jobs, state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"risk_assets", "pagerank_20", "k_shortest_paths", "closeness", "shortest_path", "hybrid_rank", "betweenness", "communities", "community_members", "closeness_estimate", "betweenness_estimate", "vector_index_topk", "full_analytics", "similar_incidents"}))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in oracle.SQL:
        r = duck.sql(oracle.SQL[name])
        at = [r.columns.index(c) for c in cols]
        assert sorted(r.columns) == cols
        assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.fixture(scope="module")
def ring(spark):
    """1 -> 2 -> 3 -> 4 -> 1, 2 -> 5; 6 alone."""
    pairs = [("1", "2"), ("2", "3"), ("3", "4"), ("4", "1"), ("2", "5")]
    edges = spark.createDataFrame([(a, b, "FEEDS", f"{a}>{b}") for a, b in pairs], "src string, dst string, rel_type string, edge_id string")
    nodes = spark.createDataFrame([(str(i), f"n{i}", "Equipment") for i in range(1, 7)], "node_id string, name string, label string")
    return nodes, edges


def test_algorithms(ring):
    nodes, edges = ring
    assert [tuple(r) for r in G.paths(edges, "1", "5", 5).collect()] == [(2, "1>2>5")]
    assert [r.path for r in G.paths(edges, "1", "4", 5, directed=True, k=3).collect()] == ["1>2>3>4"]
    ranks = {r.node_id: r["rank"] for r in A.pagerank(nodes, edges, iterations=100, tolerance=1e-6).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and max(ranks, key=ranks.get) == "2"
    assert {r.node_id: r.component for r in A.components(nodes, edges).collect()} == {**dict.fromkeys("12345", "1"), "6": "6"}
    between = {r.node_id: r.betweenness for r in A.betweenness(edges, 6).collect()}
    assert between["2"] > between["3"] and between["5"] == 0
    assert {r.node_id for r in G.orphans(nodes, edges).collect()} == {"6"}


def test_feeds_of_all_parts(spark, tmp_path):
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet") if name != "lineitem" else None
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    line.withColumn("l_partkey", (F.col("l_partkey") + 1000).cast(line.schema["l_partkey"].dataType)).write.parquet(f"{tmp_path}/lineitem.parquet")
    feeds = lambda sf: FX.edges(FX.Tables(spark, sf)).where("rel_type = 'FEEDS'").count()
    assert feeds(str(tmp_path)) == feeds(SF) > 0


def test_long_distances(spark):
    """A path of 20 nodes and two ways past its end: searches go on until nothing is new."""
    pairs = [(i, i + 1) for i in range(19)] + [(0, 18)]
    edges = spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in pairs], "src string, dst string")
    dist = {(r.src, r.dst): r.dist for r in A.distances(edges, None).collect()}
    want = {(f"{a:02}", f"{b:02}"): min(b - a, 1 + b - 18 if a == 0 and b >= 18 else 99) for a in range(20) for b in range(a + 1, 20)}
    assert dist == want
    for r in A.closeness(edges, 20).collect():
        d = [v for (_, to), v in want.items() if to == r.node_id]
        assert abs(r.closeness - len(d) / sum(d) * len(d) / 19) < 1e-12
    between = {r.node_id: r.betweenness * 19 * 18 for r in A.betweenness(edges, 20).collect()}
    # 18 is on the ways from 0..17 to 19; 10 on those from 0 to 11..17 and from 1..9 to 11..19
    assert round(between["18"], 9) == 18 and round(between["10"], 9) == 7 + 9 * 9 and between["19"] == 0 and "00" not in between


def test_packed_sentences():
    text = " ".join(f"S{i} a b c d e f g h." for i in range(10))
    chunks = X.packed_sentences(text, "HEAD", 30, 9)
    assert all(c.startswith("[HEAD]\n") for c in chunks) and chunks[0].endswith("S2 a b c d e f g h.") and chunks[1].startswith("[HEAD]\nS2")


def test_near_names(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, e in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != e)))
        return row[-1]

    names = [*enumerate(["", "a", "ab", "ba", "abc", "xbcd", "aa", "aaaa", "Supplier#1", "Suppller#2", "upplier#12", "S#1"]), (50, "ab"), (51, "abcdef"), (52, "defabc"), (53, None)]
    got = sorted(map(tuple, X.near_names(spark.createDataFrame(names, "id long, name string")).collect()))
    assert got == sorted((a, b, edits(m, n)) for a, m in names for b, n in names if a < b and n is not None and edits(m, n) <= 2)


def test_names_that_many_rows_have_are_compared_once(spark):
    names = spark.createDataFrame([(0, "a long name of a supplier"), (1, "a long name of a suppliar"), (2, "another name")], "id long, name string")
    copies = names.crossJoin(spark.range(40).withColumnRenamed("id", "i")).select((F.col("id") + 10 * F.col("i")).alias("id"), "name")
    assert X._rests(copies).count() == X._rests(names).count()
    got = X.near_names(copies)
    assert got.distinct().count() == got.count() == 3 * 40 * 39 // 2 + 40 * 40 and got.where("a >= b").count() == 0
    assert got.where("d = 1").count() == 40 * 40 and got.where("d = 0").count() == 3 * 40 * 39 // 2


def test_queries_read_all_rows(spark):
    """Filters on rows must not come back: all suppliers, lines and languages are read."""
    q = lambda name: queries.queries()[name](spark, "/root/testdata/sf0.01")
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    s = read("supplier").select("s_suppkey", "s_name")
    x, y = s.alias("x"), s.alias("y")
    assert q("levenshtein_pairs").count() == x.join(y, F.expr("x.s_suppkey < y.s_suppkey AND levenshtein(x.s_name, y.s_name) <= 2")).count()
    n = read("documents").count()
    assert q("keyword_overlap").count() == n and q("context_compression").count() == n
    pairs = set()
    lines = {}
    for r in read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").collect():
        lines.setdefault(r[0], set()).update({f"E:{r[1]}", f"P:{r[2]}"})
    for names in lines.values():
        pairs |= {(a, b) for a in names for b in names if a < b}
    assert q("cooccurrence_edges").count() == len(pairs)


def test_upload_and_merge(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    assert sorted(map(tuple, D.merge(base, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, D.insert_absent(base, new.where("v <> 'e'"), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_tenants_see_only_their_rows(spark):
    t = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, x long")
    TenantCatalog(spark, "t1").register("mine", t)
    assert [r.x for r in spark.sql("SELECT x FROM mine").collect()] == [1]


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT normalize_name('P-1 01') AS n, cosine(array(1D, 0D), array(1D, 1D)) AS c").first()
    assert r.n == "p101" and abs(r.c - 0.70710678) < 1e-6


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.csv").write_text("k,v\n1,x\n,\n3,z\n")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "c.docx").write_bytes(buf.getvalue())
    got = {r.source_file: r.text for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "hello", "b.csv": "Row 1: k=1, v=x.\nRow 3: k=3, v=z.", "c.docx": "one\ntwo"}
    assert files.tolerant_json('x ```json\n{"a": 1}\n```') == {"a": 1}


def test_breaker_and_compression(spark):
    b = state.Breaker(most=2, rest=10)
    assert [b.step(t, ok) for t, ok in [(0, False), (1, False), (5, True), (12, True), (13, True), (14, True)]] == ["CLOSED", "OPEN", "OPEN", "HALF_OPEN", "HALF_OPEN", "CLOSED"]
    text = "Alpha beta gamma. " * 12 + "Pump failure cause here. " + "Other words follow now. " * 10
    df = spark.createDataFrame([(1, text), (2, "short text")], "id long, text string")
    got = {r.id: r.text for r in R.compress(df, "pump failure").collect()}
    assert got[2] == "short text" and "Pump failure" in got[1] and len(got[1]) < len(text)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    os.makedirs(tmp_path / "in")
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"))
    q = jobs.daily_quota(stream).writeStream.outputMode("complete").format("memory").queryName("quota").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r.w.start)[:10]: r.used for r in spark.sql("SELECT * FROM quota").collect()}
    assert got == {r.day: r.used for r in state.daily_quota(events, "ts").collect()}
    few = stream.where("user_id < 5")
    q = jobs.rate_limits(few, 3600, 2).writeStream.outputMode("append").format("memory").queryName("limits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.event_id: r.limited for r in state.rate_limited(events.where("user_id < 5"), "user_id", "ts", 3600, 2).collect()}
    assert {r.event_id: r.limited for r in spark.sql("SELECT * FROM limits").collect()} == want


def test_breaker_keeps_its_successes():
    b = state.Breaker(most=2, rest=10)
    for at, ok in [(0, True), (1, True), (2, True), (3, False), (4, False)]:
        b.step(at, ok)
    assert b.state == "OPEN" and b.step(20, True) == "CLOSED"


def test_latest_without_deleted(spark, tmp_path):
    write = jobs.latest_into(str(tmp_path), "k", ["ts"])
    for epoch, rows in enumerate([[(1, 1, "new"), (2, 1, "new")], [(1, 3, "deleted"), (3, 1, "new")], [(1, 2, "late")]]):
        for _ in range(2):  # a batch that runs again changes nothing
            write(spark.createDataFrame(rows, "k long, ts long, status string"), epoch)
    assert sorted(tuple(r) for r in jobs.latest(spark, str(tmp_path), "k", ["ts"]).select("k", "status").collect()) == [(2, "new"), (3, "new")]


def test_sheets_by_reference():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "k")}{cell("C1", "v")}</row><row r="3">{cell("C3", "x")}</row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/><sheet name="T"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/sheet2.xml", sheet)
    assert files.parse_xlsx(out.getvalue()) == [(1, "Sheet: S\n\nIn sheet 'S', row 2: v=x."), (2, "Sheet: T\n\nIn sheet 'T', row 2: v=x.")]


def test_positions_over_ranges(spark, monkeypatch):
    from loomgraph.functions import ordering

    monkeypatch.setattr(ordering, "RANGE_ROWS", 7)
    rows = [("a" if i % 3 else None, (i * 37) % 100) for i in range(100)]
    got = ordering.numbered(spark.createDataFrame(rows, "g string, v long"), ["g"], ["v"]).collect()
    for g in ("a", None):
        assert [r.v for r in sorted((r for r in got if r.g == g), key=lambda r: r.nth)] == sorted(v for x, v in rows if x == g)


def test_clauses_and_types(spark):
    row = spark.createDataFrame([("keep it\nbelow 4.5 bar in Section 2 at all times\n4.1 report leaks to the shift lead\nSection 5 and sign the sheet", "Incident", "pump seal leak")], "t string, k string, n string")
    got = row.select(X.clauses(F.col("t")).alias("c"), X.classify(F.col("k"), F.col("n")).alias("s")).first()
    assert got.c == ["keep it\nbelow 4.5 bar in Section 2 at all times", "4.1 report leaks to the shift lead", "Section 5 and sign the sheet"] and got.s == "SealLeak"
