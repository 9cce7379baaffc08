"""The queries' SQL for DuckDB, over the same tables."""

from __future__ import annotations

from ..vocab import CATEGORY_OF_LABEL, CATEGORY_OF_RELATIONSHIP, INTENTS, METADATA_WORDS, ONTOLOGY, RELATIONSHIP_REMAP, RELATIONSHIPS, RISK_SIGNALS, STOP_WORDS, TAG_WORDS
from .queries import AS_OF, PATH_ENDS, QUERY, SEED_NAME

_q = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_TAG = f"(list_extract([{_q(TAG_WORDS)}], CAST(p_partkey % 7 + 1 AS BIGINT)) || '-' || CAST(10 + p_partkey // 7 AS VARCHAR))"
_WORD = f"list_extract([{_q(TAG_WORDS.values())}], CAST(p_partkey % 7 + 1 AS BIGINT))"
_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"

GRAPH = f"""
WITH RECURSIVE nodes AS (
  SELECT 'E:' || p_partkey AS node_id, {_WORD} || ' ' || {_TAG} AS name, 'Equipment' AS label, replace({_TAG}, '-', '') AS canonical_id, CAST(p_partkey % 100 AS BIGINT) AS source_doc_id, CAST(NULL AS VARCHAR) AS retirement_risk, CAST(NULL AS VARCHAR) AS event_time FROM part
  UNION ALL SELECT 'P:' || s_suppkey, s_name, 'Person', s_name, CAST(s_suppkey % 100 AS BIGINT), CASE WHEN s_acctbal < 0 THEN 'HIGH' WHEN s_acctbal < 3000 THEN 'MEDIUM' ELSE 'LOW' END, NULL FROM supplier
  UNION ALL SELECT 'I:' || o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'Emergency ' ELSE 'Incident ' END || o_orderkey, 'Incident', CASE WHEN o_totalprice > 250000 THEN 'Emergency ' ELSE 'Incident ' END || o_orderkey, CAST(o_orderkey % 100 AS BIGINT), NULL, {_ISO} FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT 'W:' || o_orderkey, 'WO-' || o_orderkey, 'WorkOrder', 'WO-' || o_orderkey, CAST(o_orderkey % 100 AS BIGINT), NULL, {_ISO} FROM orders WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT DISTINCT 'B:' || p_brand, 'SOP ' || p_brand, 'Procedure', 'SOP ' || p_brand, 0, NULL, NULL FROM part
  UNION ALL SELECT 'N:' || n_nationkey, 'Regulation ' || n_name, 'Regulation', 'Regulation ' || n_name, 0, NULL, NULL FROM nation),
e0 AS (
  SELECT DISTINCT 'P:' || l_suppkey AS src, 'E:' || l_partkey AS dst, 'MAINTAINED_BY' AS rel_type, CAST(NULL AS VARCHAR) AS event_time FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_quantity >= 45
  UNION ALL SELECT DISTINCT 'I:' || o_orderkey, 'E:' || l_partkey, 'OCCURRED_ON', {_ISO} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 2 AND o_orderpriority = '1-URGENT'
  UNION ALL SELECT DISTINCT 'W:' || o_orderkey, 'E:' || l_partkey, 'PERFORMED_ON', {_ISO} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 3 AND o_orderpriority = '5-LOW'
  UNION ALL SELECT DISTINCT 'E:' || a.l_partkey, 'E:' || b.l_partkey, 'FEEDS', NULL FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey
  UNION ALL SELECT DISTINCT 'E:' || p_partkey, 'B:' || p_brand, 'COMPLIES_WITH', NULL FROM part WHERE p_size <= 25
  UNION ALL SELECT DISTINCT 'E:' || l_partkey, 'N:' || s_nationkey, 'COMPLIES_WITH', NULL FROM (SELECT l_partkey, min(l_suppkey) AS k FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1) JOIN supplier ON s_suppkey = k),
edges AS (SELECT *, src || '>' || rel_type || '>' || dst AS edge_id, CAST(0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (length(src || '>' || rel_type || '>' || dst) % 6) AS confidence, CAST(length(src || '>' || rel_type || '>' || dst) % 7 AS BIGINT) AS source_doc_id FROM e0),
und AS (SELECT src AS a, dst AS b, rel_type, edge_id FROM edges UNION ALL SELECT dst, src, rel_type, edge_id FROM edges WHERE src <> dst),
full_e AS (SELECT e.*, s.name AS src_name, s.label AS src_label, d.name AS dst_name, d.label AS dst_label FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes d ON d.node_id = e.dst),
both_e AS (SELECT src, dst, rel_type, src_label, dst_label FROM full_e UNION ALL SELECT dst, src, rel_type, dst_label, src_label FROM full_e),
assets AS (SELECT node_id, name FROM nodes WHERE label = 'Equipment'),
feeds AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type = 'FEEDS'),
fnodes AS (SELECT src AS node_id FROM feeds UNION SELECT dst FROM feeds)
"""

COVERAGE = GRAPH + """,
cov AS (SELECT node_id, name, CAST(sop AS BIGINT) AS sop, CAST(incident AS BIGINT) AS incident, CAST(maintenance AS BIGINT) AS maintenance, CAST(compliance AS BIGINT) AS compliance, n_experts, CAST(n_experts > 0 AS BIGINT) AS expert,
  CAST(25 * sop::INT + 20 * incident::INT + 20 * maintenance::INT + 20 * compliance::INT + 15 * (n_experts > 0)::INT AS BIGINT) AS coverage FROM (
  SELECT a.node_id, a.name,
    a.node_id IN (SELECT src FROM both_e WHERE rel_type IN ('PREVENTS', 'COMPLIES_WITH') AND dst_label = 'Procedure') AS sop,
    a.node_id IN (SELECT dst FROM full_e WHERE rel_type = 'OCCURRED_ON' AND src_label = 'Incident') AS incident,
    a.node_id IN (SELECT dst FROM full_e WHERE rel_type IN ('PERFORMED_ON', 'MAINTAINED_BY')) AS maintenance,
    a.node_id IN (SELECT src FROM full_e WHERE rel_type = 'COMPLIES_WITH' AND dst_label = 'Regulation') AS compliance,
    coalesce(x.n, 0) AS n_experts
  FROM assets a LEFT JOIN (SELECT dst, count(*) AS n FROM full_e WHERE rel_type IN ('KNOWLEDGE_OWNER_FOR', 'MAINTAINED_BY') AND src_label = 'Person' GROUP BY dst) x ON x.dst = a.node_id)),
rsk0 AS (SELECT *, CAST(node_id IN (SELECT dst FROM full_e WHERE rel_type = 'OCCURRED_ON' AND src_label = 'Incident' AND regexp_matches(lower(src_name), 'catastrophic|emergency|critical')) AS BIGINT) AS severe,
  CAST(node_id IN (SELECT a FROM und WHERE rel_type IN ('FEEDS', 'SUPPLIES', 'CONNECTED_TO') AND b IN (SELECT dst FROM full_e WHERE rel_type = 'OCCURRED_ON' AND src_label = 'Incident')) AS BIGINT) AS cascade FROM cov),
rsk AS (SELECT *, CAST(least(100, 30 * severe + CASE WHEN coverage < 50 THEN 25 WHEN coverage < 75 THEN 10 ELSE 0 END + CASE WHEN n_experts <= 1 THEN 20 ELSE 0 END + 15 * cascade + CASE WHEN incident = 1 AND sop = 0 THEN 10 ELSE 0 END) AS BIGINT) AS risk FROM rsk0)
"""

_CASE = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"
GAPS = COVERAGE + f""",
have AS (SELECT DISTINCT node_id, c FROM (SELECT a AS node_id, {_CASE("rel_type", CATEGORY_OF_RELATIONSHIP)} AS c FROM und JOIN nodes n ON n.node_id = und.b UNION ALL SELECT a, {_CASE("n.label", CATEGORY_OF_LABEL)} FROM und JOIN nodes n ON n.node_id = und.b) WHERE c IS NOT NULL),
cats AS (SELECT unnest(['SOP', 'Inspection', 'Maintenance', 'Failure', 'Compliance']) AS c),
miss AS (SELECT a.node_id, cats.c FROM assets a CROSS JOIN cats LEFT JOIN have h ON h.node_id = a.node_id AND h.c = cats.c WHERE h.c IS NULL),
gaps AS (SELECT a.node_id, coalesce(p.x, '') AS present, coalesce(m.x, '') AS missing, round(coalesce(p.n, 0) / CAST(5 AS DOUBLE) * 100, 1) AS pct FROM assets a
  LEFT JOIN (SELECT node_id, string_agg(c, '|' ORDER BY c) AS x, count(*) AS n FROM have GROUP BY 1) p USING (node_id) LEFT JOIN (SELECT node_id, string_agg(c, '|' ORDER BY c) AS x FROM miss GROUP BY 1) m USING (node_id))
"""

ENGINEERS = GRAPH + """,
own AS (SELECT DISTINCT src AS person, dst AS asset FROM both_e WHERE src_label = 'Person' AND dst_label IN ('Asset', 'Equipment')),
hit AS (SELECT DISTINCT dst AS asset FROM edges WHERE rel_type = 'OCCURRED_ON'),
alone AS (SELECT asset FROM own GROUP BY 1 HAVING count(*) = 1),
eng AS (SELECT n.node_id, n.name, n.retirement_risk, coalesce(degree, 0) AS degree, coalesce(critical, 0) AS critical, coalesce(sole, 0) AS sole FROM nodes n
  LEFT JOIN (SELECT person, count(*) AS degree, count(*) FILTER (asset IN (SELECT asset FROM hit)) AS critical, count(*) FILTER (asset IN (SELECT asset FROM alone)) AS sole FROM own GROUP BY 1) o ON o.person = n.node_id WHERE n.label = 'Person'),
eng2 AS (SELECT *, round_even(degree / CAST(100 AS DOUBLE), 3) AS centrality, CAST(least(100, 2 * degree + 10 * critical + 15 * sole) AS BIGINT) AS score, CASE WHEN sole >= 3 THEN 'Critical' WHEN sole >= 1 THEN 'High' WHEN critical >= 2 THEN 'Medium' ELSE 'Low' END AS level FROM eng)
"""

BREAKDOWN = GAPS + """,
brk AS (SELECT a.node_id, a.name, coalesce(i.n, 0) AS incidents, coalesce(w.n, 0) AS workorders, coalesce(g.n, 0) AS gaps, coalesce(p.n, 0) AS procs FROM assets a
  LEFT JOIN (SELECT dst AS node_id, count(DISTINCT src) AS n FROM full_e WHERE src_label = 'Incident' GROUP BY 1) i USING (node_id)
  LEFT JOIN (SELECT dst AS node_id, count(DISTINCT src) AS n FROM full_e WHERE src_label = 'WorkOrder' GROUP BY 1) w USING (node_id)
  LEFT JOIN (SELECT node_id, count(*) AS n FROM miss GROUP BY 1) g USING (node_id)
  LEFT JOIN (SELECT src AS node_id, count(DISTINCT dst) AS n FROM full_e WHERE dst_label = 'Procedure' GROUP BY 1) p USING (node_id)),
brk2 AS (SELECT *, CAST(15 * incidents + 5 * workorders + 10 * gaps + CASE WHEN procs = 0 THEN 20 ELSE 0 END AS BIGINT) AS score FROM brk),
brk3 AS (SELECT *, CASE WHEN score >= 50 THEN 'Critical' WHEN score >= 25 THEN 'High' WHEN score >= 10 THEN 'Medium' ELSE 'Low' END AS level FROM brk2)
"""


def _pagerank(rounds: int = 20) -> str:
    """Twenty rounds as a chain of tables."""
    out = ",\noutd AS (SELECT src, count(*) AS o FROM feeds GROUP BY 1), cnt AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM fnodes), sinks AS (SELECT node_id FROM fnodes WHERE node_id NOT IN (SELECT src FROM outd)), pr0 AS MATERIALIZED (SELECT node_id, 1 / n AS r FROM fnodes, cnt)"
    for i in range(1, rounds + 1):
        p = f"pr{i - 1}"
        out += f""",
pr{i} AS MATERIALIZED (SELECT f.node_id, (1 - CAST(0.85 AS DOUBLE)) / n + CAST(0.85 AS DOUBLE) * (coalesce(x.s, 0) + (SELECT coalesce(sum(r), 0) FROM {p} WHERE node_id IN (SELECT node_id FROM sinks)) / n) AS r FROM fnodes f CROSS JOIN cnt LEFT JOIN (SELECT dst, sum(r / o) AS s FROM feeds JOIN outd USING (src) JOIN {p} ON {p}.node_id = feeds.src GROUP BY 1) x ON x.dst = f.node_id)"""
    return out + f",\npr AS (SELECT node_id, r AS rank FROM pr{rounds})"


def _equipment_rank(rounds: int = 20) -> str:
    out = ",\nod AS (SELECT src, count(*) AS o FROM feeds GROUP BY 1), er0 AS MATERIALIZED (SELECT node_id, 1 - CAST(0.85 AS DOUBLE) AS r FROM assets)"
    for i in range(1, rounds + 1):
        out += f", er{i} AS MATERIALIZED (SELECT a.node_id, 1 - CAST(0.85 AS DOUBLE) + CAST(0.85 AS DOUBLE) * coalesce(x.s, 0) AS r FROM assets a LEFT JOIN (SELECT dst, sum(r / o) AS s FROM feeds JOIN od USING (src) JOIN er{i - 1} p ON p.node_id = feeds.src GROUP BY 1) x ON x.dst = a.node_id)"
    return out + f" SELECT node_id, name, round(r, 6) AS score FROM er{rounds} JOIN assets USING (node_id) ORDER BY 3 DESC, 1 LIMIT 50"


_HOP2 = f""",
seed AS (SELECT node_id FROM nodes WHERE name = '{SEED_NAME}'), h1 AS (SELECT DISTINCT b AS node_id FROM und WHERE a IN (SELECT node_id FROM seed)), h2 AS (SELECT DISTINCT b AS node_id FROM und WHERE a IN (SELECT node_id FROM h1)),
hops AS (SELECT node_id, min(h) AS hops FROM (SELECT node_id, 0 AS h FROM seed UNION ALL SELECT node_id, 1 FROM h1 UNION ALL SELECT node_id, 2 FROM h2) GROUP BY 1)
"""


def _path(step: str, source: str, target: str, k: int, depth: int = 5) -> str:
    return f""",
walk AS (SELECT '{source}' AS pos, ['{source}'] AS path UNION ALL SELECT s.b, list_append(w.path, s.b) FROM walk w JOIN ({step}) s ON s.a = w.pos WHERE w.pos <> '{target}' AND len(w.path) <= {depth} AND NOT list_contains(w.path, s.b))
SELECT CAST(len(path) - 1 AS BIGINT) AS hops, array_to_string(path, '>') AS path FROM walk WHERE pos = '{target}' ORDER BY 1, 2 LIMIT {k}"""


SENTENCES = f"""WITH s AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey, {_TAG} AS tag FROM part),
t AS (SELECT *, 'V-' || CAST(10 + p_partkey % 90 AS VARCHAR) AS v, CASE WHEN p_partkey % 2 = 0 THEN 'Ann Lee' ELSE 'Bob Ray' END AS who, 'WO-' || CAST(10000 + p_partkey AS VARCHAR) AS wo,
  tag || ' feeds V-' || CAST(10 + p_partkey % 90 AS VARCHAR) || '. ' || tag || ' is maintained by ' || CASE WHEN p_partkey % 2 = 0 THEN 'Ann Lee' ELSE 'Bob Ray' END || '.' || chr(10) || 'WO-' || CAST(10000 + p_partkey AS VARCHAR) || ' maintenance on ' || tag || ' done.' || chr(10) || 'SOP-12 covers ' || tag || '.' || chr(10) || 'Emergency shutdown of ' || tag || ' under ISO 9001.' AS text FROM s),
ent AS (SELECT id, name, min(i) AS i FROM (SELECT id, unnest(regexp_extract_all(text, '\\b([A-Z]{{1,3}}-\\d{{2,4}}[A-Z]?)\\b', 1)) AS name, 0 AS i FROM t UNION ALL SELECT id, unnest(regexp_extract_all(text, '\\b(WO-\\d{{4,6}})\\b', 1)), 1 FROM t
  UNION ALL SELECT id, unnest(regexp_extract_all(text, '\\b(SOP-\\d+|ITP-\\d+|SDS-\\d+)\\b', 1)), 2 FROM t UNION ALL SELECT id, unnest(regexp_extract_all(text, '\\b(ISO\\s+\\d+[\\d\\-]*|OSHA\\s+\\d+|API\\s+\\d+|NFPA\\s+\\d+)\\b', 1)), 3 FROM t) GROUP BY 1, 2),
rel AS (SELECT DISTINCT * FROM (SELECT id, wo AS source, tag AS target, 'PERFORMED_ON' AS type FROM t UNION ALL SELECT id, tag, v, 'FEEDS' FROM t UNION ALL SELECT id, 'SOP-12', tag, 'REFERENCES' FROM t UNION ALL SELECT id, tag, 'Emergency Event', 'AFFECTED_BY' FROM t UNION ALL SELECT id, who, tag, 'KNOWLEDGE_OWNER' FROM t)),
pre AS (SELECT unnest([{_q(TAG_WORDS)}]) AS p, unnest([{_q(TAG_WORDS.values())}]) AS w)
"""
_ENT_TYPE = "list_extract(['Equipment', 'Incident', 'Procedure', 'Regulation'], i + 1)"


def _canon(x: str) -> str:
    pat = r"(?i)\b(C|P|R|B|HX|CT|V)-?(\d+)\b"
    words = "CASE upper(regexp_extract({0}, '" + pat + "', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAG_WORDS.items()) + " END"
    return f"CASE WHEN regexp_extract({x}, '{pat}', 1) <> '' THEN {words.format(x)} || ' ' || upper(regexp_extract({x}, '{pat}', 1)) || '-' || regexp_extract({x}, '{pat}', 2) ELSE {x} END"


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_BM25 = """d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM d),
asked AS (SELECT query_id, t, count(*) AS times FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS t FROM qs) GROUP BY ALL),
dfs AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS t FROM d) GROUP BY 1),
raw AS (SELECT t, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM dfs, st),
idf AS (SELECT t, CASE WHEN raw < 0 THEN (SELECT 0.25::DOUBLE * avg(raw) FROM raw) ELSE raw END AS idf FROM raw WHERE t IN (SELECT t FROM asked)),
tf AS (SELECT id, l, t, count(*) AS tf FROM (SELECT id, len(w) AS l, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))) AS score FROM tf JOIN idf USING (t) JOIN asked USING (t), st GROUP BY ALL HAVING score > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)"""
_DENSE = "dn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"
_ITEMS = "qs AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0)"
_RUNS = "(SELECT {0} AS id, w, unnest(range(1, CAST(len(w) - 8 AS BIGINT))) AS i FROM (SELECT {0}, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {1}))"
_WINDOW = "strftime({0}, '%Y-%m-%dT%H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total"
_DELETE = GRAPH + ", le AS (SELECT * FROM edges WHERE source_doc_id IS DISTINCT FROM 3), ln AS (SELECT * FROM nodes WHERE NOT (source_doc_id = 3 AND node_id NOT IN (SELECT src FROM le UNION SELECT dst FROM le)))"

_ENDS = f"""WITH r AS (SELECT CAST(p_partkey AS BIGINT) AS k, {_TAG} AS ref, CASE p_partkey % 3 WHEN 0 THEN replace({_TAG}, '-', '') WHEN 1 THEN right(replace({_TAG}, '-', ''), 3) ELSE 'X1-' || replace({_TAG}, '-', '') END AS cid FROM part),
n AS (SELECT 'E:' || p_partkey AS node_id, replace({_TAG}, '-', '') AS canonical_id, {_TAG} AS alias, regexp_extract(replace({_TAG}, '-', ''), '[0-9]+') AS short_id FROM part),
hit AS (SELECT DISTINCT ref, cid, node_id FROM r JOIN n ON canonical_id = cid OR ref = alias OR short_id = cid OR ends_with(canonical_id, cid) OR ends_with(cid, canonical_id))"""

SQL: dict[str, str] = {
    "label_stats": GRAPH + "SELECT label, count(*) AS n FROM nodes GROUP BY 1",
    "neighbors": GRAPH + f"SELECT n.node_id, n.name, n.label, u.rel_type FROM und u JOIN nodes n ON n.node_id = u.b WHERE u.a IN (SELECT node_id FROM nodes WHERE name = '{SEED_NAME}') ORDER BY 1, 4 LIMIT 50",
    "neighborhood_2hop": GRAPH + _HOP2 + "SELECT node_id, label, hops, CASE WHEN hops = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score FROM hops JOIN nodes USING (node_id)",
    "induced_subgraph": GRAPH + "SELECT edge_id, src, dst, rel_type FROM full_e WHERE src_label IN ('Equipment', 'Person') AND dst_label IN ('Equipment', 'Person')",
    "temporal_subgraph": GRAPH + "SELECT rel_type, count(*) AS n FROM edges WHERE event_time IS NULL OR event_time <= '1996-01-01T00:00:00' GROUP BY 1",
    "incident_timeline": GRAPH + f"SELECT e.src AS node_id, src_name AS name, src_label AS label, rel_type, coalesce(n.event_time, e.event_time) AS event_time FROM full_e e JOIN nodes n ON n.node_id = e.src WHERE rel_type IN ('OCCURRED_ON', 'PERFORMED_ON', 'MAINTAINED_BY', 'INSPECTED_BY') AND dst_label = 'Equipment' AND dst_name = '{SEED_NAME}' ORDER BY 5 DESC NULLS LAST, 1 LIMIT 50",
    "orphan_nodes": GRAPH + "SELECT label, count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT a FROM und) GROUP BY 1",
    "duplicate_nodes": GRAPH + "SELECT regexp_replace(canonical_id, '[0-9]', '', 'g') AS canonical_id, count(*) AS n, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM nodes GROUP BY 1 HAVING count(*) > 1",
    "low_confidence_edges": GRAPH + "SELECT rel_type, count(*) AS n, round(avg(confidence), 6) AS mean FROM edges WHERE confidence < 0.5::DOUBLE GROUP BY 1",
    "degree_topk": GRAPH + "SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
    "suggestions_topk": GRAPH + ", top AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6) SELECT question FROM (SELECT degree, node_id, 0 AS i, CASE WHEN label = 'Equipment' THEN 'What incidents occurred on ' || name || '?' ELSE 'What is connected to ' || name || '?' END AS question FROM top JOIN nodes USING (node_id) UNION ALL SELECT degree, node_id, 1, CASE WHEN label = 'Equipment' THEN 'What is the risk level of ' || name || '?' ELSE 'Summarize ' || name || '.' END FROM top JOIN nodes USING (node_id) UNION ALL SELECT degree, node_id, 2, 'Who maintains ' || name || '?' FROM top JOIN nodes USING (node_id) WHERE label = 'Equipment') ORDER BY degree DESC, node_id, i LIMIT 6",
    "graph_density": GRAPH + ", c AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT a FROM und)) AS o, (SELECT count(*) FROM edges WHERE rel_type = 'IS_A') AS isa) SELECT n_nodes, n_edges, round(n_edges / CAST(n_nodes * (n_nodes - 1) AS DOUBLE), 8) AS density, round(2 * n_edges / CAST(n_nodes AS DOUBLE), 6) AS avg_degree, round(o / CAST(n_nodes AS DOUBLE), 6) AS orphan_ratio, round(isa / CAST(n_edges AS DOUBLE), 6) AS isa_ratio FROM c",
    "tenant_counts": GRAPH + "SELECT 't1' AS tenant_id, label, count(*) AS n FROM nodes WHERE length(node_id) % 2 = 1 GROUP BY 2",
    "graph_view": GRAPH + "SELECT src_label, rel_type, dst_label, count(*) AS n, count(DISTINCT src_name) AS sources, count(DISTINCT dst_name) AS targets FROM full_e GROUP BY 1, 2, 3",
    "k_shortest_paths": GRAPH + _path("SELECT src AS a, dst AS b FROM feeds", *PATH_ENDS, 3),
    "pagerank_20": GRAPH + _pagerank() + "SELECT node_id, round(rank, 9) AS rank FROM pr",
    "node_similarity": GRAPH + ", sz AS (SELECT src, count(*) AS n FROM feeds GROUP BY 1) SELECT x.src AS a, y.src AS b, round(count(*) / CAST(any_value(sx.n) + any_value(sy.n) - count(*) AS DOUBLE), 6) AS jaccard FROM feeds x JOIN feeds y ON x.dst = y.dst AND x.src < y.src JOIN sz sx ON sx.src = x.src JOIN sz sy ON sy.src = y.src GROUP BY 1, 2",
    "components_small": GRAPH + ", fu AS (SELECT src AS a, dst AS b FROM feeds UNION SELECT dst, src FROM feeds), reach AS (SELECT node_id AS r, node_id AS pos FROM fnodes UNION SELECT reach.r, fu.b FROM reach JOIN fu ON fu.a = reach.pos) SELECT component, count(*) AS n FROM (SELECT pos, min(r) AS component FROM reach GROUP BY 1) GROUP BY 1",
    "coverage_score": COVERAGE + "SELECT * EXCLUDE (name) FROM cov",
    "risk_score": COVERAGE + "SELECT node_id, coverage, n_experts, severe, cascade, risk, CASE WHEN risk >= 70 THEN 'Critical' WHEN risk >= 40 THEN 'High' WHEN risk >= 20 THEN 'Medium' ELSE 'Low' END AS level, array_to_string(list_filter([CASE WHEN severe = 1 THEN 'severe incident' END, CASE WHEN coverage < 50 THEN 'low coverage' END, CASE WHEN n_experts = 0 THEN 'no expert' WHEN n_experts = 1 THEN 'single expert' END, CASE WHEN cascade = 1 THEN 'connected to incident' END, CASE WHEN incident = 1 AND sop = 0 THEN 'incident without procedure' END], lambda x: x IS NOT NULL), ' + ') AS reasons FROM rsk",
    "category_gaps": GAPS + "SELECT * FROM gaps",
    "gap_edges": GAPS + "SELECT c AS category, count(*) AS n FROM miss GROUP BY 1",
    "all_gaps_top": GAPS + "SELECT node_id, missing, pct, risk, coverage FROM gaps JOIN rsk USING (node_id) ORDER BY risk DESC, node_id LIMIT 50",
    "engineer_roster": ENGINEERS + "SELECT node_id, degree, critical, sole, centrality, score, level FROM eng2",
    "engineer_summary": ENGINEERS + "SELECT count(*) AS total, count(*) FILTER (level IN ('High', 'Critical')) AS high_risk, round_even(sum(score) / CAST(greatest(count(*), 1) AS DOUBLE), 1) AS mean_score FROM eng2",
    "unprotected_assets": ENGINEERS + "SELECT a.node_id, a.name FROM assets a WHERE a.node_id IN (SELECT asset FROM hit) AND NOT EXISTS (SELECT 1 FROM own o JOIN eng2 e ON e.node_id = o.person WHERE o.asset = a.node_id AND e.level NOT IN ('High', 'Critical'))",
    "knowledge_concentration": GRAPH + ", b AS (SELECT src AS node_id, src_name AS name, count(*) AS events FROM full_e WHERE rel_type IN ('MAINTAINED_BY', 'INSPECTED_BY') AND src_label = 'Person' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20), s AS (SELECT *, round(events / CAST(sum(events) OVER () AS DOUBLE) * 100, 1) AS share FROM b) SELECT *, CASE WHEN share >= 60 THEN 'HIGH' WHEN share >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s",
    "engineer_expertise": GRAPH + "SELECT n.node_id, n.name, CAST(least(100, sum(CASE rel_type WHEN 'MAINTAINED_BY' THEN 3 WHEN 'INSPECTED_BY' THEN 2 WHEN 'INVOLVED_IN' THEN 4 WHEN 'REPORTED_BY' THEN 4 WHEN 'AUTHORED_BY' THEN 1 ELSE 0 END)) AS BIGINT) AS expertise FROM und JOIN nodes n ON n.node_id = und.a WHERE n.label = 'Person' GROUP BY 1, 2",
    "engineer_profile": GRAPH + ", c AS (SELECT a, count(*) FILTER (label IN ('Document', 'Procedure')) AS d, count(*) FILTER (label = 'Incident') AS i, count(*) FILTER (label IN ('Asset', 'Equipment')) AS e FROM (SELECT DISTINCT a, b FROM und) u JOIN nodes n ON n.node_id = u.b GROUP BY 1) SELECT node_id, round(least(CAST(1 AS DOUBLE), 0.1::DOUBLE * coalesce(d, 0) + 0.05::DOUBLE * coalesce(i, 0) + 0.15::DOUBLE * coalesce(e, 0)), 6) AS knowledge, CAST(CASE WHEN retirement_risk = 'HIGH' THEN 0.9 WHEN coalesce(e, 0) > 3 AND coalesce(d, 0) < 2 THEN 0.8 WHEN coalesce(e, 0) > 1 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS risk FROM nodes LEFT JOIN c ON c.a = node_id WHERE label = 'Person'",
    "equipment_expert_risk": ENGINEERS + "SELECT asset, person, CAST(CASE WHEN retirement_risk = 'HIGH' THEN 0.9 ELSE 0.3 END AS DOUBLE) AS risk, count(*) OVER (PARTITION BY asset) > 1 AS has_backup FROM own JOIN nodes ON node_id = person",
    "risk_breakdown": BREAKDOWN + "SELECT node_id, incidents, workorders, gaps, procs, score, level FROM brk3",
    "risk_bands": BREAKDOWN + "SELECT level, count(*) AS n, round(avg(score), 2) AS mean FROM brk3 GROUP BY 1",
    "risk_assets": BREAKDOWN + _pagerank() + "SELECT node_id, name, round(least(CAST(100 AS DOUBLE), score + least(CAST(30 AS DOUBLE), 200 * coalesce(rank, 0))), 4) AS score, CAST(CASE WHEN contains(name, 'Reactor') THEN 500000 ELSE 250000 END AS BIGINT) AS downtime_cost FROM brk3 LEFT JOIN pr USING (node_id) ORDER BY least(CAST(100 AS DOUBLE), score + least(CAST(30 AS DOUBLE), 200 * coalesce(rank, 0))) DESC, node_id LIMIT 20",
    "risk_timeline": GRAPH + f"SELECT kind, severity, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT 'retirement' AS kind, 'High' AS severity, strftime(TIMESTAMP '{AS_OF}' + INTERVAL 365 DAY, '%Y-%m-%d') AS date FROM nodes WHERE label = 'Person' AND retirement_risk = 'HIGH' UNION ALL SELECT 'ageing', CASE WHEN date_diff('day', CAST(substr(event_time, 1, 10) AS DATE), DATE '2000-01-01') > 1825 THEN 'Critical' ELSE 'Medium' END, substr(event_time, 1, 10) FROM nodes WHERE label = 'WorkOrder' AND date_diff('day', CAST(substr(event_time, 1, 10) AS DATE), DATE '2000-01-01') > 365) GROUP BY 1, 2",
    "system_metrics": GRAPH + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM assets) AS assets, (SELECT count(embedding) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS documents, round((SELECT count(DISTINCT src) FROM full_e WHERE src_label = 'Equipment' AND dst_label = 'Procedure') / CAST((SELECT count(*) FROM assets) AS DOUBLE) * 100, 2) AS coverage_pct",
    "stats_summary": COVERAGE + "SELECT count(*) AS assets, count(*) FILTER (coverage >= 50) AS covered, CAST(floor(avg(coverage)) AS BIGINT) AS mean_coverage, round(avg(coverage), 4) AS exact_mean FROM cov",
    "canonicalize": SENTENCES + f"SELECT id, {_canon('tag')} AS name FROM t",
    "regex_entities": SENTENCES + f"SELECT id, name, {_ENT_TYPE} AS type, CAST(0.85 AS DOUBLE) AS confidence FROM ent",
    "rule_relationships": SENTENCES + "SELECT *, CAST(0.8 AS DOUBLE) AS confidence FROM rel",
    "rel_merge": SENTENCES + f"SELECT {_canon('source')} AS source, {_canon('target')} AS target, type, CAST(0.8 AS DOUBLE) AS confidence, count(DISTINCT id) AS n_texts FROM rel GROUP BY 1, 2, 3",
    "entity_confidence": SENTENCES + f"SELECT name, {_ENT_TYPE} AS type, round(CAST(0.65 AS DOUBLE) + CASE WHEN count(DISTINCT id) > 1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN length(name) < 3 THEN CAST(0.15 AS DOUBLE) ELSE 0 END, 6) AS confidence FROM ent GROUP BY name, i",
    "remap_types": GRAPH + f", k AS (SELECT CASE length(edge_id) % 3 WHEN 0 THEN 'OWNED_BY' WHEN 1 THEN rel_type ELSE 'INVENTED' END AS kind FROM edges) SELECT CASE WHEN kind IN ({_q(RELATIONSHIPS)}) THEN kind ELSE coalesce({_CASE('kind', RELATIONSHIP_REMAP)}, 'RELATED_TO') END AS rel_type, count(*) AS n FROM k GROUP BY 1",
    "ontology_classify": f"SELECT CAST(p_partkey AS BIGINT) AS id, CASE {' '.join(f'WHEN {_any(f"upper({_WORD} || chr(32) || {_TAG})", keys)} THEN {chr(39)}{sub}{chr(39)}' for top, _, sub, keys in ONTOLOGY if top == 'Equipment')} END AS subclass FROM part",
    "risk_signal_flag": f"SELECT doc_id, {_any('lower(text)', RISK_SIGNALS)} AS risk FROM documents",
    "keyword_extract": f"SELECT item_id, coalesce(array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|'), '') AS keywords FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-]*'), lambda x: length(x) > 3 AND lower(x) NOT IN ({_q(STOP_WORDS)})) AS k FROM benchmark)",
    "clause_extract": "WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn || '.' || turn % 3 || ' ' ELSE '' END || regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS line FROM conversations WHERE text IS NOT NULL), g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^([0-9]+\\.[0-9]+|Section\\b)') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, line ROWS UNBOUNDED PRECEDING) AS c FROM l), k AS (SELECT conv_id, c, trim(string_agg(line, chr(10) ORDER BY turn, line), ' ' || chr(10)) AS clause FROM g GROUP BY 1, 2) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY c) - 1 AS INTEGER) AS i, clause FROM k WHERE length(clause) > 20",
    "intent_classify": f"SELECT conv_id, turn, CASE {' '.join(f'WHEN {_any("lower(text)", w)} THEN {chr(39)}{n}{chr(39)}' for n, w in INTENTS)} WHEN {_any('lower(text)', METADATA_WORDS[0])} AND {_any('lower(text)', METADATA_WORDS[1])} THEN 'metadata' ELSE 'general' END AS intent, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) > 10 OR len(regexp_extract_all(text, '\\b([A-Z]{{1,3}}-\\d{{2,4}}[A-Z]?)\\b', 1)) > 1 AS complex FROM conversations",
    "csv_row_sentences": "SELECT CAST((n - 1) // 100 + 1 AS BIGINT) AS page, n AS row, 'Row ' || n || ': s_suppkey=' || s_suppkey || ', s_name=' || s_name || ', s_nationkey=' || s_nationkey || '.' AS sentence FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)",
    "levenshtein_pairs": "SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(levenshtein(a.s_name, b.s_name) AS BIGINT) AS d FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE levenshtein(a.s_name, b.s_name) <= 2",
    "bm25_topk": f"WITH {_ITEMS}, {_BM25} SELECT query_id, id, round(score, 6) AS score FROM best WHERE rank <= 10",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, id, round(score, 5) AS score FROM dn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dn.score DESC, id) <= 10",
    "rrf_fusion": f"WITH {_ITEMS}, {_BM25}, {_DENSE}, dr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dn WHERE query_id IN (SELECT query_id FROM qs) AND id IN (SELECT doc_id FROM documents)), both_ AS (SELECT 0 AS arm, query_id, id, rank FROM best WHERE rank <= 20 UNION ALL SELECT 1, query_id, id, rank FROM dr WHERE rank <= 20), arms AS (SELECT arm, query_id, trim(text) AS text, min(rank) AS rank, min(id) AS id FROM both_ JOIN documents ON doc_id = id WHERE trim(text) <> '' GROUP BY 1, 2, 3) SELECT query_id, min(id) AS id, round(sum(1 / CAST(60 + rank AS DOUBLE)), 8) AS rrf FROM arms GROUP BY query_id, text",
    "keyword_overlap": "SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN\\pM_]{3,}')), ['the', 'and', 'with'])) / CAST(3 AS DOUBLE), 6) AS overlap FROM documents",
    "fulltext_nodes": GRAPH + "SELECT node_id, name, label FROM nodes WHERE contains(regexp_replace(lower(name), '[- ]', '', 'g'), 'p12') OR contains('p12', regexp_replace(lower(name), '[- ]', '', 'g')) ORDER BY node_id LIMIT 20",
    "upsert_nodes": GRAPH + "SELECT label, regexp_replace(canonical_id, '[0-9]$', '') AS canonical_id, max(length(name) % 10 / CAST(10 AS DOUBLE)) AS confidence, max_by(name, {'c': length(name) % 10 / CAST(10 AS DOUBLE), 'n': name}) AS name, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases FROM nodes WHERE label = 'Equipment' GROUP BY 1, 2",
    "upsert_edges": GRAPH + ", k AS (SELECT src, dst, rel_type, max(confidence) AS confidence FROM edges WHERE confidence >= 0.4::DOUBLE AND src <> dst AND src IN (SELECT node_id FROM nodes WHERE source_doc_id <> 3) AND dst IN (SELECT node_id FROM nodes WHERE source_doc_id <> 3) GROUP BY 1, 2, 3) SELECT rel_type, count(*) AS n, round(sum(confidence), 4) AS total FROM k GROUP BY 1",
    "delete_cascade": _DELETE + "SELECT label, count(*) AS n FROM ln GROUP BY 1 UNION ALL SELECT rel_type, count(*) FROM le GROUP BY 1",
    "cross_doc_links": GRAPH + ", q AS (SELECT node_id, substr(canonical_id, 1, 2) AS c FROM nodes WHERE label = 'Equipment'), f AS (SELECT c, min(node_id) AS src FROM q GROUP BY 1) SELECT src, 'RELATED_TO' AS rel_type, count(*) AS n FROM q JOIN f USING (c) WHERE node_id <> src AND NOT EXISTS (SELECT 1 FROM und WHERE a = src AND b = node_id) GROUP BY 1",
    "cooccurrence_edges": "WITH m AS (SELECT DISTINCT l_orderkey AS d, 'E:' || l_partkey AS name, 'Equipment' AS label FROM lineitem UNION SELECT DISTINCT l_orderkey, 'P:' || l_suppkey, 'Person' FROM lineitem) SELECT DISTINCT x.name AS src, y.name AS dst, CASE WHEN x.label <> y.label THEN 'MAINTAINED_BY' ELSE 'RELATED_TO' END AS rel_type FROM m x JOIN m y ON x.d = y.d AND x.name < y.name",
    "exact_dedup_keep_oldest": "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "hash_precheck": "SELECT doc_id FROM documents WHERE source = 'src1' AND text IN (SELECT text FROM documents WHERE source <> 'src1')",
    "extraction_cache": "SELECT source, count(*) AS n FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY 1",
    "replace_chunks": "SELECT document_id, count(*) AS n, count(*) FILTER (text = 'new') AS new FROM (SELECT conv_id AS document_id, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 5 = 0 AND turn = 0) UNION ALL SELECT conv_id, 'new' FROM conversations WHERE conv_id % 5 = 0 AND turn = 0) GROUP BY 1",
    "ordered_concat": "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS text_hash FROM conversations GROUP BY 1",
    "integrity_report": "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing_vectors, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphaned_vectors",
    "referential_check": "SELECT 'l_orderkey' AS key, count(*) AS broken FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "stuck_jobs": f"SELECT s AS status, CASE WHEN s <> 'completed' AND o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE THEN 'failed' ELSE s END AS new_status, count(*) AS n FROM (SELECT *, CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'O' THEN 'pending' ELSE 'completed' END AS s FROM orders) GROUP BY 1, 2",
    "latest_job": "SELECT CAST(o_custkey % 100 AS BIGINT) AS document_id, CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderstatus NOT IN ('P', 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "backfill_tenant": "SELECT CASE WHEN doc_id % 2 = 0 THEN 't1' ELSE 'default' END AS tenant_id, count(*) AS n FROM documents GROUP BY 1",
    "rate_limit_sliding": "SELECT event_id, a AS before, a >= 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, ts) + row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) - 1 AS a FROM events)",
    "daily_quota": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS used, count(*) < 50 AS healthy FROM events GROUP BY 1",
    "latency_rollup": "SELECT event_type, count(*) AS calls, round(sum(value) / 1000, 6) AS seconds FROM events GROUP BY 1",
    "latest_status": "SELECT user_id, max_by(event_type, {'t': ts, 'e': event_id}) AS last, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS at FROM events GROUP BY 1",
    "tumbling_window": f"SELECT {_WINDOW.format('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)')} FROM events GROUP BY 1, 2",
    "sliding_window": f"SELECT {_WINDOW.format('w')} FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY w, event_type",
    "session_window": "SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') AS stop, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s",
    "activity_feed": "SELECT event_id, upper(event_type[1]) || event_type[2:] AS title, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'success' ELSE 'info' END AS severity FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "eval_precision_recall": "WITH x AS (SELECT count(*) FILTER (n_chars >= 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars >= 1000) AS said, count(*) FILTER (quality = 1) AS t FROM labels JOIN documents USING (doc_id)), y AS (SELECT tp / CAST(greatest(said, 1) AS DOUBLE) AS p, tp / CAST(greatest(t, 1) AS DOUBLE) AS r FROM x) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM y",
    "latency_p95_exclusive": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n, median(value) AS p50 FROM events GROUP BY 1), j AS (SELECT *, CAST(0.95 AS DOUBLE) * (n + 1) AS pos, CAST(least(greatest(floor(CAST(0.95 AS DOUBLE) * (n + 1)), 1), n - 1) AS BIGINT) AS j FROM s) SELECT event_type, round(p50, 6) AS p50, round(v[j] + (pos - j) * (v[j + 1] - v[j]), 6) AS p95 FROM j",
    "retrieval_eval": f"WITH qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_BM25}, wi AS (SELECT DISTINCT id AS query_id, array_to_string(w[i:i + 9], ' ') AS g FROM {_RUNS.format('item_id', 'benchmark')}), wd AS (SELECT DISTINCT id, array_to_string(w[i:i + 9], ' ') AS g FROM {_RUNS.format('doc_id', 'documents')}), good AS (SELECT DISTINCT query_id, id FROM wd JOIN wi USING (g)), f AS (SELECT query_id, min(rank) AS first FROM best JOIN good USING (query_id, id) WHERE rank <= 10 GROUP BY 1) SELECT count(first) AS hits, count(*) AS queries, round(avg(coalesce(1 / CAST(first AS DOUBLE), 0)), 6) AS mrr FROM qs LEFT JOIN f USING (query_id)",
    "search_descriptions": GRAPH + f", k AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'check ' || {_WORD} || ' ' || {_TAG} || ' now' WHEN 1 THEN 'in ' || p_partkey ELSE substr({_TAG}, 1, 4) END AS term FROM part WHERE p_partkey % 100 < 3), z AS (SELECT term, regexp_replace(lower(term), '[- ]', '', 'g') AS t FROM k), s AS (SELECT node_id, name, label, unnest([regexp_replace(lower(name), '[- ]', '', 'g'), regexp_replace(lower('made in ' || source_doc_id || '-' || length(node_id)), '[- ]', '', 'g')]) AS said FROM nodes), m AS (SELECT DISTINCT term, node_id, name, label FROM s JOIN z ON said <> '' AND (contains(said, t) OR contains(t, said))) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY term ORDER BY node_id) <= 20",
    "resolve_endpoints": _ENDS + "SELECT cid, ref, count(*) AS n, min(node_id) AS first FROM hit GROUP BY ALL",
    "upsert_resolved": _ENDS + ", b AS (SELECT DISTINCT ref AS target, cid AS target_cid, k - 7 AS k FROM r), x AS (SELECT s.node_id AS src, d.node_id AS dst, k % 10 / CAST(10 AS DOUBLE) AS confidence, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS event_time, 'seen with ' || target AS evidence FROM r JOIN b USING (k) JOIN hit s ON s.ref = r.ref AND s.cid = r.cid JOIN hit d ON d.ref = target AND d.cid = target_cid WHERE s.node_id <> d.node_id AND k % 10 / CAST(10 AS DOUBLE) >= CAST(0.4 AS DOUBLE)) SELECT src, dst, 'CONNECTED_TO' AS rel_type, max(confidence) AS confidence, min(event_time) AS event_time, first(evidence ORDER BY length(evidence) DESC, evidence) AS evidence FROM x GROUP BY src, dst",
    "bulk_upsert": GRAPH + "SELECT 'node' AS kind, CASE WHEN p_partkey % 5 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS confidence, CAST(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS properties, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'edge', CASE WHEN src = 'E:0' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END, CAST(0 AS BIGINT), count(*) FROM feeds GROUP BY ALL",
    "parse_dates": "SELECT event_id, CASE event_id % 7 WHEN 5 THEN strftime(ts, '%Y-%m-%dT00:00:00') WHEN 6 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS at FROM events",
    "equipment_pagerank": GRAPH + _equipment_rank(),
    "search_nodes": GRAPH + f", k AS (SELECT DISTINCT {_TAG} AS term FROM part WHERE p_partkey % 100 = 0), m AS (SELECT term, node_id, name, label FROM nodes JOIN k ON contains(regexp_replace(lower(name), '[- ]', '', 'g'), regexp_replace(lower(term), '[- ]', '', 'g')) OR contains(regexp_replace(lower(term), '[- ]', '', 'g'), regexp_replace(lower(name), '[- ]', '', 'g')) WHERE regexp_replace(name, '[- ]', '', 'g') <> '') SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY term ORDER BY node_id) <= 20",
}

_JOB = "CASE WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'completed' END"
_POINTS = "p AS (SELECT 't' || (conv_id % 2) AS tenant_id, conv_id, text, sha256('t' || (conv_id % 2) || '|' || conv_id || '|' || turn) AS point_id FROM conversations)"

SQL |= {
    "valid_subgraph": GRAPH + """SELECT rel_type, count(*) AS n FROM edges e JOIN nodes s ON s.node_id = e.src WHERE (s.event_time IS NULL OR s.event_time <= '1996-06-01T00:00:00') AND (e.event_time IS NULL OR e.event_time <= '1996-06-01T00:00:00')
      AND (length(e.edge_id) % 2 <> 0 OR '1997-01-01T00:00:00' >= '1996-06-01T00:00:00') GROUP BY 1""",
    "duplicate_total": GRAPH + ", g AS (SELECT count(*) AS n FROM nodes GROUP BY regexp_replace(name, '[0-9]', '', 'g'), label HAVING count(*) > 1) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicates, count(*) AS groups FROM g",
    "compliance_context": "SELECT conv_id AS document_id, length(x) AS n_chars, sha256(x) AS text_hash FROM (SELECT conv_id, left(string_agg(text, chr(10) ORDER BY turn, text), 4000) AS x FROM conversations GROUP BY 1)",
    "hit_filenames": "SELECT 3 * vec_id AS id, coalesce(source, 'Document') AS filename FROM embeddings LEFT JOIN documents ON doc_id = 3 * vec_id",
    "citations": f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS citation FROM dn) SELECT query_id, citation, id, CASE WHEN length(text) > 180 THEN left(text, 180) || '...' ELSE text END AS snippet FROM r JOIN documents ON doc_id = id WHERE citation <= 10",
    "vector_upsert": f"WITH {_POINTS} SELECT tenant_id, count(*) AS n, count(DISTINCT point_id) AS points, count(*) FILTER (conv_id % 3 = 0) AS new, min(point_id) AS least FROM p WHERE NOT (conv_id % 5 = 0 AND tenant_id = 't1') GROUP BY 1",
    "purge_stuck": "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS documents, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS chunks",
    "active_recent_jobs": f"SELECT {_JOB} AS status, count(*) AS n FROM orders WHERE o_custkey % 100 % 5 NOT IN (0, 1) AND o_orderdate >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 365 DAY GROUP BY 1",
    "job_status": f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, {_JOB} AS status, CASE WHEN {_JOB} = 'completed' THEN coalesce(n, 0) END AS n_chunks, {_JOB} <> 'completed' OR coalesce(n, 0) > 0 AS passes
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey""",
    "job_progress": """SELECT job, stage, processed, total, CAST(CASE WHEN processed = total THEN 100 ELSE least(99, 100 * processed // total) END AS BIGINT) AS percent
      FROM (SELECT user_id AS job, last(event_type ORDER BY ts, event_id) AS stage, count(*) FILTER (event_type <> 'error') AS processed, count(*) AS total FROM events GROUP BY 1)""",
    "node_metrics": GRAPH + """, deg AS (SELECT n AS node_id, count(*) AS degree FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1), fed AS (SELECT dst AS node_id, count(*) AS f FROM edges WHERE rel_type = 'FEEDS' GROUP BY 1)
      SELECT label, count(degree) AS linked, CAST(sum(degree) AS BIGINT) AS degrees, CAST(sum(f) AS BIGINT) AS fed_by FROM nodes LEFT JOIN deg USING (node_id) LEFT JOIN fed USING (node_id) GROUP BY 1""",
    "applicable_regulations": GRAPH + """, near AS (SELECT DISTINCT x.source_doc_id, n.name AS regulation FROM und JOIN nodes n ON n.node_id = und.b AND n.label = 'Regulation' JOIN nodes x ON x.node_id = und.a),
      k AS (SELECT *, row_number() OVER (PARTITION BY source_doc_id ORDER BY regulation) AS r FROM near) SELECT source_doc_id, regulation FROM k WHERE r <= 10""",
    "regulation_scope": GRAPH + "SELECT node_id, regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g') AS identifier FROM nodes WHERE label = 'Regulation' AND (contains(lower(name), 'nation_1') OR contains(lower(canonical_id), 'nation_1'))",
    "lessons_evidence": GRAPH + "SELECT DISTINCT und.a AS incident, o.name AS other FROM und JOIN nodes i ON i.node_id = und.a AND i.label = 'Incident' JOIN nodes o ON o.node_id = und.b WHERE contains(o.name, 'Pump') ORDER BY 1, 2 LIMIT 10",
    "dashboard_summary": GRAPH + f"SELECT (SELECT count(*) FROM orders WHERE {_JOB} = 'completed') AS completed, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM assets) AS assets, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM conversations) AS chunks",
}

_NAME = f"({_WORD} || ' ' || {_TAG})"
_TAGS = r"'\b([A-Z]{1,3}-\d{2,4}[A-Z]?)\b'"
_NORM = lambda c: f"regexp_replace(lower({c}), '[- ]', '', 'g')"
_ASKED = f"""q AS (SELECT CAST(p_partkey AS BIGINT) AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'Why does ' || {_NAME} || ' vibrate' WHEN 1 THEN 'status ' || {_TAG} || ' ' || p_brand WHEN 2 THEN 'the rules of part ' || p_partkey ELSE 'nothing known' END AS query,
  CASE WHEN p_partkey % 4 = 2 THEN 'is ' || {_NAME} || ' safe' END AS sub FROM part)"""
_SEEDS = GRAPH + f""", {_ASKED},
w AS (SELECT query_id, 0 AS n, query AS term FROM q UNION ALL SELECT query_id, 1, sub FROM q WHERE sub IS NOT NULL),
kw AS (SELECT query_id, unnest(k[1:5]) AS term, generate_subscripts(k[1:5], 1) - 1 AS n FROM (SELECT query_id, list_filter(k0, lambda x, i: list_position(k0, x) = i) AS k FROM (SELECT query_id, list_filter(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9\\-]*'), lambda x: length(x) > 3 AND lower(x) NOT IN ({_q(STOP_WORDS)})) AS k0 FROM q))),
terms AS (SELECT term, {_NORM("term")} AS t FROM (SELECT term FROM w UNION SELECT term FROM kw)),
nn AS (SELECT node_id, name, {_NORM("name")} AS m FROM nodes),
found AS (SELECT term, node_id, name FROM (SELECT term, node_id, name, row_number() OVER (PARTITION BY term ORDER BY node_id) AS r FROM terms JOIN nn ON contains(m, t) OR contains(t, m)) WHERE r <= 20),
h1 AS (SELECT query_id, n, node_id, name FROM w JOIN found USING (term)),
kc AS (SELECT query_id, n, term, (SELECT count(*) FROM found f WHERE f.term = kw.term) AS hits FROM kw WHERE query_id NOT IN (SELECT query_id FROM h1)),
kb AS (SELECT *, coalesce(sum(hits) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kc),
h AS (SELECT * FROM h1 UNION ALL SELECT query_id, n, node_id, name FROM kb JOIN found USING (term) WHERE before < 5),
five AS (SELECT query_id, 1 AS kind, n, node_id, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, node_id) AS r FROM h) WHERE r <= 5),
tg AS (SELECT query_id, 0 AS kind, generate_subscripts(g, 1) - 1 AS n, '' AS node_id, unnest(g) AS name FROM (SELECT query_id, regexp_extract_all(query, {_TAGS}, 1) AS g FROM q)),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY kind, n, node_id) AS r FROM (SELECT * FROM five UNION ALL SELECT * FROM tg))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, n, node_id, name) - 1 AS place, name FROM u WHERE r = 1"""
_GOOD = f"WITH qs AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_BM25}, wi AS (SELECT DISTINCT id AS query_id, array_to_string(w[i:i + 9], ' ') AS g FROM {_RUNS.format('item_id', 'benchmark')}), wd AS (SELECT DISTINCT id, array_to_string(w[i:i + 9], ' ') AS g FROM {_RUNS.format('doc_id', 'documents')}), good AS (SELECT DISTINCT query_id, id FROM wd JOIN wi USING (g))"
_UPLOADS = "d AS (SELECT doc_id AS place, source || '/' || length(text) AS filename, sha256(text) AS file_hash, source FROM documents), b AS (SELECT *, filename IN (SELECT filename FROM d WHERE place % 50 = 0) AS named FROM d), f AS (SELECT file_hash, min(place) AS first FROM b WHERE NOT named GROUP BY 1)"

SQL |= {
    "procedures_lookup": GRAPH + f""", q AS (SELECT CAST(p_partkey AS BIGINT) AS query_id, CASE WHEN p_partkey % 4 < 2 THEN {_NAME} WHEN p_partkey % 4 = 2 THEN p_brand ELSE 'no such thing' END AS mode FROM part),
      near AS (SELECT DISTINCT query_id, p.name FROM q JOIN assets a ON a.name = mode JOIN und ON und.a = a.node_id JOIN nodes p ON p.node_id = und.b AND p.label = 'Procedure'),
      broad AS (SELECT DISTINCT query_id, p.name FROM q JOIN nodes p ON p.label = 'Procedure' AND contains(p.name, mode)),
      arms AS (SELECT *, 0 AS arm FROM near UNION ALL SELECT *, 1 FROM broad UNION ALL SELECT query_id, unnest(['General safety', 'Work permits']), 2 FROM q),
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY name) AS r, min(arm) OVER (PARTITION BY query_id) AS best FROM arms) SELECT query_id, name, arm FROM k WHERE arm = best AND r <= 5""",
    "regulations_fallback": GRAPH + """, q AS (SELECT DISTINCT source_doc_id, CASE source_doc_id % 3 WHEN 0 THEN 'NATION_' || source_doc_id % 10 WHEN 2 THEN 'no such scope' END AS scope FROM nodes),
      ok AS (SELECT a, b FROM und JOIN edges USING (edge_id) WHERE edges.rel_type <> 'COMPLIES_WITH' OR source_doc_id % 2 = 0), reg AS (SELECT node_id, name, canonical_id FROM nodes WHERE label = 'Regulation'),
      near AS (SELECT source_doc_id, name, canonical_id, 0 AS arm FROM (SELECT *, row_number() OVER (PARTITION BY source_doc_id ORDER BY name, canonical_id) AS r FROM (SELECT DISTINCT n.source_doc_id, reg.name, reg.canonical_id FROM nodes n JOIN ok ON ok.a = n.node_id JOIN reg ON reg.node_id = ok.b)) WHERE r <= 10),
      got AS (SELECT * FROM near UNION ALL SELECT source_doc_id, name, canonical_id, 1 FROM (SELECT DISTINCT source_doc_id FROM q WHERE source_doc_id NOT IN (SELECT source_doc_id FROM near)), (SELECT DISTINCT name, canonical_id FROM reg ORDER BY 1, 2 LIMIT 5)),
      kept AS (SELECT DISTINCT source_doc_id, name, arm FROM got JOIN q USING (source_doc_id) WHERE contains(lower(name), lower(coalesce(scope, ''))) OR contains(lower(canonical_id), lower(coalesce(scope, ''))))
      SELECT * FROM kept UNION ALL SELECT source_doc_id, 'General safety', 2 FROM q WHERE source_doc_id NOT IN (SELECT source_doc_id FROM kept)""",
    "graph_seeds": _SEEDS,
    "seed_subgraph": GRAPH + f""", st AS (SELECT CAST(p_partkey AS BIGINT) AS query_id, node_id FROM part JOIN nodes ON name = {_NAME}), un AS (SELECT DISTINCT a, b FROM und WHERE rel_type <> 'FEEDS'),
      l1 AS (SELECT DISTINCT query_id, b AS node_id FROM st JOIN un ON a = node_id), l2 AS (SELECT DISTINCT query_id, b AS node_id FROM l1 JOIN un ON a = node_id),
      hp AS (SELECT query_id, node_id, min(h) AS hops FROM (SELECT *, 0 AS h FROM st UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY ALL),
      k AS (SELECT query_id, node_id, hops FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, node_id) AS r FROM hp) WHERE r <= 40),
      en AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d, rel_type FROM edges WHERE rel_type <> 'FEEDS'),
      m AS (SELECT x.query_id, count(*) AS n_edges FROM k x JOIN en ON s = x.node_id JOIN k y ON y.query_id = x.query_id AND y.node_id = d GROUP BY 1)
      SELECT query_id, count(*) AS n_nodes, sum(CASE WHEN hops = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END) AS score, max(node_id) AS last, coalesce(any_value(n_edges), 0) AS n_edges FROM k LEFT JOIN m USING (query_id) GROUP BY 1""",
    "query_routes": f"SELECT conv_id, turn, CASE WHEN intent = 'metadata' THEN 'registry' ELSE 'search' END AS route, CASE WHEN complex THEN 30 ELSE 20 END AS candidates, CASE WHEN complex THEN 15 ELSE 8 END AS answers FROM ({SQL['intent_classify']})",
    "registry_listing": "SELECT o_orderkey AS id, '- ' || o_orderpriority || ' (Status: ' || CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'processing' END || ', Type: pdf, Uploaded: ' || strftime(o_orderdate, '%Y-%m-%d') || ')' AS line FROM orders WHERE o_orderstatus <> 'P'",
    "lessons_by_topic": GRAPH + f""", tp AS (SELECT DISTINCT CAST(p_partkey % 7 AS BIGINT) AS query_id, {_WORD} AS topic FROM part),
      dn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id < 7),
      inc AS (SELECT DISTINCT query_id, und.b AS item FROM tp JOIN nodes o ON contains(o.name, topic) JOIN und ON und.a = o.node_id JOIN nodes i ON i.node_id = und.b AND i.label = 'Incident')
      SELECT query_id, 'chunk' AS kind, CAST(id AS VARCHAR) AS item, rank FROM dn JOIN tp USING (query_id) WHERE rank <= 5 UNION ALL SELECT query_id, 'incident', item, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item) AS r FROM inc) WHERE r <= 10""",
    "extract_cached": SENTENCES + f""", kept AS (SELECT id FROM t WHERE id % 3 = 0 AND id % 5 <> 0),
      nm AS (SELECT id, {_canon("name")} AS name, {_ENT_TYPE} AS type, CAST(0.85 AS DOUBLE) AS confidence, 0 AS arm, i, p FROM (SELECT e.id, name, i, instr(text, name) AS p FROM ent e JOIN t ON t.id = e.id) UNION ALL SELECT id, 'Unit ' || id, 'Entity', CAST(0.6 AS DOUBLE), 1, 0, 0 FROM t WHERE id % 2 = 0),
      o AS (SELECT id, name, type, confidence, row_number() OVER (PARTITION BY id ORDER BY arm, i, p) - 1 AS place FROM nm WHERE id NOT IN (SELECT id FROM kept))
      SELECT id, false AS cached, CAST(place AS INTEGER) AS place, name, type, confidence, '' AS target FROM o UNION ALL SELECT id, true, 0, 'kept', 'Document', CAST(0.5 AS DOUBLE), '' FROM kept
      UNION ALL SELECT id, false, 0, 'Unit ' || id, 'RELATED_TO', CAST(0.7 AS DOUBLE), 'ISO 9001' FROM t WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM kept)""",
    "extraction_scores": SENTENCES + """, f AS (SELECT DISTINCT id, lower(trim(name)) AS a FROM ent), e AS (SELECT DISTINCT id, lower(trim(b)) AS b FROM (SELECT id, unnest([lower(tag), ' ' || wo, who]) AS b FROM t)),
      p AS (SELECT * FROM f JOIN e USING (id) WHERE contains(a, b) OR contains(b, a)),
      sc AS (SELECT id, coalesce(hf / CAST(nf AS DOUBLE), 0) AS p, coalesce(he / CAST(ne AS DOUBLE), 0) AS r FROM (SELECT id, count(*) AS nf FROM f GROUP BY 1) FULL JOIN (SELECT id, count(*) AS ne FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT id, count(DISTINCT a) AS hf, count(DISTINCT b) AS he FROM p GROUP BY 1) USING (id)),
      m AS (SELECT count(*) AS texts, avg(p) AS p, avg(r) AS r FROM sc) SELECT texts, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM m""",
    "retrieval_recall": _GOOD + ", ks AS (SELECT unnest([1, 3, 5, 10]) AS k), s AS (SELECT k, g.query_id, count(b.rank) FILTER (b.rank <= k) / CAST(count(*) AS DOUBLE) AS recall FROM good g CROSS JOIN ks LEFT JOIN (SELECT * FROM best WHERE rank <= 10) b ON b.query_id = g.query_id AND b.id = g.id GROUP BY ALL) SELECT k, round(avg(recall), 6) AS recall, count(*) AS queries FROM s GROUP BY 1",
    "trail_edges": GRAPH + _HOP2 + "SELECT src, dst, rel_type, edge_id, least(coalesce(x.hops, 9), coalesce(y.hops, 9)) AS hops FROM edges LEFT JOIN hops x ON x.node_id = src LEFT JOIN hops y ON y.node_id = dst WHERE least(coalesce(x.hops, 9), coalesce(y.hops, 9)) <= 1 ORDER BY hops, edge_id LIMIT 500",
    "health_report": GRAPH + """, fu AS (SELECT src AS a, dst AS b FROM feeds UNION SELECT dst, src FROM feeds), reach AS (SELECT node_id AS r, node_id AS pos FROM fnodes UNION SELECT reach.r, fu.b FROM reach JOIN fu ON fu.a = reach.pos),
      sm AS (SELECT component FROM (SELECT pos, min(r) AS component FROM reach GROUP BY 1) GROUP BY 1 HAVING count(*) <= 2),
      items AS (SELECT 'orphan_nodes' AS k, node_id AS item FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT 'duplicate_ids', substr(canonical_id, 1, 4) FROM nodes GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'low_confidence_edges', edge_id FROM edges WHERE confidence < 0.5 UNION ALL SELECT 'small_groups', component FROM sm),
      r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY item) AS r FROM items), ks AS (SELECT unnest(['orphan_nodes', 'duplicate_ids', 'low_confidence_edges', 'small_groups']) AS k)
      SELECT ks.k AS "check", count(item) AS n, coalesce(string_agg(item, '|' ORDER BY item) FILTER (r <= 10), '') AS samples FROM ks LEFT JOIN r USING (k) GROUP BY 1""",
    "risk_profiles": BREAKDOWN + _pagerank() + f""", rt AS (SELECT e.dst AS node_id, string_agg(DISTINCT p.name, '|' ORDER BY p.name) AS retiring FROM edges e JOIN nodes p ON p.node_id = e.src AND p.label = 'Person' AND p.retirement_risk = 'HIGH' WHERE e.rel_type = 'MAINTAINED_BY' GROUP BY 1),
      nw AS (SELECT 'B:' || p_brand AS b, max(l_shipdate) AS shipped FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), ag AS (SELECT src AS node_id, max(shipped) AS newest FROM edges JOIN nw ON dst = b GROUP BY 1),
      x AS (SELECT *, least(CAST(30 AS DOUBLE), 200 * coalesce(rank, 0)) AS boost FROM brk3 LEFT JOIN pr USING (node_id) LEFT JOIN rt USING (node_id) LEFT JOIN ag USING (node_id)), y AS (SELECT *, least(CAST(100 AS DOUBLE), score + boost) AS total FROM x)
      SELECT node_id, round(total, 4) AS score, CASE WHEN total >= 50 THEN 'Critical' WHEN total >= 25 THEN 'High' WHEN total >= 10 THEN 'Medium' ELSE 'Low' END AS level, round(coalesce(rank, 0), 4) AS pagerank,
        coalesce(nullif(concat_ws(' + ', CASE WHEN incidents >= 1 THEN incidents || ' recent incidents' END, CASE WHEN gaps > 0 THEN gaps || ' missing SOPs' END, CASE WHEN procs = 0 THEN 'No active procedures' END, CASE WHEN workorders > 0 THEN workorders || ' active work orders' END, CASE WHEN boost > 15 THEN 'High systemic connectivity (Hub)' END), ''), 'Low documentation coverage') AS reason,
        coalesce(nullif(concat_ws('. ', CASE WHEN gaps > 0 THEN 'Create missing SOPs' END, CASE WHEN procs = 0 THEN 'Document standard operating procedures' END, CASE WHEN incidents > 0 THEN 'Review incident root causes' END), ''), 'Review documentation coverage') AS action,
        coalesce(retiring, '') AS retiring, CAST(coalesce(greatest(0, date_sub('day', newest, TIMESTAMP '{AS_OF}')), 0) AS BIGINT) AS sop_age FROM y""",
    "upload_batch": f"WITH {_UPLOADS} SELECT place, CASE WHEN named THEN 'name' WHEN first < place THEN 'batch' WHEN file_hash IN (SELECT file_hash FROM d WHERE source IN ('src1', 'src2')) THEN 'server' ELSE 'upload' END AS outcome FROM b LEFT JOIN f USING (file_hash)",
    "whole_cascade": _DELETE + f""", c AS (SELECT l_orderkey % 100 AS d FROM lineitem), dd AS (SELECT DISTINCT o_orderkey % 100 AS d FROM orders)
      SELECT 'nodes' AS kind, '' AS said, count(*) AS n FROM ln UNION ALL SELECT 'edges', '', count(*) FROM le UNION ALL SELECT 'chunks', '', count(*) FROM c WHERE d <> 3 UNION ALL SELECT 'points', '', count(*) FROM c WHERE d % 2 = 1 AND d <> 3
      UNION ALL SELECT 'documents', CASE WHEN d = 3 THEN 'deleted' ELSE 'completed' END, count(*) FROM dd GROUP BY ALL UNION ALL SELECT 'audit', 'system|delete_document|3|{{"chunks":' || count(*) FILTER (d = 3) || ',"points":' || count(*) FILTER (d = 3) || '}}', 1 FROM c""",
    "tenant_delete": f"WITH {_POINTS} SELECT tenant_id, count(*) AS n FROM p WHERE tenant_id <> 't1' GROUP BY 1",
}

SQL |= {
    "prompt_budget": "WITH r AS (SELECT doc_id, text, 400 - length(concat_ws(' ', source, lang)) AS room FROM documents), f AS (SELECT doc_id, CASE WHEN length(text) <= room OR room <= 3 THEN text ELSE '...' || right(text, room - 3) END AS x FROM r) SELECT doc_id, length(x) AS n_chars, sha256(x) AS text_hash FROM f",
    "token_usage": "SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM (SELECT CAST(coalesce(sum(length(text) // 4) FILTER (role = 'user'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(length(text) // 4) FILTER (role <> 'user'), 0) AS BIGINT) AS completion_tokens FROM conversations)",
}
