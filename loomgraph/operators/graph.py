"""Graph operators over nodes (node_id, name, label, ...) and edges (src, dst, rel_type, edge_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    """a, b and the edge's columns, once for each direction; a self-loop only once."""
    ahead = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", "edge_id")
    back = edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type", "edge_id")
    return ahead.unionByName(back)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' names and labels; edges with a missing end are dropped."""
    s = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("src_name"), F.col("label").alias("src_label"))
    d = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name"), F.col("label").alias("dst_label"))
    return edges.join(s, "src").join(d, "dst")


def find_node(nodes: DataFrame, label: str, name: str) -> DataFrame:
    return nodes.where((F.col("label") == label) & (F.col("name") == name)).orderBy("node_id").limit(1)


def neighbors(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """One undirected hop from the nodes of a name, in a total order."""
    seeds = nodes.where(F.col("name") == name).select(F.col("node_id").alias("a"))
    near = undirected(edges).join(seeds, "a", "left_semi").select(F.col("b").alias("node_id"), "rel_type")
    return near.join(nodes, "node_id").select("node_id", "name", "label", "rel_type").orderBy("node_id", "rel_type").limit(limit)


def reachable(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """node_id, hops: every node within depth undirected hops of seeds (node_id), by levels without repeats."""
    und = undirected(edges).select("a", "b").distinct()
    seen = seeds.select("node_id", F.lit(0).alias("hops"))
    front = seen
    for d in range(1, depth + 1):
        nxt = und.join(front.select(F.col("node_id").alias("a")), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
        front = nxt.join(seen, "node_id", "left_anti").withColumn("hops", F.lit(d))
        if d % 3 == 0:
            front = checkpointed(front)
        seen = seen.unionByName(front)
    return seen


def neighborhood(nodes: DataFrame, edges: DataFrame, names: list[str], depth: int = 3) -> DataFrame:
    """Nodes within depth hops of the nodes of these names; seeds score 1.0, others 0.5."""
    seeds = nodes.where(F.col("name").isin(names)).select("node_id").distinct()
    found = reachable(seeds, edges, depth).join(nodes, "node_id")
    return found.select("node_id", "name", "label", "hops", F.when(F.col("hops") == 0, 1.0).otherwise(0.5).alias("score"))


def trail_edges(nodes: DataFrame, edges: DataFrame, names: list[str], depth: int = 3, limit: int = 500) -> DataFrame:
    """src, dst, rel_type, edge_id, hops: the first edges, by (hops, edge_id), on trails of at most depth edges from the nodes of these
    names. hops is that of an edge's nearer end: the shortest way there never takes the edge itself, so it is on a trail if hops < depth."""
    seeds = nodes.where(F.col("name").isin(names)).select("node_id").distinct()
    near = reachable(seeds, edges, depth - 1)
    met = undirected(edges).select("edge_id", F.col("a").alias("node_id")).join(near, "node_id").groupBy("edge_id").agg(F.min("hops").alias("hops"))
    first = met.orderBy("hops", "edge_id").limit(limit)
    return edges.select("src", "dst", "rel_type", "edge_id").join(first, "edge_id").select("src", "dst", "rel_type", "edge_id", "hops")


def health_report(nodes: DataFrame, edges: DataFrame, groups: DataFrame, small: int = 2, samples: int = 10) -> DataFrame:
    """check, n, samples: how many orphans, shared canonical ids, unsure edges and groups (node_id, community) of at most `small` nodes
    there are, and the first few of each, `|` between them. Counts are of all rows; a check that finds nothing has n = 0."""
    sizes = groups.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") <= small)
    found = {"orphan_nodes": orphans(nodes, edges).select("node_id"), "duplicate_ids": duplicates(nodes).select("canonical_id"), "low_confidence_edges": low_confidence(edges).select("edge_id"), "small_groups": sizes.select(F.col("community").cast("string"))}
    out = None
    for check, rows in found.items():
        rows = rows.toDF("item")
        first = rows.orderBy("item").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("samples"))
        row = rows.agg(F.count("*").alias("n")).crossJoin(first).select(F.lit(check).alias("check"), "n", "samples")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in kept (node_id)."""
    ids = kept.select("node_id").distinct()
    return edges.join(ids, edges["src"] == ids["node_id"], "left_semi").join(ids, edges["dst"] == ids["node_id"], "left_semi")


def subgraph_by_labels(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    return induced(edges, nodes.where(F.col("label").isin(labels)))


def as_of(edges: DataFrame, at: str) -> DataFrame:
    """Edges whose event isn't after an ISO time, compared as text; edges without a time are always there."""
    return edges.where(F.col("event_time").isNull() | (F.col("event_time") <= at))


EVENT_RELATIONS = ("OCCURRED_ON", "PERFORMED_ON", "MAINTAINED_BY", "INSPECTED_BY")


def timeline(nodes: DataFrame, edges: DataFrame, equipment: str, limit: int = 50) -> DataFrame:
    """Events into an equipment, newest first; time of the event node, else of the edge."""
    target = nodes.where((F.col("label") == "Equipment") & (F.col("name") == equipment)).select(F.col("node_id").alias("dst"))
    into = edges.where(F.col("rel_type").isin(*EVENT_RELATIONS)).join(target, "dst", "left_semi").select(F.col("src").alias("node_id"), "rel_type", F.col("event_time").alias("rel_time"))
    out = into.join(nodes, "node_id").select("node_id", "name", "label", "rel_type", F.coalesce("event_time", "rel_time").alias("event_time"))
    return out.orderBy(F.col("event_time").desc_nulls_last(), "node_id").limit(limit)


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges), "node_id", "left_anti")


def duplicates(nodes: DataFrame) -> DataFrame:
    """canonical_id, n, names of ids that several nodes have."""
    return nodes.groupBy("canonical_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("name")), "|").alias("names")).where("n > 1")


def low_confidence(edges: DataFrame, below: float = 0.5) -> DataFrame:
    return edges.where(F.col("confidence").isNotNull() & (F.col("confidence") < below))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node_id").agg(F.count("*").alias("degree"))


def label_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density, avg_degree, orphan_ratio, isa_ratio."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("rel_type") == "IS_A").alias("isa"))
    o = orphans(nodes, edges).agg(F.count("*").alias("orphans"))
    size = F.greatest(F.col("n_nodes"), F.lit(1)).cast("double")
    pairs = F.greatest(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(1)).cast("double")
    return n.crossJoin(e).crossJoin(o).select("n_nodes", "n_edges", F.round(F.col("n_edges") / pairs, 8).alias("density"), F.round(2 * F.col("n_edges") / size, 6).alias("avg_degree"), F.round(F.col("orphans") / size, 6).alias("orphan_ratio"), F.round(F.col("isa") / F.greatest(F.col("n_edges"), F.lit(1)), 6).alias("isa_ratio"))


def paths(edges: DataFrame, source: str, target: str, depth: int = 5, directed: bool = False, k: int = 1) -> DataFrame:
    """The k shortest paths without repeated nodes, as hops and `>`-joined ids; ties by the ids.

    Both sides are pruned: only nodes that both source and target reach within depth can be on a path.
    """
    spark = edges.sparkSession
    edges = checkpointed(edges.select("src", "dst", "rel_type", "edge_id"))
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct() if directed else undirected(edges).select("a", "b").distinct()
    near = reachable(spark.createDataFrame([(source,)], "node_id string"), edges, depth).select("node_id", F.col("hops").alias("from_source"))
    far = reachable(spark.createDataFrame([(target,)], "node_id string"), edges, depth).select("node_id", F.col("hops").alias("to_target"))
    kept = checkpointed(near.join(far, "node_id").where(F.col("from_source") + F.col("to_target") <= depth).select("node_id", "to_target"))
    step = step.join(kept.select(F.col("node_id").alias("a")), "a", "left_semi").join(kept.select(F.col("node_id").alias("b"), "to_target"), "b")
    front = spark.createDataFrame([(source, [source])], "at string, path array<string>")
    found = front.where(F.col("at") == target)
    for d in range(1, depth + 1):
        grown = front.where(F.col("at") != target).join(step, F.col("at") == F.col("a")).where(~F.array_contains("path", F.col("b")) & (F.col("to_target") <= depth - d))
        front = grown.select(F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
        done = checkpointed(front.where(F.col("at") == target).orderBy(F.array_join("path", ">")).limit(k))
        found = found.unionByName(done)
        if found.count() >= k:
            break
    return found.select((F.size("path") - 1).cast("long").alias("hops"), F.array_join("path", ">").alias("path")).orderBy("hops", "path").limit(k)
