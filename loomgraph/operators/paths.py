"""The k shortest paths by deviations: each next path leaves a found one at some node, its spur, by an edge not taken there.

All spurs of a round are searched together: distances to the target grow by frontiers, one row for each (search, node),
without the nodes before the spur and the edges taken from it. Depth is limited if `most` hops are given. The driver holds
the found paths only, k of them, and their candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .graph import undirected

CUT_EVERY = 3


def _text(path: list[str]) -> str:
    return ">".join(path)


def _search(step: DataFrame, target: str, roots: list[tuple[list[str], list[str]]], most: int | None = None) -> list[list[str] | None]:
    """For each (path up to the spur, next nodes not to take) the shortest path to target of at most `most` hops in all; ties as of the joined text."""
    spark = step.sparkSession
    gone = spark.createDataFrame([(i, n) for i, (root, _) in enumerate(roots) for n in root[:-1]], "search int, node string")
    banned = spark.createDataFrame([(i, root[-1], n) for i, (root, taken) in enumerate(roots) for n in taken], "search int, a string, b string")
    wanted = spark.createDataFrame([(i, root[-1]) for i, (root, _) in enumerate(roots)], "search int, node string")
    front = spark.createDataFrame([(i, target) for i, (root, _) in enumerate(roots) if target not in root[:-1]], "search int, node string")
    seen = written(front.withColumn("dist", F.lit(0)))
    gone, banned = F.broadcast(gone), F.broadcast(banned)  # at most k paths' nodes
    dist, reached = 0, {}
    while True:
        for r in front.join(F.broadcast(wanted), ["search", "node"], "left_semi").collect():
            reached.setdefault(r.search, dist)
        done = [i for i, (root, _) in enumerate(roots) if i in reached or (most is not None and len(root) - 1 + dist >= most)]
        if len(done) == len(roots):
            break
        front = front.where(~F.col("search").isin(done)) if done else front
        grown = front.select("search", F.col("node").alias("b")).join(step, "b").join(banned, ["search", "a", "b"], "left_anti").select("search", F.col("a").alias("node")).distinct()
        dist += 1
        front = written(grown.join(gone, ["search", "node"], "left_anti").join(seen.select("search", "node"), ["search", "node"], "left_anti").withColumn("dist", F.lit(dist)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if dist % CUT_EVERY == 0:
            seen = written(seen)
        front = front.select("search", "node")
    walks = {i: [roots[i][0][-1]] for i in reached}
    while going := {i: w for i, w in walks.items() if w[-1] != target}:
        at = spark.createDataFrame([(i, w[-1], reached[i] - len(w)) for i, w in going.items()], "search int, a string, dist int")
        there = step.join(F.broadcast(at), "a").join(banned, ["search", "a", "b"], "left_anti").join(seen.withColumnRenamed("node", "b"), ["search", "b", "dist"])
        for r in there.groupBy("search").agg(F.min_by("b", F.concat("b", F.lit(">"))).alias("b")).collect():
            walks[r.search].append(r.b)
    return [roots[i][0][:-1] + walks[i] if i in walks else None for i in range(len(roots))]


def k_shortest(edges: DataFrame, source: str, target: str, k: int = 3, directed: bool = True, most: int | None = None) -> DataFrame:
    """hops, path (`>`-joined ids) of the k shortest paths without repeated nodes and of at most `most` hops (None: any), ties by
    the path's text. Parallel edges are one."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if directed else undirected(edges).select("a", "b")
    step = written(both.where("a <> b").distinct())
    found: list[list[str]] = []
    waiting: list[list[str]] = [p for p in _search(step, target, [([source], [])], most) if p] if source != target else [[source]]
    while waiting and len(found) < k:
        waiting.sort(key=lambda p: (len(p), _text(p)))
        last = waiting.pop(0)
        found.append(last)
        if len(found) == k or source == target:
            break
        roots = []
        for i in range(len(last) - 1):
            taken = sorted({p[i + 1] for p in found if p[: i + 1] == last[: i + 1] and len(p) > i + 1})
            roots.append((last[: i + 1], taken))
        waiting += [p for p in _search(step, target, roots, most) if p and p not in waiting and p not in found]
    return edges.sparkSession.createDataFrame([(len(p) - 1, _text(p)) for p in found], "hops long, path string")
