"""Business scores over nodes and edges. Each branch is added up by itself before it is joined, so nothing fans out."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import CATEGORIES, CATEGORY_OF_LABEL, CATEGORY_OF_RELATIONSHIP
from .graph import undirected, with_ends


def _flag(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias("node_id")).distinct().withColumn(name, F.lit(1))


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]


def assets(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin("Asset", "Equipment")).select("node_id", "name")


def sides(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, other, other_label, other_name, rel_type, ahead: a row for each end of each edge between known nodes; ahead at its source."""
    end = lambda a, b, ahead: F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"), F.col(f"{b}_label").alias("other_label"), F.col(f"{b}_name").alias("other_name"), F.lit(ahead).alias("ahead"))
    return with_ends(edges, nodes).select("rel_type", F.explode(F.array(end("src", "dst", True), end("dst", "src", False))).alias("e")).select("e.*", "rel_type")


def _any(condition: str) -> Column:
    return F.max(F.expr(condition).cast("int"))


HIT = "NOT ahead AND rel_type = 'OCCURRED_ON' AND other_label = 'Incident'"


def facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What coverage and risk know of each node that has edges: one pass over the edges, one aggregation."""
    return sides(nodes, edges).groupBy("node_id").agg(
        _any("rel_type IN ('PREVENTS', 'COMPLIES_WITH') AND other_label = 'Procedure'").alias("sop"),
        _any(HIT).alias("incident"),
        _any("NOT ahead AND rel_type IN ('PERFORMED_ON', 'MAINTAINED_BY')").alias("maintenance"),
        _any("ahead AND rel_type = 'COMPLIES_WITH' AND other_label = 'Regulation'").alias("compliance"),
        _any(f"{HIT} AND lower(other_name) RLIKE 'catastrophic|emergency|critical'").alias("severe"),
        F.count_if(F.expr("NOT ahead AND rel_type IN ('KNOWLEDGE_OWNER_FOR', 'MAINTAINED_BY') AND other_label = 'Person'")).alias("n_experts"),
    )


def _covered(nodes: DataFrame, known: DataFrame, *more: str) -> DataFrame:
    out = assets(nodes).join(known, "node_id", "left").select("node_id", "name", *_zero("sop", "incident", "maintenance", "compliance", "n_experts", *more)).withColumn("expert", (F.col("n_experts") > 0).cast("long"))
    return out.withColumn("coverage", (25 * F.col("sop") + 20 * F.col("incident") + 20 * F.col("maintenance") + 20 * F.col("compliance") + 15 * F.col("expert")).cast("long"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, name, sop, incident, maintenance, compliance, expert (0/1), n_experts (edges), coverage (0-100)."""
    return _covered(nodes, facts(nodes, edges))


def level(score: Column, critical: int, high: int, medium: int) -> Column:
    return F.when(score >= critical, "Critical").when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Coverage's columns with severe, cascade, risk (0-100), level and the reasons."""
    known = facts(nodes, edges)
    hit = known.where("incident = 1").select(F.col("node_id").alias("b"))
    cascade = _flag(undirected(edges).where(F.col("rel_type").isin("FEEDS", "SUPPLIES", "CONNECTED_TO")).join(hit, "b", "left_semi"), "a", "cascade")
    c = _covered(nodes, known.join(cascade, "node_id", "left"), "severe", "cascade")
    c = c.select("node_id", "name", "sop", "incident", "coverage", "n_experts", "severe", "cascade")
    parts = [30 * F.col("severe"), F.when(F.col("coverage") < 50, 25).when(F.col("coverage") < 75, 10).otherwise(0), F.when(F.col("n_experts") <= 1, 20).otherwise(0), 15 * F.col("cascade"), F.when((F.col("incident") == 1) & (F.col("sop") == 0), 10).otherwise(0)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    reasons = F.array_compact(F.array(F.when(F.col("severe") == 1, "severe incident"), F.when(F.col("coverage") < 50, "low coverage"), F.when(F.col("n_experts") == 0, "no expert").when(F.col("n_experts") == 1, "single expert"), F.when(F.col("cascade") == 1, "connected to incident"), F.when((F.col("incident") == 1) & (F.col("sop") == 0), "incident without procedure")))
    return c.withColumn("risk", F.least(F.lit(100), total).cast("long")).withColumn("level", level(F.col("risk"), 70, 40, 20)).withColumn("reasons", F.array_join(reasons, " + "))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(d.items())))


def category_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, name, present, missing (sorted, `|`-joined), pct of the expected knowledge categories."""
    label = nodes.select(F.col("node_id").alias("b"), F.col("label").alias("b_label"))
    near = undirected(edges).join(label, "b").select(F.col("a").alias("node_id"), F.explode(F.array_compact(F.array(_map(CATEGORY_OF_RELATIONSHIP)[F.col("rel_type")], _map(CATEGORY_OF_LABEL)[F.col("b_label")]))).alias("category"))
    have = near.groupBy("node_id").agg(F.collect_set("category").alias("have"))
    out = assets(nodes).join(have, "node_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, CATEGORIES)), "have"))
    return out.select("node_id", "name", F.array_join(F.array_sort("have"), "|").alias("present"), F.array_join(missing, "|").alias("missing"), F.round(F.size("have") / 5.0 * 100, 1).alias("pct"))


def gap_rows(gaps: DataFrame) -> DataFrame:
    """One HAS_KNOWLEDGE_GAP edge for each missing category: derived, with no side effect."""
    return gaps.where("missing <> ''").select(F.col("node_id").alias("src"), F.explode(F.split("missing", r"\|")).alias("category")).select("src", F.concat(F.lit("gap:"), "src", F.lit(":"), "category").alias("dst"), F.lit("HAS_KNOWLEDGE_GAP").alias("rel_type"), "category")


def owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """person, asset: distinct pairs that person-asset relations connect, in either direction."""
    full = with_ends(edges, nodes)
    out = full.where("src_label = 'Person' AND dst_label IN ('Asset', 'Equipment')").select(F.col("src").alias("person"), F.col("dst").alias("asset"))
    back = full.where("dst_label = 'Person' AND src_label IN ('Asset', 'Equipment')").select(F.col("dst").alias("person"), F.col("src").alias("asset"))
    return out.unionByName(back).distinct()


def engineers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, name, degree, critical, sole, centrality, score, level of every person."""
    own = owners(nodes, edges)
    hit = edges.where("rel_type = 'OCCURRED_ON'").select(F.col("dst").alias("asset")).distinct().withColumn("hit", F.lit(1))
    alone = own.groupBy("asset").agg(F.count("*").alias("n")).where("n = 1").select("asset", F.lit(1).alias("alone"))
    by = own.join(hit, "asset", "left").join(alone, "asset", "left").groupBy(F.col("person").alias("node_id")).agg(F.count("*").alias("degree"), F.count("hit").alias("critical"), F.count("alone").alias("sole"))
    out = nodes.where("label = 'Person'").select("node_id", "name", "retirement_risk").join(by, "node_id", "left").select("node_id", "name", "retirement_risk", *_zero("degree", "critical", "sole"))
    score = F.least(F.lit(100), 2 * F.col("degree") + 10 * F.col("critical") + 15 * F.col("sole")).cast("long")
    lvl = F.when(F.col("sole") >= 3, "Critical").when(F.col("sole") >= 1, "High").when(F.col("critical") >= 2, "Medium").otherwise("Low")
    return out.select("*", F.bround(F.col("degree") / 100, 3).alias("centrality"), score.alias("score"), lvl.alias("level"))


def engineer_summary(roster: DataFrame) -> DataFrame:
    return roster.agg(F.count("*").alias("total"), F.count_if(F.col("level").isin("High", "Critical")).alias("high_risk"), F.bround(F.sum("score") / F.greatest(F.count("*"), F.lit(1)), 1).alias("mean_score"))


def unprotected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Assets with incidents whose experts are all High or Critical, or that have none."""
    lvl = engineers(nodes, edges).select(F.col("node_id").alias("person"), F.col("level").isin("High", "Critical").alias("risky"))
    safe = owners(nodes, edges).join(lvl, "person").groupBy(F.col("asset").alias("node_id")).agg(F.bool_and("risky").alias("all_risky"))
    hit = edges.where("rel_type = 'OCCURRED_ON'").select(F.col("dst").alias("node_id")).distinct()
    return assets(nodes).join(hit, "node_id", "left_semi").join(safe, "node_id", "left").where(F.coalesce("all_risky", F.lit(True))).select("node_id", "name")


def concentration(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """The people with most maintenance and inspection events, their share of that top list, and a level."""
    events = with_ends(edges, nodes).where("rel_type IN ('MAINTAINED_BY', 'INSPECTED_BY') AND src_label = 'Person'").groupBy(F.col("src").alias("node_id"), F.col("src_name").alias("name")).agg(F.count("*").alias("events"))
    best = events.orderBy(F.desc("events"), "node_id").limit(top)
    total = best.agg(F.sum("events").alias("total"))
    share = F.round(F.col("events") / F.col("total") * 100, 1)
    return best.crossJoin(F.broadcast(total)).select("node_id", "name", "events", share.alias("share"), F.when(share >= 60, "HIGH").when(share >= 40, "MEDIUM").otherwise("LOW").alias("level"))


def expertise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """3 for maintenance, 2 for inspection, 4 for an incident, 1 for authorship; capped at 100."""
    worth = F.when(F.col("rel_type") == "MAINTAINED_BY", 3).when(F.col("rel_type") == "INSPECTED_BY", 2).when(F.col("rel_type").isin("INVOLVED_IN", "REPORTED_BY"), 4).when(F.col("rel_type") == "AUTHORED_BY", 1).otherwise(0)
    people = nodes.where("label = 'Person'").select(F.col("node_id").alias("a"), "name")
    by = undirected(edges).join(people, "a").groupBy(F.col("a").alias("node_id"), "name").agg(F.sum(worth).alias("s"))
    return by.select("node_id", "name", F.least(F.lit(100), F.col("s")).cast("long").alias("expertise"))


def profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """knowledge = min(1, .1 docs + .05 incidents + .15 equipment); succession risk by retirement and spread."""
    people = nodes.where("label = 'Person'").select(F.col("node_id").alias("a"), "name", "retirement_risk")
    label = nodes.select(F.col("node_id").alias("b"), F.col("label").alias("l"))
    near = undirected(edges).select("a", "b").distinct().join(label, "b").groupBy("a").agg(F.count_if(F.col("l").isin("Document", "Procedure")).alias("docs"), F.count_if(F.col("l") == "Incident").alias("incidents"), F.count_if(F.col("l").isin("Asset", "Equipment")).alias("equipment"))
    x = people.join(near, "a", "left").select(F.col("a").alias("node_id"), "name", "retirement_risk", *_zero("docs", "incidents", "equipment"))
    risk_ = F.when(F.col("retirement_risk") == "HIGH", 0.9).when((F.col("equipment") > 3) & (F.col("docs") < 2), 0.8).when(F.col("equipment") > 1, 0.5).otherwise(0.2)
    return x.select("node_id", "name", F.round(F.least(F.lit(1.0), 0.1 * F.col("docs") + 0.05 * F.col("incidents") + 0.15 * F.col("equipment")), 6).alias("knowledge"), risk_.alias("risk"))


def expert_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """asset, person, risk by retirement, and whether the asset has a second expert."""
    own = owners(nodes, edges)
    n = own.groupBy("asset").agg(F.count("*").alias("n"))
    who = nodes.select(F.col("node_id").alias("person"), "retirement_risk")
    return own.join(n, "asset").join(who, "person").select("asset", "person", F.when(F.col("retirement_risk") == "HIGH", 0.9).otherwise(0.3).alias("risk"), (F.col("n") > 1).alias("has_backup"))


def breakdown(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, name, incidents, workorders, gaps, procs, score, level: 15, 5, 10 each and 20 without procedure.

    Neighbours count once however many edges lead to them: edges are added up by pair, pairs by node.
    """
    label, kind = F.col("other_label"), F.col("rel_type")
    has = {c: (F.coalesce(_map(CATEGORY_OF_RELATIONSHIP)[kind] == c, F.lit(False)) | F.coalesce(_map(CATEGORY_OF_LABEL)[label] == c, F.lit(False))).cast("int") for c in CATEGORIES}
    unnamed = nodes.select("node_id", F.lit(None).cast("string").alias("name"), "label")  # names aren't read here, so they don't move
    pairs = sides(unnamed, edges).groupBy("node_id", "other", "ahead", "other_label").agg(*(F.max(x).alias(c) for c, x in has.items()))
    by = pairs.groupBy("node_id").agg(
        F.count_if(~F.col("ahead") & (label == "Incident")).alias("incidents"),
        F.count_if(~F.col("ahead") & (label == "WorkOrder")).alias("workorders"),
        F.count_if(F.col("ahead") & (label == "Procedure")).alias("procs"),
        sum((F.max(c) for c in CATEGORIES), F.lit(0)).alias("have"),
    )
    out = assets(nodes).join(by, "node_id", "left").withColumn("gaps", len(CATEGORIES) - F.coalesce("have", F.lit(0)))
    out = out.select("node_id", "name", *_zero("incidents", "workorders", "gaps", "procs"))
    score = 15 * F.col("incidents") + 5 * F.col("workorders") + 10 * F.col("gaps") + F.when(F.col("procs") == 0, 20).otherwise(0)
    return out.withColumn("score", score.cast("long")).withColumn("level", level(F.col("score"), 50, 25, 10))


def risk_assets(scored: DataFrame, ranks: DataFrame, top: int = 20) -> DataFrame:
    """The breakdown with min(30, 200 * pagerank) added, capped at 100; downtime cost by name; the top."""
    s = F.least(F.lit(100.0), F.col("score") + F.least(F.lit(30.0), 200 * F.coalesce("rank", F.lit(0.0))))
    x = scored.join(ranks, "node_id", "left").select("node_id", "name", F.round(s, 4).alias("score"), F.when(F.col("name").contains("Reactor"), 500000).otherwise(250000).cast("long").alias("downtime_cost"))
    return x.orderBy(F.desc("score"), "node_id").limit(top)


EXPERT_LINKS = ("MAINTAINED_BY", "INSPECTED_BY", "OPERATED_BY", "KNOWLEDGE_OWNER", "OWNED_BY", "KNOWLEDGE_OWNER_FOR")


def _joined(parts: list[tuple[Column, Column | str]], by: str, otherwise: str) -> Column:
    """What applies of (condition, text), in order, as one text."""
    said = F.array_compact(F.array(*(F.when(c, t) for c, t in parts)))
    return F.when(F.size(said) > 0, F.array_join(said, by)).otherwise(otherwise)


def risk_profiles(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, written_at: DataFrame, as_of: str) -> DataFrame:
    """What risk_assets scores, told in full, of every asset: node_id, name, score, level, pagerank, reason, action, retiring
    (names of experts at risk of leaving, `|` between them), sop_age (days since the newest document of its procedures; 0 without any).

    ranks: node_id, rank. written_at: node_id of procedures and `at` (timestamps of their documents; nulls are passed over).
    """
    scored = breakdown(nodes, edges).drop("level")
    at_risk = F.col("retirement_risk") == "HIGH"
    if "succession_risk" in nodes.columns:
        at_risk = F.coalesce(at_risk, F.lit(False)) | F.col("succession_risk").isin("High", "Critical")
    people = nodes.where((F.col("label") == "Person") & at_risk).select(F.col("node_id").alias("src"), F.col("name").alias("person"))
    retiring = edges.where(F.col("rel_type").isin(*EXPERT_LINKS)).select("src", F.col("dst").alias("node_id")).join(people, "src").select("node_id", "person").distinct()
    retiring = retiring.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("person")), "|").alias("retiring"))
    newest = written_at.groupBy(F.col("node_id").alias("dst")).agg(F.max("at").alias("at"))
    ages = edges.select(F.col("src").alias("node_id"), "dst").join(newest, "dst").groupBy("node_id").agg(F.max("at").alias("newest"))
    x = scored.join(ranks.select("node_id", F.col("rank").alias("pagerank")), "node_id", "left").join(retiring, "node_id", "left").join(ages, "node_id", "left")
    boost = F.least(F.lit(30.0), 200 * F.coalesce("pagerank", F.lit(0.0)))
    total = F.least(F.lit(100.0), F.col("score") + boost)
    count = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    reason = _joined([(F.col("incidents") >= 1, count("incidents", " recent incidents")), (F.col("gaps") > 0, count("gaps", " missing SOPs")), (F.col("procs") == 0, "No active procedures"), (F.col("workorders") > 0, count("workorders", " active work orders")), (boost > 15, "High systemic connectivity (Hub)")], " + ", "Low documentation coverage")
    action = _joined([(F.col("gaps") > 0, "Create missing SOPs"), (F.col("procs") == 0, "Document standard operating procedures"), (F.col("incidents") > 0, "Review incident root causes")], ". ", "Review documentation coverage")
    days = F.timestamp_diff("DAY", F.col("newest").cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    return x.select(
        "node_id", "name", F.round(total, 4).alias("score"), level(total, 50, 25, 10).alias("level"), F.round(F.coalesce("pagerank", F.lit(0.0)), 4).alias("pagerank"),
        reason.alias("reason"), action.alias("action"), F.coalesce("retiring", F.lit("")).alias("retiring"), F.coalesce(F.greatest(F.lit(0), days), F.lit(0)).cast("long").alias("sop_age"),
    )


def risk_timeline(nodes: DataFrame, as_of: str, retire_days: int = 365) -> DataFrame:
    """Retirements of people at HIGH risk (undated: as_of plus a year) and procedures or incidents over a year old."""
    at = F.lit(as_of).cast("timestamp_ntz")
    retire = nodes.where("label = 'Person' AND retirement_risk = 'HIGH'").select("node_id", F.lit("retirement").alias("kind"), F.date_format(at + F.expr(f"INTERVAL {retire_days} DAYS"), "yyyy-MM-dd").alias("date"), F.lit("High").alias("severity"))
    age = F.datediff(at, F.to_date(F.substring("event_time", 1, 10)))
    old = nodes.where(F.col("event_time").isNotNull() & F.col("label").isin("WorkOrder", "Procedure")).withColumn("age", age).where("age > 365")
    ageing = old.select("node_id", F.lit("ageing").alias("kind"), F.substring("event_time", 1, 10).alias("date"), F.when(F.col("age") > 1825, "Critical").otherwise("Medium").alias("severity"))
    return retire.unionByName(ageing)
