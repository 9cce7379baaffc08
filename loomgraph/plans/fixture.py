"""A knowledge graph, documents and jobs derived from the star schema's tables, by pure expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import TAG_WORDS


class Tables:
    """The given tables and what is derived from them; everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def tag_of(key: Column) -> Column:
    prefix = F.element_at(F.array(*map(F.lit, TAG_WORDS)), (key % 7 + 1).cast("int"))
    return F.concat(prefix, F.lit("-"), (F.lit(10) + F.floor(key / 7)).cast("string"))


def tag_word(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TAG_WORDS.values())), (key % 7 + 1).cast("int"))


def _id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def nodes(t: Tables) -> DataFrame:
    """node_id, name, label, canonical_id, source_doc_id, retirement_risk, event_time of one tenant."""
    none = F.lit(None).cast("string")

    def made(df, node_id, name, label, canonical, doc, risk=none, event=none):
        return df.select(node_id.alias("node_id"), name.alias("name"), F.lit(label).alias("label"), canonical.alias("canonical_id"), doc.cast("long").alias("source_doc_id"), risk.alias("retirement_risk"), event.alias("event_time"))

    key = F.col("p_partkey")
    risk = F.when(F.col("s_acctbal") < 0, "HIGH").when(F.col("s_acctbal") < 3000, "MEDIUM").otherwise("LOW")
    incident = F.concat(F.when(F.col("o_totalprice") > 250000, "Emergency ").otherwise("Incident "), F.col("o_orderkey").cast("string"))
    wo = F.concat(F.lit("WO-"), F.col("o_orderkey").cast("string"))
    sop, reg = F.concat(F.lit("SOP "), F.col("p_brand")), F.concat(F.lit("Regulation "), F.col("n_name"))
    parts = [
        made(t.part, _id("E", key), F.concat(tag_word(key), F.lit(" "), tag_of(key)), "Equipment", F.regexp_replace(tag_of(key), "-", ""), key % 100),
        made(t.supplier, _id("P", F.col("s_suppkey")), F.col("s_name"), "Person", F.col("s_name"), F.col("s_suppkey") % 100, risk),
        made(t.orders.where("o_orderpriority = '1-URGENT'"), _id("I", F.col("o_orderkey")), incident, "Incident", incident, F.col("o_orderkey") % 100, none, iso(F.col("o_orderdate"))),
        made(t.orders.where("o_orderpriority = '5-LOW'"), _id("W", F.col("o_orderkey")), wo, "WorkOrder", wo, F.col("o_orderkey") % 100, none, iso(F.col("o_orderdate"))),
        made(t.part.select("p_brand").distinct(), _id("B", F.col("p_brand")), sop, "Procedure", sop, F.lit(0)),
        made(t.nation, _id("N", F.col("n_nationkey")), reg, "Regulation", reg, F.lit(0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feeds(t: Tables) -> DataFrame:
    """src, dst of FEEDS: the parts of lines that follow each other in an order. Pairs repeat, as `edges` has them once."""
    return _following(t).select(_id("E", F.col("x")).alias("src"), _id("E", F.col("y")).alias("dst"))


def _following(t: Tables) -> DataFrame:
    a = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x"))
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("y"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("x <> y").select("x", "y")


def edges(t: Tables) -> DataFrame:
    """src, dst, rel_type, event_time, edge_id, confidence, source_doc_id; distinct, since line numbers repeat."""
    line, orders = t.lineitem, t.orders
    none = F.lit(None).cast("string")

    def named(df, src, dst, rel, event=none):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"), event.alias("event_time"))

    def made(*x):
        return named(*x).distinct()

    part, supp, order = _id("E", F.col("l_partkey")), _id("P", F.col("l_suppkey")), F.col("o_orderkey")
    least = line.where("l_partkey % 3 = 0").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s_suppkey")).join(t.supplier, "s_suppkey")
    urgent, low = orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderpriority = '5-LOW'")
    found = [
        made(line.where("l_linenumber = 1 AND l_returnflag = 'R' AND l_quantity >= 45"), supp, part, "MAINTAINED_BY"),
        made(line.where("l_linenumber = 2").join(urgent, line["l_orderkey"] == order), _id("I", order), part, "OCCURRED_ON", iso(F.col("o_orderdate"))),
        made(line.where("l_linenumber = 3").join(low, line["l_orderkey"] == order), _id("W", order), part, "PERFORMED_ON", iso(F.col("o_orderdate"))),
        named(_following(t).distinct(), _id("E", F.col("x")), _id("E", F.col("y")), "FEEDS"),
        made(t.part.where("p_size <= 25"), _id("E", F.col("p_partkey")), _id("B", F.col("p_brand")), "COMPLIES_WITH"),
        made(least, part, _id("N", F.col("s_nationkey")), "COMPLIES_WITH"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    edge_id = F.concat("src", F.lit(">"), "rel_type", F.lit(">"), "dst")
    return out.withColumn("edge_id", edge_id).withColumn("confidence", F.lit(0.4) + F.lit(0.1) * (F.length("edge_id") % 6)).withColumn("source_doc_id", (F.length("edge_id") % 7).cast("long"))


def sentences(t: Tables) -> DataFrame:
    """id, text: industrial sentences made of each part's row, for the extraction operators."""
    key = F.col("p_partkey")
    tag = tag_of(key)
    text = F.concat(
        tag, F.lit(" feeds V-"), (F.lit(10) + key % 90).cast("string"), F.lit(". "), tag, F.lit(" is maintained by "), F.when(key % 2 == 0, "Ann Lee").otherwise("Bob Ray"), F.lit(".\nWO-"),
        (F.lit(10000) + key).cast("string"), F.lit(" maintenance on "), tag, F.lit(" done.\nSOP-12 covers "), tag, F.lit(".\nEmergency shutdown of "), tag, F.lit(" under ISO 9001."),
    )
    return t.part.select(key.cast("long").alias("id"), text.alias("text"))


def jobs(t: Tables) -> DataFrame:
    """job_id, document_id, status, updated_at from orders."""
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "O", "pending").otherwise("completed")
    return t.orders.select(F.col("o_orderkey").cast("string").alias("job_id"), (F.col("o_custkey") % 100).cast("long").alias("document_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))
