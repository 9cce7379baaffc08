"""Registry, vector-store and evidence operators: joins, filters and appends over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocab import INACTIVE
from .graph import with_ends


def within(t_from: Column, t_to: Column, at: str) -> Column:
    """Whether an interval of ISO times, open where null, holds a time."""
    return (t_from.isNull() | (t_from <= at)) & (t_to.isNull() | (t_to >= at))


def valid_at(nodes: DataFrame, edges: DataFrame, at: str) -> DataFrame:
    """Edges valid at a time whose source is valid too; the target isn't asked. Both tables have valid_from, valid_to."""
    alive = nodes.where(within(F.col("valid_from"), F.col("valid_to"), at)).select(F.col("node_id").alias("src"))
    return edges.where(within(F.col("valid_from"), F.col("valid_to"), at)).join(alive, "src", "left_semi")


def duplicate_total(nodes: DataFrame) -> DataFrame:
    """One row: nodes in groups of one name and label with more than one member; 0 without any."""
    groups = nodes.groupBy("name", "label").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"), F.count("*").alias("groups"))


def context(chunks: DataFrame, most: int = 4000) -> DataFrame:
    """document_id, text: its chunks in order, a line each, as far as a prompt takes them; null texts are passed over, and
    has_text tells whether there is any other. Chunks without an index come last.

    Chunks that begin beyond the limit go before any are collected, so a document of any length is a few rows here.
    """
    w = Window.partitionBy("document_id").orderBy(F.col("chunk_index").asc_nulls_last(), "text")
    before = F.coalesce(F.sum(F.coalesce(F.length("text") + 1, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.select("document_id", "chunk_index", F.substring("text", 1, most).alias("text"), before.alias("before"), F.row_number().over(w).alias("n"))
    kept = rows.where(((F.col("before") <= most) & F.col("text").isNotNull()) | (F.col("n") == 1))  # at the limit the line break before a chunk still counts; the first stays, so that each document has a row
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda c: c["text"])
    return kept.groupBy("document_id").agg(F.substring(F.array_join(parts, "\n"), 1, most).alias("text"), (F.count("text") > 0).alias("has_text"))


def with_filename(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (id) with their document's filename, `Document` where the registry has none."""
    return hits.join(documents.select("id", "filename"), "id", "left").withColumn("filename", F.coalesce("filename", F.lit("Document")))


def snippet(text: Column, most: int = 180) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def citations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, citation, id, snippet of hits (query_id, id, rank): the rank in the list is the citation's number."""
    return hits.join(chunks.select("id", "text"), "id").select("query_id", F.col("rank").cast("long").alias("citation"), "id", snippet(F.col("text")).alias("snippet"))


def point_id(tenant: Column, document: Column, chunk: Column) -> Column:
    """A vector's id, the same whenever a chunk is ingested again."""
    return F.sha2(F.concat_ws("|", tenant, document.cast("string"), chunk.cast("string")), 256)


def upsert_vectors(base: DataFrame, new: DataFrame) -> DataFrame:
    """New points in the place of those with their id."""
    return base.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)


def delete_vectors(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Points without those of some (tenant_id, document_id)."""
    return points.join(documents.select("tenant_id", "document_id").distinct(), ["tenant_id", "document_id"], "left_anti")


def purge(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) without the documents that are stuck while deleting."""
    gone = documents.where(F.col("status").isin("deleting", "failed_delete")).select("document_id").distinct()
    return documents.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def active(rows: DataFrame) -> DataFrame:
    """Rows in no inactive status; a null status goes too, as in SQL's NOT IN."""
    return rows.where(~F.col("status").isin(INACTIVE))


def recent(rows: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Rows updated in the last days before a time, the bound included."""
    return rows.where(F.col("updated_at").cast("timestamp_ntz") >= F.expr(f"CAST('{as_of}' AS TIMESTAMP_NTZ) - INTERVAL {days} DAYS"))


def job_status(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Jobs with the number of their chunks, told only once completed; a completed job without any fails the gate."""
    n = chunks.groupBy("job_id").agg(F.count("*").alias("n"))
    told = F.when(F.col("status") == "completed", F.coalesce("n", F.lit(0)))
    return jobs.join(n, "job_id", "left").select("job_id", "status", told.alias("n_chunks"), F.coalesce(told > 0, F.lit(True)).alias("passes"))


def progress(steps: DataFrame) -> DataFrame:
    """job, stage (the last one's), processed, total, percent of steps (job, at, n, stage, done): at most 99 till all are done."""
    per = steps.groupBy("job").agg(F.max_by("stage", F.struct("at", "n")).alias("stage"), F.count_if("done").alias("processed"), F.count("*").alias("total"))
    share = F.floor(100 * F.col("processed") / F.col("total"))
    return per.withColumn("percent", F.when(F.col("processed") == F.col("total"), 100).otherwise(F.least(F.lit(99), share)).cast("long"))


def with_metrics(nodes: DataFrame, *metrics: DataFrame) -> DataFrame:
    """Nodes with the columns of each table of metrics (node_id, ...); null where one has no row for the node."""
    for m in metrics:
        nodes = nodes.join(m, "node_id", "left")
    return nodes


def applicable_regulations(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """source_doc_id, regulation: the first regulations by name that a document's nodes point to, either way."""
    full = with_ends(edges, nodes)
    near = full.where("dst_label = 'Regulation'").select(F.col("src").alias("node_id"), F.col("dst_name").alias("regulation"))
    near = near.unionByName(full.where("src_label = 'Regulation'").select(F.col("dst").alias("node_id"), F.col("src_name").alias("regulation")))
    found = near.join(nodes.select("node_id", "source_doc_id"), "node_id").select("source_doc_id", "regulation").distinct()
    return found.withColumn("n", F.row_number().over(Window.partitionBy("source_doc_id").orderBy("regulation"))).where(F.col("n") <= most).drop("n")


def in_scope(regulations: DataFrame, scope: str) -> DataFrame:
    """Regulations whose name or code holds the scope, whatever the case."""
    return regulations.where(F.contains(F.lower("name"), F.lit(scope.lower())) | F.contains(F.lower("canonical_id"), F.lit(scope.lower())))


def lessons(nodes: DataFrame, edges: DataFrame, topic: str, most: int = 10) -> DataFrame:
    """Incidents with a neighbour whose name holds the topic, case kept, in a total order."""
    full = with_ends(edges, nodes)
    hit = full.where(F.col("src_label") == "Incident").select(F.col("src").alias("incident"), F.col("dst_name").alias("other"))
    hit = hit.unionByName(full.where(F.col("dst_label") == "Incident").select(F.col("dst").alias("incident"), F.col("src_name").alias("other")))
    return hit.where(F.contains("other", F.lit(topic))).distinct().orderBy("incident", "other").limit(most)


def identifier(name: Column) -> Column:
    """A name as an identifier: all but letters, digits and _ becomes _."""
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def delete_tenant(points: DataFrame, tenant: str) -> DataFrame:
    """Points of all tenants but one; those of no tenant stay."""
    return points.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def token_usage(calls: DataFrame) -> DataFrame:
    """One row: prompt, completion and total tokens of calls (prompt_tokens, completion_tokens); nulls count as 0."""
    p, c = (F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("prompt_tokens", "completion_tokens"))
    return calls.agg(p, c).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def has_serious_gap(gaps: Column) -> Column:
    """Whether any of an array of gaps is High or Critical; without gaps none is."""
    return F.coalesce(F.exists(gaps, lambda g: F.coalesce(g["risk_level"].isin("High", "Critical"), F.lit(False))), F.lit(False))
