"""Upserts, deletes and integrity checks as set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import ends, undirected


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(base: DataFrame, changes: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Last write wins by key; rows of base without a change stay."""
    return base.join(changes, keys, "left_anti").unionByName(latest(changes, keys, order), allowMissingColumns=True)


def upsert_entities(rows: DataFrame) -> DataFrame:
    """label, canonical_id, confidence (highest), name (of the highest, ties by name), aliases (united, sorted).

    Rows are first added up by alias, so what is collected for a hot id are its distinct aliases, not its rows.
    """
    each = rows.select("label", "canonical_id", "confidence", "name", F.explode_outer("aliases").alias("alias"))
    each = each.groupBy("label", "canonical_id", "alias").agg(F.max("confidence").alias("confidence"), F.max(F.struct("confidence", "name")).alias("best"))
    return each.groupBy("label", "canonical_id").agg(F.max("confidence").alias("confidence"), F.max("best")["name"].alias("name"), F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"))


def upsert_relationships(rows: DataFrame, nodes: DataFrame, least: float = 0.40) -> DataFrame:
    """src, dst, rel_type with the highest confidence and first time; unsure ones, self-loops and missing ends go."""
    ids = nodes.select("node_id")
    kept = rows.where((F.col("confidence") >= least) & (F.col("src") != F.col("dst")))
    kept = kept.join(ids, F.col("src") == ids["node_id"], "left_semi").join(ids, F.col("dst") == ids["node_id"], "left_semi")
    return kept.groupBy("src", "dst", "rel_type").agg(F.max("confidence").alias("confidence"), F.min("event_time").alias("event_time"))


def delete_document(nodes: DataFrame, edges: DataFrame, doc_id: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the document's edges, and without its nodes that are then isolated."""
    left = edges.where(~F.col("source_doc_id").eqNullSafe(F.lit(doc_id)))
    gone = nodes.where(F.col("source_doc_id") == doc_id).join(ends(left), "node_id", "left_anti").select("node_id")
    return nodes.join(gone, "node_id", "left_anti"), left


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without some nodes (node_id) and every edge at them."""
    left = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), left


def cross_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """RELATED_TO for equipment that shares a canonical id and isn't connected yet. Each node is linked with the
    smallest of its id, so a large group takes a row for each member."""
    eq = nodes.where("label = 'Equipment'").select("node_id", "canonical_id")
    first = eq.groupBy("canonical_id").agg(F.min("node_id").alias("src"))
    pairs = eq.join(first, "canonical_id").where("node_id <> src").select("src", F.col("node_id").alias("dst"))
    have = undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return pairs.join(have, ["src", "dst"], "left_anti").withColumn("rel_type", F.lit("RELATED_TO"))


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """src, dst, rel_type of names (doc_id, name, label) in one document; person with equipment: MAINTAINED_BY.

    A document's mentions are few; the result is the pairs themselves, distinct over documents.
    """
    x, y = mentions.alias("x"), mentions.alias("y")
    mixed = F.array_sort(F.array("x.label", "y.label")) == F.array(F.lit("Equipment"), F.lit("Person"))
    return x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.name") < F.col("y.name"))).select(F.col("x.name").alias("src"), F.col("y.name").alias("dst"), F.when(mixed, "MAINTAINED_BY").otherwise("RELATED_TO").alias("rel_type")).distinct()


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks in the place of all chunks of their documents."""
    return chunks.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def uncached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts whose hash the extraction cache doesn't have."""
    return texts.withColumn("file_hash", F.sha2("text", 256)).join(cache.select("file_hash"), "file_hash", "left_anti")


def keep_oldest(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Of documents with equal content, the first. An aggregate, so a hot text is added up before the shuffle."""
    return docs.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def backfill(df: DataFrame, column: str, value: str) -> DataFrame:
    """Migration: the column exists, and is value where it was null."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value))


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def watchdog(jobs: DataFrame, as_of: str, minutes: int = 15) -> DataFrame:
    """Jobs that stand still in a working status for longer become failed (deleting: failed_delete)."""
    late = F.col("updated_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    stuck = F.col("status").isin("pending", "processing", "deleting") & late
    return jobs.withColumn("new_status", F.when(stuck & (F.col("status") == "deleting"), "failed_delete").when(stuck, "failed").otherwise(F.col("status")))


def new_uploads(batch: DataFrame, documents: DataFrame) -> DataFrame:
    """The batch (place, filename, file_hash) with `outcome`: `name` where a document has the filename, `batch` where an earlier file
    of the batch that no name ruled out has the hash, `server` where a document has it, else `upload`. Nulls equal nothing."""
    named = documents.where("filename IS NOT NULL").select("filename", F.lit(True).alias("by_name")).distinct()
    hashed = documents.where("file_hash IS NOT NULL").select("file_hash", F.lit(True).alias("by_hash")).distinct()
    rows = batch.join(named, "filename", "left").join(hashed, "file_hash", "left")
    first = rows.where("by_name IS NULL").groupBy("file_hash").agg(F.min("place").alias("first"))  # added up before the shuffle, so a hot hash is no hot group
    rows = rows.join(first, "file_hash", "left")
    outcome = F.when(F.col("by_name"), "name").when(F.col("first") < F.col("place"), "batch").when(F.col("by_hash"), "server").otherwise("upload")
    return rows.select("place", "filename", "file_hash", outcome.alias("outcome"))


def audited(actions: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """The audit table with a row for each action (actor, action, query, at, and any details): details as JSON, without those that are null."""
    fixed = ["actor", "action", "query", "at"]
    details = [c for c in actions.columns if c not in fixed]
    rows = actions.select(*fixed, (F.to_json(F.struct(*details)) if details else F.lit("{}")).alias("details"))
    return rows if audit is None else audit.unionByName(rows)


def cascade(document_id: int, at: str, nodes: DataFrame, edges: DataFrame, documents: DataFrame, chunks: DataFrame, points: DataFrame, audit: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables after a document is deleted: its chunks and points go, then its edges and the nodes of it that are isolated by
    that; the document stays as `deleted`; the audit gets one row, with how many chunks and points went."""
    mine = F.col("document_id").eqNullSafe(F.lit(document_id))
    left_nodes, left_edges = delete_document(nodes, edges, document_id)
    gone = chunks.where(mine).agg(F.count("*").alias("chunks")).crossJoin(points.where(mine).agg(F.count("*").alias("points")))  # one row each
    action = gone.select(F.lit("system").alias("actor"), F.lit("delete_document").alias("action"), F.lit(str(document_id)).alias("query"), F.lit(at).alias("at"), "chunks", "points")
    return {
        "nodes": left_nodes,
        "edges": left_edges,
        "documents": documents.withColumn("status", F.when(mine, "deleted").otherwise(F.col("status"))),
        "chunks": chunks.where(~mine),
        "points": points.where(~mine),
        "audit": audited(action, audit),
    }
