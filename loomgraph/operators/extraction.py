"""Extraction with a cache by content: a text that was extracted before isn't read again, and equal texts are read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import arriving_entities, canonicalize, remap_relationship
from ..vocab import NODE_LABELS

ENTITIES = "array<struct<name:string,type:string,confidence:double>>"
RELATIONSHIPS = "array<struct<source:string,target:string,type:string,confidence:double>>"
RESULT = f"struct<entities:{ENTITIES},relationships:{RELATIONSHIPS}>"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def parsed(result: Column) -> Column:
    """A cached result; null where it isn't one."""
    x = F.from_json(result, RESULT)
    return F.when(x["entities"].isNotNull(), x)


def coerced(kind: Column, otherwise: str = "Entity") -> Column:
    """A type of the vocabulary as it is, any other and none as `otherwise`."""
    return F.when(kind.isin(NODE_LABELS), kind).otherwise(F.lit(otherwise))


def typed_relationship(kind: Column) -> Column:
    """A relationship's type in capitals with underscores, mapped to the vocabulary; none is RELATED_TO."""
    return remap_relationship(F.replace(F.upper(F.coalesce(kind, F.lit("RELATED_TO"))), F.lit(" "), F.lit("_")))


def _in_order(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """file_hash and an array of each text's items in the order of `at`."""
    return rows.groupBy("file_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("x")))), lambda e: e["x"]).alias(name))


def results(texts: DataFrame, entities: DataFrame | None = None, relationships: DataFrame | None = None) -> DataFrame:
    """file_hash, result (JSON) of distinct texts (file_hash, text).

    Rules find names in order, a model's findings follow: entities (file_hash, nth, name, type, confidence), relationships (file_hash,
    nth, source, target, type, confidence). Of one canonical name the first stays; unknown types are `Entity`; names that are
    empty or null go; confidence unsaid is 1. Rules add no relationships here, so without a model there are none.
    """
    found = arriving_entities(texts.select(F.col("file_hash").alias("id"), "text")).select(F.col("id").alias("file_hash"), F.struct(F.lit(0).alias("arm"), F.col("nth").cast("long").alias("nth")).alias("at"), "name", "type", "confidence")
    if entities is not None:
        found = found.unionByName(entities.select("file_hash", F.struct(F.lit(1).alias("arm"), F.col("nth").cast("long").alias("nth")).alias("at"), "name", "type", F.coalesce("confidence", F.lit(1.0)).alias("confidence")))
    named = found.withColumn("name", canonicalize(F.col("name"))).where("name <> ''")
    first = named.groupBy("file_hash", "name").agg(F.min_by(F.struct("type", "confidence"), "at").alias("e"), F.min("at").alias("at"))
    item = F.struct("name", coerced(F.col("e.type")).alias("type"), F.col("e.confidence").cast("double").alias("confidence"))
    out = texts.select("file_hash").join(_in_order(first, item, "entities"), "file_hash", "left")
    if relationships is not None:
        ends = relationships.select("file_hash", F.col("nth").cast("long").alias("at"), canonicalize(F.col("source")).alias("source"), canonicalize(F.col("target")).alias("target"), typed_relationship(F.col("type")).alias("type"), F.coalesce("confidence", F.lit(1.0)).cast("double").alias("confidence"))
        out = out.join(_in_order(ends.where("source <> '' AND target <> ''"), F.struct("source", "target", "type", "confidence"), "relationships"), "file_hash", "left")
    else:
        out = out.withColumn("relationships", F.lit(None).cast(RELATIONSHIPS))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return out.select("file_hash", F.to_json(F.struct(empty("entities", ENTITIES), empty("relationships", RELATIONSHIPS))).alias("result"))


def extract_once(docs: DataFrame, cache: DataFrame, entities: DataFrame | None = None, relationships: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, additions) of documents (id, text) and a cache (file_hash, result).

    Answers: id, cached, result (a struct of entities and relationships). Additions: the cache's new rows, to be appended; none where
    no model ran (neither entities nor relationships given). A cached result that is no JSON of this form counts as none, and
    a hash that is there more than once takes its smallest result. Null texts count as empty ones.
    """
    hashed = docs.select("id", "text", content_hash(F.col("text")).alias("file_hash"))
    good = cache.select("file_hash", "result").where(parsed(F.col("result")).isNotNull()).groupBy("file_hash").agg(F.min("result").alias("result"))
    new = hashed.join(good, "file_hash", "left_anti").groupBy("file_hash").agg(F.first("text").alias("text"))
    made = results(new, entities, relationships)
    known = good.withColumn("cached", F.lit(True)).unionByName(made.withColumn("cached", F.lit(False)))
    answers = hashed.select("id", "file_hash").join(known, "file_hash").select("id", "cached", parsed(F.col("result")).alias("result"))
    additions = made if entities is not None or relationships is not None else made.limit(0)
    return answers, additions
