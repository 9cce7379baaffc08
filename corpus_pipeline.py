"""Documents to packed sequences in five stages; see `STAGES`.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. SQL can't express the stages (trained models, a tokenizer, packing), so ORACLE_SQL is None; each
stage's operator is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, langid, packing, pii, set_join
from loomgraph.llm.common import bounded_batches, cut, table

#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this is no language that was learnt.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the model is sure of, go; lang becomes the prediction.

    Null texts have no letter. Rows with a null lang are judged but not learnt from; where no row has a lang, no language was
    learnt, and all rows stay as they are. Repeated rows are each judged alike. Long texts are read whole.
    """
    bounded_batches(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs.select(*COLUMNS)
    found = langid.identify(docs.select(*COLUMNS), model, "doc_id", "text", "source", "n_chars")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, similarity 0.8), the smallest id stays.

    Texts without words, null or empty, are like nothing and stay. Of repeated rows of one id and text all stay or all go. Rows
    without an id stay. Long texts are compared whole.
    """
    bounded_batches(spark)
    return set_join.keep_one(docs.select(*COLUMNS), words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; an item of fewer words than a window is one window. Rows are judged by id and text.
    """
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is that of the new text. No document goes.

    A null text stays null and has a null n_chars. Spans that overlap become one, named by the first.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences. A null or empty text is a piece of its end id; repeated rows are packed each."""
    bounded_batches(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
