"""The corpus pipeline: cleaning and packing of ``documents`` in stages, each written as Parquet and read again.

NULLs, empty tables, repeated rows and further columns are treated as the operators' docstrings say. All stages but the
last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazeledger.llm import decontaminate, near_text, packing, quality, secrets
from gazeledger.llm.catalog import TOKENIZER
from gazeledger.llm.common import keep_ids, materialise, small_batches, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on a sample of all labelled documents, does not reject."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, model)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``: a row without an id takes one from its text, in the top quarter of the range, so that rows of equal
    texts are one document. Two texts share such an id with a chance of 2**-62. Rows without id and words keep NULL."""
    made = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(2**62)
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.when(has_words, made)).alias("doc_id"), "text",
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of every group of near-duplicates: five words, a similarity of 0.8.

    Rows that repeat a document's id are one document too: of them the row that comes first by its columns' hash stays.
    Rows with a NULL id are judged like others, behind all that have one (see ``keyed``); without words they all stay.
    """
    small_batches(spark)
    own = keyed(docs)
    found = near_text.near_duplicates(own, size=5, percent=80)
    decided = materialise(found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")), "decisions")
    once = keep_ids(own, materialise(decided.where("kept and n = 1 and doc_id is not null").select("doc_id"), "kept"), "doc_id")
    repeated = keep_ids(own, materialise(decided.where("kept and n > 1 and doc_id is not null").select("doc_id"), "repeated"), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("row")))
    first = repeated.withColumn("place", place).where("place = 1")
    return once.select("row.*").union(first.select("row.*")).union(own.where("doc_id is null").select("row.*"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, those with a NULL id included."""
    own = keyed(docs)
    found = decontaminate.contained_items(own, table(spark, sf_dir, "benchmark"))
    return decontaminate.clean(own, found).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew where the text changed."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    small_batches(spark)
    return packing.pack(docs, TOKENIZER, with_ids=False)


STAGES = [
    ("good_quality", good_quality),
    ("near_distinct", near_distinct),
    ("uncontaminated", uncontaminated),
    ("without_secrets", without_secrets),
    ("packed", packed),
]
ORACLE_SQL = None  # a trained model and token ids are beyond SQL; tests/llm/test_pipeline.py compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
