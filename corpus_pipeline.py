"""The corpus pipeline: documents pass through the stages in order, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last return the columns of ``documents``.

Every stage judges one row a document and returns that row or none: of rows that share a doc_id the least by text,
language, source and size stays, the others go unjudged with their texts, and so do rows without doc_id. Null and empty
texts have no words: they pass the quality stage and the others unchanged. Columns beyond those of ``documents`` are
dropped, an empty table stays empty, and null languages and sources are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import decontaminate, jaccard, mixing, pii, quality
from strataframe.llm.common import one_per_id, read, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _judged(docs: DataFrame) -> DataFrame:
    """The row that each operator judges: the least of those that share a doc_id."""
    return one_per_id(docs, "doc_id", *COLUMNS[1:])


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id is among ``kept``."""
    return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = _judged(docs)
    told = quality.classify(docs.select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))
    return _only(docs, told.filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    docs = _judged(docs)
    classes = jaccard.similar_classes(docs.select("doc_id", "text"))
    return _only(docs, classes.filter("doc_id = component_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = _judged(docs)
    found = settle(decontaminate.leaks(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates; n_chars follows the text."""
    out = pii.replace_private(_judged(docs))
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mixing.mix_counts(docs.select("doc_id", "text", "source"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", private_data),
    ("mixing sources to target weights", source_mixing),
]

#: SQL can express neither the language model nor the retrieval; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
