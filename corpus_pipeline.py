"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.columns import picked
from larkspur.llm.mixing import mixed
from larkspur.llm.ngram_join import ngram_join
from larkspur.llm.packing import packed
from larkspur.llm.quality_model import quality_scores
from larkspur.llm.quality_rules import quality_rules
from larkspur.runtime import shared_dir, temporary, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever other columns are called."""
    return picked(docs, **{c: c for c in COLUMNS})


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps.

    Null and empty texts, and texts without words, go. Rows are judged one by one, so
    rows that repeat stay or go together, and null or repeated ids change nothing but which
    rows are drawn to train the scorer. An empty table gives an empty table. Only the
    columns of documents are read and returned, so others can't clash."""
    return quality_scores(_documents(docs)).where("quality_kept").select(*COLUMNS)


def quality_line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed; n_chars is that of the text that stays.

    Null and empty texts, and all of fewer words than the rules ask for, go. Rows are
    judged one by one: repeated rows and null ids change nothing, and there are no ties. An
    empty table gives an empty table. Only the columns of documents are read and returned."""
    kept = quality_rules(_documents(docs)).where("kept")
    return kept.select("doc_id", F.col("cleaned_text").alias("text"), "lang", "source", F.length("cleaned_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on 5-grams: that of the smallest
    id, null last; of rows with that id, the first by a key of their own. Rows are told apart by
    that key, so rows without an id, or with one that others have too, are grouped by their
    texts like all others.

    Null texts, and texts without words, are linked with nothing and stay. An empty table
    gives an empty table. Only the columns of documents are read and returned."""
    keyed = written(_documents(docs).withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    groups = ngram_join(keyed, n=5, percent=80, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    groups = written(groups.join(keyed.select("row_key", "doc_id"), "row_key"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first")
    several = groups.groupBy("component_id").agg(first, F.count("*").alias("n")).where("n > 1")
    others = groups.join(several, "component_id").where("row_key <> first.row_key").select("row_key")
    return keyed.join(others, "row_key", "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source. Null and empty texts have size 0 and are taken at their
    source's rate, or not at all where it has no words. Rows that repeat, and null and repeated
    ids, are drawn one by one. An empty table gives an empty table. Only the columns of
    documents are read and returned."""
    return mixed(_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences: the columns of ``packing.packed``.

    Null text is the empty text: one piece of one token. Rows that repeat are packed as often
    as they come, and null ids pass on. Pieces of one length are placed in the order of
    the table. An empty table gives an empty table. Only id and text are read."""
    return packed(_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_line_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]

#: Trained scores, hashes and tokens aren't SQL. Tests hold rules, join and mixing against plain
#: Python, the classifier against labels, packing against ids, places and bounds.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again, and its intermediate tables go."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
