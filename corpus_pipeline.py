"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All stages but the last return
the columns of documents; removed lines leave the text, and n_chars follows it. Results are written as Parquet in the shared
folder and read again between stages.

Null texts count as empty and fail the quality rules; rows with equal id and text are the same document, of which near-dedup
keeps one row, as of each group of copies; ties go to the smallest id; extra columns pass through, whatever their names; an
empty table gives empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import line_dedup, near_dedup, packing, quality_classifier, quality_rules
from ledgerlake.llm.common import saved, table

#: A stage's classes, similarities and windows can't be had in SQL; the tests compare with versions of brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))
    return docs.select(*columns)


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with names of their own for columns that operators don't read, so that they clash with nothing; and the names."""
    names = [c if c in ("doc_id", "text", "source", "n_chars") else f"extra{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough."""
    own, names = _plain(docs)
    model = quality_classifier.fit(own, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(own, model, out="score")
    return scored.where(F.col("score") >= quality_classifier.THRESHOLD).select(*names).toDF(*docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that many documents of their host share."""
    own, names = _plain(docs)
    judged = quality_rules.judge(own, with_text=True)
    return _counted(judged.where("kept"), names).toDF(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to earlier ones."""
    return _counted(line_dedup.apply(docs), docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("line_dedup", remove_lines),
    ("near_dedup", keep_one),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
