"""From raw documents to packed sequences: each stage is written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.llm import cotraining, hyperminhash, line_runs, packing, tiling
from tracewell.llm.store import free_name, keep


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null and empty texts are scored by their metadata and the shape of an empty page;
    repeated rows are scored each; without labels of both classes all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = cotraining.added_columns(docs.columns)[-1]
    return cotraining.classify(docs, labels).where(kept).select(*_own(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one that had nothing else goes.

    Null texts and texts without words stay as they are; rows that repeat id and text
    are treated alike.
    """
    removed = free_name(docs.columns, "n_lines_removed")
    left = (F.col(removed) == 0) | F.col("text").rlike(line_runs.WORD)
    return line_runs.dedup_lines(docs).where(left).select(*_own(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more; the smallest id stays.

    Texts without words and rows without an id stay; of rows that repeat both id and
    text one stays, of rows that repeat an id only all.
    """
    gone = hyperminhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*_own(docs))
    again = keep(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(*_own(docs)).unionByName(once.select(*_own(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows go or stay together."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; a null or empty text is one piece, its end token."""
    return packing.pack(docs)


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name.replace(" ", "-"))
    return docs


#: The classifier and the tokenizer can't be said in SQL; tests compare each stage with a plain version.
ORACLE_SQL: str | None = None
