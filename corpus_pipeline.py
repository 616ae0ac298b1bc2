"""A training corpus from raw documents: five stages, each an operator of tidegrid.llm over all that the stage before kept.

Edge cases are those of the operators: a null or empty text fails the quality rules and goes there; rows
that repeat or share a doc_id are kept or dropped by what each operator says of them; a null doc_id
passes near-duplicate removal unharmed; very long texts are taken whole; an empty table stays empty
through all stages; further columns of documents are carried to the last stage, whatever they are
called but for the prefixes that the operators reserve (_q_, _ld_, _sh_, _dc_).
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontaminate, line_dedup, quality_rules, sentencepieces, simhash
from tidegrid.llm.lineage import remove, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; every document stays, if need be empty."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return simhash.drop_similar(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text and its sampled segmentations; fewer words are remembered than alone, as executors have grown by then."""
    return sentencepieces.report(docs, kept=90_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontaminate", leaks),
    ("sentencepieces", pieces),
]

#: Suffix automata, Golay codes, WAND and sampled segmentations can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet to the shared folder and read again.

    A stage's result goes once the next one is written; the last of them stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, before = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            remove(spark, before)
        before = f"{top}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
