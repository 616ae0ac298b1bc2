"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that a classifier is fitted on, at most.
PER_CLASS = 4000


def fold(doc_id: str | Column = "doc_id") -> Column:
    """0 to 4 by the CRC-32 of the id's text; rows of fold 0 are never learnt from."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % 5


def part() -> Column:
    """0 to 9 by the id's hash."""
    return F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)).cast("int")


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of all labelled documents, none of fold 0."""
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold() != 0)).distinct()


def chosen(labels: DataFrame, label: str, per_class: int, first: int = 0, end: int = 10) -> DataFrame:
    """doc_id, y of at most per_class labelled documents of each class: the least hashes of ids in parts first to end - 1, none of fold 0.

    The choice doesn't depend on the order of rows, and its size is bounded, so it may be broadcast.
    """
    some = known(labels, label).where(part().between(first, end - 1))
    order = F.xxhash64("doc_id", F.lit("sample"))
    return reduce(DataFrame.union, [some.where(F.col("y") == y).orderBy(order).limit(per_class) for y in (0, 1)])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, end: int = 10) -> DataFrame:
    """doc_id, text, y, part (under `end`) of at most per_class documents of each class."""
    return keyed(docs).join(F.broadcast(chosen(labels, label, per_class, 0, end)), "doc_id").select("doc_id", "text", "y", part().alias("part"))
