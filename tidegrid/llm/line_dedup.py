"""Line deduplication over overlapping windows of three lines.

A window is three consecutive lines that hold a word; lines without a word are neither counted nor
removed. A window that occurs more than once in the corpus stays where it occurs first by (doc_id,
hash of the text, position); the lines of all its later occurrences are marked and the marks of
overlapping windows merge. Hashing is 128 bits wide (two hashes of the three lines).

Plan: scan -> explode windows -> partial and final count by hash -> join of the repeated hashes with
their occurrences (a sort-merge join, whose hot keys AQE can split) -> lines by document -> join with
the texts. No group is gathered but the line numbers of one document.

Edge cases: null and empty texts have no lines and stay as they are; fewer than three lines with
words give no window; repeated rows (doc_id and text alike, a null doc_id too) are one document, so
none is a later occurrence of another; rows that share a doc_id but not a text are documents of
their own, ordered by the text's hash, and never touch each other's lines; a null doc_id sorts
first; a very long text is one row and its windows are spread like those of many short ones; an
empty table stays empty; other columns pass through, whatever they are called but for names that
begin with _ld_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.text import body

WINDOW = 3


def _lines(text: Column) -> Column:
    """Lines with a word, each with its number."""
    return F.filter(
        F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"),
    )


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_ld_doc, _ld_th, _ld_lines (the three line numbers), _ld_h1, _ld_h2 for each window of each document."""
    lines = docs.select(F.col(f"`{doc_id}`").alias("_ld_doc"), F.xxhash64(f"`{text}`").alias("_ld_th"), _lines(body(f"`{text}`")).alias("_ld_l")).where(F.size("_ld_l") >= WINDOW)

    def window(s: Column, k: Column) -> Column:
        three = [s["x"], F.get(F.col("_ld_l"), k + 1)["x"], F.get(F.col("_ld_l"), k + 2)["x"]]
        numbers = F.array(s["i"], F.get(F.col("_ld_l"), k + 1)["i"], F.get(F.col("_ld_l"), k + 2)["i"])
        return F.struct(numbers.alias("n"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second"), *reversed(three)).alias("h2"))

    return lines.select(
        "_ld_doc", "_ld_th", F.explode(F.slice(F.transform("_ld_l", window), 1, F.size("_ld_l") - (WINDOW - 1))).alias("w")
    ).select("_ld_doc", "_ld_th", F.col("w.n").alias("_ld_lines"), F.col("w.h1").alias("_ld_h1"), F.col("w.h2").alias("_ld_h2"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_ld_doc, _ld_th and _ld_drop, the sorted numbers of the lines that later occurrences cover."""
    found = windows(docs, doc_id, text).withColumn("_ld_at", F.struct("_ld_doc", "_ld_th", F.get("_ld_lines", F.lit(0)).alias("i")))
    first = (
        found.groupBy("_ld_h1", "_ld_h2")
        .agg(F.min("_ld_at").alias("_ld_first"), F.max("_ld_at").alias("_ld_last"))
        .where(F.col("_ld_first") < F.col("_ld_last"))
        .drop("_ld_last")
    )
    return (
        found.join(first, ["_ld_h1", "_ld_h2"])
        .where(F.col("_ld_at") > F.col("_ld_first"))
        .select("_ld_doc", "_ld_th", F.explode("_ld_lines").alias("i"))
        .groupBy("_ld_doc", "_ld_th")
        .agg(F.sort_array(F.collect_set("i")).alias("_ld_drop"))
    )


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _ld_drop (null: none) and _ld_kept, the text without those lines (null where the text is null)."""
    marked = repeated_lines(docs, doc_id, text)
    lines = F.split(f"`{text}`", "\n")
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("_ld_drop"), s["i"])), lambda s: s["x"]), "\n")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_ld_doc")) & (F.xxhash64(f"`{text}`") == F.col("_ld_th"))
    return docs.join(marked, same, "left").drop("_ld_doc", "_ld_th").withColumn("_ld_kept", F.when(F.col("_ld_drop").isNull(), F.col(f"`{text}`")).otherwise(kept))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text and n_chars counted anew; every row stays."""
    out = drop_repeated(docs)
    changed = {"text": F.col("_ld_kept"), "n_chars": F.length("_ld_kept").cast("bigint")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """For each row: how many lines it has, how many were removed, and the digest of what is left."""
    out = drop_repeated(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size(F.split(body(), "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(F.coalesce("_ld_kept", F.lit("")), 256).alias("kept_sha256"),
    )
