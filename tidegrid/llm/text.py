"""Column helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space; every other byte belongs to a word.
GAP = r"[\x20\x09-\x0D]+"


def body(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, GAP), "")
