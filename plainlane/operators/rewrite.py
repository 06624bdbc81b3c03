"""Rewrite checks: modality, negation and quantities of a proposed text against its original. Narrow, Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words whose counts must not change.
MODALITY = ["may", "can", "could", "must", "should", "will"]
NEGATION = ["not", "no", "never", "cannot"]
NUMBER = "[-+]?(?:\\p{Nd}+(?:\\.\\p{Nd}+)?|\\.\\p{Nd}+)"


def words_among(text: Column, words: list[str]) -> Column:
    """The sorted occurrences of some words: equal arrays are equal multisets."""
    return F.array_sort(F.filter(F.split(F.lower(text), "[^\\p{IsAlphabetic}]+"), lambda w: w.isin(*words)))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def check_rewrites(changes: DataFrame, original: str = "original", proposed: str = "proposed") -> DataFrame:
    """changes with codes (of SEM-MODALITY-001, SEM-NEGATION-001, SEM-QUANTITY-001) and accepted."""
    a, b = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(proposed), F.lit(""))
    tests = [
        ("SEM-MODALITY-001", words_among(a, MODALITY) != words_among(b, MODALITY)),
        ("SEM-NEGATION-001", words_among(a, NEGATION) != words_among(b, NEGATION)),
        ("SEM-QUANTITY-001", numbers(a) != numbers(b)),
    ]
    codes = F.filter(F.array(*[F.when(t, F.lit(c)) for c, t in tests]), lambda c: c.isNotNull())
    return changes.withColumn("codes", codes).withColumn("accepted", F.size("codes") == 0)
