"""Stateless rules over streams of documents: the scan and the counting are narrow, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counting, rewrite, structure


def long_sentences(docs: DataFrame, mode: str = "descriptive") -> DataFrame:
    """Sentences over the limit of a stream (or table) of documents (doc_id, text)."""
    return counting.counted_units(structure.scanned(docs, mode=mode, families=("units",), with_text=False)).where(F.col("words") > F.col("limit"))


def rewrites(changes: DataFrame) -> DataFrame:
    """check_rewrites() of a stream of changes (original, proposed)."""
    return rewrite.check_rewrites(changes)
