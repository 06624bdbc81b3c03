"""Canonical word counts of units: count groups stand for one word, excluded numbering for none.

The scanner counts with the groups that it finds itself. Groups from elsewhere (context, named entities, abbreviations)
are merged with those and the units counted again; either way a unit costs a bisection and one sweep of its groups.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS = {"procedural": 20, "descriptive": 25, "note": 25}
_UNITS = "doc_id long, mode string, kind string, start long, end long, words int"


def _recounted(batches) -> Iterator:
    import pyarrow as pa

    from .structure import Groups

    for batch in batches:
        out = []
        for doc_id, mode, text, units, groups, more in zip(*(batch.column(k).to_pylist() for k in range(6))):
            known = Groups((g["kind"], g["cs"], g["ce"]) for g in [*(groups or ()), *(more or ())])
            out += [(doc_id, mode, u["kind"], u["start"], u["end"], known.words(text, u["cs"], u["ce"])) for u in units or ()]
        if out:
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in _UNITS.split(", ")])


def counted_units(scanned: DataFrame, extra: DataFrame | None = None, carry=()) -> DataFrame:
    """(doc_id, mode, kind, start, end, words, limit, carry...) of all word-limit units. extra: more groups by doc_id (context,
    named entities, abbreviations) as (doc_id, groups array); carry: columns of scanned to keep (without extra only)."""
    if extra is None:
        rows = scanned.select("doc_id", "mode", F.explode("units").alias("u"), *carry).select("doc_id", "mode", "u.kind", "u.start", "u.end", "u.words", *carry)
    else:
        both = scanned.join(extra.select("doc_id", F.col("groups").alias("more")).hint("merge"), "doc_id", "left")
        rows = both.select("doc_id", "mode", "text", "units", "groups", "more").mapInArrow(_recounted, _UNITS)
    limit = F.when(F.col("kind") == "note", LIMITS["note"]).when(F.col("mode") == "procedural", LIMITS["procedural"]).otherwise(LIMITS["descriptive"])
    return rows.withColumn("limit", limit)
