"""Fixes: replacements of spans, and lint after them.

Fixes are (doc_id, start, end, replacement) in bytes of the text. They are applied from the last to the first; of two that
overlap the later one is applied, the earlier one is left out and reported by overlaps().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import arrays
from ..schema import classify

def _sorted(fixes: DataFrame) -> DataFrame:
    """Fixes with taken: a sweep from the last fix to the first takes those that end where the last taken one starts, or before."""
    rows = fixes.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "replacement")), asc=False).alias("all"))
    rows = rows.withColumn("whole", F.filter("all", lambda f: f["start"] <= f["end"]))
    # a sweep to the left is one to the right of the mirrored places
    places = arrays.kept_places(F.transform("whole", lambda f: -f["end"]), F.transform("whole", lambda f: -f["start"]))
    return rows.withColumn("taken", F.reverse(F.transform(places, lambda i: F.get("whole", i.cast("int"))))).drop("whole")


def overlaps(fixes: DataFrame) -> DataFrame:
    """Fixes that are not applied, for a later one overlaps them."""
    return _sorted(fixes).select("doc_id", F.explode(F.array_except("all", "taken")).alias("f")).select("doc_id", "f.*")


def apply_fixes(docs: DataFrame, fixes: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with fixed texts and the column fixed (whether any fix was applied). A null text stays null."""
    raw = F.col("_raw")
    piece = lambda a, b: F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).cast("string")
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("taken", i - 1)["end"])
    parts = F.transform("taken", lambda f, i: F.concat(piece(before(i), f["start"]), f["replacement"]))
    last = F.element_at("taken", -1)["end"]
    both = docs.withColumn("_raw", F.col("text").cast("binary")).join(_sorted(fixes).select("doc_id", "taken").hint("merge"), "doc_id", "left")
    some = F.col("taken").isNotNull() & (F.size("taken") > 0) & F.col("text").isNotNull()
    text = F.when(some, F.concat(F.array_join(parts, ""), piece(last, F.octet_length("text").cast("long")))).otherwise(F.col("text"))
    return both.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), F.coalesce(some, F.lit(False)).alias("fixed"))


def lint_fixed(docs: DataFrame, fixes: DataFrame, lint: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixed documents, their diagnostics, outcomes): lint is called once, on the fixed texts; documents without errors and
    blocked rules are fixed if a fix was applied, else clean."""
    out = apply_fixes(docs, fixes)
    diags = lint(out.drop("fixed"))
    rows = out.select("doc_id", "fixed").join(classify(diags).hint("merge"), "doc_id", "left")
    outcome = F.when(F.col("outcome").isin("error", "blocked"), F.col("outcome")).when(F.col("fixed"), "fixed").otherwise("clean")
    return out, diags, rows.select("doc_id", outcome.alias("outcome"), "fixed", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("n_blocked", F.lit(0)).alias("n_blocked"))


def replacements(rows: DataFrame) -> DataFrame:
    """Fixes of lexical_rows()-like places (doc_id, start, end, phrase) joined with a replacement: unapproved words that have one
    word to be written instead; the first letter keeps its case."""
    capital = F.col("text").rlike("^\\p{Lu}")
    new = F.when(capital, F.concat(F.upper(F.left("instead", F.lit(1))), F.substring("instead", 2, 1 << 20))).otherwise(F.col("instead"))
    return rows.where("instead is not null").select("doc_id", "start", "end", new.alias("replacement"))


def in_order(diags: DataFrame) -> DataFrame:
    """Diagnostics in the reporting order, numbered by document: by start and code, ties by pass and place in it."""
    w = Window.partitionBy("doc_id").orderBy("start", "code", "pass_no", "seq", "end")
    return diags.withColumn("nth", F.row_number().over(w) - 1)
