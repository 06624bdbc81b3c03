"""The lint plan: scan once, run every rule family, unite, classify."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching, rules, structure
from ..schema import classify
from ..sources import glossary as glossaries
from ..sources import lexicon as lexicons
from ..sources import tables


def inputs(docs: DataFrame, lexicon: DataFrame | None = None, glossary: DataFrame | None = None, evidence: DataFrame | None = None, context: dict[str, DataFrame] | None = None, mode: str = "descriptive", families: list | None = None, codes: set[str] | None = None) -> rules.Inputs:
    """Everything that the rule families (all by default) read: the scan as a staged table that they share, of the span families,
    columns and kinds of units that they read for the codes that are asked for (all by default)."""
    from . import context as contexts

    entries = lexicon if lexicon is not None else lexicons.starter(docs.sparkSession)
    forms, ings = matching.pinned(lexicons.form_table(entries)), matching.pinned(lexicons.ing_table(entries))
    names = matching.pinned(glossaries.compiled(glossary)) if glossary is not None else None
    c = context or {}
    codes = None if codes is None else frozenset(codes)
    spans, kinds, counted, whole = tuple(structure.FAMILIES), structure.KINDS, True, bool(c) or names is not None
    if families is not None:
        wanted = {s for f in families for s in rules.reads(f, codes)} | ({"tokens", "groups"} if whole else set())
        spans = tuple(s for s in spans if s in wanted)
        if not whole:
            read = {k for f in families if {"units", "unit_words", "tokens"} & set(rules.reads(f, codes)) for k in rules.KINDS.get(f, kinds)}
            kinds, counted = tuple(k for k in kinds if k in read), rules.length in families
    scanned = tables.staged(structure.scanned(docs, mode=mode, families=spans, with_text=families is None or whole, kinds=kinds, counted=counted), "scan")
    widest = max([r["w"] or 1 for t in ([forms, names] if names is not None else [forms]) for r in t.agg(F.max("width").alias("w")).collect()])
    groups = contexts.groups(scanned, c, names) if (c or names is not None) and (families is None or rules.length in families) else None
    return rules.Inputs(scanned, forms, ings, names, evidence, c.get("occurrences"), c.get("topics"), c.get("orderings"), c.get("safety_facts"), groups, int(widest), c.get("entities"), codes)


def lint(docs: DataFrame, lexicon: DataFrame | None = None, glossary: DataFrame | None = None, evidence: DataFrame | None = None, context: dict[str, DataFrame] | None = None, mode: str = "descriptive", families: list | None = None, codes: set[str] | None = None) -> DataFrame:
    """Diagnostics of docs (doc_id, text[, mode]), of those codes if some are given: what others alone read is not computed. Sort by (doc_id, start, code, pass_no, seq) for the reporting order."""
    families = list(families or rules.FAMILIES)
    return rules.run(inputs(docs, lexicon, glossary, evidence, context, mode, families, codes), families)


def outcomes(docs: DataFrame, diags: DataFrame) -> DataFrame:
    """(doc_id, outcome, n_errors, n_blocked) of every document."""
    out = docs.select("doc_id").join(classify(diags).hint("merge"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("outcome", F.lit("clean")).alias("outcome"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("n_blocked", F.lit(0)).alias("n_blocked"))


def exit_code(diags: DataFrame) -> int:
    """1 with errors, 2 with blocked ones only, else 0."""
    r = diags.agg(F.bool_or(F.col("severity") == "error").alias("e"), F.bool_or(F.col("severity") == "blocked").alias("b")).first()
    return 1 if r["e"] else 2 if r["b"] else 0


#: Exit codes of runs that give no diagnostics: data that do not hold, and anything else that fails.
INVALID_DATA, FAILED = 3, 4


def run_status(work: Callable[[], DataFrame]) -> tuple[int, str]:
    """(exit code, message) of a run: work reads what it needs and gives diagnostics.

    0 to 2 as exit_code(); 3 if a lexicon, terminology, context or project file is missing where one is needed or does not hold
    (these readers raise ValueError); 4 if anything else fails, reading and writing of files included.
    """
    try:
        return exit_code(work()), ""
    except ValueError as e:
        return INVALID_DATA, str(e)
    except Exception as e:
        return FAILED, str(e).splitlines()[0] if str(e) else type(e).__name__
