"""Schemas shared by all rules and readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIAGNOSTIC = "doc_id long, code string, severity string, start long, end long, rules array<string>, message string, evidence string, pass_no int, seq long"

#: Order in which rule families report; ties of (start, code) keep it.
PASSES = [
    "punctuation", "contractions", "length", "lists", "notes", "paragraph", "verb_constructions", "grammar", "entities", "discourse",
    "technical_roles", "dictionary_forms", "dictionary_roles", "procedural", "contextual", "lexical",
]

# Rules that each code cites.
RULES = {
    "STE-PUNC-001": ["8.1"], "STE-PUNC-002": ["8.2"], "STE-PUNC-003": ["8.3"], "STE-SYN-001": ["4.2"],
    "STE-LEN-001": ["4.1", "5.1", "8.4", "8.5", "8.6", "8.7"], "STE-LEN-002": ["4.1", "6.3", "8.4", "8.5", "8.6", "8.7"],
    "STE-LIST-001": ["4.3"], "STE-LIST-002": ["4.3"], "STE-LIST-003": ["4.3"], "STE-LIST-004": ["4.3"],
    "STE-NOTE-001": ["5.5"], "STE-NOTE-002": ["5.5"], "STE-PARA-001": ["6.6"], "STE-PARA-002": ["6.5"],
    "STE-VERB-001": ["3.2", "3.3", "3.4"], "STE-VERB-002": ["3.2", "3.4"], "STE-VERB-003": ["3.3", "3.4"], "STE-VERB-004": ["3.3", "3.4"],
    "STE-VERB-005": ["3.2", "3.4", "3.5"], "STE-VERB-006": ["3.2", "3.4", "3.5"], "STE-VERB-007": ["3.5"],
    "STE-GRAM-001": ["1.2"], "STE-GRAM-002": ["3.5"], "STE-GRAM-003": ["3.3", "3.6"], "STE-NOUN-001": ["2.1"], "STE-NOUN-002": ["2.2"],
    "STE-DISC-001": ["6.1"], "STE-TERM-001": ["1.1"], "STE-TERM-002": ["1.8"], "STE-TERM-003": ["1.7"], "STE-TERM-004": ["1.13"],
    "STE-FORM-001": ["1.4"], "STE-SAFE-001": ["7.2"], "STE-SAFE-002": ["7.2"], "STE-SAFE-003": ["7.1"],
    "STE-PROC-001": ["5.3"], "STE-PROC-002": ["5.4"], "STE-PROC-003": ["5.2"], "STE-PROC-004": ["5.3"],
    "STE-CTX-000": [], "STE-CTX-001": ["1.3", "9.2"], "STE-CTX-002": ["1.10"], "STE-CTX-003": ["1.14"], "STE-PHRASE-001": ["9.3"],
    "STE-LEX-001": ["1.1"], "STE-LEX-002": ["1.1"],
}


def diagnostics(rows: DataFrame, family: str, code: str | Column, severity: str | Column, message: str, evidence: Column | None = None, start: str | Column = "start", end: str | Column = "end", rules: Column | None = None, text: Column | None = None) -> DataFrame:
    """rows (doc_id, start, end, ...) as diagnostics of one rule family."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    code = lit(code)
    if rules is None:
        table = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
        rules = table[code]
    return rows.select(
        "doc_id", code.alias("code"), lit(severity).alias("severity"), col(start).cast("long").alias("start"), col(end).cast("long").alias("end"),
        rules.alias("rules"), (F.lit(message) if text is None else text).alias("message"), (evidence if evidence is not None else F.lit(None).cast("string")).alias("evidence"),
        F.lit(PASSES.index(family)).alias("pass_no"), col(start).cast("long").alias("seq"),
    )


def _any(conditions) -> Column:
    """Whether one of the conditions holds: rows without any go before their diagnostics are made."""
    return reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in conditions))


def diagnose(rows: DataFrame, family: str, tests: list[tuple[Column, str, str, str]], evidence: Column | None = None, start: str = "start", end: str = "end", rules: Column | None = None) -> DataFrame:
    """Diagnostics of all tests (condition, code, severity, message) in one pass over rows; a null condition is false."""
    if len(tests) == 1:
        c, code, sev, msg = tests[0]
        return diagnostics(rows.where(F.coalesce(c, F.lit(False))), family, code, sev, msg, evidence, start, end, rules)
    if not tests:
        return diagnostics(rows.where("false"), family, "", "", "", evidence, start, end)
    hits = F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(msg).alias("message"))) for c, code, sev, msg in tests])
    kept = rows.where(_any(t[0] for t in tests)).select("doc_id", F.col(start).alias("start"), F.col(end).alias("end"), hits.alias("_hits"), (evidence if evidence is not None else F.lit(None).cast("string")).alias("_evidence"), (rules if rules is not None else F.lit(None).cast("array<string>")).alias("_rules"))
    flat = kept.withColumn("_h", F.explode("_hits")).where(F.col("_h").isNotNull())
    table = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    out = diagnostics(flat, family, F.col("_h.code"), F.col("_h.severity"), "", F.col("_evidence"), rules=F.coalesce(F.col("_rules"), table[F.col("_h.code")]), text=F.col("_h.message"))
    return out


def diagnose_one(rows: DataFrame, family: str, tests: list[tuple[Column, str, str, str]], evidence: Column | None = None, rules: Column | None = None) -> DataFrame:
    """diagnose() for tests of which no two hold at once: each row gives one diagnostic or none, without an array of hits."""
    pick = lambda k: reduce(lambda c, t: c.when(t[0], t[k]), tests, F)
    table = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    own = table[pick(1)] if rules is None else F.coalesce(rules, table[pick(1)])
    return diagnostics(rows.where(pick(1).isNotNull()), family, pick(1), pick(2), "", evidence, rules=own, text=pick(3))


def checks(rows: DataFrame, tests: list[tuple]) -> DataFrame:
    """Diagnostics of tests (family, condition, code, severity, message, evidence, start) of several families in one pass over
    rows (doc_id, end, ...); a null condition is false."""
    hit = lambda f, c, code, sev, msg, ev, start: F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(msg).alias("message"), F.lit(PASSES.index(f)).alias("pass_no"), ev.alias("evidence"), F.col(start).cast("long").alias("start")))
    hits = F.array(*[hit(*t) for t in tests])
    flat = rows.where(_any(t[1] for t in tests)).select("doc_id", F.col("end").cast("long").alias("end"), F.explode(hits).alias("h")).where(F.col("h").isNotNull())
    table = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return flat.select("doc_id", "h.code", "h.severity", "h.start", "end", table[F.col("h.code")].alias("rules"), "h.message", "h.evidence", "h.pass_no", F.col("h.start").alias("seq"))


def classify(diags: DataFrame) -> DataFrame:
    """(doc_id, outcome, n_errors, n_blocked): error over blocked."""
    counts = diags.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "blocked").alias("n_blocked"))
    return counts.select("doc_id", F.when(F.col("n_errors") > 0, "error").when(F.col("n_blocked") > 0, "blocked").otherwise("clean").alias("outcome"), "n_errors", "n_blocked")
