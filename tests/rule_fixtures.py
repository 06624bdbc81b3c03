"""A small corpus that makes every rule family report, with the diagnostics that are expected of it, written by hand.

EXPECTED names each diagnostic by the text it stands on (and which occurrence of it); its SQL finds the place in the text, so it
shares nothing with the rules but the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlane.plans import lint
from plainlane.sources import glossary as glossaries

_LONG = " ".join(["tool"] * 27)
TEXTS = [
    (1, "procedural", "Open the valve; close the cap and clean the tool.\n\nNOTE: Remove the cap.\n"),
    (2, "descriptive", "The pipe was removed. It doesn't utilize water. The tool has closed the door. The valve is closing. The new water pump system part is hot."),
    (3, "procedural", "Use this:\n\n- first item,\n- Turn the tool\n\nWARNING: The pressure is hot.\nIf the door is open remove it."),
    (4, "descriptive", "It's hot. They're here, and we can't stop; use \"x;y\" or `a;b`."),
    (5, "procedural", f"Use the {_LONG}.\n\nNOTE: Open the cap.\n\nThe tool turns. It was removed.\n\nCAUTION: Open the door."),
    (6, "descriptive", "It is hot. It is hot. It is hot. It is hot. It is hot. It is hot. It is hot."),
    (7, "descriptive", f"Use the {_LONG}.\n\nThe tools\n\n- Do it.\n"),
    (8, "procedural", "Zorb the cap. Look at the blip. This is an old name. The control unit is hot."),
    (9, "descriptive", "The colour of the well-made cap is good. It breaks down (often). See the yard and the item."),
    (10, "descriptive", "It is good. Using it, we record it. He cleaning it. The gizmo runs."),
    (11, "procedural", "WARNING: Stop it."),
    (12, "descriptive", "First one. Second one."),
    (13, "descriptive", "It has set it. It was cleaned. The record is opening. It is connected."),
]
TERMS = [
    {"id": "a", "canonical": "zorb", "roles": ["noun"], "status": "approved"},
    {"id": "b", "canonical": "blip", "roles": ["verb"], "status": "approved"},
    {"id": "c", "canonical": "old name", "roles": ["noun"], "status": "deprecated", "replacement": "a"},
    {"id": "d", "canonical": "main engine fuel control unit", "roles": ["noun"], "status": "approved", "aliases": [{"text": "control unit", "kind": "short"}]},
]

#: (document, code, severity, text it stands on, its occurrence). STE-TERM-001 is left to the queries on documents.
EXPECTED = [
    (1, "STE-PUNC-001", "error", ";", 1), (1, "STE-PROC-003", "error", "Open the valve; close the cap and clean the tool.", 1),
    (1, "STE-PROC-004", "blocked", "Open the valve; close the cap and clean the tool.", 1), (1, "STE-NOTE-001", "error", "Remove the cap.", 1),
    (2, "STE-VERB-003", "error", "was removed", 1), (2, "STE-SYN-001", "error", "doesn't", 1), (2, "STE-LEX-001", "error", "utilize", 1),
    (2, "STE-VERB-001", "error", "has closed", 1), (2, "STE-VERB-005", "error", "is closing", 1), (2, "STE-GRAM-002", "error", "is closing", 1),
    (2, "STE-NOUN-001", "error", "new water pump system part", 1),
    (3, "STE-LIST-002", "error", "first item,", 1), (3, "STE-LIST-003", "error", "first item,", 1), (3, "STE-LIST-004", "error", "Turn the tool", 1),
    (3, "STE-SAFE-001", "error", " The pressure is hot.", 1), (3, "STE-PROC-002", "error", "If the door is open remove it.", 1),
    (4, "STE-SYN-001", "error", "It's", 1), (4, "STE-SYN-001", "error", "They're", 1), (4, "STE-SYN-001", "error", "can't", 1),
    (4, "STE-PUNC-001", "error", ";", 1), (4, "STE-PUNC-001", "error", ";", 2),
    (5, "STE-LEN-001", "error", f"Use the {_LONG}.", 1), (5, "STE-NOTE-002", "blocked", "Open the cap.", 1), (5, "STE-PROC-001", "error", "The tool turns.", 1),
    (5, "STE-PROC-001", "error", "It was removed.", 1), (5, "STE-VERB-003", "error", "was removed", 1), (5, "STE-GRAM-003", "error", "was removed", 1),
    (5, "STE-SAFE-002", "blocked", " Open the door.", 1),
    (6, "STE-PARA-001", "error", "It is hot. It is hot. It is hot. It is hot. It is hot. It is hot. It is hot.", 1),
    (7, "STE-LEN-002", "error", f"Use the {_LONG}.", 1), (7, "STE-LIST-001", "error", "- Do it.", 1),
    (8, "STE-TERM-003", "error", "Zorb", 1), (8, "STE-TERM-004", "error", "blip", 1), (8, "STE-TERM-002", "error", "old name", 1), (8, "STE-NOUN-002", "error", "control unit", 1),
    (8, "STE-PROC-001", "error", "This is an old name.", 1), (8, "STE-PROC-001", "error", "The control unit is hot.", 1),
    (9, "STE-CTX-003", "error", "colour", 1), (9, "STE-PUNC-002", "error", "well-made", 1), (9, "STE-PHRASE-001", "error", "breaks down", 1), (9, "STE-PUNC-003", "error", "(often)", 1),
    (9, "STE-CTX-001", "error", "yard", 1), (9, "STE-CTX-002", "error", "item", 1),
    (9, "STE-PARA-002", "error", "The colour of the well-made cap is good. It breaks down (often). See the yard and the item.", 1),
    (10, "STE-LEX-001", "error", "Using", 1), (10, "STE-VERB-007", "error", "cleaning", 1), (10, "STE-GRAM-001", "error", "good", 1), (10, "STE-FORM-001", "error", "runs", 1),
    (11, "STE-SAFE-003", "error", " Stop it.", 1),
    (12, "STE-DISC-001", "error", "First one.", 1),
    (13, "STE-VERB-002", "blocked", "has set", 1), (13, "STE-VERB-003", "error", "was cleaned", 1), (13, "STE-VERB-006", "blocked", "is opening", 1), (13, "STE-VERB-004", "blocked", "is connected", 1),
    (5, "STE-NOUN-001", "error", _LONG, 1), (7, "STE-NOUN-001", "error", _LONG, 1), (9, "STE-LEX-002", "blocked", "yard", 1),
]


def _at(doc: int, part: str) -> tuple[int, int]:
    text = next(t for i, _, t in TEXTS if i == doc)
    return text.index(part), text.index(part) + len(part)


def context(spark: SparkSession) -> dict[str, DataFrame]:
    """Facts that the contextual families read."""
    names = ["dictionary_meaning", "technical_noun_scope", "spelling", "hyphen_direct_relation", "phrasal_verb", "parenthesis_use"]
    facts = {"colour": ("spelling", "british"), "well-made": ("hyphen_direct_relation", False), "breaks down": ("phrasal_verb", True), "(often)": ("parenthesis_use", "other"), "yard": ("dictionary_meaning", "unapproved"), "item": ("technical_noun_scope", "slang")}
    rows = [(9, *_at(9, part), "s", *(value if n == name else None for n in names)) for part, (name, value) in facts.items()]
    node, span = "struct<kind:string,start:bigint,end:bigint>", "struct<start:bigint,end:bigint>"
    first, second = ("sentence", *_at(12, "First one.")), ("sentence", 11, 22)
    return {
        "occurrences": spark.createDataFrame(rows, "doc_id long, start long, end long, source string, dictionary_meaning string, technical_noun_scope string, spelling string, hyphen_direct_relation boolean, phrasal_verb boolean, parenthesis_use string"),
        "topics": spark.createDataFrame([(9, 0, 10, "x", "s"), (9, 12, 20, "y", "s")], "doc_id long, start long, end long, topic string, source string"),
        "orderings": spark.createDataFrame([(12, second, first)], f"doc_id long, before {node}, after {node}"),
        "safety_facts": spark.createDataFrame([(11, 8, 17, "caution", (9, 13), None)], f"doc_id long, start long, end long, safety_level string, command {span}, actor {span}").withColumn("hazard", F.lit(None).cast(span)).withColumn("consequence", F.lit(None).cast(span)),
    }


def evidence(spark: SparkSession) -> DataFrame:
    rows = [(10, *_at(10, "cleaning"), "clean", "verb"), (10, *_at(10, "runs"), "run", "verb"), (10, *_at(10, "good"), None, "noun")]
    return spark.createDataFrame(rows, "doc_id long, start long, end long, lemma string, pos string")


def lexicon(spark: SparkSession) -> DataFrame:
    """The starter lexicon and a few entries that make rules of evidence and of several readings report."""
    from plainlane.sources import lexicon as lexicons

    entry = lambda lemma, pos, status="approved": {"lemma": lemma, "status": status, "part_of_speech": pos, "forms": [lemma], "interpretation_state": "interpreted"}
    more = [entry("run", "verb"), entry("good", "adjective"), entry("connected", "adjective"), entry("opening", "noun"), entry("yard", "noun"), entry("yard", "verb", "unapproved")]
    own = spark.createDataFrame([tuple(e.get(k) for k in lexicons.ENTRY_NAMES) for e in [*lexicons.starter_entries(), *more]], lexicons.ENTRY)
    return lexicons.with_ids(own)


def diagnostics(spark: SparkSession) -> DataFrame:
    """What all rule families report on the corpus, with facts, terms and evidence."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, mode string, text string")
    out = lint.lint(docs, lexicon(spark), glossaries.terms_frame(spark, TERMS), evidence(spark), context(spark))
    return out.where("code <> 'STE-TERM-001'").select("doc_id", "code", "severity", "start", "end")


def sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    texts = ", ".join(f"({i}, {quote(t)})" for i, _, t in TEXTS)
    rows = ", ".join(f"({i}, '{c}', '{s}', {quote(p)}, {n})" for i, c, s, p, n in EXPECTED)
    return f"""WITH t(doc_id, text) AS (VALUES {texts}), e(doc_id, code, severity, part, nth) AS (VALUES {rows})
SELECT CAST(doc_id AS BIGINT) AS doc_id, code, severity, CAST(place AS BIGINT) AS start, CAST(place + length(part) AS BIGINT) AS "end"
FROM (SELECT *, CASE nth WHEN 1 THEN p - 1 ELSE p + length(part) - 2 + strpos(substr(text, p + length(part)), part) END AS place
  FROM (SELECT *, strpos(text, part) AS p FROM e JOIN t USING (doc_id)))"""
