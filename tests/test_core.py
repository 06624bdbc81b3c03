"""The engine's own operators on small inputs: rule boundaries, structure, resolution, contracts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainlane import functions as T
from plainlane import registry
from plainlane.operators import counting, matching, rewrite, rules, structure, units
from plainlane.plans import context, lint
from plainlane.sources import benchmarks, coverage, evidence, glossary, lexicon

REGISTRY = units.registry()


def codes(spark, text, mode="descriptive", families=None, **kw):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return sorted((r.code, r.severity) for r in lint.lint(docs, mode=mode, families=families, **kw).collect() if r.code != "STE-TERM-001")


def test_scan_is_total_and_byte_exact():
    r = random.Random(1)
    alphabet = ["a", "B", " ", "\n", ".", "?", "(", ")", '"', "“", "”", ";", "-", "1", "é", "漢", "😀", "`", "#", ":", "\t", "NOTE:", "WARNING:", "- ", "1. ", " ", "\r\n", "> ", "```\n"]
    for _ in range(1500):
        t = "".join(r.choices(alphabet, k=r.randrange(40)))
        raw = t.encode()
        for name, spans in structure.scan(t, REGISTRY).items():
            for x in spans:
                a, b, cs, ce = next(x[k : k + 4] for k in range(len(x)) if k in {"protected": [0], "headings": [0], "paragraphs": [1], "lists": [2], "items": [3], "notes": [1], "safety": [2], "units": [3], "tokens": [1], "lexical": [1], "runs": [0], "semicolons": [0], "groups": [1]}[name])
                assert raw[a:b].decode() == t[cs:ce], (name, t)


@pytest.mark.parametrize("text,n", [("One. Two? Three!", 3), ("It is 3.5 mm. Go", 2), ('He said "A. B." now. Then', 2), ("See (a. b). Go.", 2), ("Use no. 5 now. Go.", 2), ("e.g. this one. Go.", 2), ("...", 0)])
def test_sentences(text, n):
    assert len(structure.sentences(text, 0, len(text), [])) == n


def test_sentence_limits(spark):
    word = " ".join(["tool"] * 30).split()
    for mode, limit in (("procedural", 20), ("descriptive", 25)):
        code = "STE-LEN-001" if mode == "procedural" else "STE-LEN-002"
        assert codes(spark, " ".join(word[:limit]) + ".", mode, [rules.length]) == []
        assert codes(spark, " ".join(word[: limit + 1]) + ".", mode, [rules.length]) == [(code, "error")]
    assert codes(spark, "NOTE: " + " ".join(word[:26]) + ".", "procedural", [rules.length]) == [("STE-LEN-002", "error")]
    assert codes(spark, " ".join(word[:24]) + " (one two three) 5 mm.", "descriptive", [rules.length]) == [("STE-LEN-002", "error")]
    assert codes(spark, " ".join(word[:23]) + " (one two three) 5 mm.", "descriptive", [rules.length]) == []


def test_paragraph_limit(spark):
    assert codes(spark, "It is hot. " * 6, families=[rules.paragraph]) == []
    assert codes(spark, "It is hot. " * 7, families=[rules.paragraph]) == [("STE-PARA-001", "error")]


def test_rule_families(spark):
    cases = [
        ("Open it; close `a;b` it.", "procedural", rules.punctuation, ["STE-PUNC-001"]),
        ("It's here and we don't know the dog's name.", "descriptive", rules.contractions, ["STE-SYN-001", "STE-SYN-001"]),
        ("Do this:\n\n- Turn the tool.\n- Lift the tool.\n", "procedural", rules.lists, []),
        ("Do this\n\n- turn the tool,\n", "procedural", rules.lists, ["STE-LIST-001", "STE-LIST-002", "STE-LIST-003"]),
        ("NOTE: Remove the cap.", "procedural", rules.notes, ["STE-NOTE-001"]),
        ("NOTE: Open the cap.", "procedural", rules.notes, ["STE-NOTE-002"]),
        ("The tool has closed it.", "descriptive", rules.verb_constructions, ["STE-VERB-001"]),
        ("It was removed.", "descriptive", rules.verb_constructions, ["STE-VERB-003"]),
        ("It is closing.", "descriptive", rules.verb_constructions, ["STE-VERB-005"]),
        ("It was removed.", "procedural", rules.grammar, ["STE-GRAM-003"]),
        ("The new water pump system stays.", "descriptive", rules.grammar, ["STE-NOUN-001"]),
        ("The water pump system stays.", "descriptive", rules.grammar, []),
        ("Turn the tool and lift the cap.", "procedural", rules.procedural, ["STE-PROC-003"]),
        ("If it is hot stop it.", "procedural", rules.procedural, ["STE-PROC-002"]),
        ("The tool turns.", "procedural", rules.procedural, ["STE-PROC-001"]),
        ("Open the door.", "procedural", rules.procedural, ["STE-PROC-004"]),
        ("WARNING: The pressure is hot.", "procedural", rules.procedural, ["STE-SAFE-001"]),
        ("WARNING: If it is hot, stop.", "procedural", rules.procedural, []),
        ("Utilize it and make sure.", "descriptive", rules.lexical, ["STE-LEX-001"]),
    ]
    for text, mode, family, want in cases:
        assert [c for c, _ in codes(spark, text, mode, [family])] == want, text


def test_glossary_rules(spark):
    terms = glossary.terms_frame(spark, [
        {"id": "a", "canonical": "zorb", "roles": ["noun"], "status": "approved"}, {"id": "b", "canonical": "blip", "roles": ["verb"], "status": "approved"},
        {"id": "c", "canonical": "old name", "roles": ["noun"], "status": "deprecated", "replacement": "a"},
        {"id": "d", "canonical": "main engine fuel control unit", "roles": ["noun"], "status": "approved", "aliases": [{"text": "control unit", "kind": "short"}]},
    ])
    assert glossary.integrity(terms).count() == 0
    got = lambda t, f: [c for c, _ in codes(spark, t, "procedural", [f], glossary=terms)]
    assert got("Zorb the cap.", rules.technical_roles) == ["STE-TERM-003"] and got("Look at the blip.", rules.technical_roles) == ["STE-TERM-004"]
    assert got("This is an old name.", rules.lexical) == ["STE-TERM-002"]
    assert got("The control unit is hot. The main engine fuel control unit is hot.", rules.entities) == ["STE-NOUN-002"]
    assert got("The main engine fuel control unit is hot. The control unit is hot.", rules.entities) == []
    with pytest.raises(ValueError):
        glossary.compose(terms, terms)


def test_context_rules(spark):
    text = "The colour of the well-made cap is good. It breaks down (often)."
    at = lambda s: (text.index(s), text.index(s) + len(s))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = "doc_id long, start long, end long, source string, spelling string, hyphen_direct_relation boolean, phrasal_verb boolean, parenthesis_use string"
    facts = [(1, *at("colour"), "s", "british", None, None, None), (1, *at("well-made"), "s", None, False, None, None), (1, *at("breaks down"), "s", None, None, True, None), (1, *at("(often)"), "s", None, None, None, "other"), (1, 5, 900, "s", None, None, None, None)]
    facts = {"occurrences": spark.createDataFrame(facts, names), "topics": spark.createDataFrame([(1, 0, 10, "x", "s"), (1, 12, 20, "y", "s")], "doc_id long, start long, end long, topic string, source string")}
    got = [r.code for r in lint.lint(docs, context=facts, families=[rules.contextual, rules.paragraph]).collect()]
    assert sorted(got) == ["STE-CTX-000", "STE-CTX-003", "STE-PARA-002", "STE-PHRASE-001", "STE-PUNC-002", "STE-PUNC-003"]
    assert [r.problem for r in context.validate(facts, structure.scanned(docs)).collect()].count("occurrences: outside the text") == 1


def test_rewrites(spark):
    rows = [("You must stop.", "You can stop.", "SEM-MODALITY-001"), ("Do not stop.", "Do stop.", "SEM-NEGATION-001"), ("Use 10-12 mm.", "Use 10-13 mm.", "SEM-QUANTITY-001"), ("Stop 1.0 now.", "Now stop 1.0.", ""), (None, None, "")]
    got = rewrite.check_rewrites(spark.createDataFrame(rows, "original string, proposed string, want string")).collect()
    assert all(",".join(r.codes) == r.want and r.accepted == (r.want == "") for r in got)


def test_units_and_groups():
    for good in ("mm", "km", "psi", "kilometers", "degrees Celsius", "N·m", "km/h"):
        assert REGISTRY.is_unit(good), good
    for bad in ("xx", "dog", "mmm"):
        assert not REGISTRY.is_unit(bad), bad
    got = {(k, "5 p.m. no. 7 CB-1 3.5 mm"[a:b]) for k, a, b in REGISTRY.groups("5 p.m. no. 7 CB-1 3.5 mm", [])}
    assert {("abbreviation", "5 p.m."), ("identifier", "no. 7"), ("identifier", "CB-1"), ("number_with_unit", "3.5 mm")} <= got


def test_matching(spark):
    d = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 0, 1)], "doc_id long, idx int, width int")
    assert sorted((r.doc_id, r.idx) for r in matching.leftmost(d).collect()) == [(1, 0), (1, 2), (1, 3), (2, 0)]
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 9, 12), (1, 10, 11)], "doc_id long, start long, end long")
    assert sorted((r.start, r.end) for r in matching.span_union(s).collect()) == [(0, 7), (9, 12)]


def test_lexicon_and_identity(spark, tmp_path):
    e = lexicon.starter(spark)
    a, u = e.where("status = 'approved'").count(), e.where("status = 'unapproved'").count()
    assert lexicon.identity_report(e, a, u).where("not passed").count() == 0
    assert lexicon.identity_report(e, a + 1, u).where("not passed").count() == 1
    p = tmp_path / "lexicon.json"
    p.write_text('{"metadata": {"standard": "x"}, "entries": [{"lemma": "Use", "status": "approved", "part_of_speech": "verb", "forms": ["uses"]}]}')
    import hashlib

    raw = p.read_bytes()
    assert lexicon.verified(spark, str(p), hashlib.sha256(raw).hexdigest(), len(raw)).first()["lemma"] == "Use"
    with pytest.raises(ValueError):
        lexicon.verified(spark, str(p), "0" * 64, len(raw))


def test_coverage_and_contracts(spark):
    t = coverage.rules(spark)
    assert {r.status: r.n_rules for r in coverage.status_counts(t).collect()} == {"implemented": 9, "partial": 33, "context_required": 11}
    assert coverage.problems(t).count() == 0 and coverage.problems(t.union(t.limit(1))).count() == 2
    good = [(1, "s", "f", "p", "t", "manual", "https://x.example", "application/pdf", "2024-02-29", ("a" * 64, 5, 3), None, ("ok",), None)]
    src = spark.createDataFrame(good, benchmarks.SOURCE)
    assert benchmarks.source_problems(src).count() == 0
    assert benchmarks.source_problems(src.withColumn("retrieval_date", F.lit("2023-02-29"))).count() == 1
    suite = spark.createDataFrame([(1, "x", [("a", "s", "c", None, 1, 9, "procedural"), ("a", "zz", "c", None, 2, 1, "other")])], benchmarks.SUITE)
    assert {r.problem for r in benchmarks.suite_problems(suite, src).collect()} == {"page range", "repeated selection", "unknown source", "page order", "mode"}


def test_evidence(spark):
    import hashlib

    text = "Die Tür is closing."
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    sha, n = hashlib.sha256(text.encode()).hexdigest(), len(text.encode())
    ok = [("pos", 12, 19, "closing", "VERB", None, None, 0.9, None), ("clause", 0, n, None, "condition", None, None, 0.9, ["instruction"])]
    rows = [("evidence-bundle/v1", 1, sha, n, ("p", "1", "0" * 64), ok), ("evidence-bundle/v1", 2, sha, n + 1, ("p", "1", "0" * 64), [("pos", 5, 6, None, "NOUN", None, None, 2.0, None)])]
    b = spark.createDataFrame(rows, evidence.BUNDLE)
    assert {(r.doc_id, r.problem) for r in evidence.bundle_problems(b, docs).collect()} == {(2, "length"), (2, "confidence"), (2, "span")}
    got = evidence.imported(b, docs)
    assert got.count() == 2 and evidence.linguistic(got).first()["pos"] == "verb"
    c = evidence.clause_kinds(got).first()
    assert c["candidates"] == ["instruction", "condition"] and c["state"] == "ambiguous"


def test_column_functions(spark):
    d = spark.createDataFrame([("é;b;;c",), ("none",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(T.mark_offsets(F.col("t"), ";")).collect()] == [[2, 4, 5], [], [], None]
    w = spark.createDataFrame([("(See 5 a.m. CB-1!) don't x_y 'ok'",)], "t string")
    assert [x.word for x in w.select(T.lexical_words(F.col("t"))).first()[0]] == ["See", "5", "a.m", "CB-1", "x_y", "ok"]


def test_registry_is_consistent():
    q, o = registry.queries(), registry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 20


def test_counting_prefers_outer_groups(spark):
    d = structure.scanned(spark.createDataFrame([(1, 'Read "the long title here" and stop (now or later).')], "doc_id long, text string"))
    r = {x.kind: x.words for x in counting.counted_units(d).collect()}
    assert r["prose"] == 5 and r["parenthetical"] == 3


def test_scanned_words_come_as_arrays():
    """Words and lexical tokens leave the scan as arrays and bytes, not as one Python object a word; they say what plain code finds."""
    import re

    text = "Don’t x-y “it's” ½a  C:\\x/y (é), a_b;\u3000𝒳 5. no-\n`co de` z' end."
    out = structure._scan(text, REGISTRY, ("tokens", "lexical"))
    assert all(isinstance(c, (np.ndarray, structure.Strings)) for f in ("tokens", "lexical") for c in out[f])
    found = structure.scan(text, REGISTRY, ("tokens", "lexical"))
    want = [m.span() for m in re.finditer(r"[^\W_]+(?:['’][^\W_]+)*", text) if not text.index("`co") < m.start() < text.index("` z")]
    assert [t[3:5] for t in found["tokens"]] == want and [t[5] for t in found["tokens"]] == [text[a:b] for a, b in want]
    gaps = ["", *(g if g in ("", "-") else " " if g.isspace() else "x" for g in (text[b:a] for (_, b), (a, _) in zip(want, want[1:])))]
    assert [t[7] for t in found["tokens"]] == gaps
    assert [t[1:3] for t in found["tokens"]] == [tuple(len(text[:k].encode()) for k in w) for w in want]
    assert [(t[5], t[6]) for t in found["lexical"]] == [("x-y", True), ("C:\\x/y", True), ("é", False), ("a_b", True), ("𝒳", False), ("5", True), ("no-", True), ("co", False), ("de", False), ("z", False), ("end", False)]
