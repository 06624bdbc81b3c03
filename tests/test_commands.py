"""Fixes, files, profiles, lookup, grammar resolutions, evaluation measures and the fixture corpus."""

import json
import random

import pytest
from pyspark.sql import functions as F

import plainlane
import rule_fixtures as fixtures
from plainlane.operators import grammar, matching, rules, structure, units
from plainlane.plans import fixes, lint, reports
from plainlane.sources import etl, glossary, lexicon, profiles, texts


def test_fixture_corpus(spark):
    want = set()
    for doc, code, severity, part, nth in fixtures.EXPECTED:
        text, at = next(t for i, _, t in fixtures.TEXTS if i == doc), -1
        for _ in range(nth):
            at = text.index(part, at + 1)
        want.add((doc, code, severity, at, at + len(part)))
    assert {tuple(r) for r in fixtures.diagnostics(spark).collect()} == want


def test_fixes(spark):
    docs = spark.createDataFrame([(1, "Größe: a; b; c"), (2, "clean"), (3, None)], "doc_id long, text string")
    rows = [(1, 10, 11, "."), (1, 13, 14, "."), (1, 10, 14, "X"), (1, 0, 0, ">")]
    f = spark.createDataFrame(rows, "doc_id long, start long, end long, replacement string")
    out = {r.doc_id: (r.text, r.fixed) for r in fixes.apply_fixes(docs, f).collect()}
    assert out == {1: (">Größe: a. b. c", True), 2: ("clean", False), 3: (None, False)}
    assert [r.replacement for r in fixes.overlaps(f).collect()] == ["X"]
    d = spark.createDataFrame([(1, "Stop; go"), (2, "Stop."), (3, "It's; on")], "doc_id long, text string")
    f = spark.createDataFrame([(1, 4, 5, ","), (3, 4, 5, ",")], "doc_id long, start long, end long, replacement string")
    got = fixes.lint_fixed(d, f, lambda x: lint.lint(x, families=[rules.punctuation, rules.contractions]))[2]
    assert {r.doc_id: r.outcome for r in got.collect()} == {1: "fixed", 2: "clean", 3: "error"}


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Stop; go; on.")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff\xfe")
    docs = texts.read_texts(spark, str(tmp_path / "in"), "*.txt")
    assert sorted((r.path[-5:], r.text, r.valid) for r in docs.collect()) == [("a.txt", "Stop; go; on.", True), ("b.txt", None, False)]
    diags = lint.lint(docs, families=[rules.punctuation])
    assert [r.line for r in texts.human_lines(diags).orderBy("nth").collect()] == ["STE-PUNC-001 4:5 Do not use a semicolon.", "STE-PUNC-001 8:9 Do not use a semicolon."]
    texts.write_json(diags, docs, str(tmp_path / "out"))
    found = {len(x["diagnostics"]): x for x in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())}
    assert set(found) == {0, 2} and found[2]["diagnostics"][1]["span"] == {"start": 8, "end": 9}
    assert plainlane.exit_code(diags) == 1


def test_profiles(spark, tmp_path):
    (tmp_path / "p" / ".plainlane").mkdir(parents=True)
    (tmp_path / "p" / "docs").mkdir()
    (tmp_path / "p" / ".plainlane" / "config.json").write_text('{"profiles": ["git"]}')
    (tmp_path / "p" / "docs" / "x.md").write_text("x")
    assert profiles.project_file(str(tmp_path / "p" / "docs" / "x.md"), profiles.CONFIG) == str(tmp_path / "p" / ".plainlane" / "config.json")
    got = profiles.effective_glossary(spark, str(tmp_path / "p" / "docs" / "x.md"))
    assert got.profiles == ["git"] and {r.canonical for r in got.report().collect()} == {"commit", "branch", "rebase"}
    assert [r.id for r in profiles.listed(spark).collect()] == ["software-core", "git", "github"]
    for bad in ('{"profiles": [], "more": 1}', '{"profiles": ["git", "git"]}'):
        with pytest.raises(ValueError):
            profiles.parse_config(bad)
    with pytest.raises(ValueError):
        profiles.shown(spark, "none")
    with pytest.raises(ValueError):
        profiles.choose_lexicon(spark)
    paths = spark.createDataFrame([("/a/b/c/x.md",), ("/z/y.md",)], "path string")
    files = spark.createDataFrame([("/a", "one"), ("/a/b", "two")], "folder string, file string")
    assert {r.path: r.file for r in profiles.nearest(paths, files).collect()} == {"/a/b/c/x.md": "two", "/z/y.md": None}


def test_lookup(spark):
    e = lexicon.starter(spark)
    got = {(r.word, r.lemma, r.pos) for r in lexicon.lookup(spark.createDataFrame([("Used",), ("MAKE  sure",), ("none",), ("open",)], "word string"), e).collect()}
    assert got == {("Used", "use", "verb"), ("MAKE  sure", "make sure", "verb"), ("open", "open", "verb"), ("open", "open", "adjective")}


def test_grammar_resolutions(spark):
    docs = spark.createDataFrame([(1, "The water pump removes the cap. It is hot. The tool stops."), (2, "Lift the cap and clean the tool. The tool turns.")], "doc_id long, text string")
    entries = fixtures.lexicon(spark)
    x = lint.inputs(docs, entries, mode="procedural")
    by = {(r.doc_id, r.unit): r for r in grammar.subject_predicates(x).collect()}
    assert by[1, 1].state == "unknown" and by[1, 0].state in ("resolved", "ambiguous") and by[2, 1].state == "resolved"
    phrases = {(r.doc_id, r.start): (len(r.candidates), r.state) for r in grammar.noun_phrases(x).collect()}
    assert phrases[1, 27 - 4] == (1, "resolved") and phrases[2, 5] == (1, "resolved")
    acts = {(r.doc_id, r.unit): ([h.w for h in r.heads], r.cardinality) for r in grammar.action_structures(x).collect()}
    assert acts == {(2, 0): (["lift", "clean"], "multiple")}


def test_measures(spark):
    e = spark.createDataFrame([(1, "It", "pump"), (1, "they", "caps")], "case long, mention string, antecedent string")
    o = spark.createDataFrame([(1, "it", "The Pump"), (1, "they", None)], "case long, mention string, representative string")
    assert tuple(reports.coreference(e, o).first()) == (1, 2, 0.5)
    a = spark.createDataFrame([(1, 0, 2, "noun"), (1, 3, 4, "verb"), (1, 5, 6, None)], "case long, start int, end int, pos string")
    b = spark.createDataFrame([(1, 0, 2, "noun"), (1, 3, 4, "noun")], "case long, start int, end int, pos string")
    assert tuple(reports.token_parity(a, b, "pos").first()) == (1, 2, 0.5)
    t = spark.createDataFrame([(1, "(S (NP the cap) (VP is (ADJP hot)))"), (2, None), (3, ")(")], "case long, tree string")
    assert [(r.label, r.text) for r in reports.constituents(t).orderBy("ordinal").collect()] == [("NP", "the cap"), ("ADJP", "hot"), ("VP", "is hot"), ("S", "the cap is hot")]


def test_compiled_entries(spark):
    rows = [(1, 0, "USE (v), USES,", "To do with", "a", "b"), (1, 1, "USED, USED", "more", None, None), (2, 0, "using (v)", "USE", "c", "d")]
    e = etl.entries(spark.createDataFrame(rows, "page int, row_no int, word string, meaning string, good string, bad string"))
    c = {r.lemma: r for r in etl.compiled_entries(e).collect()}
    assert c["USE"].status == "approved" and c["using"].status == "unapproved" and c["using"].verb_paradigm is None
    assert etl.authority_problems(e, {"entries": 2, "approved": 1, "unapproved": 1}).count() == 0
    assert [r.check for r in etl.authority_problems(e, {"entries": 2, "approved": 2, "unapproved": 1}).collect()] == ["approved"]


def test_gaps_and_look_around_have_no_limit(spark):
    far = "It has" + " " * 70 + "; removed. See e.g." + " " * 90 + "this one. " + "x" * 60 + "no. 5 is it."
    got = lint.lint(spark.createDataFrame([(1, far)], "doc_id long, text string"), families=[rules.verb_constructions]).count()
    assert got == 0
    assert len(structure.sentences("See e.g." + " " * 90 + "this one.", 0, 107, [])) == 1
    d = spark.createDataFrame([(1, "It has" + " " * 70 + "removed it.")], "doc_id long, text string")
    assert lint.lint(d, families=[rules.verb_constructions]).count() == 1


def test_scan_is_linear():
    import time

    registry = units.registry()
    for make in (lambda k: "Do:\n\n" + "- item one\n\npara:\n\n" * k, lambda k: "a `b` c. " * k, lambda k: "NOTE: a b.\n x y.\n\ntext one.\n\n" * k, lambda k: "“" * (10 * k) + "...." * k):
        took = []
        for k in (1500, 6000):
            began = time.process_time()
            structure.scan(make(k), registry)
            took.append(time.process_time() - began)
        assert took[1] < 9 * took[0] + 0.3
    deep = "(" * 3000 + "a b" + ")" * 3000
    assert len(structure.scan(deep[2000:-2000], registry)["units"]) == 1001


def test_html_and_definitions_are_no_prose():
    d = structure.blocks_of("<div>\nx; y\n</div>\n\nText one.\n\n<!-- a;\n\nb -->\n[ref]: http://x\n\nText two <b>bold</b>.")
    assert [d.text[a:b] for a, b in d.paragraphs] == ["Text one.", "Text two <b>bold</b>."]
    assert structure.Spans(d.protected).touches(6, 7)


def test_sweep_agrees_with_joins(spark):
    r = random.Random(3)
    words = ["make", "sure", "use", "fuel", "pump", "valve", "x"]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(60)], "doc_id long, text string")
    terms = glossary.terms_frame(spark, [{"id": "p", "canonical": "fuel pump", "roles": ["noun"], "status": "approved"}, {"id": "q", "canonical": "fuel pump valve", "roles": ["noun"], "status": "approved"}, {"id": "r", "canonical": "pump valve use", "roles": ["noun"], "status": "approved"}])
    x = lint.inputs(docs, glossary=terms)
    rows = lambda: sorted(map(tuple, rules.lexical_rows(x).select("doc_id", "start", "end", "phrase").collect()))
    swept, most = rows(), matching.MOST_PHRASES
    matching.MOST_PHRASES = 0
    try:
        joined = rows()
    finally:
        matching.MOST_PHRASES = most
    assert swept == joined and any(" " in p for *_, p in swept)
    assert F is not None


def test_run_status(spark, tmp_path, monkeypatch):
    from plainlane import run_status

    monkeypatch.delenv(profiles.LEXICON_VARIABLE, raising=False)
    run = lambda text, **k: run_status(lambda: lint.lint(spark.createDataFrame([(1, text)], "doc_id long, text string"), lexicon=profiles.choose_lexicon(spark, **k), families=[rules.punctuation]))
    assert run("Stop it.", allow_starter=True) == (0, "") and run("Stop; go.", allow_starter=True) == (1, "")
    code, message = run("Stop it.")
    assert code == 3 and "lexicon" in message
    (tmp_path / "x.json").write_text("{}")
    assert run("Stop it.", path=str(tmp_path / "x.json"), sha256="0" * 64, size=2)[0] == 3
    assert run_status(lambda: spark.read.parquet(str(tmp_path / "nothing")))[0] == 4
