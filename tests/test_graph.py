"""Graphs, resolutions, dictionary ETL and streams."""

from pyspark.sql import functions as F

from plainlane import streaming
from plainlane.operators import graph, rules, structure
from plainlane.plans import lint
from plainlane.sources import etl, glossary, lexicon


def test_graph_and_references(spark):
    docs = spark.createDataFrame([(1, "The zorb is hot. It moves.\n\nThe zorb and the blip stop. Look at it.")], "doc_id long, text string")
    terms = glossary.terms_frame(spark, [{"id": t, "canonical": t, "roles": ["noun"], "status": "approved"} for t in ("zorb", "blip")])
    x = lint.inputs(docs, glossary=terms)
    got = graph.references(x).orderBy("start").collect()
    assert [(r.candidates, r.state) for r in got] == [(["zorb"], "resolved"), (["blip", "zorb"], "ambiguous")]
    e = graph.edges(x.scanned)
    assert e.where("relation = 'contains'").count() == 4 and e.where("relation = 'precedes' and kind = 'sentence'").count() == 3
    assert graph.auxiliary_chains(x.scanned).select("words", "head").collect()[0] == (["is"], "hot")
    assert graph.senses(x, lexicon.starter(spark)).where("w = 'look'").first()["state"] == "resolved"


def test_grammar_columns(spark):
    x = lint.inputs(spark.createDataFrame([(1, "It has moved. It was open. It is closing.")], "doc_id long, text string"))
    got = {r.w: (r.participle_use, r.ing_use) for r in graph.grammar_columns(x).collect()}
    assert got["moved"] == (["perfect"], []) and got["closing"] == ([], ["progressive"])


def test_safety_semantics(spark):
    s = structure.scanned(spark.createDataFrame([(1, "WARNING: Stop it.\nCAUTION: Go.")], "doc_id long, text string"))
    span = "struct<start:bigint,end:bigint>"
    f = spark.createDataFrame([(1, 9, 17, "caution", (9, 13), None), (1, 9, 17, "warning", (9, 13), None)], f"doc_id long, start long, end long, safety_level string, command {span}, actor {span}").withColumn("hazard", F.lit(None).cast(span)).withColumn("consequence", F.lit(None).cast(span))
    got = graph.safety_semantics(s, f).orderBy("start").collect()
    assert (got[0].safety_level_state, got[0].command_state, got[0].hazard_state, got[1].safety_level_state) == ("ambiguous", "resolved", "unknown", "unknown")


def test_etl(spark):
    rows = [(1, 0, "USE (v), USES,", "To do with", "a", "b"), (1, 1, "USED, USED", "more", None, None), (2, 0, "using (v)", "USE", "c", "d")]
    e = {r.headword: r for r in etl.entries(spark.createDataFrame(rows, "page int, row_no int, word string, meaning string, good string, bad string")).collect()}
    assert e["USE"].approved and e["USE"].forms == ["USE", "USES", "USED"] and e["USE"].meaning == "To do with more" and not e["using"].approved
    p = etl.pages(spark.createDataFrame([("Head\n1.1 A\nx\fHead\ny\n1.2 B",)], "content string"))
    s = etl.sections(etl.clean_lines(p, "^Head$"), "^[0-9][.][0-9]").orderBy("page", "section").collect()
    assert [(r.section, r.text) for r in s] == [("1.1", "1.1 A\nx\ny"), ("1.2", "1.2 B")]
    assert [r.page for r in etl.missing_pages(p, 1, 3).collect()] == [3]


def test_numbered_over_ranges(spark):
    """Marks are counted over ranges of pages as one window over all rows would count them, and no task gets all rows."""
    import random

    r = random.Random(2)
    rows = [(p, k, r.random() < 0.2) for p in r.sample(range(-40, 400), 150) for k in range(r.randint(0, 6))] + [(None, 0, True), (None, 1, None)]
    got = etl.numbered(spark.createDataFrame(rows, "page int, row_no int, mark boolean").repartition(4), F.col("mark"), "row_no", 7)
    n, want = 0, {}
    for p, k, mark in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        n += bool(mark)
        want[p, k] = n
    assert {(x["page"], x["row_no"]): x["n"] for x in got.collect()} == want
    lines = spark.createDataFrame([(p, k, f"{p} {k}") for p in range(50) for k in range(3)], "page int, line_no int, line string")
    plan = etl.sections(lines, "[05] 0$")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(page" not in plan.lower() and "partitionby" not in plan.lower()
    got = sorted((x["page"], x["last"], x["section"], x["text"]) for x in etl.sections(lines, "[05] 0$", 4).collect())
    want = [[p for p in range(50) if p // 5 == k] for k in range(10)]
    assert got == [(w[0], w[-1], f"{w[0]} 0"[-3:], "\n".join(f"{p} {k}" for p in w for k in range(3))) for w in want]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 30 + "end."), (2, "Short.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = streaming.long_sentences(stream).writeStream.format("memory").queryName("long_ones").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.doc_id for r in spark.table("long_ones").collect()] == [1]


def test_orderings(spark):
    text = "First one. Second one."
    node = "struct<kind:string,start:bigint,end:bigint>"
    facts = [(1, ("sentence", 11, 22), ("sentence", 0, 10)), (1, ("sentence", 0, 10), ("sentence", 11, 22)), (1, ("sentence", 1, 10), ("sentence", 0, 10))]
    ctx = {"orderings": spark.createDataFrame(facts, f"doc_id long, before {node}, after {node}")}
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = lint.lint(docs, context=ctx, families=[rules.discourse]).collect()
    assert [(r.code, r.start, r.end) for r in got] == [("STE-DISC-001", 0, 10)]
