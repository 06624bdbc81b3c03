"""Mentions, antecedents, edges and orderings against brute force."""

import random

import time

import pytest
from pyspark.sql import functions as F

from plainlane.operators import graph, mentions, structure
from plainlane.plans import context, lint
from plainlane.sources import glossary

ENTITY = "doc_id long, id string, canonical string, class string, forms array<string>, source string"


def by_hand(text, surfaces):
    """All occurrences of each surface, searched from the end of the last find, with no letter or digit at either side."""
    out = []
    for s in surfaces:
        at = text.find(s)
        while at >= 0:
            a, b = at, at + len(s)
            if not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                out.append((s, len(text[:a].encode()), len(text[:b].encode())))
            at = text.find(s, b)
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [1 << 20, 4])
def test_occurrences(spark, part_bytes):
    r = random.Random(2)
    alphabet = ["a", "b", " ", "a b", "é", "漢", "-", ".", "a a", "B"]
    surfaces = ["a", "a a", "a b a", "é", "b", "漢 a", "a-b", ".", "a b a b a b a b", "aa", "", None, "a"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(80)] + [None, "", "a" * 5000, "a b " * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, surface int")
    names = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    got = {}
    for row in mentions.occurrences(docs, names, part_bytes=part_bytes).collect():
        got.setdefault(row["doc_id"], []).append((row["surface"], row["start"], row["end"]))
        assert texts[row["doc_id"]][row["cs"] : row["ce"]] == row["surface"]
    want = {i: by_hand(t or "", {s for s in surfaces if s}) for i, t in enumerate(texts)}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert mentions.occurrences(docs, names.where("false")).count() == 0


def test_own_surfaces_and_places(spark):
    text = "The Big Old Red Iron Bridge Company of York met. St. Paul's Dr. No won't go; X-ray A.\n\nYork and Yorkshire."
    docs = spark.createDataFrame([(1, text), (2, "York")], "doc_id long, text string")
    entities = spark.createDataFrame(
        [(1, "c", "Big Old Red Iron Bridge Company of York", "organization", ["York"], "s"), (1, "p", "Paul's", "person", ["won", "met. St"], "s"), (1, "x", "York", "place", None, "t")], ENTITY
    )
    x = lint.inputs(docs, context={"entities": entities})
    got = sorted((r["start"], r["surface"], r["identity"], r["unit"]) for r in mentions.mentions(x).collect())
    # "won" ends within a word, "met. St" goes over a sentence's end, "Yorkshire" is another word, document 2 has no facts
    assert got == sorted([(4, "Big Old Red Iron Bridge Company of York", "c", 0), (39, "York", "c", 0), (39, "York", "x", 0), (53, "Paul's", "p", 2), (text.index("York and"), "York", "c", 4), (text.index("York and"), "York", "x", 4)])


def test_long_names_count_as_one_word(spark):
    """Names of seven words and abbreviations of four: nothing is cut off."""
    text = "See a b c d e f g now. Use q r s t now."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    entities = spark.createDataFrame([(1, "e", "a b c d e f g", "product", [], "s")], ENTITY)
    term = {"id": "q", "canonical": "quite rare single thing", "roles": ["noun"], "status": "approved", "aliases": [{"text": "q r s t", "kind": "abbreviation"}]}
    names = glossary.compiled(glossary.terms_frame(spark, [term]))
    scanned = structure.scanned(docs)
    groups = context.groups(scanned, {"entities": entities}, names).first()["groups"]
    assert {(g["kind"], text[g["cs"] : g["ce"]]) for g in groups} == {("proper_noun", "a b c d e f g"), ("abbreviation", "q r s t")}


def test_official_names(spark):
    docs = spark.createDataFrame([(1, "The  Iron Duke is on. It runs.")], "doc_id long, text string")
    o = spark.createDataFrame([(1, 5, 14, "s", True), (1, 5, 14, "t", True), (1, 6, 14, "s", True), (1, 0, 3, "s", False)], "doc_id long, start long, end long, source string, official_technical_name boolean")
    x = lint.inputs(docs, context={"occurrences": o})
    got = mentions.mentions(x).collect()
    assert [(r["kind"], r["identity"], r["start"], r["idx"], r["last"]) for r in got] == [("official", "iron duke", 5, 1, 2)]
    assert [(r["candidates"], r["state"]) for r in graph.references(x).collect()] == [(["iron duke"], "resolved")]


def test_antecedents(spark):
    r = random.Random(4)
    ms, ps = [], []
    for doc in range(40):
        for unit in range(r.randint(1, 5)):
            places = sorted(r.sample(range(100), 12))
            ms += [(doc, unit, a, a + r.randint(1, 4), r.choice("abc")) for a in places[:: r.choice((2, 3, 13))]]
            ps += [(doc, unit, a, a + 2, "it") for a in places[1::4]]
    m = spark.createDataFrame(ms, "doc_id long, unit int, start long, end long, identity string")
    p = spark.createDataFrame(ps, "doc_id long, unit int, start long, end long, pronoun string")
    want = []
    for doc, unit, a, b, _ in ps:
        own = [x for x in ms if x[:2] == (doc, unit) and x[3] <= a]
        last = [x for x in ms if x[:2] == (doc, unit - 1)]
        use, basis = (own, "same") if own else (last, "previous") if last else ([], None)
        names = {x[4] for x in use}
        least = min(((x[3], x[2], x[4]) for x in use), default=None)
        want.append((doc, unit, a, basis, len(names), None if len(names) != 1 else (least[2], least[1], least[0])))
    got = [(x["doc_id"], x["unit"], x["start"], x["basis"], x["n"], x["antecedent"] and tuple(x["antecedent"])) for x in graph.antecedents(p, m).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_antecedents_of_one_long_text(spark):
    """50,000 mentions and as many pronouns of one unit: each meets a running state, not all others."""
    n = 50_000
    m = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("unit"), (F.col("id") * 4).alias("start"), (F.col("id") * 4 + 1).alias("end"), F.concat(F.lit("e"), F.col("id") % 20_000).alias("identity"))
    p = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("unit"), (F.col("id") * 4 + 2).alias("start"), (F.col("id") * 4 + 3).alias("end"), F.lit("it").alias("pronoun"))
    began = time.time()
    row = graph.antecedents(p, m).agg(F.max("n"), F.sum("n"), F.count("antecedent")).first()
    assert tuple(row) == (20_000, sum(min(i + 1, 20_000) for i in range(n)), 1) and time.time() - began < 60


def test_reference_and_ordering_edges(spark):
    text = "The Zorb is hot. It moves.\n\nThe Zorb and the Blip stop. Look at it."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    entities = spark.createDataFrame([(1, "z", "Zorb", "product", [], "s"), (1, "b", "Blip", "product", [], "s")], ENTITY)
    x = lint.inputs(docs, context={"entities": entities})
    found = mentions.mentions(x).persist()
    refs = graph.reference_edges(graph.pronouns(x.scanned), found).orderBy("start").collect()
    assert [(r["state"], r["entity"]) for r in refs] == [("resolved", 0), ("ambiguous", None)]
    e = graph.edges(x.scanned, mentions=found)
    assert e.where("relation = 'contains' and to_kind = 'entity'").count() == 3 and e.where("relation = 'precedes' and kind = 'entity'").count() == 2
    node = "struct<kind:string,start:bigint,end:bigint>"
    z = text.index("Zorb and")
    facts = [(1, ("entity", 4, 8), ("sentence", 0, 16), "s"), (1, ("entity", z, z + 4), ("entity", 5, 8), "s"), (1, ("topic", 0, 3), ("paragraph", 0, 26), "s")]
    topics = spark.createDataFrame([(1, 0, 3, "t", "s"), (1, 0, 3, "u", "s")], "doc_id long, start long, end long, topic string, source string")
    o = graph.ordering_edges(graph.nodes(x.scanned, topics, found), spark.createDataFrame(facts, f"doc_id long, before {node}, after {node}, source string"))
    got = sorted((r["before"]["kind"], r["before_state"], r["before_id"], r["after_state"], r["after_id"]) for r in o.collect())
    assert got == [("entity", "resolved", 0, "resolved", 0), ("entity", "resolved", 1, "unknown", None), ("topic", "ambiguous", None, "resolved", 0)]


def test_contradictory_orderings(spark):
    r = random.Random(7)
    orders = [(d, r.randrange(12), r.randrange(12)) for d in range(12) for _ in range(r.randint(0, 16))] + [(99, k, k + 1) for k in range(9)] + [(98, 5, 5), (97, None, 1)]
    want = set()
    for d in {x[0] for x in orders}:
        own = {(a, b) for e, a, b in orders if e == d and a is not None}
        reach = set(own)
        while True:
            more = {(a, c) for a, b in reach for b2, c in own if b == b2} - reach
            if not more:
                break
            reach |= more
        want |= {(d, a, b) for a, b in own if (b, a) in reach or a == b}
    orders += [(96, k, (k + 1) % 7) for k in range(7)]
    want |= {(96, k, (k + 1) % 7) for k in range(7)}
    rows = spark.createDataFrame(orders, "doc_id long, a int, b int")
    assert {tuple(x) for x in graph.contradictions(rows).collect()} == want
    assert graph.contradictions(rows.where("false")).count() == 0


def test_linear_sweeps(spark):
    """100,000 matches and fixes in one text; ten times as many take well under thirty times as long."""
    from plainlane import functions as T
    from plainlane.operators import matching
    from plainlane.plans import fixes

    took = []
    for n in (10_000, 100_000):
        docs = spark.createDataFrame([(1, "go to;" * n)], "doc_id long, text string")
        words = docs.select("doc_id", F.lit("x").alias("mode"), F.transform(F.split("text", "[ ;]"), lambda w: F.struct(w.alias("text"))).alias("lexical"))
        began = time.time()
        assert matching.sweep(words, ["go to", "to go"]).select(F.size("kept")).first()[0] == n
        found = spark.range(2 * n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("idx"), F.lit(2).alias("width"))
        assert matching.leftmost(found).count() == n
        marks = docs.select("doc_id", F.explode(T.mark_offsets(F.col("text"), ";")).alias("start"))
        out = fixes.apply_fixes(docs, marks.select("doc_id", "start", (F.col("start") + 1).alias("end"), F.lit(", ").alias("replacement"))).first()
        assert out["text"] == "go to, " * n
        took.append(time.time() - began)
    assert took[1] < 30 * took[0]


def test_sweep_keeps_what_a_fold_keeps(spark):
    from plainlane.operators import arrays

    r = random.Random(1)
    rows = []
    for _ in range(200):
        spans = sorted((r.randrange(40), r.randrange(6)) for _ in range(r.randint(0, 20)))
        rows.append(([a for a, _ in spans], [a + w for a, w in spans]))
    rows += [(None, None), ([], [])]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a array<int>, b array<int>").repartition(3)
    for i, kept, sums in d.select("i", arrays.kept_places(F.col("a"), F.col("b")), arrays.running_sums(F.col("a"))).collect():
        at, want, total = None, [], []
        for k, (a, b) in enumerate(zip(rows[i][0] or [], rows[i][1] or [])):
            total.append(a + (total[-1] if total else 0))
            if at is None or a >= at:
                want.append(k)
                at = b
        assert kept == want and sums == total




def test_walk_contradictions(spark):
    """Against reachability over the same steps, over several ranges, with repeated visits, nulls, one place and no rows."""
    r = random.Random(11)
    visits = [(d, unit, k, k + 1, r.choice("abcdefghijklmnop"[: 4 + d])) for d in range(10) for unit in r.sample(range(40), 6) for k in range(r.randint(0, 3))]
    visits += visits[:7] + [(50, 0, 0, 1, "a"), (51, None, 0, 1, "b"), (51, 3, 0, 1, "a"), (51, 2, 0, 1, "b"), (52, 1, 0, 1, None), (None, 1, 0, 1, "a"), (None, 2, 0, 1, "b"), (None, 3, 0, 1, "a")]
    walks = {}
    for d, unit, start, end, name in visits:
        if d is not None and name is not None:
            walks.setdefault(d, []).append((unit is None, unit or 0, start, end, name))
    want = set()
    for d, walk in walks.items():
        names = [x[-1] for x in sorted(walk)]
        own = {(a, b) for a, b in zip(names, names[1:]) if a != b}
        reach = set(own)
        while more := {(a, c) for a, b in reach for b2, c in own if b == b2} - reach:
            reach |= more
        want |= {(d, a, b) for a, b in own if (b, a) in reach}
    rows = spark.createDataFrame(visits, "doc_id long, unit int, start long, end long, name string")
    steps = spark.createDataFrame([(d, a[-1], b[-1]) for d, walk in walks.items() for a, b in zip(sorted(walk), sorted(walk)[1:]) if a[-1] != b[-1]], "doc_id long, a string, b string")
    assert want and (51, "b", "a") in want
    for width in (1, 8, 1024):
        assert sorted(map(tuple, graph.walk_contradictions(rows, "unit", width).collect())) == sorted(want)
    assert {tuple(x) for x in graph.contradictions(steps.where("doc_id < 5")).collect()} == {x for x in want if x[0] < 5}
    assert graph.walk_contradictions(rows.where("false"), "unit").count() == 0
