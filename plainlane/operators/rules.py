"""Rule families: each turns scanned documents, dimension tables and facts into diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import checks, diagnose, diagnose_one, diagnostics
from . import counting, matching

# Closed word classes and word lists of the rules.
HAVE = ["have", "has", "had"]
BE = ["be", "am", "is", "are", "was", "were", "been", "being"]
DETERMINERS = ["a", "an", "the", "this", "that", "these", "those", "each", "every", "all"]
OPENERS = ["after", "before", "if", "when", "while"]
OWN_S = ["it", "he", "she", "that", "there", "here", "what", "who", "where", "when", "why", "how", "let"]


@dataclass
class Inputs:
    """What rules read. forms and ings come from a lexicon, identities from a glossary; facts may be missing."""

    scanned: DataFrame
    forms: DataFrame
    ings: DataFrame
    identities: DataFrame | None = None
    evidence: DataFrame | None = None  # doc_id, start, end, lemma, pos
    occurrences: DataFrame | None = None
    topics: DataFrame | None = None
    orderings: DataFrame | None = None
    safety_facts: DataFrame | None = None
    groups: DataFrame | None = None
    widths: int = 4
    entities: DataFrame | None = None
    codes: frozenset[str] | None = None  # those that are asked for; None for all

    def asks(self, start: str) -> bool:
        """Whether a code that starts so is asked for."""
        return self.codes is None or any(c.startswith(start) for c in self.codes)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _tests(x: Inputs, tests: list[tuple]) -> list[tuple]:
    """The tests (condition, code, ...) of codes that are asked for."""
    return [t for t in tests if x.asks(t[1])]


def _known(x: Inputs, around: tuple[str, ...] = matching.AROUND) -> DataFrame:
    """Words with all that their form's candidates say."""
    return _with_forms(x, matching.word_rows(x.scanned, around=around))


def _with_forms(x: Inputs, rows: DataFrame) -> DataFrame:
    return rows.join(matching.small(x.forms.where("width = 1").withColumnRenamed("form", "w").drop("width")), "w", "left")


def punctuation(x: Inputs) -> DataFrame:
    rows = x.scanned.select("doc_id", F.explode("semicolons").alias("s")).select("doc_id", "s.start", "s.end")
    return diagnostics(rows, "punctuation", "STE-PUNC-001", "error", "Do not use a semicolon.")


def contraction(text: Column) -> Column:
    """Whether a run of letters and apostrophes is a contraction."""
    t = F.lower(F.regexp_replace(text, "’", "'"))
    return t.rlike("[\\p{IsAlphabetic}](n't|'re|'ve|'ll|'d|'m)$") | t.rlike("^(" + "|".join(OWN_S) + ")'s$")


def contractions(x: Inputs) -> DataFrame:
    rows = x.scanned.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*").where(contraction(F.col("text")))
    return diagnostics(rows, "contractions", "STE-SYN-001", "error", "Write all words in full.", F.to_json(F.struct("text")))


def length(x: Inputs) -> DataFrame:
    rows = counting.counted_units(x.scanned, x.groups).where(F.col("words") > F.col("limit"))
    code = F.when((F.col("kind") != "note") & (F.col("mode") == "procedural"), "STE-LEN-001").otherwise("STE-LEN-002")
    return diagnostics(rows, "length", code, "error", "The sentence is too long.", F.to_json(F.struct("words", "limit")))


def _item_syntax(items: DataFrame, x: Inputs) -> DataFrame:
    """items (doc_id, start, end, text, own) that have words: whether they are, or may be, sentences. Inside each row while the
    lexicon's verbs are few enough to stand in the plan, else by a join."""
    one = x.forms.where("width = 1")
    auxiliary = [*BE, *HAVE, "do", "does", "did", "can", "must", "will"]
    verbs, openers = matching.phrase_set(one.where("verbs > 0"), "form"), matching.phrase_set(one.where("base_verbs > 0 and nominals = 0"), "form")
    if verbs is not None and openers is not None:
        sure = lambda w, i: w.isin(auxiliary) | ((i == 0) & w.isin(openers))
        sentence = F.exists("own", lambda w: w.isin(auxiliary)) | F.get("own", F.lit(0)).isin(openers)
        maybe = F.exists(F.transform("own", lambda w, i: w.isin(verbs) & ~sure(w, i)), lambda t: t)
        return items.where(F.size("own") > 0).select("doc_id", "start", "end", "text", sentence.alias("sentence"), maybe.alias("maybe"))
    words = items.select("doc_id", "start", "end", "text", F.posexplode("own").alias("at", "w")).join(matching.small(one.select(F.col("form").alias("w"), "base_verbs", "verbs", "other_approved", "nominals")), "w", "left")
    sure = F.col("w").isin(auxiliary) | ((F.col("at") == 0) & (F.col("base_verbs") > 0) & (F.col("nominals") == 0))
    maybe = (F.col("verbs") > 0) & ~sure
    return words.groupBy("doc_id", "start", "end", "text").agg(F.bool_or(F.coalesce(sure, F.lit(False))).alias("sentence"), F.bool_or(F.coalesce(maybe, F.lit(False))).alias("maybe"))


def lists(x: Inputs) -> DataFrame:
    out = []
    if x.asks("STE-LIST-001"):
        heads = x.scanned.select("doc_id", F.explode("lists").alias("l")).select("doc_id", "l.*").where("depth = 0 and not introduced")
        out.append(diagnostics(heads, "lists", "STE-LIST-001", "error", "Introduce the list with a colon."))
    # white space at the end, which most items do not have: their last character tells
    blanks = [" ", "\t", "\n", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029"]
    stripped = lambda item: F.when(F.substring(f"{item}.text", -1, 1).isin(blanks), F.regexp_replace(f"{item}.text", "\\s+$", "")).otherwise(F.col(f"{item}.text")).alias("text")
    if x.asks("STE-LIST-002") or x.asks("STE-LIST-003"):
        items = x.scanned.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.start", "i.end", stripped("i"))
        first = F.regexp_extract("text", "\\p{IsAlphabetic}", 0)
        # one pass for each: an array of both hits of every item costs more than to read the items twice
        out += [diagnose(items, "lists", [t]) for t in _tests(x, [
            ((first != "") & (F.lower(first) == first) & (F.upper(first) != first), "STE-LIST-002", "error", "Start the item with a capital letter."),
            (F.col("text").rlike("[,;]$"), "STE-LIST-003", "error", "Do not end the item with a comma or semicolon."),
        ])]
    if x.asks("STE-LIST-004"):
        zipped = x.scanned.select("doc_id", F.explode(F.arrays_zip("items", "item_words")).alias("z"))
        syntax = _item_syntax(zipped.select("doc_id", "z.items.start", "z.items.end", stripped("z.items"), F.col("z.item_words.words").alias("own")), x)
        period = F.col("text").endswith(".")
        out.append(diagnose(syntax.where(~F.col("text").rlike("[,;]$")), "lists", [
            (F.col("sentence") & ~period | (~F.col("sentence") & ~F.col("maybe") & period), "STE-LIST-004", "error", "End sentences, and only them, with a period."),
            (~F.col("sentence") & F.col("maybe"), "STE-LIST-004", "blocked", "It is not clear whether the item is a sentence."),
        ]))
    return _union(out) if out else _none(x)


def _opening(rows: DataFrame, x: Inputs, most: int = 8) -> DataFrame:
    """rows (doc_id, start, end, words array) with the candidates of their longest known opening phrase of up to most words: one
    join for each number of words that forms have, and no shuffle while the forms are few."""
    known = ["base_verbs", "other_approved", "n_unapproved", "n_approved"]
    joined = rows.select("doc_id", "start", "end", "words")
    widths = range(1, max(min(most, x.widths), 1) + 1)
    for k in widths:
        forms = x.forms.where(F.col("width") == k).select(F.col("form").alias(f"_f{k}"), F.struct("form", *known).alias(f"_m{k}"))
        opening = F.when(F.size("words") >= k, F.array_join(F.slice("words", 1, k), " "))
        joined = joined.withColumn(f"_f{k}", opening).join(matching.small(forms), f"_f{k}", "left")
    none = F.struct(F.coalesce(F.get("words", F.lit(0)), F.lit("")).alias("form"), *(F.lit(None).cast("long").alias(c) for c in known))
    m = F.coalesce(*(F.col(f"_m{k}") for k in reversed(widths)), none)
    return joined.select("doc_id", "start", "end", "words", m.alias("m")).select("doc_id", "start", "end", "words", "m.*")


def _unit_words(x: Inputs, kinds: list[str]) -> DataFrame:
    """Units of procedural documents with their words."""
    rows = x.scanned.where("mode = 'procedural'")
    u = rows.select("doc_id", F.explode(F.arrays_zip("units", "unit_words")).alias("z")).where(F.col("z.units.kind").isin(*kinds))
    return u.select("doc_id", "z.units.start", "z.units.end", "z.units.text", F.col("z.unit_words.words").alias("words")).where(F.size("words") > 0)


def notes(x: Inputs) -> DataFrame:
    rows = _opening(_unit_words(x, ["note"]), x).where("base_verbs > 0")
    sure = F.col("other_approved") == 0
    return diagnose(rows, "notes", _tests(x, [
        (sure, "STE-NOTE-001", "error", "Do not give instructions in a note."),
        (~sure, "STE-NOTE-002", "blocked", "The note may give an instruction."),
    ]), F.to_json(F.struct("form")))


def paragraph(x: Inputs) -> DataFrame:
    rows = x.scanned.where("mode = 'descriptive'").select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")
    out = [diagnostics(rows.where("sentences > 6"), "paragraph", "STE-PARA-001", "error", "Write no more than six sentences in a paragraph.", F.to_json(F.struct("sentences")))]
    if x.topics is not None:
        t = x.topics.select("doc_id", F.col("start").alias("ts"), F.col("end").alias("te"), F.trim("topic").alias("topic"))
        inside = rows.join(t, (rows["doc_id"] == t["doc_id"]) & (t["ts"] >= rows["start"]) & (t["te"] <= rows["end"])).drop(t["doc_id"])
        many = inside.groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_set("topic")).alias("topics")).where(F.size("topics") > 1)
        lost = t.join(rows.select(F.col("doc_id").alias("d"), "start", "end"), (F.col("d") == F.col("doc_id")) & (F.col("ts") >= F.col("start")) & (F.col("te") <= F.col("end")), "left_anti")
        out += [
            diagnostics(many, "paragraph", "STE-PARA-002", "error", "Write about one topic in a paragraph.", F.to_json(F.struct("topics"))),
            diagnostics(lost, "paragraph", "STE-CTX-000", "blocked", "The topic lies in no paragraph.", start="ts", end="te"),
        ]
    return _union(out)


def words(x: Inputs, after_auxiliary: bool = False) -> DataFrame:
    """Every word (or only those after a form of have or be, which is all that tests of verbs and voice look at) with its
    candidates, its verb if it is a progressive form, and whether glossary terms of one word are nouns or verbs: what all families
    of single words read, in one pass."""
    ings = x.ings.select(F.col("form").alias("w"), F.col("base"), F.col("n_approved").alias("ing_ok"))
    around = ("w", "p1", "n1", "p_start", "first")
    if after_auxiliary:
        k = _with_forms(x, matching.chosen_rows(x.scanned, [*HAVE, *BE], 1, around).where("gap = ' '"))
    else:
        k = _known(x, around)
    k = k.join(matching.small(ings), "w", "left")
    if x.identities is None:
        return k.withColumn("noun", F.lit(False)).withColumn("verb", F.lit(False))
    terms = x.identities.where("width = 1 and coalesce(status, 'approved') <> 'deprecated'").groupBy(F.col("identity").alias("w"))
    return k.join(matching.small(terms.agg(F.bool_or(F.array_contains("roles", "noun")).alias("noun"), F.bool_or(F.array_contains("roles", "verb")).alias("verb"))), "w", "left")


def _after_auxiliary() -> tuple[Column, Column]:
    """Whether white space alone parts the word from a form of have, or of be, before it."""
    return F.col("p1").isin(*HAVE) & (F.col("gap") == " "), F.col("p1").isin(*BE) & (F.col("gap") == " ")


def verb_tests(x: Inputs) -> list[tuple]:
    have, be = _after_auxiliary()
    clear = (F.col("other_approved") == 0) & (F.col("n_unapproved") == 0)
    participle, adjective, other = F.col("participles") > 0, F.col("adjectives") > 0, F.coalesce(F.col("nominals"), F.lit(0)) > 0
    ing = be & (F.col("ing_ok") > 0)
    ev = F.to_json(F.struct(F.col("p1").alias("auxiliary"), F.col("w").alias("form")))
    tests = [
        (have & participle & clear, "STE-VERB-001", "error", "Do not use perfect tenses."),
        (have & participle & ~clear, "STE-VERB-002", "blocked", "The tense may be a perfect one."),
        (be & participle & ~adjective, "STE-VERB-003", "error", "Do not use the passive voice."),
        (be & participle & adjective, "STE-VERB-004", "blocked", "The participle may be an adjective."),
        (ing & ~other, "STE-VERB-005", "error", "Do not use progressive tenses."),
        (ing & other, "STE-VERB-006", "blocked", "The form may be a noun or adjective."),
    ]
    return [("verb_constructions", *t, ev, "p_start") for t in tests]


def voice_tests(x: Inputs) -> list[tuple]:
    _, be = _after_auxiliary()
    none = F.lit(None).cast("string")
    passive = (F.col("mode") == "procedural") & be & (F.col("participles") > 0) & (F.col("adjectives") == 0)
    return [
        ("grammar", be & F.col("base").isNotNull() & (F.coalesce(F.col("nominals"), F.lit(0)) == 0), "STE-GRAM-002", "error", "Do not use progressive tenses.", none, "p_start"),
        ("grammar", passive, "STE-GRAM-003", "error", "Use the active voice in procedures.", none, "p_start"),
    ]


def role_tests(x: Inputs) -> list[tuple]:
    nominal = F.coalesce(F.col("p1").isin(*DETERMINERS) & ~F.col("first"), F.lit(False))
    verbal = (F.col("mode") == "procedural") & F.col("first") & F.coalesce(F.col("n1").isin(*DETERMINERS), F.lit(False)) & ~nominal
    ev = F.to_json(F.struct("w"))
    return [
        ("technical_roles", F.col("noun") & ~F.col("verb") & verbal, "STE-TERM-003", "error", "Do not use a technical noun as a verb.", ev, "start"),
        ("technical_roles", F.col("verb") & ~F.col("noun") & nominal, "STE-TERM-004", "error", "Do not use a technical verb as a noun.", ev, "start"),
    ]


def verb_constructions(x: Inputs) -> DataFrame:
    out = [checks(words(x, True), verb_tests(x))]
    return _union(out + free_ings(x))


def free_ings(x: Inputs) -> list[DataFrame]:
    """-ing forms that evidence calls verbs, without an auxiliary before them."""
    if x.evidence is None:
        return []
    e = x.evidence.where("pos = 'verb'").select("doc_id", "start", "end").distinct()
    free = matching.word_rows(x.scanned).where(F.col("w").endswith("ing") & ~F.coalesce(F.col("p1").isin(*BE), F.lit(False))).join(e, ["doc_id", "start", "end"])
    return [diagnostics(free, "verb_constructions", "STE-VERB-007", "error", "Use the -ing form only as a noun or modifier.", F.to_json(F.struct("w")))]


def nominal_runs(x: Inputs) -> DataFrame:
    """(doc_id, start, end, n): runs of words that can only be nouns or noun modifiers, after a determiner; words joined by
    hyphens count once. Gaps and islands over the marked words."""
    nominal = matching.phrase_set(x.forms.where("width = 1 and nominals > 0 and verbs = 0"), "form")
    terms = [] if x.identities is None else matching.phrase_set(x.identities.where("width = 1 and array_contains(roles, 'noun')"), "identity")
    # no other words can be nominal: while they stand in the plan, only they get their neighbours and their forms
    few = nominal is not None and terms is not None
    rows = matching.chosen_rows(x.scanned, sorted({*nominal, *terms}), 0, ("w", "p1")) if few else matching.word_rows(x.scanned, around=("w", "p1"))
    k = _with_forms(x, rows).withColumn("nominal", (F.col("nominals") > 0) & (F.col("verbs") == 0) & ~F.col("w").isin(*DETERMINERS))
    if x.identities is not None:
        nouns = x.identities.where("width = 1 and array_contains(roles, 'noun')").select(F.col("identity").alias("w"), F.lit(True).alias("term")).distinct()
        k = k.join(matching.small(nouns), "w", "left").withColumn("nominal", F.coalesce(F.col("nominal"), F.lit(False)) | F.col("term").isNotNull())
    k = k.where("nominal")
    w = Window.partitionBy("doc_id").orderBy("idx")
    joined = F.coalesce((F.col("idx") == F.lag("idx").over(w) + 1) & F.col("gap").rlike("^(\\s+|-)$") & (F.col("unit") == F.lag("unit").over(w)), F.lit(False))
    k = k.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = k.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.when((F.col("new") == 0) & (F.col("gap") == "-"), 0).otherwise(1)).alias("n"), F.min_by("p1", "idx").alias("before"))
    return runs.where(F.col("before").isin(*DETERMINERS)).select("doc_id", "start", "end", "n")


def grammar(x: Inputs) -> DataFrame:
    return _union([long_nouns(x), checks(words(x, True), voice_tests(x))])


def long_nouns(x: Inputs) -> DataFrame:
    return diagnostics(nominal_runs(x).where("n > 3"), "grammar", "STE-NOUN-001", "error", "Use no more than three words in a noun.", F.to_json(F.struct("n")))


def mentions(x: Inputs) -> DataFrame:
    """(doc_id, idx, width, start, end, phrase, term_id, kind, ...): glossary names, longest and leftmost."""
    found = matching.phrases(x.scanned, x.widths, "tokens", spaced=True).join(x.identities.drop("width").withColumnRenamed("identity", "phrase"), "phrase")
    return matching.leftmost(matching.longest(found))


def entities(x: Inputs) -> DataFrame:
    if x.identities is None:
        return _none(x)
    m = mentions(x).where(F.size(F.split(F.trim("canonical"), "\\s+")) > 3)
    full = F.col("kind").isin("canonical", "form")
    first = F.min(F.when(full, F.col("start"))).over(Window.partitionBy("doc_id", "term_id"))
    early = m.withColumn("full_at", first).where(~full & (F.col("full_at").isNull() | (F.col("start") < F.col("full_at"))))
    loose = m.where(~full & ((F.col("width") > 3) | F.coalesce(~F.col("alias_kind").isin("short", "abbreviation", "acronym"), F.lit(True))))
    rows = early.select("doc_id", "start", "end", "phrase").union(loose.select("doc_id", "start", "end", "phrase")).distinct()
    return diagnostics(rows, "entities", "STE-NOUN-002", "error", "Write the full noun first.", F.to_json(F.struct("phrase")))


def discourse(x: Inputs) -> DataFrame:
    """Facts that one place must come before another, against where both are. Facts that match no node are left alone."""
    if x.orderings is None:
        return _none(x)
    from .graph import nodes

    flat = nodes(x.scanned.where("mode = 'descriptive'")).select("doc_id", "kind", "start", "end").distinct()
    o = x.orderings.select("doc_id", "before", "after")
    for side in ("before", "after"):
        n = flat.select("doc_id", F.struct("kind", "start", "end").alias(side))
        o = o.join(n, ["doc_id", side], "left_semi")
    rows = o.where("after.end <= before.start").select("doc_id", "after.start", "after.end", "before")
    return diagnostics(rows, "discourse", "STE-DISC-001", "error", "Give information in the right order.", F.to_json(F.struct("before")))


def technical_roles(x: Inputs) -> DataFrame:
    return _none(x) if x.identities is None else checks(words(x), role_tests(x))


def dictionary_forms(x: Inputs) -> DataFrame:
    """Inflected words that no form has, whose lemma (by evidence) has one approved verb or adjective entry."""
    if x.evidence is None:
        return _none(x)
    e = x.evidence.where("lemma is not null").select("doc_id", "start", "end", F.lower("lemma").alias("lemma"))
    words = matching.word_rows(x.scanned).join(e, ["doc_id", "start", "end"]).where("lemma <> w")
    free = words.join(x.forms.select(F.col("form").alias("w")), "w", "left_anti")
    one = x.forms.where("width = 1 and n_approved = 1 and n_unapproved = 0 and (array_contains(poses, 'verb') or array_contains(poses, 'adjective'))").select(F.col("form").alias("lemma"))
    return diagnostics(free.join(one, "lemma"), "dictionary_forms", "STE-FORM-001", "error", "Use only the forms that the dictionary gives.", F.to_json(F.struct("w", "lemma")))


def dictionary_roles(x: Inputs) -> DataFrame:
    """Approved words whose observed part of speech (by evidence) none of their entries has; glossary terms are exempt."""
    if x.evidence is None:
        return _none(x)
    seen = x.evidence.where("pos is not null").groupBy("doc_id", "start", "end").agg(F.collect_set("pos").alias("observed"))
    k = _known(x).where("n_approved > 0 and n_unapproved = 0").join(seen, ["doc_id", "start", "end"]).where(~F.arrays_overlap("poses", "observed"))
    if x.identities is not None:
        k = k.join(x.identities.select(F.col("identity").alias("w")), "w", "left_anti")
    return diagnostics(k, "dictionary_roles", "STE-GRAM-001", "error", "Use the word as its approved part of speech.", F.to_json(F.struct("w", "observed", "poses")))


def procedural(x: Inputs) -> DataFrame:
    out = (commands(x) if x.asks("STE-PROC") else []) + (safety(x) if x.asks("STE-SAFE") else [])
    return _union(out) if out else _none(x)


def commands(x: Inputs) -> list[DataFrame]:
    u = _unit_words(x, ["prose", "item"]).where(~F.col("text").rlike("(?i)^\\s*(warning|caution|note)\\s*:"))
    opener = F.get("words", F.lit(0)).isin(*OPENERS)
    head = _opening(u.where(~opener), x, x.widths).where("n_approved is not null")
    known = F.col("n_approved") + F.col("n_unapproved") > 0
    imperative = F.col("base_verbs") > 0
    # two commands take an "and" between them
    ands = u.where(~opener & F.array_contains("words", "and")).select("doc_id", "start", "end", F.explode(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"), F.get("words", i - 1).alias("p")))).alias("t")).where("t.i = 0 or t.p = 'and'")
    acts = ands.select("doc_id", "start", "end", "t.i", F.col("t.w").alias("form")).join(x.forms.where("base_verbs > 0 and width = 1").select("form"), "form").groupBy("doc_id", "start", "end").agg(F.count(F.lit(1)).alias("actions"), F.min("i").alias("i"))
    return [
        diagnostics(acts.where("actions > 1 and i = 0"), "procedural", "STE-PROC-003", "error", "Write one instruction in a sentence.", F.to_json(F.struct("actions"))),
        diagnostics(u.where(opener & ~F.col("text").contains(",")), "procedural", "STE-PROC-002", "error", "Put a comma after the condition."),
        diagnose(head, "procedural", _tests(x, [
            (known & ~imperative & (F.col("n_approved") > 0), "STE-PROC-001", "error", "Start the instruction with a command."),
            (imperative & (F.col("other_approved") > 0), "STE-PROC-004", "blocked", "The first word may be no command."),
        ]), F.to_json(F.struct("form"))),
    ]


def safety(x: Inputs) -> list[DataFrame]:
    s = x.scanned.select("doc_id", F.explode("safety").alias("s")).select("doc_id", "s.level", "s.start", "s.end", F.filter(F.split(F.lower("s.text"), "[^\\p{IsAlphabetic}\\p{N}']+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    o = _opening(s.where(~F.get("words", F.lit(0)).isin(*OPENERS)), x)
    ok = F.coalesce(F.col("base_verbs"), F.lit(0)) > 0
    out = [diagnose(o, "procedural", _tests(x, [
        (~ok, "STE-SAFE-001", "error", "Start with a command or a condition."),
        (ok & (F.col("other_approved") > 0), "STE-SAFE-002", "blocked", "The opening may be no command."),
    ]), F.to_json(F.struct("form")))]
    if x.safety_facts is not None:
        f = x.safety_facts.select("doc_id", F.col("start").alias("fs"), F.col("end").alias("fe"), F.lower("safety_level").alias("fact"))
        both = s.join(f, "doc_id").where("fs < end and start < fe").groupBy("doc_id", "start", "end", "level").agg(F.collect_set("fact").alias("facts"))
        out.append(diagnostics(both.where((F.size("facts") == 1) & (F.get("facts", F.lit(0)) != F.col("level"))), "procedural", "STE-SAFE-003", "error", "Use the signal word of the risk.", F.to_json(F.struct("level", "facts"))))
    return out


def contextual(x: Inputs) -> DataFrame:
    """Supplied facts on places of a text; facts that lie outside of it block."""
    if x.occurrences is None:
        return _none(x)
    have = x.occurrences.columns
    o = x.occurrences.join(x.scanned.select("doc_id", "text"), "doc_id")
    size = F.octet_length("text")
    bad = ~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= size) & F.is_valid_utf8(F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("string")))
    o = o.withColumn("bad", F.coalesce(bad, F.lit(True)))
    part = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("string")
    tests = [
        ("dictionary_meaning", "STE-CTX-001", F.col("dictionary_meaning") == "unapproved", "Use the word only with its approved meaning."),
        ("technical_noun_scope", "STE-CTX-002", F.col("technical_noun_scope").isin("regional", "slang", "jargon"), "Do not use regional words, slang or jargon."),
        ("spelling", "STE-CTX-003", (F.col("spelling") != "american") & ~F.coalesce(F.col("official_technical_name") if "official_technical_name" in have else F.lit(False), F.lit(False)), "Use American spelling."),
        ("hyphen_direct_relation", "STE-PUNC-002", ~F.col("hyphen_direct_relation"), "Join only directly related words with hyphens."),
        ("phrasal_verb", "STE-PHRASE-001", F.col("phrasal_verb") & part.rlike("\\S\\s+\\S"), "Do not use phrasal verbs."),
        ("parenthesis_use", "STE-PUNC-003", F.col("parenthesis_use") == "other", "Use parentheses only as the rules permit."),
    ]
    good = [(~F.col("bad") & test, code, "error", msg) for name, code, test, msg in tests if name in have]
    return diagnose(o, "contextual", [(F.col("bad"), "STE-CTX-000", "blocked", "The fact does not fit the text."), *good], F.when(~F.col("bad"), F.to_json(F.struct(part.alias("text")))))


def _dictionary(x: Inputs) -> DataFrame:
    """Phrases of the lexicon and the glossary with what LEX and TERM codes ask of them; the glossary comes first."""
    d = x.forms.select(F.col("form").alias("phrase"), "width", F.lit(1).alias("source"), "n_approved", "n_unapproved", "instead", F.lit(None).cast("string").alias("status"), F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("string").alias("replacement"))
    if x.identities is not None:
        g = x.identities.select(F.col("identity").alias("phrase"), "width", F.lit(0).alias("source"), F.lit(0).cast("long").alias("n_approved"), F.lit(0).cast("long").alias("n_unapproved"), F.lit(None).cast("string").alias("instead"), "status", "roles", "replacement")
        d = d.unionByName(g)
    rest = [c for c in d.columns if c != "phrase"]
    return d.groupBy("phrase").agg(F.min_by(F.struct(*rest), "source").alias("m")).select("phrase", "m.*")


def lexical_rows(x: Inputs) -> DataFrame:
    """(doc_id, start, end, phrase): the longest, leftmost known phrases of several words, and all words outside of them that
    are not machine-like."""
    d = _dictionary(x)
    s = x.scanned.select("doc_id", "mode", "lexical")
    many = matching.phrase_set(d.where("width > 1"), "phrase")
    if many is not None:
        swept = matching.sweep(s, many)
        t = lambda i: F.get("lexical", i)
        row = lambda start, end, text, machine: F.struct(start.alias("start"), end.alias("end"), text.alias("text"), machine.alias("machine"))
        multi = F.transform("kept", lambda m: row(t(m["idx"])["start"], t(m["idx"] + m["width"] - 1)["end"], F.array_join(F.slice("low", m["idx"] + 1, m["width"]), " "), F.lit(False)))
        covered = F.flatten(F.transform("kept", lambda m: F.sequence(m["idx"], m["idx"] + m["width"] - 1)))
        free = F.array_except(F.sequence(F.lit(0), F.size("lexical") - 1), covered)
        # lambdas over each word are interpreted: documents without any phrase give their words as they are
        rows = F.when(F.size("kept") == 0, F.col("lexical")).otherwise(F.concat(multi, F.transform(free, lambda i: row(t(i)["start"], t(i)["end"], t(i)["text"], t(i)["machine"]))))
        swept = swept.where(F.size("lexical") > 0).select("doc_id", F.explode(rows).alias("r")).where("not r.machine")
        return swept.select("doc_id", "r.start", "r.end", F.lower("r.text").alias("phrase"))
    found = matching.phrases(s, x.widths, "lexical").join(d.select("phrase").hint("merge"), "phrase").where("width > 1")
    kept = matching.leftmost(matching.longest(found)).select("doc_id", "idx", "width", "start", "end", "phrase")
    covered = kept.select("doc_id", F.explode(F.sequence("idx", F.col("idx") + F.col("width") - 1)).alias("idx"))
    lone = s.select("doc_id", F.posexplode("lexical").alias("idx", "t")).select("doc_id", "idx", "t.*").where("not machine").join(covered.hint("merge"), ["doc_id", "idx"], "left_anti")
    return lone.select("doc_id", "start", "end", F.lower("text").alias("phrase")).unionByName(kept.select("doc_id", "start", "end", "phrase"))


def lexical(x: Inputs) -> DataFrame:
    """Dictionary and glossary status of words and phrases: longest first, the glossary before the dictionary."""
    rows = lexical_rows(x).join(matching.small(_dictionary(x).drop("width")), "phrase", "left")
    ev = F.to_json(F.struct("phrase", "instead", "replacement"))
    noun = F.array_contains("roles", "noun")
    word = F.col("source") == 1
    return diagnose_one(rows, "lexical", [
        (word & (F.col("n_approved") == 0), "STE-LEX-001", "error", "Use an approved word."),
        (word & (F.col("n_approved") > 0) & (F.col("n_unapproved") > 0), "STE-LEX-002", "blocked", "The word is approved only in some uses."),
        (F.col("source").isNull(), "STE-TERM-001", "blocked", "The word is in neither source."),
        ((F.col("source") == 0) & (F.col("status") == "deprecated"), "STE-TERM-002", "error", "Do not use a deprecated term."),
    ], ev, rules=F.when(F.col("source") == 0, F.when(noun, F.array(F.lit("1.8"))).otherwise(F.array().cast("array<string>"))))


def _none(x: Inputs) -> DataFrame:
    rows = x.scanned.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    return diagnostics(rows, "contextual", "STE-CTX-000", "blocked", "")


FAMILIES = [punctuation, contractions, length, lists, notes, paragraph, verb_constructions, grammar, entities, discourse, technical_roles, dictionary_forms, dictionary_roles, procedural, contextual, lexical]

#: Families of single words, by their tests: run() evaluates all that are asked for in one pass over the words.
WORD_TESTS = {verb_constructions: (verb_tests, free_ings), grammar: (voice_tests, lambda x: [long_nouns(x)]), technical_roles: (role_tests, lambda x: [])}

#: The span families that each rule family reads.
READS = {
    punctuation: ["semicolons"], contractions: ["runs"], length: ["units", "groups"], lists: ["lists", "items", "item_words"], notes: ["units", "unit_words"],
    paragraph: ["paragraphs"], verb_constructions: ["tokens"], grammar: ["tokens"], entities: ["tokens"], discourse: ["headings", "paragraphs", "units", "items", "notes", "safety"],
    technical_roles: ["tokens"], dictionary_forms: ["tokens"], dictionary_roles: ["tokens"], procedural: ["units", "unit_words", "safety"], contextual: [], lexical: ["lexical"],
}


#: Families of which some codes read less, by how those start.
PARTS = {
    lists: {"STE-LIST-001": ["lists"], "STE-LIST-002": ["items"], "STE-LIST-003": ["items"], "STE-LIST-004": ["items", "item_words"]},
    procedural: {"STE-PROC": ["units", "unit_words"], "STE-SAFE": ["safety"]},
}
#: The kinds of units that are read by families, or their codes, that do not read all.
KINDS = {notes: ("note",), procedural: ("prose", "item")}


def reads(family: Callable, codes: frozenset[str] | None) -> list[str]:
    """The span families that a rule family reads for the codes that are asked for."""
    if codes is None or family not in PARTS:
        return READS[family]
    return [s for start, spans in PARTS[family].items() if any(c.startswith(start) for c in codes) for s in spans]


def run(x: Inputs, families: list) -> DataFrame:
    """Diagnostics of the rule families, of the codes that are asked for: one pass for all families of single words, one for each
    other."""
    out = _run(x, families)
    return out if x.codes is None else out.where(F.col("code").isin(*sorted(x.codes)))


def _run(x: Inputs, families: list) -> DataFrame:
    single = [f for f in families if f in WORD_TESTS and not (f is technical_roles and x.identities is None)]
    parts = [f(x) for f in families if f not in WORD_TESTS]
    if single:
        parts += [checks(words(x, technical_roles not in single), [t for f in single for t in WORD_TESTS[f][0](x)]), *(d for f in single for d in WORD_TESTS[f][1](x))]
    return _union(parts) if parts else _none(x)
