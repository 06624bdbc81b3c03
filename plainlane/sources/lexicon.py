"""Lexicons: a small one of our own, readers of lexicon documents, identity checks, and the form table that rules join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = (
    "lemma string, status string, part_of_speech string, forms array<string>, "
    "verb_paradigm struct<classification:string, source_sequence:array<string>, base_form:string, simple_present_variants:array<string>, simple_past_variants:array<string>, past_participle:string>, "
    "senses array<struct<meaning:string>>, alternatives array<struct<kind:string, text:string, part_of_speech:string, strategy:string>>, restrictions array<string>, interpretation_state string"
)
DOCUMENT = (
    "metadata struct<standard:string, issue:int, date:string, scope:string, authority:struct<source_sha256:string, source_byte_size:bigint, physical_pages:int>, "
    "dictionary_cardinalities:struct<structural_approved_records:int, structural_unapproved_records:int>>, "
    f"entries array<struct<{ENTRY.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>>"
)
POS = ["noun", "verb", "adjective", "adverb", "pronoun", "article", "preposition", "conjunction"]

#: Our own starter lexicon, independent of any standard's dictionary: approved words by part of speech.
_VERBS = "use turn open close stop start make put set remove install connect disconnect check clean move hold lift push pull do get give keep find look measure read record replace adjust attach loosen tighten apply"
_IRREGULAR = {"make": ("made", "made"), "put": ("put", "put"), "set": ("set", "set"), "hold": ("held", "held"), "do": ("did", "done"), "get": ("got", "got"), "give": ("gave", "given"), "keep": ("kept", "kept"), "find": ("found", "found"), "read": ("read", "read")}
_APPROVED = {
    "noun": "valve cap cable door tool bolt pipe pump switch system part area hand head line number operation pressure procedure set side surface temperature time work water record measure",
    "adjective": "clean open hot cold correct safe full empty permitted dry loose tight necessary possible other new",
    "adverb": "not again before slowly fully then only carefully",
    "pronoun": "this it you they that these those we all",
    "article": "the a an",
    "preposition": "with in on at of to from by for into during through before after",
    "conjunction": "and or if when but while because than that after before",
}
_MODALS = "can must will"
_PHRASES = {"make sure": "verb"}
#: Words to avoid, with what to write instead.
_UNAPPROVED = {
    "ensure": ("verb", "make sure"), "utilize": ("verb", "use"), "may": ("verb", "can"), "should": ("verb", "must"), "could": ("verb", "can"), "commence": ("verb", "start"), "terminate": ("verb", "stop"),
    "acceptable": ("adjective", "permitted"), "using": ("verb", "use"), "prior": ("adjective", "before"), "however": ("adverb", "but"), "therefore": ("adverb", "thus"), "shut": ("verb", "close"), "verify": ("verb", "make sure"),
}


def _s_form(v: str) -> str:
    return v + ("es" if v.endswith(("s", "sh", "ch", "x", "z", "o")) else "s")


def _doubled(v: str) -> str:
    return v + v[-1] if v in {"stop", "put", "set", "get"} else v[:-1] if v.endswith("e") else v


def starter_entries() -> list[dict]:
    """The starter lexicon as entries."""
    out = []
    base = dict.fromkeys(("senses", "alternatives", "restrictions", "verb_paradigm"))
    for v in _VERBS.split():
        past, participle = _IRREGULAR.get(v, (_doubled(v) + "ed",) * 2)
        p = {"classification": "lexical", "source_sequence": [v, _s_form(v), past, participle], "base_form": v, "simple_present_variants": [v, _s_form(v)], "simple_past_variants": [past], "past_participle": participle}
        out.append(base | {"lemma": v, "status": "approved", "part_of_speech": "verb", "forms": list(dict.fromkeys(p["source_sequence"])), "verb_paradigm": p, "interpretation_state": "interpreted", "senses": [{"meaning": f"to {v}"}]})
    for v in _MODALS.split():
        out.append(base | {"lemma": v, "status": "approved", "part_of_speech": "verb", "forms": [v], "interpretation_state": "interpreted", "verb_paradigm": {"classification": "modal", "source_sequence": [v], "base_form": v, "simple_present_variants": [v], "simple_past_variants": [], "past_participle": None}})
    for pos, words in _APPROVED.items():
        for w in words.split():
            out.append(base | {"lemma": w, "status": "approved", "part_of_speech": pos, "forms": [w, _s_form(w)] if pos == "noun" else [w], "interpretation_state": "interpreted"})
    for w, pos in _PHRASES.items():
        out.append(base | {"lemma": w, "status": "approved", "part_of_speech": pos, "forms": [w], "interpretation_state": "interpreted"})
    for w, (pos, instead) in _UNAPPROVED.items():
        forms = [w, _s_form(w), _doubled(w) + "ed"] if pos == "verb" and w not in ("may", "should", "could", "using") else [w]
        out.append(base | {"lemma": w, "status": "unapproved", "part_of_speech": pos, "forms": forms, "alternatives": [{"kind": "word", "text": instead, "part_of_speech": None, "strategy": "replace"}], "interpretation_state": "interpreted"})
    return out


def starter(spark: SparkSession) -> DataFrame:
    return with_ids(spark.createDataFrame([tuple(e.get(k) for k in ENTRY_NAMES) for e in starter_entries()], ENTRY))


ENTRY_NAMES = ["lemma", "status", "part_of_speech", "forms", "verb_paradigm", "senses", "alternatives", "restrictions", "interpretation_state"]


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, ...) of a lexicon document."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    return doc.select(F.posexplode("entries").alias("entry_id", "e")).select("entry_id", "e.*")


def with_ids(entries: DataFrame) -> DataFrame:
    """Numbers entries by lemma, part of speech and status."""
    return entries.withColumn("entry_id", F.row_number().over(Window.orderBy("lemma", "part_of_speech", "status")) - 1).select("entry_id", *ENTRY_NAMES)


def form_rows(entries: DataFrame) -> DataFrame:
    """(form, entry_id, lemma, status, pos, roles, interpreted) for every form and lemma."""
    p = F.col("verb_paradigm")
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    forms = F.array_distinct(F.transform(F.concat(F.coalesce("forms", F.array().cast("array<string>")), F.array("lemma")), lambda x: F.array_join(F.filter(F.split(F.lower(x), "[ \\t\\n\\f\\r]+"), lambda w: w != ""), " ")))
    rows = entries.select("entry_id", F.lower("lemma").alias("lemma"), "status", F.col("part_of_speech").alias("pos"), F.explode(forms).alias("form"), p.alias("p"), (F.col("interpretation_state") == "interpreted").alias("interpreted"), F.get("alternatives", F.lit(0))["text"].alias("instead"))
    roles = F.filter(
        F.array(
            F.when(F.lower("p.base_form") == F.col("form"), "base"),
            F.when(F.array_contains(low(F.col("p.simple_present_variants")), F.col("form")), "present"),
            F.when(F.array_contains(low(F.col("p.simple_past_variants")), F.col("form")), "past"),
            F.when(F.lower("p.past_participle") == F.col("form"), "participle"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select("form", "entry_id", "lemma", "status", "pos", F.when(F.col("p").isNotNull(), roles).otherwise(F.array().cast("array<string>")).alias("roles"), (F.col("p.classification") == "modal").alias("modal"), "interpreted", "instead", F.size(F.split("form", " ")).alias("width"))


def lookup(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(word, entry_id, lemma, status, pos, matched) for words (word): entries that have it as a form, else as their lemma."""
    key = F.array_join(F.filter(F.split(F.lower("word"), "[ \\t\\n\\f\\r]+"), lambda w: w != ""), " ")
    asked = words.select("word").distinct().withColumn("key", key)
    e = entries.select("entry_id", F.lower("lemma").alias("lemma"), "status", F.col("part_of_speech").alias("pos"), F.explode(F.concat(F.transform(F.coalesce("forms", F.array().cast("array<string>")), lambda f: F.struct(F.lower(f).alias("key"), F.lit("form").alias("matched"))), F.array(F.struct(F.lower("lemma").alias("key"), F.lit("lemma").alias("matched"))))).alias("k"))
    e = e.select("entry_id", "lemma", "status", "pos", "k.key", "k.matched").distinct()
    found = asked.join(e, "key").withColumn("by_form", F.max(F.col("matched") == "form").over(Window.partitionBy("word")))
    return found.where((F.col("matched") == "form") | ~F.col("by_form")).select("word", "entry_id", "lemma", "status", "pos", "matched")


def form_table(entries: DataFrame) -> DataFrame:
    """One row for each form, with what rules ask of all its candidates: joins with it stay one to one."""
    r = form_rows(entries)
    ok, verb = F.col("status") == "approved", F.col("pos") == "verb"
    has = lambda role: F.array_contains("roles", role)
    lexical = ~F.coalesce("modal", F.lit(False))
    return r.groupBy("form", "width").agg(
        F.count_if(ok).alias("n_approved"), F.count_if(~ok).alias("n_unapproved"),
        F.array_sort(F.collect_set("pos")).alias("poses"), F.array_sort(F.collect_set("entry_id")).alias("entry_ids"),
        F.count_if(ok & verb & lexical & (has("base") | (F.size("roles") == 0))).alias("base_verbs"),
        F.count_if(ok & verb & has("participle")).alias("participles"),
        F.count_if(ok & ~verb).alias("other_approved"), F.count_if(F.col("pos") == "adjective").alias("adjectives"),
        F.count_if((F.col("pos") == "noun") | (F.col("pos") == "adjective")).alias("nominals"), F.count_if(F.col("pos") == "noun").alias("nouns"),
        F.count_if(verb).alias("verbs"), F.max("instead").alias("instead"),
    )


def ing_table(entries: DataFrame) -> DataFrame:
    """(form, base, approved): progressive forms of single-word base verbs, by spelling rule."""
    base = F.lower("verb_paradigm.base_form")
    stem = F.when(base.rlike("[^aeiou]e$"), F.regexp_replace(base, "e$", "")).when(base.rlike("^[^aeiou]*[aeiou][bdglmnprt]$"), F.concat(base, F.right(base, F.lit(1)))).otherwise(base)
    rows = entries.where("part_of_speech = 'verb' and verb_paradigm.classification = 'lexical'").select(F.concat(stem, F.lit("ing")).alias("form"), base.alias("base"), F.col("status"))
    return rows.groupBy("form").agg(F.min("base").alias("base"), F.count_if(F.col("status") == "approved").alias("n_approved"))


def identity_report(entries: DataFrame, n_approved: int, n_unapproved: int) -> DataFrame:
    """One row a check of a lexicon against its declared counts: (check, expected, actual, passed)."""
    c = entries.agg(
        F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "unapproved").alias("unapproved"),
        F.count_if(~F.coalesce(F.col("status").isin("approved", "unapproved"), F.lit(False))).alias("bad_status"),
        F.count_if(F.trim(F.coalesce("lemma", F.lit(""))) == "").alias("empty_lemma"),
        F.count_if(F.col("part_of_speech").isNotNull() & ~F.col("part_of_speech").isin(*POS)).alias("bad_pos"),
        F.count_if(F.size(F.coalesce("forms", F.array().cast("array<string>"))) == 0).alias("no_forms"),
    )
    want = {"approved": n_approved, "unapproved": n_unapproved, "bad_status": 0, "empty_lemma": 0, "bad_pos": 0, "no_forms": 0}
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).cast("long").alias("expected"), F.col(k).cast("long").alias("actual")) for k, v in want.items()])
    return c.select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.col("expected") == F.col("actual"))


def verified(spark: SparkSession, path: str, sha256: str, size: int) -> DataFrame:
    """Entries of a lexicon document, read only if the file's size and digest are the expected ones."""
    row = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha256"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8")).first()
    if row is None or row["length"] != size or row["sha256"] != sha256 or not row["utf8"]:
        raise ValueError(f"{path} is not the expected lexicon")
    return read_entries(spark, path)
