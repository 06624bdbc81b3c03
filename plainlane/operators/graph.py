"""Document graphs and resolutions: nodes and edges, pronoun antecedents, senses, grammar and safety semantics.

Every resolution keeps its candidates in an array; state says unknown (none), resolved (one) or ambiguous (more).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import reports
from ..sources import tables
from ..sources.evidence import resolution
from . import matching, rules

PRONOUNS = ["it", "its"]


def nodes(scanned: DataFrame, topics: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, id, start, end) of headings, paragraphs, sentences, items, notes and safety statements, and of topics (facts)
    and entity mentions if they are given; id numbers a document's nodes of a kind by place."""
    parts = [("headings", "heading"), ("paragraphs", "paragraph"), ("units", "sentence"), ("items", "item"), ("notes", "note"), ("safety", "safety")]
    parts = [(f, k) for f, k in parts if f in scanned.columns]

    def array(family: str, kind: str) -> Column:
        return F.transform(family, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("id"), s["start"].alias("start"), s["end"].alias("end")))

    out = scanned.select("doc_id", F.explode(F.concat(*[array(f, k) for f, k in parts])).alias("n")).select("doc_id", "n.*")
    for rows, kind in ((topics, "topic"), (mentions, "entity")):
        if rows is not None:
            number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", *(["identity"] if kind == "entity" else ["topic"]))) - 1).cast("int")
            out = out.unionByName(rows.select("doc_id", F.lit(kind).alias("kind"), number.alias("id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return out


def edges(scanned: DataFrame, topics: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(doc_id, relation, kind, start, to_kind, to_start): precedes among nodes of a kind, contains from paragraphs to sentences,
    topics and entity mentions."""
    n = nodes(scanned, topics, mentions)
    w = Window.partitionBy("doc_id", "kind").orderBy("start", "end")
    follows = n.withColumn("to_start", F.lead("start").over(w)).where("to_start is not null").select("doc_id", F.lit("precedes").alias("relation"), "kind", "start", F.col("kind").alias("to_kind"), "to_start")
    outer, out = n.where("kind = 'paragraph'"), follows
    for kind in ("sentence", "topic", "entity"):
        if kind == "sentence" or (topics if kind == "topic" else mentions) is not None:
            held = reports.contains(outer, n.where(F.col("kind") == kind))
            out = out.unionByName(held.select("doc_id", F.lit("contains").alias("relation"), F.lit("paragraph").alias("kind"), F.col("outer_start").alias("start"), F.lit(kind).alias("to_kind"), F.col("inner_start").alias("to_start")))
    return out


def antecedents(pronouns: DataFrame, mentions: DataFrame) -> DataFrame:
    """pronouns (doc_id, unit, start, end, ...) with basis, n and antecedent (identity, start, end): the distinct identities that end
    before a pronoun in its unit (basis "same"), or else those of the unit before ("previous"). antecedent is the first mention
    of the one identity, null unless n is 1.

    An as-of merge: each unit's first mentions and its pronouns in one order of places, with a running count and the first
    identity so far as the only state. Pronouns never meet all mentions of their document.
    """
    first = mentions.groupBy("doc_id", "unit", "identity").agg(F.min(F.struct("end", "start")).alias("m"))
    first = first.select("doc_id", "unit", F.struct("identity", F.col("m.start").alias("start"), F.col("m.end").alias("end")).alias("a"))
    kind, own = first.schema["a"].dataType, [c for c in pronouns.columns if c not in ("doc_id", "unit")]
    row = F.struct(*own)
    events = first.select("doc_id", "unit", F.col("a.end").alias("at"), F.lit(0).alias("order"), "a").withColumn("p", F.lit(None).cast(pronouns.select(row.alias("p")).schema["p"].dataType))
    events = events.unionByName(pronouns.select("doc_id", "unit", F.col("start").alias("at"), F.lit(1).alias("order"), F.lit(None).cast(kind).alias("a"), row.alias("p")))
    upto = Window.partitionBy("doc_id", "unit").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("n", F.count("a").over(upto)).withColumn("first", F.first("a", ignorenulls=True).over(upto)).where("p is not null")
    whole = first.groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("last_n"), F.min(F.struct("a.end", "a")).alias("last")).select("doc_id", (F.col("unit") + 1).alias("unit"), "last_n", F.col("last.a").alias("last"))
    both = seen.join(whole.hint("merge"), ["doc_id", "unit"], "left")
    same, before = F.col("n") > 0, F.coalesce(F.col("last_n"), F.lit(0)) > 0
    n = F.when(same, F.col("n")).otherwise(F.coalesce("last_n", F.lit(0)))
    return both.select(
        "doc_id", "unit", "p.*", F.when(same, F.lit("same")).when(before, F.lit("previous")).alias("basis"), n.cast("long").alias("n"), F.when(n == 1, F.when(same, F.col("first")).otherwise(F.col("last"))).alias("antecedent"),
    )


def state_of(n: Column) -> Column:
    return F.when(n == 0, "unknown").when(n == 1, "resolved").otherwise("ambiguous")


def pronouns(scanned: DataFrame) -> DataFrame:
    """(doc_id, unit, start, end, pronoun) of it and its within units."""
    return matching.word_rows(scanned, around=("w",)).where(F.col("w").isin(*PRONOUNS) & (F.col("unit") >= 0)).select("doc_id", "unit", "start", "end", F.col("w").alias("pronoun"))


def references(x: rules.Inputs, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, pronoun, candidates, state): antecedents() of it and its among all mentions, with the identities that
    compete. Several identities stay ambiguous; their lists are what makes rows long, antecedents() alone is linear."""
    found = all_mentions(x) if found is None else found
    a = antecedents(pronouns(x.scanned), found)
    firsts = found.groupBy("doc_id", "unit", "identity").agg(F.min("end").alias("first_end"))
    unit = F.when(F.col("basis") == "previous", F.col("unit") - 1).otherwise(F.col("unit"))
    near = a.withColumn("at", unit).join(firsts.withColumnRenamed("unit", "at"), ["doc_id", "at"], "left").where("basis is null or first_end <= start or basis = 'previous'")
    lists = near.groupBy("doc_id", "start", "end", "pronoun", "n").agg(F.array_sort(F.collect_set(F.when(F.col("basis").isNotNull(), F.col("identity")))).alias("candidates"))
    return lists.select("doc_id", "start", "end", "pronoun", "candidates", state_of(F.col("n")).alias("state"))


def all_mentions(x: rules.Inputs) -> DataFrame:
    from . import mentions

    return mentions.mentions(x)


def reference_edges(pronouns: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, start, end, unit, state, entity): each pronoun with the number of its antecedent's node among the document's entity
    nodes (equal identity and span; of several equal ones the first), null unless resolved."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "identity")) - 1
    ids = mentions.select("doc_id", "start", "end", "identity").withColumn("entity", number.cast("int"))
    ids = ids.groupBy("doc_id", F.struct("identity", "start", "end").alias("antecedent")).agg(F.min("entity").alias("entity"))
    found = antecedents(pronouns, mentions)
    return found.join(ids.hint("merge"), ["doc_id", "antecedent"], "left").select("doc_id", "start", "end", "unit", state_of(F.col("n")).alias("state"), "entity")


def ordering_edges(nodes: DataFrame, orderings: DataFrame) -> DataFrame:
    """orderings (doc_id, before, after[, source]) with before_id, after_id and their states: nodes of equal kind, start and end.
    Targets are (kind, start, end); one node resolves, several are ambiguous."""
    flat = nodes.groupBy("doc_id", F.struct("kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("t")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k"))
    out = orderings.withColumn("_n", F.xxhash64("doc_id", "before", "after"))
    for side in ("before", "after"):
        t = flat.select("doc_id", F.col("t").alias("_t"), F.col("id").alias(f"{side}_id"), F.col("k").alias("_k"))
        key = F.struct(F.col(f"{side}.kind").alias("kind"), F.col(f"{side}.start").cast("long").alias("start"), F.col(f"{side}.end").cast("long").alias("end"))
        out = out.withColumn("_t", key).join(t.hint("merge"), ["doc_id", "_t"], "left").withColumn(f"{side}_state", state_of(F.coalesce("_k", F.lit(0))))
        out = out.withColumn(f"{side}_id", F.when(F.col("_k") == 1, F.col(f"{side}_id"))).drop("_t", "_k")
    return out.drop("_n")


def _peeled(orders: DataFrame) -> DataFrame:
    """orders without those of places that no order leads into or out of, round by round; what is left lies on or between cycles."""
    left, size = tables.staged(orders, "orders"), -1
    while (now := left.count()) not in (0, size):
        size = now
        heads, tails = left.select("doc_id", F.col("a").alias("b")).distinct(), left.select("doc_id", F.col("b").alias("a")).distinct()
        left = tables.staged(left.join(heads.hint("merge"), ["doc_id", "b"], "left_semi").join(tails.hint("merge"), ["doc_id", "a"], "left_semi").select("doc_id", "a", "b"), "orders")
    return left


def _colored(left: DataFrame) -> DataFrame:
    """(doc_id, v, c): the greatest place that reaches each place, itself included. Each round sends on only what has changed."""
    places = left.select("doc_id", F.col("a").alias("v")).union(left.select("doc_id", "b")).distinct()
    colors = new = tables.staged(places.withColumn("c", F.col("v")), "colors")
    while True:
        sent = new.join(left.select("doc_id", F.col("a").alias("v"), "b").hint("merge"), ["doc_id", "v"]).groupBy("doc_id", F.col("b").alias("v")).agg(F.max("c").alias("m"))
        new = tables.staged(sent.join(colors.hint("merge"), ["doc_id", "v"]).where("m > c").select("doc_id", "v", F.col("m").alias("c")), "recolored")
        if not new.limit(1).count():
            return colors
        colors = tables.staged(colors.join(new.withColumnRenamed("c", "m").hint("merge"), ["doc_id", "v"], "left").select("doc_id", "v", F.coalesce("m", "c").alias("c")), "colors")


def contradictions(orders: DataFrame) -> DataFrame:
    """The orders (doc_id, a, b: a comes before b) that lie on a cycle, with b reaching a; a self-order is one.

    Places on no cycle are peeled off. Of the rest each gets as its color the greatest place that reaches it; those of a color
    that reach its namesake are one strongly connected part, whose orders are the contradictory ones. Parts found are taken out
    and the rest begins anew. Both searches are semi-naive and hold one row a place, never pairs of places; rounds are written
    to the shared folder and the driver sees counts.
    """
    left = _peeled(orders.select("doc_id", "a", "b").where("a is not null and b is not null").distinct())
    out = left.where("false")
    while left.limit(1).count():
        colors = _colored(left)
        inner = left.join(colors.select("doc_id", F.col("v").alias("a"), F.col("c").alias("ca")).hint("merge"), ["doc_id", "a"]).join(colors.select("doc_id", F.col("v").alias("b"), F.col("c").alias("cb")).hint("merge"), ["doc_id", "b"])
        inner = tables.staged(inner.where("ca = cb").select("doc_id", "a", "b"), "one-color")
        part = new = tables.staged(colors.where("v = c").select("doc_id", "v"), "part")
        while new.limit(1).count():
            back = inner.join(new.withColumnRenamed("v", "b").hint("merge"), ["doc_id", "b"]).select("doc_id", F.col("a").alias("v")).distinct()
            new = tables.staged(back.join(part.hint("merge"), ["doc_id", "v"], "left_anti"), "part")
            part = tables.staged(part.unionByName(new), "part")
        a, b = part.withColumnRenamed("v", "a").hint("merge"), part.withColumnRenamed("v", "b").hint("merge")
        out = out.unionByName(inner.join(a, ["doc_id", "a"], "left_semi").join(b, ["doc_id", "b"], "left_semi").select("doc_id", "a", "b"))
        left = _peeled(left.join(a, ["doc_id", "a"], "left_anti").join(b, ["doc_id", "b"], "left_anti").select("doc_id", "a", "b"))
    return out


def walk_contradictions(visits: DataFrame, unit: str, range_units: int = 1024) -> DataFrame:
    """The orders (doc_id, a, b) that lie on a cycle, where a and b are neighbours in a document's sequence of visits
    (doc_id, unit, start, end, name), ordered by these; what contradictions() gives for such steps, without its rounds.

    A sequence leads from each place to all later ones, so a step lies on a cycle exactly if some name is visited before and
    after it. Each name that recurs opens at its first place and closes at its last; a step while any is open is one. The
    running count of open names is a two-level scan: within ranges of units, and over one row a range. No task holds a whole
    document. Steps from a name to itself are none, repeated visits change nothing, a null unit comes last, and rows of null
    doc_id or name are left out.
    """
    key = ["unit", "start", "end", "name"]
    rows = visits.where("doc_id is not null and name is not null")
    rows = rows.select("doc_id", F.coalesce(F.col(unit).cast("long"), F.lit((1 << 63) - 1)).alias("unit"), "start", "end", "name")
    spans = rows.groupBy("doc_id", "name").agg(F.min(F.struct(*key[:3])).alias("first"), F.max(F.struct(*key[:3])).alias("last")).where("first <> last")
    turns = F.explode(F.array(F.struct("first.*", F.lit(1).alias("opens")), F.struct("last.*", F.lit(-1).alias("opens"))))
    marks = spans.select("doc_id", "name", turns.alias("t")).select("doc_id", "t.unit", "t.start", "t.end", "name", "t.opens", F.lit(0).alias("visit"))
    events = rows.select("doc_id", *key, F.lit(0).alias("opens"), F.lit(1).alias("visit")).unionByName(marks)
    events = events.withColumn("range", F.floor(F.col("unit") / range_units))

    within = Window.partitionBy("doc_id", "range").orderBy(*key, "visit")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    steps = events.withColumn("open", F.sum("opens").over(upto)).where("visit = 1").withColumn("b", F.lead("name").over(within))

    first = F.min(F.when(F.col("visit") == 1, F.struct(*key))).alias("first")
    sums, over = events.groupBy("doc_id", "range").agg(F.sum("opens").alias("own"), first), Window.partitionBy("doc_id").orderBy("range")
    before = F.sum("own").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    sums = sums.select("doc_id", "range", before.alias("before"), F.lead("first.name").over(over).alias("next"))
    both = steps.join(sums.hint("merge"), ["doc_id", "range"]).where(F.col("open") + F.col("before") > 0)
    return both.select("doc_id", F.col("name").alias("a"), F.coalesce("b", "next").alias("b")).where("a <> b").distinct()


def senses(x: rules.Inputs, entries: DataFrame) -> DataFrame:
    """(doc_id, start, end, w, candidates, state): meanings of the interpreted approved entries of each word."""
    from ..sources import lexicon

    meaning = lexicon.form_rows(entries).where("width = 1 and status = 'approved' and interpreted").select("form", "entry_id")
    meaning = meaning.join(entries.select("entry_id", F.explode("senses").alias("s")).select("entry_id", "s.meaning"), "entry_id").groupBy("form").agg(F.array_sort(F.collect_set("meaning")).alias("candidates"))
    rows = matching.word_rows(x.scanned).join(meaning.withColumnRenamed("form", "w"), "w")
    return rows.select("doc_id", "start", "end", "w", "candidates", resolution(F.col("candidates")).alias("state"))


def grammar_columns(x: rules.Inputs) -> DataFrame:
    """Words with resolved uses: participle_use, ing_use and role, each an array of candidates."""
    k = matching.word_rows(x.scanned).join(x.forms.where("width = 1").withColumnRenamed("form", "w").drop("width"), "w", "left")
    k = k.join(x.ings.select(F.col("form").alias("w"), "base"), "w", "left")
    be, have, det = F.col("p1").isin(*rules.BE), F.col("p1").isin(*rules.HAVE), F.col("p1").isin(*rules.DETERMINERS)
    some = lambda *xs: F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in xs]), lambda y: y.isNotNull())
    part, adj = F.col("participles") > 0, F.col("adjectives") > 0
    return k.select(
        "doc_id", "idx", "start", "end", "w", "unit",
        some((part & have, "perfect"), (part & be, "passive"), (part & be & adj, "adjectival")).alias("participle_use"),
        some((F.col("base").isNotNull() & be, "progressive"), (F.col("base").isNotNull() & be & adj, "adjectival"), (F.col("base").isNotNull() & det & F.coalesce(F.col("n1").isin(*rules.BE), F.lit(False)), "nominal")).alias("ing_use"),
        some((det & F.coalesce(F.col("n1").isin(*rules.BE), F.lit(False)), "nominal"), ((F.col("mode") == "procedural") & F.col("first") & F.coalesce(F.col("n1").isin(*rules.DETERMINERS), F.lit(False)), "verbal")).alias("role"),
    )


def auxiliary_chains(scanned: DataFrame) -> DataFrame:
    """(doc_id, unit, start, end, words, head): runs of auxiliaries with the word that follows; gaps and islands."""
    k = matching.word_rows(scanned).where(F.col("w").isin(*rules.HAVE, *rules.BE))
    w = Window.partitionBy("doc_id", "unit").orderBy("idx")
    k = k.withColumn("run", F.col("idx") - F.row_number().over(w))
    return k.groupBy("doc_id", "unit", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda y: y["w"]).alias("words"), F.max_by("n1", "idx").alias("head")).drop("run")


def safety_semantics(scanned: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, start, end, level, and candidates and state of supplied level, actor, command, hazard, consequence)."""
    s = scanned.select("doc_id", F.explode("safety").alias("s")).select("doc_id", "s.start", "s.end", "s.level")
    f = facts.select("doc_id", F.col("start").alias("fs"), F.col("end").alias("fe"), "safety_level", *(F.when(F.col(c).isNotNull(), F.concat_ws("-", f"{c}.start", f"{c}.end")).alias(c) for c in ("actor", "command", "hazard", "consequence")))
    j = s.join(f, (s["doc_id"] == f["doc_id"]) & (f["fs"] < s["end"]) & (s["start"] < f["fe"]), "left").drop(f["doc_id"])
    names = ["safety_level", "actor", "command", "hazard", "consequence"]
    out = j.groupBy("doc_id", "start", "end", "level").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in names])
    state: list[Column] = [resolution(F.col(c)).alias(f"{c}_state") for c in names]
    return out.select("*", *state)
