"""Phrase matching: n-grams of word arrays joined with form tables, longest match, leftmost sweep.

A sweep with a set of phrases runs inside each document's row and shuffles nothing: places are looked at whose word begins a
phrase, the widest phrase there is found in the set, and a linear sweep (arrays.py) keeps the leftmost ones. Sets of over MOST_PHRASES phrases take
the way of joins: phrases are exploded, joined, and only places that match are shuffled (by doc_id).
Form tables are broadcast only if they are counted and small (small()); frames that derive from documents never are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Phrases that a plan may hold as a set, and rows of a dimension table that may be broadcast.
MOST_PHRASES, MOST_ROWS = 50_000, 500_000
#: First words of phrases that are sought in a whole text before its words are looked at.
FEW_HEADS = 32


def small(table: DataFrame) -> DataFrame:
    """A dimension table with a hint: broadcast if it has no more than MOST_ROWS rows (they are counted), else merge join."""
    n = table.limit(MOST_ROWS + 1).count()
    return F.broadcast(table) if n <= MOST_ROWS else table.hint("merge")


def pinned(table: DataFrame) -> DataFrame:
    """A dimension table of no more than MOST_ROWS rows held in the plan, so that it is computed once; a larger one as it is."""
    rows = table.limit(MOST_ROWS + 1).toArrow()
    return table.sparkSession.createDataFrame(rows, table.schema) if rows.num_rows <= MOST_ROWS else table


def phrase_set(table: DataFrame, column: str) -> list[str] | None:
    """The phrases of a dimension table, sorted; None if there are more than MOST_PHRASES."""
    rows = table.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_PHRASES + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= MOST_PHRASES else None


def sweep(scanned: DataFrame, phrases: list[str], family: str = "lexical", spaced: bool = False) -> DataFrame:
    """scanned with the columns low (its lower-case words) and kept: the places (idx, width) of the widest phrase at each place,
    of which a sweep from the left keeps those that start where the last kept one ended, or later. spaced: only white space
    may stand between a phrase's words (the family has gaps). While the phrases begin with no more than FEW_HEADS words, low is
    empty in documents that hold none of these, which is told from the whole text at once."""
    by_width: dict[int, list[str]] = {}
    for p in phrases:
        by_width.setdefault(p.count(" ") + 1, []).append(p)
    heads = sorted({p.split(" ")[0] for p in phrases})
    low = F.transform(family, lambda t: F.lower(t["text"]))
    if heads and len(heads) <= FEW_HEADS:
        whole = F.concat(F.lit(" "), F.lower(F.array_join(F.col(family)["text"], " ")), F.lit(" "))
        rows = scanned.withColumn("_whole", whole)
        holds = reduce(Column.__or__, (F.contains("_whole", F.lit(f" {h} ")) for h in heads))
        rows = rows.withColumn("low", F.when(holds, low).otherwise(F.array().cast("array<string>"))).drop("_whole")
    else:
        rows = scanned.withColumn("low", low)
    low = F.col("low")
    rows = rows.withColumn("_heads", F.filter(F.transform(low, lambda w, i: F.when(w.isin(heads), i)), lambda i: i.isNotNull()))

    def width(i: Column) -> Column:
        found = []
        for k in sorted(by_width, reverse=True):
            hit = (i + k <= F.size(low)) & (F.array_join(F.slice(low, i + 1, k), " ") if k > 1 else F.get(low, i)).isin(by_width[k])
            if spaced and k > 1:
                hit &= F.forall(F.slice(family, i + 2, k - 1), lambda t: t["gap"] == " ")
            found.append(F.when(hit, F.lit(k)))
        return F.coalesce(*found) if found else F.lit(None).cast("int")

    hits = F.filter(F.transform("_heads", lambda i: F.struct(i.alias("idx"), width(i).alias("width"))), lambda m: m["width"].isNotNull())
    rows = rows.withColumn("_hits", hits)
    places = arrays.kept_places(F.transform("_hits", lambda m: m["idx"]), F.transform("_hits", lambda m: m["idx"] + m["width"]))
    rows = rows.withColumn("_kept", places)
    return rows.withColumn("kept", F.transform("_kept", lambda i: F.get("_hits", i.cast("int")))).drop("_heads", "_hits", "_kept")


#: Columns of word_rows() beside those of the words themselves.
AROUND = ("w", "p1", "p2", "n1", "n2", "p_start", "first", "n_gap")


def word_rows(scanned: DataFrame, family: str = "tokens", around: tuple[str, ...] = AROUND) -> DataFrame:
    """One row a word, with its neighbours: (doc_id, mode, idx, start, end, text, unit, gap, around...)."""
    # arrays of the neighbours, shifted and zipped: lambdas over each word are interpreted, these are compiled
    fields = {"p1": ("text", -1), "p2": ("text", -2), "n1": ("text", 1), "n2": ("text", 2), "p_start": ("start", -1), "first": ("unit", -1), "n_gap": ("gap", 1)}

    def shifted(field: str, by: int) -> Column:
        values = F.col(family)[field]
        return F.slice(values, by + 1, F.size(values)) if by > 0 else F.concat(*[F.array(F.get(values, F.lit(-1)))] * -by, values)

    near = [f for f in around if f in fields]
    zipped = F.arrays_zip(F.col(family).alias("t"), *(shifted(*fields[f]).alias(f) for f in near))
    rows = scanned.where(F.size(family) > 0).select("doc_id", "mode", F.posexplode(zipped).alias("idx", "x")).where("x.t is not null")
    given = {
        "w": F.lower("x.t.text"), "p_start": F.col("x.p_start"), "first": F.coalesce("x.first", F.lit(-2)) != F.col("x.t.unit"), "n_gap": F.coalesce("x.n_gap", F.lit("")),
        **{f: F.lower(f"x.{f}") for f in ("p1", "p2", "n1", "n2")},
    }
    return rows.select("doc_id", "mode", "idx", "x.t.*", *(given[f].alias(f) for f in around))


def chosen_rows(scanned: DataFrame, among: list[str], after: int = 0, around: tuple[str, ...] = AROUND, family: str = "tokens") -> DataFrame:
    """word_rows() of the words that are, or stand after places behind, one of these lower-case words. Texts alone are exploded
    and told by the set; only what is left looks its neighbours up."""
    words = F.col(family)
    rows = scanned.where(F.size(family) > 0).select("doc_id", "mode", family, F.posexplode(words["text"]).alias("_k", "_text"))
    rows = rows.where(F.lower("_text").isin(among)).select("doc_id", "mode", (F.col("_k") + after).alias("idx"), family)
    at = lambda by: F.get(words, F.col("idx") + by)
    given = {
        "w": F.lower(at(0)["text"]), "p_start": at(-1)["start"], "first": F.coalesce(at(-1)["unit"], F.lit(-2)) != at(0)["unit"], "n_gap": F.coalesce(at(1)["gap"], F.lit("")),
        **{f: F.lower(at(by)["text"]) for f, by in (("p1", -1), ("p2", -2), ("n1", 1), ("n2", 2))},
    }
    own = [f.name for f in scanned.schema[family].dataType.elementType]
    return rows.where(at(0).isNotNull()).select("doc_id", "mode", "idx", *(at(0)[c].alias(c) for c in own), *(given[f].alias(f) for f in around))


def phrases(scanned: DataFrame, widths: int, family: str = "lexical", spaced: bool = False) -> DataFrame:
    """(doc_id, mode, idx, width, start, end, phrase, machine): all runs of 1 to widths words; spaced: only those that
    white space alone separates (the family has gaps)."""
    words = F.col(family)
    last = lambda i, k: F.get(words, i + k - 1)

    def runs(x: Column, i: Column) -> Column:
        def one(k: Column) -> Column:
            part = F.slice(words, i + 1, k)
            ok = last(i, k).isNotNull()
            if spaced:
                ok &= F.forall(F.slice(words, i + 2, k - 1), lambda t: t["gap"] == " ") | (k == 1)
            return F.when(ok, F.struct(i.alias("idx"), k.alias("width"), x["start"].alias("start"), last(i, k)["end"].alias("end"), F.array_join(F.transform(part, lambda t: F.lower(t["text"])), " ").alias("phrase")))

        return F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(widths, 1))), one), lambda y: y.isNotNull())

    return scanned.select("doc_id", "mode", F.explode(F.flatten(F.transform(words, runs))).alias("r")).select("doc_id", "mode", "r.*")


def longest(matches: DataFrame, priority: str | None = None) -> DataFrame:
    """The widest match at each place of each document; of equally wide ones the one of least priority."""
    key = [F.col("width"), *([-F.col(priority)] if priority else [])]
    best = F.max_by(F.struct(*matches.columns), F.struct(*key)).alias("m")
    return matches.groupBy("doc_id", "idx").agg(best).select("m.*")


def leftmost(matches: DataFrame) -> DataFrame:
    """Of the matches (doc_id, idx, width, ...) those that a sweep from the left keeps: each starts where the last kept
    one has ended, or later. One linear sweep over a document's sorted matches."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("width").cast("int").alias("width"))))
    rows = matches.groupBy("doc_id").agg(ordered.alias("all"))
    rows = rows.withColumn("places", arrays.kept_places(F.transform("all", lambda m: m["idx"]), F.transform("all", lambda m: m["idx"] + m["width"])))
    kept = rows.select("doc_id", F.explode(F.transform("places", lambda i: F.get("all", i.cast("int"))["idx"])).alias("idx"))
    return matches.join(kept.hint("merge"), ["doc_id", "idx"])


def span_union(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end) with overlapping and touching spans joined: running maximum, islands."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.where("start < end").withColumn("island", island).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
