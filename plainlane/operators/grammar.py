"""Grammar resolutions of sentences: noun phrases, subjects with their predicates, and actions.

Each keeps all its candidates; state says unknown (none), resolved (one) or ambiguous (more).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.evidence import resolution
from . import rules

_BREAKS = ["verb", "preposition", "conjunction", "article"]


def _tagged(x: rules.Inputs) -> DataFrame:
    """Words of sentences with their parts of speech; run numbers the stretches that no breaking word or gap divides."""
    k = rules._known(x, ("w", "p1", "first")).where("unit >= 0").withColumn("poses", F.coalesce("poses", F.array().cast("array<string>")))
    breaks = F.arrays_overlap("poses", F.array(*map(F.lit, _BREAKS))) | (F.col("gap") != " ") | F.col("first")
    w = Window.partitionBy("doc_id", "unit").orderBy("idx")
    return k.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def noun_phrases(x: rules.Inputs) -> DataFrame:
    """(doc_id, unit, idx, start, candidates, state) at every determiner: each noun that follows it, up to a verb, preposition,
    conjunction, article or mark, may be the head; candidates are (head, end)."""
    w = Window.partitionBy("doc_id", "unit", "run").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    noun = F.when(F.array_contains("poses", "noun"), F.struct(F.col("idx").alias("head"), F.col("end").alias("end")))
    k = _tagged(x).withColumn("candidates", F.collect_list(noun).over(w)).where(F.col("w").isin(*rules.DETERMINERS))
    return k.select("doc_id", "unit", "idx", "start", "candidates", resolution(F.col("candidates")).alias("state"))


def subject_predicates(x: rules.Inputs) -> DataFrame:
    """(doc_id, unit, candidates, state) of every sentence: the noun phrases at its first word, each with the first verb after
    it, from which the predicate runs to the sentence's end. candidates are (start, end, verb_start, predicate_end)."""
    k = _tagged(x)
    verb = F.when(F.array_contains("poses", "verb"), F.struct(F.col("idx").alias("idx"), F.col("start").alias("start")))
    sentences = k.groupBy("doc_id", "unit").agg(F.min("idx").alias("idx"), F.max("end").alias("last"), F.array_sort(F.collect_list(verb)).alias("verbs"))
    both = sentences.join(noun_phrases(x).select("doc_id", "unit", "idx", "start", "candidates").hint("merge"), ["doc_id", "unit", "idx"], "left")

    def clause(c: Column) -> Column:
        after = F.get(F.filter("verbs", lambda v: v["idx"] > c["head"]), F.lit(0))
        return F.when(after.isNotNull(), F.struct(F.col("start").alias("start"), c["end"].alias("end"), after["start"].alias("verb_start"), F.col("last").alias("predicate_end")))

    none = F.array().cast("array<struct<head:int,end:bigint>>")
    clauses = F.filter(F.transform(F.coalesce("candidates", none), clause), lambda c: c.isNotNull())
    return both.select("doc_id", "unit", clauses.alias("candidates")).withColumn("state", resolution(F.col("candidates")))


def action_structures(x: rules.Inputs) -> DataFrame:
    """(doc_id, unit, heads, cardinality) of procedural sentences that start with a base verb: that verb, and each base verb
    after "and"; cardinality is single or multiple."""
    k = rules._known(x, ("w", "p1", "first")).where("mode = 'procedural' and unit >= 0 and base_verbs > 0")
    low = Window.partitionBy("doc_id", "unit")
    k = k.withColumn("opens", F.bool_or("first").over(low)).where("opens")
    k = k.where(F.col("first") | (~F.col("first") & (F.col("p1") == "and") & (F.col("gap") == " ")))
    heads = F.array_sort(F.collect_list(F.struct("start", "end", "w"))).alias("heads")
    out = k.groupBy("doc_id", "unit").agg(heads)
    return out.withColumn("cardinality", F.when(F.size("heads") == 1, "single").otherwise("multiple"))
