"""External linguistic evidence: bundles are imported whole or not at all; clause kinds and resolutions from candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = (
    "schema string, doc_id bigint, text_sha256 string, text_bytes bigint, provider struct<name:string, version:string, config_sha256:string>, "
    "evidence array<struct<kind:string, start:bigint, end:bigint, surface:string, value:string, target_start:bigint, target_end:bigint, confidence:float, alternatives:array<string>>>"
)
SCHEMA_NAME = "evidence-bundle/v1"
KINDS = ["dependency", "constituency", "entity", "coreference", "pos", "lemma", "clause"]
CONFIDENCE = 0.80
#: The order in which clause kinds are reported.
CLAUSE_KINDS = ["instruction", "description", "condition", "warning", "note", "purpose", "result", "other"]


def resolution(candidates: Column) -> Column:
    """unknown, resolved or ambiguous, by the number of candidates; none is ever picked."""
    n = F.size(F.array_distinct(candidates))
    return F.when(candidates.isNull() | (n <= 0), "unknown").when(n == 1, "resolved").otherwise("ambiguous")


def bundle_problems(bundles: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, problem): every reason to reject a bundle."""
    b = bundles.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id", "left")
    raw = F.col("_t").cast("binary")
    cut = lambda s, e: F.substring(raw, (s + 1).cast("int"), (e - s).cast("int"))
    bad_span = F.exists("evidence", lambda x: ~F.coalesce((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.octet_length("_t")) & F.is_valid_utf8(cut(x["start"], x["end"]).cast("string")), F.lit(False)))
    tests = {
        "no document": F.col("_t").isNull(), "schema": F.col("schema") != SCHEMA_NAME, "length": F.col("text_bytes") != F.octet_length("_t"), "digest": F.sha2(raw, 256) != F.col("text_sha256"),
        "configuration digest": ~F.col("provider.config_sha256").rlike("^[0-9a-f]{64}$"), "provider": F.trim("provider.name") == "",
        "span": bad_span, "surface": F.exists("evidence", lambda x: x["surface"].isNotNull() & (cut(x["start"], x["end"]).cast("string") != x["surface"])),
        "kind": F.exists("evidence", lambda x: ~F.coalesce(x["kind"].isin(*KINDS), F.lit(False))),
        "confidence": F.exists("evidence", lambda x: x["confidence"].isNotNull() & ~x["confidence"].between(0, 1)),
    }
    hits = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(p)) for p, t in tests.items()]), lambda x: x.isNotNull())
    return b.select("doc_id", F.explode(hits).alias("problem"))


def imported(bundles: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, ...) of the bundles without problems."""
    good = bundles.join(bundle_problems(bundles, docs).select("doc_id").distinct(), "doc_id", "left_anti")
    return good.select("doc_id", F.explode("evidence").alias("e")).select("doc_id", "e.*")


def linguistic(evidence: DataFrame) -> DataFrame:
    """(doc_id, start, end, lemma, pos) that the rules read, from pos and lemma evidence."""
    keyed = evidence.where("kind in ('pos', 'lemma')").groupBy("doc_id", "start", "end")
    upos = F.create_map(*[F.lit(x) for kv in {"AUX": "verb", "VERB": "verb", "NOUN": "noun", "PROPN": "noun", "ADJ": "adjective", "ADV": "adverb", "PRON": "pronoun", "ADP": "preposition", "CCONJ": "conjunction", "SCONJ": "conjunction"}.items() for x in kv])
    out = keyed.agg(F.max(F.when(F.col("kind") == "lemma", F.col("value"))).alias("lemma"), F.max(F.when(F.col("kind") == "pos", F.col("value"))).alias("p"))
    return out.select("doc_id", "start", "end", "lemma", F.coalesce(upos[F.upper("p")], F.when(F.col("p").isin("noun", "verb", "adjective", "adverb", "pronoun", "preposition", "conjunction", "article"), F.col("p"))).alias("pos"))


def clause_kinds(evidence: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """(doc_id, start, end, candidates, state): kinds of enough confidence and their alternatives, in a fixed order."""
    rank = F.create_map(*[x for k, v in enumerate(CLAUSE_KINDS) for x in (F.lit(v), F.lit(k))])
    e = evidence.where("kind = 'clause'").where(F.col("confidence") >= least)
    kinds = F.concat(F.array("value"), F.coalesce("alternatives", F.array().cast("array<string>")))
    all_ = e.select("doc_id", "start", "end", F.explode(kinds).alias("k")).groupBy("doc_id", "start", "end").agg(F.collect_set("k").alias("k"))
    ordered = F.transform(F.array_sort(F.transform("k", lambda x: F.struct(F.coalesce(rank[x], F.lit(99)).alias("r"), x.alias("x")))), lambda y: y["x"])
    return all_.select("doc_id", "start", "end", ordered.alias("candidates")).withColumn("state", resolution(F.col("candidates")))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE).json(path)
