"""Benchmark contracts: source manifests, suites and results as tables, with what is wrong in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = (
    "schema_version int, id string, source_family string, publisher string, title string, document_type string, url string, media_type string, retrieval_date string, "
    "identity struct<sha256:string, byte_size:bigint, physical_pages:int>, ste_claim struct<kind:string, evidence:struct<physical_page:int, method:string, note:string>>, "
    "verification struct<state:string>, rights struct<redistribution:string, source_cache:string, derived_text:string, committed_excerpt:string>"
)
SUITE = "schema_version int, id string, selections array<struct<id:string, source_id:string, cohort:string, match_group:string, first_page:int, last_page:int, mode:string>>"
RESULT = (
    "schema_version int, suite_id string, authoritative_runtime boolean, pages array<struct<source_id:string, selection_id:string, cohort:string, match_group:string, physical_page:int, mode:string, "
    "normalized_text_sha256:string, normalized_byte_count:bigint, word_count:bigint, outcome:string, "
    "diagnostics:array<struct<code:string, severity:string, rules:array<string>, span:struct<start:bigint, end:bigint>>>>>"
)
MODES, OUTCOMES, SEVERITIES = ["procedural", "descriptive"], ["clean", "fixed", "error", "blocked"], ["error", "warning", "blocked"]


def is_digest(c) -> Column:
    return F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_date(c) -> Column:
    """An existing day as YYYY-MM-DD."""
    d = F.try_to_date(F.col(c), "yyyy-MM-dd")
    return F.coalesce(F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & d.isNotNull() & (F.date_format(d, "yyyy-MM-dd") == F.col(c)), F.lit(False))


def blank(c) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _found(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    hits = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(p)) for p, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key).alias("id"), F.explode(hits).alias("problem"))


def source_problems(sources: DataFrame) -> DataFrame:
    twice = sources.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    return twice.unionByName(_found(sources, "id", {
        "schema version": F.col("schema_version") != 1, **{f"blank {c}": blank(c) for c in ("id", "source_family", "publisher", "title", "document_type", "media_type")},
        "url": ~F.col("url").rlike("^https://"), "retrieval date": ~is_date("retrieval_date"), "digest": ~is_digest("identity.sha256"),
        "size": ~(F.col("identity.byte_size") > 0), "pages": ~(F.col("identity.physical_pages") > 0),
        "claim page": F.col("ste_claim.evidence").isNotNull() & ~F.coalesce(F.col("ste_claim.evidence.physical_page").between(1, F.col("identity.physical_pages")), F.lit(False)),
    }))


def suite_problems(suites: DataFrame, sources: DataFrame) -> DataFrame:
    s = suites.select(F.col("id").alias("suite"), F.explode("selections").alias("s")).select("suite", "s.*")
    twice = s.groupBy("suite", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated selection").alias("problem"))
    known = s.join(sources.select(F.col("id").alias("source_id"), F.col("identity.physical_pages").alias("pages"), F.lit(True).alias("known")), "source_id", "left")
    return twice.unionByName(_found(known, "id", {
        "unknown source": F.col("known").isNull(), "page order": ~((F.col("first_page") >= 1) & (F.col("first_page") <= F.col("last_page"))),
        "page range": F.col("known").isNotNull() & (F.col("last_page") > F.col("pages")), "mode": ~F.col("mode").isin(*MODES), "blank cohort": blank("cohort"),
    }))


def result_problems(results: DataFrame) -> DataFrame:
    p = results.select(F.explode("pages").alias("p")).select("p.*").withColumn("id", F.concat_ws(":", "selection_id", "physical_page"))
    twice = p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated page").alias("problem"))
    d = F.coalesce("diagnostics", F.array().cast("array<struct<code:string,severity:string,rules:array<string>,span:struct<start:bigint,end:bigint>>>"))
    return twice.unionByName(_found(p, "id", {
        "digest": ~is_digest("normalized_text_sha256"), "mode": ~F.col("mode").isin(*MODES), "outcome": ~F.col("outcome").isin(*OUTCOMES),
        "severity": F.exists(d, lambda x: ~F.coalesce(x["severity"].isin(*SEVERITIES), F.lit(False))),
        "span": F.exists(d, lambda x: ~F.coalesce((x["span"]["start"] >= 0) & (x["span"]["start"] <= x["span"]["end"]) & (x["span"]["end"] <= F.col("normalized_byte_count")), F.lit(False))),
        "outcome and diagnostics": (F.col("outcome") == "clean") & (F.size(d) > 0),
    }))


def public_rows(diags: DataFrame) -> DataFrame:
    """Diagnostics without message and evidence."""
    return diags.select("doc_id", "code", "severity", "rules", F.struct("start", "end").alias("span"))


def all_problems(sources: DataFrame, suites: DataFrame, results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.withColumn("part", F.lit(n)) for n, x in (("source", source_problems(sources)), ("suite", suite_problems(suites, sources)), ("result", result_problems(results)))])
