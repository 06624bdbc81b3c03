"""Terminology: readers of both document layouts, the identity table, integrity checks and composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERM = "id string, canonical string, roles array<string>, definition string, forms array<struct<text:string, roles:array<string>>>, aliases array<struct<text:string, kind:string>>, sources array<struct<source:string, supports:array<string>>>, status string, replacement string, examples array<string>"
_IN = TERM.replace(" string", ":string").replace(" array", ":array")
DOCUMENT = f"schema string, domain string, profile struct<id:string, version:int, domain:string, description:string>, sources map<string, struct<title:string, url:string, reviewed_on:string>>, terms array<struct<{_IN}, term:string, kind:string, domain:string, preferred:boolean, provenance:array<string>>>"
NAMES = [x.split()[0] for x in ("id string", "canonical string", "roles x", "definition x", "forms x", "aliases x", "sources x", "status x", "replacement x", "examples x")]
SCHEMAS = ("ste-glossary/v2", "ste-profile/v1", "terminology/v2")


def normal(c) -> F.Column:
    """An identity: ASCII white space collapsed, lower case."""
    return F.lower(F.array_join(F.filter(F.split(c, "[ \\t\\n\\f\\r]+"), lambda w: w != ""), " "))


def stable_id(c) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(doc_schema, known_sources, ordinal, term columns) of terminology documents of either layout.

    The older layout names terms by term, kind (a role), plain-text forms and provenance.
    """
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    t = doc.select("schema", F.map_keys("sources").alias("known_sources"), F.posexplode("terms").alias("ordinal", "t"))
    legacy = F.col("schema").isNull()
    return t.select(
        F.col("schema").alias("doc_schema"), F.coalesce("known_sources", F.array().cast("array<string>")).alias("known_sources"), "ordinal",
        F.when(legacy, stable_id(F.col("t.term"))).otherwise(F.col("t.id")).alias("id"),
        F.when(legacy, F.col("t.term")).otherwise(F.col("t.canonical")).alias("canonical"),
        F.when(legacy, F.array(F.col("t.kind"))).otherwise(F.col("t.roles")).alias("roles"),
        *(F.col(f"t.{c}").alias(c) for c in NAMES[3:]),
    )


def terms_frame(spark: SparkSession, terms: list[dict], known_sources: list[str] = (), schema: str = "terminology/v2") -> DataFrame:
    """The same table from Python records."""
    rows = [(schema, list(known_sources), i, *(t.get(c) for c in NAMES)) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, f"doc_schema string, known_sources array<string>, ordinal int, {TERM}")


def identities(terms: DataFrame) -> DataFrame:
    """(identity, term_id, ordinal, kind, alias_kind, roles, status, canonical, replacement, width): every name of every term."""
    e = lambda c, t: F.coalesce(c, F.array().cast(t))
    canonical = F.array(F.struct(F.col("canonical").alias("text"), F.lit("canonical").alias("kind"), F.lit(None).cast("string").alias("alias_kind"), F.col("roles").alias("own")))
    alias = F.transform(e(F.col("aliases"), "array<struct<text:string,kind:string>>"), lambda a: F.struct(a["text"].alias("text"), F.lit("alias").alias("kind"), a["kind"].alias("alias_kind"), F.col("roles").alias("own")))
    form = F.transform(e(F.col("forms"), "array<struct<text:string,roles:array<string>>>"), lambda a: F.struct(a["text"].alias("text"), F.lit("form").alias("kind"), F.lit(None).cast("string").alias("alias_kind"), a["roles"].alias("own")))
    rows = terms.select("id", "ordinal", "status", "canonical", "replacement", F.posexplode(F.concat(canonical, alias, form)).alias("place", "n"))
    out = rows.select(normal(F.col("n.text")).alias("identity"), F.col("id").alias("term_id"), "ordinal", "place", "n.kind", "n.alias_kind", F.col("n.own").alias("roles"), "status", "canonical", "replacement")
    return out.withColumn("width", F.size(F.split("identity", " ")))


def compiled(terms: DataFrame) -> DataFrame:
    """One row an identity: the first claim wins."""
    w = Window.partitionBy("identity").orderBy("ordinal", "place")
    return identities(terms).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def integrity(terms: DataFrame) -> DataFrame:
    """(code, term_id, detail): what is wrong with a terminology, each (code, detail) once."""
    first = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("ordinal"))
    e = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    out = lambda rows, code, detail: rows.select(F.lit(code).alias("code"), F.col("id").alias("term_id"), detail.cast("string").alias("detail"))
    role = F.exists(F.coalesce("forms", F.array().cast("array<struct<text:string,roles:array<string>>>")), lambda f: (F.size(e(f["roles"])) == 0) | (F.size(F.array_except(f["roles"], e(F.col("roles")))) > 0))
    uses = terms.select("id", "known_sources", F.explode("sources").alias("s"))
    ids = terms.select(F.col("id").alias("target")).distinct()
    replaced = terms.where("replacement is not null").join(ids, F.col("replacement") == F.col("target"), "left")
    w = Window.partitionBy("identity").orderBy("ordinal", "place")
    claims = identities(terms).withColumns({"n": F.row_number().over(w), "owner": F.first("term_id").over(w)})
    parts = [
        out(terms.where(~F.coalesce(F.col("doc_schema").isin(*SCHEMAS), F.lit(True))).dropDuplicates(["doc_schema"]), "TERM-SCHEMA-001", F.col("doc_schema")),
        out(terms.withColumn("n", first("id")).where("n > 1"), "TERM-STABLE-ID-001", F.col("id")),
        out(terms.withColumn("k", normal(F.col("canonical"))).withColumn("n", first("k")).where("n > 1"), "TERM-DUP-001", F.col("k")),
        out(terms.where(F.size(e(F.col("roles"))) == 0), "TERM-ROLE-001", F.col("id")),
        out(terms.where(role), "TERM-FORM-001", F.col("id")),
        out(uses.where(~F.array_contains("known_sources", F.col("s.source"))), "TERM-SOURCE-001", F.col("s.source")),
        out(replaced.where("target is null or status <> 'deprecated'"), "TERM-REPLACEMENT-001", F.col("replacement")),
        out(claims.where("n > 1").withColumn("id", F.col("term_id")), "TERM-ID-CONFLICT-001", F.col("identity")),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["code", "detail"])


def compose(*glossaries: DataFrame) -> DataFrame:
    """All terms together; raises if the whole has integrity problems (nothing overrides anything)."""
    spark = glossaries[0].sparkSession
    numbered = [g.withColumn("ordinal", F.col("ordinal") + F.lit(k * 1_000_000)) for k, g in enumerate(glossaries)]
    whole = reduce(DataFrame.unionByName, numbered)
    bad = integrity(whole).limit(5).collect()
    if bad:
        raise ValueError("the glossaries do not compose: " + ", ".join(f"{r['code']} {r['detail']}" for r in bad))
    assert spark
    return whole
