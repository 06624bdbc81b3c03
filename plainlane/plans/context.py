"""Context facts: reader, validation, and the count groups that facts and terms add."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.glossary import normal

_AT = "start bigint, end bigint"
OCCURRENCE = f"{_AT}, source string, dictionary_meaning string, technical_noun_scope string, spelling string, official_technical_name boolean, count_group string, text_authority string, hyphen_direct_relation boolean, parenthesis_use string, phrasal_verb boolean"
_N = "struct<kind:string,start:bigint,end:bigint>"
_S = "struct<start:bigint,end:bigint>"


def _inner(ddl: str) -> str:
    return ", ".join(f"{a}:{b}" for a, b in (x.strip().split(" ", 1) for x in ddl.split(",")))


DOCUMENT = (
    f"doc_id bigint, occurrences array<struct<{_inner(OCCURRENCE)}>>, "
    "named_entities array<struct<id:string,canonical:string,class:string,forms:array<string>,source:string>>, "
    "measurement_units array<struct<id:string,canonical:string,forms:array<string>,source:string>>, "
    "topics array<struct<start:bigint,end:bigint,topic:string,source:string>>, "
    f"semantic_orderings array<struct<before:{_N},after:{_N},source:string>>, "
    f"safety_facts array<struct<start:bigint,end:bigint,source:string,safety_level:string,actor:{_S},command:{_S},hazard:{_S},consequence:{_S}>>"
)
FACTS = {"occurrences": "occurrences", "entities": "named_entities", "measurement_units": "measurement_units", "topics": "topics", "orderings": "semantic_orderings", "safety_facts": "safety_facts"}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Fact tables of context documents, one JSON line for each document (with its doc_id)."""
    return tables(spark.read.schema(DOCUMENT).json(path))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    return {k: rows.select("doc_id", F.explode(c).alias("f")).select("doc_id", "f.*") for k, c in FACTS.items()}


#: Count group of each text authority; numbering counts as no word.
AUTHORITY = {"quoted": "quoted", "formula": "quoted", "title": "title", "placard": "placard", "label": "label", "numbering": "document_numbering_excluded"}
#: Count group of each class of named entity.
CLASSES = {"person": "proper_noun", "organization": "proper_noun", "place": "proper_noun", "product": "proper_noun", "identifier": "identifier", "title": "title"}


def _chars(rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """Adds character offsets to byte spans (doc_id, start, end, kind)."""
    text = scanned.select("doc_id", F.col("text").cast("binary").alias("b"))
    cut = lambda e: F.length(F.substring(F.col("b"), F.lit(1), e.cast("int")).cast("string")).cast("int")
    return rows.join(text, "doc_id").select("doc_id", F.struct("kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), cut(F.col("start")).alias("cs"), cut(F.col("end")).alias("ce")).alias("g"))


def groups(scanned: DataFrame, context: dict[str, DataFrame], names_: DataFrame | None) -> DataFrame | None:
    """(doc_id, groups) from occurrences (count_group, text_authority), named entities and abbreviations of the glossary (names_),
    whatever their length."""
    from ..operators import matching, mentions

    parts = []
    o = context.get("occurrences")
    if o is not None:
        pick = lambda m, c: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[F.col(c)]
        if "count_group" in o.columns:
            parts.append(o.where("count_group is not null").select("doc_id", "start", "end", F.col("count_group").alias("kind")))
        if "text_authority" in o.columns:
            parts.append(o.select("doc_id", "start", "end", pick(AUTHORITY, "text_authority").alias("kind")).where("kind is not null"))
    e = context.get("entities")
    if e is not None:
        names = mentions.surfaces_of(e)
        found = mentions.placed(mentions.own_occurrences(scanned.select("doc_id", "text"), names), scanned).join(names, ["doc_id", "surface"])
        kind = F.coalesce(F.create_map(*[x for k, v in CLASSES.items() for x in (F.lit(k), F.lit(v))])[F.col("class")], F.lit("proper_noun"))
        parts.append(found.select("doc_id", "start", "end", kind.alias("kind")))
    if names_ is not None:
        short = names_.where("alias_kind in ('abbreviation', 'acronym')").select(F.col("identity").alias("phrase"))
        widest = short.agg(F.max(F.size(F.split("phrase", " ")))).first()[0]
        if widest:
            parts.append(matching.phrases(scanned, widest, "tokens", spaced=True).join(short, "phrase").select("doc_id", "start", "end", F.lit("abbreviation").alias("kind")))
    if not parts:
        return None
    return _chars(reduce(DataFrame.unionByName, parts), scanned).groupBy("doc_id").agg(F.collect_list("g").alias("groups"))


def validate(context: dict[str, DataFrame], scanned: DataFrame) -> DataFrame:
    """(doc_id, problem, start, end): spans outside of their text, overlapping occurrences, blank sources and topics,
    entity surfaces that two entities claim."""
    size = scanned.select("doc_id", F.octet_length("text").alias("size"))
    out = []
    for name in ("occurrences", "topics", "safety_facts"):
        if (f := context.get(name)) is not None:
            outside = f.join(size, "doc_id", "left").where("size is null or start < 0 or start >= end or end > size")
            out.append(outside.select("doc_id", F.lit(f"{name}: outside the text").alias("problem"), "start", "end"))
            if "source" in f.columns:
                out.append(f.where("trim(coalesce(source, '')) = ''").select("doc_id", F.lit(f"{name}: no source").alias("problem"), "start", "end"))
    if (o := context.get("occurrences")) is not None:
        w = Window.partitionBy("doc_id").orderBy("start", "end")
        out.append(o.withColumn("prev", F.lag("end").over(w)).where("start < prev").select("doc_id", F.lit("occurrences: overlap").alias("problem"), "start", "end"))
    if (t := context.get("topics")) is not None:
        out.append(t.where("trim(coalesce(topic, '')) = ''").select("doc_id", F.lit("topics: blank").alias("problem"), "start", "end"))
    if (e := context.get("entities")) is not None:
        s = e.select("doc_id", "id", F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical"), F.coalesce("forms", F.array().cast("array<string>"))), normal))).alias("surface"))
        clash = s.groupBy("doc_id", "surface").agg(F.count_distinct("id").alias("n")).where("n > 1")
        out.append(clash.select("doc_id", F.concat(F.lit("entities: two claim "), "surface").alias("problem"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")))
    return reduce(DataFrame.unionByName, out)
