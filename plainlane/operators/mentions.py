"""Mentions of names in texts: every occurrence of every surface, by Aho-Corasick automata, without a bound on words.

Surfaces that all documents share are cut into parts of bounded size; each part is one automaton and one pass over the texts,
so that no task and no broadcast holds more than a part. Surfaces of single documents (context facts) travel in their row.
An occurrence counts if no letter or digit touches it; of overlapping occurrences of one surface the first counts, as when
a text is searched from the end of the last find. Offsets are bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.glossary import normal

#: Bytes of surfaces in one automaton.
PART_BYTES = 8 << 20

_FOUND = "array<struct<surface:string,start:bigint,end:bigint,cs:int,ce:int>>"


def automaton(surfaces: list[str]):
    """An automaton of surfaces, None without any; empty surfaces are left out."""
    import ahocorasick

    made, some = ahocorasick.Automaton(), False
    for s in surfaces:
        if s:
            made.add_word(s, s)
            some = True
    if not some:
        return None
    made.make_automaton()
    return made


def find(made, text: str) -> Iterator[tuple[str, int, int]]:
    """(surface, start, end) in characters, ordered by end; linear in the text and in what is found."""
    last: dict[str, int] = {}
    n = len(text)
    for end, surface in made.iter(text):
        end += 1
        start = end - len(surface)
        if start < last.get(surface, 0):
            continue
        last[surface] = end
        if not (start and text[start - 1].isalnum()) and not (end < n and text[end].isalnum()):
            yield surface, start, end


def _byte_places(text: str, at: list[int]) -> dict[int, int]:
    """The byte offsets of the characters at; one pass over the text."""
    if text.isascii():
        return {i: i for i in at}
    out, done, size = {}, 0, 0
    for i in sorted(set(at)):
        size += len(text[done:i].encode("utf-8", "surrogatepass"))
        out[i] = size
        done = i
    return out


def _rows(text: str | None, made) -> list[dict]:
    if not text or made is None:
        return []
    found = list(find(made, text))
    places = _byte_places(text, [i for _, a, b in found for i in (a, b)])
    return [{"surface": s, "start": places[a], "end": places[b], "cs": a, "ce": b} for s, a, b in found]


def _scanner(surfaces):
    """Adds to each batch (text last) what is found; surfaces: a broadcast list, or None if the second last column holds them."""

    import pyarrow as pa

    number = pa.int64()
    kind = pa.list_(pa.struct([("surface", pa.string()), ("start", number), ("end", number), ("cs", pa.int32()), ("ce", pa.int32())]))

    def run(batches) -> Iterator:
        made = automaton(surfaces.value) if surfaces is not None else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if surfaces is not None:
                found, own = [_rows(t, made) for t in texts], 1
            else:
                found, own = [_rows(t, automaton(s or [])) for t, s in zip(texts, batch.column(batch.num_columns - 2).to_pylist())], 2
            columns = [*(batch.column(k) for k in range(batch.num_columns - own)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: batch.num_columns - own], "found"])

    return run


def _exploded(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode("found").alias("f")).select(*keys, "f.*")


def occurrences(texts: DataFrame, surfaces: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", surface_col: str = "surface", part_bytes: int = PART_BYTES) -> DataFrame:
    """(keys, surface, start, end, cs, ce) of every occurrence of a surface in every text; cs and ce count characters.

    Null texts have none, null and empty surfaces are left out, repeated surfaces count once, repeated rows give theirs each.
    Surfaces come in parts of part_bytes; each is a pass over the texts, without a shuffle.
    """
    spark, keys = texts.sparkSession, list(keys)
    rows = texts.select(*keys, F.col(text_col).alias("text"))
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + f", found {_FOUND}"
    parts, part, size = [], [], 0
    for row in surfaces.select(F.col(surface_col).alias("s")).where("s is not null and s <> ''").distinct().orderBy("s").toLocalIterator():
        part.append(row["s"])
        size += len(row["s"].encode())
        if size >= part_bytes:
            parts.append(spark.sparkContext.broadcast(part))
            part, size = [], 0
    if part or not parts:
        parts.append(spark.sparkContext.broadcast(part))
    return _exploded(reduce(DataFrame.unionAll, [rows.mapInArrow(_scanner(p), schema) for p in parts]), keys)


def own_occurrences(texts: DataFrame, surfaces: DataFrame) -> DataFrame:
    """occurrences() of (doc_id, surface): each document is searched for its own surfaces only."""
    own = surfaces.where("surface is not null and surface <> ''").groupBy("doc_id").agg(F.collect_set("surface").alias("own"))
    rows = texts.select("doc_id", "text").join(own.hint("merge"), "doc_id").select("doc_id", "own", "text")
    return _exploded(rows.mapInArrow(_scanner(None), f"doc_id bigint, found {_FOUND}"), ["doc_id"])


def surfaces_of(entities: DataFrame) -> DataFrame:
    """(doc_id, id, class, source, surface): an entity's canonical name and its forms."""
    have = entities.columns
    surfaces = F.array_distinct(F.concat(F.array("canonical"), F.coalesce("forms", F.array().cast("array<string>"))))
    source = F.col("source") if "source" in have else F.lit(None).cast("string")
    return entities.select("doc_id", "id", "class", source.alias("source"), F.explode(surfaces).alias("surface"))


def placed(found: DataFrame, scanned: DataFrame) -> DataFrame:
    """found (doc_id, start, end, ...) with idx and last, the first and last word inside, and unit, theirs; spans that begin or
    end within a word, hold no word, or whose words are of several units are left out.

    Words and spans meet by the words at which spans begin and end: one merge of both by place, with running values.
    """
    words = scanned.select("doc_id", F.posexplode("tokens").alias("idx", "t")).select("doc_id", "idx", "t.start", "t.end", "t.unit")
    rows = found.withColumn("_id", F.struct("start", "end"))
    spans = rows.select("doc_id", "_id").distinct()
    # events by place: a word's start and end, a span's start and end; the words around each are running values
    word_in = words.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("order"), F.struct("idx", "end", "unit").alias("w"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("s"))
    events = lambda edge, order: spans.select("doc_id", F.col(f"_id.{edge}").alias("at"), F.lit(order).alias("order"), F.lit(None).cast(word_in.schema["w"].dataType).alias("w"), F.col("_id").alias("s"))
    upto = lambda *order: F.last("w", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before, after = upto("at", "order"), upto(F.desc("at"), F.desc("order"))
    # a span's start: the word that starts there or later, and none that started before and goes on; its end likewise
    begins = word_in.unionByName(events("start", 0)).withColumn("prev", before).withColumn("next", after).where("s is not null")
    begins = begins.where("next is not null and (prev is null or prev.end <= at)").select("doc_id", F.col("s").alias("_id"), F.col("next.idx").alias("idx"), F.col("next.unit").alias("unit"))
    ends = word_in.unionByName(events("end", 0)).withColumn("prev", before).where("s is not null and prev is not null and prev.end <= at")
    ends = ends.select("doc_id", F.col("s").alias("_id"), F.col("prev.idx").alias("last"), F.col("prev.unit").alias("last_unit"))
    whole = begins.join(ends, ["doc_id", "_id"]).where("idx <= last and unit = last_unit").drop("last_unit")
    return rows.join(whole, ["doc_id", "_id"]).drop("_id")


def mentions(x) -> DataFrame:
    """(doc_id, start, end, idx, last, unit, kind, identity, surface, class, source) of all mentions, in the order of their places:
    glossary terms (longest, leftmost), named entities of context facts (all occurrences), and official names.

    x are a plan's Inputs; entities come from x.entities, official names from x.occurrences. Of equal official names at one
    place one is kept.
    """
    from . import rules

    none = lambda c: F.lit(None).cast("string").alias(c)
    parts = []
    if x.identities is not None:
        units = x.scanned.select("doc_id", F.posexplode("tokens").alias("idx", "t")).select("doc_id", "idx", F.col("t.unit").alias("unit"))
        terms = rules.mentions(x).join(units.hint("merge"), ["doc_id", "idx"])
        parts.append(terms.select("doc_id", "start", "end", "idx", (F.col("idx") + F.col("width") - 1).alias("last"), "unit", F.lit("term").alias("kind"), F.col("term_id").alias("identity"), F.col("phrase").alias("surface"), none("class"), none("source")))
    texts = x.scanned.select("doc_id", "text")
    if x.entities is not None:
        names = surfaces_of(x.entities)
        at = placed(own_occurrences(texts, names), x.scanned).join(names, ["doc_id", "surface"])
        parts.append(at.select("doc_id", "start", "end", "idx", "last", "unit", F.lit("entity").alias("kind"), F.col("id").alias("identity"), "surface", "class", "source"))
    if x.occurrences is not None and "official_technical_name" in x.occurrences.columns:
        official = placed(x.occurrences.where("official_technical_name").select("doc_id", "start", "end", "source").dropDuplicates(["doc_id", "start", "end"]), x.scanned)
        surface = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("string")
        official = official.join(texts, "doc_id").withColumn("surface", surface)
        parts.append(official.select("doc_id", "start", "end", "idx", "last", "unit", F.lit("official").alias("kind"), normal(F.col("surface")).alias("identity"), "surface", none("class"), "source"))
    if not parts:
        return texts.where("false").select("doc_id", *(F.lit(0).cast(t).alias(c) for c, t in (("start", "long"), ("end", "long"), ("idx", "int"), ("last", "int"), ("unit", "int"))), *map(none, ("kind", "identity", "surface", "class", "source")))
    return reduce(DataFrame.unionByName, parts)
