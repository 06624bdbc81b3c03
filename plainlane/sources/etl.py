"""Dictionary ETL: extracted pages and table rows to lexicon entries, as transformations of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pages(texts: DataFrame, col: str = "content") -> DataFrame:
    """(page, text) of a text with form feeds between its pages."""
    return texts.select(F.posexplode(F.split(col, "\f")).alias("page", "text")).select((F.col("page") + 1).alias("page"), "text")


def clean_lines(page_rows: DataFrame, noise: str) -> DataFrame:
    """(page, line_no, line) without blank lines and those that match noise (running headers and footers)."""
    rows = page_rows.select("page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(~F.col("line").rlike(noise) & (F.trim("line") != ""))


#: Pages of a range, in which marks are counted one after another.
RANGE_PAGES = 1024


def numbered(rows: DataFrame, mark: Column, line: str, range_pages: int = RANGE_PAGES, keep_range: bool = False) -> DataFrame:
    """rows (page, line, ...) with n, the marks up to each row in the order of pages and lines: a two-level prefix scan.

    Marks are counted by ranges of pages, the counts (one row a range) are summed in order, and rows are numbered within their
    range (_range, if it is kept). No task holds more than a range; null marks count as none, a null page as before all others.
    """
    place = F.coalesce(F.floor(F.col("page") / range_pages), F.lit(-1 << 40))
    rows = rows.withColumn("_range", place).withColumn("_mark", F.coalesce(mark, F.lit(False)).cast("long"))
    counts = rows.groupBy("_range").agg(F.sum("_mark").alias("_c"))
    before = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    inner = Window.partitionBy("_range").orderBy("page", line).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_n", F.sum("_mark").over(inner)).join(before, "_range").withColumn("n", F.col("_before") + F.col("_n"))
    return both.drop("_mark", "_n", "_before", *([] if keep_range else ["_range"]))


def sections(lines: DataFrame, opener: str, range_pages: int = RANGE_PAGES) -> DataFrame:
    """(section, page, last, text): each line that matches opener starts a section, up to the next such line.

    Lines are shuffled once, to their ranges; only sections that a range begins or ends with meet again.
    """
    rows = numbered(lines, F.col("line").rlike(opener), "line_no", range_pages, keep_range=True).where("n > 0")
    whole = rows.groupBy("_range", "n").agg(F.min("page").alias("page"), F.max("page").alias("last"), F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))).alias("x"))
    own = Window.partitionBy("_range")
    whole = whole.withColumn("edge", (F.col("n") == F.min("n").over(own)) | (F.col("n") == F.max("n").over(own)))
    split = whole.where("edge").groupBy("n").agg(F.min("page").alias("page"), F.max("last").alias("last"), F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    out = whole.where("not edge").select("page", "last", "x").unionByName(split.select("page", "last", "x"))
    text = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return out.select(F.regexp_extract(F.get("x", F.lit(0))["line"], opener, 0).alias("section"), "page", "last", text.alias("text"))


def is_headword(cell: str | Column) -> Column:
    """A word cell that opens an entry: letters first, and a part of speech in parentheses."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return c.rlike("^\\s*[A-Za-z][^(]*\\((n|v|adj|adv|pn|art|prep|con)\\)")


POS = {"n": "noun", "v": "verb", "adj": "adjective", "adv": "adverb", "pn": "pronoun", "art": "article", "prep": "preposition", "con": "conjunction"}


def entries(rows: DataFrame) -> DataFrame:
    """Table rows (page, row_no, word, meaning, good, bad) folded to entries: continued rows belong to the last headword.

    approved: the headword is in capitals. Pages and their order come with the rows."""
    marked = numbered(rows, is_headword("word"), "row_no").withColumnRenamed("n", "entry").where("entry > 0")
    joined = lambda c: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "row_no", F.coalesce(F.trim(c), F.lit("")).alias("x")))), lambda y: y["x"]), " "))
    out = marked.groupBy("entry").agg(joined("word").alias("word_cell"), joined("meaning").alias("meaning"), joined("good").alias("ste_example"), joined("bad").alias("non_ste_example"), F.array_sort(F.collect_set("page")).alias("source_pages"))
    head = F.trim(F.regexp_extract("word_cell", "^([^(]*)\\(", 1))
    pos = F.create_map(*[F.lit(x) for kv in POS.items() for x in kv])[F.regexp_extract("word_cell", "\\(([a-z]+)\\)", 1)]
    forms = F.filter(F.transform(F.split(F.regexp_replace("word_cell", "^[^)]*\\)", ""), "[,;]"), lambda f: F.trim(f)), lambda f: f.rlike("^[A-Za-z][A-Za-z -]*$"))
    return out.select("entry", head.alias("headword"), pos.alias("part_of_speech"), (F.upper(head) == head).alias("approved"), F.array_distinct(F.concat(F.array(head), forms)).alias("forms"), "word_cell", "meaning", "ste_example", "non_ste_example", "source_pages")


def missing_pages(seen: DataFrame, first: int, last: int) -> DataFrame:
    """Pages of a range that no row came from."""
    return seen.sparkSession.range(first, last + 1).toDF("page").join(seen.select(F.col("page").cast("long").alias("page")).distinct(), "page", "left_anti")


def paradigm(forms: Column) -> Column:
    """A verb's paradigm from its sequence of base, present, past and participle forms; fewer give none."""
    at = lambda k: F.get(forms, F.lit(k))
    return F.when(F.size(forms) >= 4, F.struct(F.lit("lexical").alias("classification"), forms.alias("source_sequence"), at(0).alias("base_form"), F.array(at(0), at(1)).alias("simple_present_variants"), F.array(at(2)).alias("simple_past_variants"), at(3).alias("past_participle")))


def compiled_entries(rows: DataFrame) -> DataFrame:
    """entries() as lexicon entries (lexicon.ENTRY, with entry_id): approved verbs of four forms or more get their paradigm."""
    from . import lexicon

    verb = F.col("approved") & (F.col("part_of_speech") == "verb")
    empty = lambda c: F.lit(None).cast(c)
    kinds = {f.name: f.dataType for f in lexicon.starter(rows.sparkSession).schema.fields}
    out = rows.select(
        F.col("headword").alias("lemma"), F.when(F.col("approved"), "approved").otherwise("unapproved").alias("status"), "part_of_speech", "forms",
        F.when(verb, paradigm(F.col("forms"))).cast(kinds["verb_paradigm"]).alias("verb_paradigm"), empty(kinds["senses"]).alias("senses"), empty(kinds["alternatives"]).alias("alternatives"),
        empty(kinds["restrictions"]).alias("restrictions"), F.lit("structural").alias("interpretation_state"),
    )
    return lexicon.with_ids(out)


def authority_problems(entry_rows: DataFrame, manifest: dict, content: DataFrame | None = None) -> DataFrame:
    """(check, expected, actual) of what differs from a manifest: entries, approved and unapproved records, and (with content, a
    binaryFile row) the artifact's bytes and digest."""
    counts = entry_rows.agg(F.count(F.lit(1)).alias("entries"), F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("unapproved"))
    names = ["entries", "approved", "unapproved"]
    if content is not None:
        counts = counts.crossJoin(content.select(F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).limit(1))
        names += ["bytes", "sha256"]
    found = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(str(manifest.get(k))).alias("expected"), F.col(k).cast("string").alias("actual")) for k in names))
    return counts.select(F.explode(found).alias("c")).select("c.*").where("expected <> actual")
