"""Line dedup with a log-template tree.

Every line goes down a tree of fixed depth: number of tokens, then its first three tokens, where tokens with a digit are
variable fields. A leaf that fewer than MIN_DOCS documents reach holds no recurring template. In the other leaves the
tokens that stand at their place in at least MIN_DOCS documents' lines are constant and all others are variable fields;
a line with the fields blanked is its template. Templates of mostly constant tokens that recur in at least MIN_DOCS
documents are dropped from all of them but the first (least doc_id), so content is lost nowhere. Counting is by
aggregates that combine before they shuffle and count documents, not rows, so no leaf, template or line has to fit one task, and the result does not
depend on order, as that of a tree grown line by line would. Texts meet their line numbers in merge joins at every size.

That is op4, as its SQL has it. The pipeline takes templates() instead, which also knows templates whose constant tokens
are those of a share of the leaf, so that they are the same in a corpus of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from ._common import SPACED, U64, as_long, blocks, column_bytes, mix, read_table, staged, tidied, unstage, word_bounds, word_hashes

DEPTH = 3
MIN_DOCS = 10
#: Templates have at least so many constant tokens of ten.
CONSTANT_OF_TEN = 7
#: templates(): a constant token stands at its place in at least so many of ten of the leaf's lines, and has no digit.
SHARE_OF_TEN = 3
#: templates(): lines that are equal word for word go from so many documents on.
EXACT_DOCS = 3
#: Hot leaves and templates are split into so many parts where they are joined.
SALT = 16
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIELD = U64(0x5851F42D4C957F2D)


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Byte offsets of all lines of all rows, and each row's range of lines; every row has one line more than newlines."""
    ends = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, ends, "right") - 1
    counts = np.bincount(owner, minlength=len(offsets) - 1) + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    starts = np.empty(first[-1] + 1, np.int64)
    starts[first[:-1]] = offsets[:-1]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[:-1][inner] = ends + 1
    starts[-1] = offsets[-1]
    return starts, first


def _parsed(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH):
    """(row, line number, leaf, line hash, words' hashes, words' ranges) of the lines of a block; leaves of a tree of that depth."""
    cuts, first = _lines(data, offsets)
    starts, ends, ranges = word_bounds(data, cuts, SPACED)
    h = word_hashes(data, starts, ends)
    n = np.diff(ranges)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = np.arange(len(n)) - first[row]
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    masked = np.where(digits[ends] > digits[starts], _FIELD, h)
    leaf = mix(n.astype(np.uint64) + U64(1))
    for k in range(depth):
        has = n > k
        at = np.where(has, ranges[:-1] + k, 0)
        leaf = np.where(has, mix(leaf ^ (masked[at] if len(h) else U64(0)) * U64(2 * k + 3)), leaf)
    power, inverse = c._powers(len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))
    line = mix((sums[ranges[1:]] - sums[ranges[:-1]]) * inverse[ranges[:-1]] + n.astype(np.uint64))
    return row, number, leaf, line, h, ranges


def _first_of(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    order = np.lexsort((key, row))
    new = np.ones(len(row), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    out = np.empty(len(row), bool)
    out[order] = new
    return out


def _parse(batches, up: bool = False) -> Iterator:
    """The lines that have words; with up also the node above each leaf."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for i, j in blocks(offsets):
            row, number, leaf, line, _, ranges = _parsed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keep = np.diff(ranges) > 0
            above = _parsed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], DEPTH - 1)[2][keep] if up else None
            row, number, leaf, line = row[keep], number[keep], leaf[keep], line[keep]
            if len(row):
                yield pa.record_batch(
                    [pa.array(ids[i:j][row]), pa.array(number.astype(np.int32)), pa.array(as_long(leaf)), pa.array(as_long(line)), pa.array(_first_of(row, leaf)), pa.array(_first_of(row, line)), *([pa.array(as_long(above))] if up else [])],
                    names=["doc_id", "number", "leaf", "line", "new_leaf", "new_line", *(["up"] if up else [])],
                )


def _tokens(batches, marked: bool = False) -> Iterator:
    """(leaf, line, tokens) of the wanted lines of each text; marked tokens are odd if they have a digit, else even."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = column_bytes(batch.column(0))
        wanted = batch.column(1)
        for i, j in blocks(offsets):
            part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            row, number, leaf, line, h, ranges = _parsed(part, cuts)
            if marked:
                starts, ends, _ = word_bounds(part, _lines(part, cuts)[0], SPACED)
                digits = np.concatenate(([0], np.cumsum(_DIGIT[part])))
                h = h & ~U64(1) | (digits[ends] > digits[starts]).astype(np.uint64)
            lists = wanted.slice(i, j - i)
            want_row = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
            first = np.searchsorted(row, np.arange(j - i))
            at = first[want_row] + lists.flatten().to_numpy()
            if len(at):
                n = np.diff(ranges)[at]
                words = h[c.ragged(ranges[at], n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(as_long(words)))
                yield pa.record_batch([pa.array(as_long(leaf[at])), pa.array(as_long(line[at])), lists], names=["leaf", "line", "tokens"])


def _salted(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """big joined with small, the keys of big split by a hash of column by."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    return big.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(small.select("*", parts), [*on, "salt"], how).drop("salt")


def _sizes(lines: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, size): leaves of min_docs documents or more, with the number of their lines (equal ones of a document once)."""
    each = lines.groupBy("leaf", "doc_id").agg(F.count_distinct("line").alias("size"))
    return each.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size")).where(F.col("docs") >= min_docs).select("leaf", "size")


def _kinds(lines: DataFrame, *more: str) -> DataFrame:
    """(leaf, line, docs, at, more...): how many documents hold each line of each leaf, whatever the rows that repeat them."""
    each = lines.groupBy("leaf", "line", "doc_id").agg(F.min("number").alias("number"), *(F.max(c).alias(c) for c in more))
    return each.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "number")).alias("at"), *(F.max(c).alias(c) for c in more))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, numbers): the numbers (from 0) of the lines that a document loses; rows for such documents only."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    lines = staged(texts.mapInArrow(tidied(_parse), "doc_id long, number int, leaf long, line long, new_leaf boolean, new_line boolean").drop("new_line"), "lines")
    # rows that repeat a document may lift a leaf over min_docs here; its templates are counted by documents below
    leaves = lines.where("new_leaf").groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    mine = staged(_salted(lines.drop("new_leaf"), leaves, ["leaf"], "doc_id"), "leaf-lines")
    kinds = staged(_kinds(mine), "kinds")
    wanted = kinds.groupBy("at.doc_id").agg(F.array_sort(F.collect_list("at.number")).alias("numbers"))
    tokens = texts.join(wanted.hint("merge"), "doc_id").select("text", "numbers").mapInArrow(tidied(_tokens), "leaf long, line long, tokens array<long>").dropDuplicates(["leaf", "line"])
    tokens = staged(tokens.join(kinds.select("leaf", "line", "docs"), ["leaf", "line"]), "tokens")
    places = tokens.select("leaf", "line", "docs", F.posexplode("tokens").alias("at", "token"))
    constant = places.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "at", "token", F.lit(1).alias("fixed"))
    blanked = places.join(constant, ["leaf", "at", "token"], "left").groupBy("leaf", "line").agg(
        F.count(F.lit(1)).alias("n"), F.count("fixed").alias("n_fixed"),
        F.bit_xor(F.when(F.col("fixed") == 1, F.xxhash64("at", "token"))).alias("x"),
        F.sum(F.when(F.col("fixed") == 1, F.xxhash64("token", "at").cast("decimal(38,0)"))).alias("y"),
    )
    templates = blanked.where(F.col("n_fixed") * 10 >= F.col("n") * CONSTANT_OF_TEN).select("leaf", "line", F.sha2(F.concat_ws(",", "leaf", "n_fixed", "x", "y"), 256).substr(1, 32).alias("template"))
    found = staged(_salted(mine, templates, ["leaf", "line"], "doc_id").select("doc_id", "number", "template"), "templated")
    recurring = found.select("template", "doc_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    lost = staged(_salted(found, recurring, ["template"], "doc_id").where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("number").alias("numbers")), "lost")
    unstage(lines, mine, kinds, tokens, found)
    return lost


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS) -> DataFrame:
    """(doc_id, numbers) as recurring_lines() has them, of templates by share.

    A token is constant if it has no digit and stands at its place in SHARE_OF_TEN of ten of the leaf's lines (equal lines
    of a document count once). It must also reach min_docs, for a template with a rarer one cannot recur. Tokens with a
    digit are fields for sure, those without may be prose: constant tokens (one at least) and tokens with a digit together
    are at least CONSTANT_OF_TEN of ten. Lines of leaves of fewer than min_docs documents meet in the node above, their
    third token a field. Lines whose template by share is no template take the one of recurring_lines(), never the coarser
    of the two. Equal lines need no template: they go from exact_docs documents on.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    lines = staged(texts.mapInArrow(tidied(partial(_parse, up=True)), "doc_id long, number int, leaf long, line long, new_leaf boolean, new_line boolean, up long"), "lines")
    leaves = _sizes(lines, min_docs)
    placed = staged(_salted(lines.drop("new_leaf", "new_line"), leaves, ["leaf"], "doc_id", "left"), "placed")
    rest = placed.where("size is null").select("doc_id", "number", F.col("up").alias("leaf"), "line")
    above = _sizes(rest, min_docs)
    mine = staged(placed.where("size is not null").drop("up").unionByName(_salted(rest, above, ["leaf"], "doc_id")), "leaf-lines")
    kinds = staged(_kinds(mine, "size"), "kinds")
    wanted = kinds.groupBy("at.doc_id").agg(F.array_sort(F.collect_list("at.number")).alias("numbers"))
    tokens = texts.join(wanted.hint("merge"), "doc_id").select("text", "numbers").mapInArrow(tidied(partial(_tokens, marked=True)), "leaf long, line long, tokens array<long>").select("line", "tokens").dropDuplicates(["line"])
    tokens = staged(tokens.join(kinds.drop("at"), "line"), "tokens")
    places = tokens.select("leaf", "line", "docs", "size", F.posexplode("tokens").alias("at", "token"))
    constant = places.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs"), F.max("size").alias("size")).where(F.col("docs") >= min_docs)
    shared = (F.col("token") % 2 == 0) & (F.col("docs") * 10 >= F.col("size") * SHARE_OF_TEN)
    constant = constant.select("leaf", "at", "token", F.lit(True).alias("fixed"), shared.alias("shared"))
    x, y = F.xxhash64("at", "token"), F.xxhash64("token", "at").cast("decimal(38,0)")
    blanked = places.join(constant, ["leaf", "at", "token"], "left").groupBy("leaf", "line").agg(
        F.count(F.lit(1)).alias("n"), *(f for k in ("fixed", "shared") for f in (F.count_if(k).alias(f"n_{k}"), F.bit_xor(F.when(F.col(k), x)).alias(f"x_{k}"), F.sum(F.when(F.col(k), y)).alias(f"y_{k}"))),
        F.count_if(F.col("token") % 2 != 0).alias("n_digit"),
    )
    key = lambda k: F.sha2(F.concat_ws(",", F.lit(k), "leaf", f"n_{k}", f"x_{k}", f"y_{k}"), 256).substr(1, 32)
    enough = lambda n: n * 10 >= F.col("n") * CONSTANT_OF_TEN
    named = blanked.select("leaf", "line", F.when((F.col("n_shared") > 0) & enough(F.col("n_shared") + F.col("n_digit")), key("shared")).when(enough(F.col("n_fixed")), key("fixed")).alias("template")).where("template is not null")
    found = staged(_salted(mine.drop("size"), named, ["leaf", "line"], "doc_id").select("doc_id", "number", "template"), "templated")
    recurring = found.select("template", "doc_id").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    gone = _salted(found, recurring, ["template"], "doc_id").where("doc_id <> first").select("doc_id", "number")
    equal = placed.groupBy("line", "doc_id").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= exact_docs).select("line", "first")
    gone = gone.unionByName(_salted(placed, equal, ["line"], "doc_id").where("doc_id <> first").select("doc_id", "number"))
    lost = staged(gone.groupBy("doc_id").agg(F.collect_set("number").alias("numbers")), "lost")
    unstage(lines, placed, mine, kinds, tokens, found)
    return lost


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, keep_text: bool = True, lost_lines: Callable[..., DataFrame] = recurring_lines) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept): every document without its recurring lines.

    Lines end at newlines; lines without words count in n_lines but are kept always. Null and empty texts have one empty
    line and lose nothing (a null text gives an empty kept); rows of null id lose nothing and count for nothing. Rows
    repeated whole count as one document and are all returned; ids should be unique otherwise. An empty table gives an
    empty one; other columns are not looked at. keep_text=False leaves kept null. lost_lines is
    recurring_lines or templates. Texts are cut by Column expressions, in time linear in their lines.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lost = lost_lines(docs, id_col, text_col, min_docs)
    both = texts.join(lost.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "numbers")
    lines = both.withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("numbers"))
    left = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n"))
    cut = lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("numbers").isNull(), 0).otherwise(F.size("numbers")).cast("long").alias("n_dropped"), left.alias("kept"))
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_lines", "n_dropped", digest, F.col("kept") if keep_text else F.lit(None).cast("string").alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring(read_table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS number FROM d),
l AS (SELECT doc_id, line, number, w, CAST(len(w) AS VARCHAR) || ' ' || array_to_string(list_transform(w[1:{DEPTH}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS leaf, array_to_string(w, ' ') AS k
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM raw) WHERE len(w) > 0),
leaves AS (SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
mine AS (SELECT l.* FROM l SEMI JOIN leaves USING (leaf)),
kinds AS (SELECT leaf, k, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM mine GROUP BY leaf, k),
places AS (SELECT leaf, k, docs, unnest(w) AS token, unnest(range(0, len(w))) AS place FROM kinds),
fixed AS (SELECT leaf, place, token FROM places GROUP BY leaf, place, token HAVING sum(docs) >= {MIN_DOCS}),
blanked AS (
  SELECT p.leaf, p.k, count(*) AS n, count(f.token) AS n_fixed, string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE 'w' || p.token END, ' ' ORDER BY p.place) AS template
  FROM places p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.place = f.place AND p.token = f.token GROUP BY p.leaf, p.k),
found AS (SELECT m.doc_id, m.number, m.leaf || ':' || b.template AS template FROM mine m JOIN blanked b ON m.leaf = b.leaf AND m.k = b.k WHERE b.n_fixed * 10 >= b.n * {CONSTANT_OF_TEN}),
rec AS (SELECT template, min(doc_id) AS first FROM found GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
lost AS (SELECT DISTINCT doc_id, number FROM found JOIN rec USING (template) WHERE doc_id <> first),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.number) AS t, count(*) AS n FROM raw r ANTI JOIN lost USING (doc_id, number) GROUP BY r.doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(kept.n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
