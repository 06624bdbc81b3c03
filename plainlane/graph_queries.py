"""Queries of mentions, antecedents, orders and nesting over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import arrays, graph, mentions, nesting
from .sources import etl, tables

#: Surfaces are the benchmark's words of six letters or more, and the first eight words of each item as one name.
_WORD, _NAME = "[A-Za-z]{6,}", r"^\S+(?: \S+){7}"
_SURFACES = rf"""surfaces AS (SELECT DISTINCT s FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS s FROM benchmark UNION ALL SELECT regexp_extract(text, '{_NAME}') FROM benchmark) WHERE s <> '')"""


def _places(rows: str, surfaces: str, keys: str) -> str:
    """Occurrences by splitting each text at each surface that it contains."""
    return rf"""SELECT {keys}, s, CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + (i - 1) * strlen(s) AS BIGINT) AS start, CAST(list_sum(list_transform(p[1:i], lambda x: strlen(x))) + i * strlen(s) AS BIGINT) AS e
  FROM (SELECT *, unnest(range(1, len(p))) AS i FROM (SELECT {keys}, s, string_split(text, s) AS p FROM {rows} JOIN {surfaces} ON contains(text, s)))
  WHERE NOT regexp_matches(CASE WHEN p[i] <> '' THEN p[i] WHEN i > 1 THEN s ELSE '' END, '[\p{{L}}\p{{N}}]$')
    AND NOT regexp_matches(CASE WHEN p[i + 1] <> '' THEN p[i + 1] WHEN i + 1 < len(p) THEN s ELSE '' END, '^[\p{{L}}\p{{N}}]')"""


def _surfaces(spark: SparkSession, d: str) -> DataFrame:
    t = tables.read(spark, d, "benchmark")
    words = t.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("surface"))
    return words.union(t.select(F.regexp_extract("text", _NAME, 0))).where("surface <> ''").distinct()


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """All occurrences of the benchmark's words and names in the documents."""
    found = mentions.occurrences(tables.spread(tables.read(spark, d, "documents")).select("doc_id", "text"), _surfaces(spark, d))
    return found.select("doc_id", "surface", "start", F.col("end").alias("stop"))


_MENTIONS = f"""WITH {_SURFACES} SELECT doc_id, s AS surface, start, e AS stop FROM ({_places('documents', 'surfaces', 'doc_id')})"""


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, at, text): lines with the bytes before them."""
    cut = docs.select("doc_id", F.split("text", "\n").alias("parts"))
    ends = arrays.running_sums(F.transform("parts", lambda p: F.octet_length(p).cast("bigint") + 1))
    rows = cut.withColumn("ends", ends).select("doc_id", F.posexplode(F.arrays_zip("parts", "ends")).alias("unit", "x"))
    return rows.select("doc_id", "unit", (F.col("x.ends") - F.octet_length("x.parts") - 1).alias("at"), F.col("x.parts").alias("text"))


def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each it and its of the documents with the node of the mention that it refers to, in its line or else in the line before (-1
    unless there is one)."""
    lines = _lines(tables.spread(tables.read(spark, d, "documents")))
    at = lambda rows, name: rows.select("doc_id", "unit", (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"), F.col("surface").alias(name))
    keys = ("doc_id", "unit", "at")
    m = at(mentions.occurrences(lines, _surfaces(spark, d), keys), "identity")
    p = at(mentions.occurrences(lines, spark.createDataFrame([(w,) for w in graph.PRONOUNS], "surface string"), keys), "pronoun")
    return graph.reference_edges(p, m).select("doc_id", "start", "state", F.coalesce("entity", F.lit(-1)).alias("entity"))


_REFERENCES = f"""WITH {_SURFACES},
cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unit - 1 AS unit, CAST(strlen(array_to_string(parts[1:unit - 1], chr(10))) + CASE WHEN unit > 1 THEN 1 ELSE 0 END AS BIGINT) AS base, parts[unit] AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS unit FROM cut)),
m AS (SELECT doc_id, unit, s AS identity, start + base AS start, e + base AS e FROM ({_places('lines', 'surfaces', 'doc_id, unit, base')})),
p AS (SELECT doc_id, unit, start + base AS start FROM ({_places('lines', "(SELECT unnest(['it', 'its']) AS s)", 'doc_id, unit, base')})),
nodes AS (SELECT doc_id, identity, start, row_number() OVER (PARTITION BY doc_id ORDER BY start, e, identity) - 1 AS entity FROM m),
firsts AS (SELECT doc_id, unit, identity, min(e) AS e, min(start) AS start FROM m GROUP BY ALL),
own AS (SELECT p.doc_id, p.start, count(*) AS n, any_value(f.identity) AS identity, any_value(f.start) AS m_start FROM p JOIN firsts f ON f.doc_id = p.doc_id AND f.unit = p.unit AND f.e <= p.start GROUP BY ALL),
prev AS (SELECT p.doc_id, p.start, count(*) AS n, any_value(f.identity) AS identity, any_value(f.start) AS m_start FROM p JOIN firsts f ON f.doc_id = p.doc_id AND f.unit = p.unit - 1 GROUP BY ALL),
found AS (SELECT p.doc_id, p.start, coalesce(own.n, prev.n, 0) AS n, CASE WHEN own.n IS NULL THEN prev.identity ELSE own.identity END AS identity, CASE WHEN own.n IS NULL THEN prev.m_start ELSE own.m_start END AS m_start
  FROM p LEFT JOIN own ON own.doc_id = p.doc_id AND own.start = p.start LEFT JOIN prev ON prev.doc_id = p.doc_id AND prev.start = p.start)
SELECT f.doc_id, f.start, CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CAST(coalesce(entity, -1) AS INTEGER) AS entity
FROM found f LEFT JOIN nodes k ON n = 1 AND k.doc_id = f.doc_id AND k.identity = f.identity AND k.start = f.m_start"""


def order_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Names that each conversation mentions in both orders: steps from one mention to the next that lie on a cycle."""
    turns = tables.spread(tables.read(spark, d, "conversations")).select("conv_id", "turn", "text")
    found = mentions.occurrences(turns, _surfaces(spark, d), ("conv_id", "turn"))
    visits = tables.staged(found.select(F.col("conv_id").alias("doc_id"), "turn", "start", "end", F.col("surface").alias("name")), "visits")
    return graph.walk_contradictions(visits, "turn").select(F.col("doc_id").alias("conv_id"), "a", "b")


_ORDERS = f"""WITH RECURSIVE {_SURFACES},
m AS ({_places('conversations', 'surfaces', 'conv_id, turn')}),
steps AS (SELECT DISTINCT conv_id, a, b FROM (SELECT conv_id, s AS a, lead(s) OVER (PARTITION BY conv_id ORDER BY turn, start, e, s) AS b FROM m) WHERE b IS NOT NULL AND a <> b),
reach AS (SELECT conv_id, a, b FROM steps UNION SELECT r.conv_id, r.a, s.b FROM reach r JOIN steps s ON s.conv_id = r.conv_id AND s.a = r.b)
SELECT s.conv_id, s.a, s.b FROM steps s JOIN reach r ON r.conv_id = s.conv_id AND r.a = s.b AND r.b = s.a"""

#: Elements that do not nest in themselves: what opens and closes them.
_ELEMENTS = {"ul": ("<ul>", "</ul>"), "li": ("<li>", "</li>"), "nav": ("<nav>", "</nav>"), "a": ("<a ", "</a>"), "article": ("<article>", "</article>"), "div": ('<div class="ad">', "</div>"), "h1": ("<h1>", "</h1>"), "b": ("<b>", "</b>")}


def nested_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the pages with the smallest element around each; kinds whose marks do not pair up in a page are left out."""
    pages = tables.spread(tables.read(spark, d, "pages")).select("page_id", "html")

    def marks(mark: str):
        sums = arrays.running_sums(F.transform(F.split("html", mark), lambda p: F.octet_length(p).cast("bigint") + len(mark)))
        return F.slice(sums, 1, F.size(sums) - 1)

    def elements(kind: str, opener: str, closer: str):
        a, b = marks(opener), marks(closer)
        span = lambda x: F.struct(F.lit(kind).alias("kind"), (x["a"] - len(opener)).alias("start"), x["b"].alias("end"))
        return F.when(F.size(a) == F.size(b), F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), span))

    pairs = [elements(k, a, b) for k, (a, b) in _ELEMENTS.items()]
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    spans = pages.select("page_id", F.explode(F.flatten(F.array(*[F.coalesce(p, none) for p in pairs]))).alias("s")).select("page_id", "s.*").where("start < end")
    out = nesting.innermost(spans, spans, "page_id")
    return out.select("page_id", "kind", "start", F.col("end").alias("stop"), F.coalesce("holder.kind", F.lit("")).alias("holder"), F.coalesce("holder.start", F.lit(-1)).alias("holder_start"))


def _nested_sql() -> str:
    at = lambda mark: f"list_transform(range(1, len(string_split(html, '{mark}'))), lambda i: CAST(strlen(array_to_string(string_split(html, '{mark}')[1:i], '{mark}')) + {len(mark)} AS BIGINT))"
    kinds = " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, {len(a)} AS n, {at(a)} AS a, {at(b)} AS b FROM pages" for k, (a, b) in _ELEMENTS.items())
    return f"""WITH k AS ({kinds}),
s AS (SELECT page_id, kind, a[i] - n AS start, b[i] AS stop FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM k WHERE len(a) = len(b)) WHERE a[i] - n < b[i]),
h AS (SELECT x.page_id, x.kind, x.start, x.stop, coalesce(y.kind, '') AS holder, coalesce(y.start, -1) AS holder_start FROM s x LEFT JOIN s y ON y.page_id = x.page_id AND y.start < x.start AND x.stop <= y.stop
  QUALIFY row_number() OVER (PARTITION BY x.page_id, x.kind, x.start, x.stop ORDER BY y.stop - y.start, y.start) = 1)
SELECT * FROM h"""


#: Lines of pages: a line ends after each mark's end. Closing marks are noise; headings and list items open sections.
_NOISE, _OPENER = "^</", "<(h1|li)>"


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the pages read as one book, from each heading or list item to the next, over the ends of pages."""
    pages = tables.spread(tables.read(spark, d, "pages")).select(F.col("page_id").alias("page"), F.regexp_replace("html", ">", ">\n").alias("text"))
    out = etl.sections(etl.clean_lines(pages, _NOISE), _OPENER, range_pages=64)
    return out.select("section", "page", "last", F.sha2("text", 256).alias("sha256"))


_SECTIONS = f"""WITH l AS (SELECT page_id AS page, unnest(string_split(replace(html, '>', '>' || chr(10)), chr(10))) AS line, unnest(range(0, len(string_split(replace(html, '>', '>' || chr(10)), chr(10))))) AS line_no FROM pages),
k AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_OPENER}') THEN 1 ELSE 0 END) OVER (ORDER BY page, line_no) AS n FROM l WHERE NOT regexp_matches(line, '{_NOISE}') AND trim(line) <> '')
SELECT regexp_extract(arg_min(line, (page, line_no)), '{_OPENER}') AS section, min(page) AS page, max(page) AS last, sha256(string_agg(line, chr(10) ORDER BY page, line_no)) AS sha256 FROM k WHERE n > 0 GROUP BY n"""


QUERIES = {
    "page_sections": (page_sections, _SECTIONS),
    "entity_mentions": (entity_mentions, _MENTIONS),
    "reference_edges": (reference_edges, _REFERENCES),
    "order_contradictions": (order_contradictions, _ORDERS),
    "nested_elements": (nested_elements, _nested_sql),
}
