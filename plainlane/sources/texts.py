"""Files of text in, diagnostics and fixed texts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(doc_id, path, text, valid): one row for each file under path, whole; valid tells whether it is UTF-8 (text is null else).

    doc_id is a hash of the path, so that it does not depend on what else is read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.when(valid, text).alias("text"), valid.alias("valid"))


def write_fixed(fixed: DataFrame, path: str) -> None:
    """Documents whose text a fix has changed, as Parquet in a new place; the files that were read stay as they are."""
    fixed.where("fixed").drop("fixed").write.parquet(path)


def human_lines(diags: DataFrame) -> DataFrame:
    """(doc_id, nth, line): diagnostics as lines "code start:end message" in the reporting order."""
    from ..plans.fixes import in_order

    return in_order(diags).select("doc_id", "nth", F.format_string("%s %d:%d %s", "code", "start", "end", "message").alias("line"))


def json_documents(diags: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, json): one JSON document for each text, with its diagnostics in the reporting order; none gives an empty list."""
    from ..plans.fixes import in_order

    fields = F.struct("nth", "code", "severity", "rules", "message", F.struct("start", "end").alias("span"), "evidence")
    rows = in_order(diags).groupBy("doc_id").agg(F.array_sort(F.collect_list(fields)).alias("diagnostics"))
    out = docs.select("doc_id").join(rows.hint("merge"), "doc_id", "left")
    listed = F.transform(F.coalesce("diagnostics", F.array().cast(rows.schema["diagnostics"].dataType)), lambda d: d.dropFields("nth"))
    return out.select("doc_id", F.to_json(F.struct("doc_id", listed.alias("diagnostics"))).alias("json"))


def write_json(diags: DataFrame, docs: DataFrame, path: str) -> None:
    """json_documents() as files of one JSON document a line."""
    json_documents(diags, docs).select("json").write.text(path)
