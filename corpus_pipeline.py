"""The training-data pipeline: toxicity, line dedup, near-dedup, decontamination and byte-level BPE, in this order.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; run() writes every stage's result as Parquet
into the folder that the cluster shares and reads it back as the next stage's documents. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainlane.llm import byte_bpe, decontaminate, line_dedup, minhash_dedup, toxicity
from plainlane.llm._common import read_table, staged, unstage


def _prefix(docs: DataFrame) -> str:
    """What no column's name starts with."""
    out = "__"
    while any(c.lower().startswith(out) for c in docs.columns):
        out += "_"
    return out


def _joined(docs: DataFrame, result: DataFrame, prefix: str, how: str = "inner") -> DataFrame:
    """docs with the columns of result (one row for each non-null doc_id), whose names get the prefix.

    The join is a merge at every size: a small result is not broadcast, so that plans are alike on any corpus.
    """
    own = result.where("doc_id is not null").dropDuplicates(["doc_id"])
    own = own.select(*(F.col(c).alias(prefix + c) for c in own.columns))
    return docs.join(own.hint("merge"), docs["doc_id"] == F.col(f"{prefix}doc_id"), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model learns from this stage's own documents and the labels.

    Null, empty and wordless texts get the share of toxic labels as their score; rows of null id are scored like others;
    repeated rows go or stay alike; other columns, whatever their names, are kept; no documents give none.
    """
    model, score = toxicity.fit(docs, read_table(spark, sf_dir, "labels")), _prefix(docs) + "score"
    return toxicity.with_scores(docs, model, score).where(F.col(score) < 0.5).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first that has them; n_chars follows the new text.

    Documents that lose nothing stay as they are (null and empty texts, rows of null id); those whose every word goes are
    dropped. Repeated rows are one document and are cut alike; other columns, whatever their names, are kept; no documents
    give none.
    """
    p = _prefix(docs)
    cleaned = line_dedup.drop_recurring(docs, lost_lines=line_dedup.templates).where("n_dropped > 0").select("doc_id", "kept")
    kept, same = F.col(f"{p}kept"), F.col(f"{p}doc_id").isNull()
    out = _joined(docs, cleaned, p, "left").where(same | kept.rlike("[^ \t\n\x0b\x0c\r]"))
    text = F.when(same, docs["text"]).otherwise(kept)
    new = {"text": text, "n_chars": F.when(same, docs["n_chars"]).otherwise(F.length(text).cast("long"))}
    return out.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least doc_id.

    Null, empty and wordless texts and rows of null id belong to no group and stay; repeated rows stay or go alike; other
    columns, whatever their names, are kept; no documents give none.
    """
    p = _prefix(docs)
    gone = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id")
    return _joined(docs, gone, p, "left").where(F.col(f"{p}doc_id").isNull()).select(*(docs[c] for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words are benchmark passages go; from others passages of eight words or more are cut.

    n_chars follows the new text. Rows are judged alone, so repeated ones alike; null and empty texts and rows of null id are
    rows like others; other columns are kept; an empty benchmark takes nothing, no documents give none.
    """
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"), span=decontaminate.SPAN, chars_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of every remaining text: (doc_id, n_tokens, ids).

    Null texts are empty and have no ids; rows of null id and repeated rows are returned too; other columns are not looked at;
    no documents give none.
    """
    return byte_bpe.encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte BPE", encode),
]

#: The recurrent network and the merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            unstage(before)
        before = docs
    return docs
