"""Roll-ups over documents, and measures of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity_by(diags: DataFrame, docs: DataFrame, *dims: str) -> DataFrame:
    """Counts of diagnostics by code and dimensions of the documents; they are counted by document before they meet these."""
    each = diags.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))
    rows = each.join(docs.select("doc_id", *dims).hint("merge"), "doc_id")
    return rows.groupBy(*dims, "code").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def per_thousand_words(diags: DataFrame, words: DataFrame, *dims: str) -> DataFrame:
    """Diagnostics for each 1,000 words by dimensions; words is (doc_id, dims..., n_words)."""
    n = diags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = words.join(n.hint("merge"), "doc_id", "left").groupBy(*dims).agg(F.sum("n_words").cast("long").alias("n_words"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n_diagnostics"))
    return rows.withColumn("per_1000", F.expr("(n_diagnostics * 1000) div nullif(n_words, 0)"))


def precedes(spans: DataFrame, *by: str) -> DataFrame:
    """Edges from each span to the next one: (by..., start, next_start)."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    return spans.withColumn("next_start", F.lead("start").over(w)).where("next_start is not null").select(*by, "start", "next_start")


def contains(outer: DataFrame, inner: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, outer_start, inner_start): spans inside others of the same document; an equi join with a range residue."""
    a = outer.select(by, F.col("start").alias("outer_start"), F.col("end").alias("outer_end"))
    b = inner.select(by, F.col("start").alias("inner_start"), F.col("end").alias("inner_end"))
    return a.join(b, by).where("inner_start >= outer_start and inner_end <= outer_end").select(by, "outer_start", "inner_start")


def latency(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, 95th percentile (linear interpolation) and peak."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("peak"), F.count(value).alias("n"))


def accuracy(expected: DataFrame, observed: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Expected rows that were observed: (by..., correct, total, accuracy); null without expected rows."""
    hit = expected.join(observed.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return hit.groupBy(*by).agg(F.count("hit").alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.try_divide("correct", "total"))


def tree_digest(files: DataFrame, path: str = "path", content: Column | str = "content") -> DataFrame:
    """One digest of all files: of their digests in the order of their paths."""
    each = files.select(F.col(path).alias("p"), F.sha2(F.col(content) if isinstance(content, str) else content, 256).alias("h"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: F.concat_ws(" ", x["p"], x["h"])), "\n")
    return each.agg(F.sha2(lines, 256).alias("digest"), F.count(F.lit(1)).alias("n_files"))


def first_full_form(mentions: DataFrame) -> DataFrame:
    """mentions (doc_id, identity, start, is_full) with seen_full: whether a full form stands earlier."""
    w = Window.partitionBy("doc_id", "identity").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumn("seen_full", F.coalesce(F.min(F.when(F.col("is_full"), F.col("start"))).over(w).isNotNull(), F.lit(False)))


def coreference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(correct, total, accuracy): expected links (case, mention, antecedent) that an observed one (case, mention, representative)
    answers: the same mention in any case, and a representative that contains the antecedent."""
    o = observed.select("case", F.lower("mention").alias("m"), F.lower(F.coalesce("representative", F.lit(""))).alias("r")).groupBy("case", "m").agg(F.collect_set("r").alias("rs"))
    e = expected.select("case", F.lower("mention").alias("m"), F.lower("antecedent").alias("a"))
    hit = F.coalesce(F.exists("rs", lambda r: F.contains(r, F.col("a"))), F.lit(False))
    return e.join(o, ["case", "m"], "left").agg(F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.try_divide("correct", "total"))


def token_parity(reference: DataFrame, observed: DataFrame, label: str) -> DataFrame:
    """(correct, total, accuracy): tokens (case, start, end, label) of which an observed token has the same span: equal labels.
    Tokens without a label on the reference's side are not counted."""
    o = observed.select("case", "start", "end", F.col(label).alias("seen"))
    both = reference.where(F.col(label).isNotNull()).join(o, ["case", "start", "end"])
    return both.agg(F.count_if(F.col(label).eqNullSafe(F.col("seen"))).alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.try_divide("correct", "total"))


def combined(**providers: DataFrame) -> DataFrame:
    """(provider, metric, correct, total, accuracy) of several providers' measures (metric, correct, total, accuracy)."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [m.select(F.lit(p).alias("provider"), "metric", "correct", "total", "accuracy") for p, m in providers.items()])


def constituents(trees: DataFrame) -> DataFrame:
    """(case, ordinal, label, text) of bracketed trees (case, tree): each inner node with the words below it, children first."""
    import re

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for case, tree in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words: list[str] = []
                open_: list[tuple[str, int]] = []
                n = 0
                for label, close, word in re.findall(r"\(\s*([^\s()]*)|(\))|([^\s()]+)", tree or ""):
                    if word:
                        words.append(word)
                    elif close and open_:
                        name, at = open_.pop()
                        if name and len(words) > at:
                            rows.append((case, n, name, " ".join(words[at:])))
                            n += 1
                    elif not close:
                        open_.append((label, len(words)))
            if rows:
                types = (pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["case", "ordinal", "label", "text"])

    return trees.select(F.col("case").cast("long").alias("case"), "tree").mapInArrow(run, "case long, ordinal int, label string, text string")
