"""Mixing sources to target weights by Pareto order sampling.

Sources get targets in words by weight, stopped at a number of times their own size. A document's expected copies are its
source's target over the source's size, times its weight if there is one, and never above that number. Whole copies are
certain. The fraction p that remains is its probability of one copy more: with U uniform by hash, documents of a source are
ranked by Q = (U / (1 - U)) / (p / (1 - p)), and the first of them are selected as long as their words fit the source's rest.
What is then open is closed by the one document whose size is nearest to it, and what is then too much by dropping the
selected document whose size is nearest to that, each only if it brings the source nearer.

Only the words of ranges of Q are summed for all rows (partial sums, one row a range); the rows of the one range of each
source in which its rest ends are the only ones to be sorted. Ranges come from counts, so that they hold about RANGE_ROWS rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read_table, staged, unstage

WEIGHTS = (1, 2, 3)
COPIES = 3
#: Expected rows of a range of Q, of which one a source is sorted.
RANGE_ROWS = 20_000
SEED = "mix-1"
#: 52 bits of hash make U = (2 k + 1) / 2^53.
BITS = 52

DEC = "decimal(38,0)"


def weighted_sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(stratum, n, s, w): documents and words of each source, and its weight, which goes through weights by code point, null last.

    Sources are numbered by ranges of names: no task sorts all of them.
    """
    sums = staged(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), "sources")
    parted = sums.repartitionByRange("stratum").withColumn("range", F.spark_partition_id()).select("stratum", "n", "s", "range")
    parted = staged(parted, "source-ranges")
    unstage(sums)
    # as many rows as there are ranges
    before = parted.groupBy("range").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("range").orderBy("stratum")) - 1 + F.coalesce("before", F.lit(0))
    ranked = parted.join(F.broadcast(before.select("range", "before")), "range").withColumn("place", place)
    return ranked.select("stratum", "n", "s", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("w"))


def with_targets(sources: DataFrame, copies: int = COPIES) -> DataFrame:
    """Adds target to (stratum, n, s, w): shares of all words by weight, stopped at copies * s, what is over shared again.

    Each turn is one sum over the sources; a source that is stopped stays so, so turns end. The driver sees two numbers.
    """
    total = int(sources.agg(F.sum("s")).first()[0] or 0)
    stop = F.lit(copies).cast(DEC) * F.col("s")
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("w").cast(DEC) * F.lit(level[0]).cast(DEC) > stop * F.lit(level[1]).cast(DEC)
        row = sources.agg(F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if row[2] == stopped:
            break
        # all may be stopped only if all sizes are zero
        level, stopped = (total - int(row[0] or 0), int(row[1] or 0) or 1), row[2]
    share = (F.col("w") * F.lit(level[0])).cast("double") / F.lit(level[1]).cast("double")
    return sources.withColumn("target", F.when(full, stop.cast("double")).otherwise(share))


def _expected(rows: DataFrame, sources: DataFrame, copies: int) -> DataFrame:
    """Adds e, the expected copies: weight * c, at most copies, with c of each source such that its words are its target.

    Each turn sums the sources once more and ends when no more documents are stopped; with equal weights there is one.
    """
    level = sources.select("stratum", F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0).alias("c"))
    if "weight" not in rows.columns:
        return rows.join(level, "stratum").withColumn("e", F.col("c")).drop("c")
    stopped = None
    while True:
        now = rows.join(level, "stratum") if stopped is not None else rows.withColumn("c", F.lit(0.0))
        full = F.col("weight") * F.col("c") >= copies
        sums = staged(
            now.groupBy("stratum").agg(F.sum(F.when(full, F.col("size"))).alias("held"), F.sum(F.when(~full, F.col("size") * F.col("weight"))).alias("free"), F.count_if(full).alias("full")), "mix-level"
        )
        count = sums.agg(F.sum("full")).first()[0]
        if count == stopped:
            return now.withColumn("e", F.least(F.col("weight") * F.col("c"), F.lit(float(copies)))).drop("c")
        stopped = count
        rest = F.greatest(F.col("target") - copies * F.coalesce("held", F.lit(0)), F.lit(0.0))
        level = staged(sources.join(sums, "stratum").select("stratum", F.when(F.col("free") > 0, rest / F.col("free")).otherwise(0.0).alias("c")), "mix-c")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight_col: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    size counts the text's words (null: none), taken is copies * size; of copies, the whole part of the expected number is
    certain. A weight (null or negative: 0) makes some documents of a source likelier than others. A null source is a source
    of its own and the last one. Null and repeated ids are fine: the hash covers id and text, and of rows alike in both any may
    be taken, with as many taken on each run. An empty table gives an empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))
    columns = [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), F.struct(F.lit(1).alias("absent"), F.lit("").alias("name"))).otherwise(F.struct(F.lit(0).alias("absent"), F.col(source_col).cast("string").alias("name"))).alias("stratum"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        mark.alias("mark"),
    ]
    if weight_col is not None:
        columns.append(F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    rows = staged(docs.select(*columns), "mix-rows")
    sources = staged(with_targets(weighted_sources(rows, weights), copies), "mix-sources")

    placed = _expected(rows, sources, copies)
    placed = placed.withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("whole"))
    u = (F.conv(F.substring("mark", 1, BITS // 4), 16, 10).cast("long") * 2 + 1).cast("double") / F.lit(float(1 << (BITS + 1)))
    q = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # all rows once more: what whole copies leave of each source, and the mean p
    sums = placed.groupBy("stratum").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.avg("p").alias("mean"), F.count(F.lit(1)).alias("m"))
    sums = sources.join(sums, "stratum").select("stratum", "m", "mean", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)).alias("rest"))
    sums = staged(sums, "mix-rests")
    # a range of Q: its odds times those of the mean p are near the odds of a uniform number, whose ranges are of equal counts
    odds = F.col("q") * F.col("mean") / (1 - F.col("mean"))
    spread = F.when(F.col("q").isNotNull(), F.floor(odds / (1 + odds) * F.ceil(F.col("m") / F.lit(range_rows))).cast("long"))
    ranged = staged(placed.withColumn("q", q).join(sums, "stratum").withColumn("range", spread).select("doc_id", "source", "stratum", "size", "mark", "whole", "q", "range"), "mix-ranges")

    by_range = ranged.where("range is not null").groupBy("stratum", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    upto = by_range.withColumn("upto", F.sum("words").over(running)).join(sums.select("stratum", "rest"), "stratum")
    # the range in which the rest ends: the first whose words do not all fit
    last = upto.where(F.col("upto") > F.col("rest")).groupBy("stratum").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
    ends = staged(sums.join(last, "stratum", "left").select("stratum", "rest", "at.range", "at.before").withColumnsRenamed({"range": "end"}), "mix-ends")

    order = ["q", "mark"]
    # rows alike in mark are alike in id and text, and stand next to each other
    inner = Window.partitionBy("stratum").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at_end = ranged.join(ends, "stratum").where(F.col("range") == F.col("end"))
    cut = at_end.withColumn("upto", F.col("before") + F.sum("size").over(inner))
    # the last row selected there, by its place in the order, and what is open then
    number = F.row_number().over(Window.partitionBy("stratum").orderBy(*order))
    cut = cut.withColumn("number", number).where(F.col("upto") <= F.col("rest")).groupBy("stratum").agg(F.max("number").alias("chosen"), F.max("upto").alias("got"))
    after = ends.where("end is not null").join(cut, "stratum", "left").select("stratum", "rest", "end", "before", F.coalesce("chosen", F.lit(0)).alias("chosen"), (F.col("rest") - F.coalesce("got", "before")).alias("open"))
    after = staged(after, "mix-open")
    # the nearest size to what is open, of rows that are not selected; then the nearest one to drop for what is too much
    numbered = ranged.join(after, "stratum").withColumn("past", F.col("range") > F.col("end"))
    number = F.row_number().over(Window.partitionBy("stratum", "range").orderBy(*order))
    inside = numbered.where(F.col("range") == F.col("end")).withColumn("past", number > F.col("chosen"))
    parted = inside.unionByName(numbered.where(F.col("range") != F.col("end")))
    off = F.abs(F.col("open") - F.col("size"))
    closing = parted.where(F.col("past") & (off < F.col("open"))).groupBy("stratum").agg(F.min(F.struct(off.alias("off"), "q", "mark", "size")).alias("closing"))
    closed = staged(after.join(closing, "stratum", "left").select("stratum", "end", "chosen", "closing.mark", (F.col("closing.size") - F.col("open")).alias("over")), "mix-closed").withColumnsRenamed({"mark": "closing"})
    off = F.abs(F.col("over") - F.col("size"))
    over = parted.where(~F.col("past")).join(closed.select("stratum", "over").where("over > 0"), "stratum").where(off < F.col("over"))
    dropped = over.groupBy("stratum").agg(F.min(F.struct(off.alias("off"), "q", "mark")).alias("dropped")).select("stratum", F.col("dropped.mark").alias("dropped"))
    plan = staged(closed.drop("over").join(dropped, "stratum", "left"), "mix-plan")

    all_rows = ranged.join(sources.select("stratum", F.col("s").alias("source_size"), "target"), "stratum").join(plan, "stratum", "left")
    is_it = lambda mark: F.coalesce(F.col("mark") == F.col(mark), F.lit(False))
    sorted_ones = F.coalesce(F.col("range") == F.col("end"), F.lit(False)) | is_it("closing") | is_it("dropped")
    # without an end all that have a fraction are selected; ranges before it are, ranges after it are not
    plainly = all_rows.where(~sorted_ones).withColumn("more", F.coalesce(F.col("range").isNotNull() & (F.col("end").isNull() | (F.col("range") < F.col("end"))), F.lit(False)))
    some = all_rows.where(sorted_ones).withColumn("number", number).withColumn("in", (F.col("range") < F.col("end")) | ((F.col("range") == F.col("end")) & (F.col("number") <= F.col("chosen"))))
    # of rows alike in mark one is meant
    one = F.row_number().over(Window.partitionBy("stratum", "mark", "in").orderBy("number")) == 1
    some = some.withColumn("one", one).withColumn("more", F.when(F.col("in"), ~(is_it("dropped") & F.col("one"))).otherwise(is_it("closing") & F.col("one")))
    out = plainly.unionByName(some.drop("number", "in", "one")).withColumn("copies", F.col("whole") + F.col("more").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = f"""
WITH base AS (
  SELECT doc_id, source, source IS NULL AS absent, coalesce(source, '') AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS mark
  FROM documents
),
sources AS (
  SELECT absent, name, CAST(sum(size) AS BIGINT) AS s, 1 + (row_number() OVER (ORDER BY absent, encode(name)) - 1) % 3 AS w FROM base GROUP BY absent, name
),
-- sources stop in the order of stop / weight; the level is the first that stops none of those after it
steps AS (
  SELECT s * {COPIES} AS stop, w, row_number() OVER o AS i, sum(s) OVER () AS total,
    coalesce(sum(s * {COPIES}) OVER (ORDER BY CAST(s AS DOUBLE) / w, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY CAST(s AS DOUBLE) / w, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM sources WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / w, absent, name)
),
level AS (SELECT total - stopped AS num, free AS den FROM steps WHERE CAST(w AS HUGEINT) * (total - stopped) <= CAST(stop AS HUGEINT) * free ORDER BY i LIMIT 1),
targets AS (
  SELECT absent, name, s, CASE WHEN CAST(w AS HUGEINT) * num > CAST({COPIES} * s AS HUGEINT) * den THEN CAST({COPIES} * s AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM sources, level
),
expected AS (
  SELECT b.*, s AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS e FROM base b JOIN targets t ON t.absent = b.absent AND t.name = b.name
),
ranked AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p, (CAST('0x' || substr(mark, 1, 13) AS BIGINT) * 2 + 1) / 9007199254740992.0::DOUBLE AS u FROM expected
),
ordered AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM ranked),
rests AS (SELECT absent, name, greatest(any_value(target) - sum(whole * size), 0.0) AS rest FROM ordered GROUP BY absent, name),
run AS (
  SELECT o.*, rest, row_number() OVER w AS number, CASE WHEN q IS NOT NULL THEN sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) END AS upto
  FROM ordered o JOIN rests r ON r.absent = o.absent AND r.name = o.name WINDOW w AS (PARTITION BY o.absent, o.name ORDER BY q NULLS LAST, mark)
),
opened AS (SELECT absent, name, any_value(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS open FROM run GROUP BY absent, name),
closing AS (
  SELECT r.absent, r.name, r.number, size - open AS over
  FROM run r JOIN opened o ON o.absent = r.absent AND o.name = r.name WHERE upto > rest AND abs(open - size) < open
  QUALIFY row_number() OVER (PARTITION BY r.absent, r.name ORDER BY abs(open - size), q, mark, r.number) = 1
),
dropped AS (
  SELECT r.absent, r.name, r.number
  FROM run r JOIN closing c ON c.absent = r.absent AND c.name = r.name WHERE upto <= rest AND over > 0 AND abs(over - size) < over
  QUALIFY row_number() OVER (PARTITION BY r.absent, r.name ORDER BY abs(over - size), q, mark, r.number) = 1
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN upto <= rest AND d.number IS NULL OR c.number IS NOT NULL THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, source
FROM run r LEFT JOIN closing c ON c.absent = r.absent AND c.name = r.name AND c.number = r.number LEFT JOIN dropped d ON d.absent = r.absent AND d.name = r.name AND d.number = r.number
"""
