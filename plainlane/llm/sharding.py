"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - 1/2) / rows of the
source. Sorting all rows by it interleaves the sources in proportion, and equal cuts of that order give every shard the
mixture of the whole. No window holds a source or the table: ranks come from counts of hash ranges plus a rank within
one range, and the global order from counts of 4,096 ranges of the fractional rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import read_table, staged

#: Hash ranges of each source (a power of two), and ranges of the fractional rank.
HASH_RANGES = 1024
RANK_RANGES = 4096
SEED = "interleave-1"


def interleave(docs: DataFrame, shards: int = 24, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Puts every row into a shard: (doc_id, source, size, text_crc32, fraction, shard, slot).

    size is the text's UTF-8 bytes plus 8. Counts of shards differ by one at most, and slots run from 0 without gaps.
    A null source is a source of its own; a null text counts as empty; a null id and repeated rows are placed as any
    row, ties broken by id, size and checksum (rows alike in all of these may swap, which no output shows). An empty
    table gives an empty result. Other columns are not looked at.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source_col))).alias("stratum"),
        number.alias("k"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("part", F.shiftright("k", 52 - HASH_RANGES.bit_length() + 1))

    counts = rows.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("c"))
    by_stratum = Window.partitionBy("stratum")
    before = counts.select(
        "stratum",
        "part",
        (F.sum("c").over(by_stratum.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"),
        F.sum("c").over(by_stratum).alias("n"),
    )
    order = [F.col("k"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("stratum", "part").orderBy(*order))).join(before, ["stratum", "part"])
    twice = 2 * (F.col("before") + F.col("rank")) - 1
    placed = staged(
        ranked.select(
            "doc_id", "source", "stratum", "k", "size", "text_crc32",
            (twice.cast("double") / (2 * F.col("n")).cast("double")).alias("fraction"),
        ),
        "interleave",
    )
    placed = placed.withColumn("range", F.floor(F.col("fraction") * F.lit(RANK_RANGES)).cast("int"))
    # at most RANK_RANGES rows, whatever the input: one task may sum them, and they may be broadcast
    sums = placed.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    firsts = sums.select(
        "range",
        (F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("first"),
        F.sum("c").over(Window.partitionBy()).alias("total"),
    )
    within = Window.partitionBy("range").orderBy(F.col("fraction"), F.col("stratum"), *order)
    place = (F.col("first") + F.col("row") - 1).cast("long")
    out = placed.withColumn("row", F.row_number().over(within)).join(F.broadcast(firsts), "range").withColumn("place", place)
    out = out.withColumn("shard", F.expr(f"cast((place * {shards}) div total as int)"))
    return out.select(
        "doc_id", "source", "size", "text_crc32", "fraction", "shard",
        (F.col("place") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: The checksum's table comes from its rule (reflected polynomial 0xEDB88320); bytes are folded one by one.
CRC_SQL = """
crc_step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT range AS i FROM range(0, 256)))
)"""

SQL = f"""
WITH {CRC_SQL},
texts AS (
  SELECT coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM (SELECT DISTINCT text FROM documents)
),
sums AS (
  SELECT text, xor(4294967295, list_reduce(range(0, length(h) // 2),
    lambda c, x: xor(c >> 8, list_extract(t, 1 + xor(c & 255, CAST('0x' || h[2 * x + 1:2 * x + 2] AS BIGINT)))), 4294967295)) AS crc
  FROM texts, crc_step
),
base AS (
  SELECT d.doc_id, d.source, CASE WHEN d.source IS NULL THEN '0' ELSE '1' || d.source END AS stratum,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS k,
    CAST(strlen(coalesce(d.text, '')) + 8 AS BIGINT) AS size, s.crc AS text_crc32
  FROM documents d JOIN sums s ON s.text = coalesce(d.text, '')
),
ranked AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, size, text_crc32) - 1 AS DOUBLE)
    / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS fraction FROM base
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, k, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST((place * 24) // total AS INTEGER) AS shard,
  CAST(place - (((place * 24) // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""
