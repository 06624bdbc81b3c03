"""Vector code compression: product codes of fixed-point vectors, nearest entries found through segment-mean lower bounds.

A component x becomes floor(256 x). Vectors are cut into equal parts, and each part becomes the index of the nearest of its
position's entries. No distance is computed for an entry that cannot win. For segments of b components with sums S and
residuals from the segment mean of norm R, |x - c|^2 is at least the sum of (S_x - S_c)^2 / b + (R_x - R_c)^2; the part as one
segment comes first, halves of it next, down to segments of two or three. The bounds are rounded down by more than the error of
doubles, the entry with the least bound gives the distance to beat, and entries whose bound does not pass it (equal ones
stay, for ties) receive exact integer distances.

Tasks hold the codebooks and sums of at most parts * entries entries, whatever the table's size. Vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, staged, tidied

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Vectors that one vectorised step works on.
STEP = 4096
#: Of the sizes of part and entry, so much may be an error of doubles; it is taken off the bounds.
SLACK = 1e-7


def limit_of(width: int) -> int:
    """Components saturate here: width squares of differences still fit a signed 64-bit number."""
    return 1 << ((60 - max(width - 1, 1).bit_length()) // 2)


@dataclass
class Codebooks:
    """entries[p][i]: entry i of part position p, integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Lowercase hex over all decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for, as floating-point numbers."""
        indexes = np.frombuffer(bytes.fromhex(code), np.uint8)
        return (self.entries[np.arange(len(indexes)), indexes] / SCALE).reshape(-1)


def levels(width: int) -> list[np.ndarray]:
    """First places of the segments, from the whole part down to segments of two or three, each halved from one level to the next."""
    out = [np.array([0])]
    while (sizes := np.diff(np.append(out[-1], width))).max() > 3 or (len(out) == 1 and width > 2):
        out.append(np.unique(np.concatenate((out[-1], (out[-1] + (sizes + 1) // 2)[sizes > 2]))))
    return out


def segments(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each row, segment sums over the root of the length, then the norms of the segments' residuals from their means.

    Squared distances of these rows are never above those of the vectors themselves.
    """
    lengths = np.diff(np.append(starts, x.shape[1]))
    # length * (sum of squares) - (sum)^2, exact in integers unless they are too large
    if np.abs(x).max(initial=0) >= 1 << 24:
        x = x.astype(np.float64)
    sums = np.add.reduceat(x, starts, axis=1)
    rest = np.maximum(lengths * np.add.reduceat(x * x, starts, axis=1) - sums * sums, 0)
    return np.concatenate((sums / np.sqrt(lengths), np.sqrt(rest / lengths)), axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, by squared distance and index, that distance, and how many distances were computed."""
    n, k = len(x), len(entries)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    norm = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    slack = SLACK * ((norm(x)[:, None] + norm(entries)[None, :]) ** 2 + 1)
    rows, columns = np.divmod(np.arange(n * k), k)
    best = np.full(n, np.iinfo(np.int64).max)
    computed = 0
    for starts in levels(x.shape[1]):
        a, b = segments(x, starts), segments(entries, starts)
        bound = -slack[rows, columns]
        for j in range(a.shape[1]):
            bound += (a[rows, j] - b[columns, j]) ** 2
        # the entry of the least bound gives each row a distance to beat; it stays itself, for no bound is above its distance
        heads = np.searchsorted(rows, np.arange(n))
        least = np.minimum.reduceat(bound, heads)
        first = np.full(n, k)
        at = np.flatnonzero(bound == least[rows])
        np.minimum.at(first, rows[at], columns[at])
        best = np.minimum(best, ((x - entries[first]) ** 2).sum(axis=1))
        computed += n
        stays = bound <= best[rows]
        rows, columns = rows[stays], columns[stays]
    exact = ((x[rows] - entries[columns]) ** 2).sum(axis=1)
    computed += len(rows)
    order = np.lexsort((columns, exact, rows))
    heads = order[np.searchsorted(rows[order], np.arange(n))]
    return columns[heads], exact[heads], computed


def fixed_point(column, width: int) -> np.ndarray:
    """The integers of an Arrow column of lists of width numbers."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten().cast(pa.float64())).reshape(-1, width)
    most = limit_of(width)
    return np.floor(np.clip(x * SCALE, -most, most)).astype(np.int64)


def _means(books: np.ndarray, width: int):
    """Sums and counts of the parts nearest to each entry, one row an entry and task."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        parts, entries, own = books.shape
        # sums of one task: floats of two halves would lose digits, so Python integers take over after each step
        sums, counts = np.zeros((parts, entries, own), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = fixed_point(batch.column(0), width)
            for i in range(0, len(x), STEP):
                step = x[i : i + STEP]
                for p in range(parts):
                    part = step[:, p * own : (p + 1) * own]
                    to, _, _ = nearest(part, books[p])
                    counts[p] += np.bincount(to, minlength=entries)
                    add = np.zeros((entries, own), np.int64)
                    np.add.at(add, to, part)
                    sums[p] += add
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.record_batch(
                [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array([[str(v) for v in row] for row in sums[p, e].tolist()], pa.list_(pa.string())), pa.array(counts[p, e])],
                names=["part", "entry", "sums", "n"],
            )

    return run


def _coder(books: np.ndarray, width: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        parts, _, own = books.shape
        for batch in batches:
            x = fixed_point(batch.column(0), width)
            codes, errors = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for i in range(0, len(x), STEP):
                for p in range(parts):
                    to, distance, _ = nearest(x[i : i + STEP, p * own : (p + 1) * own], books[p])
                    codes[i : i + STEP, p] = to
                    errors[i : i + STEP] += distance
            text = codes.tobytes().hex()
            yield pa.record_batch(
                [batch.column(1), batch.column(2), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"]
            )

    return run


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) without null vectors and vectors with null or non-finite components."""
    whole = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & whole)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int] | None:
    """Codebooks of kept() rows, and the length of the vectors that they are for; None without such a vector.

    That length is the one of the least id's vector, and must be a multiple of parts. Each round is one pass over the rows
    and brings at most parts * entries rows to the driver.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("one byte a part: 1 to 256 entries")
    rows = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").first()
    if first is None:
        return None
    width = len(first[0])
    rows = rows.where(F.size("v") == width)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.col("v").cast("array<double>").alias("v")).limit(entries).toArrow()
    seeds = fixed_point(seeds.column("v"), width)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(tidied(_means(books, width)), "part int, entry int, sums array<string>, n long")
        whole = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width // parts)])
        books = books.copy()
        for row in whole.collect():
            books[row["part"], row["entry"]] = [int(row[f"s{j}"]) // row["n"] for j in range(width // parts)]
    return Codebooks(books), width


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Vectors that are null or hold nulls or non-finite components go, and so do vectors whose length is not that of the
    least id's vector with a positive multiple of parts components. Components saturate at limit_of() (2^27 for 64
    components). Equal ids are ordered by vector, null ids come last, repeated rows count each time; with fewer vectors
    than entries the codebooks are shorter. An empty table gives an empty result, other columns are not looked at.
    """
    rows = kept(vectors, id_col, vector_col, label_col)
    made = fit(rows, parts, entries, rounds)
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    books, width = made if made else (None, -1)
    rows = rows.where(F.size("v") == width).select("v", "vec_id", "label")
    if books is None:
        coded = vectors.sparkSession.createDataFrame([], schema)
    else:
        # sums of labels meet the rows in a join of two tables, which Spark broadcasts if small and splits where a label is hot
        coded = staged(rows.mapInArrow(tidied(_coder(books.entries, width)), schema), "codes")
    sums = staged(coded.groupBy("label").agg(F.sum("error").cast("long").alias("label_error")), "label-errors")
    joined = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Every distance of every part to every entry, rounds unrolled."""
    most = limit_of(64)
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT r, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
    SELECT v.r, v.p, b.e, CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS BIGINT) AS d
    FROM parts v JOIN books{r} b ON b.p = v.p)
  GROUP BY r, p
)""")  # fmt: skip
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT n.p, n.e, i, CAST(sum(v.x[i]) // count(*) - CASE WHEN sum(v.x[i]) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS m
    FROM near{r} n JOIN parts v ON v.r = n.r AND v.p = n.p, range(1, (SELECT max(len(x)) FROM parts) + 1) AS t(i) GROUP BY n.p, n.e, i)
  GROUP BY p, e
),
books{r + 1} AS (SELECT b.p, b.e, coalesce(s.x, b.x) AS x FROM books{r} b LEFT JOIN sums{r} s ON s.p = b.p AND s.e = b.e)""")  # fmt: skip
    return f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(least(greatest({SCALE} * CAST(x AS DOUBLE), -{most}), {most})) AS BIGINT)) AS x,
    row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM whole, range(0, {parts}) AS t(p)),
books0 AS (SELECT p, r AS e, x FROM parts WHERE r < {entries}),{",".join(steps)},
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM books{rounds})),
codes AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM codes JOIN whole USING (r), digest
"""


SQL = _sql()
