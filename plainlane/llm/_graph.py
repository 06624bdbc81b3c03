"""Connected components of links that may not fit one machine: union-find within batches, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged, tidied, unstage


def _union_find(batches) -> Iterator:
    """Replaces each batch's links by (node, least node of its group), groups by union-find with path halving."""
    import pyarrow as pa

    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: links (a, b) with a > b."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of links (a long, b long); root is the least node that can be reached.

    Each round is written to the shared folder; rounds end when nothing changes, after about the logarithm of the
    longest way. The driver sees two numbers a round.
    """
    now = staged(links.select("a", "b").mapInArrow(tidied(_union_find), "a long, b long"), label)
    seen = None
    while True:
        new = staged(_stars(now), label)
        row = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(now)
        now = new
        if tuple(row) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(row)
