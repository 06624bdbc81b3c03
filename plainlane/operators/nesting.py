"""Nesting of spans: the smallest span that holds another, and depths of lists in items, by one sweep with a stack.

Spans of a document are swept once in the order of their starts. Those that ended before the place of the sweep leave the stack;
the smallest holder is looked for from its top, which is one step where spans nest, and the number of open spans at worst.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays


class _Open:
    """Spans (start, end, number) that are open at the place of a sweep, the latest start on top."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = spans
        self.order = sorted(range(len(spans)), key=lambda k: (spans[k][0], -spans[k][1], k))
        self.at = 0
        self.stack: list[tuple[int, float]] = []  # number, and the least end of all below it

    def smallest(self, start: int, end: int, passes=None) -> int | None:
        """The smallest one that starts before start and ends at end or later; starts come in ascending order."""
        spans, stack = self.spans, self.stack
        while self.at < len(self.order) and spans[k := self.order[self.at]][0] < start:
            while stack and spans[stack[-1][0]][1] <= spans[k][0]:
                stack.pop()
            stack.append((k, min(stack[-1][1], spans[stack[-1][0]][1]) if stack else float("inf")))
            self.at += 1
        # what ended is closed for all later places too; deeper down it goes when it comes to the top
        while stack and spans[stack[-1][0]][1] <= start:
            stack.pop()
        best = None
        for k, below in reversed(stack):
            a, b = spans[k]
            if b >= end and (best is None or (b - a, k) < best) and (passes is None or passes(k)):
                best = (b - a, k)
            # those below start no later, so a smaller one would end before the best one does
            if best is not None and below > spans[best[1]][1]:
                break
        return best[1] if best else None


def holders(outer: list[tuple[int, int]], inner: list[tuple[int, int]]) -> list[int | None]:
    """For each inner span the place of the smallest outer one that starts before it and ends with it or later; of equally small
    ones the first in the list."""
    out: list[int | None] = [None] * len(inner)
    opened = _Open(outer)
    for q in sorted(range(len(inner)), key=lambda k: inner[k]):
        out[q] = opened.smallest(*inner[q])
    return out


def depths(lists: list[tuple[int, int]], items: list[tuple[int, int, int]]) -> list[int]:
    """The depth of each list (start, end): one more than that of the list of the smallest item (list, start, end) of another list
    that holds it, 0 without one. Lists come in any order; holders start earlier, so one pass from the left settles all."""
    out = [0] * len(lists)
    opened = _Open([(a, b) for _, a, b in items])
    for q in sorted(range(len(lists)), key=lambda k: lists[k]):
        k = opened.smallest(*lists[q], lambda k: items[k][0] != q)
        if k is not None:
            out[q] = out[items[k][0]] + 1
    return out


@cache
def _holder():
    def found(outer_starts, outer_ends, starts, ends):
        import numpy as np
        import pyarrow as pa

        (a, at), (b, _), (c, of), (d, _) = (arrays._lists(x) for x in (outer_starts, outer_ends, starts, ends))
        a, b, c, d = (x.tolist() for x in (a, b, c, d))
        out: list[int | None] = []
        for i, j, k, m in zip(at[:-1].tolist(), at[1:].tolist(), of[:-1].tolist(), of[1:].tolist()):
            out += holders(list(zip(a[i:j], b[i:j])), list(zip(c[k:m], d[k:m])))
        return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(out, pa.int64()))

    return F.arrow_udf(found, "array<bigint>")


def holder_places(outer_starts: Column, outer_ends: Column, starts: Column, ends: Column) -> Column:
    """For each inner span the place (from 0) of its smallest holder among the outer ones, null without one."""
    return _holder()(*(x.cast("array<bigint>") for x in (outer_starts, outer_ends, starts, ends)))


def innermost(outer: DataFrame, inner: DataFrame, by: str = "doc_id") -> DataFrame:
    """inner (by, start, end, ...) with holder: the smallest outer span (by, start, end, ...) that starts before it and ends with it
    or later, as a struct of outer's other columns with start and end; null without one.

    Documents' spans meet as two arrays, sorted; of holders alike in size the first by start and the other columns is taken.
    """
    rest = [c for c in outer.columns if c not in (by, "start", "end")]
    own = [c for c in inner.columns if c not in (by, "start", "end")]
    span = lambda names: F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *names)
    o = outer.groupBy(by).agg(F.array_sort(F.collect_list(span(rest))).alias("o"))
    i = inner.groupBy(by).agg(F.collect_list(span(own)).alias("i"))
    both = i.join(o.hint("merge"), by, "left").withColumn("o", F.coalesce("o", F.array().cast(o.schema["o"].dataType)))
    get = lambda c, f: F.transform(c, lambda x: x[f])
    both = both.withColumn("h", holder_places(get("o", "start"), get("o", "end"), get("i", "start"), get("i", "end")))
    rows = both.select(by, F.explode(F.transform("i", lambda x, k: F.struct(x.alias("x"), F.get("o", F.get("h", k).cast("int")).alias("holder")))).alias("r"))
    return rows.select(by, "r.x.*", "r.holder")
