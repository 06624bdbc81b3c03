"""Nesting by a sweep against looking at all pairs, and list depths against repeated passes over all lists."""

import random

from pyspark.sql import functions as F

from plainlane.operators import nesting


def nested(r, a, b, depth, out):
    """Random spans that nest or lie apart."""
    at = a
    while at < b and depth:
        s = r.randint(at, b)
        e = r.randint(s, b)
        if e > s:
            out.append((s, e))
            nested(r, s, e, depth - 1, out)
        at = e + r.randint(0, 3)
    return out


def crossing(r):
    return [(a := r.randrange(60), a + r.randrange(1, 30)) for _ in range(r.randint(0, 25))]


def slow_holder(outer, span):
    found = [(b - a, k) for k, (a, b) in enumerate(outer) if a < span[0] and span[1] <= b]
    return min(found)[1] if found else None


def test_holders():
    r = random.Random(3)
    for k in range(300):
        outer = nested(r, 0, 80, 4, []) if k % 2 else crossing(r)
        r.shuffle(outer)
        inner = outer[:5] + crossing(r)
        assert nesting.holders(outer, inner) == [slow_holder(outer, s) for s in inner]


def slow_depths(lists, items):
    depth = [0] * len(lists)
    for _ in range(len(lists) + 1):
        before = list(depth)
        for q, (start, end) in enumerate(lists):
            found = [(b - a, k) for k, (of, a, b) in enumerate(items) if of != q and a < start and end <= b]
            if found:
                depth[q] = before[items[min(found)[1]][0]] + 1
    return depth


def test_depths():
    r = random.Random(9)
    for _ in range(300):
        lists = nested(r, 0, 90, 5, [])
        items = []
        for q, (a, b) in enumerate(lists):
            at = a
            while at < b:
                e = r.randint(at, b)
                items.append((q, at, max(e, at + 1)))
                at = e + 1
        r.shuffle(items)
        assert nesting.depths(lists, items) == slow_depths(lists, items)


def test_deep_nesting_is_linear():
    n = 100_000
    outer = [(k, 2 * n - k) for k in range(n)]
    assert nesting.holders(outer, [(k + 1, 2 * n - k - 1) for k in range(n)]) == list(range(n))


def test_innermost(spark):
    r = random.Random(5)
    rows = [(d, a, b, f"o{k}") for d in range(30) for k, (a, b) in enumerate(nested(r, 0, 60, 4, []))]
    asked = [(d, a, b, k, 7) for d in range(32) for k, (a, b) in enumerate(crossing(r))] + [(None, 1, 2, 0, 7)]
    outer = spark.createDataFrame(rows, "doc_id long, start int, end int, name string")
    inner = spark.createDataFrame(asked, "doc_id long, start int, end int, n int, name int")
    got = {(x["doc_id"], x["n"]): x["holder"] and (x["holder"]["start"], x["holder"]["end"], x["holder"]["name"]) for x in nesting.innermost(outer, inner).collect()}
    want = {}
    for d, a, b, k, _ in asked:
        own = sorted((s, e, name) for doc, s, e, name in rows if doc == d)
        h = slow_holder([(s, e) for s, e, _ in own], (a, b))
        want[d, k] = None if h is None else own[h]
    assert got == want
    assert nesting.innermost(outer.where("false"), inner).where(F.col("holder").isNotNull()).count() == 0
