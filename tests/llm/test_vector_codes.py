"""Vector codes against distances to every entry."""

import hashlib
import math
import random

import numpy as np
import pytest

from plainlane.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, part int, v int"


def brute(rows, parts=16, entries=64, rounds=2):
    rows = [(i, x, label) for i, x, label in rows if x is not None and all(a is not None and math.isfinite(a) for a in x)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == width]
    most, own = v.limit_of(width), width // parts
    x = [[max(-most, min(most, math.floor(256 * np.float64(np.float32(a))))) for a in r[1]] for r in rows]
    books = [[x[i][p * own : (p + 1) * own] for i in range(min(entries, len(x)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(r[p * own : (p + 1) * own], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for r in x]

    for _ in range(rounds):
        to = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[k][p * own : (p + 1) * own] for k in range(len(x)) if to[k][p][1] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    digest = hashlib.sha256(",".join(str(a) for p in books for e in p for a in e).encode()).hexdigest()
    to = assign()
    errors = [sum(d for d, _ in t) for t in to]
    total = {}
    for r, e in zip(rows, errors):
        total[r[2]] = total.get(r[2], 0) + e
    return [(r[0], "".join(f"{i:02x}" for _, i in t), e, total[r[2]], digest) for r, t, e in zip(rows, to, errors)]


def key(row):
    return tuple((a is None, a or 0) for a in row)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def test_codes(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(32)], r.choice([0, 1, None])) for i in range(150)]
    rows += [(200 + i, [round(a * 4) / 256 for a in rows[i][1]], 7) for i in range(40)]  # many ties
    rows += [rows[3], rows[3], (3, rows[4][1], 1), (None, rows[5][1], 0), (None, rows[6][1], None)]
    rows += [(400, None, 1), (401, [0.1] * 31 + [None], 1), (402, [math.nan] * 32, 1), (403, [math.inf] + [0.0] * 31, 0), (404, [], 1), (405, [0.1] * 48, 1), (-5, [3e38] * 16 + [-3e38] * 16, 1)]
    got = v.compress(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_few_vectors_and_none(spark):
    rows = [(2, [0.5] * 16, None), (1, [0.25] * 16, 3), (1, [0.25] * 16, 3)]
    assert sorted(map(tuple, v.compress(frame(spark, rows)).collect()), key=key) == sorted(brute(rows), key=key)
    for none in ([], [(1, None, 1)], [(1, [], 1)], [(1, [0.5] * 15, 1)]):
        assert v.compress(frame(spark, none) if none else spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        v.fit(v.kept(frame(spark, rows)), entries=300)


@pytest.mark.parametrize(("scale", "width"), [(3, 4), (100, 4), (100, 7), (100, 16), (100, 1), (100, 2), (100, 3), (1 << 27, 4)])
def test_bounds_lose_nothing(scale, width):
    r = np.random.default_rng(scale)
    entries = r.integers(-scale, scale + 1, (64, width))
    x = np.concatenate((r.integers(-scale, scale + 1, (3000, width)), entries, entries[:20] * 0 + scale, np.zeros((2, width), np.int64)))
    to, distance, computed = v.nearest(x, entries)
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (to == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    if width > 3:  # uniform entries are the worst case; below that a segment is nearly the part itself
        assert computed < 0.5 * exact.size


def test_decoded_vectors_are_near(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(0, 0.2, 16).tolist(), 0) for i in range(400)]
    books, _ = v.fit(v.kept(frame(spark, rows)), parts=4)
    for row in v.compress(frame(spark, rows), parts=4).collect()[:50]:
        assert abs((((books.decode(row["code"]) - np.array(rows[row["vec_id"]][1])) * 256) ** 2).sum() - row["error"]) < 0.3 * row["error"] + 40
