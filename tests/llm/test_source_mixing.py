"""Source mixing against a plain recomputation, and its laws."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from plainlane.llm import source_mixing as m

SCHEMA = "doc_id long, text string, source string, quality double, size long, stratum int, mark string, q double, target int"


def targets(sizes, weights=(1, 2, 3), copies=3):
    """Water filling by hand: sizes by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, free = total - sum(copies * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        new = {s for s in names if s not in full and Fraction(w[s] * rest, free or 1) > copies * sizes[s]}
        if not new:
            return {s: copies * sizes[s] if s in full else Fraction(w[s] * rest, free or 1) for s in names}
        full |= new


def brute(rows):
    """Taken words by (doc_id, text, source), sorted."""
    docs = defaultdict(list)
    for i, t, s in rows:
        mark = hashlib.md5(f"{m.SEED}:{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        docs[s].append([i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), mark])
    sizes = {s: sum(d[1] for d in x) for s, x in docs.items()}
    goal, out = targets(sizes), []
    for s, x in docs.items():
        e = float(goal[s]) / sizes[s] if sizes[s] else 0.0
        whole, p = int(e), e - int(e)
        rest = max(float(goal[s]) - sum(whole * d[1] for d in x), 0.0)

        def rank(d, p=p):
            u = (int(d[2][:13], 16) * 2 + 1) / 2**53
            return (u / (1 - u)) / (p / (1 - p)), d[2]

        x = sorted(x, key=rank) if p > 0 else x
        taken, at = 0, 0
        while p > 0 and at < len(x) and taken + x[at][1] <= rest:
            taken += x[at][1]
            at += 1
        more = set(range(at))
        left = [(abs(rest - taken - d[1]), rank(d), k) for k, d in enumerate(x) if k >= at] if p > 0 else []
        if left and min(left)[0] < rest - taken:
            closing = min(left)[2]
            over = taken + x[closing][1] - rest
            drop = [(abs(over - d[1]), rank(d), k) for k, d in enumerate(x) if k < at]
            if over > 0 and drop and min(drop)[0] < over:
                more.remove(min(drop)[2])
            more.add(closing)
        out += [(d[0], s, d[1], sizes[s], float(goal[s]), (whole + (k in more)) * d[1]) for k, d in enumerate(x)]
    return out


def rows_of(n=700, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choice(["a"] * 12 + ["b", "B", "é", None, "", "tiny", "漢"])
        rows.append((None if i % 50 == 0 else i, None if i % 31 == 0 else "w " * int(r.paretovariate(1.1) * 3) + " \n", s))
    rows += [rows[5]] * 4 + [(999, "", "empty"), (998, None, "empty"), (1000, "x " * 40_000, "a")]
    return rows


def key(row):
    return tuple((a is None, a or 0) for a in row)


@pytest.mark.parametrize("range_rows", [20_000, 10])
def test_mix(spark, range_rows):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1.0, 2, 3, "m", 0.5, 4) for r in rows], SCHEMA).repartition(3)
    got = m.mix(docs, range_rows=range_rows).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    taken, largest = Counter(), Counter()
    for row in got:
        assert row["taken"] <= 3 * row["size"]
        taken[row["source"]] += row["taken"]
        largest[row["source"]] = max(largest[row["source"]], row["size"])
    for s, t in {(row["source"], row["target"]) for row in got}:
        # one document is nearly all of source a
        assert abs(taken[s] - t) <= max(5, 0.02 * t, 0.05 * largest[s]), s


def test_weights_make_documents_likelier(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(1, 40), f"s{i % 3}", [0.0, 0.5, 4.0, None][i % 4], 2, 3, "m", 0.5, 4) for i in range(1500)]
    got = m.mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 1, 2), weight_col="quality").collect()
    by, taken, goal = defaultdict(list), Counter(), {}
    for row in got:
        q = rows[row["doc_id"]][3]
        by[row["source"], q].append(row["copies"])
        assert row["copies"] <= 3 and (q or row["copies"] == 0 or row["copies"] == 1)
        taken[row["source"]] += row["taken"]
        goal[row["source"]] = row["target"]
    for s in goal:
        assert abs(taken[s] - goal[s]) < 0.02 * goal[s]
        assert sum(by[s, 4.0]) / len(by[s, 4.0]) > sum(by[s, 0.5]) / len(by[s, 0.5])
        assert sum(by[s, None]) + sum(by[s, 0.0]) <= 1  # at most the closing one


def test_inclusion_follows_the_odds(spark):
    """Over seeds, a document's mean copies are near its expected ones."""
    rows = [(i, "w " * (1 + i % 7), "a" if i % 4 else "b", 1.0, 2, 3, "m", 0.5, 4) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    total = Counter()
    seeds = 3
    for k in range(seeds):
        for row in m.mix(docs, weights=(3, 5), seed=f"s{k}").collect():
            total[row["source"]] += row["copies"]
    sizes = Counter()
    for i, t, s, *_ in rows:
        sizes[s] += len(t.split())
    goal = targets(sizes, (3, 5))
    n = Counter(s for _, _, s, *_ in rows)
    for s in n:
        assert abs(total[s] / (n[s] * seeds) - float(goal[s]) / sizes[s]) < 0.12


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert m.mix(none).count() == 0
    assert [row["taken"] for row in m.mix(spark.createDataFrame([(1, None, None, 1.0, 1, 1, "m", 0.5, 1)], SCHEMA)).collect()] == [0]
