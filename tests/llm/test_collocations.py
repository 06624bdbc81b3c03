"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from plainlane.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, k int, cells int"
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_count, most=4, inside=80, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        f = {p: n for p, n in own.items() if n >= min_count}
        kept = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def corpus():
    r = random.Random(5)
    words = ["the", "The", "of", "é", "漢字", "Ärger", "a b", "x-y", "und", "\x00", "'"] + [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(120):
        n = r.randint(1, 60)
        texts.append("".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " ; ", "\r\n", "\x0b"]) for _ in range(n)))
    texts += ["new york city is big " * 40, "the the the the the the", None, "", " \n\t.,", ".", "one", "a" * 50_000 + " the of the of", " ".join(r.choice(words) for _ in range(9000))]
    texts += texts[3:9]
    return [(t, r.choice(["en", "de", None, "und", "", "fr"])) for t in texts]


@pytest.mark.parametrize("bounds", [{}, {"most_cells": 1 << 16, "shard_bytes": 900, "candidate_bytes": 200}])
def test_collocations(spark, bounds):
    rows = corpus()
    docs = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, lang, "p", 3, 4, 5) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    for least, top in ((30, 2000), (4, 7)):
        got = sorted(map(tuple, c.collocations(docs, min_count=least, top=top, **bounds).collect()))
        want = brute(rows, least, top=top)
        assert got == want and got


def test_threshold_above_a_cell(spark):
    rows = [("a b " * 100 + ". " + "b c " * 20, "en")] * 5
    docs = spark.createDataFrame([(1, t, lang, "p", 3, 4, 5) for t, lang in rows], SCHEMA)
    assert sorted(map(tuple, c.collocations(docs, min_count=400).collect())) == brute(rows, 400)


def test_empty(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.collocations(spark.createDataFrame([(1, None, None, None, 1, 1, 1)], SCHEMA)).count() == 0


def test_paired():
    chunk = c.normalised([b"a b c d e. f g h i j k"])
    phrases = c.Phrases(chunk, "en", 4)
    read = lambda *at: c._paired(chunk, phrases, c.np.array(at, c.np.int64))
    # lone words go, one line end for each run of them, so that no phrase reaches over
    assert read() == b"" and read(0, 3) == b" a b \n d e \n \n " and read(1, 9) == b" \n b c \n j k "
    assert read(*range(10)) == chunk


def test_normalised():
    assert c.normalised([b"A  b\t.\n, C", b"", b" d"]) == b" a b \n c \n d "
    text = c.normalised([b"x y. " * 3000])
    assert b"".join(c.chunks(text, 100)) == text and max(map(len, c.chunks(text, 100))) < 110
