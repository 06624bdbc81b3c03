"""The training-data operators against brute force, on small tables with every awkward case."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from plainlane.llm import _common, byte_bpe, decontaminate, gru, line_dedup, minhash_dedup, secret_scan, sharding, substring_dedup, superminhash, token_counts, toxicity, transport_stream

#: Columns named like the operators' own ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor long, shard int, score double, numbers string, file string, bucket long, __score long"
LOWER = {i: i + 32 for i in range(65, 91)}


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "Ärger", "naïve", "漢字"]
    line = lambda n: " ".join(r.choices(words, k=n))
    passage, boiler = line(60), "Terms of use 2024 apply to this page here"
    out = [None, "", " ", "\n\n", "one", "A b\tc  d", "the of the of the of the of"]
    base = line(300)
    out += [base, base, base.upper(), base + " extra"]
    for k in range(12):
        w = base.split()
        for _ in range(r.randint(1, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        out.append(" ".join(w))
    out += [f"{line(25)} {passage} {line(10)}\n{boiler.replace('2024', str(2000 + k))}\n{line(7)}" for k in range(14)]
    out += [line(r.randint(1, 80)) for _ in range(20)]
    out.append(" ".join([passage, line(5), passage]))
    out.append("x" * 70000 + " " + line(9000))
    rows = list(enumerate(out))
    return [*rows, (None, base), (None, None), (5, out[5])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), 1, 2, 0.5, "n", "f", 7, 9) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, pattern=r"[^\x20\x09-\x0D]+", lower=True):
    return re.findall(pattern, (t or "").translate(LOWER) if lower else t or "")


def shingles(t):
    w = words(t)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        u = r.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = u[:400], np.concatenate((u[:300], u[400:500]))
        s = superminhash.signatures(np.concatenate((a, b)), np.array([0, 400, 800]))
        errors.append(superminhash.agreement(s[0], s[1]) - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.24 / superminhash.SLOTS) ** 0.5 * 1.15
    assert (superminhash.signatures(np.empty(0, np.uint64), np.array([0, 0])) == superminhash._EMPTY).all()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_minhash_against_all_pairs(docs, empty):
    got = minhash_dedup.near_duplicates(docs).collect()
    want = components(texts())
    assert len(got) == len(texts())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_minhash_large_mixed_bucket(spark):
    """A bucket of several hundred documents in which hubs do not link all: blocks and full sets decide."""
    r = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(620):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = components(rows)
    assert got == {i: c for i, (_, c) in want.items()}


def test_minhash_large_groups_share_buckets(spark):
    """Two groups of some hundreds that do not link but share bands, and documents in between: only these are compared."""
    r = random.Random(6)
    first = [f"b{k}" for k in range(120)]
    second = first[:94] + [f"c{k}" for k in range(26)]
    rows = []
    for k in range(600):
        w = list(first if k % 2 else second)
        w[-1 - r.randrange(3)] = f"x{k}"
        rows.append((k, " ".join(w)))
    for k in range(30):
        rows.append((600 + k, " ".join(first[: r.choice((84, 118))] + [f"y{k}z{j}" for j in range(20)])))
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, (_, c) in components(rows).items()}
    assert got == want and sorted(Counter(want.values()).values())[-2:] == [300, 315]


def test_bpe_matches_tiktoken_and_round_trips(docs, empty):
    import public_tokenizers as P
    import tiktoken

    v = byte_bpe.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "²", "!", "漢", "😀", "\x1c", "\x85"]
    many = ["".join(r.choices(parts, k=r.randrange(24))) for _ in range(4000)] + ["z" * 3000, "ab" * 2000, ""]
    raw = [t.encode() for t in many]
    offsets = np.cumsum([0] + [len(b) for b in raw]).astype(np.int64)
    got = [(ids, ends.tolist(), parts) for ids, ends, parts in byte_bpe.encode_texts(np.frombuffer(b"".join(raw), np.uint8), offsets, v)]
    assert [g[0] for g in got] == [enc.encode_ordinary(t) for t in many]
    for b, (ids, ends, pieces) in zip(raw, got):
        assert v.decode(ids) == b and (ends[-1] if ends else 0) == len(b)
        if len(ends) > 2:  # offsets let the middle decode alone
            n = len(pieces[0])
            assert v.decode(ids[n : n + len(pieces[1])]) == b[ends[0] : ends[1]]
    by_id = dict(texts()[:-1])
    for r in byte_bpe.round_trip(docs).where("doc_id is not null").collect():
        ids, t = enc.encode_ordinary(by_id[r.doc_id] or ""), (by_id[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest())
    encoded = byte_bpe.encode(docs)
    assert {r.doc_id: bytes(r.content) for r in byte_bpe.decode(encoded).where("doc_id is not null").collect()} == {i: (t or "").encode() for i, t in by_id.items() if i is not None}
    assert byte_bpe.round_trip(empty).count() == 0


def test_token_counts(spark, docs, empty):
    r = np.random.default_rng(0)
    rows, want = [], {}
    for f in range(6):
        ids = r.integers(0, 6, 2500)
        ids = np.ones(700, int) if f == 3 else ids
        size = 3 + 8 * f
        rows += [(f, k // size, ids[k : k + size].astype("<u4").tobytes()) for k in range(0, len(ids), size)]
        run = nth = 0
        for x in ids.tolist():
            if x == 0:
                want[f, nth] = (run, True)
                run, nth = 0, nth + 1
            else:
                run += 1
        if run:
            want[f, nth] = (run, False)
    blocks = spark.createDataFrame([*rows, (99, 0, None), (98, 0, b"")], "file int, block int, tokens binary").repartition(4)
    span, token_counts.SPAN = token_counts.SPAN, 16
    try:
        got = {(x.file, x.nth): (x.n_tokens, x.ended) for x in token_counts.count_tokens(blocks, width=4, separator=0).collect()}
    finally:
        token_counts.SPAN = span
    assert got == want
    stream = token_counts.write_stream(docs, block_tokens=50)
    listed = stream.where("tokens is null").select("file", "nth", "doc_id")
    n = listed.join(token_counts.count_tokens(stream.where("tokens is not null")), ["file", "nth"])
    expected = Counter((r.doc_id, r.n_tokens) for r in byte_bpe.encode(docs).select("doc_id", "n_tokens").collect())
    assert Counter((r.doc_id, r.n_tokens) for r in n.collect()) == expected
    assert token_counts.write_stream(empty).count() == 0


def test_flat_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, 6, 50256, 50256, 7], "<u2").tobytes())
    got = token_counts.count_tokens(token_counts.read_files(spark, str(tmp_path), block_tokens=2)).orderBy("nth").collect()
    assert [(r.n_tokens, r.ended) for r in got] == [(2, True), (0, True), (1, False)]


def templates(rows, least):
    lines = {}
    for i, t in rows:
        if i is not None:
            for k, x in enumerate((t or "").split("\n")):
                if w := words(x, lower=False):
                    lines[i, k] = (len(w), tuple("<*>" if re.search("[0-9]", y) else y for y in w[:3]), tuple(w))
    docs_of = lambda key: {k: len(v) for k, v in key.items()}
    leaf, kind = {}, {}
    for (i, _), (n, head, w) in lines.items():
        leaf.setdefault((n, head), set()).add(i)
        kind.setdefault((n, head, w), set()).add(i)
    leaf, count = docs_of(leaf), docs_of(kind)
    place = Counter()
    for (n, head, w), c in count.items():
        if leaf[n, head] >= least:
            place.update({(n, head, k, y): c for k, y in enumerate(w)})
    found = {}
    for at, (n, head, w) in lines.items():
        if leaf[n, head] >= least:
            t = tuple(y if place[n, head, k, y] >= least else None for k, y in enumerate(w))
            if 10 * sum(y is not None for y in t) >= 7 * n:
                found.setdefault((n, head, t), []).append(at)
    lost = set()
    for ats in found.values():
        ids = {i for i, _ in ats}
        if len(ids) >= least:
            lost |= {(i, k) for i, k in ats if i != min(ids)}
    return lost


def test_line_dedup(docs, empty):
    lost = templates(dict(texts()[:-1]).items(), 10)
    assert any("Terms of use" in texts()[i][1].split("\n")[k] for i, k in lost)
    got = line_dedup.drop_recurring(docs).collect()
    assert len(got) == len(texts())
    by_id = dict(texts()[:-1])
    for r in got:
        if r.doc_id is not None:
            t = by_id[r.doc_id] or ""
            want = "\n".join(x for k, x in enumerate(t.split("\n")) if (r.doc_id, k) not in lost)
            assert (r.kept, r.n_dropped) == (want, sum(i == r.doc_id for i, _ in lost))
        else:
            assert r.n_dropped == 0
    assert line_dedup.drop_recurring(empty).count() == 0


UPDATED = "This article was last updated by the editorial team on {} {} {} at {:02d}:{:02d}"


def without_lines(spark, lines):
    """How many of the lines, each with a word of its own document above it, the pipeline's stage keeps, by their doc_id."""
    import corpus_pipeline

    rows = [(i, f"own{i}\n{x}", "en", "s", 0) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    return [i for i, _, *_ in rows if "\n" in got.get(i, "")]


@pytest.mark.parametrize("n", [40, 40000])
def test_templates_do_not_depend_on_the_size_of_the_corpus(spark, n):
    r = random.Random(4)
    months = "January February March April May June July August September October November December".split()
    lines = [UPDATED.format(r.randint(1, 28), months[i % 12], r.randint(2015, 2024), r.randrange(24), r.randrange(60)) for i in range(n)]
    assert without_lines(spark, lines) == [0]


def test_short_templates_and_small_groups_of_lines(spark):
    names = [f"{a}{b}" for a in ("Al", "Be", "Cy", "Do", "Ed", "Fa") for b in ("an", "bert", "cy", "dora", "eth")]
    assert without_lines(spark, [f"Posted by {x} on 2021-03-{i:02d}" for i, x in enumerate(names)]) == [0]  # every name rare
    assert without_lines(spark, [f"Posted by {names[i % 2]} on 2021-03-{i:02d}" for i in range(40)]) == [0, 1]
    assert without_lines(spark, [f"Page {i}" for i in range(40)]) == [0]
    assert without_lines(spark, ["Share this with a friend"] * 3 + ["only in two"] * 2) == [0, 3, 4]
    prose = [f"There is a {x} {y}" for x, y in zip(names, names[1:])]
    assert without_lines(spark, prose) == list(range(len(prose)))
    digits = [f"{i} {i * i} {i + 7}" for i in range(40)]
    assert without_lines(spark, digits) == list(range(40))


def test_decontamination(spark, docs, empty):
    rows = texts()
    long_ = rows[27][1].split()
    items = [(1, " ".join(long_[30:60])), (2, "ONE"), (3, "w1 w2 w3"), (4, None), (5, "!!!"), (10, " ".join(long_[40:53]) + ", tail"), (2, "unmatched words here"), (None, rows[30][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items:
        w = words(t, pattern)
        for k in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add("null" if i is None else str(i))
    want = {}
    for i, t in rows:
        w = words(t, pattern)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        want[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    for part in (decontaminate.PART_BYTES, 200):
        hits = decontaminate.contamination(docs.where("doc_id is not null"), bench) if part > 200 else None
        if hits is None:
            old, decontaminate.PART_BYTES = decontaminate.PART_BYTES, part
            decontaminate.automata.__defaults__ = (*decontaminate.automata.__defaults__[:-1], part)
            hits = decontaminate.contamination(docs.where("doc_id is not null"), bench)
            clean = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
            decontaminate.PART_BYTES = old
            decontaminate.automata.__defaults__ = (*decontaminate.automata.__defaults__[:-1], old)
        else:
            clean = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
        for r in decontaminate.verdicts(hits).collect():
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == want[r.doc_id]
        assert clean - {None} == {i for i, x in want.items() if i is not None and not x[3]}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.verdicts(decontaminate.contamination(docs, bench.limit(0))).where("n_hit > 0").count() == 0


def in_parts(part_bytes):
    """automata() of parts of that size by default."""
    decontaminate.automata.__defaults__ = (*decontaminate.automata.__defaults__[:-1], part_bytes)


def test_rows_are_judged_alone_by_several_automata(spark):
    own = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    bench = spark.createDataFrame([(1, own("i", 30)), (2, own("j", 30)), (3, own("k", 30))], "item_id long, text string")
    bad, clean = f"{own('i', 15)} {own('j', 14)} {own('a', 5)}", own("b", 40)
    docs = spark.createDataFrame([(None, bad), (None, clean), (None, bad), (7, bad), (7, bad), (8, clean), (8, clean)], "doc_id long, text string")
    try:
        in_parts(100)
        hits = [(x.doc_id, x.n_words, x.spans, x["items"]) for x in decontaminate.contamination(docs, bench).collect()]
        kept = [tuple(x) for x in decontaminate.clean_documents(docs, bench).collect()]
    finally:
        in_parts(decontaminate.PART_BYTES)
    want = [(i, 34, [[0, 29]], ["1", "2"]) if t == bad else (i, 40, [], []) for i, t in [(None, bad), (None, clean), (None, bad), (7, bad), (7, bad), (8, clean), (8, clean)]]
    assert sorted(hits, key=str) == sorted(want, key=str)
    assert sorted(kept, key=str) == sorted([(None, clean), (8, clean), (8, clean)], key=str)


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 100])
def test_benchmark_passages_are_cut(spark, tmp_path, part_bytes):
    import corpus_pipeline

    own = lambda a, n: " ".join(f"ö{a}x{k}" for k in range(n))
    item, short, tiny = own("i", 40), own("s", 9), "tiny item"
    spark.createDataFrame([(1, item), (2, short), (3, tiny)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [
        (1, f"{own('a', 500)}, ({item.upper().replace('Ö', 'ö')})!\n{own('b', 400)} {tiny}", f"{own('a', 500)}, ()!\n{own('b', 400)} {tiny}"),
        (2, f"{own('c', 300)} {short} {own('d', 300)} {short}", f"{own('c', 300)}  {own('d', 300)} "),
        (3, f"{own('e', 30)} {item}", None),
        (4, own("f", 50), own("f", 50)),
        (5, None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        in_parts(part_bytes)
        got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    finally:
        in_parts(decontaminate.PART_BYTES)
    assert got == {i: (left, 7 if left == t else len(left)) for i, t, left in rows if i != 3}


def test_substring_dedup(docs, empty):
    seen, want = {}, {}
    for i, t in sorted((x for x in texts()[:-1] if x[0] is not None), key=lambda x: x[0]):
        w = words(t, lower=False)
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(texts()) and sum(x[1] for x in want.values()) > 1000
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == want[r.doc_id]
    spans = substring_dedup.maximal_repeats(docs).collect()
    assert all(r.end - r["first"] >= 20 and (r.source_id, r.source_first) < (r.doc_id, r["first"]) for r in spans)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_frequent_passage(spark):
    """A passage in all documents, several times in some, and a run of one word: tasks settle their own repeats first."""
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, " ".join([*(f"u{r.randrange(10**6)}" for _ in range(12)), passage, *(["same"] * (i % 50)), passage if i % 7 == 0 else "end"])) for i in range(400)]
    rows += rows[:5]
    seen, want = set(), set()
    for i, t in sorted(set(rows)):
        w = t.split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                want.add((i, k))
            seen.add(key)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {(x.doc_id, x.at + k) for x in substring_dedup.repeated_places(docs).collect() for k in range(x.n)} == want
    found = substring_dedup.repeated_windows(docs).collect()
    assert {(x.doc_id, x.at) for x in found} == want and len(want) > 5000
    assert all((x.source_id, x.source_at) < (x.doc_id, x.at) for x in found)


def test_network_gradients():
    p = gru.new_parameters(3, 8)
    r = np.random.default_rng(0)
    v = r.standard_normal((9, 16)).astype(np.float32)
    index, mask = r.integers(0, 9, (5, 6)), np.ones((5, 6), np.float32)
    mask[0, 4:] = 0
    y, w = np.array([1, 0, 1, 0, 1], np.float32), np.ones(5, np.float32)
    _, grad, _ = gru.gradients(p, v, index, mask, y, w)
    for k in ("wx", "wh", "wa", "va", "wo"):
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old = p[k][i]
        p[k][i] = old + 1e-2
        up = gru.gradients(p, v, index, mask, y, w)[0]
        p[k][i] = old - 1e-2
        down = gru.gradients(p, v, index, mask, y, w)[0]
        p[k][i] = old
        assert abs((up - down) / 2e-2 - grad[k][i]) < 0.03 * abs(grad[k][i]) + 1e-4
    projected = gru.project(p, v)
    assert np.allclose(gru._run(p, projected, index, mask, []), gru._infer(p, projected, index, mask), atol=1e-5)


def test_toxicity_held_out(spark, docs, empty):
    r = random.Random(2)
    syllables = "ba ce di fo gu ha je ki lo mu ne pa".split()
    plain = lambda n: " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        t = plain(r.randint(5, 120)).split()
        if bad:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["zorgat", "Zorgel!", "zorgin", "vuxx"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (1, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = {x.doc_id: x.score for x in toxicity.toxicity(d, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(labels[i][1]) for i in held) / len(held) > 0.95
    out = toxicity.with_scores(docs, model, "__own").collect()
    assert len(out) == len(texts()) and all(0 <= x["__own"] <= 1 for x in out)
    assert {round(x["__own"], 9) for x in out if not words(x.text)} == {round(model.base, 9)}
    assert toxicity.toxicity(empty, model).count() == 0
    constant = toxicity.fit(d, lab.where("toxic = 0"))
    assert {x.score for x in toxicity.toxicity(d.limit(3), constant).collect()} <= {constant.base} or constant.base < 0.5


def plain_score(model, text):
    """The probability of a text by the definition: one word, window and step after another, in Python numbers."""
    M = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
        x = (x ^ x >> 27) * 0x94D049BB133111EB & M
        return x ^ x >> 31

    def number(w):
        h = sum(int(_common._BYTE[b]) * pow(int(_common._P), k, 1 << 64) for k, b in enumerate(w))
        found = np.flatnonzero(model.words == np.uint64(mix((h + len(w)) & M)))
        return int(found[0]) + 1 if len(found) else 0

    def vector(w):
        marked = [mix((x + 0x632BE59BD9B4E019) & M) for x in (1, *w, 1)]
        grams = []
        for k in toxicity.GRAMS:
            for a in range(len(marked) - k + 1):
                x = 0
                for y in marked[a : a + k]:
                    x = (x * 0x9E3779B97F4A7C15 + y) & M
                grams.append(mix((x + k) & M) % toxicity.BUCKETS)
        p = model.p
        char = np.mean([p["char"][g].astype(float) for g in grams], axis=0) if grams else np.zeros(gru.CHAR_DIM)
        return np.concatenate((p["word"][number(w)], char))

    p = {k: np.asarray(v, float) for k, v in model.p.items() if k not in ("word", "char")}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def direction(d, vectors):
        h, n, out = np.zeros(gru.HIDDEN), gru.HIDDEN, []
        for v in vectors:
            x, g = v @ p["wx"][:, d] + p["b"][d], h @ p["wh"][d]
            z, r = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
            h = (1 - z) * np.tanh(x[2 * n :] + r * g[2 * n :]) + z * h
            out.append(h)
        return out

    def logit(vectors):
        states = [np.concatenate(x) for x in zip(direction(0, vectors), direction(1, vectors[::-1])[::-1])]
        weights = np.exp([np.tanh(s @ p["wa"] + p["ba"]) @ p["va"] for s in states])
        return sum(w * s for w, s in zip(weights / weights.sum(), states)) @ p["wo"] + p["bo"][0]

    found = []
    for w in words(text):
        b = w.encode()
        for _ in range(3):
            b = b[1:] if len(b) > 1 and b[0] < 128 and chr(b[0]) in string.punctuation else b
            b = b[:-1] if len(b) > 1 and b[-1] < 128 and chr(b[-1]) in string.punctuation else b
        found.append(vector(b))
    if not found:
        return model.base
    n = len(found)
    firsts = sorted({min(k, max(n - 24, 0)) for k in range(0, max(n - 24, 0) + 12, 12)})
    x = sorted((max(-12, min(12, logit(found[k : k + 24]))) for k in firsts), reverse=True)
    f = [1, x[0], sum(x[:3]) / len(x[:3]), sum(y > 0 for y in x) / len(x), math.log1p(len(x))]
    return sigmoid(np.dot(f, model.scale))


def test_toxicity_against_plain_scores(spark, docs):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["(Vuxx!)", "zorgat,", "Ärger"]
    rows = [(i, " ".join(r.choices(vocabulary[: 60 if i % 2 else 63], k=r.randint(1, 90))), i % 2) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d)
    assert len(model.words) > 30
    got = {x.doc_id: x.score for x in toxicity.toxicity(d, model).collect()}
    for i, t, _ in rows[:60]:
        assert abs(got[i] - plain_score(model, t)) < 1e-3
    assert len(set(got.values())) > 100
    by_id = dict(texts()[:-1])
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, model).where("doc_id is not null").collect()}
    for i in (k for k in by_id if k is not None and len(by_id[k] or "") < 3000):
        assert abs(got[i] - plain_score(model, by_id[i])) < 1e-3
    long = " ".join(r.choices(vocabulary, k=20000))  # many windows, over several chunks
    got = toxicity.toxicity(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()["score"]
    assert abs(got - plain_score(model, long)) < 1e-3


def test_toxicity_sample_is_bounded(spark):
    rows = [(i, "x" * 100 * (1 + (i % 50 == 7)), i % 2) for i in range(200)] + [(3, "y", 1), (None, "z", 1), (8, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got, share = toxicity.sample(d, d)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert [i for i, _, _ in got] == held and abs(share - sum(i % 2 for i in held) / len(held)) < 1e-9
    assert dict((i, t) for i, _, t in got).get(3, b"y") == b"y"
    got, _ = toxicity.sample(d, d, toxic_docs=30, clean_docs=20, text_bytes=150, sample_bytes=1500)
    assert 0 < len(got) <= 31 and all(len(t) <= 150 for _, _, t in got)
    assert all(sum(len(t) for _, y, t in got if y == k) <= 1500 for k in (0, 1))


def test_windows_cover_all_words():
    for n in (1, 5, 23, 24, 25, 36, 37, 100):
        first, owner = toxicity.windows(np.array([0, n, n, n + 3]))
        covered = {k for f, o in zip(first, owner) if o == 0 for k in range(f, min(f + toxicity.LENGTH, n))}
        assert covered == set(range(n)) and (owner == 1).sum() == 0 and (owner == 2).sum() == 1


def test_sharding(docs, empty):
    for shards in (1, 3, 24):
        got = sharding.interleave(docs, shards).collect()
        assert len(got) == len(texts())
        n = Counter(r.shard for r in got)
        sizes = [n.get(k, 0) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        for k in n:
            assert sorted(r.slot for r in got if r.shard == k) == list(range(n[k]))
    by_source = Counter((r.source, r.shard) for r in sharding.interleave(docs, 3).collect())
    for s in ("s0", "s1", "s2"):
        c = [by_source[s, k] for k in range(3)]
        assert max(c) - min(c) <= 1
    by_id = dict(texts()[:-1])
    for r in got:
        if r.doc_id is not None:
            raw = (by_id[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.interleave(empty).count() == 0


def test_secret_features_agree_and_forest_generalises(spark):
    fresh = secret_scan.labelled_findings(600, seed=77)
    assert sum((secret_scan.score_of(s, b, a) >= secret_scan.THRESHOLD) == bool(y) for s, b, a, y in fresh) / len(fresh) > 0.97
    rows = [(k, f"{b}{s}{a}") for k, (s, b, a, _) in enumerate(fresh[:200])] + [(900, None), (901, ""), (None, 'token = "0123456789abcdef0123456789abcdef01234567"'), (902, "no candidates at all")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, nth long, score string")
    got = secret_scan.secrets(d).collect()
    for r in got:
        if r.doc_id is not None and r.doc_id < 200:
            t = rows[r.doc_id][1]
            assert t[r.start : r.start + len(r.candidate)] == r.candidate
            end = r.start + len(r.candidate)
            spans = [m.span() for m in re.finditer(secret_scan.CANDIDATE, t)]
            k = spans.index((r.start, end))
            before, after = t[spans[k - 1][1] if k else 0 : r.start], t[end : spans[k + 1][0] if k + 1 < len(spans) else len(t)]
            assert r.score == secret_scan.score_of(r.candidate, before, after)
    assert [r.is_secret for r in got if r.doc_id is None] == [True] and not [r for r in got if r.doc_id in (900, 901, 902)]
    assert secret_scan.secrets(d.limit(0)).count() == 0


def test_transport_stream(docs, empty):
    for n in [0, 1, 63, 64, 65, 8160, 8192, 8193, *range(150, 900, 7), 70000]:
        raw = random.Random(n).randbytes(n)
        s = transport_stream.demux(transport_stream.mux(transport_stream.padded(raw)))
        assert s.payload == transport_stream.padded(raw) and not s.errors and not s.discontinuities and s.programs == {1: 0x1000}
        assert s.stamps == sorted(s.stamps) and s.access_points[0] == (0, 2)
    media = transport_stream.mux(bytes(9000))
    assert transport_stream.demux(media[: 188 * 20] + media[188 * 21 :]).discontinuities == 1
    assert transport_stream.demux(b"\x00" + media[1:]).errors and transport_stream.demux(b"").payload == b""
    by_id = dict(texts()[:-1])
    for r in transport_stream.media_column(docs).collect():
        if r.doc_id is not None:
            raw = (by_id[r.doc_id] or "").encode()
            whole = transport_stream.padded(raw)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
            assert bytes(r.media)[:1] == b"\x47" and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
    assert transport_stream.media_column(empty).count() == 0


def section_ok(x):
    """The CRC-32 of a table section, bit by bit: its remainder is zero."""
    c = 0xFFFFFFFF
    for bit in "".join(f"{b:08b}" for b in x):
        top = c >> 31 ^ int(bit)
        c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return c == 0


def plain_reader(media):
    """A transport stream read packet by packet by the standard's bit fields: (feature, payload)."""
    bits = lambda b, at, n: int("".join(f"{x:08b}" for x in b)[at : at + n], 2)
    programs, streams, units, points, last, gaps = {}, {}, [], [], {}, 0
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    for at, x in enumerate(packets):
        assert len(x) == 188 and x[0] == 0x47 and bits(x, 8, 1) == 0 and bits(x, 24, 2) == 0
        begins, pid, field, payload, counter = bits(x, 9, 1), bits(x, 11, 13), bits(x, 26, 1), bits(x, 27, 1), bits(x, 28, 4)
        assert payload
        gaps += pid in last and (last[pid] + 1) % 16 != counter
        last[pid] = counter
        rest, access = x[4:], False
        if field:
            if rest[0]:
                access = bits(rest, 9, 1)
                if bits(rest, 11, 1):
                    base, extension = bits(rest, 16, 33), bits(rest, 55, 9)
                    assert extension == 0 and base == len(units) * 3600
            rest = rest[1 + rest[0] :]
        if pid in (0, *programs.values()):
            section = rest[1 + rest[0] :]
            section = section[: 3 + bits(section, 12, 12)]
            assert begins and section_ok(section) and section[0] == (0 if pid == 0 else 2)
            if pid == 0:
                programs |= {bits(section, k * 8, 16): bits(section, k * 8 + 19, 13) for k in range(8, len(section) - 4, 4)}
            else:
                streams[bits(section, 12 * 8 + 11, 13)] = section[12]
        else:
            assert pid in streams
            if begins:
                units.append(b"")
                if access:
                    points.append((len(units) - 1, at))
            units[-1] += rest
    stamps, payload = [], b""
    for x in units:
        assert x[:3] == b"\0\0\1" and bits(x, 32, 16) == len(x) - 6 and bits(x, 56, 2) == 2 and bits(x, 72, 4) == 2
        stamps.append(bits(x, 76, 3) << 30 | bits(x, 80, 15) << 15 | bits(x, 96, 15))
        payload += x[9 + x[8] :]
    access = ",".join(f"{stamps[n]}@{at}" for n, at in points)
    names = ",".join(f"{k}:{v}" for k, v in sorted(streams.items()))
    feature = f"ts;programs={len(programs)};streams={names};packets={len(packets)};units={len(units)};pts={min(stamps)}-{max(stamps)};access={access};gaps={gaps};errors=0"
    return feature, payload


def test_transport_stream_against_a_plain_reader(docs):
    by_id = dict(texts()[:-1])
    rows = transport_stream.media_column(docs).collect()
    assert len(rows) == len(texts())
    for r in rows:
        feature, payload = plain_reader(bytes(r.media))
        assert feature == r.feature and hashlib.sha256(payload).hexdigest() == r.payload_sha256
        if r.doc_id is not None:
            assert payload == transport_stream.padded((by_id[r.doc_id] or "").encode())


def test_transport_stream_tables_and_repeated_packets():
    """Tables over several packets, packets sent twice, marked discontinuities and tables cut off."""
    t = transport_stream
    raw = random.Random(1).randbytes(30000)
    media = t.mux(raw)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = b"".join(x + x for x in packets)
    assert (t.demux(twice).payload, t.demux(twice).discontinuities, t.demux(twice).errors) == (raw, 0, [])
    assert t.demux(b"".join([*packets[:6], packets[5], packets[5], *packets[6:]])).payload == raw
    body = bytes([0xE0 | t.ES_PID >> 8, t.ES_PID & 255, 0xF0 | 400 >> 8, 400 & 255, *bytes(400), t.STREAM_TYPE, 0xE0 | t.ES_PID >> 8, t.ES_PID & 255, 0xF0, 0])
    section = b"\0" + t._section(0x02, 1, body)
    parts = [section[i : i + 184] for i in range(0, len(section), 184)]
    table = [bytes([0x47, (0x40 if k == 0 else 0) | 0x10, 0, 0x10 | k]) + x.ljust(184, b"\xff") for k, x in enumerate(parts)]
    long = b"".join([packets[0], *table, *packets[2:]])
    assert len(table) == 3 and (t.demux(long).payload, t.demux(long).streams, t.demux(long).errors) == (raw, {t.ES_PID: t.STREAM_TYPE}, [])
    assert t.demux(b"".join([packets[0], *table[:2], *packets[2:]])).errors == ["bad program map table"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    syllables = "ba ce di fo gu ha je ki lo mu ne pa".split()
    plain = lambda n: " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) + str(r.randrange(50)) for _ in range(n))
    rows = [(i, plain(900 if i % 4 == 3 else 80)) for i in range(220)]
    toxic = {i for i in range(220) if i % 4 == 1}
    rows = [(i, t + " vuxx zorgat vuxx" if i in toxic else t) for i, t in rows]
    rows += [(500, rows[0][1]), (501, rows[2][1] + " tail"), (502, None), (503, "")]
    item = plain(40)
    rows += [(600, item), (601, plain(900) + " " + item)]
    rows = [(i, (t + "\nAll rights reserved by nobody at all") if t and i < 40 and i % 4 == 0 else t) for i, t in rows]
    for name, data, schema in (
        ("documents", [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(i, 1, int(i in toxic)) for i in range(220)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = {x.doc_id: x for x in docs.collect()}
        if name != "byte BPE":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = seen["toxicity"]
    assert len(toxic - set(kept)) >= 0.95 * len(toxic) and len([i for i in range(220) if i not in toxic and i in kept]) >= 160
    assert sum("All rights" in (x.text or "") for x in seen["line dedup"].values()) == 1
    assert all(x.n_chars == len(x.text or "") for x in seen["line dedup"].values())
    assert not {500, 501} & set(seen["near dedup"]) and {502, 503} <= set(seen["near dedup"])
    assert 600 not in seen["decontamination"] and 601 in seen["decontamination"]
    assert set(seen["byte BPE"]) == set(seen["decontamination"]) and seen["byte BPE"][502].n_tokens == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["byte BPE"])


def plain_lines(rows):
    """{(doc_id, line number)} that the pipeline's stage drops, by its rule (templates by share, and equal lines)."""
    has_digit = lambda w: re.search("[0-9]", w) is not None
    masked = lambda w, k: tuple("<*>" if has_digit(y) else y for y in w[:k])
    lines = {(i, k): tuple(w) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if (w := words(x, lower=False))}

    def leaves(depth, among):
        out = {}
        for at in among:
            w = lines[at]
            out.setdefault((depth, len(w), masked(w, depth)), []).append(at)
        return {k: v for k, v in out.items() if len({i for i, _ in v}) >= 10}

    deep = leaves(3, lines)
    placed = {at for v in deep.values() for at in v}
    found = {}
    for leaf, ats in (deep | leaves(2, set(lines) - placed)).items():
        kinds = {(i, lines[i, k]) for i, k in ats}
        docs = Counter(w for _, w in kinds)
        place = Counter()
        for w, c in docs.items():
            place.update({(k, y): c for k, y in enumerate(w)})
        for at in ats:
            w = lines[at]
            fixed = [y if place[k, y] >= 10 else None for k, y in enumerate(w)]
            shared = [y if y and not has_digit(y) and place[k, y] * 10 >= 3 * len(kinds) else None for k, y in enumerate(fixed)]
            n_shared, n_digit, n_fixed = sum(y is not None for y in shared), sum(map(has_digit, w)), sum(y is not None for y in fixed)
            if n_shared and 10 * (n_shared + n_digit) >= 7 * len(w):
                found.setdefault(("shared", leaf, tuple(shared)), []).append(at)
            elif 10 * n_fixed >= 7 * len(w):
                found.setdefault(("fixed", leaf, tuple(fixed)), []).append(at)
    lost = set()
    for ats in found.values():
        ids = {i for i, _ in ats}
        lost |= {at for at in ats if len(ids) >= 10 and at[0] != min(ids)}
    equal = {}
    for at, w in lines.items():
        equal.setdefault(w, []).append(at)
    for ats in equal.values():
        ids = {i for i, _ in ats}
        lost |= {at for at in ats if len(ids) >= 3 and at[0] != min(ids)}
    return lost


def plain_clean(t, items):
    """A text without benchmark passages; None if it is contaminated."""
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    raw = (t or "").encode()
    lower = lambda b: b.translate(bytes(LOWER.get(k, k) for k in range(256)))
    at = [m.span() for m in re.finditer(pattern, lower(raw))]
    w, windows = [lower(raw[a:b]) for a, b in at], set()
    for x in items:
        y = re.findall(pattern, lower((x or "").encode()))
        windows |= {tuple(y[k : k + 13]) for k in range(max(len(y) - 12, 1))} if y else set()
    hit = set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    if hit and 20 * len(hit) >= len(w):
        return None
    spans = []
    for k in sorted(hit):
        spans = [*spans[:-1], (spans[-1][0], k)] if spans and spans[-1][1] == k - 1 else [*spans, (k, k)]
    for a, b in reversed(spans):
        if b - a + 1 >= 8:
            raw = raw[: at[a][0]] + raw[at[b][1] :]
    return raw.decode()


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, against plain Python over all rows; nulls, empty texts and extra columns."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    r = random.Random(11)
    syllables = "ba ce di fo gu ha je ki lo mu ne pa".split()
    plain = lambda n: " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) + str(r.randrange(40)) * r.randrange(2) for _ in range(n))
    item, short = plain(30), plain(9)
    data = []
    for i in range(150):
        t = plain(450 if i % 7 == 0 else r.randint(40, 90))
        if i % 5 == 1:
            t += " vuxx zorgat vuxx"
        if i % 3 == 0:
            t = f"Posted by {r.choice(['Al', 'Be', 'Cy'])} on 2021-03-{i % 28:02d}\n{t}\nAll rights reserved by nobody at all"
        if i % 50 == 2:
            t += "\nonly here and there in a few"
        data.append((i, t))
    data += [(500 + k, data[k][1]) for k in (0, 2, 7)]
    for k in range(6):  # at the threshold of 0.75 and on both sides of it
        w = [f"u{k}x{j}" for j in range(80)]
        data += [(600 + 2 * k, " ".join(w)), (601 + 2 * k, " ".join([*w[: 64 + 4 * k], *(f"v{k}x{j}" for j in range(4))]))]
    data += [(700, item), (701, f"{plain(700)}\n{item.upper()} {plain(20)}"), (702, f"{plain(400)}, {short}! {plain(10)}"), (703, plain(150) + " " + short)]
    data += [(800, None), (801, ""), (802, " \n "), (803, "All rights reserved by nobody at all"), (None, plain(30) + " naïve 漢字")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, numbers string, __id long, score double"
    d = spark.createDataFrame([(i, t, None, "s", len(t or ""), "n", 4, 0.5) for i, t in data], schema)
    tables = {
        "documents": d, "labels": spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(150)] + [(None, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item), (2, short), (3, None), (4, "")], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.drop("numbers", "__id", "score").write.parquet(f"{tmp_path}/{name}.parquet") if name == "documents" else df.write.parquet(f"{tmp_path}/{name}.parquet")

    model = toxicity.fit(d, tables["labels"])
    want = [(i, t) for i, t in data if plain_score(model, t) < 0.5]
    assert 20 < len(data) - len(want) < 60
    steps = [want]
    lost = plain_lines(want)
    assert len(lost) > 60
    out = []
    for i, t in want:
        if any(x == i for x, _ in lost):
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in lost)
            if not words(t):
                continue
        out.append((i, t))
    steps.append(out)
    keyed = [(i, t) for i, t in out if i is not None]
    groups = components(keyed)
    steps.append([(i, t) for i, t in out if i is None or groups[i][1] == i])
    assert 3 <= len(out) - len(steps[-1]) <= 10
    steps.append([(i, x) for i, t in steps[-1] if (x := plain_clean(t, [item, short, None, ""])) is not None])
    docs = d
    for (name, stage), rows in zip(corpus_pipeline.STAGES, steps):
        docs = stage(spark, docs, str(tmp_path)).cache()
        got = {x.doc_id: x for x in docs.collect()}
        assert docs.columns == d.columns and docs.count() == len(got)
        # a null text that loses nothing may come back as it is
        assert {i: x.text or "" for i, x in got.items()} == {i: t or "" for i, t in rows}, name
        assert all(x.n_chars == len(x.text or "") and (x.numbers, x["__id"], x.score) == ("n", 4, 0.5) for x in got.values())
    before, after = dict(steps[2]), dict(steps[3])
    assert len(before) > len(after) and any(before[i] != t for i, t in after.items())
    v = byte_bpe.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    ids = {x.doc_id: list(x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids == {i: enc.encode_ordinary(t or "") for i, t in steps[-1]}


def test_entries_are_complete():
    from plainlane.llm import entries

    assert sorted(int(k[2:].split("_")[0]) for k in entries.QUERIES if k != "pipeline") == list(range(1, 11)) and "pipeline" in entries.QUERIES
    assert set(entries.SQL) <= set(entries.QUERIES)


def test_repeated_rows_are_one_document_for_line_dedup(spark):
    """Rows that repeat a document turn no variable field into a constant, and all are cut alike."""
    rows = [(i, f"The same words stand in it but w{i}x") for i in range(10)]
    for how in (line_dedup.recurring_lines, line_dedup.templates):
        for more in (0, 9):
            docs = spark.createDataFrame(rows + rows[1:2] * more, "doc_id long, text string")
            got = {(x.doc_id, x.n_dropped, x.kept) for x in line_dedup.drop_recurring(docs, lost_lines=how).collect()}
            assert got == {(0, 0, rows[0][1])} | {(i, 1, "") for i in range(1, 10)}
    few = spark.createDataFrame([(1, "Only in one document it stands here")] * 12 + [(2, "another text")], "doc_id long, text string")
    assert line_dedup.drop_recurring(few, lost_lines=line_dedup.templates).agg({"n_dropped": "max"}).first()[0] == 0


def test_secret_candidates_against_brute_force(spark):
    """Context is what the text holds around a candidate; short values count after secrets' names only."""
    r = random.Random(4)
    key = lambda k, of="0123456789abcdef": "".join(r.choices(of, k=k))
    pieces = ["word ", "a_long_key_name_without_end=", "password=", "db_passwd: '", "version = ", "naïve ", "\n", "漢字 ", "; ", '"', "x=", "secret_access_key=\"", "commit ", "eightchr "]
    rows = [(i, "".join(r.choice(pieces) if r.random() < 0.7 else key(r.choice([4, 9, 12, 16, 40]), "abcdefXYZ012/+-") for _ in range(r.randint(1, 25)))) for i in range(150)]
    rows += [(200, "x" * 50000 + " " + "password=" + key(12) + " word" * 5000), (201, None), (202, "")]
    want = {}
    for i, t in rows:
        nth = 0
        for m in re.finditer(secret_scan.RUN, t or ""):
            before, after = t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 16]
            if re.match(secret_scan.CANDIDATE, m[0]) or re.search(secret_scan.SHORT_AFTER, before):
                want[i, nth] = (m.start(), m[0], secret_scan.score_of(m[0], before, after))
                nth += 1
    got = {(x.doc_id, x.nth): (x.start, x.candidate, x.score) for x in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({i for i, _ in want}) > 100


@pytest.mark.parametrize("name", ["secret=", "aws_secret_access_key=", 'AWS_SECRET_ACCESS_KEY = "', "GITHUB_ACCESS_TOKEN: ", "client.secret='"])
def test_secrets_after_long_names_are_found(spark, name):
    r = random.Random(7)
    for alphabet, size, least in (("0123456789abcdef", 40, 0.95), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 24, 0.9), ("abcdefghjkmnpqrstuvwxyzABCDEFGH0123456789", 11, 0.9)):
        rows = [(i, f"set {name}{''.join(r.choices(alphabet, k=size))}\" and go on") for i in range(100)]
        got = secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).where(f"is_secret and length(candidate) = {size}").select("doc_id").distinct().count()
        assert got >= 100 * least


def test_words_and_placeholders_are_no_secrets():
    fresh = secret_scan.more_findings(600, seed=78)
    assert sum((secret_scan.score_of(s, b, a) >= secret_scan.THRESHOLD) == bool(y) for s, b, a, y in fresh) / len(fresh) > 0.95


def test_substring_places_are_lean():
    """The words around a place are kept in six bytes each, and are read back as they were."""
    words = _common.mix(np.arange(1, 400, dtype=np.uint64))
    ranges, at = np.array([0, 150, 399]), np.array([0, 13, 60, 142, 150, 391])
    around = substring_dedup._contexts(words, ranges, at, np.searchsorted(ranges, at, "right") - 1, 12)
    column = substring_dedup._binary(around)
    assert (substring_dedup._around(column, 12) == around).all() and (substring_dedup._around(column.slice(2, 3), 12) == around[2:5]).all()
    assert (around[0, :12] == 0).all() and (around[2] != 0).all() and len(column[0].as_py()) == 24 * 6


def test_substring_several_contexts_of_one_anchor(spark):
    """A frequent short line with different words around it: places that equal an earlier one which is not the anchor's first."""
    r = random.Random(12)
    line = [f"f{k}" for k in range(10)]
    sides = [([f"l{v}x{k}" for k in range(12)], [f"r{v}x{k}" for k in range(12)]) for v in range(6)]
    rows = []
    for i in range(240):
        left, right = sides[r.randrange(6)][0], sides[r.randrange(6)][1]
        cut = r.randint(0, 12)
        rows.append((i, " ".join([*(f"u{r.randrange(10**6)}" for _ in range(r.randint(0, 6))), *left[cut:], *line, *right[: r.randint(0, 12)], f"v{i}"])))
    seen, want = set(), set()
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                want.add((i, k))
            seen.add(key)
    got = substring_dedup.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(x.doc_id, k) for x in got for k in range(x["first"], x.end - 19)} == want and len(want) > 200
    by_id = {i: t.split() for i, t in rows}
    for x in got:
        assert (x.source_id, x.source_first) < (x.doc_id, x["first"])
        assert by_id[x.doc_id][x["first"] : x.end] == by_id[x.source_id][x.source_first : x.source_first + x.end - x["first"]]


def test_secrets_of_one_text_are_linear(spark):
    """Twenty times as many candidates in one text take well under sixty times as long, and all are found."""
    import time

    took = []
    for n in (5_000, 100_000):
        text = " ".join(f"k{k} = {hashlib.sha1(str(k).encode()).hexdigest()}" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        rows = secret_scan.secrets(docs).select("nth", "start", "candidate").collect()
        took.append(time.time() - began)
        assert len(rows) == n and all(text[r["start"] : r["start"] + 40] == r["candidate"] for r in rows[:: max(1, n // 500)])
        assert [r["nth"] for r in rows] == list(range(n))
    assert took[1] < 60 * took[0]
