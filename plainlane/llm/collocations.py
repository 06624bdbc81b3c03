"""Phrase collocations: candidates from sketch upper bounds, counted by delimiter-guarded automata, scored and ranked.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends, and into words at blanks. Three steps:

1. Two count-min sketches whose cells stop counting at the threshold: of all words and pairs, then of longer phrases whose
   pairs the first one does not rule out. Tasks sketch what they read, blocks of cells are summed by Spark, and the sums are
   broadcast: their size is a parameter, whatever the input. They rule much out while there are fewer phrases than about half
   the threshold times the cells; a corpus that is larger needs a higher threshold or more cells, or its counts are as right
   but mostly of phrases that fail.
2. Tasks read the texts again in shards. Phrases of a shard whose bound and whose parts' bounds reach the threshold are
   candidates; those of several words are compiled into pyahocorasick automata with a blank at either end of each phrase, and what of
   the shard stands in a pair that passes is scanned for all, overlapping, matches; single words are counted by their hashes. Counts are packed by bucket of phrases, shuffled, summed one bucket at a time and
   held against the threshold, so that the bounds change nothing but the work. A shard ends at a number of bytes of text or of candidates, so that an automaton's memory is
   bounded however little the sketch rules out.
3. Scores, the drop of phrases inside longer ones, and ranks are joins and groupings of the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BLOCK_BYTES, U64, byte_class, column_bytes, gram_hashes, mix, read_table, staged, tidied, word_bounds, word_hashes

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: A phrase goes if a longer one that holds it has this many per cent of its count.
INSIDE = 80
SCALE = 2_000_000
#: Cells in each of a sketch's two rows: an eighth to a quarter of the text's bytes, within these bounds. A cell has one byte, or
#: four with thresholds from 256 on.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 24
CELL_BLOCK = 1 << 16
#: Phrases that a task counts before it gives their counts, and rows of a batch of them.
HELD, ROWS = 500_000, 50_000
#: Counts travel in buckets of phrases, one for so many bytes of text; a task sums one bucket after another.
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 64
#: A shard ends when it has so many bytes of text or of candidates.
SHARD_BYTES, CANDIDATE_BYTES = 16 << 20, 2 << 20

MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, blanks to spaces, marks to line ends.
FOLD = bytes(10 if b in MARKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = byte_class(b" \n")


def normalised(texts: list[bytes]) -> bytes:
    """All pieces of texts: words parted by one space, pieces by ' \\n ', a space at either end."""
    t = b"\n".join(texts).translate(FOLD)
    for double, single in ((b"  ", b" "), (b"\n ", b"\n"), (b" \n", b"\n"), (b"\n\n", b"\n")):
        while double in t:
            t = t.replace(double, single)
    return b" " + t.strip(b" \n").replace(b"\n", b" \n ") + b" "


def chunks(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A normalised text cut between pieces after limit bytes each; a longer piece stays whole."""
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + limit) + 1 or len(text)
        yield text[at:end]
        at = end


class Phrases:
    """The phrases of 1 to most words of a chunk: word places, and for each length the places where a phrase starts and its hash."""

    def __init__(self, chunk: bytes, lang: str, most: int):
        data = np.frombuffer(chunk, np.uint8)
        self.starts, self.ends, _ = word_bounds(data, np.array([0, len(data)]), WORDS)
        n = len(self.starts)
        key = np.frombuffer(lang.encode(), np.uint8)
        words = word_hashes(data, self.starts, self.ends) ^ word_hashes(key, np.zeros(1, np.int64), np.array([len(key)]))
        goes_on = self.starts[1:] - self.ends[:-1] == 1
        whole = np.ones(n, bool)
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(n), words)]
        for k in range(2, most + 1):
            whole = whole[: max(n - k + 1, 0)] & goes_on[k - 2 :]
            at = np.flatnonzero(whole)
            self.by_length.append((at, gram_hashes(words, k, k)[at] if len(at) else np.empty(0, np.uint64)))


def _cells(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64(width - 1)
    return (hashes & mask).astype(np.uint32), (mix(hashes ^ U64(1)) & mask).astype(np.uint32)


def _by_lang(batch, lot: dict[str, list[bytes]]) -> int:
    """Adds a batch's texts to lot; their bytes."""
    data, offsets = column_bytes(batch.column(0))
    raw = data.tobytes()
    for lang, a, b in zip(batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        lot.setdefault(lang, []).append(raw[a:b])
    return len(raw)


def _passed(phrases: Phrases, full: int, sketches: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places, hashes) of a chunk's phrases that may reach full: both phrases of one word less may, and so may they by
    their own sketch. Sketches are of words and pairs, and of longer phrases; what has no sketch yet is not ruled out by it."""
    before = None
    for k, (at, hashes) in enumerate(phrases.by_length, 1):
        passed = np.ones(len(at), bool) if before is None else before[at] & before[at + 1]
        if len(sketches) > (k > 2):
            cells = sketches[int(k > 2)]
            a, b = _cells(hashes, cells.shape[1])
            passed &= (cells[0][a] >= full) & (cells[1][b] >= full)
        before = np.zeros(len(phrases.starts) + 1, bool)
        before[at[passed]] = True
        yield k, at[passed], hashes[passed]


def _shaped(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(2, -1)


def _sketcher(width: int, full: int, kind: str, most: int, prior):
    """Cells of words and pairs, or, with prior, the sketch of these, of the longer phrases that it does not rule out."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        known = [_shaped(prior.value, kind)] if prior is not None else []
        cells = np.zeros((2, width), kind)
        for batch in batches:
            lot: dict[str, list[bytes]] = {}
            _by_lang(batch, lot)
            for lang, texts in lot.items():
                for chunk in chunks(normalised(texts)):
                    phrases = Phrases(chunk, lang, most if known else min(most, 2))
                    if known:
                        hashes = np.concatenate([h for k, _, h in _passed(phrases, full, known) if k > 2])
                    else:
                        hashes = np.concatenate([h for _, h in phrases.by_length])
                    for row, index in zip(cells, _cells(hashes, width)):
                        index, counts = np.unique(index, return_counts=True)
                        row[index] = np.minimum(row[index] + counts, full)
        flat = cells.reshape(-1, min(CELL_BLOCK, width))
        for i in np.flatnonzero(flat.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([flat[i].tobytes()], pa.binary())], names=["block", "cells"])

    return run


def _summer(full: int, kind: str):
    """Sums blocks of cells up to full; a task holds the blocks dealt to it, one array each."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(raw.as_buffer(), kind)
                held[i] = np.minimum(held[i].astype(np.int64) + new, full).astype(kind) if i in held else new.copy()
        for i, block in held.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "cells"])

    return run


def sketch(texts: DataFrame, width: int, full: int, kind: str, most: int, prior=None) -> bytes:
    """The two rows of cells of the phrases of texts (text, lang). The driver holds them: 2 * width cells."""
    blocks = texts.mapInArrow(tidied(_sketcher(width, full, kind, most, prior)), "block int, cells binary")
    total = blocks.repartition("block").mapInArrow(tidied(_summer(full, kind)), "block int, cells binary")
    cells = np.zeros(2 * width, kind).reshape(-1, min(CELL_BLOCK, width))
    for row in total.toLocalIterator():
        cells[row["block"]] = np.frombuffer(row["cells"], kind)
    return cells.tobytes()


def _candidates(chunk: bytes, phrases: Phrases, sketches: list[np.ndarray], full: int, found: dict[bytes, None], words: dict[bytes, int]) -> tuple[int, bytes]:
    """Adds to found the phrases of 2 words or more of a chunk that pass, and to words how often its words that pass stand in it;
    bytes of what is new in found, and what of the chunk an automaton has to read."""
    added, paired = 0, np.empty(0, np.int64)
    for k, at, hashes in _passed(phrases, full, sketches):
        _, first, times = np.unique(hashes, return_index=True, return_counts=True)
        if k == 1:
            for a, b, n in zip(phrases.starts[at[first]].tolist(), phrases.ends[at[first]].tolist(), times.tolist()):
                words[chunk[a:b]] = words.get(chunk[a:b], 0) + n
            continue
        if k == 2:
            paired = at
        at = at[first]
        for a, b in zip(phrases.starts[at].tolist(), phrases.ends[at + k - 1].tolist()):
            phrase = chunk[a:b]
            if phrase not in found:
                found[phrase] = None
                added += b - a + 2
    return added, _paired(chunk, phrases, paired)


def _paired(chunk: bytes, phrases: Phrases, paired: np.ndarray) -> bytes:
    """A chunk without the words in none of the pairs that start at those places: one line end stands for each run of them, which no
    candidate reaches over."""
    if not len(paired):
        return b""
    lone = np.ones(len(phrases.starts), bool)
    lone[paired] = lone[paired + 1] = False
    data = np.frombuffer(chunk, np.uint8).copy()
    gone = np.flatnonzero(lone)
    follows = np.zeros(len(gone), bool)
    follows[1:] = gone[1:] == gone[:-1] + 1
    data[phrases.starts[gone[~follows]]] = 10
    edge = np.zeros(len(data) + 1, np.int8)
    edge[phrases.starts[gone[~follows]] + 1] += 1
    edge[phrases.ends[gone[follows] - 1]] += 1
    edge[phrases.ends[gone]] -= 1
    return data[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes()


def automata(phrases: list[bytes], limit: int = CANDIDATE_BYTES):
    """(first number, automaton) of phrases guarded by blanks, each of up to limit bytes; bytes stand as Latin-1 letters."""
    import ahocorasick

    first = 0
    while first < len(phrases):
        made, size, i = ahocorasick.Automaton(), 0, first
        while i < len(phrases) and (i == first or size + len(phrases[i]) + 2 <= limit):
            made.add_word(f" {phrases[i].decode('latin-1')} ", i - first)
            size += len(phrases[i]) + 2
            i += 1
        made.make_automaton()
        yield first, i - first, made
        first = i


def _counter(shared: list, full: int, kind: str, most: int, shard_bytes: int, candidate_bytes: int, buckets: int):
    """Counts of a task's candidates, packed into one row for each language and bucket of phrases: they hold no line ends."""

    def count(shard: list[tuple[str, bytes]], found: dict[str, dict[bytes, None]], totals: dict[str, dict[bytes, int]]) -> None:
        for lang, phrases in found.items():
            names, own = list(phrases), totals.setdefault(lang, {})
            for first, n, automaton in automata(names, candidate_bytes):
                counts = np.zeros(n, np.int64)
                for of, chunk in shard:
                    if of == lang:
                        counts += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(chunk.decode("latin-1"))), np.int32), minlength=n)
                for name, c in zip(names[first : first + n], counts.tolist()):
                    own[name] = own.get(name, 0) + c

    def rows(totals: dict[str, dict[bytes, int]]) -> Iterator:
        import pyarrow as pa

        for lang, own in totals.items():
            packed: dict[int, list[bytes]] = {}
            for name in own:
                packed.setdefault(crc32(name) % buckets, []).append(name)
            for bucket, names in packed.items():
                counts = np.fromiter(map(own.__getitem__, names), np.int64, len(names))
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([lang]), pa.array([b"\n".join(names)], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["bucket", "lang", "phrases", "counts"])

    def run(batches) -> Iterator:
        sketches = [_shaped(x.value, kind) for x in shared]
        shard, found, size, added = [], {}, 0, 0
        lot: dict[str, list[bytes]] = {}
        totals: dict[str, dict[bytes, int]] = {}
        waiting = 0
        for batch in _then_none(batches):
            if batch is not None:
                waiting += _by_lang(batch, lot)
                if waiting < shard_bytes // 4:
                    continue
            for lang, texts in lot.items():
                for chunk in chunks(normalised(texts)):
                    phrases, own = Phrases(chunk, lang, most), totals.setdefault(lang, {})
                    # all words are counted as the empty phrase
                    own[b""] = own.get(b"", 0) + len(phrases.starts)
                    new, read = _candidates(chunk, phrases, sketches, full, found.setdefault(lang, {}), own)
                    shard.append((lang, read))
                    size += len(chunk)
                    added += new
                    if size >= shard_bytes or added >= candidate_bytes:
                        count(shard, found, totals)
                        shard, found, size, added = [], {}, 0, 0
                        if sum(map(len, totals.values())) >= HELD:
                            yield from rows(totals)
                            totals = {}
            lot, waiting = {}, 0
        count(shard, found, totals)
        yield from rows(totals)

    return run


def _totals(least: int):
    """Sums packed counts that come in the order of their buckets, and gives the phrases with least or more (and all words)."""

    def rows(held: dict[str, dict[bytes, int]]) -> Iterator:
        import pyarrow as pa

        for lang, own in held.items():
            names = [x for x, c in own.items() if c >= least or not x]
            for i in range(0, len(names), ROWS):
                part = names[i : i + ROWS]
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([own[x] for x in part], pa.int64())], names=["lang", "phrase", "a"])

    def run(batches) -> Iterator:
        now, held = None, {}
        for batch in batches:
            for bucket, lang, phrases, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if bucket != now:
                    yield from rows(held)
                    now, held = bucket, {}
                own = held.setdefault(lang, {})
                for name, c in zip(phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                    own[name] = own.get(name, 0) + c
        yield from rows(held)

    return run


def _then_none(batches) -> Iterator:
    yield from batches
    yield None


def frequent(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, most: int = MAX_WORDS,
             most_cells: int = MOST_CELLS, shard_bytes: int = SHARD_BYTES, candidate_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """(lang, phrase, a): every phrase of 1 to most words with a >= min_count occurrences in its language, and, as the empty
    phrase, all words of each language. Null languages are `und`, null texts empty; repeated rows count each time.

    Exact but for one event: of two phrases of one chunk whose 64-bit hashes agree, one may miss that chunk's count.
    """
    if min_count < 1 or most < 1:
        raise ValueError("min_count and most must be positive")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = 1 << max(LEAST_CELLS.bit_length() - 1, min(most_cells.bit_length() - 1, (size // 8).bit_length()))
    kind = "u1" if min_count < 256 else "u4"
    full = min(min_count, (1 << 32) - 1)
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(sketch(texts, width, full, kind, most))]
    if most > 2:
        shared.append(context.broadcast(sketch(texts, width, full, kind, most, shared[0])))
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    packed = texts.mapInArrow(tidied(_counter(shared, full, kind, most, shard_bytes, candidate_bytes, buckets)), "bucket int, lang string, phrases binary, counts binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_totals(min_count)), "lang string, phrase string, a long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, most: int = MAX_WORDS,
                 inside: int = INSIDE, top: int = TOP, **bounds) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's top phrases of 2 to most words, by score, count and phrase.

    a, l and r are occurrences of the phrase and of the two parts of its lowest-scoring cut, n all words of the language,
    score floor(2,000,000 a / (l + r)). A phrase inside a longer frequent one with inside per cent of its count or more is
    left out. Null languages are `und`, null and wordless texts have no phrases, repeated rows count each time, an empty
    table gives an empty result, other columns are not looked at. bounds are those of frequent().
    """
    counted = staged(frequent(docs, lang_col, text_col, min_count, most, **bounds), "phrases")
    found = counted.where("phrase <> ''")
    words = F.split("phrase", " ")
    long = found.withColumn("w", words).where(F.size("w") > 1)
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = (
        long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
        .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
        .join(found.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
        .join(found.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
        .withColumn("score", F.expr(f"(cast({SCALE} as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r)"))
    )
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase's parts of 2 words or more, each with the largest count of what holds it
    parts = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    holders = long.where(F.size("w") > 2).select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    kept = (
        best.join(holders, ["lang", "phrase"], "left")
        .where(F.col("held").isNull() | (F.lit(100).cast("decimal(38,0)") * F.col("held") < F.lit(inside).cast("decimal(38,0)") * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within 32 parts of a language, so that a task's last ranking has 32 * top rows of a language at most
    first = kept.withColumn("part", F.pmod(F.hash("phrase"), F.lit(32))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counted.where("phrase = ''").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, range(1, {MAX_WORDS + 1}) AS t(k)
),
f AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= {MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (CAST({SCALE} AS HUGEINT) * c.a) // (l.a + r.a) AS score
  FROM f c, range(1, {MAX_WORDS}) AS t(k), f l, f r
  WHERE k < len(c.w) AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:k], ' ') AND r.phrase = array_to_string(c.w[k + 1:len(c.w)], ' ')
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, a
  FROM f, range(2, {MAX_WORDS}) AS t(n), range(1, {MAX_WORDS + 1}) AS u(i)
  WHERE n < len(w) AND i + n - 1 <= len(w)
),
held AS (SELECT lang, phrase, max(a) AS held FROM parts GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
  WHERE h.held IS NULL OR 100 * CAST(h.held AS HUGEINT) < {INSIDE} * CAST(b.a AS HUGEINT)
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= {TOP}
"""
