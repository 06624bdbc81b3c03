"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items' word sequences is built on the driver in parts of bounded size and shipped to the workers.
They stream every text's words through it and track the longest match that ends at each word; where it reaches a window
(13 words, or a whole shorter item) the window's words are hit. Only stretches of words whose neighbouring pairs all
occur in items are streamed: outside of them no match reaches a window, so the lengths there need no tracking.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ALNUM, LOWER, blocks, column_bytes, ragged, read_table, tidied, word_bounds, word_hashes

WINDOW = 13
#: Contaminated: n_hit > 0 and SHARE * n_hit >= n_words.
SHARE = 20
#: Of documents that are not contaminated the pipeline cuts spans of so many hit words or more.
SPAN = 8
#: Bytes of texts that meet one automaton after another, if there are several.
LOT_BYTES = 16 << 20
#: Bytes of item texts in one automaton; more items make more automata, used one after another.
PART_BYTES = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII bytes."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    raw = data.tobytes()
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class SuffixAutomaton:
    """A generalised suffix automaton of sequences of word numbers, with the items of each windowed state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        named = [(name, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]) for name, words in items if words]
        for _, seq in named:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min((min(len(s), window) for _, s in named), default=window)
        n = len(self.next)
        # the state of each window (its longest suffix link of at least that length), and items that hold it
        self.items: dict[int, set[str]] = {}
        self.ends: dict[int, tuple[int, set[str]]] = {}  # whole short items that end in a state
        pairs = set()
        for name, seq in named:
            state = 0
            pairs.update(zip(seq, seq[1:]))
            for i, c in enumerate(seq):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.items.setdefault(self._windowed(state), set()).add(name)
            if len(seq) < window:
                self.ends.setdefault(state, (len(seq), set()))[1].add(name)
        #: The nearest state on the way of suffix links, itself included, in which a short item ends.
        self.short = [-1] * n
        for s in sorted(range(n), key=self.length.__getitem__):
            self.short[s] = s if s in self.ends else self.short[self.link[s]] if s else -1
        # sorted hashes of the words with their numbers, and sorted keys of pairs
        vocab = list(self.numbers)
        raw = np.frombuffer(b" ".join(vocab), np.uint8)
        sizes = np.array([len(w) for w in vocab], np.int64)
        ends = np.cumsum(sizes + 1) - 1 if len(vocab) else np.empty(0, np.int64)
        hashes = word_hashes(raw, ends - sizes, ends)
        order = np.argsort(hashes)
        self.hashes, self.hashed = hashes[order], (order + 1).astype(np.int64)
        self.pairs = np.sort(np.array([a * (len(vocab) + 1) + b for a, b in pairs], np.int64))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _windowed(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, seq: list[int], hit: np.ndarray, found: set[str]) -> None:
        """Streams seq, marks the words of occurring windows in hit, and adds their items to found."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for i, c in enumerate(seq):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            if size >= window:
                hit[i - window + 1 : i + 1] = True
                found |= self.items[self._windowed(state)]
            if self.ends and size:
                s = self.short[state if size == length[state] else link[state]]
                while s > 0:
                    n, names = self.ends[s]
                    hit[i - n + 1 : i + 1] = True
                    found |= names
                    s = self.short[link[s]]

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of a block are hit, and the items of each row that has any."""
        n = len(starts)
        hit = np.zeros(n, bool)
        found: dict[int, set[str]] = {}
        if not n or not len(self.hashes):
            return hit, found
        h = word_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
        number = np.where(self.hashes[at] == h, self.hashed[at], 0)
        joined = np.zeros(n + 1, bool)  # joined[i]: words i - 1 and i may follow each other in a match
        keys = number[:-1] * (len(self.hashes) + 1) + number[1:]
        maybe = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0))
        if len(self.pairs):
            where = np.searchsorted(self.pairs, keys[maybe]).clip(max=len(self.pairs) - 1)
            joined[maybe[self.pairs[where] == keys[maybe]] + 1] = True
        joined[ranges] = False
        heads = np.flatnonzero(~joined[:n])
        sizes = np.diff(np.append(heads, n))
        rows = np.searchsorted(ranges, heads, "right") - 1
        keep = (sizes >= self.shortest) & (number[heads] > 0)
        raw = None
        for a, size, row in zip(heads[keep].tolist(), sizes[keep].tolist(), rows[keep].tolist()):
            # the words' bytes decide, not their hashes
            if raw is None:
                raw = data.tobytes()
            seq = [self.numbers.get(raw[s:e], 0) for s, e in zip(starts[a : a + size].tolist(), ends[a : a + size].tolist())]
            got: set[str] = set()
            self.match(seq, hit[a : a + size], got)
            if got:
                found.setdefault(row, set()).update(got)
        return hit, found


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> Iterator[SuffixAutomaton]:
    """Automata of all items, each of items with up to part_bytes bytes of text (or one longer item).

    Items are fetched in the order of their ids, so that the driver holds one part at a time.
    """
    part: list[tuple[str, list[bytes]]] = []
    size, any_made = 0, False
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")).orderBy("item")
    for row in rows.toLocalIterator():
        text = (row["text"] or "").encode()
        if part and size + len(text) > part_bytes:
            yield SuffixAutomaton(part, window)
            part, size, any_made = [], 0, True
        part.append((row["item"], words_of(text)))
        size += len(text)
    if part or not any_made:
        yield SuffixAutomaton(part, window)


HITS = "doc_id long, n_words long, spans array<array<int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document.

    spans are [first, end) runs of hit words (numbers of words, ascending, apart), items the ids of items that have an
    occurring window, sorted as strings. Null or wordless texts have no words and no hits; null and wordless items have
    no windows; items of the same id count once and a null id counts as "null"; each document row gives a row.
    Empty tables are fine, other columns are not looked at. Narrow: each row meets all automata in its task.
    """
    parts = list(_broadcast(docs.sparkSession.sparkContext, automata(benchmark, item_col, item_text_col, window)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(tidied(_scanner(parts)), HITS)


def _broadcast(sc: SparkContext, made: Iterator[SuffixAutomaton]):
    for x in made:
        yield sc.broadcast(x)


def _scanned(batches: Iterator, at: int, parts: list) -> Iterator:
    """(batch, blocks) of each batch; a block is (first row, rows' first bytes, words' starts, ends and ranges, hit, items by row).

    Only one of several automata is in memory: they are loaded one after another for each lot of texts.
    """

    def lots():
        lot, size = [], 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            own = []
            for i, j in blocks(offsets):
                part = LOWER[data[offsets[i] : offsets[j]]]
                own.append((i, offsets[i : j + 1] - offsets[i], part, *word_bounds(part, offsets[i : j + 1] - offsets[i], ALNUM)))
            lot.append((batch, own))
            size += len(data)
            if len(parts) == 1 or size >= LOT_BYTES:
                yield lot
                lot, size = [], 0
        if lot:
            yield lot

    for lot in lots():
        out = [[(i, first, starts, ends, ranges, np.zeros(len(starts), bool), {}) for i, first, _, starts, ends, ranges in own] for _, own in lot]
        for automaton in parts:
            sa = automaton.value
            for (_, own), results in zip(lot, out):
                for (_, _, part, starts, ends, ranges), result in zip(own, results):
                    hit, found = sa.scan(part, starts, ends, ranges)
                    np.logical_or(result[5], hit, out=result[5])
                    for row, items in found.items():
                        result[6].setdefault(row, set()).update(items)
            if len(parts) > 1:
                del sa, automaton._value
        for (batch, _), results in zip(lot, out):
            yield batch, results


def _spans(hit: np.ndarray) -> np.ndarray:
    """[first, end) of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).reshape(-1, 2)


def _scanner(parts: list):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, results in _scanned(batches, 1, parts):
            words, spans, items = [], [], []
            for _, _, _, _, ranges, hit, found in results:
                words.extend(np.diff(ranges).tolist())
                for row in range(len(ranges) - 1):
                    got = found.get(row)
                    spans.append([] if got is None else _spans(hit[ranges[row] : ranges[row + 1]]).tolist())
                    items.append([] if got is None else sorted(got))
            if len(words):
                yield pa.record_batch(
                    [batch.column(0), pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "spans", "items"],
                )

    return run


def _without(batch, at: int, gone: dict[int, list[tuple[int, int]]], chars_col: str | None):
    """batch without the byte ranges gone of its texts."""
    import pyarrow as pa

    texts = batch.column(at).to_pylist()
    for row, ranges in gone.items():
        raw, left, k = texts[row].encode(), [], 0
        for a, b in ranges:
            left.append(raw[k:a])
            k = b
        texts[row] = b"".join([*left, raw[k:]]).decode()
    names = batch.schema.names
    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    if chars_col is not None:
        k = names.index(chars_col)
        chars = batch.column(k).to_pylist()
        for row in gone:
            chars[row] = len(texts[row])
        batch = batch.set_column(k, batch.schema.field(k), pa.array(chars, batch.schema.field(k).type))
    return batch


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = SHARE,
    span: int | None = None, chars_col: str | None = None,
) -> DataFrame:
    """The rows of docs that are not contaminated, all columns as they are; no shuffle.

    With span, runs of that many hit words or more are cut out of the rows that stay, from the first word to the last (what
    stands around them stays, so no words are joined), and chars_col, if given, takes the new text's length. A text is cut
    once: words that only the cut brings together are not looked at again.
    """
    parts = list(_broadcast(docs.sparkSession.sparkContext, automata(benchmark, item_col, item_text_col, window)))
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch, results in _scanned(batches, at, parts):
            keep, new = np.ones(batch.num_rows, bool), {}
            for i, first, starts, ends, ranges, hit, found in results:
                for row in found:
                    a, b = ranges[row], ranges[row + 1]
                    n_hit = int(hit[a:b].sum())
                    keep[i + row] = not (n_hit and share * n_hit >= b - a)
                    gone = [(x, y) for x, y in (_spans(hit[a:b]) + a).tolist() if span is not None and y - x >= span]
                    if keep[i + row] and gone:
                        new[i + row] = [(int(starts[x] - first[row]), int(ends[y - 1] - first[row])) for x, y in gone]
            if new:
                batch = _without(batch, at, new, chars_col)
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)


def verdicts(hits: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds n_hit and contaminated (n_hit > 0 and share * n_hit >= n_words) to contamination()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT item, len(x) AS n, array_to_string(x, ' ') AS k FROM (
    SELECT item, w[i:i + least(len(w), {WINDOW}) - 1] AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0))
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
