"""Substring dedup by seed and extend: winnowed anchors, matches extended both ways, maximal repeats removed.

Seeds. Of the 8-word sequences in each 20-word window the one of least hash is the window's anchor, so equal windows have
equal anchors wherever they stand (winnowing). Anchors meet by hash over the whole corpus; those seen once are dropped.
Extension. Each place of a repeated anchor is joined with the anchor's earliest place and the match extended word by word to
the left and to the right, as far as windows with this anchor reach (12 words each way). A match of 20 words or more is a
repeat of that place; longer repeats are matched piece by piece, by the anchors along them, and chained while text and source
run on together: these are the maximal repeats (doc, first word, end, source place), and what they cover is removed.
The rest. Where an anchor stands in several contexts, a place may equal an earlier one that is not the earliest. Windows
that the extension leaves open are such: they are compared with each other, whole, and linked to their earliest place. An
equal window that the extension has settled would have settled them too, so nothing else can equal them.
No pairs of occurrences are made: each place meets one other, so a passage in thousands of documents costs as many rows as
it has places. Each task extends matches among its own PRE_ROWS places before any is shuffled, so a passage in a third of all
documents sends a few places for each task to the one that joins its anchor; joins deal keys that stay hot by salt. Exact
copies of a text are recognised whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACED, U64, as_long, blocks, column_bytes, gram_hashes, mix, read_table, release, staged, tidied, unstage, word_bounds, word_hashes

#: Words of a window, and of an anchor.
LENGTH, ANCHOR = 20, 8
#: Anchors or windows of a task that are looked at together before they are shuffled.
PRE_ROWS = 500_000
#: Parts of a group of copies, and of an anchor with HOT places or more in one task, where rows are joined.
SALT, HOT = 16, 64
#: Bytes of a word's hash that a place keeps of the words around it: only places of one anchor meet, so 48 bits tell them apart.
KEPT = 6


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over x[i : i + size], for every i that has so many."""
    out, done = x, 1
    while done < size:
        step = min(done, size - done)
        out = op(out[: len(out) - step], out[step:])
        done += step
    return out


def window_anchors(words: np.ndarray, ranges: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all anchor-length sequences, the least of each window (0: it crosses a text's end), and which are anchors."""
    g = gram_hashes(words, anchor)
    span = length - anchor + 1
    if len(g) < span:
        return g, np.empty(0, np.uint64), np.zeros(len(g), bool)
    least = _slide(g, span, np.minimum)
    end = np.repeat(ranges[1:], np.diff(ranges))[: len(least)]
    least[np.arange(len(least)) + length > end] = 0
    padded = np.zeros(len(g) + span - 1, np.uint64)
    padded[span - 1 : span - 1 + len(least)] = least
    return g, least, _slide(padded, span, np.maximum) == g


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, ranges = word_bounds(data, offsets, SPACED)
    return word_hashes(data, starts, ends), ranges


def _gathered(parts, size: int):
    """Lists of parts (tuples of equally long arrays) joined to arrays of about size rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _anchors(batches) -> Iterator:
    """(anchor, part, doc_id), once for each text that has it, twice if it has it more than once.

    Anchors that PRE_ROWS rows hold more than once are known to recur: their rows are dealt by part, the document, and one
    more row of part 0 tells other tasks. So an anchor of very many documents meets itself in few rows. Parts of anchors with
    HOT rows or more have their second bit set.
    """
    import pyarrow as pa

    def parts():
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in blocks(offsets):
                h, ranges = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                g, _, chosen = window_anchors(h, ranges)
                at = np.flatnonzero(chosen)
                if not len(at):
                    continue
                owner = np.searchsorted(ranges, at, "right") - 1
                x = g[at]
                order = np.lexsort((x, owner))
                x, owner = x[order], owner[order]
                same = (x[1:] == x[:-1]) & (owner[1:] == owner[:-1])
                keep = np.ones(len(x), bool)
                keep[2:] = ~(same[1:] & same[:-1])
                yield x[keep], ids[i:j][owner[keep]]

    for x, doc in _gathered(parts(), PRE_ROWS):
        _, number, count = np.unique(x, return_inverse=True, return_counts=True)
        known = count[number] > 1
        one = np.flatnonzero(known)[np.unique(number[known], return_index=True)[1]]
        part = np.where(known, as_long(mix(doc.view(np.uint64)) << U64(2) | np.where(count[number] >= HOT, U64(3), U64(1))), 0)
        yield pa.record_batch(
            [pa.array(as_long(np.concatenate((x, x[one])))), pa.array(np.concatenate((part, np.zeros(len(one), np.int64)))), pa.array(np.concatenate((doc, doc[one])))],
            names=["anchor", "part", "doc_id"],
        )


#: A match: words [first, end) of doc_id equal those from source_first on of source_id, which start earlier.
MATCH = "doc_id long, first int, end int, source_id long, source_first int"
_TYPES = (np.int64, np.int32, np.int32, np.int64, np.int32)
#: A place of an anchor: its windows (bit k: the one that starts k words before it) and the words around it, or a match.
PLACE = "anchor long, at int, windows int, around binary, hot boolean, " + MATCH


def _contexts(words: np.ndarray, ranges: np.ndarray, at: np.ndarray, owner: np.ndarray, reach: int) -> np.ndarray:
    """The hashes (KEPT bytes) of the words before (nearest first) and after the anchors at places at; 0 beyond the text."""
    step = np.arange(1, reach + 1)
    left, right = at[:, None] - step, at[:, None] + ANCHOR - 1 + step
    place = np.concatenate((left, right), axis=1)
    inside = (place >= ranges[owner][:, None]) & (place < ranges[owner + 1][:, None])
    return np.where(inside, words[np.where(inside, place, 0)] & U64((1 << 8 * KEPT) - 1) | U64(1), U64(0))


def _reach(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and to the right of equal anchors are equal, one after another."""
    same = (own == other) & (own != 0)
    k = own.shape[1] // 2
    return tuple(np.logical_and.accumulate(x, axis=1).sum(axis=1).astype(np.int32) for x in (same[:, :k], same[:, k:]))


def _later(doc: np.ndarray, at: np.ndarray, other_doc: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    return (doc > other_doc) | ((doc == other_doc) & (at > other_at))


def _open_windows(windows: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """The windows that a match of so many words each way does not cover."""
    for k in range(reach + 1):
        windows = np.where((left >= k) & (right >= reach - k), windows & ~np.int32(1 << k), windows)
    return windows


def _uncovered(windows: np.ndarray, doc: np.ndarray, at: np.ndarray, m_doc: np.ndarray, first: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """The windows of the places that no match [first, end) of their document covers. Whole documents only: a window that is
    open stays so at all its anchors' places, those in a run of one word among them."""
    docs, number = np.unique(doc, return_inverse=True)
    last = np.zeros(len(docs), np.int64)
    np.maximum.at(last, number, at)
    base = np.concatenate(([0], np.cumsum(last + 2 * length)))
    edge = np.zeros(base[-1] + 1, np.int32)
    m = base[np.searchsorted(docs, m_doc)]
    np.add.at(edge, m + first, 1)
    np.add.at(edge, m + end - length + 1, -1)
    covered = np.cumsum(edge) > 0
    place = base[number] + at
    for k in range(length - ANCHOR + 1):
        windows = np.where(covered[np.maximum(place - k, 0)], windows & ~np.int32(1 << k), windows)
    return windows


def _binary(rows: np.ndarray):
    import pyarrow as pa

    size = rows.shape[1] * KEPT
    kept = np.ascontiguousarray(rows, "<u8").view(np.uint8).reshape(*rows.shape, 8)[:, :, :KEPT]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(kept.tobytes())])


def _around(column, reach: int) -> np.ndarray:
    """The arrays that _binary() has made; no row is null."""
    import pyarrow as pa

    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, _, data = raw.buffers()
    size = 2 * reach * KEPT
    flat = np.frombuffer(data, np.uint8)[raw.offset * size : (raw.offset + len(raw)) * size] if data is not None else np.empty(0, np.uint8)
    out = np.zeros((len(raw), 2 * reach, 8), np.uint8)
    out[:, :, :KEPT] = flat.reshape(len(raw), 2 * reach, KEPT)
    return out.view("<u8").reshape(len(raw), 2 * reach)


def _matched(doc, at, left, right, source, source_at):
    """Columns of MATCH."""
    return doc, at - left, at + ANCHOR + right, source, source_at - left


def _placed(batches, length: int):
    """(anchor, at, windows, around, doc_id, hot) of the anchors that are given, block by block."""
    reach = length - ANCHOR
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        seeds = batch.column(2)
        for i, j in blocks(offsets):
            h, ranges = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            g, least, chosen = window_anchors(h, ranges, length)
            known = np.unique(seeds.slice(i, j - i).flatten().to_numpy().view(np.uint64))
            hot = np.unique(batch.column(3).slice(i, j - i).flatten().to_numpy().view(np.uint64))
            at = np.flatnonzero(chosen)
            if not len(at) or not len(known):
                continue
            k = np.searchsorted(known, g[at]).clip(max=len(known) - 1)
            at = at[known[k] == g[at]]
            if not len(at):
                continue
            owner = np.searchsorted(ranges, at, "right") - 1
            windows = np.zeros(len(at), np.int32)
            for k in range(reach + 1):
                start = at - k
                ok = (start >= ranges[owner]) & (start < len(least))
                windows |= (ok & (least[np.where(ok, start, 0)] == g[at])).astype(np.int32) << k
            yield g[at], (at - ranges[owner]).astype(np.int32), windows, _contexts(h, ranges, at, owner, reach), ids[i:j][owner], np.isin(g[at], hot)


def _seeds_extended(length: int):
    """Places of anchors; those that the earliest place among their task's PRE_ROWS ones settles become matches at once."""
    reach = length - ANCHOR

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in PLACE.split(", ")]
        for anchor, at, windows, around, doc, hot in _gathered(_placed(batches, length), PRE_ROWS // 5):
            order = np.lexsort((at, doc, anchor))
            anchor, at, windows, around, doc, hot = (x[order] for x in (anchor, at, windows, around, doc, hot))
            new = np.ones(len(at), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            left, right = _reach(around, around[first])
            later = _later(doc, at, doc[first], at[first])
            hit = later & (left + right >= reach)
            windows = np.where(later, _open_windows(windows, left, right, reach), windows)
            m = np.flatnonzero(hit)
            if len(m):
                windows = _uncovered(windows, doc, at, doc[m], at[m] - left[m], at[m] + ANCHOR + right[m], length)
            rest = new | (windows != 0)
            if len(m):
                f = first[m]
                none = pa.nulls(len(m), pa.int64())
                cols = _matched(doc[m], at[m], left[m], right[m], doc[f], at[f])
                yield pa.record_batch([none, none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.string()).cast(pa.binary()), none.cast(pa.bool_()), *(pa.array(c.astype(t)) for c, t in zip(cols, _TYPES))], names=names)
            r = np.flatnonzero(rest)
            none = pa.nulls(len(r), pa.int32())
            yield pa.record_batch([pa.array(as_long(anchor[r])), pa.array(at[r]), pa.array(windows[r]), _binary(around[r]), pa.array(hot[r]), pa.array(doc[r].astype(np.int64)), none, none, none.cast(pa.int64()), none], names=names)

    return run


OPEN = MATCH + ", w1 long, w2 long"


def _extended(length: int):
    """Places joined with their anchor's earliest place: matches, and the windows that stay open, by two hashes of their words."""
    reach = length - ANCHOR

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in OPEN.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, at, windows, doc, source, source_at = (batch.column(k).to_numpy() for k in (0, 1, 2, 4, 5, 6))
            around = _around(batch.column(3), reach)
            left, right = _reach(around, _around(batch.column(7), reach))
            m = np.flatnonzero(left + right >= reach)
            if len(m):
                none = pa.nulls(len(m), pa.int64())
                cols = _matched(doc[m], at[m], left[m], right[m], source[m], source_at[m])
                yield pa.record_batch([*(pa.array(c.astype(t)) for c, t in zip(cols, _TYPES)), none, none], names=names)
            windows = _open_windows(windows, left, right, reach)
            hashes = []
            for salt in (1, 2):
                # of the first k words on a side, nearest first
                sides = [np.zeros((len(at), reach + 1), np.uint64) for _ in range(2)]
                for side, part in zip(sides, (around[:, :reach], around[:, reach:])):
                    for k in range(reach):
                        side[:, k + 1] = mix(side[:, k] ^ part[:, k] * U64(2 * salt + 1))
                hashes.append([mix(sides[0][:, k] ^ mix(sides[1][:, reach - k] ^ mix(anchor.view(np.uint64) + U64(64 * salt + k)))) for k in range(reach + 1)])
            for k in range(reach + 1):
                r = np.flatnonzero(windows & (1 << k))
                if len(r):
                    none = pa.nulls(len(r), pa.int32())
                    yield pa.record_batch([pa.array(doc[r].astype(np.int64)), pa.array((at[r] - k).astype(np.int32)), none, none.cast(pa.int64()), none, *(pa.array(as_long(x[k][r])) for x in hashes)], names=names)

    return run


def _open_settled(length: int):
    """Open windows that equal an earlier one among their task's PRE_ROWS become matches; all others go on."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in OPEN.split(", ")]
        parts = (tuple(b.column(k).to_numpy() for k in (5, 6, 0, 1)) for b in batches if b.num_rows)
        for w1, w2, doc, at in _gathered(parts, PRE_ROWS):
            order = np.lexsort((at, doc, w2, w1))
            w1, w2, doc, at = w1[order], w2[order], doc[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            later = _later(doc, at, doc[first], at[first])
            end = pa.array(np.where(later, at + length, 0).astype(np.int32), mask=~later)
            source, source_at = pa.array(doc[first], mask=~later), pa.array(at[first].astype(np.int32), mask=~later)
            yield pa.record_batch([pa.array(doc), pa.array(at.astype(np.int32)), end, source, source_at, pa.array(np.where(later, doc, w1)), pa.array(np.where(later, at, w2))], names=names)

    return run


def _seeded(texts: DataFrame) -> DataFrame:
    """(doc_id, text, anchors, hot) of texts that have anchors which recur; hot are those of very many places."""
    rows = texts.mapInArrow(tidied(_anchors), "anchor long, part long, doc_id long")
    seeds = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("anchor", "part"))).where("c > 1 or part <> 0")
    hot = F.collect_set(F.when(F.col("part").bitwiseAND(2) != 0, F.col("anchor"))).alias("hot")
    by_doc = staged(seeds.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), hot), "seeds")
    release(texts.sparkSession)
    return texts.join(by_doc, "doc_id").select("doc_id", "text", "anchors", "hot")


def matches(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """MATCH: pieces of texts (doc_id, text) of length words or more with an earlier place; they cover every window of length
    words that starts earlier too, and no others. length is 8 to 38."""
    return _matches(texts, length)[0]


def _matches(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """matches() and the staged table that it reads."""
    if not ANCHOR <= length <= ANCHOR + 30:
        raise ValueError("length must be 8 to 38 words")
    spark = texts.sparkSession
    names = [x.split()[0] for x in MATCH.split(", ")]
    places = staged(_seeded(texts.where("doc_id is not null")).mapInArrow(tidied(_seeds_extended(length)), PLACE), "places")
    release(spark)
    open_ = places.where("anchor is not null").select("anchor", "at", "windows", "around", "doc_id", "hot")
    at = F.struct("doc_id", "at")
    earliest = open_.groupBy("anchor").agg(F.min_by(F.struct("doc_id", "at", "around"), at).alias("e"), F.count(F.lit(1)).alias("c"), F.max("hot").alias("any_hot")).where("c > 1")
    parts = F.sequence(F.lit(0), F.when(F.col("any_hot"), SALT - 1).otherwise(0))
    earliest = earliest.select("anchor", F.explode(parts).alias("salt"), "e")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALT))).otherwise(0).cast("int")
    met = open_.withColumn("salt", salt).join(earliest.hint("merge"), ["anchor", "salt"]).where("doc_id > e.doc_id or (doc_id = e.doc_id and at > e.at)")
    met = met.select("anchor", "at", "windows", "around", "doc_id", F.col("e.doc_id").alias("source"), F.col("e.at").alias("source_at"), F.col("e.around").alias("source_around"))
    settled = places.where("anchor is null").select(*names, *(F.lit(None).cast("long").alias(w) for w in ("w1", "w2")))
    extended = staged(settled.unionByName(met.mapInArrow(tidied(_extended(length)), OPEN)), "extended")
    unstage(places)
    release(spark)
    rest = extended.where("w1 is not null").mapInArrow(tidied(_open_settled(length)), OPEN)
    same = Window.partitionBy("w1", "w2", F.col("end").isNull())
    rest = rest.withColumn("e", F.min(F.struct("doc_id", "first")).over(same)).where("end is not null or doc_id > e.doc_id or first > e.first")
    rest = rest.select("doc_id", "first", F.coalesce("end", F.col("first") + length).alias("end"), F.coalesce("source_id", "e.doc_id").alias("source_id"), F.coalesce("source_first", "e.first").alias("source_first"))
    return extended.where("w1 is null").select(names).unionByName(rest), extended


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, at, source_id, source_at): windows of texts (doc_id, text) that start earlier too, with such a place."""
    m = matches(texts, length).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("end") - F.col("first") - length)))
    return m.select("doc_id", (F.col("first") + F.col("k")).alias("at"), "source_id", (F.col("source_first") + F.col("k")).alias("source_at"))


def repeated_places(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, at, n): runs of n windows of repeated_windows() from at on. Runs may meet or overlap."""
    return matches(texts, length).select("doc_id", F.col("first").alias("at"), (F.col("end") - F.col("first") - length + 1).alias("n"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, first, end, source_id, source_first): repeats of at least length words, in words, with an earlier place.

    Matches that run on together in the text and in the source are chained into one repeat. Rows of null id, null, empty and
    short texts give none; repeated rows count once; other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _chained(matches(texts, length))


def _chained(pieces: DataFrame) -> DataFrame:
    pieces = pieces.withColumn("shift", F.col("source_first") - F.col("first"))
    w = Window.partitionBy("doc_id", "source_id", "shift").orderBy("first", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("new", F.when(seen.isNull() | (F.col("first") > seen), 1).otherwise(0))
    pieces = pieces.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = pieces.groupBy("doc_id", "source_id", "shift", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return runs.select("doc_id", "first", "end", "source_id", (F.col("first") + F.col("shift")).alias("source_first"))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): words that no repeated window covers, joined by blanks.

    A window is repeated if its words also start earlier (at a smaller doc_id, or before in the text). Words are split
    at ASCII white space. Null, empty and short texts lose nothing; rows of null id lose nothing and take nothing from
    others. Rows repeated whole (same id) count as one place and are all returned; ids should be unique otherwise. An
    empty table gives an empty one; other columns are not looked at. keep_text=False leaves kept null.
    """
    import pyarrow as pa

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.where("doc_id is not null").select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("m"))
    groups = named.groupBy("m").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1 and m is not null")
    # a group may hold a large part of all rows: they are dealt to SALT parts
    groups = groups.select("m", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    copies = salted.join(groups.hint("merge"), ["m", "salt"]).where("doc_id > rep").select("doc_id").distinct()
    copies = staged(copies.withColumn("copy", F.lit(True)), "copies")
    own = texts.join(copies, "doc_id", "left_anti")
    # seeds come from all texts that are not copies: a copy's windows all start earlier in its original
    pieces, table = _matches(own, length)
    marks = _chained(pieces).groupBy("doc_id").agg(F.collect_list("first").alias("at"), F.collect_list("end").alias("end"))
    marks = staged(marks.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", *(F.array().cast("array<int>").alias(c) for c in ("at", "end")), "copy")), "marks")
    unstage(copies, table)
    release(docs.sparkSession)

    def run(batches) -> Iterator:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            copy = batch.column(4).fill_null(False).to_pylist()
            ats = batch.column(2).offsets.to_numpy()
            firsts, ends = (np.empty(0, np.int32) if x.values is None else x.values.to_numpy() for x in batch.columns[2:4])
            n, removed, digest, kept = [], [], [], []
            for i in range(len(copy)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n.append(len(words))
                if copy[i]:
                    left = [] if len(words) >= length else words
                elif ats[i + 1] > ats[i]:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at, end = firsts[ats[i] : ats[i + 1]], ends[ats[i] : ats[i + 1]]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, end, -1)
                    left = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                else:
                    left = words
                removed.append(len(words) - len(left))
                text = b" ".join(left)
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if keep_text else None)
            if n:
                yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return texts.join(marks, "doc_id", "left").select("doc_id", "text", "at", "end", "copy").mapInArrow(tidied(run), RESULT)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS i FROM d WHERE len(w) >= {LENGTH}),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH} - 1], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM k) WHERE rn > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM r) GROUP BY doc_id),
w AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY w.p) AS t FROM w LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
