"""Byte-level BPE encoding and decoding.

Pre-tokens are found without regular expressions. Every code point becomes a symbol (its class, with what the next two
code points decide folded in), every symbol is a function from automaton state to automaton state, and since composing
functions is associative the states at all places come from a blocked scan: functions of blocks, a doubling scan over
the blocks, then the places within them. Slices between boundaries go through a cache of merged pieces; their byte
offsets are kept, so that any run of tokens can be decoded alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, column_bytes, read_table, tidied

# symbols
LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACE_IN, SPACE_LAST, GAP_LAST = range(8)
# states after a code point: in a run of letters, numbers or others; in white space that goes on; after a blank that
# joins what follows; after a finished token; one or two letters short of a contraction's end
IN_L, IN_N, IN_O, IN_W, BLANK, DONE, SHORT_1, SHORT_2 = range(8)
STATES = 8
#: White_Space of Unicode, fixed values.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLOCK_CHARS = 1 << 20
#: Steps of a block of the scan.
LANE = 256
#: The cache of merged pieces is emptied at this size, and holds pieces up to this length.
CACHE_PIECES, CACHE_BYTES = 1 << 18, 128


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and boundary-before[symbol, state]; symbols + 8 are the same ones at a text's start."""
    nxt, cut = np.zeros((16, STATES), np.uint8), np.ones((16, STATES), bool)
    for s in range(STATES):
        nxt[LETTER, s], nxt[NUMBER, s], nxt[OTHER, s] = IN_L, IN_N, IN_O
        nxt[QUOTE_1, s], nxt[QUOTE_2, s] = SHORT_1, SHORT_2
        nxt[SPACE_IN, s], nxt[SPACE_LAST, s], nxt[GAP_LAST, s] = IN_W, BLANK, DONE
    for sym, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (SPACE_IN, IN_W)):
        cut[sym, run] = False
        if sym != SPACE_IN:
            cut[sym, BLANK] = False
    for sym in (QUOTE_1, QUOTE_2):  # no contraction within a run of others or after a blank that joins it
        for s in (IN_O, BLANK):
            nxt[sym, s], cut[sym, s] = IN_O, False
    nxt[LETTER, SHORT_2], cut[LETTER, SHORT_2] = SHORT_1, False
    nxt[LETTER, SHORT_1], cut[LETTER, SHORT_1] = DONE, False
    nxt[8:], cut[8:] = nxt[:8, DONE : DONE + 1], True
    return nxt, cut


NEXT, CUT = _transitions()
_STEP = NEXT.ravel()
_MARK = (NEXT | CUT.astype(np.uint8) << 3).ravel()


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_IN of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = SPACE_IN
    return out


def symbols(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of each code point; firsts are the places where (non-empty) texts start."""
    n = len(codes)
    sym = classes()[codes]
    last = np.zeros(n + 2, bool)
    last[firsts[firsts > 0] - 1] = True
    last[n - 1] = True
    nxt = np.zeros(n + 2, np.uint32)
    nxt[: n - 1] = codes[1:]
    nxt[:n][last[:n]] = 0
    space = sym == SPACE_IN
    # white space whose follower is no white space; a text's end counts as white space
    ends = space & ~last[:n]
    ends[: n - 1] &= ~space[1:]
    sym[ends] = GAP_LAST
    sym[ends & (codes == 0x20)] = SPACE_LAST
    quote = np.flatnonzero((codes == 0x27) & ~last[:n])
    if len(quote):
        a = nxt[quote]
        b = np.where(last[quote + 1], 0, nxt[quote + 1])
        sym[quote[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE_1
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[quote[two]] = QUOTE_2
    sym[firsts] += 8
    return sym


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Places where pieces start, by an associative scan of the symbols' transition functions."""
    n = len(sym)
    lanes = -(-n // LANE)
    grid = np.zeros((lanes, LANE), np.uint8)
    grid.ravel()[:n] = sym
    grid = np.ascontiguousarray(grid.T).astype(np.uint16) << 3
    # functions of whole blocks
    f = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (lanes, STATES)).copy()
    for row in grid:
        f = _STEP[row[:, None] | f]
    # inclusive doubling scan: f[i] becomes f[i] after f[i-1] after ... after f[0]
    step = 1
    while step < lanes:
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)
        f, step = g, step * 2
    state = np.full(lanes, DONE, np.uint8)
    state[1:] = f[:-1, DONE]
    marks = np.empty((LANE, lanes), np.uint8)
    for j, row in enumerate(grid):
        marks[j] = _MARK[row | state]
        state = marks[j] & 7
    return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n] >> 3)


def pieces_of(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where pieces of the texts in raw start (with the end at last), and each text's range of pieces."""
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    at = np.empty(len(codes) + 1, np.int64)
    at[0] = 0
    np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=at[1:])
    firsts = np.unique(np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]]))
    starts = at[boundaries(symbols(codes, firsts))]
    return np.append(starts, len(raw)), np.searchsorted(starts, offsets)


class Vocabulary(dict):
    """Ranks of byte strings, and a cache of merged pieces: vocabulary[piece] is a tuple of ids."""

    def __init__(self, rank_file: str):
        super().__init__()
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        ids = (rank,) if rank is not None else tuple(self.merge(piece))
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, the leftmost of equals, until none is left."""
        return self._merge_short(piece) if len(piece) <= 64 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[x] for x in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same in n log n, by a heap of pairs and a chain of parts."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def vocabulary(rank_file: str | None = None) -> Vocabulary:
    """One vocabulary per worker; None: the public byte-level ranks of this machine."""
    if rank_file is None:
        import public_tokenizers

        rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Vocabulary(rank_file)


def encode_texts(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
    """(ids, byte places where pieces end, tokens of each piece) of each text."""
    for i, j in blocks(offsets, BLOCK_CHARS):
        raw = data[offsets[i] : offsets[j]].tobytes()
        cuts, ranges = pieces_of(raw, offsets[i : j + 1] - offsets[i])
        places = cuts.tolist()
        for k in range(j - i):
            a, b = ranges[k], ranges[k + 1]
            parts = list(map(vocab.__getitem__, [raw[s:e] for s, e in zip(places[a:b], places[a + 1 : b + 1])]))
            yield list(chain.from_iterable(parts)), cuts[a + 1 : b + 1] - (offsets[i + k] - offsets[i]), parts


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, piece_ends, piece_tokens) of every whole text.

    piece_ends are byte offsets in the text and piece_tokens counts of tokens, so that any run of pieces decodes alone.
    Null and empty texts have no tokens; a null id stays null; repeated rows give repeated rows; an empty table gives an
    empty one; other columns are not looked at. Memory: a block of about 1 MB or one text. Narrow: no shuffle.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in blocks(offsets):
                rows = [(x, ends.tolist(), [len(p) for p in parts]) for x, ends, parts in encode_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vocab)]
                yield pa.record_batch(
                    [ids.slice(i, j - i), pa.array([len(x) for x, _, _ in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3))],
                    names=["doc_id", "n_tokens", "ids", "piece_ends", "piece_tokens"],
                )

    schema = "doc_id long, n_tokens long, ids array<int>, piece_ends array<int>, piece_tokens array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, id_col: str = "doc_id", rank_file: str | None = None) -> DataFrame:
    """(doc_id, content binary) of encode()'s ids; null ids give an empty content."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([vocab.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), "ids").mapInArrow(tidied(run), "doc_id long, content binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """DIGESTS of every text's ids and of what they decode to, without moving the ids out of the worker."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(rank_file)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            rows = []
            for ids, ends, _ in encode_texts(data, offsets, vocab):
                names = " ".join(map(vocab.names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(names).hexdigest(), hashlib.sha256(vocab.decode(ids)).hexdigest(), len(ends)))
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch(
                    [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.int64())],
                    names=[x.split()[0] for x in DIGESTS.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), DIGESTS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
