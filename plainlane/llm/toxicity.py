"""Toxicity of whole texts: a bidirectional gated recurrent network with attention over all overlapping windows.

Words (split at ASCII white space, A-Z lower-cased, ASCII punctuation stripped at the ends) enter as a vector of their
own, if the training sample has them often enough, and as the mean of the vectors of their hashed character n-grams.
The network scores every window of 24 words, 12 apart. Labels are of documents, so training goes by rounds: score all
windows of the sample, then learn from the highest ones of each document. A logistic layer turns a document's window
scores into its probability, weighted to the share of toxic labels among all labelled training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import gru
from ._common import LOWER, SPACED, U64, blocks, column_bytes, mix, ragged, read_table, tidied, word_bounds, word_hashes

LENGTH, STRIDE = 24, 12
#: Bounds of the training sample: documents of each label, taken by the order of a hash of their ids.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 1600
#: Bounds of the sample's texts in bytes: of one, and of all of one label. Longer texts teach nothing, but are scored whole.
TEXT_BYTES, SAMPLE_BYTES = 2 << 20, 16 << 20
#: Sizes of character n-grams in bytes (a mark stands before and after each word), and their hash buckets.
GRAMS, BUCKETS = (3, 5, 7), 1 << 14
#: A word has its own vector if so many documents of the sample have it.
WORD_DOCS = 8
ROUNDS, TOP, BATCH = 5, 2, 256
#: Batches of a round at least: small samples are gone through more than once.
STEPS = 30
FOLDS = 5
#: Windows scored at once, by a worker.
CHUNK = 1024
#: Text bytes of a block: larger ones repeat fewer words.
BLOCK = 2 << 20

_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass
class Model:
    p: dict
    words: np.ndarray  # sorted hashes of words with vectors 1, 2, ...
    scale: np.ndarray  # of the document layer
    base: float  # the share of toxic rows; the score of texts without words

    def vectors(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The input vectors of words, their numbers in the word table, and (buckets, owners, counts) of their n-grams."""
        at = np.searchsorted(self.words, hashes).clip(max=max(len(self.words) - 1, 0))
        number = np.where(self.words[at] == hashes, at + 1, 0) if len(self.words) else np.zeros(len(hashes), np.int64)
        grams = character_grams(raw, starts, ends)
        return np.concatenate((self.p["word"][number], _means(self.p["char"], *grams)), axis=1), number, grams


def character_grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of each word's character n-grams, one word after another, with offsets (n + 1) and sizes."""
    sizes = ends - starts + 2
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    body = np.full(offsets[-1], 1, np.uint64)  # the marks
    inner = ragged(offsets[:-1] + 1, sizes - 2)
    body[inner] = raw[ragged(starts, sizes - 2)]
    body = mix(body + U64(0x632BE59BD9B4E019))
    parts, counts = [], []
    for k in GRAMS:
        n = np.maximum(sizes - k + 1, 0)
        at = ragged(offsets[:-1], n)
        x = np.zeros(len(at), np.uint64)
        for j in range(k):
            x = x * U64(0x9E3779B97F4A7C15) + body[at + j]
        parts.append((mix(x + U64(k)) & U64(BUCKETS - 1)).astype(np.int64))
        counts.append(n)
    # words shorter than the least n-gram keep one bucket for the whole word
    total = np.sum(counts, axis=0)
    ends_ = np.cumsum(total)
    first = ends_ - total
    out = np.empty(int(total.sum()), np.int64)
    done = np.zeros(len(starts), np.int64)
    for x, n in zip(parts, counts):
        out[ragged(first + done, n)] = x
        done += n
    return out, np.concatenate(([0], ends_)), total


def _means(table: np.ndarray, buckets: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(table[buckets], offsets[:-1][some], axis=0) / counts[some, None]
    return out


def block_words(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, hashes, ranges) of the stripped words; a word of punctuation only is left whole."""
    data = LOWER[data]
    starts, ends, ranges = word_bounds(data, offsets, SPACED)
    s, e = starts.copy(), ends.copy()
    for _ in range(3):
        move = (s < e - 1) & _EDGE[data[s]] if len(s) else np.empty(0, bool)
        s = s + move
        move = (s < e - 1) & _EDGE[data[e - 1]] if len(s) else np.empty(0, bool)
        e = e - move
    return data, s, e, word_hashes(data, s, e), ranges


def windows(ranges: np.ndarray, length: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows and the rows they belong to: every stride words, the last one flush with the end."""
    counts = np.diff(ranges)
    n = np.where(counts > 0, 1 + np.maximum(-(-(counts - length) // stride), 0), 0)
    owner = np.repeat(np.arange(len(counts)), n)
    first = ragged(np.zeros(len(n), np.int64), n) * stride
    first = np.minimum(first, np.maximum(counts[owner] - length, 0))
    return ranges[owner] + first, owner


def _indexed(first: np.ndarray, owner: np.ndarray, ranges: np.ndarray, of: np.ndarray):
    """(index, mask) of windows; places past a row's end are masked."""
    at = first[:, None] + np.arange(LENGTH)
    inside = at < ranges[owner + 1][:, None]
    return np.where(inside, of[np.where(inside, at, first[:, None])], 0), inside.astype(np.float32)


def window_logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows of a block of texts, and their rows."""
    data, s, e, h, ranges = block_words(data, offsets)
    if not len(h):
        return np.empty(0, np.float32), np.empty(0, np.int64)
    _, at, of = np.unique(h, return_index=True, return_inverse=True)
    vectors, _, _ = model.vectors(data, s[at], e[at], h[at])
    projected = gru.project(model.p, vectors)
    first, owner = windows(ranges)
    out = np.empty(len(first), np.float32)
    full = np.diff(ranges)[owner] >= LENGTH
    for kind in (True, False):
        rows = np.flatnonzero(full == kind)
        for i in range(0, len(rows), CHUNK):
            r = rows[i : i + CHUNK]
            index, mask = _indexed(first[r], owner[r], ranges, of)
            out[r] = gru.logits(model.p, projected, index, None if kind else mask)
    return out, owner


def document_features(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Highest logit, mean of the three highest, share of windows over 0, and log of their count, for each row."""
    out = np.zeros((n, 5), np.float64)
    order = np.lexsort((-x, owner))
    x, owner = x[order], owner[order]
    ranges = np.searchsorted(owner, np.arange(n + 1))
    counts = np.diff(ranges)
    some = np.flatnonzero(counts)
    out[:, 0] = 1
    if len(some):
        x = np.clip(x.astype(np.float64), -12, 12)
        sums = np.concatenate(([0], np.cumsum(x)))
        over = np.concatenate(([0], np.cumsum(x > 0)))
        a = ranges[some]
        three = np.minimum(counts[some], 3)
        out[some, 1] = x[a]
        out[some, 2] = (sums[a + three] - sums[a]) / three
        out[some, 3] = (over[ranges[some + 1]] - over[a]) / counts[some]
        out[some, 4] = np.log1p(counts[some])
    return out


def score(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of each row of a column of texts."""
    out = []
    for i, j in blocks(offsets, BLOCK):
        x, owner = window_logits(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        f = document_features(x, owner, j - i)
        p = 1 / (1 + np.exp(-np.clip(f @ model.scale, -40, 40)))
        out.append(np.where(f[:, 4] > 0, p, model.base))
    return np.concatenate(out) if out else np.empty(0)


def train(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """Learns from labelled texts; share is that of toxic rows among all labelled ones. One class only: a constant."""
    labels = np.asarray(labels, np.float32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    raw, s, e, h, ranges = _sample_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    logit_share = float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4))))
    constant = Model({**gru.new_parameters(1, BUCKETS)}, np.empty(0, np.uint64), np.array([logit_share, 0, 0, 0, 0]), float(share))
    if not len(h) or labels.min() == labels.max():
        return constant
    uniq, at, of = np.unique(h, return_index=True, return_inverse=True)
    owner_of = np.repeat(np.arange(len(texts)), np.diff(ranges))
    docs_with = np.bincount(np.unique(of * np.int64(len(texts)) + owner_of) // len(texts), minlength=len(uniq))
    known = uniq[docs_with >= WORD_DOCS]
    p = gru.new_parameters(len(known) + 1, BUCKETS, seed)
    model = Model(p, known, constant.scale, float(share))
    first, owner = windows(ranges)
    adam, r = gru.Adam(p), np.random.default_rng(seed)
    y = labels[owner]
    weight = np.where(labels > 0, 0.5 * len(labels) / labels.sum(), 0.5 * len(labels) / (len(labels) - labels.sum())).astype(np.float32)
    chosen = r.permutation(len(first))[: 24 * BATCH * TOP]
    for round_ in range(ROUNDS + 1):
        if round_:
            x = _sample_logits(model, raw, s, e, h, at, of, first, owner, ranges)
            order = np.lexsort((-x, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            chosen = r.permutation(order[rank < np.where(y[order] > 0, TOP, TOP + 2)])
        batches = -(-len(chosen) // BATCH)
        passes = [r.permutation(chosen) for _ in range(-(-STEPS // batches))]
        for rows in (p_[i : i + BATCH] for p_ in passes for i in range(0, len(p_), BATCH)):
            index, mask = _indexed(first[rows], owner[rows], ranges, of)
            own, local = np.unique(index, return_inverse=True)
            a = at[own]
            vectors, number, (buckets, _, counts) = model.vectors(raw, s[a], e[a], h[a])
            _, grad, dv = gru.gradients(p, vectors, local.reshape(index.shape), mask, y[rows], weight[owner[rows]])
            grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(grad["word"], number, dv[:, : gru.WORD_DIM])
            grad["word"][0] = 0
            np.add.at(grad["char"], buckets, np.repeat(dv[:, gru.WORD_DIM :] / np.maximum(counts, 1)[:, None], counts, axis=0))
            adam.update(p, grad)
        adam.rate = 0.01 * (1 - round_ / (ROUNDS + 2))
    x = _sample_logits(model, raw, s, e, h, at, of, first, owner, ranges)
    f = document_features(x, owner, len(texts))
    rate = labels.mean()
    model.scale = _logistic(f, labels, np.where(labels > 0, share / rate, (1 - share) / (1 - rate)))
    return model


def _sample_words(data: np.ndarray, offsets: np.ndarray):
    """block_words() of many texts, block by block."""
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in blocks(offsets):
        raw, s, e, h, ranges = block_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((raw, s + offsets[i], e + offsets[i], h))
        counts.append(np.diff(ranges))
    if not parts:
        return data, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return *(np.concatenate(x) for x in zip(*parts)), np.cumsum(np.concatenate(counts))


def _sample_logits(model, raw, s, e, h, at, of, first, owner, ranges) -> np.ndarray:
    parts = [gru.project(model.p, model.vectors(raw, s[a], e[a], h[a])[0]) for a in np.array_split(at, -(-len(at) // 20000))]
    projected = tuple(np.concatenate(x) for x in zip(*parts))
    out = np.empty(len(first), np.float32)
    for i in range(0, len(first), CHUNK):
        index, mask = _indexed(first[i : i + CHUNK], owner[i : i + CHUNK], ranges, of)
        out[i : i + CHUNK] = gru.logits(model.p, projected, index, mask if (mask == 0).any() else None)
    return out


def _logistic(f: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    b = np.zeros(f.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(f @ b, -30, 30)))
        hess = (f * (w * q * (1 - q))[:, None]).T @ f + ridge * np.eye(len(b))
        b += np.clip(np.linalg.solve(hess, f.T @ (w * (y - q)) - ridge * b), -4, 4)
    return b


def fold_of(col) -> F.Column:
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_docs: int = TOXIC_SAMPLE, clean_docs: int = CLEAN_SAMPLE,
    text_bytes: int = TEXT_BYTES, sample_bytes: int = SAMPLE_BYTES,
) -> tuple[list[tuple[int, int, bytes]], float]:
    """The rows to learn from, as (id, label, text) in the order of ids, and the share of toxic ones among all labelled rows.

    Labelled rows outside fold 0: the first toxic_docs and clean_docs ids by a hash; of their texts those of at most
    text_bytes, as long as those of a label are sample_bytes together. Null ids, null labels and rows without a document
    are not used; an id labelled twice counts once, as toxic if either says so; of several texts of an id the greatest is
    taken; null texts are empty.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = known.where("y = 1").orderBy(order, "doc_id").limit(toxic_docs).union(known.where("y = 0").orderBy(order, "doc_id").limit(clean_docs))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # the sample is at most toxic_docs + clean_docs ids
    texts = texts.where(F.octet_length("text") <= text_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    so_far = Window.partitionBy("y").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.withColumn("total", F.sum(F.octet_length("text").cast("long")).over(so_far)).where(F.col("total") <= sample_bytes)
    rows = sorted((r["doc_id"], r["y"], bytes(r["text"])) for r in texts.collect())
    total = sum(counts.values())
    return rows, counts.get(1, 0) / total if total else 0.0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int) -> Model:
    """A model of sample()'s rows, with its bounds."""
    rows, share = sample(docs, labels, id_col, text_col, label_col, **bounds)
    return train([t for _, _, t in rows], np.array([y for _, y, _ in rows] or [0]), share)


SCORED = "doc_id long, score double"


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability that a text is toxic, from all its windows.

    Null, empty and wordless texts get the share of toxic rows; null ids stay null; repeated rows are scored alike; an
    empty table gives an empty one; other columns are not looked at. Narrow: the model (about 1 MB) is broadcast.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            if batch.num_rows:
                p = score(shared.value, data, offsets)
                yield pa.record_batch([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), SCORED)


def with_scores(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """docs with a column name of the scores: all columns pass through, no shuffle."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                p = score(shared.value, *column_bytes(batch.column(at)))
                yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
