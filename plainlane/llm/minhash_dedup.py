"""Near-duplicate groups of documents: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes), a signature of 128 slots, 32 band keys of four
   slots and a digest of the set. Documents of equal digest are one class, which its least id stands for.
2. Classes that share a band key form buckets. Each bucket's members are checked against two of its members, the least
   and a pseudo-random one, on their full sets; the links that hold are grouped.
3. Buckets whose members then lie in one group are done, however large. In the others, members of different groups are
   compared by whole signatures, in blocks of bounded size, and those with a partner that could reach the threshold are
   compared on their full sets, block by block, so that no pair becomes a row. Blocks of one large group never meet, so a
   bucket of one huge group and a few others costs its size times theirs. No bucket, partner or candidate is capped.

A pair at the threshold itself is missed by all bands with probability (1 - 0.75^4)^32 = 5e-6, by the signature
comparison with less than 1e-7; both fall fast above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _graph
from ._common import LOWER, SPACED, U64, as_long, blocks, column_bytes, gram_hashes, mix, ragged, read_table, staged, tidied, unstage, word_bounds, word_hashes
from .superminhash import SLOTS, signatures

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Mean members of a block of the signature comparison, and slots (of 128, by their low bytes) that a link must agree in.
BLOCK, AGREE = 256, 68
#: Parts of a class where its rows are joined.
SALT = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and their n + 1 offsets; shorter texts are one shingle."""
    data = LOWER[data]
    starts, ends, ranges = word_bounds(data, offsets, SPACED)
    h = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    counts = np.diff(ranges)
    grams = gram_hashes(h, words)
    many = np.maximum(counts - words + 1, 0)
    e, owner = grams[ragged(ranges[:-1], many)] if len(grams) else grams, np.repeat(np.arange(n), many)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        own = np.array([int(gram_hashes(h[ranges[i] : ranges[i + 1]], counts[i], salt=int(counts[i]))[0]) for i in short], np.uint64)
        e, owner = np.concatenate((e, own)), np.concatenate((owner, short))
    order = np.lexsort((e, owner))
    e, owner = e[order], owner[order]
    if len(e):
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]) | (owner[1:] != owner[:-1])
        e, owner = e[new], owner[new]
    return e, np.searchsorted(owner, np.arange(n + 1))


def _sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) keys; keys of different bands differ."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), mix(np.array([b + 1], np.uint64))[0])
        for r in range(rows):
            key = mix(key ^ sig[:, b * rows + r])
        out[:, b] = key
    return out


SIGNED = "doc_id long, n long, d1 long, d2 long, bands array<long>, sig binary"


def _sign(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in blocks(offsets):
            e, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sig = signatures(e, at)
            sizes = np.diff(at)
            keys = as_long(band_keys(sig)[sizes > 0].ravel())
            lists = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            low = (sig & U64(255)).astype(np.uint8).tobytes()
            yield pa.record_batch(
                [
                    batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()),
                    pa.array(as_long(_sums(mix(e), at))), pa.array(as_long(_sums(mix(e ^ U64(0xA0761D6478BD642F)), at))),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(keys)),
                    pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((np.arange(j - i + 1) * SLOTS).astype(np.int32)), pa.py_buffer(low)]),
                ],
                names=["doc_id", "n", "d1", "d2", "bands", "sig"],
            )


def _sets(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in blocks(offsets):
            e, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(as_long(e)))], names=["doc", "shingles"])


def _by_key(batches, work) -> Iterator:
    """work(table, [(first row, last row + 1), ...]) for whole groups of rows sorted by (bucket, i, j)."""
    import pyarrow as pa

    held: list = []
    names = ("bucket", "i", "j")

    def done(table):
        key = np.stack([table.column(k).to_numpy() for k in names])
        cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        return work(table, list(zip(cuts[:-1].tolist(), cuts[1:].tolist())))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        same = np.logical_and.reduce([(x := table.column(k).to_numpy()) == x[-1] for k in names])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from done(table.slice(0, cut).combine_chunks())
        held = table.slice(cut).to_batches()
    if held:
        yield from done(pa.Table.from_batches(held).combine_chunks())


def _fits(n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, twice: bool) -> np.ndarray:
    """Which of left x right are of different groups and of sizes that allow a link; twice: both are the same rows."""
    a, b = n[left][:, None], n[right][None, :]
    ok = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
    return np.triu(ok, 1) if twice else ok


def _sides(side: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of block i and of block j (side 0 and 2), or twice those of one block (side 1)."""
    rows = np.arange(a, b)
    if side[a] == 1:
        return rows, rows, True
    return rows[side[a:b] == 0], rows[side[a:b] == 2], False


def _compare(batches) -> Iterator:
    """The rows (bucket, i, j, side, doc, comp) with a partner of another group whose signature agrees enough."""

    def work(table, groups):
        comp, n, side = (table.column(k).to_numpy() for k in ("comp", "n", "side"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(n), SLOTS)
        keep = np.zeros(len(n), bool)
        for a, b in groups:
            if b - a < 2 or (comp[a:b] == comp[a]).all():
                continue
            left, right, twice = _sides(side, a, b)
            ok = _fits(n, comp, left, right, twice)
            for k in np.flatnonzero(ok.any(axis=1)):
                other = right[ok[k]]
                other = other[(sig[other] == sig[left[k]]).sum(axis=1) >= AGREE]
                keep[other] = True
                keep[left[k]] |= len(other) > 0
        if keep.any():
            yield from table.select(["bucket", "i", "j", "side", "doc", "comp"]).take(np.flatnonzero(keep)).to_batches()

    return _by_key(batches, work)


def _verify(batches) -> Iterator:
    """Links (a, b) of different groups among the rows of each block pair, on their full sets; of the links of a document
    to one other group, which is connected already, the first stands for all."""
    import pyarrow as pa

    def work(table, groups):
        doc, comp, side = (table.column(k).to_numpy() for k in ("doc", "comp", "side"))
        lists = table.column("shingles").chunk(0) if table.column("shingles").num_chunks else None
        at, e = lists.offsets.to_numpy(), lists.values.to_numpy()
        n = np.diff(at)
        out_a, out_b = [], []
        for a, b in groups:
            left, right, twice = _sides(side, a, b)
            if not len(left) or not len(right):
                continue
            ok = _fits(n, comp, left, right, twice)
            if not ok.any():
                continue
            common = _common_counts(e, at, a, b)[np.ix_(left - a, right - a)]
            ok &= 100 * common >= PERCENT * (n[left][:, None] + n[right][None, :] - common)
            for k in np.flatnonzero(ok.any(axis=1)):
                other = right[ok[k]]
                other = other[np.unique(comp[other], return_index=True)[1]]
                out_a.append(np.full(len(other), doc[left[k]]))
                out_b.append(doc[other])
        if out_a:
            x, y = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return _by_key(batches, work)


def _common_counts(e: np.ndarray, at: np.ndarray, a: int, b: int, columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets a .. b - 1 share, by products of their 0/1 rows over ranges of elements."""
    own = e[at[a] : at[b]]
    _, number, count = np.unique(own, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
    shared = count[number] > 1
    number, row = (np.cumsum(count > 1) - 1)[number[shared]], row[shared]
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    out = np.zeros((b - a, b - a), np.int64)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        i, j = np.searchsorted(number, (lo, lo + columns))
        x = np.zeros((b - a, columns), np.float32)
        x[row[i:j], number[i:j] - lo] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold on their full sets."""
    right = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("common", common).where(F.expr(f"100L * common >= {PERCENT}L * (size(sa) + size(sb) - common)")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are split at ASCII white space, A-Z lower-cased; a text of fewer than five words is one shingle; null, empty
    and wordless texts have an empty set and are linked with nothing. component_id is the least doc_id reachable by
    links, kept whether the document is that one. Rows of null id take part in no group: component_id null, kept true.
    Ids should be unique; repeated rows are returned as often as they come, and different texts under one id count as
    linked. Other columns are not looked at; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(texts.mapInArrow(tidied(_sign), SIGNED), "signatures")
    keyed = signed.where("n > 0 and doc_id is not null")
    digest = ["n", "d1", "d2"]
    classes = keyed.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    members = keyed.join(classes.withColumn("doc_id", F.col("rep")), ["doc_id", *digest])
    entries = members.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc"), "n")
    hubs = entries.groupBy("bucket").agg(
        F.min(F.struct("doc", "n")).alias("first"),
        F.min(F.struct(F.xxhash64("doc", "bucket").alias("x"), "doc", "n")).alias("other"),
        F.count(F.lit(1)).alias("members"),
    )
    buckets = staged(
        entries.join(hubs.where("members > 1"), "bucket").select(
            "bucket", "doc", "n", "members",
            F.array(F.col("first"), F.struct(F.col("other.doc"), F.col("other.n"))).alias("hubs"),
        ),
        "buckets",
    )
    wanted = buckets.select(F.col("doc").alias("doc_id")).distinct()
    sets = staged(texts.join(wanted, "doc_id", "left_semi").mapInArrow(tidied(_sets), "doc long, shingles array<long>"), "sets")

    hub = F.col("hub")
    spokes = buckets.select("doc", "n", F.explode("hubs").alias("hub")).where((hub.doc != F.col("doc")) & (4 * F.least(hub.n, F.col("n")) >= 3 * F.greatest(hub.n, F.col("n"))))
    tested = staged(spokes.select(F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b")).distinct(), "pairs")
    links = staged(_links(tested, sets), "links")
    groups = _graph.components(links)

    # buckets of more than one group
    labelled = buckets.join(groups, buckets["doc"] == groups["node"], "left").select("bucket", "doc", "n", F.coalesce("root", "doc").alias("comp"))
    labelled = staged(labelled, "labelled")
    # groups of BLOCK members have blocks of their own, which never meet each other; smaller ones share blocks
    own = F.col("c") >= BLOCK
    sizes = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c")).withColumn("big", own).withColumn("pool", F.when(own, F.col("comp")).otherwise(0))
    several = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    sizes = staged(sizes.join(several, "bucket"), "sizes")
    pools = sizes.groupBy("bucket", "big", "pool").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("own"))
    # a bucket has at most one pool for BLOCK members, and one more
    upto = Window.partitionBy("bucket").orderBy("big", "pool").rowsBetween(Window.unboundedPreceding, 0)
    pools = pools.withColumn("first", (F.sum("own").over(upto) - F.col("own")).cast("int")).withColumn("blocks", F.sum("own").over(Window.partitionBy("bucket")).cast("int"))
    blocked = labelled.join(sizes.join(pools, ["bucket", "big", "pool"]).select("bucket", "comp", "big", "own", "first", "blocks"), ["bucket", "comp"])
    blocked = blocked.withColumn("block", F.col("first") + F.pmod(F.xxhash64("doc"), F.col("own")).cast("int"))
    with_sig = blocked.join(members.select(F.col("rep").alias("doc"), "sig").dropDuplicates(["doc"]), "doc")
    # members of a large group meet all blocks but their group's
    others = with_sig.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("big"), F.col("blocks") - F.col("own")).otherwise(F.col("blocks")) - 1)))
    dealt = others.withColumn("k", F.when(F.col("big") & (F.col("k") >= F.col("first")), F.col("k") + F.col("own")).otherwise(F.col("k")))
    dealt = dealt.select(
        "bucket", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "doc", "comp", "n", "sig",
        F.when(F.col("block") == F.col("k"), 1).when(F.col("block") < F.col("k"), 0).otherwise(2).alias("side"),
    )
    key = ["bucket", "i", "j"]
    near = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidied(_compare), "bucket long, i int, j int, side int, doc long, comp long")
    full = near.join(sets, "doc").select(*key, "side", "doc", "comp", "shingles")
    links2 = staged(full.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidied(_verify), "a long, b long").distinct(), "links")
    whole = _graph.components(links.union(links2))

    roots = classes.join(whole, classes["rep"] == whole["node"], "left").select(*digest, F.coalesce("root", "rep").alias("component"))
    # a class may hold a large part of all rows: its rows are dealt to SALT parts
    parts = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = signed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(parts, [*digest, "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    unstage(buckets, sets, tested, labelled, sizes)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
