"""Token counts of flat token streams without an index, by a separator scan.

A stream is a file of fixed-width token ids, documents ended by an end-of-document id, cut into blocks of any size with
no regard for documents. Each block is searched for separators in one vectorised pass and summed up as (tokens, separators,
tokens before the first, tokens after the last). These summaries combine associatively, so the state in which each block
starts (documents closed before it, tokens of the open one) is a prefix scan: within runs of SPAN blocks, and over the
runs' sums. Lengths of documents that cross blocks are then stitched; no file, run or document has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import column_bytes, read_table, staged, tidied
from .byte_bpe import encode_texts, vocabulary

#: The id that ends documents: the one that the public byte-level vocabulary leaves free.
SEPARATOR = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 15
#: Blocks of one run of the prefix scan.
SPAN = 1024

STREAM = "file int, block int, tokens binary, nth long, doc_id long"


def write_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A staged table of flat streams, one for each partition of docs, from byte-level BPE ids.

    Rows with tokens are blocks (16-bit little-endian ids, cut anywhere); rows without are a stream's list of documents
    (nth, doc_id), which the counting does not read.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    names = [x.split()[0] for x in STREAM.split(", ")]

    def run(batches) -> Iterator:
        vocab = vocabulary(rank_file)
        file, block, nth = TaskContext.get().partitionId(), 0, 0
        rest = b""
        size = block_tokens * WIDTH

        def out(blocks: list[bytes], ids):
            nonlocal block, nth
            n, m = len(blocks), len(ids)
            yield pa.record_batch(
                [
                    pa.array(np.full(n + m, file, np.int32)), pa.array([*range(block, block + n), *[None] * m], pa.int32()), pa.array([*blocks, *[None] * m], pa.binary()),
                    pa.array([*[None] * n, *range(nth, nth + m)], pa.int64()), pa.array([*[None] * n, *ids], pa.int64()),
                ],
                names=names,
            )
            block, nth = block + n, nth + m

        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            done, parts, held = 0, [rest], len(rest)
            for k, (tokens, _, _) in enumerate(encode_texts(data, offsets, vocab)):
                tokens.append(SEPARATOR)
                parts.append(np.array(tokens, "<u2").tobytes())
                held += len(parts[-1])
                if held >= 64 * size or k == len(ids) - 1:
                    raw = b"".join(parts)
                    whole = len(raw) // size * size
                    yield from out([raw[i : i + size] for i in range(0, whole, size)], ids[done : k + 1])
                    rest, done = raw[whole:], k + 1
                    parts, held = [rest], len(rest)
        if rest:
            yield from out([rest], [])

    return staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), STREAM), "token-stream")


def read_files(spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file string, block int, tokens binary) of flat token files, which Spark's binary reader takes whole (up to 2 GB
    each). A file whose size is no multiple of width is an error."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        size = width * block_tokens
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(content.as_buffer())
                if len(raw) % width:
                    raise ValueError(f"{name}: {len(raw)} bytes are no whole number of tokens")
                for k, at in enumerate(range(0, len(raw), size)):
                    yield pa.record_batch([pa.array([name]), pa.array([k], pa.int32()), pa.array([bytes(raw[at : at + size])], pa.binary())], names=["file", "block", "tokens"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tidied(run), "file string, block int, tokens binary")


def _scan(width: int, separator: int):
    kind = {2: "<u2", 4: "<u4", 8: "<u8"}[width]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                ids = np.frombuffer(data[a:b].tobytes(), kind)
                at = np.flatnonzero(ids == separator)
                n = len(ids) - len(at)
                if len(at):
                    rows.append((n, len(at), int(at[0]), len(ids) - 1 - int(at[-1]), (np.diff(at) - 1).tolist()))
                else:
                    rows.append((n, 0, n, n, []))
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch(
                    [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.list_(pa.int64()))],
                    names=["file", "block", "n", "seps", "head", "tail", "inner"],
                )

    return run


def count_tokens(blocks: DataFrame, width: int = WIDTH, separator: int = SEPARATOR) -> DataFrame:
    """(file, nth, n_tokens, ended) of every document of flat streams (file, block, tokens binary).

    nth counts a file's documents from 0; separators are not counted. Tokens after a file's last separator are a document
    that is not ended; none there, none reported. Two separators in a row enclose a document of no tokens. Null and empty
    blocks hold nothing; an empty table gives an empty one; other columns are not looked at. Blocks of a file are ordered
    by number, which may have gaps but must not repeat.
    """
    kind = dict(blocks.dtypes)["file"]
    scanned = blocks.select("file", "block", "tokens").mapInArrow(tidied(_scan(width, separator)), f"file {kind}, block int, n long, seps long, head long, tail long, inner array<long>")
    scanned = staged(scanned.withColumn("run", F.floor(F.col("block") / SPAN).cast("int")), "block-sums")

    def opened(part: Window, order: str):
        """Sums before a row: separators, and tokens since the last one (null until there is one), and all tokens."""
        before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        total = F.coalesce(F.sum("n").over(before), F.lit(0))
        # tokens after the last separator, less all tokens up to its row: adding later totals gives the open ones
        base = F.when(F.col("seps") > 0, F.col("tail") - F.sum("n").over(upto))
        return F.coalesce(F.sum("seps").over(before), F.lit(0)), total, base, before

    inside = ["file", "run"]
    seps, total, base, before = opened(inside, "block")
    local = scanned.withColumns({"seps_before": seps, "n_before": total, "base": base})
    local = local.withColumn("since", F.last("base", ignorenulls=True).over(before) + F.col("n_before"))
    runs = scanned.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max(F.when(F.col("seps") > 0, F.struct("block", "tail"))).alias("last"))
    after = scanned.join(runs.select("file", "run", F.col("last.block").alias("last_block")), inside).where("block > last_block").groupBy("file", "run").agg(F.sum("n").alias("rest"))
    runs = runs.join(after, inside, "left").select("file", "run", "n", "seps", (F.col("last.tail") + F.coalesce("rest", F.lit(0))).alias("tail"))
    seps, total, base, before = opened(["file"], "run")
    runs = runs.withColumns({"run_seps": seps, "run_total": total, "base": base})
    runs = runs.withColumn("run_open", F.coalesce(F.last("base", ignorenulls=True).over(before), F.lit(0)) + F.col("run_total")).select("file", "run", "run_seps", "run_open")
    started = local.join(runs, inside).withColumn("open", F.coalesce("since", F.col("run_open") + F.col("n_before"))).withColumn("first", F.col("run_seps") + F.col("seps_before"))
    lengths = F.when(F.col("seps") > 0, F.concat(F.array(F.col("open") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    ended = started.select("file", "first", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("nth"), "n_tokens", F.lit(True).alias("ended"))
    left = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("open") + F.col("n"))
    last = started.groupBy("file").agg(F.max(F.struct("block", (F.col("first") + F.col("seps")).alias("nth"), left.alias("n_tokens"))).alias("x")).where("x.n_tokens > 0")
    return ended.unionByName(last.select("file", "x.nth", "x.n_tokens", F.lit(False).alias("ended")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = write_stream(read_table(spark, sf_dir, "documents"))
    counts = count_tokens(stream.where("tokens is not null").select("file", "block", "tokens"))
    listed = stream.where("tokens is null").select("file", "nth", "doc_id")
    return listed.join(counts, ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth")
