"""Shared pieces of the training-data operators: byte-level words, hashes, staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64

#: Text bytes that one vectorised step works on; longer texts go alone.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs on one
    machine (tests); on a cluster that is an error, for executors would write to their own disks."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "plainlane-shared")
    return path.rstrip("/")


def staged(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut and lost executors cost nothing.

    options are the writer's. Tables that no unstage() deletes, for results still read them, go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _place(spark, path)[0].deleteOnExit(_place(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._plainlane_path = path
    return out


def _place(spark: SparkSession, path: str):
    """The file system and the Hadoop path of a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def unstage(*tables: DataFrame) -> None:
    """Deletes tables of staged() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_plainlane_path", None)
        if path:
            system, place = _place(df.sparkSession, path)
            system.delete(place, True)


#: Documents whose files are smaller than this are dealt to all cores once: they may hold fewer row groups than there are
#: cores, and a row group is one task. Larger inputs stay where they are.
SMALL_BYTES = 48 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


#: Rows of an Arrow batch: bounds what a worker and its executor hold of whole texts at once.
BATCH_ROWS = 1000


def _tidy() -> None:
    """Gives a worker's free memory back to the system; workers live on and serve other operators."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidied(work):
    """work for mapInArrow, with batches of BATCH_ROWS rows and the worker's memory tidied up after each task."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        yield from work(batches)
        _tidy()

    return run


# ---------------------------------------------------------------- bytes and words


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (null: empty) and its n + 1 offsets."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """(first row, last row + 1) of consecutive rows of at most limit bytes; a longer row goes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def byte_class(separators: bytes) -> np.ndarray:
    """True for bytes of words."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
SPACED = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = byte_class(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of the words of all rows, and each row's range of words (n + 1 numbers)."""
    inside = table[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:] = inside
    if len(data):
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    if len(data):
        after[offsets[1:-1]] = False
    after = after[1:]
    # a row's first byte may be a word's: the row before must end there
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one prefix sum over the block."""
    if not len(starts):
        return np.empty(0, np.uint64)
    table = _BYTE if fold is None else _BYTE[fold]
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * power, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive words, at the first one's place; the last k - 1 places have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(words))
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((mix(words ^ _GRAM[salt % 64]) if salt else words) * power, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n] + U64(salt))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of queries that are done, whose frames nothing holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(firsts - starts, lengths)


def sum_of_ranges(offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many marks each of the consecutive ranges holds."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
