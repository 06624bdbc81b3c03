"""Sequential scans over arrays of numbers, which Spark's folds do only by copying what they have gathered at each step.

Both are Arrow functions of whole columns of arrays: only the numbers go to Python, and time is linear in their count.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lists(array):
    """The flat values of an Arrow column of arrays as int64, and each row's first place (n + 1 numbers); null rows are empty."""
    import numpy as np
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    sizes = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = array.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
    return values, np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


def _column(values, offsets):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int64()))


def sweep_flat(starts, ends, offsets):
    """Places, in their rows, of the spans that a sweep keeps, and the places' own row offsets."""
    import numpy as np

    kept: list[int] = []
    counts = [0]
    rows = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    starts, ends = starts.tolist(), ends.tolist()
    for first, last in rows:
        at = None
        for i in range(first, last):
            if at is None or starts[i] >= at:
                kept.append(i - first)
                at = ends[i]
        counts.append(len(kept))
    return np.array(kept, np.int64), np.array(counts, np.int64)


@cache
def _sweep():
    def kept(starts, ends):
        s, offsets = _lists(starts)
        e, _ = _lists(ends)
        return _column(*sweep_flat(s, e, offsets))

    return F.arrow_udf(kept, "array<bigint>")


def kept_places(starts: Column, ends: Column) -> Column:
    """Places (from 0) of the spans that a sweep in their order keeps: the first, then each that starts where the last kept one
    ended, or later. Two arrays of equal length; a null one is empty."""
    return _sweep()(starts.cast("array<bigint>"), ends.cast("array<bigint>"))


@cache
def _running():
    def sums(numbers):
        import numpy as np

        values, offsets = _lists(numbers)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values)))
        return _column(total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets)), offsets)

    return F.arrow_udf(sums, "array<bigint>")


def running_sums(numbers: Column) -> Column:
    """The sums of an array's numbers up to each one; a null array is empty."""
    return _running()(numbers.cast("array<bigint>"))
