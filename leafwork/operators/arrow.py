"""Arrow batches for Python that works on many short things at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` in as many partitions as the session's shuffles have, while its rows are still few.

    What comes later (windows and aggregates by ``key`` and more, Python) needs no other shuffle, however many rows it makes of
    one, and partitions aren't joined by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def starts(size: np.ndarray) -> np.ndarray:
    """Where each of successive pieces of the given sizes begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def within(size: np.ndarray) -> np.ndarray:
    """0, 1, .. in each of successive pieces of the given sizes."""
    return np.arange(int(size.sum())) - np.repeat(starts(size)[:-1], size)


def parts(size: np.ndarray, most: int) -> Iterator[slice]:
    """Successive slices of at most ``most`` together, or of one piece that is larger."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(at, to)
        at = to


def of_texts(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 18, keep_null: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``most`` characters at once, with the code points of all and the number of each; no rows without text, or as empty ones."""
    for b in batches:
        b = b if keep_null else b.filter(pc.is_valid(b[column]))
        size = pc.fill_null(pc.utf8_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for s in parts(size, most):
            part = b.slice(s.start, s.stop - s.start)
            joined = "".join(pc.fill_null(part[column], "").to_pylist())
            yield part, np.frombuffer(joined.encode("utf-32-le"), np.uint32), size[s]


def strings(codes: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of the given numbers of code points, one after the other."""
    wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    offsets = starts(wide)[starts(size)]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)).cast(pa.string())


def whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches cut where keys change, with where each group begins and the end of the last: no group is in two of them."""
    left = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if left is None else pa.concat_batches([left, b])
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            x = pc.fill_null(b[k], -(1 << 31)).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new)
        if at[-1]:
            yield b.slice(0, at[-1]), at
        left = b.slice(at[-1])
    if left is not None:
        yield left, np.array([0, left.num_rows])
