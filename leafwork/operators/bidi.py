"""Lines of glyphs in logical order, whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafwork.functions.script import BACK, FRONT
from leafwork.operators.arrow import of_texts, starts, strings, within

N, R, L = 0, 1, 2


def _strong() -> np.ndarray:
    """R, L or N of each code point of the basic plane, as in ``script.strong_class``; all others are N."""
    table = np.zeros(0x10000, np.int8)
    for a, z, kind in ((0x590, 0x8FF, R), (0xFB1D, 0xFDFF, R), (0xFE70, 0xFEFF, R), (0x30, 0x39, L), (0x41, 0x5A, L), (0x61, 0x7A, L), (0xC0, 0x24F, L)):
        table[a : z + 1] = kind
    return table


_STRONG = _strong()
_MIRROR = np.arange(0x100, dtype=np.uint32)
_MIRROR[[ord(c) for c in FRONT]] = [ord(c) for c in BACK]


def logical(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Glyphs of lines of the given sizes, each line turned from its places to logical order."""
    n = len(codes)
    if not n:
        return codes
    kind = np.where(codes < 0x10000, _STRONG[np.minimum(codes, 0xFFFF)], np.int8(N))
    ends = starts(size).astype(np.int32)
    first, last = np.repeat(ends[:-1], size), np.repeat(ends[1:], size)
    rtl = np.repeat(np.add.reduceat(kind == R, ends[:-1]) > 0, size)
    here = np.arange(n, dtype=np.int32)
    left = np.maximum.accumulate(np.where(kind != N, here, np.int32(-1)))
    right = np.minimum.accumulate(np.where(kind != N, here, np.int32(n))[::-1])[::-1]
    between = (left >= first) & (right < last) & (kind[left] == L) & (kind[np.minimum(right, n - 1)] == L)
    side = np.where(kind == N, np.where(between, np.int8(L), np.int8(R)), kind)
    new = np.ones(n, bool)
    new[1:] = (side[1:] != side[:-1]) | (first[1:] != first[:-1])
    runs = np.flatnonzero(new).astype(np.int32)
    long = np.diff(np.append(runs, np.int32(n)))
    a, b = np.repeat(runs, long), np.repeat(runs + long, long)
    to = np.where(~rtl, here, np.where(side == L, first + last - b + here - a, first + last - 1 - here))
    shown = np.where(rtl & (side == R) & (codes < 0x100), _MIRROR[np.minimum(codes, 0xFF)], codes)
    out = np.empty_like(codes)
    out[to] = shown
    return out


def bidi_lines(texts: DataFrame, glyphs: int = 60) -> DataFrame:
    """``(doc_id, no, line)``: the texts' glyphs, ``glyphs`` a line, in logical order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, codes, size in of_texts(batches, "text"):
            lines = -(-size // glyphs)
            no = within(lines)
            long = np.minimum(glyphs, np.repeat(size, lines) - no * glyphs)
            ids = b["doc_id"].take(pa.array(np.repeat(np.arange(len(size)), lines)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(no), strings(logical(codes, long), long)], ["doc_id", "no", "line"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, no long, line string")
