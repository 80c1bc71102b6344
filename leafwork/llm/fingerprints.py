"""Document fingerprints by one-permutation MinHash with optimal densification (operator 4).

All word shingles are hashed once. The hash picks one of ``bins`` bins and the rest of it competes for the bin's minimum.
Empty bins copy from a bin that a 2-universal hash of (bin, attempt) draws, again and again until it is filled: each empty
bin draws for itself, which gives the least variance. Of every bin ``bits`` low-order bits are stored, packed. Two
fingerprints agree by chance in 2^-bits of the bins, which ``similarity`` (a column) and ``estimate`` correct for.

Scale: a map over the scan, vectorised over whole slices of texts; no shuffle, no state.

Edge cases: a null or blank text has a null fingerprint and 0 shingles; a text shorter than a shingle has one; a null id is
kept; repeated rows have equal fingerprints; texts are read whole whatever their length; shingles that tie for a bin's minimum
have one hash, so either stands for both; a null fingerprint has a null similarity; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import common

BINS = 256
BITS = 8
WIDTH = 3
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densify(m: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row (no row is all empty); only bins that are still empty draw again."""
    bins = m.shape[1]
    row, own = np.nonzero(m == _EMPTY)
    out, attempt = m.copy(), 0
    while len(row):
        attempt += 1
        draw = common.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 32)) % np.uint64(bins)
        value = m[row, draw.astype(np.int64)[own]]
        hit = value != _EMPTY
        out[row[hit], own[hit]] = value[hit]
        row, own = row[~hit], own[~hit]
    return out


def bin_minima(texts: pa.Array, bins: int = BINS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A row of minima per text (all ``_EMPTY`` without shingles) and the number of shingles."""
    h, at = common.shingles(texts, width)
    count = np.diff(at)
    cell = np.repeat(np.arange(len(count)) * bins, count) + (h >> np.uint64(40)).astype(np.int64) % bins
    m = np.full(len(count) * bins, _EMPTY)
    np.minimum.at(m, cell, h & np.uint64((1 << 40) - 1))
    return m.reshape(-1, bins), count


def pack(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low-order bits of each row's values, packed into bytes."""
    low = common.mix(m) & np.uint64((1 << bits) - 1)
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).reshape(len(m), -1), axis=1)


def unpack(packed: bytes, bits: int = BITS) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, bits).astype(np.int64)
    return (planes << np.arange(bits)).sum(1)


def estimate(a: bytes | None, b: bytes | None, bits: int = BITS) -> float | None:
    """Jaccard similarity from two fingerprints, corrected for agreement by chance; None if either is."""
    if a is None or b is None:
        return None
    chance = 2.0**-bits
    return max(0.0, (float((unpack(a, bits) == unpack(b, bits)).mean()) - chance) / (1 - chance))


def similarity(a: Column, b: Column, bits: int = BITS) -> Column:
    """``estimate`` as a column over two columns of fingerprints of one size, in Arrow batches; null where either is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        out, chance = np.full(len(x), np.nan), 2.0**-bits
        if both.any():
            left, right = (np.frombuffer(b"".join(v[both]), np.uint8).reshape(int(both.sum()), -1) for v in (x, y))
            differ = np.unpackbits(left ^ right, axis=1).reshape(len(left), -1, bits).any(2)
            out[both] = np.maximum(0.0, (1 - differ.mean(1) - chance) / (1 - chance))
        return pd.Series(out)

    return F.nanvl(run(a, b), F.lit(None).cast("double"))


def _fingerprints(bins: int, bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                m, count = bin_minima(batch.column(1).slice(a, b - a), bins, width)
                has = count > 0
                out = np.full(len(m), None, object)
                if has.any():
                    out[has] = [x.tobytes() for x in pack(densify(m[has]), bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(out.tolist(), pa.binary())], ["doc_id", "n_shingles", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_shingles, fingerprint)`` of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(bins, bits, width), "doc_id long, n_shingles long, fingerprint binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
