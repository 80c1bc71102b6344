"""Shared pieces: batched text access, vectorised word hashing, tokenizer files."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

TOKENIZERS = "/opt/tokenizers"
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_powers: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most ``rows`` documents at once, where the session leaves Spark's default of 10,000.

    Lists of words take several times the memory of the texts, and two workers may share an executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def fresh(*stems: str) -> list[str]:
    """Column names that no table has."""
    return [f"{stem}_{uuid.uuid4().hex}" for stem in stems]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts take about ``most`` bytes together (one text may take more)."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, min(to, len(texts))
        at = to


def parts(lists: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lists have about ``most`` items together (one list may have more)."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(lists):
        to = min(len(lists), max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1))
        yield at, to
        at = to


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and offsets of each text's words.

    A word is a longest run of ASCII letters and digits and of characters beyond ASCII, in lower case, where a character of a
    script that is written without spaces is a word by itself. Prefix sums of a polynomial modulo 2^64 give every word's
    hash without a loop over words.
    """
    low = pc.utf8_lower(texts)
    b, at = raw(low)
    if ((b == 0xE0) | (b == 0xE1) | (b >= 0xE3)).any():
        b, at = raw(pc.replace_substring_regex(low, _UNSPACED, r" \1 "))
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = _WORD[b]
    before = np.concatenate([[False], inside[:-1]])
    before[at[:-1][at[:-1] < n]] = False
    after = np.concatenate([inside[1:], [False]])
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start]), np.searchsorted(start, at)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and offsets of each text's runs.

    A text of fewer words has one run of them all; one without words but with other characters than white space has one
    run, of its whole text; a null or blank one has none.
    """
    h, at = words(texts)
    n_words = np.diff(at)
    end = np.repeat(at[1:], n_words)
    here = np.arange(len(h))
    out = np.zeros(len(h), np.uint64)
    for t in range(width):
        m = len(h) - t
        if m <= 0:
            break
        part = h[t:] * np.uint64(pow(int(_BASE), t + 1, 1 << 64))
        out[:m] += np.where(here[:m] + t < end[:m], part, np.uint64(0))
    valid = here <= np.maximum(np.repeat(at[:-1], n_words), end - width)
    out, offsets = mix(out[valid]), np.concatenate([[0], np.cumsum(np.minimum(n_words, np.maximum(1, n_words - width + 1)))])
    bare = np.flatnonzero(n_words == 0)
    odd = [(i, s) for i in bare.tolist() if (s := (texts[i].as_py() or "").strip())]
    if odd:
        add = np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little") for _, s in odd], np.uint64)
        where = np.array([i for i, _ in odd])
        out = np.insert(out, offsets[where], add)
        offsets = offsets + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(n_words)), where))])
    return out, offsets


def ranks(path: str) -> dict[bytes, int]:
    """A tokenizer's pieces with their ids, from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
