"""Token ids in binary form by Simple-8b word-aligned coding (operator 8).

Ids are cut into blocks of ``BLOCK``. A 64-bit word has a 4-bit selector and packs as many of the next ids as fit: 120
zeros, or 60 of 1 bit, 30 of 2, .. 1 of 60. An id of more than 60 bits is escaped: selector 0, and the id in the word after.
The last word of a block is filled up with zeros. The word where each block starts is stored, so that blocks can be read
alone and decoding is vectorised over all words of all blocks.

Scale: a map over the scan without a shuffle; texts are split into words by Spark, and each batch has its distinct words
encoded once, many at a call. Packing is vectorised over all blocks of many texts: windows that double tell for every place
which selectors fit, then all blocks step through their own places side by side.

Edge cases: null texts have null results, empty ones no words; a null id is kept; repeated rows get equal results; texts are
packed whole; negative ids are refused; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import bpe, common

BLOCK = 128
#: (count, bits) by selector; 0 is the escape.
SELECTORS = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (120, 0))
_COUNTS, _BITS = (np.array(x, np.uint8) for x in zip(*SELECTORS))
#: Words whose distinct ones are encoded together, and distinct words for one call of the tokenizer.
SHARED, CALL = 1 << 23, 1 << 16
#: Words without white space but one space before: the tokenizer cuts each off where a line break comes between them.
_PLAIN = r"^ ?[^\p{Z}\p{C}]+$"


def _widths(v: np.ndarray) -> np.ndarray:
    if len(v) and int(v.max()) < 1 << 20:
        return np.maximum((v.astype(np.float32).view(np.int32) >> 23) - 126, 0).astype(np.uint8)
    w = np.zeros(len(v), np.uint8)
    rest = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >> np.uint64(step) > 0
        w[big] += step
        rest[big] >>= np.uint64(step)
    return w + (rest > 0)


def _runs(fits: np.ndarray, left: np.ndarray, count: int) -> np.ndarray:
    """Where the next ``count`` places, or all that are left in the block, fit; changes ``fits``."""
    have = 1
    while have < count and fits.any():
        step = min(have, count - have)
        fits[:-step] &= fits[step:] | (left[:-step] <= step)
        have += step
    return fits


def pack(values: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack lists that stand one after the other in ``values``: words, first word of each list, first word of each block.

    The last two have an end entry. Blocks don't span lists.
    """
    if len(values) and values.dtype.kind == "i" and int(values.min()) < 0:
        raise ValueError("ids can't be negative")
    v = values.astype(np.uint64)
    n = len(v)
    n_blocks = -(-lengths // block)
    ends = np.cumsum(lengths)
    first = np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    number = np.arange(int(n_blocks.sum())) - first
    start = np.repeat(ends - lengths, n_blocks) + number * block
    end = np.minimum(start + block, np.repeat(ends, n_blocks))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(lengths) + 1, np.int64), np.zeros(1, np.int64)
    here = np.arange(n, dtype=np.int32)
    left = np.minimum(np.repeat(end.astype(np.int32), end - start) - here, 255).astype(np.uint8)
    width = _widths(v)
    low, high = int(width.min()), int(width.max())
    whole = min((s for s in range(1, 16) if SELECTORS[s][1] >= high), key=lambda s: SELECTORS[s][1], default=0)
    selector = np.full(n, whole, np.uint8)
    for s in (*range(14, 0, -1), 15):
        count, bits = SELECTORS[s]
        if low <= bits < high:
            np.copyto(selector, s, where=_runs(width <= bits, left, count))
    take = np.minimum(_COUNTS[selector], left)
    visited = np.zeros(n, bool)
    at, until = start.copy(), end
    while len(at):
        visited[at] = True
        at = at + take[at]
        more = at < until
        at, until = at[more], until[more]
    place = np.flatnonzero(visited)
    own, got = selector[place], take[place]
    used = np.where(own == 0, 2, 1)
    word_at = np.cumsum(used) - used
    out = np.zeros(int(used.sum()), np.uint64)
    shift = (here - np.repeat(place.astype(np.int32), got)) * np.repeat(_BITS[own], got) + 4
    raw = place[own == 0]
    shift[raw] = 0
    moved = v << shift.astype(np.uint64)
    moved[raw] = 0
    out[word_at] = np.bitwise_or.reduceat(moved, place) | own
    out[word_at[own == 0] + 1] = v[raw]
    index = np.cumsum(visited) - 1
    block_at = np.append(word_at[index[start]], len(out))
    doc_at = block_at[np.concatenate([[0], np.cumsum(n_blocks)])]
    return out, doc_at, block_at


def unpack(words: np.ndarray, n: int, block_at: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of a list from its words and the first word of each of its blocks."""
    if not n:
        return np.zeros(0, np.uint64)
    words = words.astype(np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    live = np.flatnonzero(~raw)
    selector = selector[live]
    counts = np.array([c for c, _ in SELECTORS])[selector]
    of_block = np.searchsorted(block_at, live, "right") - 1
    before = np.cumsum(counts) - counts
    first = np.searchsorted(live, block_at)
    offset = of_block * block + before - before[first[of_block]]
    limit = np.minimum((of_block + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        count, bits = SELECTORS[s]
        rows = np.flatnonzero(selector == s)
        if s == 0:
            out[offset[rows]] = words[live[rows] + 1]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for j in range(count):
                some = rows[offset[rows] + j < limit[rows]]
                out[offset[some] + j] = (words[live[some]] >> np.uint64(4 + j * bits)) & mask
    return out


def _ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of the ids of each word, and these ids."""
    e = bpe.encoder(path)
    cut = e.encode_single_token("\n")
    start, size, flat, total = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32), [np.zeros(0, np.int32)], 0
    plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(plain)
    for some in (rows[a : a + CALL] for a in range(0, len(rows), CALL)):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), words.take(pa.array(some))), "\n")
        ids = np.array(e.encode_ordinary(joined[0].as_py()), np.int32)
        end = np.append(np.flatnonzero(ids == cut), len(ids))
        start[some] = total + np.concatenate([[0], end[:-1] + 1])
        size[some] = total + end - start[some]
        flat.append(ids)
        total += len(ids)
    for i in np.flatnonzero(~plain).tolist():
        ids = np.array(e.encode_ordinary(words[i].as_py()), np.int32)
        start[i], size[i] = total, len(ids)
        flat.append(ids)
        total += len(ids)
    return start, size, np.concatenate(flat)


def _packed(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in common.parts(whole.column(1), SHARED)):
            words = batch.column(1).flatten().dictionary_encode()
            start, size, flat = _ids(words.dictionary, path)
            codes, at = words.indices.to_numpy(), 0
            for part in (batch.slice(a, b - a) for a, b in common.parts(batch.column(1), bpe.PART)):
                lists = part.column(1)
                n_words = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                code = codes[at : at + n_words[-1]]
                at += len(code)
                sizes = size[code]
                ids = bpe.lay_out(start[code], sizes, flat)
                per_doc = np.diff(np.concatenate([[0], np.cumsum(sizes)])[n_words])
                packed, doc_at, block_at = pack(ids, per_doc, block)
                n_blocks = -(-per_doc // block)
                own = block_at[:-1] - np.repeat(doc_at[:-1], n_blocks)
                blocks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_blocks)]).astype(np.int32)), pa.array(own.astype(np.int32)))
                data = pa.Array.from_buffers(pa.binary(), len(per_doc), [None, pa.py_buffer((doc_at * 8).astype(np.int32).tobytes()), pa.py_buffer(packed)])
                none = pc.is_null(lists)
                null = lambda x, none=none: pc.if_else(none, pa.scalar(None, x.type), x)
                yield pa.RecordBatch.from_arrays([part.column(0), null(pa.array(per_doc.astype(np.int64))), null(data), null(blocks)], ["doc_id", "n_ids", "packed", "block_at"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = bpe.VOCABULARY, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_ids, packed, block_at)`` of every document; words are little-endian, block starts count words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), bpe.split_words(text_col).alias("words"))
    return rows.mapInArrow(_packed(path, block), "doc_id long, n_ids long, packed binary, block_at array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
