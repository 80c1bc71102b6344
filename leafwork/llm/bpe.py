"""BPE encoding and decoding through a table of distinct words (operator 9).

Spark splits texts into the tokenizer's words, counts the distinct ones, and has the most frequent encoded once. The ids then
join back by position: every batch of documents looks its own distinct words up, encodes those that the table lacks, and lays
the ids out in the order of the text. Decoding joins ids to pieces and concatenates those of each document.

Scale: only distinct words of each task are shuffled, and documents never leave their partition. The table takes at most
``broadcast_bytes`` (a hash, two offsets, the word and its ids), whatever the vocabulary, so that the driver and the workers
hold no more of it as the text grows; words that occur once are never in it. A word is found by its hash and then compared, so
that equal hashes do no harm. The rest costs time only: a word outside the table is encoded once a batch.

Edge cases: a null text has null ids, an empty one has none; a null id is kept; repeated rows get equal results; special
tokens in a text are ordinary text; texts are encoded whole; an empty table gives an empty result; other columns are not
read. Any text decodes to itself; ids without a piece give nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import common
from leafwork.session import cut

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = f"{common.TOKENIZERS}/byte_bpe_50k.tiktoken"
#: The table's size at the most, where a word counts with as many ids as bytes.
BROADCAST_BYTES = 32 << 20
#: Words or ids that are worked on together.
PART = 1 << 18


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=common.ranks(path), special_tokens={})


@functools.cache
def pieces(path: str) -> pa.Array:
    """Pieces by id; ids that the file lacks have an empty one."""
    ranks = common.ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return pa.array(out, pa.binary())


def split_words(text: str) -> F.Column:
    """The tokenizer's words of a text column, in order; together they are the text."""
    return F.regexp_extract_all(F.col(text), F.lit(f"(?U){PATTERN}"), F.lit(0))


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = [e.encode_ordinary(w) for w in words]
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes.view(np.int64)), pa.array(ids, pa.list_(pa.int32()))], ["word", "hash", "ids"])

    return run


def word_table(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(word, hash, ids)`` of the most frequent distinct words, as many as take ``broadcast_bytes``.

    Words enter by levels of their count, 16 to a doubling, each level whole or not at all.
    """
    counts = docs.select(F.explode(split_words(text_col)).alias("word")).groupBy("word").count().where("count > 1")
    counts = cut(counts.select("word", F.floor(F.log2("count") * 16).cast("int").alias("level")))
    sizes = counts.groupBy("level").agg(F.sum(16 + 5 * F.octet_length("word"))).collect()
    least, total = None, 0
    for level, size in sorted(map(tuple, sizes), reverse=True):
        total += size
        if total > broadcast_bytes:
            break
        least = level
    held = counts.where(F.lit(False) if least is None else F.col("level") >= least)
    return held.select("word").mapInArrow(_encode_words(path), "word string, hash long, ids array<int>")


def lay_out(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """``flat[start:start + size]`` of every item, one after the other."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    place = np.repeat((start - (end - size)).astype(kind), size)
    place += np.arange(total, dtype=kind)
    return flat[place]


def compact(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Hashes in order, their words, where the ids of each begin, and all ids."""
    table = table.combine_chunks()
    hashes, words, lists = (table.column(c).combine_chunks() for c in ("hash", "word", "ids"))
    hashes = hashes.to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    start, size = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    flat = lay_out(start[order].astype(np.int64), size[order], lists.values.to_numpy())
    return hashes[order], words.take(pa.array(order)), np.concatenate([[0], np.cumsum(size[order])]).astype(np.int32), flat


def ids_of(words: pa.Array, table: tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of the ids of each word, and these ids: from the compact table, or encoded here."""
    hashes, known, at, flat = table
    texts = words.to_pylist()
    row, held = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    if len(hashes):
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in texts], np.uint64)
        row = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        held = pc.equal(known.take(pa.array(row)), words).to_numpy(zero_copy_only=False)
    row, e = row[held], encoder(path)
    rest = [e.encode_ordinary(texts[i]) for i in np.flatnonzero(~held).tolist()]
    size, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    size[held] = np.diff(at)[row]
    size[~held] = [len(x) for x in rest]
    taken = lay_out(at[row].astype(np.int64), size[held], flat)
    start[held] = np.cumsum(size[held]) - size[held]
    start[~held] = len(taken) + np.cumsum(size[~held]) - size[~held]
    return start, size, np.concatenate([taken, np.fromiter(chain.from_iterable(rest), np.int32)])


def _by_position(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in common.parts(whole.column(1), PART)):
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            start, size, flat = ids_of(words.dictionary, shared.value, path)
            code = words.indices.to_numpy()
            n_words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lay_out(start[code], size[code], flat)
            per_doc = np.concatenate([[0], np.cumsum(size[code])])[np.concatenate([[0], np.cumsum(n_words)])]
            ids = pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), pa.array(ids.astype(np.int32)))
            none = pc.is_null(lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(none, pa.scalar(None, ids.type), ids)], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, ids)`` of every document."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(compact(word_table(docs, text_col, path, broadcast_bytes).toArrow()))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), split_words(text_col).alias("words"))
    return words.mapInArrow(_by_position(shared, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids, text)``: the ids of each document joined to their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in common.parts(whole.column(1), PART)):
            lists = batch.column(1)
            flat = lists.flatten()
            known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, pa.scalar(None, pa.int32()))
            taken = pc.fill_null(table.take(known), b"")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(at, taken), b"")
            try:
                text = joined.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([x.decode(errors="replace") for x in joined.to_pylist()], pa.string())
            text = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, text], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs)).withColumn("n_ids", F.size("ids"))
