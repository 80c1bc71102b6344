"""Near-duplicate groups by a chosen-path set similarity join over MinHash sketches (operator 6).

A document is the set of its word bigrams and is embedded as ``SKETCH`` MinHash values. In each of ``trees`` independent
trees a node picks every sketch position with probability 1/(threshold * SKETCH) and sends each of its documents to one
child per picked position, keyed by the value there: documents of Jaccard similarity s meet again in s/threshold children
on average. Nodes of one document end, small ones are compared exhaustively, and in the others documents whose mean
similarity to the node is near the threshold are compared with the whole node while the rest branch on.

The chance that a pair at the threshold is still together after some levels falls with their number, so trees are repeated
until it reaches ``RECALL`` for the levels that were really branched: documents of nodes that branch past ``first`` levels
get further trees, and what a task branches in its own nodes is repeated there to ``WITHIN``. (Acceptance by sketches comes
on top.)

Scale: the first levels are DataFrame steps over rows of (node, document) of 16 bytes; only nodes that several documents
share fetch sketches (256 bytes each). Common bigrams let unlike documents share single values, and the more of them the
larger the corpus, so that every node branches ``first`` levels before sizes count: unlike documents seldom share two. Nodes above ``split_rows`` branch in further distributed levels. Copies with equal
sketches are joined first and take part once, so that thousands of copies don't make a large node.

Edge cases: null or blank texts have no set and are never grouped; texts shorter than a bigram are compared as a whole;
rows whose id is null are never grouped; in ``near_groups``, whose rows are ids, rows that repeat an id count as the one with
the smallest sketch (``drop_near_duplicates`` tells their texts apart); the smallest id of a group is its keeper, so ties
can't occur; texts are read whole whatever their length; an empty table gives an empty result; other columns are not read by
``near_groups``, pass through ``drop_near_duplicates``, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwork.llm import common
from leafwork.operators.graph import components
from leafwork.session import cut

SKETCH = 128
THRESHOLD = 0.6
#: Sketch agreement has a standard deviation of 0.043 at the threshold; pairs are accepted from about one below it.
ACCEPT = 0.56
#: The chance that a pair at the threshold meets in some tree, at the least; and in the part of a tree within a task, once there.
RECALL = 0.99
WITHIN = 0.87
#: Levels that every node branches before the sizes of nodes are looked at.
FIRST = 2
SMALL = 48
SPLIT_ROWS = 100_000
_rng = np.random.default_rng(20_231)
_STEPS = np.array([(i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF for i in range(SKETCH)], np.uint64)
_A = (_rng.integers(0, 1 << 31, SKETCH) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, SKETCH).astype(np.uint32)


def trees_for(levels: int, recall: float = RECALL, below: float = 1.0) -> int:
    """Trees of ``levels`` levels in one of which a pair at the threshold meets with the chance ``recall``.

    ``below`` is the chance that it meets under a node of the last level. The children that a pair shares follow a Poisson
    distribution of mean 1.
    """
    q = below
    for _ in range(levels):
        q = 1 - np.exp(-q)
    return 1 if q >= recall else int(np.ceil(np.log1p(-recall) / np.log1p(-q)))


def sketch_matrix(texts: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """One row of ``SKETCH`` 16-bit MinHash values per text, and which texts have any shingle."""
    h, at = common.shingles(texts, width)
    has = np.diff(at) > 0
    out = np.zeros((len(has), SKETCH), np.uint16)
    if len(h):
        x = (h >> np.uint64(32)).astype(np.uint32)
        v, starts, rows = np.empty_like(x), at[:-1][has], np.flatnonzero(has)
        for i in range(SKETCH):
            np.multiply(x, _A[i], out=v)
            v += _B[i]
            out[rows, i] = (np.minimum.reduceat(v, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out, has


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in common.slices(batch.column(1)):
            m, has = sketch_matrix(batch.column(1).slice(a, b - a))
            ids = batch.column(0).slice(a, b - a).filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in m[has]], pa.binary())], ["doc_id", "sketch"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sketch)`` of every document with an id and at least one shingle."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return kept.mapInArrow(_sketches, "doc_id long, sketch binary")


def _children(keys: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child keys of documents that stand in nodes ``keys``; the node's key decides the positions."""
    row, key = [], []
    for i in range(SKETCH):
        with np.errstate(over="ignore"):
            draw = common.mix(keys + np.uint64((i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        picked = np.flatnonzero((draw >> np.uint64(11)).astype(np.float64) / (1 << 53) < 1 / (threshold * SKETCH))
        if len(picked):
            row.append(picked)
            key.append(common.mix(draw[picked] ^ (sketch[picked, i].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(row), np.concatenate(key)


def _children_of(key: int, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``_children``, where all documents stand in one node."""
    draw = common.mix(np.uint64(key) + _STEPS)
    picked = np.flatnonzero((draw >> np.uint64(11)).astype(np.float64) / (1 << 53) < 1 / (threshold * SKETCH))
    keys = common.mix((draw[picked] ^ (sketch[:, picked].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).T.ravel())
    return np.tile(np.arange(len(sketch)), len(picked)), keys


def _agreements(x: np.ndarray) -> np.ndarray:
    """For each row the places in which other rows have its value, summed over these, some columns at once."""
    n, out = len(x), np.zeros(len(x))
    step = max(1, (1 << 18) // n)
    for a in range(0, SKETCH, step):
        part = np.ascontiguousarray(x[:, a : a + step].T)
        order = np.argsort(part, axis=1, kind="stable")
        part = np.take_along_axis(part, order, 1)
        new = np.ones(part.shape, bool)
        new[:, 1:] = part[:, 1:] != part[:, :-1]
        size = np.diff(np.append(np.flatnonzero(new.ravel()), part.size))
        out += np.bincount(order.ravel(), np.repeat(size, size) - 1, n)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    b, _ = _bytes(column)
    return b.view(np.uint16).reshape(-1, SKETCH)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at


def _branch(threshold: float, trees: range, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column("doc_id").to_numpy(), _matrix(batch.column("sketch"))
            if "node" in batch.schema.names:
                roots = [batch.column("node").to_numpy().view(np.uint64)]
            else:
                roots = [np.full(len(ids), common.mix(np.array([t + 1], np.uint64))[0]) for t in trees]
            for key in roots:
                rows = np.arange(len(ids))
                for _ in range(levels):
                    row, key = _children(key, m[rows], threshold)
                    rows = rows[row]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[rows])], ["node", "doc_id"])

    return run


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        r = self.find(i)
        for j in others.tolist():
            q = self.find(j)
            if q != r:
                self.up[q] = r


def _compare(m: np.ndarray, least: int, threshold: float, key: int, small: int, depth: int, rows: np.ndarray, sets: _Sets) -> int:
    """Join what is alike in a node; the number of levels that were branched below it."""
    n = len(rows)
    if n < 2:
        return 0
    x = m[rows]
    if n <= small:
        for i in range(n - 1):
            same = np.flatnonzero((x[i + 1 :] == x[i]).sum(1) >= least)
            if len(same):
                sets.join(rows[i], rows[i + 1 + same])
        return 0
    dense = _agreements(x) / SKETCH / (n - 1) >= 0.9 * threshold if depth < 24 else np.ones(n, bool)
    loose, waiting = np.flatnonzero(~dense), set(np.flatnonzero(dense).tolist())
    while waiting:
        queue = [waiting.pop()]
        while queue:
            p = queue.pop()
            among = np.concatenate([loose, np.fromiter(waiting, np.int64, len(waiting))])
            near = among[(x[among] == x[p]).sum(1) >= least]
            sets.join(rows[p], rows[near])
            fresh = waiting.intersection(near.tolist())
            waiting -= fresh
            queue.extend(fresh)
    if len(loose) < 2:
        return 0
    # nodes below the first are repeated with it
    levels, done = 1, 0
    while done < (1 if depth > 1 else trees_for(levels, WITHIN)):
        own = key if not done else common.mix(np.array([key + done * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
        row, keys = _children_of(own, x[loose], threshold)
        order = np.argsort(keys, kind="stable")
        row, keys = row[order], keys[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a > 1:
                levels = max(levels, 1 + _compare(m, least, threshold, int(keys[a]), small, depth + 1, rows[loose[row[a:b]]], sets))
        done += 1
    return levels


def node_edges(ids: np.ndarray, m: np.ndarray, key: int, threshold: float, accept: float, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest id of every set of connected documents of a node to the others."""
    sets = _Sets(len(ids))
    _compare(m, int(np.ceil(accept * SKETCH)), threshold, int(key), small, 1, np.arange(len(ids)), sets)
    root = np.array([sets.find(i) for i in range(len(ids))])
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    keep = low[root] != ids
    return low[root][keep], ids[keep]


def _leaf(threshold: float, accept: float, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def done() -> pa.RecordBatch:
            ids, m = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            a, b = node_edges(ids, m, last, threshold, accept, small)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            out: list[pa.RecordBatch] = []
            for s, e in zip(edge[:-1], edge[1:]):
                if last is not None and node[s].view(np.uint64) != last:
                    out.append(done())
                    held = []
                last = node[s].view(np.uint64)
                held.append((ids[s:e], m[s:e]))
            if out:
                table = pa.Table.from_batches(out).combine_chunks()
                yield from table.to_batches()
        if held:
            yield done()

    return run


def near_pairs(sketch: DataFrame, threshold: float = THRESHOLD, accept: float = ACCEPT, recall: float = RECALL, first: int = FIRST, small: int = SMALL, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges ``(a, b)``, a < b, that connect every group of documents found to be similar."""
    one = sketch.groupBy("doc_id").agg(F.min("sketch").alias("sketch"))
    keyed = cut(one.withColumn("k1", F.xxhash64("sketch")).withColumn("k2", F.xxhash64("sketch", F.lit(7))))
    low = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"))
    copies = keyed.select("doc_id", "k1", "k2").join(low, ["k1", "k2"]).where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    firsts = keyed.join(low.select(F.col("low").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "sketch")
    count = F.count("*").over(Window.partitionBy("node"))
    leaves, own, done, levels = [], firsts, 0, first
    while done < (trees := trees_for(levels, recall, WITHIN)):
        front, deep, level = own.mapInArrow(_branch(threshold, range(done, trees), first), "node long, doc_id long"), [], 0
        while True:
            level += 1
            sized = cut(front.withColumn("n", count).where("n > 1"))
            leaves.append(sized.where(F.col("n") <= split_rows) if level < 12 else sized)
            big = sized.where(F.col("n") > split_rows).select("node", "doc_id")
            if level >= 12 or big.isEmpty():
                break
            deep.append(big.select("doc_id"))
            front = big.join(firsts, "doc_id").select("node", "doc_id", "sketch").mapInArrow(_branch(threshold, range(0), 1), "node long, doc_id long")
        done = trees
        if not deep:
            break
        # pairs that were parted past the first levels were both in a node that branched there
        levels = max(levels, first + len(deep))
        seen = deep[0]
        for d in deep[1:]:
            seen = seen.unionByName(d)
        own = own.join(seen.distinct(), "doc_id", "left_semi")
    members = leaves[0]
    for x in leaves[1:]:
        members = members.unionByName(x)
    members = members.select("node", "doc_id").join(firsts, "doc_id").select("node", "doc_id", "sketch")
    edges = members.repartition("node").sortWithinPartitions("node").mapInArrow(_leaf(threshold, accept, small), "a long, b long")
    return edges.unionByName(copies).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(doc_id, keeper_id)``: every document that has a near copy of a smaller id, with the smallest of its group."""
    found = components(near_pairs(sketches(docs, id_col, text_col), **how))
    return found.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("keeper_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group; columns as they were.

    Where an id has several texts, each counts as a document of its own, which stays only if its group has no document with
    an id to itself; of rows with equal id and text the one stays whose other columns come first as JSON.
    """
    again, several, key, gone, row = common.fresh("again", "several", "key", "gone", "row")
    own = F.col(id_col).cast("long")
    repeated = cut(docs.where(own.isNotNull()).groupBy(own.alias(again)).count().where("count > 1").select(again))
    if repeated.isEmpty():
        found = near_groups(docs, id_col, text_col, **how).select(F.col("doc_id").alias(gone))
        return docs.join(found, own == F.col(gone), "left_anti")
    texts = docs.select(own.alias(again), F.xxhash64(text_col).alias(key)).join(repeated, again, "left_semi")
    repeated = cut(texts.groupBy(again).agg((F.min(key) < F.max(key)).alias(several)))
    # ids from 2^62 up stand for the texts of ids that have several
    stand_in = F.shiftrightunsigned(F.xxhash64(own, F.col(text_col)), 2).bitwiseOR(F.lit(1 << 62))
    keyed = docs.join(repeated, own == F.col(again), "left").withColumn(key, F.when(F.col(several), stand_in).otherwise(own))
    found = near_groups(keyed, key, text_col, **how).select(F.col("doc_id").alias(gone))
    kept = keyed.join(found, F.col(key) == F.col(gone), "left_anti")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    order = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text_col]))
    first = kept.where(F.col(again).isNotNull()).groupBy(key).agg(F.min_by(whole, order).alias(row)).select(f"{row}.*")
    return kept.where(F.col(again).isNull()).select(*docs.columns).unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
