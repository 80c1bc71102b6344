"""Edits between many pairs of strings at once, 64 cells of the table to a word (Myers; blocks as Hyyrö has them).

Block ``b`` of a pattern is at place ``t - b`` of the text in step ``t``, so that all blocks of all pairs work at once and
take what the block before handed on a step ago. Long patterns, of which there are few, are single large integers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafwork.operators.arrow import parts, within

WORDS = 4096
LONG = 1280
_ONE = np.uint64(1)


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)


def _together(long: list[str], short: list[str]) -> np.ndarray:
    """Edits of pairs of strings that aren't empty; those of ``long`` are the patterns, of as many blocks; those of ``short`` get longer."""
    m, n = (np.array([len(x) for x in side], np.int64) for side in (long, short))
    pairs, blocks, steps = len(m), int(-(-m.max() // 64)), int(n.max())
    pattern, text = _codes(long, blocks * 64), _codes(short, steps)
    seen = np.zeros(max(int(pattern.max()), int(text.max())) + 1, bool)
    seen[pattern] = seen[text] = True
    code = np.cumsum(seen) - 1
    kinds = int(code[-1]) + 2
    pattern, text = code[pattern].reshape(pairs, blocks, 64), np.ascontiguousarray(code[text].T)
    # the padding of patterns gets a kind that no text has
    pattern = np.where(np.arange(blocks * 64).reshape(1, blocks, 64) < m[:, None, None], pattern, kinds - 1)
    base = (np.arange(blocks)[:, None] * pairs + np.arange(pairs)) * kinds
    same = np.zeros(blocks * pairs * kinds, np.uint64)
    for i in range(64):
        same[base + pattern[:, :, i].T] |= _ONE << np.uint64(i)
    up, down = np.full((blocks, pairs), ~np.uint64(0)), np.zeros((blocks, pairs), np.uint64)
    more, less = np.zeros((blocks + 1, pairs), np.uint64), np.zeros((blocks + 1, pairs), np.uint64)
    more[0] = 1  # the first row of the table counts up
    foot, bit = blocks - 1, ((m - 1) % 64).astype(np.uint64)
    found = m.copy()
    for t in range(steps + blocks - 1):
        lo, hi = max(0, t - steps + 1), min(blocks, t + 1)
        eq = same.take(base[lo:hi] + text[t - hi + 1 : t - lo + 1][::-1])
        pv, mv, hp, hm = up[lo:hi], down[lo:hi], more[lo:hi].copy(), less[lo:hi].copy()
        xv = eq | mv
        eq |= hm
        xh = eq & pv
        xh += pv
        xh ^= pv
        xh |= eq
        ph = xh | pv
        np.invert(ph, out=ph)
        ph |= mv
        mh = pv & xh
        if hi == blocks:
            # the pairs that haven't ended stand last, as they are sorted by their texts
            on = int(np.searchsorted(n, t - foot, "right"))
            found[on:] += ((ph[-1, on:] >> bit[on:]) & _ONE).view(np.int64)
            found[on:] -= ((mh[-1, on:] >> bit[on:]) & _ONE).view(np.int64)
        np.right_shift(ph, 63, out=more[lo + 1 : hi + 1])
        np.right_shift(mh, 63, out=less[lo + 1 : hi + 1])
        ph <<= _ONE
        ph |= hp
        mh <<= _ONE
        mh |= hm
        np.bitwise_or(xv, ph, out=pv)
        np.invert(pv, out=pv)
        pv |= mh
        np.bitwise_and(ph, xv, out=mv)
    return found


def _alone(long: str, short: str) -> int:
    """Edits of one pair; what the last column says in the end is the sum of its steps down."""
    same: dict[str, int] = {}
    for i, c in enumerate(long):
        same[c] = same.get(c, 0) | 1 << i
    mask = (1 << len(long)) - 1
    up, down = mask, 0
    for c in short:
        eq = same.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | (xh | up) ^ mask) << 1 | 1
        up = ((up & xh) << 1 | (xv | ph) ^ mask) & mask
        down = ph & xv
    return len(short) + up.bit_count() - down.bit_count()


def _bounded(a: str, b: str, unlike: list[int]) -> int:
    """Edits of two strings of one length that differ in the places ``unlike``, which are no fewer: the furthest row of each
    diagonal by number of edits. A diagonal as far out as edits are left can't come back."""
    n, most = len(a), len(unlike)
    last = [*unlike, n]
    far = {0: last[0]}
    for e in range(1, most):
        now = {}
        for k in range(-min(e, most - e), min(e, most - e) + 1):
            i = max(far.get(k, -2) + 1, far.get(k - 1, -1), far.get(k + 1, -2) + 1)
            if i < 0:
                continue
            i = min(i, n, n - k)
            if k == 0:
                i = last[bisect_left(last, i)]
                if i >= n:
                    return e
            else:
                j = i + k
                while i < n and j < n and a[i] == b[j]:
                    i += 1
                    j += 1
            now[k] = i
        far = now
    return most


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between the strings of each pair, for pairs of any lengths."""
    out = np.zeros(len(a), np.int64)
    todo = []
    for i, (x, y) in enumerate(zip(a, b)):
        if not x or not y:
            out[i] = max(len(x), len(y))
        elif x != y:
            if len(x) == len(y):
                p, q = _codes([x, y], len(x))
                unlike = np.flatnonzero(p != q)
                if len(unlike) ** 2 <= 2 * len(x):
                    out[i] = _bounded(x, y, unlike.tolist())
                    continue
            todo.append(i)
    rows = np.array(todo, np.int64)
    long, short = ([f((a[i], b[i]), key=len) for i in todo] for f in (max, lambda p, key: min(reversed(p), key=key)))
    blocks, n = np.array([-(-len(x) // 64) for x in long], np.int64), np.array([len(x) for x in short], np.int64)
    alone = blocks * 64 > LONG
    for i in np.flatnonzero(alone).tolist():
        out[rows[i]] = _alone(long[i], short[i])
    for part in _alike(np.where(alone, 0, blocks), n):
        out[rows[part]] = _together([long[i] for i in part.tolist()], [short[i] for i in part.tolist()])
    return out


def _alike(blocks: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of as many blocks, with texts nearly as long, that are worked on together."""
    order = np.lexsort((n, blocks))
    for own in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        if len(own) and (size := int(blocks[own[0]])):
            yield from np.split(own, range(max(1, WORDS // size), len(own), max(1, WORDS // size)))


def _lines(batches: Iterable[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Rows of about ``most`` characters at once, with the lines of all their texts and the number of each."""
    for b in batches:
        for s in parts(pc.fill_null(pc.utf8_length(b["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64), most):
            part = b.slice(s.start, s.stop - s.start)
            texts = [[] if t is None else t.split("\n") for t in part["text"].to_pylist()]
            yield part, [x for t in texts for x in t], np.array([len(t) for t in texts], np.int64)


def next_line_scores(texts: DataFrame) -> DataFrame:
    """``(doc_id, i, millionths)``: likeness by edits of each line of a text and the one after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lines, n in _lines(batches):
            i, rows = within(n), np.repeat(np.arange(len(n)), n)
            here = np.flatnonzero(i + 1 < n[rows])
            x, y = ([lines[k] for k in at.tolist()] for at in (here, here + 1))
            most = np.maximum(*(np.array([len(t) for t in side], np.int64) for side in (x, y)))
            score = np.where(most == 0, 1_000_000, np.rint((1 - distances(x, y) / np.maximum(most, 1)) * 1_000_000)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows[here])), pa.array(i[here].astype(np.int32)), pa.array(score)], ["doc_id", "i", "millionths"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, i int, millionths long")


def likeness(texts: DataFrame, by: str, ways: dict[str, Callable[[str], str]]) -> DataFrame:
    """``(by, way, total, n)``: sums of the likeness by edits of each line and what each way makes of it, and their number, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lines, n in _lines(batches):
            made = [[f(x) for x in lines] for f in ways.values()]
            found = distances(lines * len(made), [x for side in made for x in side]).reshape(len(made), len(lines))
            size = np.array([len(x) for x in lines], np.int64)
            kinds, at = np.unique(["" if x is None else f"={x}" for x in b[by].to_pylist()], return_inverse=True)
            rows = np.repeat(at, n)
            for way, d, side in zip(ways, found, made):
                score = 1 - d / np.maximum(np.maximum(size, np.array([len(x) for x in side], np.int64)), 1)
                total, count = np.bincount(rows, score, len(kinds)), np.bincount(rows, minlength=len(kinds))
                ok = np.flatnonzero(count)
                names = [kinds[k][1:] if kinds[k] else None for k in ok]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([way] * len(ok), pa.string()), pa.array(total[ok], pa.float64()), pa.array(count[ok], pa.int64())], [by, "way", "total", "n"])

    return texts.select(by, "text").mapInArrow(run, f"{by} string, way string, total double, n long")
