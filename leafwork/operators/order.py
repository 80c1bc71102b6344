"""Page-local operators that are recursive or work on grids: gutters, XY-cut, line grouping by running mean.

Each takes whole pages in Arrow batches (gutters one page at a time); one shuffle by document serves them all. Ties follow
``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.operators.arrow import spread, starts, whole, within

BOXES = ["x0", "y0", "x1", "y1"]


def find_gutters(boxes: np.ndarray, width: float, height: float, most_ink: float = 0.04, min_gap: float = 10.0) -> list[float]:
    """Column boundaries of a page: the first inked place, middles of its gutters, and the end of the last column."""
    if not len(boxes):
        return [0.0, width]
    line = float(np.median(boxes[:, 3] - boxes[:, 1]))
    span = max(boxes[:, 2].max() - boxes[:, 0].min(), 1.0)

    def narrowed(b: np.ndarray, keep: np.ndarray) -> np.ndarray:
        return b[keep] if keep.any() else b

    b = narrowed(boxes, boxes[:, 2] - boxes[:, 0] <= 0.92 * span)
    for lo, hi in ((0, 2), (1, 3)):
        if len(b) >= 5:
            size = b[:, hi] - b[:, lo]
            b = narrowed(b, size <= 1.25 * np.percentile(size, 90))
    ink = np.zeros((int(height / 4) + 1, int(width / 2) + 1), bool)
    _paint(ink, b)
    rows = np.flatnonzero(ink.any(1))
    if not len(rows):
        return [0.0, width]
    body = ink[rows[0] : rows[-1] + 1]
    columns = np.flatnonzero(body.any(0))
    first, last = columns[0], columns[-1]
    blank = body.mean(0) <= most_ink
    need = max(2, round(1.8 * max(1, round(line / 4))))

    def stacked(part: np.ndarray) -> bool:
        filled = part.any(1) if part.size else np.zeros(0, bool)
        run = best = 0
        for x in filled.tolist():
            run = run + 1 if x else 0
            best = max(best, run)
        return best >= need

    cuts, i = [], int(first)
    while i <= last:
        if not blank[i]:
            i += 1
            continue
        j = i
        while j <= last and blank[j]:
            j += 1
        if (j - i) * 2 >= min_gap and stacked(body[:, first:i]) and stacked(body[:, j : last + 1]):
            cuts.append((i + j) / 2 * 2.0)
        i = j
    return [first * 2.0, *cuts, last * 2.0 + 2]


def _paint(ink: np.ndarray, b: np.ndarray) -> None:
    """Ink where boxes are, in cells of 4 by 2 points; boxes of the same rows at once, if these share none with others."""
    if np.isfinite(b).all() and b.min() >= 0 and (b[:, 2] >= b[:, 0]).all() and (b[:, 3] >= b[:, 1]).all():
        left, right = (b[:, 0] / 2).astype(np.int64), (b[:, 2] / 2).astype(np.int64) + 1
        bands, own = np.unique((b[:, 1] / 4).astype(np.int64) * (1 << 31) + (b[:, 3] / 4).astype(np.int64) + 1, return_inverse=True)
        top, foot = bands >> 31, bands & ((1 << 31) - 1)
        if (top[1:] >= foot[:-1]).all():
            edges = np.zeros((len(bands), ink.shape[1] + 1), np.int64)
            np.add.at(edges, (own, np.minimum(left, ink.shape[1])), 1)
            np.add.at(edges, (own, np.minimum(right, ink.shape[1])), -1)
            rows = np.repeat(top, foot - top) + within(foot - top)
            on = rows < len(ink)
            ink[rows[on]] = (np.cumsum(edges[:, :-1], 1) > 0)[np.repeat(np.arange(len(bands)), foot - top)[on]]
            return
    for x0, y0, x1, y1 in b:
        ink[max(0, int(y0 / 4)) : int(y1 / 4) + 1, max(0, int(x0 / 2)) : int(x1 / 2) + 1] = True


def gutters(spans: DataFrame, width: float = 595.0, height: float = 842.0, together: bool = False) -> DataFrame:
    """``(doc_id, page, boundaries)`` from spans with boxes; ``together`` as for ``span_lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pages in whole(batches, ["doc_id", "page"]):
            boxes = np.stack([b[c].cast("float64").to_numpy(zero_copy_only=False) for c in BOXES], 1)
            found = [find_gutters(boxes[i:j], width, height) for i, j in zip(pages.tolist(), pages[1:].tolist())]
            at = pa.array(pages[:-1])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["page"].take(at), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "page", "boundaries"])

    s = spans.select("doc_id", "page", "seq", *BOXES)
    return (s if together else _together(s)).mapInArrow(run, "doc_id long, page int, boundaries array<double>")


def cut_order(boxes: np.ndarray, rtl: bool = False, gap: float = 14.0, deepest: int = 12) -> list[int]:
    """Reading order by recursive cuts: side by side first, then one above the other, then by line and place."""

    def groups(rows: list[int], lo: int, hi: int) -> list[list[int]]:
        out: list[list[int]] = []
        reach = None
        for i in sorted(rows, key=lambda r: boxes[r, lo]):
            if reach is None or boxes[i, lo] - reach >= gap:
                out.append([])
            out[-1].append(i)
            reach = boxes[i, hi] if reach is None else max(reach, boxes[i, hi])
        return out

    def walk(rows: list[int], depth: int) -> list[int]:
        if len(rows) <= 1 or depth > deepest:
            return rows
        for lo, hi in ((0, 2), (1, 3)):
            parts = groups(rows, lo, hi)
            if len(parts) > 1:
                if lo == 1:
                    parts.sort(key=lambda p: min(boxes[r, 1] for r in p))
                elif rtl:
                    parts.sort(key=lambda p: -max(boxes[r, 2] for r in p))
                else:
                    parts.sort(key=lambda p: min(boxes[r, 0] for r in p))
                return [r for p in parts for r in walk(p, depth + 1)]
        return sorted(rows, key=lambda r: (round(boxes[r, 1] / 6), -boxes[r, 2] if rtl else boxes[r, 0]))

    return walk(list(range(len(boxes))), 0)


def xy_cut(regions: DataFrame, rtl: bool = False) -> DataFrame:
    """``(doc_id, page, seq, place)``: each region's place in reading order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regions = b["regions"].flatten()
            pages = starts(pc.list_value_length(b["regions"]).to_numpy(zero_copy_only=False))
            boxes = np.stack([regions.field(c).cast("float64").to_numpy(zero_copy_only=False) for c in BOXES], 1).tolist()
            place = [np.array(_cut(boxes[i:j], rtl), np.int64) + i for i, j in zip(pages.tolist(), pages[1:].tolist())]
            rows = np.repeat(np.arange(b.num_rows), np.diff(pages))
            seq = regions.field("seq").cast("int64").take(pa.array(np.concatenate(place) if place else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows)), b["page"].take(pa.array(rows)), seq, pa.array(within(np.diff(pages)))], ["doc_id", "page", "seq", "place"])

    pages = regions.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("seq", *BOXES))).alias("regions"))
    return pages.mapInArrow(run, "doc_id long, page int, seq long, place long")


def _cut(boxes: list[list[float]], rtl: bool) -> list[int]:
    return [0] if len(boxes) == 1 else cut_order(np.array(boxes, float).reshape(-1, 4), rtl)


def group_lines(y: np.ndarray, size: np.ndarray, factor: float = 0.5) -> np.ndarray:
    """Line number of each span: by rising centre, into the line whose running mean is near enough, else a new one."""
    out = np.zeros(len(y), np.int64)
    mean = most = 0.0
    n, line = 0, -1
    for i in np.argsort(y, kind="stable"):
        if n and abs(y[i] - mean) <= max(factor * min(most, size[i]), 1.0):
            n += 1
            mean += (y[i] - mean) / n
            most = max(most, size[i])
        else:
            line, n, mean, most = line + 1, 1, float(y[i]), float(size[i])
        out[i] = line
    return out


def _lines_of(y: np.ndarray, size: np.ndarray, pages: np.ndarray, factor: float) -> np.ndarray:
    """``group_lines`` of each page, whose spans begin at ``pages``.

    Spans of one centre stay on one line, and as long as each further centre is too far from the one before, lines are centres.
    Only pages where one isn't are gone through span by span.
    """
    n = np.diff(pages)
    page = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((y, page))
    v, s, p = y[by], size[by], page[by]
    first = np.ones(len(v), bool)
    first[1:] = p[1:] != p[:-1]
    new = first.copy()
    new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    largest = np.maximum.reduceat(s, at)
    near = np.zeros(len(at), bool)
    near[1:] = ~first[at[1:]] & ~(np.diff(v[at]) > np.maximum(factor * np.minimum(largest[:-1], s[at[1:]]), 1.0))
    out = np.empty(len(v), np.int64)
    line = np.cumsum(new) - 1
    out[by] = line - line[pages[:-1]][p]
    for k in np.unique(p[at[near]]).tolist():
        a, b = pages[k], pages[k + 1]
        out[a:b] = group_lines(y[a:b], size[a:b], factor)
    return out


def span_lines(spans: DataFrame, factor: float = 0.5, together: bool = False) -> DataFrame:
    """``(doc_id, page, seq, line_no)`` by vertical centres of spans.

    ``together``: the spans of a page already stand together in order of ``seq``; else they are brought there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pages in whole(batches, ["doc_id", "page"]):
            y0, y1, size = (b[c].cast("float64").to_numpy(zero_copy_only=False) for c in ("y0", "y1", "size"))
            lines = _lines_of((y0 + y1) / 2, size, pages, factor)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["page"], b["seq"].cast("int64"), pa.array(lines)], ["doc_id", "page", "seq", "line_no"])

    s = spans.select("doc_id", "page", "seq", "y0", "y1", "size")
    return (s if together else _together(s)).mapInArrow(run, "doc_id long, page int, seq long, line_no long")


def _together(spans: DataFrame) -> DataFrame:
    return spread(spans, "doc_id").sortWithinPartitions("doc_id", "page", "seq")
