"""Table detectors: stacks of guards over one page's spans, run a page at a time in Arrow batches.

A span is a row with text, box and ``seq``; rules and panels are boxes. Detectors give tables as a box, column bounds, row
bounds and a grid of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.operators.arrow import starts
from leafwork.operators.order import group_lines

SHORT = 18
_NUMERIC = re.compile(r"[-—–+,.()%¥£€$٠-٩۰-۹0-9\s]+")
_SECTION = re.compile(r"^(table|figure)\s+\d", re.I)


@dataclass
class Table:
    columns: list[float]
    rows: list[float]
    score: float
    grid: list[list[str]]
    #: the same with the numbers of the spans
    cells: list[list[list[int]]]


def is_numeric(text: str) -> bool:
    t = text.strip()
    return bool(t and _NUMERIC.fullmatch(t) and (t in "$€£¥%—–-" or any(c.isdigit() for c in t)))


def vote(edges: np.ndarray, tol: float) -> list[np.ndarray]:
    """Clusters of sorted places: a gap of more than ``tol`` from the last one starts a new cluster. Gives row numbers."""
    if not len(edges):
        return []
    order = np.argsort(edges, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(edges[order]) > tol) + 1)


class Spans:
    """A page's spans in order of ``seq``, as arrays."""

    def __init__(self, text: list[str], box: np.ndarray):
        self.text, self.box = [str(t) for t in text], box
        self.x0, self.y0, self.x1, self.y1 = box.T if len(box) else np.zeros((4, 0))

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Spans:
        order = np.argsort(pdf["seq"].to_numpy(), kind="stable")
        return cls(pdf["text"].to_numpy()[order].tolist(), pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)[order])

    def __len__(self) -> int:
        return len(self.text)

    def take(self, rows: np.ndarray) -> Spans:
        return Spans([self.text[i] for i in rows.tolist()], self.box[rows])


def _lines(s: Spans) -> np.ndarray:
    return group_lines((s.y0 + s.y1) / 2, s.y1 - s.y0)


def _edge(s: Spans, mode: str) -> np.ndarray:
    return {"r": s.x1, "l": s.x0, "c": (s.x0 + s.x1) / 2}[mode]


def _bands(s: Spans, line: np.ndarray, tabular: list[int]) -> list[list[int]]:
    """Successive tabular lines; more than three lines, or a section's head, between two part them."""
    out: list[list[int]] = []
    for n in tabular:
        if out:
            between = range(out[-1][-1] + 1, n)
            heads = [" ".join(s.text[i] for i in np.flatnonzero(line == b)) for b in between]
            broken = any((h.rstrip().endswith(":") and len(h.split()) >= 6) or _SECTION.match(h) for h in heads)
            if n - out[-1][-1] <= 3 and not broken:
                out[-1].append(n)
                continue
        out.append([n])
    return out


def borderless(s: Spans, rules: np.ndarray, panels: np.ndarray, height: float, mode: str, tol: float = 6.0, min_rows: int = 3, min_cols: int = 3) -> list[Table]:
    """Tables whose columns line up by one edge (right, left or centre) without rules between all cells."""
    if not len(s):
        return []
    min_cols = 2 if len(rules) else min_cols
    line, edge, text = _lines(s), _edge(s, mode), [t.strip() for t in s.text]
    short = np.array([len(t) <= SHORT for t in text])
    if len(rules):
        content = max(s.x1.max() - s.x0.min(), 1.0)
        mid = (s.y0 + s.y1) / 2
        short |= (mid >= rules[:, 1].min()) & (mid <= rules[:, 3].max()) & (s.x1 - s.x0 <= 0.5 * content)
    voters = np.flatnonzero(short)
    if len(voters) < min_rows * min_cols:
        return []

    def columns(rows: np.ndarray) -> list[np.ndarray]:
        found = [rows[c] for c in vote(edge[rows], tol)]
        return [c for c in found if len(np.unique(line[c])) >= 3]

    whole = columns(voters)
    hits = {n: sum((line[c] == n).any() for c in whole) for n in np.unique(line)}
    out = []
    for band in _bands(s, line, [n for n in sorted(hits) if hits[n] >= min_cols]):
        if len(band) < min_rows:
            continue
        inside = np.flatnonzero((line >= band[0]) & (line <= band[-1]))
        top, foot = s.y0[inside].min(), s.y1[inside].max()
        bounds = np.concatenate([rules[:, [1, 3]].ravel(), panels[:, [1, 3]].ravel()]) if len(rules) or len(panels) else np.zeros(0)
        framed = bool(len(bounds) and (np.abs(bounds - top) <= 30).any() and ((np.abs(bounds - foot) <= 30).any() or height - foot <= 90))
        own = columns(np.intersect1d(voters, inside)) if framed else [np.intersect1d(c, inside) for c in whole]
        support = [len(np.unique(line[c])) for c in own]
        own = [c for c, n in zip(own, support) if n >= max(3, 0.4 * max(support))]
        if len(own) < min_cols:
            continue
        aligned = np.concatenate(own)
        if not framed and np.mean([is_numeric(text[i]) for i in aligned]) < 0.6:
            continue
        fill = len({(line[i], k) for k, c in enumerate(own) for i in c if line[i] in band}) / (len(band) * len(own))
        if fill < 0.5:
            continue
        own.sort(key=lambda c: edge[c].mean())
        low, high = [s.x0[c].min() for c in own], [s.x1[c].max() for c in own]
        left = s.x0[inside].min()
        splits = [left] + ([(left_end + low[0]) / 2] if (left_end := max([s.x1[i] for i in inside if s.x1[i] < low[0]], default=None)) is not None and low[0] - left_end > tol else [])
        splits += [(high[k] + low[k + 1]) / 2 for k in range(len(own) - 1)] + [s.x1[inside].max()]
        tops = [s.y0[line == n].min() for n in range(band[0], band[-1] + 1)]
        feet = [s.y1[line == n].max() for n in range(band[0], band[-1] + 1)]
        centres = [(a + b) / 2 for a, b in zip(tops, feet)]
        rows = [tops[0] - 2, *[(a + b) / 2 for a, b in zip(centres, centres[1:])], feet[-1] + 2]
        out.append(_table(s, inside, splits, rows, fill))
    return out


def _table(s: Spans, rows_of: np.ndarray, splits: list[float], rows: list[float], score: float) -> Table:
    cells = [[[int(rows_of[i]) for i in c] for c in row] for row in place(s.take(rows_of), splits, rows)]
    return Table(splits, rows, score, texts_of(s.text, cells), cells)


def texts_of(text: list[str], cells: list[list[list[int]]]) -> list[list[str]]:
    return [[text[c[0]] if len(c) == 1 else " ".join([text[i] for i in c]) for c in row] for row in cells]


def place(s: Spans, splits: list[float], rows: list[float]) -> list[list[list[int]]]:
    """Spans by cell of their centre, in reading order."""
    grid: list[list[list[int]]] = [[[] for _ in splits[1:]] for _ in rows[1:]]
    at = np.clip(np.searchsorted(rows, (s.y0 + s.y1) / 2, "right") - 1, 0, len(grid) - 1)
    to = np.clip(np.searchsorted(splits, (s.x0 + s.x1) / 2, "right") - 1, 0, len(splits) - 2)
    for r in np.lexsort((s.x0, s.y0)).tolist():
        grid[at[r]][to[r]].append(r)
    return grid


def best_borderless(s: Spans, rules: np.ndarray, panels: np.ndarray, height: float) -> list[Table]:
    """All three edges; of tables that overlap by more than 0.3 of either, the fullest stays."""
    found = sorted((t for m in "rlc" for t in borderless(s, rules, panels, height, m)), key=lambda t: -t.score)
    kept: list[Table] = []
    for t in found:
        span = t.rows[-1] - t.rows[0]
        shared = [max(0.0, min(t.rows[-1], k.rows[-1]) - max(t.rows[0], k.rows[0])) / max(min(span, k.rows[-1] - k.rows[0]), 1e-9) for k in kept]
        if all(x <= 0.3 for x in shared):
            kept.append(t)
    return sorted(kept, key=lambda t: t.rows[0])


def definitions(s: Spans, rules: np.ndarray, min_rows: int = 3, tol: float = 6.0) -> list[Table]:
    """Row-wrapped tables between rules: a key column starts rows, later lines of a row only continue its wide column."""
    groups: list[list[np.ndarray]] = []
    for r in rules[np.argsort(rules[:, 1], kind="stable")] if len(rules) else []:
        for g in groups:
            if abs(g[0][0] - r[0]) <= 3 and abs(g[0][2] - r[2]) <= 3:
                g.append(r)
                break
        else:
            groups.append([r])
    out = []
    for g in (g for g in groups if len(g) >= 2):
        x0, x1, top, foot = g[0][0], g[0][2], g[0][1], g[-1][3]
        held = np.flatnonzero((s.x0 >= x0 - 6) & (s.x1 <= x1 + 6) & (s.y0 >= top - 6) & (s.y1 <= foot + 6))
        own = s.take(held)
        if not len(own):
            continue
        line = _lines(own)
        by_place = np.lexsort((own.x0, line))
        first = by_place[np.concatenate([[True], np.diff(line[by_place]) != 0])]
        if len(first) < min_rows:
            continue
        keys = min((c for c in vote(own.x0[first], tol) if len(c) >= 2), key=lambda c: own.x0[first][c].mean(), default=None)
        if keys is None:
            continue
        lead = first[np.sort(keys)]
        starts = sorted(set(line[lead].tolist()))
        names = [own.text[i].strip() for i in lead]
        commonest = max(set(names), key=names.count)
        if len(starts) < min_rows or (names.count(commonest) > 1 and len(commonest) <= 2 and not commonest.isalnum()):
            continue
        others = np.flatnonzero(own.x0 > own.x1[lead].max())
        extra = [c for c in vote(own.x0[others], tol) if np.isin(line[others[c]], starts).sum() >= max(2, int(0.6 * len(starts)))]
        if not extra:
            continue
        places = sorted(float(own.x0[others[c]].mean()) for c in extra)
        last = int(line.max())
        ends = [*[b - 1 for b in starts[1:]], last]
        wrapped = np.mean([e > b for b, e in zip(starts, ends)])
        strayed = [own.x0[line == n].min() < places[-1] - 12 for b, e in zip(starts, ends) for n in range(b + 1, e + 1)]
        diverse = len(set(names)) / len(names)
        if (strayed and np.mean(strayed) > 0.15) or not wrapped or 0.7 * diverse + 0.3 * wrapped < 0.5:
            continue
        bounds = [x0, *[p - 2 for p in places], x1]
        rows = [own.y0[line == b].min() for b in starts] + [own.y1[line == last].max()]
        out.append(_table(s, held, bounds, rows, 0.7 * diverse + 0.3 * wrapped))
    return out


GRID = "doc_id long, page int, place int, score double, grid array<array<string>>"


#: pages whose tables are kept, by all that these depend on
KEPT = 1 << 14
_NONE = np.zeros((0, 4))


class Detector:
    """``best_borderless`` without rules. Pages with boxes as others before have the same tables, if their texts are as short and as
    numeric and none can part a table: only the texts of the cells are new."""

    def __init__(self, height: float):
        self.height, self.kept, self.kind = height, {}, lru_cache(1 << 16)(self._kind)

    @staticmethod
    def _kind(text: str) -> str:
        """All of a text that counts beside its box; nothing if the text itself counts."""
        t = text.strip()
        return "" if ":" in t or _SECTION.search(t) or t[:5].lower() in ("table", "figur") else ("1" if len(t) <= SHORT else "0") + ("n" if is_numeric(t) else "t")

    def grids(self, text: list[str], box: np.ndarray) -> list[tuple[float, list[list[str]]]]:
        # all three edges of a table need three lines with three columns, so nine voters
        kinds = [self.kind(t) for t in text]
        if sum(k[:1] != "0" for k in kinds) < 9:
            return []
        key = None if "" in kinds else (box.tobytes(), "".join(kinds))
        found = self.kept.get(key) if key else None
        if found is None:
            found = [(t.score, t.cells) for t in best_borderless(Spans(text, box), _NONE, _NONE, self.height)]
            if key and len(self.kept) < KEPT:
                self.kept[key] = found
        return [(score, texts_of(text, cells)) for score, cells in found]


def _spans(b: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Row, texts and boxes of each page of a batch of pages."""
    spans = b["spans"].flatten()
    ends = starts(pc.list_value_length(b["spans"]).to_numpy(zero_copy_only=False)).tolist()
    text = [str(t) for t in spans.field("text").to_pylist()]
    box = np.stack([spans.field(c).cast("float64").to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], 1)
    for i, (a, z) in enumerate(zip(ends, ends[1:])):
        yield i, text[a:z], box[a:z]


def _batch(b: pa.RecordBatch, found: list[tuple[int, int, float, list[list[str]]]]) -> pa.RecordBatch:
    rows, place_, score, grid = zip(*found) if found else ((), (), (), ())
    at = pa.array(rows, pa.int64())
    kinds = (pa.int32(), pa.float64(), pa.list_(pa.list_(pa.string())))
    return pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["page"].take(at), *[pa.array(x, k) for x, k in zip((place_, score, grid), kinds)]], ["doc_id", "page", "place", "score", "grid"])


def _pages(spans: DataFrame, *columns: str) -> DataFrame:
    return spans.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("spans"))


def borderless_tables(spans: DataFrame, height: float = 842.0) -> DataFrame:
    """``(doc_id, page, place, score, grid)`` of every table that is found from spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(height)
        for b in batches:
            yield _batch(b, [(i, k, *t) for i, text, box in _spans(b) for k, t in enumerate(detector.grids(text, box))])

    return _pages(spans, "seq", "text", "x0", "y0", "x1", "y1").mapInArrow(run, GRID)


def definition_tables(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for row-wrapped tables, from spans and rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b["rules"].flatten()
            ends = starts(pc.fill_null(pc.list_value_length(b["rules"]), 0).to_numpy(zero_copy_only=False)).tolist()
            own = np.stack([held.field(c).cast("float64").to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], 1)
            yield _batch(b, [(i, k, t.score, t.grid) for i, text, box in _spans(b) for k, t in enumerate(definitions(Spans(text, box), own[ends[i] : ends[i + 1]]))])

    drawn = rules.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1"))).alias("rules"))
    return _pages(spans, "seq", "text", "x0", "y0", "x1", "y1").join(drawn, ["doc_id", "page"]).mapInArrow(run, GRID)
