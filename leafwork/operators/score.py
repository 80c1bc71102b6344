"""Scores of a prediction against gold: reading order, table cells, tree edit similarity of tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.operators.arrow import starts


def distance(a: list | str, b: list | str) -> int:
    """Edits between two sequences."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def tidy(text: str) -> str:
    """Composed characters, no stretching, single spaces."""
    return " ".join(unicodedata.normalize("NFC", text).replace("ـ", "").split())


def _alike(x: str, y: str) -> float:
    return 1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0


def edit_similarity(text: str, gold: str) -> float:
    return _alike(tidy(text), tidy(gold))


@lru_cache(1 << 16)
def _tidied(text: str) -> str:
    return tidy(text)


def claimed(pred: list[str], gold: list[str], least: float) -> list[int]:
    """For each prediction the gold item that it takes: the most similar that is left, above ``least``; else -1."""
    tidied = [_tidied(g) for g in gold]
    left, out = dict(enumerate(tidied)), []
    same: dict[str, list[int]] = {}
    for g in range(len(gold) - 1, -1, -1):
        same.setdefault(tidied[g], []).append(g)
    for p in map(_tidied, pred):
        own = same.get(p, [])
        while own and own[-1] not in left:
            own.pop()
        # nothing is more similar than the same text, so that the others needn't be compared
        # and texts of too unlike lengths can't be similar enough
        best = (1.0, -own[-1]) if own else max(((_alike(p, t), -g) for g, t in left.items() if min(len(p), len(t)) > (least - 1e-9) * max(len(p), len(t))), default=(0.0, 0))
        if best[0] > least:
            del left[-best[1]]
            out.append(-best[1])
        else:
            out.append(-1)
    return out


def reading_order(pred: list[str], gold: list[str]) -> float:
    """1 less the edits that sort the matched blocks and the blocks that nothing matched, against all gold blocks."""
    if not gold:
        return 1.0
    seq = [g for g in claimed(pred, gold, 0.5) if g >= 0]
    return max(0.0, 1 - (distance(seq, sorted(seq)) + len(gold) - len(seq)) / len(gold))


Grid = list[list[str]]


def cell_score(found: Grid, gold: Grid) -> float:
    """How many of the gold cells some cell of the other grid matches, each once, as a share."""
    wanted, offered = ([_tidied(text) for row in grid for text in row] for grid in (gold, found))
    return sum(g >= 0 for g in claimed(offered, wanted, 0.7)) / len(wanted) if wanted else 1.0


@dataclass
class Node:
    tag: str
    text: str = ""
    colspan: int = 1
    rowspan: int = 1
    children: list[Node] = field(default_factory=list)


def table_tree(grid: list[list[str]]) -> Node:
    return Node("table", children=[Node("tr", children=[Node("td", c) for c in row]) for row in grid])


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root: Node | None = None
        self.row: Node | None = None
        self.cell: Node | None = None
        self.ended = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.ended:
            return
        if tag == "table" and self.root is None:
            self.root = Node("table")
        elif tag == "tr" and self.root is not None:
            self.row = Node("tr")
            self.root.children.append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            span = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isdigit()}
            self.cell = Node("td", "", span.get("colspan", 1), span.get("rowspan", 1))
            self.row.children.append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.root is not None:
            self.ended, self.cell = True, None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.text += data


def html_tree(html: str) -> Node:
    """The first table of a page; heads and bodies of tables count for nothing, head cells as cells."""
    reader = _Reader()
    reader.feed(html)
    return reader.root or Node("table")


def _post_order(root: Node) -> tuple[list[Node], list[int]]:
    nodes: list[Node] = []
    leftmost: list[int] = []

    def walk(n: Node) -> int:
        first = None
        for c in n.children:
            at = walk(c)
            first = at if first is None else first
        nodes.append(n)
        leftmost.append(len(nodes) - 1 if first is None else first)
        return leftmost[-1]

    walk(root)
    return nodes, leftmost


def tree_distance(a: Node, b: Node, structure_only: bool = False) -> tuple[float, int]:
    """Ordered tree edit distance by dynamic programming over key roots, and the larger tree's size."""
    na, la = _post_order(a)
    nb, lb = _post_order(b)
    roots = lambda left: sorted({x: i for i, x in enumerate(left)}.values())

    def rename(x: Node, y: Node) -> float:
        if x.tag != y.tag or (x.colspan, x.rowspan) != (y.colspan, y.rowspan):
            return 1.0
        if x.tag != "td" or structure_only:
            return 0.0
        s, t = x.text.strip(), y.text.strip()
        most = max(len(s), len(t))
        return distance(s, t) / most if most else 0.0

    tree = np.zeros((len(na), len(nb)))
    for i in roots(la):
        for j in roots(lb):
            p, q = la[i], lb[j]
            f = np.zeros((i - p + 2, j - q + 2))
            f[1:, 0], f[0, 1:] = np.arange(1, i - p + 2), np.arange(1, j - q + 2)
            for s in range(1, i - p + 2):
                for t in range(1, j - q + 2):
                    x, y = p + s - 1, q + t - 1
                    step = min(f[s - 1, t] + 1, f[s, t - 1] + 1)
                    if la[x] == p and lb[y] == q:
                        f[s, t] = tree[x, y] = min(step, f[s - 1, t - 1] + rename(na[x], nb[y]))
                    else:
                        f[s, t] = min(step, f[la[x] - p, lb[y] - q] + tree[x, y])
    return float(tree[-1, -1]), max(len(na), len(nb))


def teds(a: Node, b: Node, structure_only: bool = False) -> float:
    """1 less the tree distance over the larger size; two tables without rows are alike."""
    if not a.children and not b.children:
        return 1.0
    d, n = tree_distance(a, b, structure_only)
    return 1 - d / n


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between the strings of each pair, for many short pairs at once."""
    size = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    out = np.zeros(len(a), np.int64)
    widths = np.maximum(*size) if len(a) else np.zeros(0, np.int64)
    order, at = np.argsort(widths, kind="stable"), 0
    while at < len(order):
        part = order[at : at + (1 << 16)]
        part = part[: max(1, int(np.searchsorted(np.arange(1, len(part) + 1) * (widths[part] + 1), 1 << 22, "right")))]
        at += len(part)
        x, y = (np.array([side[i] for i in part], f"U{max(1, int(n[part].max()))}").view(np.uint32).reshape(len(part), -1).T for side, n in ((a, size[0]), (b, size[1])))
        n, m, here = size[0][part], size[1][part], np.arange(len(part))
        row = np.repeat(np.arange(len(y) + 1, dtype=np.int32)[:, None], len(part), 1)
        found = np.where(n == 0, m, 0)
        for i in range(1, len(x) + 1):
            new = np.empty_like(row)
            new[0] = i
            swap = row[:-1] + (y != x[i - 1])
            for j in range(1, len(y) + 1):
                np.minimum(np.minimum(row[j], new[j - 1]) + 1, swap[j - 1], out=new[j])
            row = new
            found = np.where(n == i, row[m, here], found)
        out[part] = found
    return out


def _cell_costs(found: list[Grid], gold: list[Grid]) -> np.ndarray:
    """What it costs to rename each cell to each, per pair of tables of one shape; equal pairs of texts are compared once."""
    index: dict[str, int] = {}
    p, g = (np.array([[index.setdefault(c, len(index)) for row in t for c in row] for t in side], np.int64).reshape(len(side), -1) for side in (found, gold))
    texts = list(index)
    pairs, back = np.unique(p[:, :, None] * len(texts) + g[:, None, :], return_inverse=True)
    x, y = ([texts[i] for i in (pairs // max(1, len(texts)) if k == 0 else pairs % max(1, len(texts))).tolist()] for k in (0, 1))
    most = np.maximum(np.array([len(t) for t in x], np.int64), np.array([len(t) for t in y], np.int64)) if len(pairs) else np.zeros(0, np.int64)
    return np.where(most > 0, distances(x, y) / np.maximum(most, 1), 0.0)[back].reshape(len(found), p.shape[1], g.shape[1])


def _tree_distances(a: Node, b: Node, cells: np.ndarray) -> np.ndarray:
    """``tree_distance`` of many pairs of tables of the shapes of ``a`` and ``b``, by their costs to rename cells."""
    na, la = _post_order(a)
    nb, lb = _post_order(b)
    rename = np.array([[0.0 if x.tag == y.tag else 1.0 for y in nb] for x in na])[:, :, None].repeat(len(cells), 2)
    own, others = ([i for i, x in enumerate(side) if x.tag == "td"] for side in (na, nb))
    rename[np.ix_(own, others)] = cells.transpose(1, 2, 0)
    roots = lambda left: sorted({x: i for i, x in enumerate(left)}.values())
    tree = np.zeros((len(na), len(nb), len(cells)))
    for i in roots(la):
        for j in roots(lb):
            p, q = la[i], lb[j]
            f = np.zeros((i - p + 2, j - q + 2, len(cells)))
            f[1:, 0], f[0, 1:] = np.arange(1, i - p + 2)[:, None], np.arange(1, j - q + 2)[:, None]
            for s in range(1, i - p + 2):
                for t in range(1, j - q + 2):
                    x, y = p + s - 1, q + t - 1
                    whole = la[x] == p and lb[y] == q
                    other = f[s - 1, t - 1] + rename[x, y] if whole else f[la[x] - p, lb[y] - q] + tree[x, y]
                    np.minimum(np.minimum(f[s - 1, t], f[s, t - 1]) + 1, other, out=f[s, t])
                    if whole:
                        tree[x, y] = f[s, t]
    return tree[-1, -1]


@lru_cache(1 << 12)
def _structure(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Distance of two tables with so many cells in each row, whatever these say."""
    x, y = (table_tree([[""] * n for n in t]) for t in (a, b))
    return float(_tree_distances(x, y, np.zeros((1, sum(a), sum(b))))[0])


def _plain_distance(found: Grid, gold: Grid) -> float | None:
    """The tree distance if it can be told without the table, else None.

    If the smaller grid's rows have as many cells as the larger one's first rows, then to rename cell by cell and add the
    rest is a way: that bounds it from above. From below: whatever keeps all nodes of the smaller tree costs what is to be
    added and, for each of its cells, the cheapest rename there is; whatever doesn't keep them all costs two more than what is
    to be added. A cell that shares no character with any in the other grid costs 1 wherever it goes.
    """
    few, many = (found, gold) if len(found) <= len(gold) else (gold, found)
    if any(len(x) != len(y) for x, y in zip(few, many)):
        return None
    odd = [c for x, y in zip(few, many) if x != y for c, d in zip(x, y) if c.strip() != d.strip()]
    if odd:
        letters = set("".join(c for r in many for c in r))
        if len(odd) > 2 or any(not (t := c.strip()) or letters & set(t) for c in odd):
            return None
    return float(sum(1 + len(r) for r in many[len(few) :]) + len(odd))


def teds_of(found: list[Grid], gold: list[Grid], structure_only: bool = False, most: int = 512) -> np.ndarray:
    """``teds`` of each pair of grids; pairs of one shape are worked out together, ``most`` at once."""
    out = np.ones(len(gold))
    by_shape: dict[tuple, list[int]] = {}
    for i, (f, g) in enumerate(zip(found, gold)):
        if f == g:
            continue
        if structure_only:
            d = _structure(tuple(map(len, f)), tuple(map(len, g)))
        else:
            d = _plain_distance(f, g)
        if d is not None:
            out[i] = 1 - d / (1 + max(len(t) + sum(map(len, t)) for t in (f, g)))
        else:
            by_shape.setdefault((tuple(map(len, f)), tuple(map(len, g))), []).append(i)
    for own in by_shape.values():
        a, b = table_tree(found[own[0]]), table_tree(gold[own[0]])
        n = max(1 + len(t.children) + sum(len(r.children) for r in t.children) for t in (a, b))
        for k in range(0, len(own), most):
            part = own[k : k + most]
            out[part] = 1 - _tree_distances(a, b, _cell_costs([found[i] for i in part], [gold[i] for i in part])) / n
    return out


def _grids(tables: pa.Array) -> list[Grid]:
    """Nested lists of texts as Python has them: cells are taken all at once."""
    rows = tables.flatten()
    cells, row_ends, ends = rows.flatten().to_pylist(), *(starts(pc.list_value_length(x).to_numpy(zero_copy_only=False)).tolist() for x in (rows, tables))
    grid = [cells[a:b] for a, b in zip(row_ends, row_ends[1:])]
    return [grid[a:b] for a, b in zip(ends, ends[1:])]


def teds_column(pred: Column, gold: Column) -> Column:
    """``struct<teds, structure>`` of two ``array<array<string>>`` columns, in Arrow batches."""

    @F.arrow_udf("teds double, structure double")
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        found, wanted = _grids(p), _grids(g)
        return pa.StructArray.from_arrays([pa.array(teds_of(found, wanted, only)) for only in (False, True)], ["teds", "structure"])

    return run(pred, gold)


def order_column(pred: Column, gold: Column) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, g in parts:
            yield pd.Series([reading_order(list(x), list(y)) for x, y in zip(p, g)])

    return run(pred, gold)


def cells_column(pred: Column, gold: Column) -> Column:
    @F.arrow_udf("double")
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array([cell_score(x, y) for x, y in zip(_grids(p), _grids(g))], pa.float64())

    return run(pred, gold)


def letters_column(a: Column, b: Column) -> Column:
    """``struct<i, u>``: how many characters two texts have in common, each as often as both have it, and how many either has."""

    def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        return np.unique(row << 21 | joined, return_counts=True)

    @F.arrow_udf("i long, u long")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (x, m), (y, n) = counted(a), counted(b)
        keys, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        m, n = np.bincount(at[: len(x)], m, len(keys)), np.bincount(at[len(x) :], n, len(keys))
        i, u = (np.bincount(keys >> 21, f(m, n), len(a)).astype(np.int64) for f in (np.minimum, np.maximum))
        return pa.StructArray.from_arrays([pa.array(i), pa.array(u)], ["i", "u"])

    return run(a, b)
