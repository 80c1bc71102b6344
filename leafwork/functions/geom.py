"""Rectangles, fills and colours as column expressions. A rectangle is four columns with a common prefix: ``ax0`` .. ``ay1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sides(prefix: str | Column = "") -> tuple[Column, Column, Column, Column]:
    """The columns with a prefix, or the fields of a struct."""
    return tuple(F.col(f"{prefix}{c}") if isinstance(prefix, str) else prefix[c] for c in ("x0", "y0", "x1", "y1"))


def area(p: str | Column = "") -> Column:
    x0, y0, x1, y1 = sides(p)
    return (x1 - x0) * (y1 - y0)


def overlap(a: str | Column, b: str | Column) -> Column:
    """Area that two rectangles share; 0 where they only touch."""
    ax0, ay0, ax1, ay1 = sides(a)
    bx0, by0, bx1, by1 = sides(b)
    w, h = F.least(ax1, bx1) - F.greatest(ax0, bx0), F.least(ay1, by1) - F.greatest(ay0, by0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def containment(inner: str | Column, outer: str | Column) -> Column:
    """The share of ``inner`` that lies in ``outer``; 0 for an empty one."""
    return F.when(area(inner) > 0, overlap(inner, outer) / area(inner)).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def intersects(a: str, b: str, pad: float = 0.0) -> Column:
    """Whether two rectangles, each widened by ``pad``, share more than an edge."""
    ax0, ay0, ax1, ay1 = sides(a)
    bx0, by0, bx1, by1 = sides(b)
    p = 2 * pad
    return (ax0 < bx1 + p) & (bx0 < ax1 + p) & (ay0 < by1 + p) & (by0 < ay1 + p)


def is_rule(p: str = "") -> Column:
    x0, y0, x1, y1 = sides(p)
    return (F.least(x1 - x0, y1 - y0) < 3) & (F.greatest(x1 - x0, y1 - y0) > 20)


def is_chip(p: str = "") -> Column:
    x0, y0, x1, y1 = sides(p)
    aspect = F.when(y1 - y0 > 0, (x1 - x0) / (y1 - y0)).otherwise(F.lit(999.0))
    return ~is_rule(p) & (aspect > 0.55) & (aspect < 1.8) & (area(p) > 40) & (area(p) < 900)


def is_panel(p: str = "") -> Column:
    return ~is_rule(p) & (area(p) >= 900)


def near_white(r: Column, g: Column, b: Column) -> Column:
    return (r > 0.96) & (g > 0.96) & (b > 0.96)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    part = [F.lpad(F.hex(F.rint(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255).cast("long")), 2, "0") for c in (r, g, b)]
    return F.lower(F.concat(F.lit("#"), *part))


def style_key(font: Column, size: Column, colour: Column, flags: Column) -> Column:
    """Font, size to a tenth, colour, and B or I for bold or italic."""
    bold = (flags.bitwiseAND(16) != 0) | F.lower(font).contains("bold")
    italic = (flags.bitwiseAND(2) != 0) | F.lower(font).contains("italic")
    tenths = F.rint(size * 10).cast("long")
    return F.concat_ws(
        "|", font, F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string")),
        F.lower(F.lpad(F.hex(colour.cast("long")), 6, "0")), F.concat(F.when(bold, "B").otherwise(""), F.when(italic, "I").otherwise("")),
    )


def straight(points: Column, slack: float = 1.3) -> Column:
    """Whether a path is at most ``slack`` times as long as its chord; true for fewer than two points or no chord."""
    step = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    pairs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), step)
    length = F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)
    chord = step(F.element_at(points, 1), F.element_at(points, -1))
    return F.when(F.size(points) < 2, True).otherwise((chord == 0) | (length <= slack * chord))


def is_box(points: Column, p: str = "") -> Column:
    """Whether both sides are at least 3 and each point is a corner of the rectangle, to a tenth."""
    x0, y0, x1, y1 = sides(p)
    t = lambda c: F.rint(c * 10)
    corner = lambda q: ((t(q["x"]) == t(x0)) | (t(q["x"]) == t(x1))) & ((t(q["y"]) == t(y0)) | (t(q["y"]) == t(y1)))
    return (F.least(x1 - x0, y1 - y0) >= 3) & F.forall(points, corner)


def touches(points: Column, others: Column, pad: float) -> Column:
    """Whether any of ``points`` is within ``pad`` of a segment between successive ``others``."""

    def near(q: Column) -> Column:
        def segment(a: Column, b: Column) -> Column:
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            sq = dx * dx + dy * dy
            t = F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((q["x"] - a["x"]) * dx + (q["y"] - a["y"]) * dy) / sq))).otherwise(F.lit(0.0))
            return F.pow(q["x"] - a["x"] - t * dx, 2) + F.pow(q["y"] - a["y"] - t * dy, 2) <= pad * pad

        n = F.greatest(F.size(others) - 1, F.lit(0))
        return F.exists(F.zip_with(F.slice(others, F.lit(1), n), F.slice(others, F.lit(2), n), segment), lambda x: x)

    return F.exists(points, near)
