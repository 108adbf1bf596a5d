"""Plane geometry as column expressions.

A polygon is an array of directed edges ``(x1, y1, x2, y2)``: outer rings turn left, holes turn right. With that
orientation area, overlap and covered length are plain sums over edges, holes and concave outlines included, so no
geometry library and no Python function is involved.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edge(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def ring_edges(points: Column) -> Column:
    """Edges of one closed ring given as an array of ``(x, y)`` without the repeated last point."""
    n = F.size(points)
    return F.transform(points, lambda p, i: edge(
        p["x"], p["y"], F.element_at(points, (i + 1) % n + 1)["x"], F.element_at(points, (i + 1) % n + 1)["y"]))


def rings_edges(rings: Column) -> Column:
    """Edges of all rings of a polygon."""
    return F.flatten(F.transform(rings, ring_edges))


def _sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def area(edges: Column) -> Column:
    return _sum(edges, lambda e: (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)


def perimeter(edges: Column) -> Column:
    return _sum(edges, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def centroid(edges: Column) -> Column:
    """Struct ``(x, y)``; coordinates are taken relative to the first vertex so large ones lose no digits."""
    ox, oy = edges[0]["x1"], edges[0]["y1"]

    def moment(pick):
        def term(e):
            ax, ay, bx, by = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
            return pick(ax, ay, bx, by) * (ax * by - bx * ay)
        return _sum(edges, term)

    whole = area(edges) * 6
    return F.struct(
        (ox + moment(lambda ax, ay, bx, by: ax + bx) / whole).alias("x"),
        (oy + moment(lambda ax, ay, bx, by: ay + by) / whole).alias("y"))


def bbox(edges: Column) -> Column:
    xs = F.concat(F.transform(edges, lambda e: e["x1"]), F.transform(edges, lambda e: e["x2"]))
    ys = F.concat(F.transform(edges, lambda e: e["y1"]), F.transform(edges, lambda e: e["y2"]))
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd crossing test of a ray to the right; exact products, no division."""
    def crosses(e: Column) -> Column:
        rise = e["y2"] - e["y1"]
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * rise
        return ((e["y1"] > y) != (e["y2"] > y)) & ((rise > 0) == (turn > 0)) & (turn != 0)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e).cast("int")) % 2 == 1


def on_boundary(edges: Column, x: Column, y: Column) -> Column:
    return F.exists(edges, lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (x - e["x1"]) * (e["y2"] - e["y1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))))


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Inside or on the boundary."""
    return on_boundary(edges, x, y) | contains(edges, x, y)


def segments_touch(e: Column, f: Column) -> Column:
    """Whether two closed segments share a point."""
    def side(a, px, py):
        return F.signum((a["x2"] - a["x1"]) * (py - a["y1"]) - (a["y2"] - a["y1"]) * (px - a["x1"]))

    def boxes(lo1, hi1, lo2, hi2):
        return (F.greatest(F.least(lo1, hi1), F.least(lo2, hi2)) <= F.least(F.greatest(lo1, hi1), F.greatest(lo2, hi2)))

    return (
        boxes(e["x1"], e["x2"], f["x1"], f["x2"]) & boxes(e["y1"], e["y2"], f["y1"], f["y2"])
        & (side(e, f["x1"], f["y1"]) * side(e, f["x2"], f["y2"]) <= 0)
        & (side(f, e["x1"], e["y1"]) * side(f, e["x2"], e["y2"]) <= 0))


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: boundaries touch, or one holds a vertex of the other."""
    return (
        F.exists(a, lambda e: F.exists(b, lambda f: segments_touch(e, f)))
        | contains(b, a[0]["x1"], a[0]["y1"]) | contains(a, b[0]["x1"], b[0]["y1"]))


def _strips(a_edge: Column, b: Column, base: Column) -> Column:
    """Signed areas under one edge and each edge of ``b``, above ``base``, over the x-range they share.

    Every step names its values once, because expressions inside array functions are evaluated as often as written.
    """
    e = a_edge
    ranged = F.transform(b, lambda f: F.struct(
        f.alias("f"), F.greatest(F.least(e["x1"], e["x2"]), F.least(f["x1"], f["x2"])).alias("l"),
        F.least(F.greatest(e["x1"], e["x2"]), F.greatest(f["x1"], f["x2"])).alias("r")))
    meeting = F.filter(ranged, lambda p: p["l"] < p["r"])

    def at(g, x):
        return g["y1"] + (g["y2"] - g["y1"]) * ((x - g["x1"]) / (g["x2"] - g["x1"])) - base

    ends = F.transform(meeting, lambda p: F.struct(
        at(e, p["l"]).alias("el"), at(e, p["r"]).alias("er"), at(p["f"], p["l"]).alias("fl"), at(p["f"], p["r"]).alias("fr"),
        (F.signum(e["x1"] - e["x2"]) * F.signum(p["f"]["x1"] - p["f"]["x2"]) * (p["r"] - p["l"]) / 2).alias("w")))

    def area_of(q: Column) -> Column:
        d_l, d_r = q["el"] - q["fl"], q["er"] - q["fr"]
        low_l, low_r = F.least(q["el"], q["fl"]), F.least(q["er"], q["fr"])
        t = d_l / (d_l - d_r)
        crossed = low_l * t + (q["el"] + (q["er"] - q["el"]) * t) + low_r * (F.lit(1.0) - t)
        return q["w"] * F.when(d_l * d_r < 0, crossed).otherwise(low_l + low_r)

    return F.transform(ends, area_of)


def overlap_area(a: Column, b: Column) -> Column:
    """Exact area shared by two polygons: sum over edge pairs of signed strips, holes and concave rings included."""
    base = F.array_min(F.transform(F.concat(a, b), lambda e: F.least(e["y1"], e["y2"])))
    based = F.transform(F.array(base), lambda y: F.aggregate(
        a, F.lit(0.0), lambda acc, e: F.aggregate(_strips(e, b, y), acc, lambda s, v: s + v)))
    return based[0]


def once(df, name: str, value: Column):
    """``df`` with a column that is computed a single time, even when a later filter looks at it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def crossings(edges: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where a segment crosses the edges: structs of ``sign`` (+1 enters, -1 leaves) and ``at`` (0 to 1, clamped)."""
    dx, dy = x2 - x1, y2 - y1
    sided = F.transform(edges, lambda e: F.struct(
        e.alias("e"), (dx * (e["y1"] - y1) - dy * (e["x1"] - x1)).alias("a"), (dx * (e["y2"] - y1) - dy * (e["x2"] - x1)).alias("b")))
    met = F.filter(sided, lambda s: (s["a"] >= 0) != (s["b"] >= 0))
    cut_at = F.transform(met, lambda s: F.struct(
        F.when(s["a"] >= 0, 1).otherwise(-1).alias("sign"), (s["a"] / (s["a"] - s["b"])).alias("u"), s["e"].alias("e")))

    def place(c: Column) -> Column:
        px = c["e"]["x1"] + (c["e"]["x2"] - c["e"]["x1"]) * c["u"] - x1
        py = c["e"]["y1"] + (c["e"]["y2"] - c["e"]["y1"]) * c["u"] - y1
        return F.struct(c["sign"].alias("sign"), F.least(F.greatest((px * dx + py * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)).alias("at"))

    return F.transform(cut_at, place)


def covered_share(edges: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of a segment that lies inside a polygon: entries and exits weighted by what is left of the segment."""
    marks = crossings(edges, x1, y1, x2, y2)
    return F.aggregate(marks, F.lit(0.0), lambda acc, c: acc + c["sign"] * (F.lit(1.0) - c["at"]))


def distance_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Struct ``(dist, share)``: distance to the nearest point of a segment and that point's place along it."""
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    share = F.when(long2 > 0, F.least(F.greatest(((px - x1) * dx + (py - y1) * dy) / F.when(long2 > 0, long2).otherwise(1.0), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.struct(F.hypot(px - x1 - dx * share, py - y1 - dy * share).alias("dist"), share.alias("share"))


def _hull(points: np.ndarray) -> np.ndarray:
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    lower, upper = half(points), half(points[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _narrow_side(rows) -> float:
    hull = _hull(np.array([[e["x1"], e["y1"]] for e in rows], dtype=float))
    if len(hull) < 3:
        return 0.0
    d = np.roll(hull, -1, axis=0) - hull
    d = d / np.hypot(d[:, 0], d[:, 1])[:, None]
    along, across = np.ptp(hull @ d.T, axis=0), np.ptp(hull @ np.stack([-d[:, 1], d[:, 0]]), axis=0)
    best = int(np.argmin(np.round(along * across, 9)))
    return float(min(along[best], across[best]))


def min_width(edges: Column) -> Column:
    """Short side of the smallest rectangle around a polygon; needs its hull, so it runs as an Arrow function."""
    def narrow(batch: pd.Series) -> pd.Series:
        return batch.map(_narrow_side)

    return F.pandas_udf(narrow, "double")(edges)


# The rasterizers below enumerate rows, not boxes: each row of cells yields the covered stretches between crossings.


def covered_cells(edges: Column, size: float) -> Column:
    """Cells ``(cx, cy)`` whose centre lies inside a polygon; a boundary shared by two polygons gives each cell once."""
    low = F.array_min(F.transform(edges, lambda e: F.least(e["y1"], e["y2"])))
    high = F.array_max(F.transform(edges, lambda e: F.greatest(e["y1"], e["y2"])))
    first = F.ceil(low / size - 0.5).cast("bigint")
    last = F.ceil(high / size - 0.5).cast("bigint") - 1

    def row(cy: Column) -> Column:
        y = (cy + 0.5) * size
        hit = F.filter(edges, lambda e: (e["y1"] > y) != (e["y2"] > y))
        xs = F.array_sort(F.transform(hit, lambda e: F.ceil(
            (e["x1"] + (e["x2"] - e["x1"]) * ((y - e["y1"]) / (e["y2"] - e["y1"]))) / size - 0.5).cast("bigint")))
        pairs = F.transform(
            F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i % 2 == 0) & (F.size(xs) > 0)),
            lambda i: F.struct(F.element_at(xs, i + 1).alias("a"), F.element_at(xs, i + 2).alias("b")))
        runs = F.transform(F.filter(pairs, lambda p: p["a"] < p["b"]), lambda p: F.sequence(p["a"], p["b"] - 1))
        return F.transform(F.flatten(runs), lambda cx: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.when(last >= first, F.flatten(F.transform(F.sequence(first, last), row)))


def touched_by_segment(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Cells a segment passes through, row by row."""
    first, last = F.floor(F.least(y1, y2) / size).cast("bigint"), F.floor(F.greatest(y1, y2) / size).cast("bigint")
    flat = y1 == y2

    def row(cy: Column) -> Column:
        lo, hi = F.greatest(cy * F.lit(float(size)), F.least(y1, y2)), F.least((cy + 1) * F.lit(float(size)), F.greatest(y1, y2))
        def x_at(y):
            return F.when(flat, x1).otherwise(x1 + (x2 - x1) * ((y - y1) / F.when(flat, 1.0).otherwise(y2 - y1)))
        xa, xb = F.when(flat, x1).otherwise(x_at(lo)), F.when(flat, x2).otherwise(x_at(hi))
        return F.transform(
            F.sequence(F.floor(F.least(xa, xb) / size).cast("bigint"), F.floor(F.greatest(xa, xb) / size).cast("bigint")),
            lambda cx: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(first, last), row))


def met_cells(edges: Column, size: float) -> Column:
    """Cells a polygon's inside or boundary touches; those on the boundary come more than once."""
    boundary = F.flatten(F.transform(edges, lambda e: touched_by_segment(e["x1"], e["y1"], e["x2"], e["y2"], size)))
    inside = F.coalesce(covered_cells(edges, size), F.array().cast("array<struct<cx:bigint,cy:bigint>>"))
    return F.concat(boundary, inside)


def touched_cells(edges: Column, size: float) -> Column:
    """Cells a polygon's inside or boundary touches, each once."""
    return F.array_distinct(met_cells(edges, size))


def densify(x1: Column, y1: Column, x2: Column, y2: Column, step: float) -> Column:
    """Points ``(k, x, y)`` from the start of a segment to before its end, at most ``step`` apart."""
    n = F.greatest(F.ceil(F.hypot(x2 - x1, y2 - y1) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(
        k.alias("k"), (x1 + (x2 - x1) * (k / n)).alias("x"), (y1 + (y2 - y1) * (k / n)).alias("y")))
