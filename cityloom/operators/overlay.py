"""Polygons on polygons, edge by edge.

Pairs are found by ids and boxes alone. Outlines travel as single directed edges, each in the upright strips it crosses,
and two outlines of a pair meet strip by strip. What two edges share is a number, numbers add up per strip on the map side
and per pair after that, so neither an outline of any length nor a crowd of pairs is ever one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .spatial import BOX, bbox_join

ENDS = ["x1", "y1", "x2", "y2"]


def edges_by_strip(polygons: DataFrame, size: float, prefix: str) -> DataFrame:
    """One row per edge and upright strip it touches: ``{prefix}_id, strip, {prefix}_first`` and its ends.

    ``first`` marks the edge that starts at a polygon's first vertex, in the strip of that vertex. Edges with a missing
    coordinate take no part.
    """
    edges = polygons.select("id", F.posexplode("edges").alias("pos", "e")).select("id", "pos", "e.*")
    cut_up = edges.where("x1 + y1 + x2 + y2 IS NOT NULL").selectExpr(
        "*", f"explode(sequence(floor(least(x1, x2) / {size}D), floor(greatest(x1, x2) / {size}D))) AS strip")
    return cut_up.selectExpr(
        f"id AS {prefix}_id", "strip", f"pos = 0 AND strip = floor(x1 / {size}D) AS {prefix}_first", *[f"{c} AS {prefix}{c}" for c in ENDS])


def _at(p: str, x: str) -> str:
    """Height of an edge at ``x`` above the pair's base; null for an upright edge."""
    return f"{p}y1 - base + ({p}y2 - {p}y1) * (({x} - {p}x1) / nullif({p}x2 - {p}x1, 0D))"


def _side(p: str, x: str, y: str) -> str:
    return f"signum(({p}x2 - {p}x1) * ({y} - {p}y1) - ({p}y2 - {p}y1) * ({x} - {p}x1))"


def _above(p: str, o: str) -> str:
    """1 where the other outline's edge lies straight above a first vertex; an odd sum says that the vertex is inside."""
    turn = _side(o, f"{p}x1", f"{p}y1")
    return f"CAST({p}_first AND ({o}x1 > {p}x1) <> ({o}x2 > {p}x1) AND {turn} * signum({o}x2 - {o}x1) < 0 AS INT)"


TOUCH = f"""top >= bottom AND right >= left AND {_side('a', 'bx1', 'by1')} * {_side('a', 'bx2', 'by2')} <= 0
    AND {_side('b', 'ax1', 'ay1')} * {_side('b', 'ax2', 'ay2')} <= 0"""
# under the lower of two straight edges between left and right; where they cross, in two parts
UNDER = """CASE WHEN al < bl AND ar > br OR al > bl AND ar < br
    THEN (least(al, bl) + al + (ar - al) * cross) * cross + (al + (ar - al) * cross + least(ar, br)) * (1D - cross) ELSE least(al, bl) + least(ar, br) END"""


def overlay(pairs: DataFrame, left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """``pairs`` with the exact area ``overlap`` that the two polygons share and whether they share a point, ``meets``.

    ``pairs`` come from ``bbox_join`` with ids and boxes on both sides; their other columns stay. Ids name one polygon
    each. A pair without any edges in a common strip is left out: it shares nothing.

    Shared area is the sum, over all pairs of edges, of the signed strip under the lower of both above their common
    x-range; holes and concave outlines included. Outlines meet where edges touch, or one holds the other's first vertex,
    or area is shared, as by one part of several that lies inside.
    """
    names = [c for c in pairs.columns if c not in {f"{p}_{c}" for p in "ab" for c in BOX}]
    asked = pairs.selectExpr(
        *names, "least(a_miny, b_miny) AS base",
        f"explode(sequence(floor(greatest(a_minx, b_minx) / {size}D), floor(least(a_maxx, b_maxx) / {size}D))) AS strip")
    met = asked.join(edges_by_strip(left, size, "a"), ["a_id", "strip"]).join(edges_by_strip(right, size, "b"), ["b_id", "strip"])
    shared = met.selectExpr(
        "*", "greatest(least(ax1, ax2), least(bx1, bx2)) AS left", "least(greatest(ax1, ax2), greatest(bx1, bx2)) AS right",
        "greatest(least(ay1, ay2), least(by1, by2)) AS bottom", "least(greatest(ay1, ay2), greatest(by1, by2)) AS top",
    ).selectExpr("*", f"greatest(left, strip * {size}D) AS l", f"least(right, (strip + 1) * {size}D) AS r")
    ends = shared.selectExpr(
        "*", f"{_at('a', 'l')} AS al", f"{_at('a', 'r')} AS ar", f"{_at('b', 'l')} AS bl", f"{_at('b', 'r')} AS br")
    terms = ends.selectExpr("*", "(al - bl) / nullif((al - bl) - (ar - br), 0D) AS cross").selectExpr(
        *names, f"CASE WHEN l < r THEN signum(ax1 - ax2) * signum(bx1 - bx2) * (r - l) / 2D * {UNDER} ELSE 0D END AS area",
        f"{TOUCH} AS touch", f"{_above('a', 'b')} AS a_in", f"{_above('b', 'a')} AS b_in")
    found = terms.groupBy(*names).agg(*[F.expr(e) for e in (
        "sum(area) AS overlap", "bool_or(touch) AS touch", "sum(a_in) AS a_in", "sum(b_in) AS b_in")])
    return found.selectExpr(*names, "overlap", "touch OR a_in % 2 = 1 OR b_in % 2 = 1 OR overlap > 1e-6 AS meets")


def overlap_join(left: DataFrame, right: DataFrame, size: float, same: bool = False) -> DataFrame:
    """Pairs of polygons ``a_id, b_id`` that share area, with the exact shared area; ``same`` as in ``bbox_join``."""
    pairs = bbox_join(left.select("id", *BOX), right.select("id", *BOX), size, same=same)
    return overlay(pairs, left, right, size).where(F.col("overlap") > 1e-9).select("a_id", "b_id", "overlap")


def filter_polygon(features: DataFrame, areas: DataFrame, predicate: str, size: float) -> DataFrame:
    """Features related to the areas' actual outlines, with the area's id: ``intersects``, ``within`` or ``covers``.

    ``within`` and ``covers`` hold when all of the feature's area lies in the one area; a boundary may touch.
    """
    if predicate not in ("intersects", "within", "covers"):
        raise ValueError(f"unknown predicate {predicate}")
    pairs = bbox_join(features.select("id", *BOX), areas.select("id", *BOX), size)
    related = overlay(pairs, features, areas, size).select(F.col("a_id").alias("id"), F.col("b_id").alias("area_id"), "overlap", "meets")
    if predicate == "intersects":
        hits = related.where("meets").select("id", "area_id")
        return features.join(hits, "id").select(*features.columns, "area_id")
    own = F.col("_own")
    joined = features.withColumn("_own", g.area(F.col("edges"))).join(related, "id")
    return joined.where(F.col("overlap") >= own - F.greatest(own, F.lit(1.0)) * 1e-9).select(*features.columns, "area_id")
