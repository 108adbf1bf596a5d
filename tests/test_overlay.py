"""Polygons on polygons by single edges: against clipping and against the array form, with long outlines and crowded sides."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import EDGES, ring

from cityloom.functions import geometry as g
from cityloom.operators import overlay, spatial
from cityloom.operators.spatial import BOX


def polygons(spark, outlines):
    rows = spark.createDataFrame(list(enumerate(outlines)), f"id long, edges {EDGES}")
    return rows.select("id", "edges", g.bbox(F.col("edges")).alias("b")).select("id", "edges", *[f"b.{c}" for c in BOX])


def clipped_area(points, box):
    """Area of a polygon inside a box: cut by one side after the other."""
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        kept = []
        for p, q in zip(points, points[1:] + points[:1]):
            inside, following = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if inside:
                kept.append(p)
            if inside != following:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                kept.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
        points = kept
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1])) / 2 if points else 0.0


def star(edges, centre, rng):
    angle = np.arange(edges) / edges * 2 * np.pi
    far = 200 + 60 * np.sin(angle * 9) + rng.random(edges) * 4
    return [(float(centre + r * np.cos(a)), float(centre + r * np.sin(a))) for r, a in zip(far, angle)]


def test_a_long_outline_and_a_crowded_right_side_match_clipping(spark):
    rng = np.random.default_rng(3)
    outline = star(10_000, 300.0, rng)
    corners = np.round(rng.random((400, 2)) * 560, 2)
    crowd = [(float(x), float(y), float(x) + 24.5, float(y) + 17.25) for x, y in np.concatenate([corners, np.tile([[290.0, 310.0]], (150, 1))])]
    right = polygons(spark, [ring([(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]) for b in crowd])
    left = polygons(spark, [ring(outline)])
    want = {i: clipped_area(outline, b) for i, b in enumerate(crowd)}
    for size in (64.0, 1000.0):
        got = {r.b_id: r.overlap for r in overlay.overlap_join(left, right, size).collect()}
        assert got == pytest.approx({i: v for i, v in want.items() if v > 1e-6}, abs=1e-6)


def test_no_outline_is_shuffled(spark):
    some = polygons(spark, [ring([(0, 0), (9, 0), (9, 9), (0, 9)]), ring([(5, 5), (20, 5), (20, 20), (5, 20)])])
    plan = overlay.overlap_join(some, some, 8.0)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = re.findall(r"^\(\d+\) (\S+)[^\n]*\nInput \[\d+\]: ([^\n]*)", plan, re.M)
    exchanged = [columns for node, columns in parts if node.endswith("Exchange")]
    assert exchanged and not any("edges" in columns for columns in exchanged)


def random_polygon(rng, corners):
    angle = np.sort(rng.random(corners)) * 2 * np.pi
    centre, far = rng.random(2) * 20, 1 + rng.random(corners) * 6
    return ring([(float(x), float(y)) for x, y in np.round(np.stack([centre[0] + far * np.cos(angle), centre[1] + far * np.sin(angle)], 1) * 4) / 4])


def test_edge_form_equals_array_form(spark):
    rng = np.random.default_rng(11)
    a = polygons(spark, [random_polygon(rng, int(n)) for n in rng.integers(4, 9, 40)])
    b = polygons(spark, [random_polygon(rng, int(n)) for n in rng.integers(4, 9, 40)])
    whole = spatial.bbox_join(a, b, 6.0).select(
        "a_id", "b_id", g.overlap_area(F.col("a_edges"), F.col("b_edges")).alias("overlap"), g.intersects(F.col("a_edges"), F.col("b_edges")).alias("meets"))
    want = {(r.a_id, r.b_id): (r.overlap, r.meets) for r in whole.collect()}
    pairs = spatial.bbox_join(a.select("id", *BOX), b.select("id", *BOX), 6.0)
    got = {(r.a_id, r.b_id): (r.overlap, r.meets) for r in overlay.overlay(pairs, a, b, 6.0).collect()}
    assert set(got) <= set(want) and {m for _, m in want.values()} == {True, False}
    for key, (area, meets) in want.items():
        have = got.get(key, (0.0, False))
        assert have == (pytest.approx(area, abs=1e-9), meets), key


def test_meeting_by_holes_parts_and_single_points(spark):
    holed = ring([(0, 0), (10, 0), (10, 10), (0, 10)]) + ring([(2, 2), (2, 8), (8, 8), (8, 2)])
    parts = ring([(40, 40), (41, 40), (41, 41), (40, 41)]) + ring([(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)])  # the second lies inside
    in_hole, at_corner, upright = ring([(4, 4), (5, 4), (5, 5)]), ring([(10, 10), (12, 10), (12, 12)]), ring([(10, 3), (11, 3), (11, 4), (10, 4)])
    left, right = polygons(spark, [holed]), polygons(spark, [parts, in_hole, at_corner, upright, ring([(30, 30), (31, 30), (31, 31)])])
    for size in (1.0, 5.0, 64.0):
        met = sorted(r.area_id for r in overlay.filter_polygon(left, right, "intersects", size).collect())
        assert met == [0, 2, 3]
    inner = polygons(spark, [ring([(0, 0), (2, 0), (2, 2), (0, 2)]), ring([(1, 1), (3, 1), (3, 3), (1, 3)])])
    assert [(r.id, r.area_id) for r in overlay.filter_polygon(inner, left, "within", 4.0).collect()] == [(0, 0)]
    with pytest.raises(ValueError):
        overlay.filter_polygon(inner, left, "near", 4.0)


def test_missing_empty_and_single_rows(spark):
    left = spark.createDataFrame([(1, None, None, None, None, None), (2, [], 0.0, 0.0, 1.0, 1.0)], f"id long, edges {EDGES}, minx double, miny double, maxx double, maxy double")
    right = polygons(spark, [ring([(0, 0), (9, 0), (9, 9), (0, 9)])])
    assert overlay.overlap_join(left, right, 8.0).count() == overlay.overlap_join(right, left.limit(0), 8.0).count() == 0


def test_squares_crowded_on_either_or_both_sides_give_each_pair_once(spark):
    rng = np.random.default_rng(5)
    table = lambda n, spread: spark.createDataFrame([(i, float(x), float(y), float(x) + 1, float(y) + 1) for i, (x, y) in enumerate(rng.random((n, 2)) * spread)], "id long, " + ", ".join(f"{c} double" for c in BOX))
    few, many = table(12, 16.0).cache(), table(300, 16.0).cache()
    for left, right in ((few, many), (many, few), (many, many)):
        run = lambda hot: sorted((r.a_id, r.b_id) for r in spatial.bbox_join(left, right, 8.0, hot_rows=hot).collect())
        assert run(20) == run(500_000) and len(run(20)) > 20
