"""Feature, tile, line, seam and print-log operators on tiny inputs with known answers."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cityloom.functions import geometry as g
from cityloom.functions import tags as tg
from cityloom.functions import text
from cityloom.functions.lattice import FT
from cityloom.operators import audits, buildings, cells, roads, seams, spatial, stats
from cityloom.plans.buildings import box_edges
from cityloom.sources import manifest, printlogs, tiles, vectors
from cityloom.streaming import ingest


def boxes(spark, rows):
    return box_edges(spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(rows)], "id long, minx double, miny double, maxx double, maxy double"))


def ring(points):
    return [dict(x1=float(a[0]), y1=float(a[1]), x2=float(b[0]), y2=float(b[1])) for a, b in zip(points, points[1:] + points[:1])]


EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def test_boundary_feature_is_stored_in_two_tiles_and_read_once(spark, folder):
    rows = boxes(spark, [(8, 1, 12, 3), (15, 1, 16, 3)]).withColumn("source_order", F.col("id")).drop("edges")
    tiles.write_tiles(rows, folder + "/t", 10.0)
    assert spark.read.parquet(folder + "/t").count() == 3
    assert tiles.tile_catalog(spark, folder + "/t", 10.0).count() == 2
    read = lambda b: sorted(r.id for r in tiles.read_tiles(spark, folder + "/t", b, 10.0).collect())
    assert read((0, 0, 20, 5)) == [0, 1] and read((10, 0, 11, 5)) == [0]


def test_manifest_is_reusable_only_while_its_files_are_unchanged(spark, folder):
    path = folder + "/m"
    assert not manifest.is_current(spark, path, "c", "s")
    version = manifest.publish(spark.range(10), path, "c", "s", limited=True)
    assert manifest.is_current(spark, path, "c", "s") and not manifest.is_current(spark, path, "c2", "s")
    assert not manifest.versions(spark, path).first()["production_ready"]
    spark.range(5000).coalesce(1).write.mode("overwrite").parquet(f"{path}/data/{version}")
    assert not manifest.is_current(spark, path, "c", "s")


def test_source_inventory_changes_with_the_sources(spark, folder):
    spark.range(5).write.parquet(folder + "/a")
    first = manifest.source_inventory(spark, folder + "/a").first()
    spark.range(5).write.mode("append").parquet(folder + "/a")
    second = manifest.source_inventory(spark, folder + "/a").first()
    assert second.files > first.files and second.digest != first.digest


RING = "<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>%s</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"


def model(name, number, surfaces):
    """A city model file of one building with surfaces given as (kind, rings)."""
    space = "".join(f" xmlns:{short}='http://www.opengis.net/{path}'" for short, path in
                    (("core", "citygml/2.0"), ("bldg", "citygml/building/2.0"), ("gen", "citygml/generics/2.0"), ("gml", "gml")))
    parts = "".join(f"<bldg:boundedBy><bldg:{kind}Surface>{RING % ' '.join(str(v) for corner in corners for v in corner)}</bldg:{kind}Surface></bldg:boundedBy>" for kind, corners in surfaces)
    return (f"<?xml version='1.0'?><core:CityModel{space}><bldg:Building gml:id='{name}'><gen:stringAttribute name='DOITT_ID'><gen:value>{number}</gen:value>"
            f"</gen:stringAttribute>{parts}</bldg:Building></core:CityModel>")


def test_building_model_file(spark, tmp_path):
    flat = lambda x0, x1, z: [(x0, 2, z), (x1, 2, z), (x1, 31, z), (x0, 31, z), (x0, 2, z)]
    side = [(3, 2, 6), (24, 2, 6), (24, 2, 33.5), (3, 2, 27), (3, 2, 6)]
    (tmp_path / "tower.gml").write_text(model("hall", 9071, [("Ground", flat(3, 24, 6)), ("Roof", flat(3, 15, 27)), ("Roof", flat(15, 24, 33.5)), ("Wall", side)]))
    found, roofs = vectors.ingest_citygml(spark, str(tmp_path), (0, 0, 40, 40))
    hall = found.collect()
    assert len(hall) == 1 and (hall[0].doitt_id, hall[0].roof_count, hall[0].z_min_ft, hall[0].z_max_ft) == ("9071", 2, 6, 33.5)
    assert sorted((r.kind, len(r.ring), r.ring[0].z) for r in roofs.collect()) == [("roof", 4, 27), ("roof", 4, 33.5)]
    assert vectors.ingest_citygml(spark, str(tmp_path), (25, 0, 40, 40))[0].count() == 0
    assert vectors.ingest_citygml(spark, str(tmp_path), (24, 0, 40, 40))[0].count() == 1


def test_feature_pages_keep_their_order(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]
    page = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"doitt_id": "7.0", "height_roof": h}, "geometry": {"type": "Polygon", "coordinates": square}} for h in ("12.5", "n/a")]}
    (tmp_path / "page_000002000.json").write_text(json.dumps(page))
    rows = vectors.ingest_feature_collection(spark, str(tmp_path)).withColumn("area", g.area(F.col("edges"))).orderBy("source_order").collect()
    assert [(r.source_order, r.doitt_id, r.height_roof, r.area) for r in rows] == [(2000, "7", 12.5, 15.0), (2001, "7", None, 15.0)]


def test_diamond_area_counts_two_of_twelve_buildings(spark):
    rows = [(4.0, 4.0, 5.0, 5.0), (5.0, 5.0, 6.0, 6.0)] + [(0.1 * i, 0.1, 0.1 * i + 0.05, 0.15) for i in range(5)] + [(9.5, 9.0 + 0.1 * i, 9.6, 9.05 + 0.1 * i) for i in range(5)]
    area = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0, ring([(5, 0), (10, 5), (5, 10), (0, 5)]))], f"id long, minx double, miny double, maxx double, maxy double, edges {EDGES}")
    f = boxes(spark, rows).withColumn("is_building", F.lit(True)).withColumn("is_road", F.lit(False))
    counts = buildings.semantic_counts(f, area, 4.0).first()
    assert (counts.buildings, counts.buildings_in_box) == (2, 12)


@pytest.mark.parametrize("highway,tags,support,want", [
    ("footway", {"surface": "asphalt", "name": "x"}, 1.0, "trail"), ("residential", {}, 0.0, "carriageway"), ("service", {"service": "driveway", "lanes": "2"}, 1.0, "other"),
    ("service", {"name": "Ring Road"}, 0.9, "carriageway"), ("service", {}, 0.9, "other"), ("pedestrian", {"surface": "asphalt", "lanes": "2", "maxspeed": "25", "name": "West Drive"}, 0.0, "carriageway"),
    ("pedestrian", {"surface": "asphalt", "name": "Plaza"}, 1.0, "trail"), ("road", {}, 0.8, "carriageway"), ("elevator", {}, 1.0, "other"), ("", {}, 1.0, "other")])
def test_highway_classes(spark, highway, tags, support, want):
    row = spark.createDataFrame([(highway, tags, support)], "h string, t map<string,string>, s double")
    assert row.select(tg.classify_highway(F.col("h"), F.col("t"), F.col("s"))["cls"]).first()[0] == want


def test_durations(spark):
    row = spark.createDataFrame([("7h 5m 9s",), ("2d 1m",), ("soon",)], "t string").select(text.parse_duration(F.col("t")).alias("s")).collect()
    assert [r.s for r in row] == [25509.0, 172860.0, None]
    with pytest.raises(Exception, match="unreadable duration"):
        spark.createDataFrame([("soon",)], "t string").select(text.require_duration(F.col("t"))).collect()


def test_log_and_slicer_xml(spark, tmp_path):
    lines = ["; total layer number: 731", "; model printing time: 1d 2h 3m; total estimated time: 1d 2h 40m 5s", "; filament_type = ASA;TPU;PLA", "; total filament weight [g] : 81.4,0.6,7", "G28"]
    (tmp_path / "tray.gcode").write_text("\n".join(lines) + "\n")
    log = printlogs.print_log_stats(printlogs.read_log_lines(spark, str(tmp_path / "tray.gcode"))).first()
    assert (log.model_seconds, log.seconds, log.layers) == (93780.0, 96005.0, 731)
    assert (log.weight_g, log.type, log.status) == ([81.4, 0.6, 7.0], ["ASA", "TPU", "PLA"], "ok")
    used = lambda n, grams, metres: f"<filament id='{n}' type='TPU' color='#0A0B0C' used_m='{metres}' used_g='{grams}'/>"
    plate = lambda seconds, *inside: f"<plate><metadata key='prediction' value='{seconds}'/>{''.join(inside)}</plate>"
    (tmp_path / "tray.xml").write_text(f"<config>{plate(7310, used(3, 12.25, 4))}{plate(90, used(3, 1, 0.5), used(7, 2, 0.75))}{plate(5)}</config>")
    totals, filaments = printlogs.slice_info_stats(spark, str(tmp_path / "tray.xml"))
    print(totals.collect(), filaments.collect())
    assert (totals.first().seconds, totals.first().plates) == (7400.0, 2)
    assert [(r.extruder, r.total_g, r.length_mm) for r in filaments.orderBy("extruder").collect()] == [(3, 13.25, 4500.0), (7, 2.0, 750.0)]


def test_points_in_polygons_do_not_change_when_crowded_squares_are_split(spark):
    rng = np.random.default_rng(8)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.random((400, 2)) * 4, rng.random((200, 2)) * 40]))], "pid long, x double, y double")
    polys = boxes(spark, [(0, 0, 3, 3), (1, 1, 30, 5), (2, 2, 2.5, 38)])
    run = lambda hot: {(r.pid, r.polygon_id) for r in spatial.points_in_polygons(pts, polys, 8.0, hot_rows=hot).collect()}
    assert run(10) == run(500_000) and len(run(10)) > 100
    pairs = lambda hot: {(r.a_id, r.b_id) for r in spatial.bbox_join(polys.select("id", *spatial.BOX), polys.select("id", *spatial.BOX), 8.0, same=True, hot_rows=hot).collect()}
    assert pairs(1) == pairs(500_000) == {(0, 1), (0, 2), (1, 2)}


def test_overlap_area_of_concave_and_holed_polygons(spark):
    ell = ring([(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)])
    holed = ring([(1, 1), (5, 1), (5, 5), (1, 5)]) + ring([(3, 3), (3, 4), (4, 4), (4, 3)])
    tri = ring([(0, 0), (4, 1), (1, 4)])
    row = spark.createDataFrame([(ell, holed, tri)], f"a {EDGES}, b {EDGES}, c {EDGES}")
    ab, bb, ac, aa = row.select(*[g.overlap_area(F.col(x), F.col(y)) for x, y in ("ab", "bb", "ac", "aa")]).first()
    assert ab == pytest.approx(4 * 1 + 1 * 3) and bb == pytest.approx(15) and aa == pytest.approx(20)
    xs = (np.arange(2000) + 0.5) / 2000 * 6
    x, y = np.meshgrid(xs, xs)
    in_tri = (4 * y - x * 1 >= 0) & (x * 4 - y >= 0) & (x + y <= 5)
    in_ell = (y <= 2) | (x <= 2)
    assert ac == pytest.approx((in_tri & in_ell).mean() * 36, abs=0.02)


def test_covered_share_counts_holes(spark):
    holed = ring([(0, 0), (10, 0), (10, 10), (0, 10)]) + ring([(4, 4), (4, 6), (6, 6), (6, 4)])
    row = spark.createDataFrame([(holed,)], f"e {EDGES}")
    lit = lambda *v: [F.lit(float(a)) for a in v]
    across, outside, within = row.select(g.covered_share(F.col("e"), *lit(-5, 5, 15, 5)), g.covered_share(F.col("e"), *lit(-5, 12, 15, 12)), g.covered_share(F.col("e"), *lit(1, 1, 3, 2))).first()
    assert across == pytest.approx(8 / 20) and outside == 0 and within == pytest.approx(1)


def test_terrain_relief_modes(spark):
    z = spark.createDataFrame([(1, float(v) / 10) for v in range(101)] + [(2, 5.0)] * 5, "plate int, z double")
    out = {r.plate: r for r in cells.terrain_relief(z, "z", ["plate"], scale=10000.0, layer_mm=0.2).collect()}
    assert out[2].factor == 1.0 and out[1].factor == pytest.approx(1.2 / (9 * 1000 / 10000)) and (out[1].mode, out[2].mode) == ("raised", "flat")
    with pytest.raises(ValueError):
        cells.terrain_relief(z, "z", ["plate"], scale=1.0, layer_mm=0.2, requested=20.0)


def test_line_fit_rejects_one_gross_outlier(spark):
    rows = [(1, t / 10, 10 + t / 5 + (20 if t == 4 else 0)) for t in range(11)] + [(2, 0.5, 3.0), (2, 0.52, 5.0)]
    out = {r.line_id: r for r in stats.robust_line_fit(spark.createDataFrame([(a, float(b), float(c)) for a, b, c in rows], "line_id int, place double, z double")).collect()}
    assert out[1].start_z == pytest.approx(10) and out[1].end_z == pytest.approx(12) and out[1].rejected == 1
    assert out[2].start_z == out[2].end_z == 4.0


def test_median_slope_by_bisection_is_the_median_of_pairs():
    rng = np.random.default_rng(9)
    t, z = rng.integers(0, 900, 3400) / 900.0, rng.random(3400)
    i, j = np.triu_indices(len(t), 1)
    far = t[i] != t[j]
    assert stats.median_slope(t, z) == pytest.approx(float(np.median(((z[i] - z[j]) / np.where(far, t[i] - t[j], 1))[far])), abs=1e-9)


def test_percentiles_of_a_crowded_key(spark):
    rng = np.random.default_rng(10)
    a, b = rng.random(501) * 7, rng.integers(0, 5, 40).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "k string, v double")
    got = {r.k: (r.value, r.samples) for r in stats.percentile_by(df, ["k"], "v", 0.3, 0.5).collect()}
    assert got["a"] == (pytest.approx(np.percentile(a, 30)), 501) and got["b"] == (pytest.approx(np.percentile(b, 30)), 40)


def test_road_width_is_measured_across_the_road(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 50.0, 400.0, 50.0, 0.0, 400.0, 400.0)], "line_id int, pos int, x1 double, y1 double, x2 double, y2 double, start_length double, length double, line_length double")
    bed = spark.createDataFrame([(x, y) for x in range(0, 400) for y in range(35, 65)], "cx long, cy long")
    widths = [r.width_m for r in roads.road_width_samples(segs, bed, 1.0).collect()]
    assert len(widths) == math.ceil(400 * FT / 15) and widths == pytest.approx([30 * FT] * len(widths))


def test_repeated_openings(spark):
    rows = [("r", 1, 0.0, 10.0), ("r", 2, 2.0, 8.0), ("r", 3, 6.0, 20.0), ("r", 4, 12.0, 22.0), ("q", 1, 0.0, 1.0)]
    out = {(r.route, r.candidate): (round(r.fraction, 6), r.repeated) for r in seams.reopened_fraction(spark.createDataFrame(rows, "route string, candidate long, span_start double, span_end double")).collect()}
    assert out == {("r", 1): (0.0, False), ("r", 2): (1.0, True), ("r", 3): (round(4 / 14, 6), False), ("r", 4): (0.8, True), ("q", 1): (0.0, False)}


def test_repeated_openings_of_a_crowded_route(spark):
    rng = np.random.default_rng(12)
    rows = [("r" if i % 9 else None, i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 900, 400), rng.integers(1, 9, 400)))]
    got = {r.candidate: (r.fraction, r.repeated) for r in seams.reopened_fraction(
        spark.createDataFrame(rows, "route string, candidate long, span_start double, span_end double"), width=16.0).collect()}
    held, want = {}, {}
    for route, i, a, b in rows:
        taken = held.setdefault(route, set())
        share = sum(u in taken for u in range(int(a), int(b))) / (b - a)
        want[i] = (share, share > 0.5)
        if share <= 0.5:
            taken.update(range(int(a), int(b)))
    assert got == want


def test_turning_points_ignore_small_bends(spark):
    pts = [(1, 0, 0, 0), (1, 1, 5, 0.01), (1, 2, 10, 0), (1, 3, 10, 8), (1, 4, 10, 12), (2, 0, 0, 0), (2, 1, 3, 4)]
    turns = seams.turning_points(spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in pts], "line_id int, pos long, x double, y double"))
    assert sorted((r.line_id, r.pos) for r in turns.collect()) == [(1, 0), (1, 2), (1, 4), (2, 0), (2, 1)]
    shape = {r.line_id: (r.sides, r.corners, r.shortest_side_ft) for r in seams.joint_shape(turns).collect()}
    assert shape == {1: (2, 1, 10.0), 2: (1, 0, 5.0)}


def test_grid_labels(spark):
    rows = [("p", 0, 0, 0, 10, 10), ("p", 1, 10, 1, 20, 11), ("p", 2, 0, 10, 10, 20), ("p", 3, 11, 10, 20, 20), ("p", 4, 10.5, 12, 19, 19)]
    df = spark.createDataFrame([(a, b, *map(float, c)) for a, b, *c in rows], "plan_id string, id long, minx double, miny double, maxx double, maxy double")
    assert {r.id: r.label for r in seams.grid_labels(df).collect()} == {0: "A2", 1: "B2", 2: "A1", 3: "B1", 4: "B1.2"}


def brute_staircase(cost, run, nominal, jog, centering, least, enter=None, leave=None):
    steps, levels = cost.shape
    best = np.inf
    for path in itertools.product(range(levels), repeat=steps):
        stretches = [len(list(s)) for _, s in itertools.groupby(path)]
        if min(stretches) < run:
            continue
        total = sum(cost[i, p] + centering * abs(p - nominal) for i, p in enumerate(path))
        for i in range(1, steps):
            if path[i] != path[i - 1]:
                lo, hi = sorted((path[i], path[i - 1]))
                total += jog + cost[i, lo:hi + 1].sum() if hi - lo >= least else np.inf
        best = min(best, total + (0 if enter is None else enter[path[0]]) + (0 if leave is None else leave[path[-1]]))
    return best


def price(cost, path, nominal, jog, centering):
    total = sum(cost[i, p] + centering * abs(p - nominal) for i, p in enumerate(path))
    return total + sum(jog + cost[i, min(path[i], path[i - 1]):max(path[i], path[i - 1]) + 1].sum() for i in range(1, len(path)) if path[i] != path[i - 1])


@pytest.mark.parametrize("seed", range(4))
def test_staircase_is_the_cheapest_of_all_paths(seed):
    cost = np.random.default_rng(seed).random((7, 4)) * 10
    path = seams.staircase(cost, run=2, nominal=1, jog=0.5, centering=0.1, least_jog=2)
    assert price(cost, path, 1, 0.5, 0.1) == pytest.approx(brute_staircase(cost, 2, 1, 0.5, 0.1, 2))


@pytest.mark.parametrize("seed", range(3))
def test_staircase_pays_for_where_it_starts_and_ends(seed):
    rng = np.random.default_rng(20 + seed)
    cost, enter, leave = rng.random((7, 4)) * 10, np.array([0.0, np.inf, 3.0, 3.0]), np.array([3.0, 3.0, np.inf, 0.0])
    path = seams.staircase(cost, run=2, nominal=1, jog=0.5, centering=0.1, least_jog=1, enter=enter, leave=leave)
    got = price(cost, path, 1, 0.5, 0.1) + enter[path[0]] + leave[path[-1]]
    assert got == pytest.approx(brute_staircase(cost, 2, 1, 0.5, 0.1, 1, enter, leave))


def test_staircase_cut_meets_its_neighbours(spark):
    rows = [("a:b", s, v, 1.0, 2, 0, 4) for s in range(12) for v in range(5)]
    cut = seams.best_staircase_cut(spark.createDataFrame(rows, "band_id string, step long, level long, cost double, nominal long, enter_level long, leave_level long"),
                                   run=3, jog=0.01, centering=0.0, least_jog=1, least_meet=9)
    path = [r.level for r in cut.orderBy("step").collect()]
    assert len(path) == 12 and path[0] == 0 and path[-1] == 4


@pytest.mark.parametrize("seed,shape", [(3, (300, 25)), (4, (400, 40))])
def test_staircase_keeps_its_minimum_run_and_jog(seed, shape):
    path = seams.staircase(np.random.default_rng(seed).random(shape), run=12, nominal=shape[1] // 2, jog=0.2, centering=0.0, least_jog=3)
    assert min(len(list(s)) for _, s in itertools.groupby(path)) >= 12
    assert all(abs(int(a) - int(b)) >= 3 for a, b in zip(path, path[1:]) if a != b)


def test_shells_are_split_and_judged(spark):
    def tetra(part, base, s, inward=False):
        corners = [(part, base, 0.0, 0.0, 0.0), (part, base + 1, s, 0.0, 0.0), (part, base + 2, 0.0, s, 0.0), (part, base + 3, 0.0, 0.0, s)]
        faces = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)]
        return corners, [(part, base * 10 + k, *[base + v for v in (f[::-1] if inward else f)]) for k, f in enumerate(faces)]
    parts = [tetra(1, 0, 5.0), tetra(1, 10, 0.1), tetra(1, 20, 3.0, inward=True), tetra(2, 0, 4.0)]
    vertices = spark.createDataFrame(sum((p[0] for p in parts), []), "part_id long, vertex_id long, x double, y double, z double")
    triangles = spark.createDataFrame(sum((p[1] for p in parts), []), "part_id long, tri_id long, v1 long, v2 long, v3 long")
    kinds = sorted((r.part_id, r.kind) for r in audits.shell_classes(triangles, vertices, 0.4, 0.2).collect())
    assert kinds == [(1, "cavity"), (1, "crumb"), (1, "printable"), (2, "printable")]


def test_pages_load_once_wait_for_holes_and_refuse_other_settings(spark, folder):
    source, path, schema = folder + "/in", folder + "/out", "page long, position long"

    def add(*pages):
        for p in pages:
            spark.createDataFrame([(p, k) for k in range(3)], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.stream_pages(spark, source, schema, path, "a", per_trigger=2)
        return sorted((r.page, r.position) for r in ingest.landed_pages(spark, path).collect())

    rows = lambda n: [(p, k) for p in range(n) for k in range(3)]
    assert add(0, 1) == rows(2) and add() == rows(2)
    assert add(1, 2, 2) == rows(3)
    assert add(5, 4) == rows(3)
    assert add(3) == rows(6)
    with pytest.raises(ValueError):
        ingest.stream_pages(spark, source, schema, path, "b")


def test_partition_of_overlapping_plates(spark):
    outline = lambda points: ring(points)
    whole = outline([(0, 0), (10, 0), (10, 10), (0, 10)])
    shapes = {
        1: [whole, whole, whole],
        2: [outline([(0, 0), (6, 0), (6, 10), (0, 10)]), outline([(4, 0), (10, 0), (10, 10), (4, 10)]), outline([(2, 2), (8, 2), (5, 9)])],
        3: [outline([(-2, 0), (10, 0), (10, 10)]), outline([(0, 0), (12, 0), (0, 12)])],
        4: [whole, []],
    }
    plates = [(10 * t + k, t, min([e["x1"] for e in edges], default=None), min([e["y1"] for e in edges], default=None), max([e["x1"] for e in edges], default=None),
               max([e["y1"] for e in edges], default=None), edges) for t, all_ in shapes.items() for k, edges in enumerate(all_)]
    box = "minx double, miny double, maxx double, maxy double"
    targets = spark.createDataFrame([(t, 0.0, 0.0, 10.0, 10.0, whole) for t in [*shapes, 5]], f"id long, {box}, edges {EDGES}")
    out = {r.target_id: r for r in seams.validate_partition(targets, spark.createDataFrame(plates, f"id long, target_id long, {box}, edges {EDGES}"), 3.0, 0.01).collect()}
    x, y = np.meshgrid((np.arange(2800) + 0.5) / 200 - 2, (np.arange(2800) + 0.5) / 200 - 2)
    held = ((y >= 0) & (x <= 10) & (y <= (x + 2) * 10 / 12)) | ((x >= 0) & (y >= 0) & (x + y <= 12))
    wanted = (x >= 0) & (x <= 10) & (y >= 0) & (y <= 10)
    for t in (1, 2, 4):
        assert out[t].missing_ft2 == pytest.approx(0, abs=1e-9) and out[t].excess_ft2 == pytest.approx(0, abs=1e-9)
    assert out[1].problems == out[2].problems == "plates overlap" and out[4].problems == "plates without area"
    assert out[3].missing_ft2 == pytest.approx((wanted & ~held).sum() / 200**2, abs=0.05) and out[3].excess_ft2 == pytest.approx((held & ~wanted).sum() / 200**2, abs=0.05)
    assert out[5].missing_ft2 == 100 and out[5].plates == 0


def test_silent_stage_becomes_overdue(spark, folder):
    schema = "event_id long, ts timestamp, job string, stage string, status string"
    def add(k, ts, stage, status):
        spark.sql(f"SELECT {k}L AS event_id, timestamp'{ts}' AS ts, 'j' AS job, '{stage}' AS stage, '{status}' AS status").coalesce(1).write.mode("append").parquet(folder + "/in")
    out = folder + "/out"
    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
        status = ingest.stream_stage_status(stream, patience_minutes=30, lateness="1 minute")
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        status.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out + "/c").trigger(availableNow=True).start().awaitTermination()
    add(1, "2024-01-01 00:00:00", "mesh", "running")
    run()
    add(2, "2024-01-01 00:10:00", "mesh", "completed")
    add(3, "2024-01-01 00:11:00", "slice", "running")
    run()
    add(4, "2024-01-01 02:00:00", "other", "running")
    run()
    rows = {(r.stage, r.status): r.seconds for r in spark.read.parquet(out + "/rows").collect()}
    assert rows[("mesh", "completed")] == 600.0 and ("slice", "overdue") in rows and ("mesh", "overdue") not in rows


def test_stages_share_python_calls(spark, folder):
    """Whole buckets are folded at once, in time order over batches, and equal an event-by-event fold."""
    import random
    rng = random.Random(3)
    known, want, number = pd.DataFrame({c: [] for c in ingest.STATUS_KEPT}, dtype=object), {}, 0
    for batch in range(20):
        rows = []
        for _ in range(30):
            number += 1
            rows.append((rng.choice("abcd"), rng.choice(["x", "y", None]), rng.choice(["running", "completed", "failed"]), rng.randint(0, 20) + batch * rng.randint(3, 8), number))
        for job, stage, status, at, event in sorted(rows, key=lambda r: (r[3], r[4])):
            now, started, seconds, seen, seen_id = want.get((job, stage), (None, None, None, -1, -1))
            if (at, event) <= (seen, seen_id):
                continue
            if status == "running":
                started, seconds = at, None
            elif now == "running":
                seconds = (at - started) / 1e6
            want[job, stage] = (status, started, seconds, at, event)
        told, known = ingest.fold_status(known, pd.DataFrame(rows, columns=["job", "stage", "status", "at", "event_id"]))
        assert {(r.job, r.stage) for r in told.itertuples()} == {r[:2] for r in rows}
        known = known[ingest.STATUS_KEPT]
        assert {(r.job, r.stage): (r.status, r.started, r.seconds, r.seen, r.seen_id) for r in known.itertuples()} == want
