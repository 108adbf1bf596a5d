"""Checks that the form of a plan grows with the tables: what is joined whole, what is dealt out, what one task gets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cityloom.functions import tables
from cityloom.operators import buildings, ordered, roads, spatial, stats
from cityloom.plans import composite, load
from cityloom.plans import roads as plan_roads
from cityloom.sources import printlogs, tiles
from cityloom.sources.derived import Inputs
from cityloom.streaming import ingest


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark, rows):
    return spark.createDataFrame([(i, i * 5.0, 0.0, i * 5.0 + 4, 4.0) for i in range(rows)], "id long, minx double, miny double, maxx double, maxy double")


def test_tables_cut_into_squares_are_never_broadcast(spark):
    few = boxes(spark, 20)
    pairs = spatial.bbox_join(few, few, 4.0)
    assert pairs.where("a_id = b_id").count() == 20
    asked = few.select("id", F.col("minx").alias("x"), F.col("miny").alias("y"), F.lit(1.0).alias("fallback"))
    near = spatial.nearest_within(asked, asked.withColumnRenamed("fallback", "value"), 3, 40.0, 3.0)
    square = few.withColumn("edges", F.array(*[F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2")) for a, b, c, d in (
        ("minx", "miny", "maxx", "miny"), ("maxx", "miny", "maxx", "maxy"), ("maxx", "maxy", "minx", "maxy"), ("minx", "maxy", "minx", "miny"))]))
    held = spatial.points_in_polygons(asked.withColumn("x", F.col("x") + 1).withColumn("y", F.col("y") + 1), square, 4.0)
    assert held.count() == 20
    for joined in (pairs, near, held):
        assert "SortMergeJoin [bx" in plan_of(joined)


def customers(spark, folder, rows):
    """A data folder with a customer table of many short rows in one small file."""
    spark.range(1, rows + 1).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(0).alias("c_nationkey"), F.lit(10.0).alias("c_acctbal"), F.lit("s").alias("c_mktsegment")
    ).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_rows_of_a_small_file_are_dealt_out(spark, tmp_path):
    inputs = Inputs(spark, customers(spark, tmp_path, 25_000))
    assert inputs.polygons.rdd.getNumPartitions() == 3
    assert inputs.polygons.count() == 25_000
    assert inputs.polygons.where("id = 7").select("minx").first() == inputs._view("footprints").where("id = 7").select("minx").first()


def test_touched_cells_are_not_compared_pair_by_pair(spark):
    square = boxes(spark, 4).withColumn("edges", F.array(*[F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2")) for a, b, c, d in (
        ("minx", "miny", "maxx", "miny"), ("maxx", "miny", "maxx", "maxy"), ("maxx", "maxy", "minx", "maxy"), ("minx", "maxy", "minx", "miny"))]))
    out = spatial.rasterize(square, 2.0, "all_touched")
    assert "array_distinct" not in plan_of(out)
    want = {}
    for i in range(4):
        for cx in range(int(i * 5 // 2), int((i * 5 + 4) // 2) + 1):
            for cy in range(0, 3):
                want[cx, cy] = i
    assert {(r.cx, r.cy): r.id for r in out.collect()} == want


def test_refreshed_tiles_have_no_folder_each_and_keep_their_latest_rows(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 40).alias("tile_x"), F.lit(0).cast("bigint").alias("tile_y"), "id", F.lit(1.0).alias("v"))
    path = str(tmp_path / "refreshed")
    ingest.refresh_tiles(rows, path, "v1")
    changed = rows.withColumn("v", F.when(F.col("id") == 7, 2.0).otherwise(F.col("v")))
    ingest.refresh_tiles(changed, path, "v1")
    assert sorted(p.name for p in (tmp_path / "refreshed" / "rows").iterdir() if p.is_dir()) == ["written=0", "written=1"]
    now = ingest.refreshed_rows(spark, path)
    assert now.count() == 400 and sorted(now.columns) == sorted(rows.columns)
    assert [r.id for r in now.where("v = 2.0").collect()] == [7]


def test_models_without_a_source_stay_out_of_the_join(spark):
    models = spark.createDataFrame([("a.3mf",), ("a.gcode.3mf",), ("b.gcode.3mf",), (None,)], "model string")
    left = printlogs.drop_shadowed_models(models)
    assert sorted(r.model or "" for r in left.collect()) == ["", "a.3mf", "b.gcode.3mf"]
    assert "Union" in plan_of(left)


def test_grids_of_outlines_are_dealt_out(spark, tmp_path):
    folder = customers(spark, tmp_path, 25_000)
    assert "REPARTITION_BY_NUM" in plan_of(load().QUERIES["a22_grid_cell_coverage"](spark, folder))


def test_only_crossed_features_are_measured(spark, tmp_path):
    features = Inputs(spark, customers(spark, tmp_path, 50)).polygons.select("id", F.lit("k").alias("kind"), "name", "edges", *spatial.BOX)
    seam = spark.createDataFrame([(1, 0, 0.0, 500.0, 1000.0, 500.0)], "seam_id long, pos int, x1 double, y1 double, x2 double, y2 double")
    plan = plan_of(roads.seam_crossings(seam, features, 64.0, 2.5))
    assert plan.index("ArrowEvalPython") < plan.index("Join")


def test_roofs_are_judged_after_they_are_dealt_out(spark):
    roofs = boxes(spark, 9).select(
        F.col("id").alias("owner_id"), F.lit(2.0).alias("z_max_ft"), F.lit(1.0).alias("z_min_ft"),
        F.array(*[F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2")) for a, b, c, d in (
            ("minx", "miny", "maxx", "miny"), ("maxx", "miny", "maxx", "maxy"), ("maxx", "maxy", "minx", "maxy"), ("minx", "maxy", "minx", "miny"))]).alias("edges"),
        F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(z).alias("z")) for x, y, z in (
            ("minx", "miny", 1.0), ("maxx", "miny", 2.0), ("maxx", "maxy", 2.0), ("minx", "maxy", 1.0))]).alias("ring"))
    out = buildings.roof_surface(roofs.repartition(3, "owner_id"), 4.0)
    assert out.count() > 0
    assert "aggregate(" not in plan_of(out).split("REPARTITION_BY_NUM")[1]


def test_median_slopes_of_many_lines_at_once():
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 9, 2 * n) / 4.0 for n in (0, 1, 2, 3, 3, 7, 7, 20, 64, 90)] + [np.array([1.0, 2.0, 1.0, 5.0])]
    got = stats.median_slopes(pd.Series(lines))
    want = [stats.median_slope(r[0::2], r[1::2]) if len(r) > 2 else np.nan for r in lines]
    assert np.array_equal(got, np.array(want), equal_nan=True)


def test_a_line_fit_hands_many_lines_to_python_at_once(spark):
    samples = spark.range(60).select((F.col("id") % 6).alias("line_id"), (F.col("id") / 60).alias("place"), (F.col("id") * 2.0).alias("z"))
    out = samples.groupBy("line_id").agg(stats.theil_sen(F.col("place"), F.col("z")).alias("slope"))
    assert [round(r.slope, 6) for r in out.collect()] == [120.0] * 6
    assert "AggregateInPandas" not in plan_of(out) and "ArrowAggregatePython" not in plan_of(out)


def test_streamed_files_grow_in_number_not_in_size(spark):
    class Many:
        def __init__(self):
            self.spark = spark

        def base(self, name):
            return spark.range(12_000_000)

    path = composite._files(Many(), spark.range(5_000), "many", "id", "events")
    assert len(spark.read.parquet(path).inputFiles()) == 12


def test_tiles_have_no_folder_each(spark, tmp_path):
    path = tmp_path / "tiles"
    tiles.write_tiles(boxes(spark, 60).withColumn("source_order", F.col("id")), str(path), 10.0)
    assert not [p for p in path.iterdir() if p.is_dir()]
    near = tiles.read_tiles(spark, str(path), (100.0, 0.0, 112.0, 4.0), 10.0)
    assert sorted(r.id for r in near.collect()) == [20, 21, 22]


def test_fixture_cells_are_never_broadcast(spark):
    square = [F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2")) for a, b, c, d in (
        ("minx", "miny", "maxx", "miny"), ("maxx", "miny", "maxx", "maxy"), ("maxx", "maxy", "minx", "maxy"), ("minx", "maxy", "minx", "miny"))]
    stand = boxes(spark, 5).withColumns({"kind": F.lit("tank"), "measured_top_m": F.lit(9.0), "edges": F.array(*square)})
    cells = spark.range(20).select(F.col("id").alias("cx"), F.lit(0).cast("bigint").alias("cy"), F.lit(3.0).alias("top_m"), F.lit(4.0).alias("upper_m"))
    out = buildings.fixture_heights(stand, cells, 2.0, 4.0, 0.8)
    assert out.count() == 5 and "SortMergeJoin [cx" in plan_of(out)


def test_pages_of_features_are_dealt_out(spark, tmp_path):
    folder = customers(spark, tmp_path, 25_000)
    out = load().QUERIES["s8_ingest_feature_collection"](spark, folder)
    assert "REPARTITION_BY_NUM" in plan_of(out) and out.count() == 25_000


def test_the_table_function_of_cells_gets_dealt_out_rows(spark, tmp_path):
    folder = customers(spark, tmp_path, 25_000)
    assert "REPARTITION_BY_NUM" in plan_of(load().QUERIES["x1_cells_of_polygon"](spark, folder))


def test_samples_of_lines_are_merged_with_cells(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0, 80.0, 0.0)], "line_id long, pos int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.range(20).select(F.col("id").alias("cx"), F.lit(0).cast("bigint").alias("cy"), F.lit(1).alias("cls"))
    out = spatial.sample_lines(line, cells, 4.0)
    assert out.count() == 20 and "SortMergeJoin [cx" in plan_of(out)


def test_fixture_cells_of_the_map_are_worked_out_once_and_merged(spark):
    square = [F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2")) for a, b, c, d in (
        ("minx", "miny", "maxx", "miny"), ("maxx", "miny", "maxx", "maxy"), ("maxx", "maxy", "minx", "maxy"), ("minx", "maxy", "minx", "miny"))]
    stand = boxes(spark, 9).withColumns({"kind": F.lit("tank"), "measured_top_m": 9.0 + F.col("id"), "edges": F.array(*square)})
    roofs = spark.range(-4, 8).select(F.col("id").alias("cx"), F.lit(0).cast("bigint").alias("cy"), F.lit(3.0).alias("top_m"), F.lit(4.0).alias("upper_m"))
    out = composite.fixed_cells(stand, roofs)
    assert "exists(" not in plan_of(out) and "SortMergeJoin [id" in plan_of(out)
    tops = buildings.fixture_heights(stand, roofs, 8.0, 20.0, 0.8).select("id", F.col("top_m").alias("fixture_m"))
    want = buildings.fixture_cells(stand, 8.0, 20.0).join(tops, "id").join(roofs.select("cx", "cy"), ["cx", "cy"]).groupBy("cx", "cy").agg(F.max("fixture_m").alias("top_m"))
    assert sorted(out.collect()) == sorted(want.collect()) != []


def test_street_symbols_read_written_segments(spark, tmp_path):
    folder = customers(spark, tmp_path, 40)
    spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40 + 1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
                            F.current_timestamp().alias("o_orderdate"), F.lit("1").alias("o_orderpriority")).write.parquet(f"{folder}/orders.parquet")
    once = plan_roads.way_segments(Inputs(spark, folder))
    out = plan_roads.road_symbols(Inputs(spark, folder), once.limit(0))
    assert out.count() == 0 and plan_roads.road_symbols(Inputs(spark, folder)).count() == 40


def test_cell_runs_of_many_outlines_equal_the_table_function(spark, tmp_path):
    rng = np.random.default_rng(8)
    ring = lambda p: [dict(zip(("x1", "y1", "x2", "y2"), (*map(float, a), *map(float, b)))) for a, b in zip(p, np.roll(p, -1, axis=0))]
    outlines = [ring(rng.integers(-40, 40, (n, 2)) / 4) for n in (3, 4, 5, 9, 30)] + [None, []]
    outlines.insert(2, ring(rng.integers(-40, 40, (4, 2)) / 4)[:3])  # left open: its neighbours must not suffer
    for size in (0.5, 2.0):
        runs = tables.cell_runs(pa.array(outlines, pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))), pa.array([size] * len(outlines)))
        got = [[(x, r["cy"]) for r in line for x in range(r["low"], r["high"] + 1)] for line in runs.to_pylist()]
        assert got == [list(tables.CellsOfPolygon().eval(o, size)) for o in outlines]
    plan = plan_of(load().QUERIES["x1_cells_of_polygon"](spark, customers(spark, tmp_path, 25)))
    assert "PythonUDTF" not in plan and "cell_runs" in plan


def test_spans_that_tie_are_counted_in_the_island_they_lie_in(spark):
    rows = [(1, 0.0, 1.0)] * 3 + [(1, 5.0, 6.0)] * 4 + [(1, 5.5, 7.0), (2, 5.0, 6.0)]
    spans = spark.createDataFrame(rows, "route int, s double, e double")
    assert sorted(tuple(r) for r in ordered.merge_spans(spans, "route", "s", "e", 2.0).collect()) == [(1, 0.0, 1.0, 3), (1, 5.0, 7.0, 5), (2, 5.0, 6.0, 1)]


def test_points_along_lines_need_no_python_call_for_each(spark, tmp_path):
    folder = customers(spark, tmp_path, 4)
    spark.range(40).select(F.col("id").alias("o_orderkey"), (F.col("id") % 4 + 1).alias("o_custkey"), F.current_timestamp().alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    out = load().QUERIES["x2_densify"](spark, folder)
    assert "Python" not in plan_of(out) and out.count() == 4


def test_a_line_fit_shuffles_its_samples_once(spark):
    rng = np.random.default_rng(15)
    rows = [(n, float(t), float(2 * t + rng.random() + 30 * (rng.random() < 0.1))) for n in range(1, 41) for t in rng.integers(0, 20, n) / 19.0]
    rows += [(None, 0.1, 4.0), (None, 0.2, 6.0), (7, None, 1.0), (8, 0.5, None)]
    out = stats.robust_line_fit(spark.createDataFrame(rows, "line_id int, place double, z double"))
    plan = plan_of(out)
    assert "Join" not in plan and plan.count("Exchange ") == 1
    got = {r.line_id: r for r in out.collect()}
    assert len(got) == 41 and (got[None].start_z, got[None].samples, got[None].method) == (5.0, 2, "median")
    for n in range(1, 41):
        t, z = np.array([(b, c) for a, b, c in rows if a == n and b is not None and c is not None]).T
        if n < 3 or np.ptp(t) < 0.2:
            assert (got[n].start_z, got[n].end_z, got[n].rejected, got[n].method) == (np.median(z), np.median(z), 0, "median")
            continue
        i, j = np.triu_indices(n, 1)
        far = t[i] != t[j]
        slope = np.median((z[i] - z[j])[far] / (t[i] - t[j])[far])
        start = np.median(z - slope * t)
        dev = np.abs(z - slope * t - start)
        near = dev <= max(0.3, np.median(dev) * 3.5 * 1.4826)
        if near.sum() >= 3 and np.ptp(t[near]) >= 0.2:
            t, z = t[near], z[near]
            slope, start = np.polyfit(t, z, 1)
        edge = max(0.5, np.ptp(z) * 0.25)
        ends = np.clip([start, start + slope], z.min() - edge, z.max() + edge)
        assert np.allclose([got[n].start_z, got[n].end_z], ends)
        assert (got[n].samples, got[n].rejected, got[n].method) == (len(z), n - len(z), "fitted")


def test_a_road_width_meets_tiles_of_roadbed(spark):
    rng = np.random.default_rng(20)
    ends = [(-300.0, 5.0, 300.0, 5.0), (7.0, -250.0, 7.0, 250.0)] + [tuple(map(float, rng.uniform(-300, 300, 4))) for _ in range(30)]
    lines = [(n, 0, *e, 0.0, float(np.hypot(e[2] - e[0], e[3] - e[1]))) for n, e in enumerate(ends)]
    segments = spark.createDataFrame([(*row, row[-1]) for row in lines], "line_id int, pos int, x1 double, y1 double, x2 double, y2 double, start_length double, length double, line_length double")
    for size, share in ((1.0, 0.9), (4.0, 0.7)):
        side = int(500 / size)
        bed = {(int(x), int(y)) for x, y in np.argwhere(rng.random((2 * side, 2 * side)) < share) - side if abs(x) * size < 330}
        cells = spark.createDataFrame(pd.DataFrame(sorted(bed), columns=["cx", "cy"]))
        out = roads.road_width_samples(segments, cells, size)
        assert "Join [_tx" in plan_of(out) and "Join [cx" not in plan_of(out)
        got = {(r.line_id, r.place): r.width_m for r in out.collect()}
        foot, want = 0.3048006096012192, {}
        steps = int(60 / foot / size)
        for n, _, x1, y1, x2, y2, _, total in lines:
            places = min(max(int(np.ceil(total / (15 / foot))), 3), 30)
            ux, uy = (x2 - x1) / total, (y2 - y1) / total
            for i in range(places):
                at = (0.1 + i * 0.8 / (places - 1)) * total
                runs, run = [], []
                for k in range(-steps, steps + 2):
                    cell = (int(np.floor((x1 + ux * at - uy * k * size) / size)), int(np.floor((y1 + uy * at + ux * k * size) / size)))
                    if k <= steps and cell in bed:
                        run.append(k)
                    elif run:
                        runs, run = [*runs, run], []
                wide = [len(r) * size * foot for r in runs if min(map(abs, r)) * size <= max(1.5 / foot, size / 2)]
                if wide and 2.5 <= max(wide) <= 60:
                    want[n, i] = max(wide)
        assert got == pytest.approx(want) and len(want) > 50
