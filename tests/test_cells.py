"""Cell operators against brute force on small grids, and independence of the tile size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.operators import buildings, focal, regions


def table(spark, grid, name="v", **more):
    rows = [
        {"cx": int(x), "cy": int(y), name: None if np.isnan(grid[y, x]) else float(grid[y, x]), **{k: v[y, x].item() for k, v in more.items()}}
        for y in range(grid.shape[0]) for x in range(grid.shape[1])]
    kinds = {"b": "boolean", "i": "int", "f": "double"}
    schema = ["cx bigint", "cy bigint", f"{name} double", *[f"{k} {kinds[v.dtype.kind]}" for k, v in more.items()]]
    return spark.createDataFrame(rows, ", ".join(schema))


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("cx", "cy", F.col(name).cast("double").alias("v")).collect():
        if 0 <= r.cx < shape[1] and 0 <= r.cy < shape[0] and r.v is not None:
            out[r.cy, r.cx] = r.v
    return out


def components(mask_equal):
    """Labels by flood fill; ``mask_equal`` is a grid of values, NaN for none."""
    h, w = mask_equal.shape
    label = -np.ones((h, w), dtype=int)
    n = 0
    for y in range(h):
        for x in range(w):
            if label[y, x] >= 0 or np.isnan(mask_equal[y, x]):
                continue
            stack = [(y, x)]
            label[y, x] = n
            while stack:
                a, b = stack.pop()
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < h and 0 <= d < w and label[c, d] < 0 and mask_equal[c, d] == mask_equal[y, x]:
                        label[c, d] = n
                        stack.append((c, d))
            n += 1
    return label


@pytest.mark.parametrize("tile", [5, 16])
def test_label_regions_is_flood_fill_for_any_tile(spark, tile):
    grid = np.random.default_rng(1).integers(0, 2, (21, 19)).astype(float)
    got = dense(regions.label_regions(table(spark, grid), "v", tile=tile), "label", grid.shape)
    want = components(grid)
    pairs = set(zip(got.ravel(), want.ravel()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_connected_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(500, 500)]
    got = {r.node: r.root for r in regions.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(7, 40)} == {7} and got[500] == 500


def test_vegetated_ground_keeps_bare_patches_of_a_lawn_and_not_a_dirt_lot(spark):
    lawn = np.ones((20, 20))
    lawn[4:6, 4:8] = 3
    assert np.isfinite(dense(regions.vegetated_ground(table(spark, lawn, "cls").withColumn("cls", F.col("cls").cast("int")), tile=8), "cls", lawn.shape)).all()
    lot = np.full((30, 30), 5.0)
    lot[0:20, 0:30] = 3
    lot[20:26, 0:30] = 1
    kept = np.isfinite(dense(regions.vegetated_ground(table(spark, lot, "cls").withColumn("cls", F.col("cls").cast("int")), tile=8), "cls", lot.shape))
    assert kept[20:26].all() and not kept[:20].any() and not kept[26:].any()


@pytest.mark.parametrize("tile", [7, 64])
def test_fill_nearest_is_exact_for_any_tile(spark, tile):
    rng = np.random.default_rng(2)
    grid = np.where(rng.random((24, 20)) < 0.06, rng.random((24, 20)), np.nan)
    got = dense(focal.fill_nearest(table(spark, grid), "v", 5, only_rows=True, tile=tile), "v", grid.shape)
    known = np.argwhere(~np.isnan(grid))
    for y in range(24):
        for x in range(20):
            d = [((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in known]
            best = min(d)
            assert (np.isnan(got[y, x])) if best[0] > 25 else got[y, x] == grid[best[1], best[2]]


def test_median3_reflects_at_the_edge(spark):
    grid = np.random.default_rng(3).random((9, 8))
    got = dense(focal.median3(table(spark, grid), "v", tile=4), "v", grid.shape)
    padded = np.pad(grid, 1, mode="symmetric")
    want = np.array([[np.median(padded[y:y + 3, x:x + 3]) for x in range(8)] for y in range(9)])
    assert np.allclose(got, want)


def test_canopy_relief_rolls_off_and_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(4)
    height, veg = rng.random((30, 30)) * 20 + 2, np.zeros((30, 30), dtype=int)
    veg[5:25, 5:25] = 1
    veg[14, :] = 0
    t = table(spark, height, "height_m", vegetation=veg, eligible=np.ones_like(veg))
    settings = dict(step_mm=0.5, scale=4000.0, smoothing_m=2.0, gap_mm=1.0, edge_mm=2.0, reach=8)
    small, large = (dense(focal.canopy_relief(t, tile=s, **settings), "relief_m", height.shape) for s in (8, 64))
    assert np.allclose(small, large)
    assert (small[14, 8:22] > 0).all() and small[0, 0] == 0 and small[5, 15] < small[10, 15]
    report = focal.canopy_report(focal.canopy_relief(t, tile=64, **settings)).first()
    assert report.closed_gap_cells > 0 and report.highest_m <= 36


@pytest.mark.parametrize("tile", [7, 64])
def test_fill_nearest_any_is_exact_at_any_distance(spark, tile):
    rng = np.random.default_rng(6)
    grid = np.where(rng.random((40, 30)) < 0.004, rng.random((40, 30)), np.nan)
    grid[30:, 20:] = np.nan
    t = table(spark, grid)
    got = dense(focal.fill_nearest_any(t, "v", near=3, tile=tile), "v", grid.shape)
    known = np.argwhere(~np.isnan(grid))
    for y in range(40):
        for x in range(30):
            _, a, b = min(((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in known)
            assert got[y, x] == grid[a, b]
    none = focal.fill_nearest_any(t.withColumn("v", F.lit(None).cast("double")), "v", tile=tile)
    assert none.count() == grid.size and none.where("v IS NOT NULL OR filled").count() == 0


def test_canopy_far_from_any_measured_height_gets_relief(spark):
    height = np.full((12, 120), np.nan)
    height[6, 4] = 10.0
    green = np.ones(height.shape, dtype=int)
    t = table(spark, height, "height_m", vegetation=green, eligible=green)
    relief = dense(focal.canopy_relief(t, step_mm=0.5, scale=4000.0, smoothing_m=2.0, gap_mm=1.0, edge_mm=1.0, tile=16), "relief_m", height.shape)
    assert np.allclose(relief[5:7, 100], relief[5:7, 40]) and (relief[5:7, 40:100] > 9).all()


def test_absorb_thin_removes_slivers_and_keeps_protected_cells(spark):
    m = np.zeros((20, 20))
    m[:, 9] = 1
    m[3:9, 12:18] = 2
    protected = np.zeros((20, 20), dtype=int)
    protected[15, 9] = 1
    t = table(spark, m, "material", height_mm=m + 10.0, protected=protected).withColumn("material", F.col("material").cast("int"))
    done = focal.absorb_thin(t, nozzle_mm=1.0, step_mm=0.5, tile=8)
    got, height = dense(done, "material", m.shape), dense(done, "height_mm", m.shape)
    assert got[15, 9] == 1 and (np.delete(got[:, 9], [14, 15, 16]) == 0).all() and (got[4:8, 13:17] == 2).all()
    assert (height == got + 10).all()


def test_absorb_thin_reaches_passing_cells_at_any_distance(spark):
    cells = [(x, 0, 1, 11.0) for x in (5000, 9000, 10**6)] + [(x, y, 2, 12.0) for x in range(4) for y in range(4)]
    t = spark.createDataFrame([(*c, 0) for c in cells], "cx bigint, cy bigint, material int, height_mm double, protected int")
    done = {(r.cx, r.cy): (r.material, r.height_mm, r.moved) for r in focal.absorb_thin(t, nozzle_mm=1.0, step_mm=0.5, tile=8).collect()}
    assert all(done[x, 0] == (2, 12.0, True) for x in (5000, 9000, 10**6)) and len(done) == len(cells)


def test_slack_cells_take_their_own_part_at_any_distance(spark):
    cells = spark.createDataFrame([(x, 0, 1.0, 7) for x in range(40)], "cx bigint, cy bigint, ground_m double, fid bigint")
    prints = spark.createDataFrame([(7, 9.0)], "fid bigint, recorded_m double")
    roofs = spark.createDataFrame([], "cx bigint, cy bigint, roof_m double, roof_owner bigint")
    parts = spark.createDataFrame([(0, 0, 6.0, 7)], "cx bigint, cy bigint, part_m double, part_owner bigint")
    got = buildings.building_heights(cells, prints, roofs, parts).collect()
    assert len(got) == 40 and all((r.top_m, r.source) == (7.0, "parts") for r in got)


def test_diagonal_contacts_are_gone(spark):
    m = np.random.default_rng(5).integers(0, 2, (16, 16)).astype(float)
    t = table(spark, m, "material", height_mm=m, protected=np.zeros((16, 16), dtype=int)).withColumn("material", F.col("material").cast("int"))
    got = dense(focal.diagonal_contacts(t, rounds=20, tile=8), "material", m.shape)
    a, b, c, d = got[:-1, :-1], got[:-1, 1:], got[1:, :-1], got[1:, 1:]
    assert not ((a == d) & (b == c) & (a != b)).any()


def test_flat_zones_settle_noise_and_never_move_a_layer(spark):
    rng = np.random.default_rng(6)
    z = 1.0 + rng.random((12, 12)) * 0.04
    z[:, 6:] += 0.75
    t = table(spark, z, "z_mm").withColumn("plate", F.lit("a"))
    got = dense(regions.flat_zones(t, "z_mm", 0.2, 0.2, tile=5), "settled_mm", z.shape)
    assert len(np.unique(got.round(6))) == 2 and np.abs(got - z).max() < 0.2
    whole = dense(regions.flat_zones(t, "z_mm", 0.2, 0.2, tile=64), "settled_mm", z.shape)
    assert np.allclose(got, whole)


@pytest.mark.parametrize("seed,step", [(1, None), (2, 0.05), (3, 0.02)])
def test_zones_join_by_smallest_difference(seed, step):
    z = np.random.default_rng(seed).random((9, 11))
    z = z if step is None else np.round(z / step) * step
    zone = np.arange(z.size).reshape(z.shape)
    near = [((y, x), (y + a, x + b)) for y in range(9) for x in range(11) for a, b in ((0, 1), (1, 0)) if y + a < 9 and x + b < 11]
    for p, q in sorted(near, key=lambda e: abs(z[e[0]] - z[e[1]])):
        both = (zone == zone[p]) | (zone == zone[q])
        if np.ptp(z[both]) < 0.2:
            zone[both] = zone[p]
    key = (np.arange(9)[:, None] * regions.WIDE + np.arange(11)).ravel()
    low, high = regions._zone_ranges(key, z.ravel(), 0.2)
    for k, n in enumerate(zone.ravel()):
        assert (low[k], high[k]) == (z[zone == n].min(), z[zone == n].max())


def test_suppress_peaks_is_the_greedy_choice(spark):
    rng = np.random.default_rng(7)
    spots = [("p", float(x), float(y), float(h)) for x, y, h in zip(rng.random(120) * 50, rng.random(120) * 50, rng.permutation(120))]
    got = {r.peak_mm for r in regions.suppress_peaks(spark.createDataFrame(spots, "plate string, x double, y double, peak_mm double"), 6.0).collect()}
    kept = []
    for _, x, y, h in sorted(spots, key=lambda s: -s[3]):
        if all(np.hypot(x - a, y - b) >= 6.0 for a, b, _ in kept):
            kept.append((x, y, h))
    assert got == {h for _, _, h in kept}


def test_narrow_peaks_finds_the_tank_on_a_broad_roof(spark):
    h, on = np.full((30, 30), 2.0), np.ones((30, 30), dtype=bool)
    h[5:25, 5:25] = 20.0
    h[10:12, 14:16] = 23.0
    t = table(spark, h, "height_mm", material=np.zeros((30, 30), dtype=int), building=on).withColumn("plate", F.lit("a"))
    got = regions.narrow_peaks(t, step_mm=0.5, diameter_mm=1.0, band_mm=2.0, sweep_mm=0.5, tile=8).collect()
    assert [(r.x, r.y, r.peak_mm) for r in got] == [(7.5, 5.5, 23.0)]


def test_nearest_far_over_scattered_districts(spark, monkeypatch):
    """Forty districts far apart, sources in a few of them: exact, ties included, and pairs of tiles as many as tiles, not their square."""
    rng = np.random.default_rng(4)
    places = rng.integers(-40_000, 40_000, (40, 2))
    sides = np.arange(0, 30, 3)
    cells = [(int(x + i), int(y + j)) for x, y in places for i in sides for j in sides]
    cells = sorted(set(cells) | {(0, 0), (10, 0), (0, 10), (10, 10), (5, 5)})
    known = [c for n, c in enumerate(cells) if n % 157 == 0 and c != (5, 5)] + [(0, 0), (10, 0), (0, 10), (10, 10)]
    open_cells = [c for c in cells if c not in set(known)]
    table = lambda rows: spark.createDataFrame(rows, "cx bigint, cy bigint")
    asked, given = table(open_cells), table(known)
    for leaf in (64, 7):
        monkeypatch.setattr(focal, "LEAF", leaf)
        got = {(r.cx, r.cy): (r.sx, r.sy) for r in focal.nearest_far(asked, given).collect()}
        assert len(got) == len(open_cells)
        for x, y in open_cells:
            assert got[x, y] == min(known, key=lambda s: ((s[0] - x) ** 2 + (s[1] - y) ** 2, s[1], s[0]))
        tiles, sources = focal._boxes(asked, "qx", "qy"), focal._boxes(given, "sx", "sy")
        assert focal._tile_pairs(tiles, sources, focal._tile_extent(tiles, "qx", "qy"), focal._tile_extent(sources, "sx", "sy")).count() < 6 * tiles.count()
    assert focal.nearest_far(asked, given.limit(0)).count() == 0 and focal.nearest_far(asked.limit(0), given).count() == 0
