"""Neighbourhood operators on cell tables.

Cells are unique per lattice position, so a square tile widened by a halo holds at most ``(tile + 2 * halo)`` squared
rows, however crowded the source was: that bounds every group handed to a task. A cell is copied to each tile whose
halo holds it, a numpy kernel computes the tile, and only the tile's own cells are returned, so results do not depend
on the tile size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import floor_div
from ..runtime import cut

TILE = 256
FAR = 1 << 40


@dataclass
class Patch:
    """One tile with its halo as dense arrays: rows run along ``cy``, columns along ``cx``."""

    x0: int
    y0: int
    present: np.ndarray
    values: dict[str, np.ndarray]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name]

    def flag(self, name: str) -> np.ndarray:
        return self.present & (np.nan_to_num(self.values[name]) != 0)


def with_halo(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each cell once per tile whose halo holds it, with ``tile_x`` and ``tile_y``."""
    def tiles(c: str):
        return F.explode(F.sequence(floor_div(F.col(c) - halo, tile), floor_div(F.col(c) + halo, tile)))

    return cells.withColumn("tile_x", tiles("cx")).withColumn("tile_y", tiles("cy"))


def tile_map(
    cells: DataFrame, values: list[str], halo: int, kernel: Callable[[Patch], tuple[np.ndarray, dict[str, np.ndarray]]],
    out: dict[str, str], tile: int = TILE, by: list[str] | None = None,
) -> DataFrame:
    """Run ``kernel`` on every tile. It returns a mask of cells to keep and one array per output column.

    Value columns arrive as doubles with NaN for NULL; NaN goes back as NULL. ``by`` keeps separate layers apart.
    """
    by = by or []
    fields = ", ".join([f"`{b}` {dict(cells.dtypes)[b]}" for b in by] + ["cx bigint", "cy bigint"] + [f"`{n}` {t}" for n, t in out.items()])
    whole = {"bigint", "int"}
    size = tile + 2 * halo

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(key[-2]), int(key[-1])
        x0, y0 = tx * tile - halo, ty * tile - halo
        col, row = rows["cx"].to_numpy() - x0, rows["cy"].to_numpy() - y0
        present = np.zeros((size, size), dtype=bool)
        present[row, col] = True
        dense = {}
        for name in values:
            grid = np.full((size, size), np.nan)
            grid[row, col] = rows[name].to_numpy(dtype=float, na_value=np.nan)
            dense[name] = grid
        mask, results = kernel(Patch(x0, y0, present, dense))
        inner = np.zeros_like(present)
        inner[halo:halo + tile, halo:halo + tile] = True
        r, c = np.nonzero(mask & inner)
        frame = {b: [key[i]] * len(r) for i, b in enumerate(by)}
        frame |= {"cx": c + x0, "cy": r + y0}
        for name, kind in out.items():
            picked = results[name][r, c]
            if kind in whole:
                frame[name] = pd.array(np.where(np.isnan(picked.astype(float)), 0, picked).astype("int64"), dtype="Int64")
                frame[name][np.isnan(picked.astype(float))] = pd.NA
            elif kind == "boolean":
                frame[name] = picked.astype(bool)
            else:
                frame[name] = picked.astype(float)
        return pd.DataFrame(frame)

    spread = with_halo(cells.select(*by, "cx", "cy", *[F.col(v).cast("double").alias(v) for v in values]), tile, halo)
    result = spread.groupBy(*by, "tile_x", "tile_y").applyInPandas(run, fields)
    doubles = [n for n, t in out.items() if t == "double"]
    return result.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in doubles}) if doubles else result


def nearest_known(known: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance, row and column of the nearest known cell; ties go to the smaller row, then column."""
    height, width = known.shape
    row = np.arange(height)[:, None]
    above = np.maximum.accumulate(np.where(known, row, -FAR), axis=0)
    below = np.minimum.accumulate(np.where(known, row, FAR)[::-1], axis=0)[::-1]
    up = row - above <= below - row
    source = np.where(up, above, below)
    gap = np.minimum(np.abs(source - row), reach + 1).astype(np.int64)
    best = np.full(known.shape, FAR, dtype=np.int64)
    best_row, best_col = np.full(known.shape, FAR, dtype=np.int64), np.zeros(known.shape, dtype=np.int64)
    for dx in range(-reach, reach + 1):
        here = slice(max(0, -dx), width - max(0, dx))
        there = slice(max(0, dx), width - max(0, -dx))
        d2 = dx * dx + gap[:, there] ** 2
        better = (gap[:, there] <= reach) & ((d2 < best[:, here]) | ((d2 == best[:, here]) & (source[:, there] < best_row[:, here])))
        best[:, here] = np.where(better, d2, best[:, here])
        best_row[:, here] = np.where(better, source[:, there], best_row[:, here])
        best_col[:, here] = np.where(better, (np.arange(width)[there])[None, :], best_col[:, here])
    best[best > reach * reach] = FAR
    return best, best_row, best_col


def disk(radius: float) -> np.ndarray:
    span = int(np.ceil(radius))
    r = np.arange(-span, span + 1)
    return r[:, None] ** 2 + r[None, :] ** 2 <= radius * radius + 1e-9


def dilate(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    span = shape.shape[0] // 2
    padded = np.pad(mask, span)
    out = np.zeros_like(mask)
    for dy, dx in np.argwhere(shape):
        out |= padded[dy:dy + mask.shape[0], dx:dx + mask.shape[1]]
    return out


def erode(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    span = shape.shape[0] // 2
    padded = np.pad(mask, span)
    out = np.ones_like(mask)
    for dy, dx in np.argwhere(shape):
        out &= padded[dy:dy + mask.shape[0], dx:dx + mask.shape[1]]
    return out


def fill_nearest(cells: DataFrame, value: str, reach: int, only_rows: bool = False, keep: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Missing values take the nearest observed one within ``reach`` cells; ``filled`` marks them.

    With ``only_rows`` just the table's own rows are filled, otherwise every lattice cell within reach. ``keep`` names
    other columns a filled row takes over from the cell its value came from.
    """
    extra = keep or []

    def kernel(p: Patch):
        known = ~np.isnan(p[value])
        d2, sy, sx = nearest_known(known, reach)
        found = d2 < FAR
        sy, sx = np.where(found, sy, 0), np.where(found, sx, 0)
        result = {value: np.where(found, p[value][sy, sx], np.nan), "filled": found & ~known, "d2": np.where(found, d2, np.nan)}
        for name in extra:
            result[name] = np.where(found, p[name][sy, sx], np.nan)
        return (p.present if only_rows else found), result

    types = {value: "double", "filled": "boolean", "d2": "bigint", **{n: "double" for n in extra}}
    return tile_map(cells, [value, *extra], reach, kernel, types, tile)


BOX = ["x0", "x1", "y0", "y1"]
#: Edge of the tiles that the far search pairs, and how many of them make one of the next level.
LEAF, BRANCH = 64, 4


def _boxes(cells: DataFrame, x: str, y: str) -> DataFrame:
    """Tiles ``x, y`` that hold cells, with the box of those cells."""
    return cells.groupBy(floor_div(F.col("cx"), LEAF).alias(x), floor_div(F.col("cy"), LEAF).alias(y)).agg(
        *[f(c).alias(f"{x}_{n}") for n, f, c in zip(BOX, (F.min, F.max) * 2, ("cx", "cx", "cy", "cy"))])


def _coarser(leaves: DataFrame, x: str, y: str, level: int) -> DataFrame:
    """The boxes of a level, each joined to its parent's place ``{x}_up, {y}_up``."""
    side = BRANCH**level
    nodes = leaves if not level else leaves.groupBy(floor_div(F.col(x), side).alias(x), floor_div(F.col(y), side).alias(y)).agg(
        *[f(f"{x}_{n}").alias(f"{x}_{n}") for n, f in zip(BOX, (F.min, F.max) * 2)])
    return nodes.withColumns({f"{c}_up": floor_div(F.col(c), BRANCH) for c in (x, y)})


def _tile_extent(tiles: DataFrame, x: str, y: str) -> tuple | None:
    """Least and greatest place of the tiles along both axes."""
    found = tiles.agg(*[f(c) for c in (x, y) for f in (F.min, F.max)]).first()
    return None if found[0] is None else tuple(found)


def _tile_pairs(open_tiles: DataFrame, known_tiles: DataFrame, q: tuple, s: tuple) -> DataFrame:
    """``qx, qy, sx, sy``: for every tile with open cells the tiles that may hold the nearest source of one of them.

    From the whole map down, level by level: a tile's open cells have a source no further than the furthest points of its
    nearest box, so boxes that begin beyond that fall away with all they hold. Rounds grow with the log of the extent.
    """
    level = 0
    while any((high // BRANCH**level) - (low // BRANCH**level) > 1 for low, high in (q[:2], q[2:], s[:2], s[2:])):
        level += 1
    across = [range(low // BRANCH**level, high // BRANCH**level + 1) for low, high in (q[:2], q[2:], s[:2], s[2:])]
    top = [(a, b, c, d) for a in across[0] for b in across[1] for c in across[2] for d in across[3]]  # sixteen at most
    pairs = open_tiles.sparkSession.createDataFrame(top, "qx_up bigint, qy_up bigint, sx_up bigint, sy_up bigint")
    pairs = pairs.select(*[floor_div(F.col(c), BRANCH).alias(c) for c in pairs.columns]).distinct()
    gap = lambda a: F.greatest(F.lit(0), F.col(f"sx_{a}0") - F.col(f"qx_{a}1"), F.col(f"qx_{a}0") - F.col(f"sx_{a}1"))
    span = lambda a: F.greatest(F.col(f"sx_{a}1") - F.col(f"qx_{a}0"), F.col(f"qx_{a}1") - F.col(f"sx_{a}0"))
    square = lambda f: f("x") * f("x") + f("y") * f("y")
    while True:
        both = pairs.join(_coarser(open_tiles, "qx", "qy", level), ["qx_up", "qy_up"]).join(_coarser(known_tiles, "sx", "sy", level), ["sx_up", "sy_up"])
        sure = F.min(square(span)).over(Window.partitionBy("qx", "qy"))
        pairs = both.withColumn("sure", sure).where(square(gap) <= F.col("sure")).select("qx", "qy", "sx", "sy")
        if not level:
            return pairs
        if level % 3 == 0:
            pairs = cut(pairs, "pairs")
        level, pairs = level - 1, pairs.toDF("qx_up", "qy_up", "sx_up", "sy_up")


def nearest_far(open_cells: DataFrame, known: DataFrame) -> DataFrame:
    """``cx, cy, sx, sy``: the nearest known cell of each open one, at any distance; ties go to the smaller row, then column.

    Both are written tables of ``cx, cy``. Tiles are paired first; a tile shows another only its border: the first known
    cell of each row or column that faces it, so a pair is ``LEAF`` sources at most. A tile of open cells is paired with
    those tiles alone that lie about as far as its nearest source. Without a known cell no row comes back.
    """
    open_tiles, known_tiles = cut(_boxes(open_cells, "qx", "qy"), "open-tiles"), cut(_boxes(known, "sx", "sy"), "known-tiles")
    q, s = _tile_extent(open_tiles, "qx", "qy"), _tile_extent(known_tiles, "sx", "sy")
    if q is None or s is None:
        return open_cells.select("cx", "cy", F.lit(0).cast("bigint").alias("sx"), F.lit(0).cast("bigint").alias("sy")).limit(0)
    pairs = cut(_tile_pairs(open_tiles, known_tiles, q, s), "tile-pairs")
    placed = known.select(floor_div(F.col("cx"), LEAF).alias("sx"), floor_div(F.col("cy"), LEAF).alias("sy"), "cx", "cy")
    rows = placed.groupBy("sx", "sy", "cy").agg(F.min("cx").alias("low"), F.max("cx").alias("high"))
    columns = placed.groupBy("sx", "sy", "cx").agg(F.min("cy").alias("low"), F.max("cy").alias("high"))
    tile = ["sx", "sy"]
    beside = pairs.where("qx <> sx").join(rows, tile).select("qx", "qy", F.when(F.col("qx") < F.col("sx"), F.col("low")).otherwise(F.col("high")).alias("cx"), "cy")
    above = pairs.where("qx = sx AND qy <> sy").join(columns, tile).select("qx", "qy", "cx", F.when(F.col("qy") < F.col("sy"), F.col("low")).otherwise(F.col("high")).alias("cy"))
    own = pairs.where("qx = sx AND qy = sy").join(placed, tile).select("qx", "qy", "cx", "cy")
    shown = beside.unionByName(above).unionByName(own)
    asked = open_cells.select(floor_div(F.col("cx"), LEAF).alias("qx"), floor_div(F.col("cy"), LEAF).alias("qy"), F.col("cx").alias("x"), F.col("cy").alias("y"))

    def search(cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        x, y = cells["x"].to_numpy(), cells["y"].to_numpy()
        sources = sources.sort_values(["cy", "cx"])  # the first of equals is the one that ties go to
        sx, sy = sources["cx"].to_numpy(), sources["cy"].to_numpy()
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        step = max(1, (1 << 20) // max(1, len(x)))
        for i in range(0, len(sx), step):
            d2 = (sx[None, i:i + step] - x[:, None]) ** 2 + (sy[None, i:i + step] - y[:, None]) ** 2
            first = d2.argmin(1)
            near = d2[np.arange(len(x)), first]
            won = near < best
            best[won], at[won] = near[won], i + first[won]
        if not len(sx):
            x = y = at = at[:0]
        return pd.DataFrame({"cx": x, "cy": y, "sx": sx[at], "sy": sy[at]})

    return asked.groupBy("qx", "qy").cogroup(shown.groupBy("qx", "qy")).applyInPandas(search, "cx bigint, cy bigint, sx bigint, sy bigint")


def fill_nearest_any(cells: DataFrame, value: str, keep: list[str] | None = None, near: int = 8, tile: int = TILE) -> DataFrame:
    """``cx, cy, value, filled`` and ``keep`` of the table's rows, missing values from the nearest observed one at any distance.

    Most rows find it within ``near`` cells, on tiles; ``nearest_far`` finds it for the others. Ties go to the smaller row,
    then column, as in ``fill_nearest``. Values stay missing only where the table has none.
    """
    extra = keep or []
    names = [value, *extra]
    table = cut(cells.select("cx", "cy", *[F.col(n).cast("double").alias(n) for n in names]), "fill")
    local = cut(fill_nearest(table, value, near, only_rows=True, keep=extra, tile=tile).select("cx", "cy", "filled", *names), "near")
    open_cells = local.where(F.col(value).isNull()).select("cx", "cy")
    if open_cells.isEmpty():
        return local
    found = nearest_far(open_cells, table.where(F.col(value).isNotNull()).select("cx", "cy"))
    given = table.where(F.col(value).isNotNull()).select(F.col("cx").alias("sx"), F.col("cy").alias("sy"), *[F.col(n).alias(f"_{n}") for n in names])
    taken = found.join(given, ["sx", "sy"]).drop("sx", "sy").withColumn("_far", F.lit(True))
    whole = local.join(taken, ["cx", "cy"], "left")
    reached = F.coalesce("_far", F.lit(False))
    return cut(whole.select("cx", "cy", (F.col("filled") | reached).alias("filled"), *[F.when(reached, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names]), "far")


def distance_to(cells: DataFrame, target: str, reach: int, tile: int = TILE) -> DataFrame:
    """Distance in cells from each row to the nearest row whose ``target`` flag is set; NULL beyond ``reach``."""
    def kernel(p: Patch):
        d2, _, _ = nearest_known(p.flag(target), reach)
        return p.present, {"distance": np.where(d2 < FAR, np.sqrt(d2.astype(float)), np.nan)}

    return tile_map(cells, [target], reach, kernel, {"distance": "double"}, tile)


def gauss_kernel(sigma: float) -> np.ndarray:
    radius = int(4.0 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def blur(grid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    radius = len(kernel) // 2
    for axis in (0, 1):
        padded = np.pad(grid, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)])
        grid = sum(w * np.take(padded, np.arange(i, i + grid.shape[axis]), axis=axis) for i, w in enumerate(kernel))
    return grid


def smooth_gaussian(cells: DataFrame, value: str, sigma: float, tile: int = TILE) -> DataFrame:
    """Gaussian mean of the observed values around each row; cells without a value carry no weight."""
    weights = gauss_kernel(sigma)

    def kernel(p: Patch):
        known = ~np.isnan(p[value])
        top = blur(np.where(known, p[value], 0.0), weights)
        return p.present, {value: top / np.maximum(blur(known.astype(float), weights), 0.01)}

    return tile_map(cells, [value], len(weights) // 2, kernel, {value: "double"}, tile)


def median_of_nine(grid: np.ndarray) -> np.ndarray:
    """3 x 3 median; a missing neighbour repeats the nearest cell of the same row or column, as an edge reflects."""
    padded = np.pad(grid, 1, constant_values=np.nan)
    height, width = grid.shape

    def shifted(dy: int, dx: int) -> np.ndarray:
        return padded[1 + dy:1 + dy + height, 1 + dx:1 + dx + width]

    stack = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            v = shifted(dy, dx)
            for other in ((dy, 0), (0, dx), (0, 0)):
                v = np.where(np.isnan(v), shifted(*other), v)
            stack.append(v)
    return np.sort(np.stack(stack), axis=0)[4]


def median3(cells: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    return tile_map(cells, [value], 1, lambda p: (~np.isnan(p[value]), {value: median_of_nine(p[value])}), {value: "double"}, tile)


def morphology(cells: DataFrame, mask: str, op: str, radius: float, tile: int = TILE) -> DataFrame:
    """Disk dilation, erosion, closing or opening of a flag over the table's rows; outside of them the flag is unset."""
    shape = disk(radius)
    span = shape.shape[0] // 2
    steps = {"dilate": [dilate], "erode": [erode], "close": [dilate, erode], "open": [erode, dilate]}[op]

    def kernel(p: Patch):
        grid = p.flag(mask)
        for step in steps:
            grid = step(grid, shape) & p.present
        return p.present, {mask: grid}

    return tile_map(cells, [mask], span * len(steps), kernel, {mask: "boolean"}, tile)


def canopy_relief(
    cells: DataFrame, *, step_mm: float, scale: float, smoothing_m: float, gap_mm: float, edge_mm: float,
    low_m: float = 1.0, high_m: float = 36.0, reach: int | None = None, tile: int = TILE,
) -> DataFrame:
    """Printed canopy height per cell from ``height_m``, ``vegetation`` and ``eligible``.

    Measured heights in range fill the gaps, are de-spiked and smoothed; the vegetated footprint is closed over narrow
    gaps; near the footprint's edge the height rolls off smoothly. The nearest measured height fills at any distance, or
    only up to ``reach`` cells where that is given.
    """
    gap = disk(max(1, int(np.ceil(gap_mm / (2 * step_mm)))))
    span = gap.shape[0] // 2
    sigma = smoothing_m / (step_mm * scale / 1000.0)
    weights = gauss_kernel(sigma) if sigma > 0 else np.ones(1)
    roll = max(1, int(np.ceil(edge_mm / step_mm)))
    halo = max(2 * span + roll, 1 + len(weights) // 2 + 2 * span)
    usual = (F.col("vegetation") != 0) & ~F.isnan("height_m") & (F.col("height_m") > low_m) & (F.col("height_m") <= high_m)
    cells = cut(cells.select("cx", "cy", F.col("height_m").cast("double").alias("height_m"), "vegetation", "eligible"), "canopy")
    known = cells.select("cx", "cy", F.when(usual, F.col("height_m")).alias("filled_m"))
    carried = fill_nearest_any(known, "filled_m", tile=tile) if reach is None else fill_nearest(known, "filled_m", reach, only_rows=True, tile=tile)
    cells = cells.join(carried.select("cx", "cy", "filled_m"), ["cx", "cy"], "left")

    def kernel(p: Patch):
        vegetation = p.flag("vegetation")
        closed = erode(dilate(vegetation, gap) & p.present, gap) & p.present
        h = p["height_m"]
        good = vegetation & ~np.isnan(h) & (h > low_m) & (h <= high_m)
        calm = median_of_nine(p["filled_m"])
        usable = closed & ~np.isnan(calm)
        smooth = blur(np.where(usable, calm, 0.0), weights) / np.maximum(blur(usable.astype(float), weights), 0.01)
        footprint = closed & p.flag("eligible")
        d2, _, _ = nearest_known(p.present & ~footprint, roll)
        t = np.clip(np.sqrt(np.minimum(d2, (roll + 1) ** 2).astype(float)) * step_mm / edge_mm, 0.0, 1.0)
        relief = np.clip(smooth, 0.0, high_m) * t * t * (3 - 2 * t)
        return p.present, {
            "relief_m": np.where(footprint, relief, 0.0), "footprint": footprint, "measured": good,
            "closed_gap": closed & ~vegetation & p.flag("eligible")}

    return tile_map(cells, ["height_m", "vegetation", "eligible", "filled_m"], halo, kernel,
                    {"relief_m": "double", "footprint": "boolean", "measured": "boolean", "closed_gap": "boolean"}, tile)


def canopy_report(relief: DataFrame) -> DataFrame:
    inside = F.when(F.col("footprint"), F.col("relief_m"))
    return relief.agg(
        F.count_if("measured").alias("measured_cells"), F.count_if("closed_gap").alias("closed_gap_cells"),
        F.count_if("footprint").alias("canopy_cells"), F.median(inside).alias("median_m"), F.max(inside).alias("highest_m"))


def absorb_thin(cells: DataFrame, nozzle_mm: float, step_mm: float, passes: int = 6, near: int = 8, tile: int = TILE) -> DataFrame:
    """Redraw ``material`` so that every region is as wide as a bead; ``height_mm`` moves with the material.

    A cell no bead-sized disk of its own colour covers takes material and height from the nearest cell that passes,
    at any distance, unless ``protected``. Repeats until nothing is thin, a pass changes nothing (so none would) or the
    passes are spent. Returns the table with ``moved``.

    A pass is one round over tiles whose halo holds what judges a cell and its sources up to ``near`` cells away; only
    cells without such a source are searched for further off.
    """
    bead = disk(nozzle_mm / 2.0 / step_mm)
    span = bead.shape[0] // 2

    def redraw(p: Patch):
        inside = ~np.isnan(p["material"])
        thin = np.zeros_like(inside)
        for colour in np.unique(p["material"][inside]):
            same = inside & (p["material"] == colour)
            thin |= same & ~dilate(erode(same, bead), bead)
        thin &= ~p.flag("protected")
        d2, y, x = nearest_known(inside & ~thin, near)
        moves = thin & (d2 < FAR)
        y, x = np.where(moves, y, 0), np.where(moves, x, 0)
        drawn = {c: np.where(moves, p[c][y, x], p[c]) for c in ("material", "height_mm")}
        other = np.logical_or.reduce([(drawn[c] != p[c]) & ~(np.isnan(drawn[c]) & np.isnan(p[c])) for c in drawn])
        return p.present, {**drawn, "protected": p.flag("protected"), "moved": p.flag("moved") | moves, "thin": thin, "far": thin & ~moves, "other": other}

    cols = ["material", "height_mm", "protected", "moved"]
    fields = {"material": "int", "height_mm": "double", "protected": "boolean", "moved": "boolean", "thin": "boolean", "far": "boolean", "other": "boolean"}
    current = cells.select("cx", "cy", "material", "height_mm", "protected", F.lit(False).alias("moved"))
    for _ in range(passes):
        drawn = cut(tile_map(current, cols, 2 * span + near, redraw, fields, tile), "absorb")
        current = drawn.select("cx", "cy", *cols)
        thin, far, other = drawn.agg(F.max("thin"), F.max("far"), F.max("other")).first()
        if not thin:
            break
        if far:
            passing = drawn.where("NOT thin AND material IS NOT NULL")
            found = nearest_far(drawn.where("far").select("cx", "cy"), passing.select("cx", "cy"))
            taken = passing.select(F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("material").alias("_m"), F.col("height_mm").alias("_h"))
            picked = found.join(taken, ["sx", "sy"]).select("cx", "cy", "_m", "_h", F.lit(True).alias("_far"))
            reached = F.coalesce("_far", F.lit(False))
            new = {c: F.when(reached, F.col(n)).otherwise(F.col(c)) for c, n in (("material", "_m"), ("height_mm", "_h"))}
            differs = ~(new["material"].eqNullSafe(F.col("material")) & new["height_mm"].eqNullSafe(F.col("height_mm")))
            settled = cut(current.join(picked, ["cx", "cy"], "left").select(
                "cx", "cy", *[v.alias(c) for c, v in new.items()], "protected", (F.col("moved") | reached).alias("moved"), differs.alias("other")), "absorb")
            current, other = settled.select("cx", "cy", *cols), other or settled.agg(F.max("other")).first()[0]
        if not other:
            break
    return current


def diagonal_contacts(cells: DataFrame, rounds: int = 12, tile: int = TILE) -> DataFrame:
    """Break corner-only contacts of ``material``; ``height_mm`` moves along and ``moved`` marks the changed cells.

    In a 2 x 2 block whose diagonal cells are equal and differ from the other two, the lower cell of that diagonal
    copies the cell above it. All blocks of a round see the same state; protected cells keep their material. Repeats
    until no block changes or the rounds are spent. Rows run upwards along ``cy``.
    """
    def kernel(p: Patch):
        m, height = p["material"], p["height_mm"]
        above, change = shift(m, 1, 0), np.zeros_like(p.present)
        for side in (-1, 1):
            corner, beside = shift(m, 1, side), shift(m, 0, side)
            change |= (corner == m) & (above != m) & (beside != m) & ~np.isnan(above) & ~np.isnan(beside)
        change &= ~p.flag("protected")
        return p.present, {
            "material": np.where(change, above, m), "height_mm": np.where(change, shift(height, 1, 0), height),
            "protected": p.flag("protected"), "moved": p.flag("moved") | change, "changed": change}

    cols = ["material", "height_mm", "protected", "moved"]
    fields = {"material": "int", "height_mm": "double", "protected": "boolean", "moved": "boolean", "changed": "boolean"}
    current = cells.select("cx", "cy", "material", "height_mm", "protected", F.lit(False).alias("moved"))
    for _ in range(rounds):
        stepped = cut(tile_map(current, cols, 1, kernel, fields, tile), "contacts")
        current = stepped.drop("changed")
        if not stepped.where("changed").limit(1).count():
            break
    return current


def shift(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The value ``dy`` rows up and ``dx`` columns to the right of each cell, NaN past the edge."""
    out = np.full_like(grid, np.nan)
    h, w = grid.shape
    out[max(0, -dy):h - max(0, dy), max(0, -dx):w - max(0, dx)] = grid[max(0, dy):h - max(0, -dy), max(0, dx):w - max(0, -dx)]
    return out
