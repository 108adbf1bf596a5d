"""Operators on cell tables: one row per lattice cell, a missing row or NULL is no data.

All groupings here end on a cell, a tile or a class and combine on the map side, so a crowded cell costs no more than
its partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import once
from ..functions.lattice import FT, cell_of, floor_div
from ..functions.levels import elevation_to_mm

# Point classes that describe ground and upper surfaces, and the land-cover legend.
GROUND_CLASS = 2
UPPER_CLASSES = [1, 2, 17, 25]
LAND_COVER_CLASSES = list(range(0, 9))
TILE_BITS = 6
TILE = 1 << TILE_BITS


def point_class(raw: Column, extended: Column) -> Column:
    """The extended class where the format carries one (above 31), else the raw class."""
    return F.when(extended > 31, extended).otherwise(raw)


def read_points(df: DataFrame) -> DataFrame:
    return df.withColumn("cls", point_class(F.col("cls"), F.col("cls_ext"))).drop("cls_ext")


def bin_points(points: DataFrame, size: float) -> DataFrame:
    """Mean ground and highest upper height per cell in metres, with the counts behind each; withheld points are out."""
    ground, upper = F.col("cls") == GROUND_CLASS, F.col("cls").isin(UPPER_CLASSES)
    z = F.col("z_ft") * FT
    return (
        points.where(~F.col("withheld") & (ground | upper))
        .groupBy(cell_of(F.col("x"), size).alias("cx"), cell_of(F.col("y"), size).alias("cy"))
        .agg(
            F.avg(F.when(ground, z)).alias("ground_m"), F.count(F.when(ground, 1)).alias("ground_points"),
            F.max(F.when(upper, z)).alias("upper_m"), F.count(F.when(upper, 1)).alias("upper_points"))
    )


def with_tile(cells: DataFrame, tile: int) -> DataFrame:
    return cells.withColumn("tile_x", floor_div(F.col("cx"), tile)).withColumn("tile_y", floor_div(F.col("cy"), tile))


def class_histogram(rows: DataFrame, by: list[str], cls: str = "cls") -> DataFrame:
    """Rows per class and group; histograms of parts add up to that of the whole."""
    return rows.groupBy(*by, cls).agg(F.count("*").alias("rows"))


def histogram_map(histogram: DataFrame, by: list[str], cls: str = "cls") -> DataFrame:
    """One map per group; a group has at most as many entries as there are classes."""
    return histogram.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(cls, "rows")))).alias("histogram"))


def tile_coverage(cells: DataFrame, tile: int) -> DataFrame:
    """Shares of a tile's cells with observed ground, filled ground and an observed upper surface."""
    whole = F.lit(float(tile * tile))
    seen = lambda c: F.count(F.when(c, 1)) / whole
    return with_tile(cells, tile).groupBy("tile_x", "tile_y").agg(
        seen(F.col("ground_m").isNotNull() & ~F.col("filled")).alias("observed"),
        seen(F.col("filled")).alias("filled"), seen(F.col("upper_m").isNotNull()).alias("upper_observed"))


def resample(cells: DataFrame, factor: int, value: str, how: str) -> DataFrame:
    """Coarser cells by max, min, mean, or mode (class 0 left out, the smallest class on a tie)."""
    keyed = cells.select(
        floor_div(F.col("cx"), factor).alias("cx"), floor_div(F.col("cy"), factor).alias("cy"), F.col(value).alias(value))
    if how == "mode":
        counted = keyed.where(F.col(value) != 0).groupBy("cx", "cy", value).agg(F.count("*").alias("_n"))
        return counted.groupBy("cx", "cy").agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias(value))
    fn = {"max": F.max, "min": F.min, "mean": F.avg}[how]
    return keyed.where(F.col(value).isNotNull()).groupBy("cx", "cy").agg(fn(value).alias(value))


def terrain_relief(
    cells: DataFrame, value: str, by: list[str], *, scale: float, layer_mm: float, vertical: float = 1.0,
    levels: float = 6.0, most: float = 3.0, least_span_m: float = 0.5, requested: float | None = None,
) -> DataFrame:
    """How much a plate's terrain is stretched so that its 5 % to 95 % span fills the wanted layers."""
    share = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    spans = cells.where(F.col(value).isNotNull()).groupBy(*by).agg(share.alias("_p")).select(
        *by, F.col("_p")[0].alias("low_m"), F.col("_p")[1].alias("high_m"))
    span = F.greatest(F.lit(0.0), F.col("high_m") - F.col("low_m"))
    raw = F.col("span_m") * 1000.0 / scale * vertical
    flat = (F.col("span_m") < least_span_m) | (F.col("raw_mm") <= 1e-9)
    if requested is not None:
        if not 0.25 <= requested <= 10:
            raise ValueError("a requested terrain factor must lie between 0.25 and 10")
        factor, mode = F.lit(float(requested)), F.lit("requested")
    else:
        wanted = F.least(F.greatest(F.lit(levels * layer_mm) / F.nullif(F.col("raw_mm"), F.lit(0.0)), F.lit(1.0)), F.lit(most))
        factor = F.when(flat, 1.0).otherwise(wanted)
        mode = (
            F.when(flat, "flat")
            .when(F.col("factor") > 1, "raised")
            .otherwise("enough"))
    return (
        spans.withColumn("span_m", span).withColumn("raw_mm", raw).withColumn("factor", factor).withColumn("mode", mode)
        .withColumn("adjusted_mm", F.col("raw_mm") * F.col("factor")))


def bad_classes(cells: DataFrame, cls: str = "cls", legend: list[int] = LAND_COVER_CLASSES) -> DataFrame:
    """Classes outside the legend with how many cells carry each; empty when the table is sound."""
    return cells.where(~F.col(cls).isin(legend)).groupBy(cls).agg(F.count("*").alias("cells"))


def check_classes(cells: DataFrame, cls: str = "cls", legend: list[int] = LAND_COVER_CLASSES) -> DataFrame:
    """The same table, but an unknown class stops the job and names the class."""
    wrong = F.raise_error(F.concat(F.lit("unknown class "), F.col(cls).cast("string")))
    return cells.withColumn(cls, F.when(F.col(cls).isin(legend) | F.col(cls).isNull(), F.col(cls)).otherwise(wrong.cast("int")))


def mosaic(sources: list[DataFrame], value: str, rule: str = "first_valid") -> DataFrame:
    """One value per cell from several cell tables, given in order of priority; ``rule`` may be max, min or last."""
    tagged = [s.select("cx", "cy", F.col(value).alias(value), F.lit(i).alias("_source")) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged).where(F.col(value).isNotNull()).groupBy("cx", "cy")
    if rule == "first_valid":
        return rows.agg(F.min_by(value, "_source").alias(value), F.min("_source").alias("source"))
    if rule == "last":
        return rows.agg(F.max_by(value, "_source").alias(value), F.max("_source").alias("source"))
    by = {"max": F.max, "min": F.min}[rule]
    pick = {"max": F.max_by, "min": F.min_by}[rule]
    return rows.agg(by(value).alias(value), pick("_source", F.struct(value, "_source")).alias("source"))


def mask_algebra(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Union, intersection or difference of two cell sets."""
    a, b = a.select("cx", "cy"), b.select("cx", "cy")
    if op == "union":
        return a.union(b).distinct()
    kind = {"intersect": "left_semi", "difference": "left_anti"}[op]
    return a.join(b, ["cx", "cy"], kind).distinct()


def fallback_cells(cells: DataFrame, priority: DataFrame) -> DataFrame:
    """Rows of ``cells`` that the priority set does not cover."""
    return cells.join(priority.select("cx", "cy").distinct(), ["cx", "cy"], "left_anti")


def raise_to_ground(upper: DataFrame, ground: DataFrame) -> DataFrame:
    """Upper surface lifted to the ground below it; a cell that only one table has keeps what it has."""
    both = upper.select("cx", "cy", "upper_m").join(ground.select("cx", "cy", "ground_m"), ["cx", "cy"], "full")
    return both.select(
        "cx", "cy", "ground_m", F.when(F.col("upper_m").isNotNull(), F.greatest("upper_m", "ground_m")).alias("upper_m"),
        F.coalesce(F.col("upper_m") < F.col("ground_m"), F.lit(False)).alias("raised"))


def missing_members(required: DataFrame, present: DataFrame, name: str) -> DataFrame:
    return required.select(name).distinct().join(present.select(name).distinct(), name, "left_anti")


# The default price of cutting through a cell.
CUT_WEIGHTS = {
    "height": 4.0, "height_cap_m": 40.0, "canopy": 0.25, "building": 300.0, "cheap": 0.15, "open": 0.4,
    "open_height_m": 2.0, "water": 60.0, "nodata": 40.0, "blocked": 1e12,
}


def cut_cost(cells: DataFrame, weights: dict | None = None) -> DataFrame:
    """Price of a cut through each cell of a wide table with ``height_m`` and boolean layer columns.

    A cell no cut may enter (structure, crossing or tall building) gets the ``blocked`` price and ``keep_out``.
    """
    w = {**CUT_WEIGHTS, **(weights or {})}
    low = F.coalesce("height_m", F.lit(0.0))
    greenery = (F.col("park") | F.col("vegetation")) & ~F.col("building")
    height = F.least(low, F.lit(w["height_cap_m"])) * w["height"]
    cost = F.lit(1.0) + F.when(greenery, height * w["canopy"]).otherwise(height) + F.when(F.col("building"), w["building"]).otherwise(0.0)
    cost = F.when(F.col("cheap_surface"), cost * w["cheap"]).otherwise(cost)
    cost = F.when(greenery & (low < w["open_height_m"]), cost * w["open"]).otherwise(cost)
    cost = F.when(F.col("water"), cost + w["water"]).otherwise(cost)
    cost = F.when(F.col("height_m").isNull(), w["nodata"]).otherwise(cost)
    keep_out = F.col("structure") | F.col("crossing") | F.col("tall_building")
    return cells.withColumn("keep_out", keep_out).withColumn("cost", F.when(keep_out, w["blocked"]).otherwise(cost))


def corner_heights(cells: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """Height of each cell corner: mean or lowest of the cells that touch it, at most four."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])
    corners = cells.where(F.col(value).isNotNull()).select("cx", "cy", value, F.explode(offsets).alias("o"))
    fn = {"mean": F.avg, "min": F.min}[how]
    return corners.groupBy((F.col("cx") + F.col("o.dx")).alias("gx"), (F.col("cy") + F.col("o.dy")).alias("gy")).agg(
        fn(value).alias(value))


def relative_heights_mm(cells: DataFrame, origin_m: float, scale: float, vertical: float, factor: float, minimum_mm: float) -> DataFrame:
    """Printed terrain and surface height: terrain is stretched, what stands on it keeps its own height."""
    ground = elevation_to_mm(F.col("ground_m"), origin_m, scale, vertical, factor, minimum_mm)
    above = (F.col("surface_m") - F.col("ground_m")) * 1000.0 / scale * vertical
    return cells.withColumn("ground_mm", ground).withColumn("surface_mm", ground + above)


def cell_tiles(cells: DataFrame) -> DataFrame:
    """Cells as bits, in tiles of 64 by 64: ``_rows`` holds a number for each row of ``_tx, _ty``, with a bit for each cell."""
    row = cells.groupBy(
        F.shiftright("cx", TILE_BITS).alias("_tx"), F.shiftright("cy", TILE_BITS).alias("_ty"), F.col("cy").bitwiseAND(TILE - 1).cast("int").alias("_row"),
    ).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("cx").bitwiseAND(TILE - 1).cast("int"))).alias("_bits"))
    tiles = row.groupBy("_tx", "_ty").agg(F.collect_list(F.struct("_row", "_bits")).alias("_found"))
    tiles = once(tiles, "_by_row", F.map_from_entries("_found"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(TILE - 1)), lambda r: F.coalesce(F.try_element_at("_by_row", r), F.lit(0).cast("bigint")))
    return tiles.select("_tx", "_ty", bits.alias("_rows"))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per value of each named column, as one long table; the table is read once."""
    values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(values).alias("v")).groupBy("v.field", "v.value").agg(F.count("*").alias("rows"))
