"""Fusing layers into one surface per cell: material and top by priority, stairs, decks, tunnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.lattice import cell_of
from ..runtime import cut
from .roads import carried_structures
from .spatial import BOX, bbox_join, points_in_polygons, segment_box, split_segments
from .stats import robust_line_fit

# Drawing order, later over earlier, and the material numbers.
LAYERS = [
    "fallback_green", "green", "water", "pads", "trails", "roads", "trail_decks", "road_decks", "buildings", "canopy",
    "fixtures", "overrides", "stairs", "walls", "entrances",
]
IVORY, GREEN, BLUE, TAN = 0, 1, 2, 3


def paint_priority(base: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Material and top of each base cell: the last layer in drawing order that covers it wins, both together.

    ``base`` has ``cx, cy, ground_m``; a layer ``cx, cy, material, top_m``. Cells no layer covers are ivory ground. The
    ``layers`` column keeps one bit per layer that covered the cell, so every yield can be counted afterwards.
    """
    unknown = set(layers) - set(LAYERS)
    if unknown:
        raise ValueError(f"unknown layers {sorted(unknown)}")
    parts = [
        df.select("cx", "cy", F.lit(LAYERS.index(name)).alias("_p"), F.col("material").cast("int").alias("material"), F.col("top_m").cast("double").alias("top_m"))
        for name, df in layers.items()]
    won = reduce(DataFrame.unionByName, parts).groupBy("cx", "cy").agg(
        F.max_by(F.struct("material", "top_m"), F.struct("_p", "top_m", "material")).alias("_w"),
        F.bit_or(F.expr("shiftleft(1L, _p)")).alias("layers"))
    return base.join(won, ["cx", "cy"], "left").select(
        "cx", "cy", "ground_m", F.coalesce("_w.material", F.lit(IVORY)).alias("material"), F.coalesce("_w.top_m", "ground_m").alias("top_m"),
        F.coalesce("layers", F.lit(0)).alias("layers"))


def has_layer(name: str):
    return F.col("layers").bitwiseAND(F.lit(1 << LAYERS.index(name))) != 0


def yield_counts(painted: DataFrame) -> DataFrame:
    """Cells per layer, and cells that trails and trail decks gave up to carriageways."""
    drawn = [F.count_if(has_layer(n)).alias(f"{n}_cells") for n in LAYERS]
    return painted.agg(
        *drawn, F.count_if(has_layer("trails") & has_layer("roads")).alias("trails_yielded"),
        F.count_if(has_layer("trail_decks") & has_layer("road_decks")).alias("trail_decks_reclaimed"),
        F.count_if(has_layer("pads") & has_layer("roads")).alias("pads_repainted"))


def ribbon_places(segments: DataFrame, size: float, width_ft: float) -> DataFrame:
    """Cells within half the width of each line, with the place (0 to 1) of the line's nearest point.

    ``segments`` carry ``line_id, start_length, line_length`` and end points.
    """
    half = width_ft / 2
    unit = (F.col("x2") - F.col("x1")), (F.col("y2") - F.col("y1"))
    marked = segments.withColumn("sx", F.col("x1")).withColumn("sy", F.col("y1"))
    pieces = segment_box(split_segments(marked.select("line_id", "start_length", "line_length", "sx", "sy", "x1", "y1", "x2", "y2"), size * 8))
    span = lambda lo, hi: F.sequence(cell_of(F.col(lo) - half, size), cell_of(F.col(hi) + half, size))
    cells = pieces.withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))
    near = g.distance_to_segment((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    at = F.col("start_length") + F.hypot(F.col("x1") - F.col("sx"), F.col("y1") - F.col("sy")) + near["share"] * F.hypot(*unit)
    close = cells.select("line_id", "cx", "cy", near["dist"].alias("dist"), F.when(F.col("line_length") > 0, at / F.col("line_length")).otherwise(0.0).alias("place"))
    return close.where(F.col("dist") <= half).groupBy("line_id", "cx", "cy").agg(F.min_by("place", F.struct(F.round("dist", 9), "place")).alias("place"))


def stair_treads(
    runs: DataFrame, ground: DataFrame, building: DataFrame, water: DataFrame, transport: DataFrame, *, size: float,
    width_ft: float, mm_per_ft: float, mm_per_m: float, relief_m: float,
) -> tuple[DataFrame, DataFrame]:
    """Stepped cells of each stair run, and per run its treads and the cells it gave up to roads and decks.

    A run needs 0.9 mm of length and two treads, one per 0.4 mm along and 0.08 mm up. Its height goes from the ground
    at one end to that at the other in whole treads. ``runs`` are segments with ``line_length``.
    """
    ends = runs.groupBy("line_id").agg(
        F.max("line_length").alias("line_length"), F.min_by(F.struct("x1", "y1"), "pos").alias("a"), F.max_by(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")), "pos").alias("b"))
    at = lambda p, x, y: (cell_of(F.col(f"{p}.{x}"), size), cell_of(F.col(f"{p}.{y}"), size))
    (ax, ay), (bx, by) = at("a", "x1", "y1"), at("b", "x", "y")
    spot = ends.select("line_id", "line_length", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    z = lambda p: ground.select(F.col("cx").alias(f"{p}x"), F.col("cy").alias(f"{p}y"), F.col("ground_m").alias(f"z{p}"))
    levels = spot.join(z("a"), ["ax", "ay"]).join(z("b"), ["bx", "by"])
    rise = F.abs(F.col("zb") - F.col("za")) * mm_per_m
    treads = F.least(F.floor(F.col("line_length") * mm_per_ft / 0.4), F.floor(rise / 0.08))
    good = levels.withColumn("treads", treads).where((F.col("line_length") * mm_per_ft >= 0.9) & (F.col("treads") >= 2))
    place = ribbon_places(runs, size, width_ft).join(good.select("line_id", "za", "zb", "treads"), "line_id")
    flag = lambda df, name: df.select("cx", "cy", F.lit(True).alias(name)).distinct()
    marked = place.join(flag(building.unionByName(water), "_solid"), ["cx", "cy"], "left").join(flag(transport, "_road"), ["cx", "cy"], "left").where(F.col("_solid").isNull())
    top = F.col("za") + (F.col("zb") - F.col("za")) * F.rint(F.col("place") * F.col("treads")) / F.col("treads") + relief_m
    cells = marked.where(F.col("_road").isNull()).select("line_id", "cx", "cy", F.lit(TAN).alias("material"), top.alias("top_m"))
    report = marked.groupBy("line_id").agg(F.max("treads").alias("treads"), F.count_if(F.col("_road").isNull()).alias("cells"), F.count_if(F.col("_road").isNotNull()).alias("yielded"))
    return cells, report


def restore_over_tunnels(cells: DataFrame) -> DataFrame:
    """Tops over tunnels: in a park the ground comes back unless a bridge or surface route passes above.

    ``cells`` carry ``ground_m, top_m`` and flags ``tunnel, park, bridge, surface_route``; adds ``restored, protected``.
    """
    protected = F.col("tunnel") & (F.col("bridge") | F.col("surface_route"))
    restored = F.col("tunnel") & F.col("park") & ~protected
    return cells.withColumn("protected", protected).withColumn("restored", restored).withColumn(
        "top_m", F.when(restored, F.col("ground_m")).otherwise(F.col("top_m")))


def cap_deck(planned, visible):
    """A crossing's deck never above the deck seen there; where none is seen it stays as planned."""
    return F.when(visible.isNotNull(), F.least(planned, visible)).otherwise(planned)


def deck_profiles(bridges: DataFrame, structures: DataFrame, spots: DataFrame, ground: DataFrame, *, size: float, near_ft: float, spot_ft: float, ribbon_ft: float) -> DataFrame:
    """Start and end elevation of each bridge and where they come from.

    Structures within ``near_ft`` give elevation; those the bridge carries are its surface. Two or more spots on them
    are fitted, else the structures' own corner heights, else the 80th percentile of the ground around the bridge.
    ``bridges`` are segments with ``way_id, carriageway, start_length, line_length``; ``structures`` have ``ring``.
    """
    bridges, structures = cut(bridges, "bridges"), cut(structures, "structures")
    boxes = segment_box(split_segments(bridges, size * 4))
    edges = bbox_join(boxes, structures.select("id", "edges", *BOX), size, grow=near_ft)
    a = [F.col(f"a_{c}") for c in ("x1", "y1", "x2", "y2")]
    mid = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    close = (
        (g.covered_share(F.col("b_edges"), *a) > 0)
        | F.exists("b_edges", lambda e: g.distance_to_segment(*mid, e["x1"], e["y1"], e["x2"], e["y2"])["dist"] <= near_ft))
    touching = edges.where(close).select(F.col("a_way_id").alias("way_id"), F.col("b_id").alias("structure_id")).distinct()
    touching = cut(touching, "touching")
    carried = carried_structures(bridges, structures, size).where("kept").select("way_id", F.col("polygon_id").alias("structure_id"))
    lines = bridges.withColumn("line_id", F.col("way_id"))

    def placed(points: DataFrame) -> DataFrame:
        """Samples with their place along their bridge; points name the bridge they belong to."""
        pairs = points.join(lines.select("way_id", "x1", "y1", "x2", "y2", "start_length", "line_length"), "way_id")
        near = g.distance_to_segment(F.col("x"), F.col("y"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
        at = (F.col("start_length") + near["share"] * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / F.col("line_length")
        return pairs.groupBy("way_id", "x", "y", "z").agg(F.min_by(at, F.struct(near["dist"], "start_length")).alias("place"))

    on_structure = points_in_polygons(spots.select("x", "y", F.col("value").alias("z")), structures, size, boundary=True)
    spot_rows = on_structure.join(touching, on_structure.polygon_id == touching.structure_id).select("way_id", "x", "y", "z").distinct()
    spot_rows = cut(spot_rows, "spots")
    enough = spot_rows.groupBy("way_id").agg(F.count("*").alias("n")).where("n >= 2").select("way_id")
    corners = touching.join(structures.select(F.col("id").alias("structure_id"), F.explode("ring").alias("p")), "structure_id").select("way_id", "p.x", "p.y", "p.z").distinct()
    by_spot, by_ring = spot_rows.join(enough, "way_id", "left_semi"), corners.join(enough, "way_id", "left_anti")
    fits = robust_line_fit(placed(by_spot).unionByName(placed(by_ring)), "way_id")
    rest = lines.join(touching.select("way_id").distinct(), "way_id", "left_anti")
    around = ribbon_places(rest, size, ribbon_ft).hint("merge").join(ground, ["cx", "cy"]).groupBy(F.col("line_id").alias("way_id")).agg(
        F.percentile("ground_m", F.lit(0.8)).alias("z"), F.count("*").alias("n"))
    source = enough.withColumn("source", F.lit("spots"))
    fitted = fits.join(source, "way_id", "left").select("way_id", "start_z", "end_z", "samples", "rejected", F.coalesce("source", F.lit("structure")).alias("source"))
    inferred = around.select("way_id", F.col("z").alias("start_z"), F.col("z").alias("end_z"), F.lit(0).cast("bigint").alias("samples"),
                             F.lit(0).cast("bigint").alias("rejected"), F.lit("ground").alias("source"))
    claimed = carried.groupBy("way_id").agg(F.count("*").alias("carried"))
    return fitted.unionByName(inferred).join(claimed, "way_id", "left").withColumn("carried", F.coalesce("carried", F.lit(0)))


def deck_cells(bridges: DataFrame, profiles: DataFrame, size: float, width_ft: float, relief_m: float) -> DataFrame:
    """Deck height of every cell a bridge covers, straight between its two ends."""
    cells = ribbon_places(bridges, size, width_ft).join(profiles.select(F.col("way_id").alias("line_id"), "start_z", "end_z"), "line_id")
    return cells.select("line_id", "cx", "cy", (F.col("start_z") + (F.col("end_z") - F.col("start_z")) * F.col("place") + relief_m).alias("top_m"))
