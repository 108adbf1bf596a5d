"""Print-height arithmetic: whole layers, reliefs, elevations to millimetres, tunnel profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Heights of the drawn map, in millimetres.
COLOUR_DEPTH_MM = 0.24
PAD_RELIEF_MM = 0.16
LINE_RELIEF_MM = 0.48
FIRST_LAYER_MM = 0.2


def layer_ceil(value: Column, step: Column) -> Column:
    """Up to a whole number of steps, forgiving a rounding error of 1e-9."""
    return F.round(F.ceil((value - 1e-9) / step) * step, 10)


def snap_up(value: Column, step: Column) -> Column:
    return layer_ceil(value, step)


def snap_down(value: Column, step: Column) -> Column:
    return F.round(F.floor((value + 1e-9) / step) * step, 10)


def colour_depth(layer: Column, minimum: float = COLOUR_DEPTH_MM) -> Column:
    """Depth of a solid colour skin: at least two layers."""
    return layer_ceil(F.greatest(F.lit(minimum), layer * 2.0), layer)


def pad_relief(layer: Column, requested: float = PAD_RELIEF_MM) -> Column:
    return layer_ceil(F.lit(requested), layer)


def line_relief(layer: Column, pad: Column, requested: float = LINE_RELIEF_MM) -> Column:
    """A drawn line stands two layers above ground and one above the pad."""
    return F.round(F.greatest(F.lit(requested), layer * 2.0, pad + layer), 10)


def structural_roof(nozzle: Column, layer: Column) -> Column:
    """Thinnest roof that holds: one and a half nozzles or three layers, whole layers."""
    return layer_ceil(F.greatest(nozzle * 1.5, layer * 3.0), layer)


def crossing_floor(base: Column, layer: Column, colour: Column) -> Column:
    return base + layer + colour


def printable_width(requested: Column, nozzle: Column, beads: int = 1) -> Column:
    return F.round(F.greatest(requested, nozzle * float(beads)), 10)


def layer_level(z: Column, layer: Column, first: float = FIRST_LAYER_MM) -> Column:
    """Index of the layer plane nearest to a height."""
    return F.rint((z - first) / layer).cast("bigint")


def snap_to_layers(z: Column, layer: Column, first: float = FIRST_LAYER_MM) -> Column:
    return layer_level(z, layer, first) * layer + first


def elevation_to_mm(
    elevation: Column, origin_m: float, scale: float, vertical: float = 1.0, factor: float = 1.0, minimum_mm: float = 0.0
) -> Column:
    """Metres above the datum to printed millimetres."""
    return (elevation - origin_m) * 1000.0 / scale * vertical * factor + minimum_mm


def substrate_top(ground: Column, surface: Column, base_mm: float, depth: Column) -> Column:
    """Top of the white body: one colour depth below the lower of ground and surface, never below the base.

    A surface so low that its body would stand above it stops the job.
    """
    top = F.greatest(F.lit(float(base_mm)), F.least(ground, surface) - depth)
    return F.when(top > surface + 1e-9, F.raise_error(F.lit("substrate above its surface"))).otherwise(top)


def tunnel_profile(
    rows: DataFrame, route: str = "route_id", pos: str = "pos", surface: str = "surface_mm", road: str = "road_mm",
    protected: str = "protected", *, cover: float, clearance: float, evidence: float, tallest: float = 1.40,
    portal: float = 0.15,
) -> DataFrame:
    """Printable road and ceiling heights along each covered route.

    A route whose largest cover stays below ``evidence`` is not accepted and keeps its road height. Elsewhere the road
    sinks by the missing room, fading to nothing at the portals, but fully wherever a mapped deck passes above.
    The numbers a row needs from its route are two aggregates joined back, so a long route is never one task.
    """
    import math

    per_route = rows.groupBy(route).agg(
        F.count("*").alias("_n"), F.min(pos).alias("_lo"), F.max(F.col(surface) - F.col(road)).alias("max_separation_mm")
    )
    edge = max(1e-6, math.sin(math.pi * min(max(portal, 1e-3), 0.49)))
    t = (F.col(pos) - F.col("_lo")) / (F.col("_n") - 1)
    weight = F.when(F.col(protected), 1.0).otherwise(F.least(F.greatest(F.sin(t * math.pi) / edge, F.lit(0.0)), F.lit(1.0)))
    missing = F.greatest(F.lit(0.0), F.lit(cover + clearance) - (F.col(surface) - F.col(road)))
    accepted = F.col("max_separation_mm") >= evidence
    lowered = F.col(road) - missing * weight
    roof = F.col(surface) - cover
    ceiling = F.greatest(F.least(roof, lowered + tallest), lowered + clearance)
    return rows.join(per_route.where("_n >= 2"), route).select(
        *rows.columns, "max_separation_mm", accepted.alias("accepted"),
        F.when(accepted, lowered).otherwise(F.col(road)).alias("printed_road_mm"),
        F.when(accepted, ceiling).otherwise(F.col(road)).alias("ceiling_mm"),
        F.when(accepted, F.greatest(F.lit(0.0), ceiling - roof)).otherwise(0.0).alias("overcut_mm"),
    )
