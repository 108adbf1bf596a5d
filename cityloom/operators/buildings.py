"""Building operators: who owns a roof, heights per cell, roof fixtures, colour requests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.lattice import FT, cell_of
from ..functions.text import clean_id, identity_keys
from .ordered import dedupe_first
from .overlay import overlay
from .spatial import BOX, bbox_join, points_in_polygons
from .stats import survey_describes

DEFAULT_HEIGHT_M = 6.0


def roof_owner(roofs: DataFrame, footprints: DataFrame, size: float) -> DataFrame:
    """Footprint each roof surface belongs to, with the rule that found it.

    A building number both carry decides, else a footprint number, else the place. A key one footprint carries decides
    alone; of several candidates the one that shares most area wins, the first on a tie, none without shared area. Keys
    are looked up in a table of one row per key, so a key many rows carry never multiplies; only roofs that are still
    open go through the spatial join.
    """
    outlines, roofs, footprints = roofs.select("id", "edges"), identity_keys(roofs), identity_keys(footprints)
    for key in ("bin_key", "id_key"):
        seen = footprints.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"_{key}_n"), F.min("id").alias(f"_{key}_only"))
        roofs = roofs.join(seen, key, "left")
    by_bin, by_id = F.col("_bin_key_n").isNotNull(), F.col("_id_key_n").isNotNull()
    rule = F.when(by_bin, "bin").when(by_id, "id").otherwise("place")
    n = F.when(by_bin, F.col("_bin_key_n")).when(by_id, F.col("_id_key_n"))
    only = F.when(by_bin, F.col("_bin_key_only")).when(by_id, F.col("_id_key_only"))
    keyed = roofs.select("id", *BOX, "bin_key", "id_key", rule.alias("rule"), n.alias("_n"), only.alias("_only"))
    single = keyed.where(F.col("_n") == 1).select(F.col("id").alias("roof_id"), F.col("_only").alias("owner_id"), "rule")
    still_open = keyed.where(F.col("_n").isNull() | (F.col("_n") > 1)).drop("_n", "_only")
    keys = ["id", *BOX, "bin_key", "id_key"]
    pairs = bbox_join(still_open.select(*keys, "rule"), footprints.select(*keys), size).where(
        F.when(F.col("a_rule") == "bin", F.col("a_bin_key") == F.col("b_bin_key"))
        .when(F.col("a_rule") == "id", F.col("a_id_key") == F.col("b_id_key")).otherwise(True))
    found = overlay(pairs.select("a_id", "b_id", *[f"{p}_{c}" for p in "ab" for c in BOX], "a_rule"), outlines, footprints, size)
    shared = found.where((F.col("a_rule") != "place") | F.col("meets")).select(
        F.col("a_id").alias("roof_id"), F.col("b_id").alias("fid"), F.col("a_rule").alias("rule"), F.col("overlap").alias("area"))
    best = shared.groupBy("roof_id", "rule").agg(F.count("*").alias("n"), F.max_by(F.struct("fid", "area"), F.struct(F.round("area", 9), -F.col("fid"))).alias("b"))
    alone = (F.col("rule") == "place") & (F.col("n") == 1)
    chosen = best.select("roof_id", F.when(alone | (F.col("b.area") > 1e-9), F.col("b.fid")).alias("owner_id"), "rule")
    missed = still_open.select(F.col("id").alias("roof_id"), "rule").join(chosen, "roof_id", "left_anti").select("roof_id", F.lit(None).cast("bigint").alias("owner_id"), "rule")
    return single.unionByName(chosen).unionByName(missed)


def fill_missing(base: DataFrame, lookup: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Value replaced where it is missing or not positive and the first lookup row of the key has a positive one."""
    first = dedupe_first(lookup.where(F.col(value).isNotNull()), [key], order).select(key, F.col(value).alias("_new"))
    use = (F.coalesce(F.col(value), F.lit(0.0)) <= 0) & (F.coalesce("_new", F.lit(0.0)) > 0)
    return base.join(first, key, "left").withColumn("was_filled", use).withColumn(value, F.when(use, F.col("_new")).otherwise(F.col(value))).drop("_new")


def roof_surface(surfaces: DataFrame, size: float) -> DataFrame:
    """Highest roof height per cell and the owner of the surface that gave it.

    ``surfaces`` have ``owner_id, edges, ring`` (``ring`` an array of ``x, y, z`` in feet) and ``z_min_ft, z_max_ft``.
    A flat surface gives its height, a sloping one its plane at the cell centre; near-vertical and tiny ones are out.
    """
    a, b = F.get("ring", F.lit(0)), F.get("ring", F.lit(1))

    def normal(c: Column) -> tuple[Column, Column, Column]:
        ux, uy, uz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
        vx, vy, vz = c["x"] - a["x"], c["y"] - a["y"], c["z"] - a["z"]
        return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx

    def bent(c: Column) -> Column:
        nx, ny, nz = normal(c)
        return nx * nx + ny * ny + nz * nz > 1e-12

    third = F.get(F.filter("ring", bent), F.lit(0))
    flat = (F.col("z_max_ft") - F.col("z_min_ft")) < 0.05
    shaped = surfaces.withColumn("_a", a).withColumn("_c", third).withColumn("_flat", flat)
    nx, ny, nz = normal(F.col("_c"))
    planes = shaped.withColumn("_nx", nx).withColumn("_ny", ny).withColumn("_nz", nz)
    # not a filter: Spark would move that in front of the exchange that deals the surfaces out
    usable = F.col("_flat") | (F.col("_c").isNotNull() & (F.abs("_nz") >= 1e-6) & (F.abs(g.area(F.col("edges"))) >= 0.05))
    cells = planes.select("owner_id", "z_max_ft", "_a", "_nx", "_ny", "_nz", "_flat", F.explode(F.when(usable, g.covered_cells(F.col("edges"), size))).alias("c"))
    x, y = (F.col("c.cx") + 0.5) * size, (F.col("c.cy") + 0.5) * size
    slope = (F.col("_nx") * (x - F.col("_a.x")) + F.col("_ny") * (y - F.col("_a.y"))) / F.when(F.col("_nz") != 0, F.col("_nz"))
    z = F.when(F.col("_flat"), F.col("z_max_ft")).otherwise(F.col("_a.z") - slope) * FT
    return cells.select("c.cx", "c.cy", "owner_id", z.alias("roof_m")).groupBy("cx", "cy").agg(
        F.max("roof_m").alias("roof_m"), F.max_by("owner_id", F.struct(F.col("roof_m"), -F.coalesce("owner_id", F.lit(0)))).alias("roof_owner"))


def building_heights(cells: DataFrame, footprints: DataFrame, roofs: DataFrame, parts: DataFrame, slack_reach: int | None = None) -> DataFrame:
    """Top of every building cell in metres, with the evidence used.

    ``cells`` are ``cx, cy, ground_m, fid`` (NULL outside buildings) and, if some may hold no fringe, a flag ``barred``; ``footprints`` ``fid, recorded_m``; ``roofs``
    ``cx, cy, roof_m, roof_owner``; ``parts`` ``cx, cy, part_m, part_owner``. In order: a roof of the cell's own building
    where the survey still describes it, mapped parts capped by the recorded height (slack cells take the nearest
    part, if it is their own, at any distance or up to ``slack_reach`` cells where that is given), else ground plus
    recorded height. Cells beside a footprint keep a kept roof, but for barred ones (water and pads).
    """
    from .focal import fill_nearest, fill_nearest_any, morphology

    recorded = F.when(F.col("recorded_m") > 0, F.col("recorded_m")).otherwise(DEFAULT_HEIGHT_M)
    base = cells.join(roofs, ["cx", "cy"], "left").join(parts, ["cx", "cy"], "left")
    own_roof = F.when(F.col("roof_owner") == F.col("fid"), F.col("roof_m") - F.col("ground_m"))
    own_part = F.when(F.col("part_owner") == F.col("fid"), F.col("part_m"))
    reached = base.where(F.col("fid").isNotNull()).groupBy("fid").agg(F.max(own_roof).alias("_roof"), F.max(own_part).alias("_part"))
    judged = footprints.select("fid", recorded.alias("recorded_m")).join(reached, "fid", "left").select(
        "fid", "recorded_m", survey_describes(F.col("_roof"), F.col("recorded_m")).alias("described"),
        (survey_describes(F.col("_part"), F.col("recorded_m")) & ~survey_describes(F.col("_roof"), F.col("recorded_m"))).alias("massed"))
    kept = judged.where("described").select(F.col("fid").alias("roof_owner"), F.lit(True).alias("_kept"))
    wide = base.join(judged, "fid", "left").join(kept, "roof_owner", "left")
    on_part = F.col("massed") & (F.col("part_owner") == F.col("fid"))
    mapped = wide.where("massed").select("cx", "cy", F.when(on_part, F.col("part_m")).alias("near_m"), F.col("part_owner").alias("near_owner"))
    carried = (
        fill_nearest_any(mapped, "near_m", keep=["near_owner"]) if slack_reach is None
        else fill_nearest(mapped, "near_m", slack_reach, only_rows=True, keep=["near_owner"]))
    near = carried.select("cx", "cy", "near_m", "near_owner")
    ring = morphology(cells.select("cx", "cy", F.col("fid").isNotNull().cast("int").alias("beside")), "beside", "dilate", 1)
    rows = wide.join(near, ["cx", "cy"], "left").join(ring, ["cx", "cy"], "left")
    inside = F.col("fid").isNotNull()
    use_roof = inside & F.col("described") & (F.col("roof_owner") == F.col("fid"))
    use_part = inside & F.col("massed") & (F.col("near_owner") == F.col("fid"))
    free = ~F.coalesce(F.col("barred"), F.lit(False)) if "barred" in cells.columns else F.lit(True)
    fringe = ~inside & F.col("beside") & F.coalesce("_kept", F.lit(False)) & free
    lifted = F.greatest(F.col("roof_m"), F.col("ground_m") + 1)
    top = (
        F.when(use_roof | fringe, lifted).when(use_part, F.col("ground_m") + F.least("near_m", "recorded_m"))
        .when(inside, F.col("ground_m") + F.col("recorded_m")))
    source = F.when(use_roof, "roof").when(fringe, "fringe").when(use_part, "parts").when(inside, "recorded")
    return rows.where(inside | fringe).select("cx", "cy", F.when(fringe, F.col("roof_owner")).otherwise(F.col("fid")).alias("fid"), top.alias("top_m"), source.alias("source"))


def fixture_cells(fixtures: DataFrame, size: float, min_width_ft: float) -> DataFrame:
    """Cells of roof fixtures, those narrower than the minimum grown all round to reach it."""
    grow = F.greatest(F.lit(0.0), (F.lit(min_width_ft) - F.sqrt(F.abs(g.area(F.col("edges"))) / math.pi) * 2) / 2)
    span = lambda lo, hi: F.sequence(cell_of(F.col(lo) - F.col("_grow"), size), cell_of(F.col(hi) + F.col("_grow"), size))
    cells = fixtures.withColumn("_grow", grow).withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))
    x, y = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size
    near = F.exists("edges", lambda e: g.distance_to_segment(x, y, e["x1"], e["y1"], e["x2"], e["y2"])["dist"] < F.col("_grow"))
    return cells.where(g.contains(F.col("edges"), x, y) | near).drop("_grow")


def fixture_heights(fixtures: DataFrame, cells: DataFrame, size: float, min_width_ft: float, minimum_m: float) -> DataFrame:
    """Top of each roof fixture: ``cells`` are building cells with ``top_m, upper_m``."""
    return fixture_levels(fixtures_on_roofs(fixtures, cells, size, min_width_ft), minimum_m)


def fixtures_on_roofs(fixtures: DataFrame, cells: DataFrame, size: float, min_width_ft: float) -> DataFrame:
    """The cells of each fixture that ``cells`` hold. Fixtures look small before they are cut into cells, so both are merged."""
    drawn = fixture_cells(fixtures, size, min_width_ft).select("id", "kind", "measured_top_m", "cx", "cy")
    return drawn.hint("merge").join(cells, ["cx", "cy"])


def fixture_levels(on_roof: DataFrame, minimum_m: float) -> DataFrame:
    """Top of each fixture from its cells ``on_roof``.

    A tank has its measured top, and is skipped when that lies over a metre below the roof; a cooling tower stands as
    high as the points above the roof say, between the printable minimum and 4 m. The roof is the 30th percentile.
    """
    level = on_roof.groupBy("id", "kind", "measured_top_m").agg(
        F.percentile("top_m", F.lit(0.3)).alias("roof_m"), F.percentile("upper_m", F.lit(0.7)).alias("seen_m"), F.count("*").alias("cells"))
    tank = F.col("kind") == "tank"
    skipped = tank & (F.col("measured_top_m") < F.col("roof_m") - 1)
    rise = F.least(F.greatest(F.coalesce("seen_m", "roof_m") - F.col("roof_m"), F.lit(0.0)), F.lit(4.0))
    target = F.when(skipped, F.lit(None)).when(tank, F.col("measured_top_m")).otherwise(F.col("roof_m") + F.greatest(rise, F.lit(minimum_m)))
    method = (
        F.when(skipped, "skipped").when(tank, "tank")
        .when(rise >= minimum_m, "points").otherwise("least"))
    return level.select("id", "kind", "cells", "roof_m", target.alias("top_m"), method.alias("method"))


def resolve_overrides(requests: DataFrame, features: DataFrame, size: float, bbl_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Features each colour request claims, and the problems: no match, an ambiguous point, conflicting colours.

    A request names a building number, footprint number or lot, or gives a point; a point claims every row that carries
    the number of the feature it hits.
    """
    ids = features.withColumn("_doitt", clean_id(F.col("doitt_id"))).withColumn("_bin", clean_id(F.col("bin")))
    claims = []
    for selector, columns in (("bin", ["_bin"]), ("doitt_id", ["_doitt"]), ("bbl", bbl_columns or [])):
        for column in columns:
            wanted = requests.where(F.col("selector") == selector).select("request_id", "material", clean_id(F.col("id_value")).alias("_want"))
            claims.append(wanted.join(ids.select("id", F.col(column).alias("_want")), "_want").select("request_id", "material", "id", F.lit(selector).alias("method")))
    points = requests.where(F.col("selector") == "point").select("request_id", "material", "x", "y")
    touched = points_in_polygons(points, ids.withColumn("_identity", F.coalesce("_doitt", "_bin")), size, boundary=True, keep=["id", "_identity"])
    hits = touched.groupBy("request_id", "material").agg(F.countDistinct("polygon__identity").alias("n"), F.min_by("polygon__identity", "polygon_id").alias("_identity"))
    seeds = hits.where(F.col("n") == 1)
    claims.append(seeds.join(ids.select("id", F.coalesce("_doitt", "_bin").alias("_identity")), "_identity").select("request_id", "material", "id", F.lit("point").alias("method")))
    resolved = claims[0]
    for more in claims[1:]:
        resolved = resolved.unionByName(more)
    resolved = resolved.distinct()
    ambiguous = hits.where(F.col("n") > 1).select("request_id", F.lit("touches several features").alias("problem"))
    unmatched = requests.select("request_id").join(resolved.select("request_id").distinct(), "request_id", "left_anti").join(
        ambiguous.select("request_id"), "request_id", "left_anti").select("request_id", F.lit("matches nothing").alias("problem"))
    clash = resolved.groupBy("id").agg(F.min("material").alias("lo"), F.max("material").alias("hi")).where("lo <> hi").select("id")
    conflicts = resolved.join(clash, "id", "left_semi").select("request_id", F.lit("conflicting colours").alias("problem")).distinct()
    return resolved, ambiguous.unionByName(unmatched).unionByName(conflicts)


def semantic_counts(features: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """Buildings and motor roads inside each area's outline and within its box; ``features`` carry their edges."""
    pairs = bbox_join(features.select("id", "is_building", "is_road", "edges", *BOX), areas.select("id", "edges", *BOX), size)
    inside = g.intersects(F.col("a_edges"), F.col("b_edges"))
    return pairs.groupBy(F.col("b_id").alias("area_id")).agg(
        F.count_if(F.col("a_is_building") & inside).alias("buildings"), F.count_if(F.col("a_is_road") & inside).alias("motor_roads"),
        F.count_if("a_is_building").alias("buildings_in_box"), F.count_if("a_is_road").alias("motor_roads_in_box"))


def coverage_gates(counts: DataFrame, limit_mm: float = 250.0) -> DataFrame:
    """The quality gates of a map as booleans, from ``mapped_buildings, footprints, roofs, mapped_roads, roadbeds, top_mm``.

    From ten mapped features on: a quarter of the mapped buildings needs a footprint, a twentieth of the footprints a
    roof, and mapped roads a roadbed. The relief must stay below the printable height.
    """
    def enough(have: str, of: str, share: float) -> Column:
        return ~((F.col(of) >= 10) & (F.col(have) < F.greatest(F.lit(1), F.floor(F.col(of) * share))))

    return counts.select(
        "*", enough("footprints", "mapped_buildings", 0.25).alias("buildings_ok"), enough("roofs", "footprints", 0.05).alias("roofs_ok"),
        (~((F.col("mapped_roads") >= 10) & (F.col("roadbeds") == 0))).alias("roads_ok"), (F.col("top_mm") <= limit_mm).alias("height_ok"))
