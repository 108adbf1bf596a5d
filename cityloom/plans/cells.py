"""Aggregations and set operations on cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels, tags
from ..operators import cells as ops
from ..sources.derived import CELL_FT
from .registry import query

C = F.col
FT = "0.3048006096012192e0"
BINNED = f"""SELECT CAST(floor(x/8) AS BIGINT) AS cx, CAST(floor(y/8) AS BIGINT) AS cy,
      avg(z_ft*{FT}) FILTER (WHERE k = 2) AS ground_m, count(*) FILTER (WHERE k = 2) AS ground_points,
      max(z_ft*{FT}) FILTER (WHERE k IN (1, 2, 17, 25)) AS upper_m, count(*) FILTER (WHERE k IN (1, 2, 17, 25)) AS upper_points
    FROM (SELECT *, CASE WHEN cls_ext > 31 THEN cls_ext ELSE cls END AS k FROM points) p WHERE NOT withheld AND k IN (1, 2, 17, 25) GROUP BY 1, 2"""


def binned(t):
    return ops.bin_points(ops.read_points(t.points), CELL_FT)


@query("s11_read_points", "SELECT point_id, x, y, z_ft, CASE WHEN cls_ext > 31 THEN cls_ext ELSE cls END AS cls, withheld FROM points")
def _(t):
    return ops.read_points(t.points).select("point_id", "x", "y", "z_ft", "cls", "withheld")


@query("a1_bin_points", f"SELECT cx, cy, round(ground_m, 6) AS ground_m, ground_points, upper_m, upper_points FROM ({BINNED}) b")
def _(t):
    return binned(t).withColumn("ground_m", F.round("ground_m", 6))


@query("a2_class_histogram", """
    SELECT tile_x, tile_y, string_agg(concat(cls, ':', n), ' ' ORDER BY cls) AS histogram FROM (
      SELECT cx // 32 AS tile_x, cy // 32 AS tile_y, cls, count(*) AS n FROM landcover GROUP BY 1, 2, 3) h GROUP BY 1, 2""")
def _(t):
    hist = ops.class_histogram(ops.with_tile(t.landcover, 32), ["tile_x", "tile_y"])
    entries = F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return ops.histogram_map(hist, ["tile_x", "tile_y"]).select("tile_x", "tile_y", F.array_join(entries, " ").alias("histogram"))


@query("a3_tile_coverage", f"""
    SELECT cx // 32 AS tile_x, cy // 32 AS tile_y, count(ground_m) FILTER (WHERE ground_points % 3 <> 0)/1024.0e0 AS observed,
           count(*) FILTER (WHERE ground_points % 3 = 0)/1024.0e0 AS filled, count(upper_m)/1024.0e0 AS upper_observed
    FROM ({BINNED}) b GROUP BY 1, 2""")
def _(t):
    return ops.tile_coverage(binned(t).withColumn("filled", C("ground_points") % 3 == 0), 32)


@query("a4_resample", f"""
    WITH m AS (SELECT cx // 4 AS cx, cy // 4 AS cy, cls, count(*) AS n FROM landcover GROUP BY 1, 2, 3),
    mode AS (SELECT cx, cy, cls FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, cls) AS rn FROM m) q WHERE rn = 1),
    v AS (SELECT cx // 4 AS cx, cy // 4 AS cy, max(upper_m) AS hi, min(upper_m) AS lo, round(avg(upper_m), 6) AS mid FROM ({BINNED}) b GROUP BY 1, 2)
    SELECT cx, cy, hi, lo, mid, cls FROM v JOIN mode USING (cx, cy)""")
def _(t):
    b, keys = binned(t), ["cx", "cy"]
    parts = [ops.resample(b, 4, "upper_m", how).withColumnRenamed("upper_m", name) for how, name in (("max", "hi"), ("min", "lo"), ("mean", "mid"))]
    out = parts[0].join(parts[1], keys).join(parts[2], keys).join(ops.resample(t.landcover, 4, "cls", "mode"), keys)
    return out.withColumn("mid", F.round("mid", 6))


@query("a5_terrain_relief", f"""
    WITH p AS (SELECT cx // 64 AS tile_x, cy // 64 AS tile_y, quantile_cont(ground_m/8, 0.05) AS low, quantile_cont(ground_m/8, 0.95) AS high FROM ({BINNED}) b WHERE ground_m IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT *, greatest(0, high - low) AS span, greatest(0, high - low)*1000/4000.0e0*1.5e0 AS raw FROM p),
    f AS (SELECT *, CASE WHEN span < 0.5 OR raw <= 1e-9 THEN 1.0e0 ELSE least(greatest(6*0.2e0/raw, 1), 3) END AS factor FROM s)
    SELECT tile_x, tile_y, round(low, 6) AS low_m, round(high, 6) AS high_m, round(factor, 6) AS factor, round(raw*factor, 6) AS adjusted_mm,
           CASE WHEN span < 0.5 OR raw <= 1e-9 THEN 'flat'
                WHEN factor > 1 THEN 'raised' ELSE 'enough' END AS mode FROM f""")
def _(t):
    cells = ops.with_tile(binned(t), 64).withColumn("ground_m", C("ground_m") / 8)
    out = ops.terrain_relief(cells, "ground_m", ["tile_x", "tile_y"], scale=4000.0, layer_mm=0.2, vertical=1.5)
    return out.select("tile_x", "tile_y", *[F.round(c, 6).alias(c) for c in ("low_m", "high_m", "factor", "adjusted_mm")], "mode")


@query("p11_check_classes", "SELECT cls + 1 AS cls, count(*) AS cells FROM landcover WHERE cls + 1 > 8 GROUP BY 1")
def _(t):
    return ops.bad_classes(t.landcover.withColumn("cls", C("cls") + 1))


@query("a18_profile", """
    SELECT 'highway' AS field, highway AS value, count(*) AS rows FROM ways GROUP BY highway
    UNION ALL SELECT 'leisure', tags->>'$.leisure', count(*) FROM ways GROUP BY tags->>'$.leisure'
    UNION ALL SELECT 'amenity', tags->>'$.amenity', count(*) FROM ways GROUP BY tags->>'$.amenity'""")
def _(t):
    m = tags.parse_tags(C("tags"))
    wide = t.ways.select("highway", tags.tag(m, "leisure").alias("leisure"), tags.tag(m, "amenity").alias("amenity"))
    return ops.profile(wide, ["highway", "leisure", "amenity"])


def _sources(t):
    b = binned(t)
    return [b.select("cx", "cy", F.when((C("cx") + C("cy") * k) % 5 < 3, C("upper_m") + k).alias("v")) for k in (1, 2, 3)]


MOSAIC_SRC = f"""SELECT cx, cy, k AS source, CASE WHEN (cx + cy*(k + 1)) % 5 < 3 THEN upper_m + (k + 1) END AS v FROM ({BINNED}) b, (VALUES (0), (1), (2)) s(k)"""


@query("u1_mosaic", f"""
    WITH s AS ({MOSAIC_SRC})
    SELECT cx, cy, arg_min(v, source) AS first_v, min(source) AS first_source, arg_max(v, source) AS last_v, max(v) AS max_v, min(v) AS min_v FROM s WHERE v IS NOT NULL GROUP BY cx, cy""")
def _(t):
    src, keys = _sources(t), ["cx", "cy"]
    first = ops.mosaic(src, "v").select(*keys, C("v").alias("first_v"), C("source").alias("first_source"))
    rest = [ops.mosaic(src, "v", r).select(*keys, C("v").alias(f"{r}_v")) for r in ("last", "max", "min")]
    return first.join(rest[0], keys).join(rest[1], keys).join(rest[2], keys)


@query("u2_mask_algebra", """
    WITH a AS (SELECT cx, cy FROM landcover WHERE cls IN (1, 2, 3)), b AS (SELECT DISTINCT CAST(floor(x/8) AS BIGINT) AS cx, CAST(floor(y/8) AS BIGINT) AS cy FROM spots)
    SELECT 'union' AS op, cx, cy FROM (SELECT * FROM a UNION SELECT * FROM b) u
    UNION ALL SELECT 'intersect', cx, cy FROM (SELECT * FROM a INTERSECT SELECT * FROM b) i
    UNION ALL SELECT 'difference', cx, cy FROM (SELECT * FROM a EXCEPT SELECT * FROM b) d""")
def _(t):
    a = t.landcover.where(C("cls").isin(1, 2, 3))
    b = t.spots.select(F.floor(C("x") / CELL_FT).alias("cx"), F.floor(C("y") / CELL_FT).alias("cy"))
    one, two, three = [ops.mask_algebra(a, b, op).select(F.lit(op).alias("op"), "cx", "cy") for op in ("union", "intersect", "difference")]
    return one.union(two).union(three)


@query("j14_fallback_cells", """
    SELECT cx, cy, cls FROM landcover l WHERE NOT EXISTS (
      SELECT 1 FROM spots s WHERE CAST(floor(s.x/8) AS BIGINT) = l.cx AND CAST(floor(s.y/8) AS BIGINT) = l.cy)""")
def _(t):
    return ops.fallback_cells(t.landcover, t.spots.select(F.floor(C("x") / CELL_FT).alias("cx"), F.floor(C("y") / CELL_FT).alias("cy")))


@query("u4_raise_to_ground", f"""
    WITH b AS ({BINNED}), u AS (SELECT cx, cy, upper_m - 4 AS upper_m FROM b WHERE cx % 7 <> 0), g AS (SELECT cx, cy, round(ground_m, 6) AS ground_m FROM b WHERE cy % 5 <> 0)
    SELECT cx, cy, ground_m, CASE WHEN upper_m IS NULL THEN NULL ELSE greatest(upper_m, ground_m) END AS upper_m, coalesce(upper_m < ground_m, false) AS raised
    FROM u FULL JOIN g USING (cx, cy)""")
def _(t):
    b = binned(t)
    upper = b.where(C("cx") % 7 != 0).select("cx", "cy", (C("upper_m") - 4).alias("upper_m"))
    return ops.raise_to_ground(upper, b.where(C("cy") % 5 != 0).select("cx", "cy", F.round("ground_m", 6).alias("ground_m")))


@query("u5_missing_members", """
    SELECT DISTINCT highway AS layer FROM ways WHERE highway NOT IN (SELECT DISTINCT highway FROM ways WHERE way_id % 10 < 6)""")
def _(t):
    return ops.missing_members(t.ways.select(C("highway").alias("layer")), t.ways.where(C("way_id") % 10 < 6).select(C("highway").alias("layer")), "layer")


LAYERS_SQL = f"""SELECT l.cx, l.cy, cls, upper_m - ground_m AS height_m, cls = 5 AS building, cls = 7 AS cheap_surface, cls = 4 AS water, cls = 1 AS park,
       cls IN (1, 2) AS vegetation, cls = 8 AND l.cx % 5 = 0 AS structure, cls = 6 AND l.cy % 9 = 0 AS crossing, cls = 5 AND upper_m - ground_m > 20 AS tall_building
     FROM landcover l LEFT JOIN ({BINNED}) b ON l.cx = b.cx AND l.cy = b.cy"""


def layers(t):
    h = C("upper_m") - C("ground_m")
    cls = C("cls")
    return t.landcover.join(binned(t), ["cx", "cy"], "left").select(
        "cx", "cy", "cls", h.alias("height_m"), (cls == 5).alias("building"), (cls == 7).alias("cheap_surface"), (cls == 4).alias("water"),
        (cls == 1).alias("park"), cls.isin(1, 2).alias("vegetation"), ((cls == 8) & (C("cx") % 5 == 0)).alias("structure"),
        ((cls == 6) & (C("cy") % 9 == 0)).alias("crossing"), F.coalesce((cls == 5) & (h > 20), F.lit(False)).alias("tall_building"))


COST_SQL = f"""SELECT *, CASE WHEN structure OR crossing OR coalesce(tall_building, false) THEN 1e12 WHEN height_m IS NULL THEN 40.0e0
        ELSE (1 + 4*least(height_m, 40)*CASE WHEN (park OR vegetation) AND NOT building THEN 0.25e0 ELSE 1 END + CASE WHEN building THEN 300 ELSE 0 END)
             *CASE WHEN cheap_surface THEN 0.15e0 ELSE 1 END*CASE WHEN (park OR vegetation) AND NOT building AND height_m < 2 THEN 0.4e0 ELSE 1 END
             + CASE WHEN water THEN 60 ELSE 0 END END AS cost FROM ({LAYERS_SQL}) y"""


@query("r13_cut_cost", f"SELECT cx, cy, structure OR crossing OR coalesce(tall_building, false) AS keep_out, round(cost, 4) AS cost FROM ({COST_SQL}) c")
def _(t):
    return ops.cut_cost(layers(t)).select("cx", "cy", "keep_out", F.round("cost", 4).alias("cost"))


@query("r18_elevation_to_mm", f"""
    SELECT cx, cy, round((ground_m + 3)*1000/4000.0e0*1.5e0*1.2e0 + 0.8e0, 6) AS ground_mm,
           round((ground_m + 3)*1000/4000.0e0*1.5e0*1.2e0 + 0.8e0 + (upper_m - ground_m)*1000/4000.0e0*1.5e0, 6) AS surface_mm FROM ({BINNED}) b WHERE ground_m IS NOT NULL""")
def _(t):
    rows = binned(t).where(C("ground_m").isNotNull()).withColumnRenamed("upper_m", "surface_m")
    out = ops.relative_heights_mm(rows, -3.0, 4000.0, 1.5, 1.2, 0.8)
    return out.select("cx", "cy", F.round("ground_mm", 6).alias("ground_mm"), F.round("surface_mm", 6).alias("surface_mm"))


@query("r19_substrate_top", f"""
    SELECT cx, cy, round(greatest(0.8e0, least(ground_m/4 + 1, upper_m/4 + 1) - 0.4e0), 6) AS top FROM ({BINNED}) b WHERE ground_m IS NOT NULL""")
def _(t):
    top = levels.substrate_top(C("ground_m") / 4 + 1, C("upper_m") / 4 + 1, 0.8, levels.colour_depth(F.lit(0.2)))
    return binned(t).where(C("ground_m").isNotNull()).select("cx", "cy", F.round(top, 6).alias("top"))


@query("r20_corner_heights", f"""
    WITH c AS (SELECT cx + dx AS gx, cy + dy AS gy, upper_m FROM ({BINNED}) b, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) e(dy))
    SELECT gx, gy, round(avg(upper_m), 6) AS mean_m, min(upper_m) AS min_m FROM c GROUP BY gx, gy""")
def _(t):
    b = binned(t)
    mean, low = ops.corner_heights(b, "upper_m"), ops.corner_heights(b, "upper_m", "min")
    return mean.select("gx", "gy", F.round("upper_m", 6).alias("mean_m")).join(low.select("gx", "gy", C("upper_m").alias("min_m")), ["gx", "gy"])
