"""Building, fixture and surface-fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import buildings as ops
from ..operators import ordered, paint, spatial, stats
from ..runtime import cut
from .cells import BINNED, binned
from .registry import query
from .spatial import BOX, CROSSED, SEG, areas, way_segments

C = F.col
FTS = "0.3048006096012192e0"


def box_edges(df):
    x0, y0, x1, y1 = (C(c) for c in BOX)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return df.withColumn("edges", F.array(*[g.edge(a[0], a[1], b[0], b[1]) for a, b in zip(corners, corners[1:] + corners[:1])]))


PAIRED = "CASE WHEN {o} % 11 = 0 OR {o} < 2 THEN NULL ELSE CAST((({o} - {o} % 2) % 5 + 1)*1000000 + {o} - {o} % 2 AS VARCHAR) END"


def _paired_bin(owner):
    base = owner - owner % 2
    return F.when(owner % 11 == 0, "1000000").otherwise(((base % 5 + 1) * 1000000 + base).cast("string"))


@query("j6_roof_owner", f"""
    WITH r AS (SELECT id, minx, miny, maxx, maxy, CASE WHEN id % 4 = 0 THEN '9000001' ELSE {PAIRED.format(o='true_owner')} END AS bk, replace(doitt_id, '.0', '') AS ik FROM roofs),
    f AS (SELECT id, minx, miny, maxx, maxy, {PAIRED.format(o='id')} AS bk, replace(doitt_id, '.0', '') AS ik FROM footprints),
    k AS (SELECT r.*, CASE WHEN bk IN (SELECT bk FROM f WHERE bk IS NOT NULL) THEN 'bin' WHEN ik IN (SELECT ik FROM f) THEN 'id' ELSE 'place' END AS rule FROM r),
    c AS (SELECT k.id AS roof_id, rule, f.id AS fid, greatest(least(k.maxx, f.maxx) - greatest(k.minx, f.minx), 0)*greatest(least(k.maxy, f.maxy) - greatest(k.miny, f.miny), 0) AS area
          FROM k JOIN f ON (rule = 'bin' AND k.bk = f.bk) OR (rule = 'id' AND k.ik = f.ik) OR (rule = 'place' AND k.minx <= f.maxx AND f.minx <= k.maxx AND k.miny <= f.maxy AND f.miny <= k.maxy)),
    n AS (SELECT *, count(*) OVER (PARTITION BY roof_id) AS n, row_number() OVER (PARTITION BY roof_id ORDER BY area DESC, fid) AS rn FROM c)
    SELECT k.id AS roof_id, k.rule, CASE WHEN n = 1 OR area > 0 THEN fid END AS owner_id FROM k LEFT JOIN n ON n.roof_id = k.id AND rn = 1""")
def _(t):
    roofs = t.roof_polygons.withColumn("bin", F.when(C("id") % 4 == 0, "9000001").otherwise(_paired_bin(C("true_owner"))))
    return ops.roof_owner(roofs, box_edges(t.footprints).withColumn("bin", _paired_bin(C("id"))), 64.0)


@query("j8_fill_missing", """
    WITH l AS (SELECT true_owner AS id, z_max_ft - 95 AS h, row_number() OVER (PARTITION BY true_owner ORDER BY id) AS rn FROM roofs)
    SELECT f.id, CASE WHEN coalesce(height_roof, 0) <= 0 AND h > 0 THEN h ELSE height_roof END AS height_roof, coalesce(height_roof, 0) <= 0 AND coalesce(h, 0) > 0 AS was_filled
    FROM footprints f LEFT JOIN l ON l.id = f.id AND rn = 1""")
def _(t):
    lookup = t.roofs.select(C("true_owner").alias("id"), (C("z_max_ft") - 95).alias("height_roof"), C("id").alias("place"))
    return ops.fill_missing(t.footprints.select("id", "height_roof"), lookup, "id", "height_roof", ["place"]).select("id", "height_roof", "was_filled")


def surfaces(t):
    ring = F.array(*[F.struct(C(x).alias("x"), C(y).alias("y"), C("z_min_ft" if x == "minx" else "z_max_ft").alias("z"))
                     for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))])
    return t.roof_polygons.select("id", C("true_owner").alias("owner_id"), "edges", ring.alias("ring"), "z_min_ft", "z_max_ft", *BOX)


ROOF_CELLS = f"""SELECT cx, cy, max(z) AS roof_m, arg_max(owner, (z, -owner)) AS roof_owner FROM (
      SELECT cx, cy, true_owner AS owner, CASE WHEN z_max_ft - z_min_ft < 0.05 THEN z_max_ft ELSE z_min_ft + (z_max_ft - z_min_ft)*(cx*4 + 2 - minx)/(maxx - minx) END*{FTS} AS z FROM (
        SELECT *, unnest(range(CAST(ceil(minx/4 - 0.5) AS BIGINT), CAST(ceil(maxx/4 - 0.5) AS BIGINT))) AS cx FROM roofs) p,
        LATERAL (SELECT unnest(range(CAST(ceil(p.miny/4 - 0.5) AS BIGINT), CAST(ceil(p.maxy/4 - 0.5) AS BIGINT))) AS cy) q) r GROUP BY cx, cy"""


@query("r15_roof_surface", f"SELECT cx, cy, round(roof_m, 5) AS roof_m, roof_owner FROM ({ROOF_CELLS}) c")
def _(t):
    return ops.roof_surface(surfaces(t), 4.0).withColumn("roof_m", F.round("roof_m", 5))


RASTER4 = f"""SELECT cx, cy, max(id) AS fid FROM (SELECT p.id, cx, cy FROM (SELECT id, minx, miny, maxx, maxy, unnest(range(CAST(floor(minx/4) AS BIGINT), CAST(floor(maxx/4) AS BIGINT) + 1)) AS cx FROM footprints) p,
      LATERAL (SELECT unnest(range(CAST(floor(p.miny/4) AS BIGINT), CAST(floor(p.maxy/4) AS BIGINT) + 1)) AS cy) q, LATERAL (SELECT cx*4 + 2.0e0 AS px, cy*4 + 2.0e0 AS py) c
      JOIN edges e ON e.id = p.id GROUP BY p.id, cx, cy, px, py HAVING {CROSSED}) r GROUP BY cx, cy"""
GROUND = "(3 + ((cx + cy*3) % 5 + 5) % 5 / 10.0e0)"


@query("a11_zonal_max", f"""
    WITH d AS (SELECT fid, max(roof_m - {GROUND}) AS described FROM ({RASTER4}) f JOIN ({ROOF_CELLS}) r USING (cx, cy) WHERE roof_owner = fid GROUP BY fid)
    SELECT d.fid, round(described, 5) AS described, described > 0 AND coalesce(height_roof/3, 6) - described <= described AS kept FROM d JOIN footprints f ON f.id = d.fid""")
def _(t):
    cells = spatial.rasterize(t.polygons, 4.0).withColumnRenamed("id", "fid").hint("merge").join(ops.roof_surface(surfaces(t), 4.0), ["cx", "cy"])
    found = stats.zonal_max(cells.where(C("roof_owner") == C("fid")), "fid", C("roof_m") - ground_of())
    recorded = F.coalesce(C("height_roof") / 3, F.lit(6.0))
    return found.hint("merge").join(t.footprints.select(C("id").alias("fid"), "height_roof"), "fid").select(
        "fid", F.round("described", 5).alias("described"), stats.survey_describes(C("described"), recorded).alias("kept"))


def ground_of():
    return F.lit(3.0) + F.pmod(C("cx") + C("cy") * 3, F.lit(5)) / F.lit(10.0)


@query("a12_zonal_percentile", f"""
    SELECT concat(cx // 32, '_', cy // 32) AS zone, round(quantile_cont(upper_m, 0.15), 6) AS p15, round(quantile_cont(upper_m, 0.8), 6) AS p80, count(*) AS cells FROM ({BINNED}) b GROUP BY 1""")
def _(t):
    cells = binned(t).withColumn("zone", F.concat_ws("_", F.floor(C("cx") / 32), F.floor(C("cy") / 32)))
    low, high = stats.zonal_percentile(cells, "zone", "upper_m", 0.15), stats.zonal_percentile(cells, "zone", "upper_m", 0.8)
    return low.select("zone", F.round("value", 6).alias("p15"), "cells").join(high.select("zone", F.round("value", 6).alias("p80")), "zone")


PARTS = """SELECT cx, cy, max(h) AS part_m, arg_max(owner, (h, -owner)) AS part_owner FROM (
      SELECT true_owner AS owner, 5.0e0 + id % 7 AS h, cx, cy FROM (SELECT *, unnest(range(CAST(ceil(minx/4 - 0.5) AS BIGINT), CAST(ceil(maxx/4 - 0.5) AS BIGINT))) AS cx FROM roofs WHERE id % 3 = 1) p,
        LATERAL (SELECT unnest(range(CAST(ceil(p.miny/4 - 0.5) AS BIGINT), CAST(ceil(p.maxy/4 - 0.5) AS BIGINT))) AS cy) q) r GROUP BY cx, cy"""


def parts(t, every: bool = False):
    """Mapped parts: the roofs as boxes of their own height, a third of them unless ``every`` one is asked for."""
    raised = t.roof_polygons.where(F.lit(every) | (C("id") % 3 == 1)).select(C("true_owner").alias("owner"), (F.lit(5.0) + C("id") % 7).alias("h"), "edges")
    return spatial.cells_of_polygons(raised, 4.0, ["owner", "h"]).groupBy("cx", "cy").agg(
        F.max("h").alias("part_m"), F.max_by("owner", F.struct(C("h"), -C("owner"))).alias("part_owner"))


def height_inputs(t):
    roofs = ops.roof_surface(surfaces(t), 4.0).withColumn("roof_m", C("roof_m") - 20)
    prints = spatial.rasterize(t.polygons, 4.0).withColumnRenamed("id", "fid")
    domain = prints.select("cx", "cy").unionByName(roofs.select("cx", "cy")).distinct()
    cells = cut(domain.join(prints.hint("merge"), ["cx", "cy"], "left").withColumn("ground_m", ground_of()), "cells")
    return cells, t.footprints.select(C("id").alias("fid"), (C("height_roof") / 6).alias("recorded_m")), cut(roofs, "roofs"), cut(parts(t), "parts")


HEIGHTS = f"""WITH rf AS (SELECT cx, cy, roof_m - 20 AS roof_m, roof_owner FROM ({ROOF_CELLS}) c), fp AS ({RASTER4}), pt AS ({PARTS}),
    dm AS (SELECT cx, cy FROM fp UNION SELECT cx, cy FROM rf),
    b AS (SELECT dm.cx, dm.cy, fid, 3 + ((dm.cx + dm.cy*3) % 5 + 5) % 5 / 10.0e0 AS ground_m, roof_m, roof_owner, part_m, part_owner
          FROM dm LEFT JOIN fp ON fp.cx = dm.cx AND fp.cy = dm.cy LEFT JOIN rf ON rf.cx = dm.cx AND rf.cy = dm.cy LEFT JOIN pt ON pt.cx = dm.cx AND pt.cy = dm.cy),
    rc AS (SELECT id AS fid, CASE WHEN height_roof > 0 THEN height_roof/6 ELSE 6 END AS rec FROM footprints),
    mx AS (SELECT fid, max(roof_m - ground_m) FILTER (WHERE roof_owner = fid) AS r, max(part_m) FILTER (WHERE part_owner = fid) AS p FROM b WHERE fid IS NOT NULL GROUP BY fid),
    j AS (SELECT fid, rec, coalesce(r > 0 AND rec - r <= r, false) AS dsc, coalesce(p > 0 AND rec - p <= p, false) AND NOT coalesce(r > 0 AND rec - r <= r, false) AS mas FROM rc LEFT JOIN mx USING (fid)),
    w AS (SELECT b.*, j.rec, j.dsc, j.mas, coalesce(k.dsc, false) AS okept FROM b LEFT JOIN j USING (fid) LEFT JOIN j k ON k.fid = b.roof_owner),
    src AS (SELECT * FROM w WHERE mas AND part_owner = fid), sl AS (SELECT cx, cy FROM w WHERE mas),
    nr AS (SELECT sl.cx, sl.cy, arg_min(src.part_m, (d2, src.cy, src.cx)) AS near_m, arg_min(src.part_owner, (d2, src.cy, src.cx)) AS near_owner
           FROM sl CROSS JOIN (SELECT a.i AS dx, c.i AS dy, a.i*a.i + c.i*c.i AS d2 FROM range(-8, 9) a(i), range(-8, 9) c(i) WHERE a.i*a.i + c.i*c.i <= 64) o JOIN src ON src.cx = sl.cx + dx AND src.cy = sl.cy + dy GROUP BY sl.cx, sl.cy),
    ed AS (SELECT DISTINCT cx + dx AS cx, cy + dy AS cy FROM fp, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
    z AS (SELECT w.*, near_m, near_owner, ed.cx IS NOT NULL AS beside FROM w LEFT JOIN nr ON nr.cx = w.cx AND nr.cy = w.cy LEFT JOIN ed ON ed.cx = w.cx AND ed.cy = w.cy),
    o AS (SELECT *, CASE WHEN fid IS NOT NULL AND dsc AND roof_owner = fid THEN 'roof' WHEN fid IS NULL AND beside AND okept THEN 'fringe' WHEN fid IS NOT NULL AND mas AND near_owner = fid THEN 'parts' WHEN fid IS NOT NULL THEN 'recorded' END AS source FROM z)
    SELECT cx, cy, CASE source WHEN 'fringe' THEN roof_owner ELSE fid END AS fid, source,
           round(CASE WHEN source IN ('roof', 'fringe') THEN greatest(roof_m, ground_m + 1) WHEN source = 'parts' THEN ground_m + least(near_m, rec) ELSE ground_m + rec END, 5) AS top_m FROM o WHERE source IS NOT NULL"""


@query("r16_building_heights", HEIGHTS)
def _(t):
    return ops.building_heights(*height_inputs(t)).withColumn("top_m", F.round("top_m", 5))


def fixtures(t):
    half = t.spots.select(
        "id", F.when(C("id") % 2 == 0, "tank").otherwise("cooling").alias("kind"), (C("elevation_ft") / 2 - 8 + C("id") % 12).alias("measured_top_m"),
        (C("x") - 1.5).alias("minx"), (C("y") - 1.5).alias("miny"), (C("x") + 1.5).alias("maxx"), (C("y") + 1.5).alias("maxy"))
    return box_edges(half)


@query("r26_fixture_heights", f"""
    WITH c AS (SELECT cx, cy, ground_m + 8 AS top_m, upper_m FROM ({BINNED}) b WHERE ground_m IS NOT NULL),
    f AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'tank' ELSE 'cooling' END AS kind, elevation_ft/2 - 8 + id % 12 AS mt, x, y, (20 - sqrt(9/pi())*2)/2 AS gr FROM spots),
    p AS (SELECT f.*, c.top_m, c.upper_m FROM f JOIN c ON c.cx*8 + 4 BETWEEN x - 11 AND x + 11 AND c.cy*8 + 4 BETWEEN y - 11 AND y + 11
          AND sqrt(pow(greatest(abs(c.cx*8 + 4 - x) - 1.5, 0), 2) + pow(greatest(abs(c.cy*8 + 4 - y) - 1.5, 0), 2)) < gr),
    l AS (SELECT id, kind, mt, quantile_cont(top_m, 0.3) AS roof, quantile_cont(upper_m, 0.7) AS seen, count(*) AS cells FROM p GROUP BY id, kind, mt),
    q AS (SELECT *, least(greatest(seen - roof, 0), 4) AS rise, kind = 'tank' AND mt < roof - 1 AS skip FROM l)
    SELECT id, kind, cells, round(roof, 5) AS roof_m, round(CASE WHEN skip THEN NULL WHEN kind = 'tank' THEN mt ELSE roof + greatest(rise, 0.8) END, 5) AS top_m,
           CASE WHEN skip THEN 'skipped' WHEN kind = 'tank' THEN 'tank' WHEN rise >= 0.8 THEN 'points' ELSE 'least' END AS method FROM q""")
def _(t):
    cells = binned(t).where(C("ground_m").isNotNull()).select("cx", "cy", (C("ground_m") + 8).alias("top_m"), "upper_m")
    out = ops.fixture_heights(fixtures(t), cells, 8.0, 20.0, 0.8)
    return out.select("id", "kind", "cells", F.round("roof_m", 5).alias("roof_m"), F.round("top_m", 5).alias("top_m"), "method")


@query("j13_resolve_overrides", """
    WITH f AS (SELECT id, minx, miny, maxx, maxy, bin, replace(doitt_id, '.0', '') AS dk FROM footprints),
    b AS (SELECT request_id, material, f.id, 'bin' AS method FROM overrides o JOIN f ON o.selector = 'bin' AND f.bin = o.id_value),
    d AS (SELECT request_id, material, f.id, 'doitt_id' AS method FROM overrides o JOIN f ON o.selector = 'doitt_id' AND f.dk = o.id_value),
    h AS (SELECT request_id, material, count(DISTINCT dk) AS n, min(f.id) AS id FROM overrides o JOIN f ON o.selector = 'point' AND o.x BETWEEN minx AND maxx AND o.y BETWEEN miny AND maxy GROUP BY request_id, material),
    r AS (SELECT * FROM b UNION ALL SELECT * FROM d UNION ALL SELECT request_id, material, id, 'point' FROM h WHERE n = 1),
    x AS (SELECT id FROM r GROUP BY id HAVING count(DISTINCT material) > 1)
    SELECT request_id, id, material, method, CAST(NULL AS VARCHAR) AS problem FROM r
    UNION ALL SELECT request_id, NULL, NULL, NULL, 'touches several features' FROM h WHERE n > 1
    UNION ALL SELECT request_id, NULL, NULL, NULL, 'matches nothing' FROM overrides WHERE request_id NOT IN (SELECT request_id FROM r) AND request_id NOT IN (SELECT request_id FROM h WHERE n > 1)
    UNION ALL SELECT DISTINCT request_id, NULL, NULL, NULL, 'conflicting colours' FROM r WHERE id IN (SELECT id FROM x)""")
def _(t):
    resolved, problems = ops.resolve_overrides(t.overrides, box_edges(t.footprints), 64.0)
    return resolved.select("request_id", "id", "material", "method", F.lit(None).cast("string").alias("problem")).unionByName(
        problems.select("request_id", "problem"), allowMissingColumns=True)


@query("a14_semantic_counts", """
    WITH d AS (SELECT DISTINCT district, (district % 32)*1000 + 500 AS qx, (district // 32)*1000 + 500 AS qy FROM footprints),
    p AS (SELECT d.district, f.id, greatest(f.minx - qx, qx - f.maxx, 0) + greatest(f.miny - qy, qy - f.maxy, 0) <= 400 AS inside FROM d JOIN footprints f ON f.maxx >= qx - 400 AND f.minx <= qx + 400 AND f.maxy >= qy - 400 AND f.miny <= qy + 400),
    c AS (SELECT district AS area_id, count(*) FILTER (WHERE inside AND id % 4 <> 0) AS buildings, count(*) FILTER (WHERE inside AND id % 4 = 0) AS motor_roads, count(*) FILTER (WHERE id % 4 <> 0) AS buildings_in_box, count(*) FILTER (WHERE id % 4 = 0) AS motor_roads_in_box FROM p GROUP BY 1)
    SELECT area_id, buildings, motor_roads, buildings_in_box, motor_roads_in_box, NOT (buildings >= 10 AND area_id*50 + 90 < floor(buildings*0.25)) AS buildings_ok,
           NOT (area_id*50 + 90 >= 10 AND 3 < floor((area_id*50 + 90)*0.05)) AS roofs_ok, motor_roads < 10 AS roads_ok, buildings*1.0e0 <= 250 AS height_ok FROM c""")
def _(t):
    f = box_edges(t.footprints).withColumn("is_road", C("id") % 4 == 0).withColumn("is_building", C("id") % 4 != 0)
    counts = ops.semantic_counts(f, areas(t), 128.0)
    gated = ops.coverage_gates(counts.select(
        "*", C("buildings").alias("mapped_buildings"), C("motor_roads").alias("mapped_roads"), (C("area_id") * 50 + 90).alias("footprints"),
        F.lit(3).alias("roofs"), F.lit(0).alias("roadbeds"), C("buildings").cast("double").alias("top_mm")))
    return gated.select("area_id", "buildings", "motor_roads", "buildings_in_box", "motor_roads_in_box", "buildings_ok", "roofs_ok", "roads_ok", "height_ok")


LAYER_CLASSES = {"green": (1, 2), "water": (4,), "pads": (7,), "buildings": (5,), "fallback_green": (8,)}


def painted_layers(t):
    cells = t.landcover
    ground = cells.withColumn("ground_m", ground_of())
    flat = lambda names, material, lift: ground.where(C("cls").isin(*names)).select("cx", "cy", F.lit(material).alias("material"), (C("ground_m") + lift).alias("top_m"))
    near = lambda mod, rest: ground.where((C("cx") * 7 + C("cy") * 3) % mod == rest)
    line = lambda df, material, lift: df.select("cx", "cy", F.lit(material).alias("material"), (C("ground_m") + lift).alias("top_m"))
    layers = {
        "green": flat((1, 2), 1, 0.0), "water": flat((4,), 2, -0.5), "pads": flat((7,), 3, 0.16), "buildings": flat((5,), 0, 9.0),
        "fallback_green": flat((8,), 1, 0.0), "roads": line(near(9, 0), 0, 0.48), "trails": line(near(6, 0), 3, 0.48), "road_decks": line(near(31, 3), 0, 5.0),
        "trail_decks": line(near(17, 3), 3, 5.0), "canopy": line(ground.where((C("cls") == 1) & (C("cx") % 3 == 0)), 1, 4.0)}
    return ground.select("cx", "cy", "ground_m"), layers


PAINT = f"""WITH c AS (SELECT cx, cy, cls, {GROUND} AS g FROM landcover),
    l AS (SELECT cx, cy, g, 0 AS p, 1 AS m, g AS tp FROM c WHERE cls = 8 UNION ALL SELECT cx, cy, g, 1, 1, g FROM c WHERE cls IN (1, 2) UNION ALL SELECT cx, cy, g, 2, 2, g - 0.5e0 FROM c WHERE cls = 4
      UNION ALL SELECT cx, cy, g, 3, 3, g + 0.16e0 FROM c WHERE cls = 7 UNION ALL SELECT cx, cy, g, 4, 3, g + 0.48e0 FROM c WHERE (cx*7 + cy*3) % 6 = 0 UNION ALL SELECT cx, cy, g, 5, 0, g + 0.48e0 FROM c WHERE (cx*7 + cy*3) % 9 = 0
      UNION ALL SELECT cx, cy, g, 6, 3, g + 5 FROM c WHERE (cx*7 + cy*3) % 17 = 3 UNION ALL SELECT cx, cy, g, 7, 0, g + 5 FROM c WHERE (cx*7 + cy*3) % 31 = 3 UNION ALL SELECT cx, cy, g, 8, 0, g + 9 FROM c WHERE cls = 5
      UNION ALL SELECT cx, cy, g, 9, 1, g + 4 FROM c WHERE cls = 1 AND cx % 3 = 0),
    w AS (SELECT cx, cy, arg_max(m, p) AS m, arg_max(tp, p) AS tp, bool_or(p = 4) AND bool_or(p = 5) AS yielded FROM l GROUP BY cx, cy)
    SELECT c.cx, c.cy, coalesce(m, 0) AS material, round(coalesce(tp, g), 6) AS top_m, coalesce(yielded, false) AS trail_yielded FROM c LEFT JOIN w ON w.cx = c.cx AND w.cy = c.cy"""


@query("r17_paint_priority", PAINT)
def _(t):
    out = paint.paint_priority(*painted_layers(t))
    return out.select("cx", "cy", "material", F.round("top_m", 6).alias("top_m"), (paint.has_layer("trails") & paint.has_layer("roads")).alias("trail_yielded"))


@query("r17_yield_counts", f"""SELECT count(*) FILTER (WHERE trail_yielded) AS trails_yielded FROM ({PAINT}) p""")
def _(t):
    return paint.yield_counts(paint.paint_priority(*painted_layers(t))).select("trails_yielded")


def stair_runs(t, segments=None):
    s = (way_segments(t) if segments is None else segments).where(C("line_id") % 10 == 7)
    return s.join(s.groupBy("line_id").agg(F.sum("length").alias("line_length")), "line_id")


@query("r27_stair_treads", f"""
    WITH s AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM {SEG} q WHERE x2 IS NOT NULL AND line_id % 10 = 7),
    m AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY pos) - len AS st, sum(len) OVER (PARTITION BY line_id) AS total FROM s),
    e AS (SELECT line_id, max(total) AS total, arg_min(x1, pos) AS ax, arg_min(y1, pos) AS ay, arg_max(x2, pos) AS bx, arg_max(y2, pos) AS byy FROM m GROUP BY line_id),
    g AS (SELECT cx, cy, cls, cls*1.5e0 AS z FROM landcover),
    l AS (SELECT line_id, total, ga.z AS za, gb.z AS zb FROM e JOIN g ga ON ga.cx = CAST(floor(ax/8) AS BIGINT) AND ga.cy = CAST(floor(ay/8) AS BIGINT) JOIN g gb ON gb.cx = CAST(floor(bx/8) AS BIGINT) AND gb.cy = CAST(floor(byy/8) AS BIGINT)),
    k AS (SELECT *, least(floor(total*0.0762e0/0.4e0), floor(abs(zb-za)*0.375e0/0.08e0)) AS treads FROM l WHERE total*0.0762e0 >= 0.9),
    r AS (SELECT m.*, treads FROM m JOIN k USING (line_id) WHERE treads >= 2),
    c AS (SELECT line_id, treads, cx, cy FROM (SELECT r.*, unnest(range(CAST(floor((least(x1, x2) - 6)/8) AS BIGINT), CAST(floor((greatest(x1, x2) + 6)/8) AS BIGINT) + 1)) AS cx FROM r) p,
          LATERAL (SELECT unnest(range(CAST(floor((least(p.y1, p.y2) - 6)/8) AS BIGINT), CAST(floor((greatest(p.y1, p.y2) + 6)/8) AS BIGINT) + 1)) AS cy) q,
          LATERAL (SELECT CASE WHEN len = 0 THEN 0 ELSE least(greatest(((cx*8+4-x1)*(x2-x1) + (cy*8+4-y1)*(y2-y1))/(len*len), 0), 1) END AS sh) h WHERE pow(cx*8+4-x1-(x2-x1)*sh, 2) + pow(cy*8+4-y1-(y2-y1)*sh, 2) <= 36.0e0 GROUP BY line_id, treads, cx, cy)
    SELECT line_id, CAST(max(treads) AS BIGINT) AS treads, count(*) FILTER (WHERE cls IS NULL OR cls <> 7) AS cells, count(*) FILTER (WHERE cls = 7) AS yielded FROM c LEFT JOIN g ON g.cx = c.cx AND g.cy = c.cy WHERE cls IS NULL OR cls NOT IN (4, 5) GROUP BY line_id""")
def _(t):
    ground = t.landcover.select("cx", "cy", (C("cls") * F.lit(1.5)).alias("ground_m"))
    of = lambda k: t.landcover.where(C("cls") == k).select("cx", "cy")
    _, report = paint.stair_treads(stair_runs(t), ground, of(5), of(4), of(7), size=8.0, width_ft=12.0, mm_per_ft=0.0762, mm_per_m=0.375, relief_m=0.5)
    return report


@query("r29_restore_over_tunnels", f"""
    WITH c AS (SELECT cx, cy, {GROUND} AS g, cls, (cx + cy) % 3 = 0 AS tun, cls IN (1, 2) AS park, cx % 7 = 0 AS bri, cy % 5 = 0 AS rt FROM landcover)
    SELECT cx, cy, tun AND (bri OR rt) AS protected, tun AND park AND NOT (tun AND (bri OR rt)) AS restored,
           round(CASE WHEN tun AND park AND NOT (bri OR rt) THEN g ELSE g + cls END, 6) AS top_m, round(CASE WHEN bri THEN least(g + 6, g + cls) ELSE g + 6 END, 6) AS deck_m FROM c""")
def _(t):
    cells = t.landcover.withColumn("ground_m", ground_of()).select(
        "cx", "cy", "ground_m", (C("ground_m") + C("cls")).alias("top_m"), ((C("cx") + C("cy")) % 3 == 0).alias("tunnel"), C("cls").isin(1, 2).alias("park"),
        (C("cx") % 7 == 0).alias("bridge"), (C("cy") % 5 == 0).alias("surface_route"), paint.cap_deck(C("ground_m") + 6, F.when(C("cx") % 7 == 0, C("ground_m") + C("cls"))).alias("deck_m"))
    return paint.restore_over_tunnels(cells).select("cx", "cy", "protected", "restored", F.round("top_m", 6).alias("top_m"), F.round("deck_m", 6).alias("deck_m"))


@query("r28_deck_profiles")
def _(t):
    s = ordered.segments(t.vertices).where(C("way_id") % 9 == 0)
    bridges = s.join(s.groupBy("way_id").agg(F.sum("length").alias("line_length")), "way_id").withColumn("carriageway", (C("way_id") % 10).isin(0, 1, 2, 9))
    ground = t.landcover.select("cx", "cy", ground_of().alias("ground_m"))
    structures = surfaces(t).where(C("id") % 5 == 0)
    spots = t.spots.withColumnRenamed("elevation_ft", "value")
    return paint.deck_profiles(bridges, structures, spots, ground, size=8.0, near_ft=6.56, spot_ft=3.0, ribbon_ft=20.0)
