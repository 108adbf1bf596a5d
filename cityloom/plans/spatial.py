"""Spatial joins, rasterizing and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import ordered, overlay, spatial
from .registry import query

C = F.col
SQUARE = 64.0
BOX = spatial.BOX
# parity of edge crossings to the right of (px, py)
CROSSED = """sum(CASE WHEN (e.y1 > py) <> (e.y2 > py) AND CASE WHEN e.y2 > e.y1 THEN (e.x2-e.x1)*(py-e.y1) > (px-e.x1)*(e.y2-e.y1)
                       ELSE (e.x2-e.x1)*(py-e.y1) < (px-e.x1)*(e.y2-e.y1) END THEN 1 ELSE 0 END) % 2 = 1"""
INSIDE = f"""SELECT point_id, px AS x, py AS y, z_ft, f.id AS polygon_id FROM (SELECT point_id, x AS px, y AS py, z_ft FROM points) p
    JOIN footprints f ON px BETWEEN f.minx AND f.maxx AND py BETWEEN f.miny AND f.maxy JOIN edges e ON e.id = f.id
    GROUP BY point_id, px, py, z_ft, f.id HAVING {CROSSED}"""


@query("j1_points_in_polygons", f"SELECT polygon_id, count(*) AS points, max(z_ft) AS top FROM ({INSIDE}) i GROUP BY polygon_id")
def _(t):
    pairs = spatial.points_in_polygons(t.points.select("point_id", "x", "y", "z_ft").distinct(), t.polygons, SQUARE)
    return pairs.groupBy("polygon_id").agg(F.count("*").alias("points"), F.max("z_ft").alias("top"))


@query("j1_points_outside", f"""
    SELECT cls, count(*) AS points FROM (SELECT DISTINCT point_id, x, y, z_ft, cls FROM points) p
    WHERE NOT EXISTS (SELECT 1 FROM ({INSIDE}) i WHERE i.point_id = p.point_id AND i.x = p.x AND i.y = p.y) GROUP BY cls""")
def _(t):
    points = t.points.select("point_id", "x", "y", "z_ft", "cls").distinct()
    return spatial.points_in_polygons(points, t.polygons, SQUARE, "left_anti").groupBy("cls").agg(F.count("*").alias("points"))


@query("j1_covering_polygons", f"""
    SELECT DISTINCT p.id, f.id AS polygon_id FROM (SELECT id, x AS px, y AS py FROM spots) p
      JOIN footprints f ON px BETWEEN f.minx AND f.maxx AND py BETWEEN f.miny AND f.maxy JOIN edges e ON e.id = f.id
    GROUP BY p.id, px, py, f.id HAVING {CROSSED} OR bool_or((e.x2-e.x1)*(py-e.y1) = (px-e.x1)*(e.y2-e.y1)
      AND px BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND py BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))""")
def _(t):
    return spatial.points_in_polygons(t.spots, t.polygons, SQUARE, boundary=True).select("id", "polygon_id")


@query("j2_bbox_join", """
    SELECT f.id AS a_id, r.id AS b_id FROM footprints f JOIN roofs r ON f.minx <= r.maxx AND r.minx <= f.maxx AND f.miny <= r.maxy AND r.miny <= f.maxy""")
def _(t):
    return spatial.bbox_join(t.footprints.select("id", *BOX), t.roofs.select("id", *BOX), SQUARE).select("a_id", "b_id")


@query("j3_tile_sources", """
    WITH tl AS (SELECT DISTINCT CAST(floor(minx/100) AS BIGINT) AS tx, CAST(floor(miny/100) AS BIGINT) AS ty FROM footprints)
    SELECT concat(tx, '_', ty) AS tile_id, count(*) AS sources, string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY r.id) AS source_ids
    FROM tl JOIN roofs r ON r.maxx >= tx*100 - 10 AND r.minx <= tx*100 + 110 AND r.maxy >= ty*100 - 10 AND r.miny <= ty*100 + 110 GROUP BY tx, ty""")
def _(t):
    tx, ty = F.floor(C("minx") / 100), F.floor(C("miny") / 100)
    tiles = t.footprints.select(tx.alias("tx"), ty.alias("ty")).distinct().select(
        F.concat_ws("_", "tx", "ty").alias("id"), (C("tx") * F.lit(100.0)).alias("minx"), (C("ty") * F.lit(100.0)).alias("miny"),
        (C("tx") * F.lit(100.0) + 100).alias("maxx"), (C("ty") * F.lit(100.0) + 100).alias("maxy"))
    out = spatial.tile_sources(tiles, t.roofs, 10.0, SQUARE)
    return out.select("tile_id", "sources", F.array_join(F.transform("source_ids", lambda v: v.cast("string")), ",").alias("source_ids"))


# exact shared area: strips under the lower of two edges, over their common x-range
STRIP = """CASE WHEN r > l THEN sign(ax1-ax2)*sign(bx1-bx2)*(r-l)/2*
      CASE WHEN (al-bl)*(ar-br) < 0 THEN (al-bl)/((al-bl)-(ar-br))*(least(al,bl) + al+(ar-al)*(al-bl)/((al-bl)-(ar-br)))
             + (1-(al-bl)/((al-bl)-(ar-br)))*(al+(ar-al)*(al-bl)/((al-bl)-(ar-br)) + least(ar,br)) ELSE least(al,bl)+least(ar,br) END ELSE 0 END"""


def shared_sql(left, right, on):
    """SQL for the shared area of polygon pairs; ``left`` and ``right`` are edge tables (id, x1, y1, x2, y2, base columns)."""
    return f"""SELECT aid, bid, sum({STRIP}) AS overlap FROM (
      SELECT *, ay1 + (ay2-ay1)*(l-ax1)/nullif(ax2-ax1, 0) - base AS al, ay1 + (ay2-ay1)*(r-ax1)/nullif(ax2-ax1, 0) - base AS ar,
             by1 + (by2-by1)*(l-bx1)/nullif(bx2-bx1, 0) - base AS bl, by1 + (by2-by1)*(r-bx1)/nullif(bx2-bx1, 0) - base AS br FROM (
        SELECT a.id AS aid, b.id AS bid, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
               greatest(least(a.x1, a.x2), least(b.x1, b.x2)) AS l, least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) AS r, least(p.amin, p.bmin) AS base
        FROM ({on}) p JOIN {left} a ON a.id = p.aid JOIN {right} b ON b.id = p.bid) e) s GROUP BY aid, bid"""


ROOF_EDGES = """(SELECT id, CASE k WHEN 0 THEN minx WHEN 1 THEN maxx WHEN 2 THEN maxx ELSE minx END AS x1, CASE k WHEN 0 THEN miny WHEN 1 THEN miny WHEN 2 THEN maxy ELSE maxy END AS y1,
      CASE k WHEN 0 THEN maxx WHEN 1 THEN maxx WHEN 2 THEN minx ELSE minx END AS x2, CASE k WHEN 0 THEN miny WHEN 1 THEN maxy WHEN 2 THEN maxy ELSE miny END AS y2
    FROM roofs CROSS JOIN range(4) AS k4(k))"""
ROOF_PAIRS = """SELECT r.id AS aid, f.id AS bid, r.miny AS amin, f.miny AS bmin FROM roofs r JOIN footprints f
    ON f.minx <= r.maxx AND r.minx <= f.maxx AND f.miny <= r.maxy AND r.miny <= f.maxy"""


@query("j4_overlap_join", f"SELECT aid AS roof_id, bid AS footprint_id, round(overlap, 4) AS overlap FROM ({shared_sql(ROOF_EDGES, 'edges', ROOF_PAIRS)}) o WHERE overlap > 1e-9")
def _(t):
    out = overlay.overlap_join(t.roof_polygons.select("id", "edges", *BOX), t.polygons.select("id", "edges", *BOX), SQUARE)
    return out.select(C("a_id").alias("roof_id"), C("b_id").alias("footprint_id"), F.round("overlap", 4).alias("overlap"))


@query("p6_clip_bbox", "SELECT id, minx, miny, maxx, maxy FROM footprints WHERE maxx >= 200 AND minx <= 600 AND maxy >= 300 AND miny <= 700")
def _(t):
    return spatial.clip_bbox(t.footprints, (200.0, 300.0, 600.0, 700.0)).select("id", *BOX)


def areas(t):
    """One diamond per district, 400 ft to each corner."""
    cx, cy = C("ox") + 500, C("oy") + 500
    corners = [(cx, cy - 400), (cx + 400, cy), (cx, cy + 400), (cx - 400, cy)]
    edges = F.array(*[g.edge(a[0], a[1], b[0], b[1]) for a, b in zip(corners, corners[1:] + corners[:1])])
    return t.districts.select(C("district").alias("id"), edges.alias("edges"), (cx - 400).alias("minx"), (cy - 400).alias("miny"), (cx + 400).alias("maxx"), (cy + 400).alias("maxy"))


@query("p7_filter_polygon", """
    WITH a AS (SELECT f.*, (district % 32)*1000 + 500 AS qx, (district // 32)*1000 + 500 AS qy FROM footprints f),
    c AS (SELECT a.id, shape, district, max(abs(e.x1 - qx) + abs(e.y1 - qy)) AS far FROM a JOIN edges e ON e.id = a.id GROUP BY a.id, shape, district),
    n AS (SELECT a.id, min(CASE WHEN shape <> 1 THEN greatest(minx - qx, qx - maxx, 0) + greatest(miny - qy, qy - maxy, 0)
           ELSE greatest(abs((minx+maxx)/2 - qx) - (maxx-minx)/2, 0) + greatest(abs((miny+maxy)/2 - qy) - (maxy-miny)/2, 0) END) AS near FROM a GROUP BY a.id)
    SELECT id, true AS within_area FROM c WHERE far <= 400""")
def _(t):
    out = overlay.filter_polygon(t.polygons.select("id", "edges", *BOX), areas(t), "within", 128.0)
    return out.select("id", F.lit(True).alias("within_area"))


@query("p7_intersecting_boxes", """
    SELECT f.id, d.district AS area_id FROM footprints f JOIN (SELECT DISTINCT district, (district % 32)*1000 + 500 AS qx, (district // 32)*1000 + 500 AS qy FROM footprints) d
      ON greatest(f.minx - qx, qx - f.maxx, 0) + greatest(f.miny - qy, qy - f.maxy, 0) <= 400""")
def _(t):
    x0, y0, x1, y1 = (C(c) for c in BOX)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    boxes = t.footprints.select("id", F.array(*[g.edge(a[0], a[1], b[0], b[1]) for a, b in zip(corners, corners[1:] + corners[:1])]).alias("edges"), *BOX)
    return overlay.filter_polygon(boxes, areas(t), "intersects", 128.0).select("id", "area_id")


def way_segments(t):
    return ordered.segments(t.vertices).withColumnRenamed("way_id", "line_id")


SEG = "(SELECT way_id AS line_id, pos, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices WINDOW w AS (PARTITION BY way_id ORDER BY pos))"
CROSSINGS = f"""SELECT line_id, pos, id, len, sg, least(greatest(((ex + (fx-ex)*a/(a-b) - x1)*dx + (ey + (fy-ey)*a/(a-b) - y1)*dy)/(dx*dx+dy*dy), 0), 1) AS pl FROM (
      SELECT *, dx*(ey-y1) - dy*(ex-x1) AS a, dx*(fy-y1) - dy*(fx-x1) AS b, sqrt(dx*dx+dy*dy) AS len,
             CASE WHEN dx*(ey-y1) - dy*(ex-x1) >= 0 THEN 1 ELSE 0 END - CASE WHEN dx*(fy-y1) - dy*(fx-x1) >= 0 THEN 1 ELSE 0 END AS sg FROM (
        SELECT s.*, x2-x1 AS dx, y2-y1 AS dy, f.id, e.ex, e.ey, e.fx, e.fy FROM {SEG} s
          JOIN footprints f ON least(s.x1, s.x2) <= f.maxx AND greatest(s.x1, s.x2) >= f.minx AND least(s.y1, s.y2) <= f.maxy AND greatest(s.y1, s.y2) >= f.miny
          JOIN (SELECT id, x1 AS ex, y1 AS ey, x2 AS fx, y2 AS fy FROM edges) e ON e.id = f.id WHERE s.x2 IS NOT NULL AND (s.x1 <> s.x2 OR s.y1 <> s.y2)) q) r WHERE sg <> 0"""


@query("j5_line_in_polygon", f"SELECT line_id, id AS polygon_id, round(sum(sg*(1-pl)*len) + 0.0000123e0, 4) AS inside_length FROM ({CROSSINGS}) c GROUP BY line_id, id HAVING sum(sg*(1-pl)*len) > 1e-9")
def _(t):
    out = spatial.line_in_polygon_length(way_segments(t), t.polygons, SQUARE)
    # the offset moves lengths on the 1/16 ft grid off the rounding ties, here and in the SQL
    return out.withColumn("inside_length", F.round(C("inside_length") + 0.0000123, 4))


SUPPORT = f"""WITH ev AS (SELECT line_id, pos, len, pl, sum(sg) AS sg FROM ({CROSSINGS}) c GROUP BY line_id, pos, len, pl),
    sw AS (SELECT *, sum(sg) OVER (PARTITION BY line_id, pos ORDER BY pl) AS depth, coalesce(lead(pl) OVER (PARTITION BY line_id, pos ORDER BY pl), 1) - pl AS reach FROM ev),
    cv AS (SELECT line_id, sum(CASE WHEN depth > 0 THEN reach*len ELSE 0 END) AS covered FROM sw GROUP BY line_id),
    ln AS (SELECT line_id, sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) AS length FROM {SEG} s WHERE x2 IS NOT NULL GROUP BY line_id)
    SELECT line_id, length, CASE WHEN length > 0 THEN least(1, coalesce(covered, 0)/length) ELSE 0 END AS support FROM ln LEFT JOIN cv USING (line_id)"""


@query("j5_line_support", f"SELECT line_id, round(length, 4) AS length, round(support, 6) AS support FROM ({SUPPORT}) s")
def _(t):
    out = spatial.line_support(way_segments(t), t.polygons, SQUARE)
    return out.select("line_id", F.round("length", 4).alias("length"), F.round("support", 6).alias("support"))


@query("j7_nearest_within", """
    WITH q AS (SELECT id, minx AS x, miny AS y, 46.0e0 + id % 5 AS fallback FROM footprints),
    n AS (SELECT q.id, s.elevation_ft, row_number() OVER (PARTITION BY q.id ORDER BY (s.x-q.x)*(s.x-q.x)+(s.y-q.y)*(s.y-q.y), s.id) AS rn
          FROM q JOIN spots s ON s.x BETWEEN q.x - 40 AND q.x + 40 AND s.y BETWEEN q.y - 40 AND q.y + 40
            AND (s.x-q.x)*(s.x-q.x)+(s.y-q.y)*(s.y-q.y) <= 1600 AND abs(s.elevation_ft - fallback) <= 3),
    m AS (SELECT id, median(elevation_ft) AS v, count(*) AS c FROM n WHERE rn <= 3 GROUP BY id)
    SELECT q.id, round(coalesce(v, fallback), 6) AS value, coalesce(c, 0) AS spots,
           CASE WHEN v IS NULL THEN 'ground' ELSE 'spot' END AS method FROM q LEFT JOIN m ON m.id = q.id""")
def _(t):
    asked = t.footprints.select("id", C("minx").alias("x"), C("miny").alias("y"), (F.lit(46.0) + C("id") % 5).alias("fallback"))
    out = spatial.nearest_within(asked, t.spots.withColumnRenamed("elevation_ft", "value"), 3, 40.0, 3.0)
    return out.select("id", F.round("value", 6).alias("value"), "spots", "method")


@query("j9_route_crossings", f"""
    WITH s AS (SELECT * FROM (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM {SEG} q WHERE x2 IS NOT NULL) r),
    m AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY pos) - len AS st, sum(len) OVER (PARTITION BY line_id) AS total FROM s),
    p AS (SELECT a.line_id AS upper_id, a.pos AS upper_pos, b.line_id AS lower_id, b.pos AS lower_pos, b.st, b.total, b.len,
             (a.x2-a.x1)*(b.y2-b.y1) - (a.y2-a.y1)*(b.x2-b.x1) AS det, (b.x1-a.x1)*(b.y2-b.y1) - (b.y1-a.y1)*(b.x2-b.x1) AS tn, (b.x1-a.x1)*(a.y2-a.y1) - (b.y1-a.y1)*(a.x2-a.x1) AS un
          FROM m a JOIN m b ON a.line_id <> b.line_id AND a.line_id % 13 <> 0 AND b.line_id % 13 = 0
            AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2))
    SELECT upper_id, lower_id, count(*) AS crossings, round(min(st + un/det*len), 3) AS first_at FROM p
    WHERE det <> 0 AND tn/det >= 0 AND tn/det < 1 AND un/det >= 0 AND un/det < 1 AND st + un/det*len BETWEEN 0.05 AND total - 0.05 GROUP BY upper_id, lower_id""")
def _(t):
    s = ordered.segments(t.vertices)
    total = s.groupBy("way_id").agg(F.sum("length").alias("line_length"))
    ends = ["way_id", "pos", "x1", "y1", "x2", "y2"]
    lower = s.where(C("way_id") % 13 == 0).join(total, "way_id").select(*ends, "start_length", "line_length")
    out = spatial.route_crossings(s.where(C("way_id") % 13 != 0).select(*ends), lower, 32.0)
    return out.groupBy("upper_id", "lower_id").agg(F.count("*").alias("crossings"), F.round(F.min("at"), 3).alias("first_at"))


@query("j15_linear_reference", f"""
    WITH s AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM {SEG} q WHERE x2 IS NOT NULL),
    m AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY pos) - len AS st, sum(len) OVER (PARTITION BY line_id) AS total FROM s),
    p AS (SELECT sp.id AS point_id, m.*, sp.x AS px, sp.y AS py, CASE WHEN len = 0 THEN 0 ELSE least(greatest(((sp.x-x1)*(x2-x1)+(sp.y-y1)*(y2-y1))/(len*len), 0), 1) END AS sh
          FROM spots sp JOIN m ON sp.x BETWEEN least(x1, x2) - 12 AND greatest(x1, x2) + 12 AND sp.y BETWEEN least(y1, y2) - 12 AND greatest(y1, y2) + 12),
    d AS (SELECT *, sqrt(pow(px - x1 - (x2-x1)*sh, 2) + pow(py - y1 - (y2-y1)*sh, 2)) AS dist FROM p)
    SELECT point_id, line_id, round(min(dist), 4) AS dist FROM d WHERE dist <= 12 GROUP BY point_id, line_id""")
def _(t):
    s = way_segments(t)
    total = s.groupBy("line_id").agg(F.sum("length").alias("line_length"))
    out = spatial.linear_reference(t.spots.select(C("id").alias("point_id"), "x", "y"), s.join(total, "line_id"), 12.0)
    return out.select("point_id", "line_id", F.round("dist", 4).alias("dist"))


@query("j17_too_close_pairs", """
    SELECT a_id, b_id, round(gap, 6) AS gap FROM (SELECT a.id AS a_id, b.id AS b_id,
      sqrt(pow(greatest(b.minx - a.maxx, a.minx - b.maxx, 0), 2) + pow(greatest(b.miny - a.maxy, a.miny - b.maxy, 0), 2)) AS gap
      FROM footprints a JOIN footprints b ON a.id < b.id AND a.minx <= b.maxx + 3 AND b.minx <= a.maxx + 3 AND a.miny <= b.maxy + 3 AND b.miny <= a.maxy + 3) p WHERE gap < 3""")
def _(t):
    return spatial.too_close_pairs(t.footprints.select("id", *BOX), 3.0, SQUARE).withColumn("gap", F.round("gap", 6))


def raster_sql(size):
    return f"""SELECT p.id, cx, cy FROM (SELECT id, minx, miny, maxx, maxy, unnest(range(CAST(floor(minx/{size}) AS BIGINT), CAST(floor(maxx/{size}) AS BIGINT) + 1)) AS cx FROM footprints) p,
      LATERAL (SELECT unnest(range(CAST(floor(p.miny/{size}) AS BIGINT), CAST(floor(p.maxy/{size}) AS BIGINT) + 1)) AS cy) q,
      LATERAL (SELECT cx*{size} + {size / 2}e0 AS px, cy*{size} + {size / 2}e0 AS py) c JOIN edges e ON e.id = p.id GROUP BY p.id, cx, cy, px, py HAVING {CROSSED}"""


RASTER = raster_sql(2)


@query("r2_rasterize", f"SELECT cx, cy, max(id) AS id FROM ({RASTER}) r GROUP BY cx, cy")
def _(t):
    return spatial.rasterize(t.polygons, 2.0)


@query("r2_rasterize_touched", """
    SELECT cx, cy, max(id) AS id FROM (SELECT id, maxy, miny, unnest(range(CAST(floor(minx/2) AS BIGINT), CAST(floor(maxx/2) AS BIGINT) + 1)) AS cx FROM roofs) p,
      LATERAL (SELECT unnest(range(CAST(floor(p.miny/2) AS BIGINT), CAST(floor(p.maxy/2) AS BIGINT) + 1)) AS cy) q GROUP BY cx, cy""")
def _(t):
    return spatial.rasterize(t.roof_polygons, 2.0, "all_touched")


@query("r14_sample_lines", f"""
    WITH s AS (SELECT *, greatest(ceil(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/8), 1) AS n FROM {SEG} q WHERE x2 IS NOT NULL),
    d AS (SELECT line_id, x1 + (x2-x1)*(k/n) AS x, y1 + (y2-y1)*(k/n) AS y FROM s, LATERAL (SELECT unnest(range(CAST(n AS BIGINT))) AS k) u
          UNION ALL SELECT way_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY pos DESC) AS rn, count(*) OVER (PARTITION BY way_id) AS c FROM vertices) v WHERE rn = 1 AND c > 1)
    SELECT line_id, cls, count(*) AS samples FROM d JOIN landcover l ON l.cx = CAST(floor(d.x/8) AS BIGINT) AND l.cy = CAST(floor(d.y/8) AS BIGINT) GROUP BY line_id, cls""")
def _(t):
    return spatial.sample_lines(way_segments(t), t.landcover, 8.0).groupBy("line_id", "cls").agg(F.count("*").alias("samples"))


@query("f14_polygon_measures", """
    SELECT f.id, CASE shape WHEN 1 THEN w*h/2 WHEN 2 THEN w*h - (w-2)*(h-2) ELSE w*h END AS area,
           round(CASE shape WHEN 1 THEN 2*sqrt(w*w + h*h) WHEN 2 THEN 2*(w+h) + 2*(w+h-4) ELSE 2*(w+h) END, 6) AS perimeter,
           round((minx+maxx)/2, 6) AS centre_x, round((miny+maxy)/2, 6) AS centre_y, w, h,
           round(CASE shape WHEN 1 THEN w*h/sqrt(w*w + h*h) ELSE least(w, h) END, 6) AS narrow
    FROM (SELECT *, maxx - minx AS w, maxy - miny AS h FROM footprints) f""")
def _(t):
    e = C("edges")
    mid, box = g.centroid(e), g.bbox(e)
    out = t.polygons.select(
        "id", "shape", g.area(e).alias("area"), F.round(g.perimeter(e), 6).alias("perimeter"), F.round(mid["x"], 6).alias("centre_x"),
        F.round(mid["y"], 6).alias("centre_y"), (box["maxx"] - box["minx"]).alias("w"), (box["maxy"] - box["miny"]).alias("h"), g.min_width(e).alias("narrow"))
    return out.select("id", "area", "perimeter", "centre_x", "centre_y", "w", "h", F.round("narrow", 6).alias("narrow"))
