"""Street queries, line fits, and the road symbol report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as tg
from ..functions.lattice import FT
from ..operators import ordered, roads, spatial, stats
from ..runtime import cut
from .registry import query
from .spatial import CROSSINGS, SEG, SUPPORT, raster_sql, way_segments

C = F.col
MM_PER_FT = FT * 1000 / 4000.0


def _ways(t):
    return t.ways.select("way_id", "highway", tg.parse_tags(C("tags")).alias("tags"))


KEY_SQL = "CASE WHEN way_id % 4 = 0 THEN concat('osm:', CAST(way_id AS VARCHAR)) ELSE concat('street ', CAST(way_id % 40 AS VARCHAR)) END"
WIDTH_SQL = "CASE WHEN way_id % 6 = 0 THEN 9.0e0 WHEN way_id % 6 = 1 THEN 30*0.3048e0 WHEN way_id % 5 = 0 THEN 6.4e0 WHEN way_id % 5 = 1 THEN 4*3.2e0 END"
DEFAULT_SQL = "CASE highway WHEN 'motorway' THEN 24.0e0 WHEN 'primary' THEN 17 WHEN 'residential' THEN 9 WHEN 'service' THEN 7 WHEN 'pedestrian' THEN 8 WHEN 'road' THEN 9 WHEN 'tertiary_link' THEN 8 ELSE 9 END"
SAMPLES_SQL = f"""SELECT {KEY_SQL.replace('way_id', 'o_custkey')} AS route_key, 3 + (o_orderkey*7 % 311)/10.0e0 AS width_m FROM orders WHERE o_custkey % 3 = 0"""


def width_samples(t):
    name = F.when(C("o_custkey") % 4 == 0, F.concat(F.lit("osm:"), C("o_custkey").cast("string"))).otherwise(F.concat(F.lit("street "), (C("o_custkey") % 40).cast("string")))
    return t.orders.where(C("o_custkey") % 3 == 0).select(name.alias("route_key"), (F.lit(3) + C("o_orderkey") * 7 % 311 / F.lit(10.0)).alias("width_m"))


@query("a6_route_widths", f"""
    WITH s AS (SELECT route_key, quantile_cont(width_m, 0.3) AS measured, count(*) AS samples FROM ({SAMPLES_SQL}) q GROUP BY 1),
    w AS (SELECT {KEY_SQL} AS route_key, median({WIDTH_SQL}) AS tagged, max({DEFAULT_SQL}) AS by_class, bool_or(highway IN ('motorway', 'primary')) AS major, count(*) AS ways FROM ways GROUP BY 1)
    SELECT route_key, ways, round(least(greatest(coalesce(measured, tagged, by_class), 2.5), 60), 6) AS width_m,
           CASE WHEN measured IS NOT NULL THEN 'measured_p30' WHEN tagged IS NOT NULL THEN 'tags' ELSE 'class' END AS method,
           coalesce(samples, 0) AS samples, major, CASE WHEN major THEN 1.0e0 ELSE 0.875e0 END AS printed_mm FROM w LEFT JOIN s USING (route_key)""")
def _(t):
    routes = _ways(t).withColumn("route_key", tg.route_key(C("tags"), C("way_id")))
    return roads.route_widths(routes, width_samples(t)).withColumn("width_m", F.round("width_m", 6))


@query("a7_dominant_bearing", f"""
    WITH s AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM {SEG} q WHERE x2 IS NOT NULL),
    u AS (SELECT ((degrees(atan2(dx, dy)) % 90) + 90) % 90 AS angle, sqrt(dx*dx+dy*dy)*CASE highway WHEN 'motorway' THEN 6 WHEN 'primary' THEN 4 WHEN 'residential' THEN 1.5e0 END AS w
          FROM s JOIN ways ON way_id = line_id WHERE sqrt(dx*dx+dy*dy) > 20 AND highway IN ('motorway', 'primary', 'residential')),
    h AS (SELECT least(CAST(floor(angle/0.25e0) AS BIGINT), 359) AS bin, sum(w) AS w FROM u GROUP BY 1),
    sm AS (SELECT (bin + o + 360) % 360 AS bin, round(sum(w*(5-abs(o)))/25, 6) AS w FROM h, range(-4, 5) r(o) GROUP BY 1),
    p AS (SELECT bin*0.25e0 + 0.125e0 AS p FROM sm ORDER BY w DESC, bin LIMIT 1),
    f AS (SELECT (((angle - p + 45) % 90) + 90) % 90 - 45 AS off, w, p FROM u, p),
    g AS (SELECT count(*) AS segments, sum(w) AS weighted_ft, sum(w) FILTER (WHERE abs(off) <= 5) AS n, sum(w*off) FILTER (WHERE abs(off) <= 5) AS o, min(p) AS p FROM f)
    SELECT segments, round(weighted_ft, 3) AS weighted_ft, round(n/weighted_ft, 6) AS coherence, CASE WHEN n/weighted_ft >= 0.05 THEN round((p + o/n + 90) % 90, 6) END AS bearing_deg,
           CASE WHEN n/weighted_ft >= 0.05 THEN 'osm_streets' ELSE 'none' END AS source FROM g""")
def _(t):
    s = way_segments(t).join(t.ways.select(C("way_id").alias("line_id"), "highway"), "line_id")
    out = roads.dominant_bearing(s, least_share=0.05)
    return out.select("segments", F.round("weighted_ft", 3).alias("weighted_ft"), F.round("coherence", 6).alias("coherence"), F.round("bearing_deg", 6).alias("bearing_deg"), "source")


def line_samples(t):
    place = C("o_orderkey") % 97 / F.lit(96.0)
    bump = F.when(C("o_orderkey") % 11 == 0, 40.0).otherwise(0.0)
    return t.orders.select(C("o_custkey").alias("line_id"), place.alias("place"), (place * 5 + C("o_totalprice") % 1 + bump).alias("z"))


LINE_SAMPLES = "SELECT o_custkey AS line_id, (o_orderkey % 97)/96.0e0 AS place, (o_orderkey % 97)/96.0e0*5 + o_totalprice % 1 + CASE WHEN o_orderkey % 11 = 0 THEN 40 ELSE 0 END AS z, o_orderkey AS k FROM orders"


@query("x3_theil_sen", f"""
    WITH s AS ({LINE_SAMPLES}) SELECT a.line_id, round(median((a.z - b.z)/(a.place - b.place)), 6) AS slope FROM s a JOIN s b ON a.line_id = b.line_id AND a.k < b.k AND abs(a.place - b.place) > 1e-9 GROUP BY a.line_id""")
def _(t):
    return line_samples(t).groupBy("line_id").agg(F.round(stats.theil_sen(C("place"), C("z")), 6).alias("slope")).where(C("slope").isNotNull() & ~F.isnan("slope"))


@query("a13_robust_line_fit", f"""
    WITH s AS ({LINE_SAMPLES}), b AS (SELECT line_id, count(*) AS n, max(place) - min(place) AS rng, median(z) AS med FROM s GROUP BY line_id),
    sl AS (SELECT a.line_id, median((a.z - c.z)/(a.place - c.place)) AS slope FROM s a JOIN s c ON a.line_id = c.line_id AND a.k < c.k AND abs(a.place - c.place) > 1e-9 JOIN b ON b.line_id = a.line_id AND n >= 3 AND rng >= 0.2 GROUP BY a.line_id),
    st AS (SELECT s.line_id, slope, median(z - slope*place) AS start FROM s JOIN sl USING (line_id) GROUP BY s.line_id, slope),
    r AS (SELECT s.*, slope, start, z - slope*place - start AS res FROM s JOIN st USING (line_id)), c AS (SELECT line_id, median(res) AS mid FROM r GROUP BY line_id),
    d AS (SELECT r.*, abs(res - mid) AS dev FROM r JOIN c USING (line_id)), m AS (SELECT line_id, median(dev) AS mad FROM d GROUP BY line_id),
    k AS (SELECT d.*, dev <= greatest(0.30, mad*3.5e0*1.4826e0) AS ok FROM d JOIN m USING (line_id)),
    f AS (SELECT line_id, min(slope) AS slope, min(start) AS start, count(*) FILTER (WHERE ok) AS kept, count(*) AS n, max(place) FILTER (WHERE ok) - min(place) FILTER (WHERE ok) AS krng,
             regr_slope(z, place) FILTER (WHERE ok) AS bb, regr_intercept(z, place) FILTER (WHERE ok) AS aa, min(z) FILTER (WHERE ok) AS klo, max(z) FILTER (WHERE ok) AS khi, min(z) AS lo, max(z) AS hi FROM k GROUP BY line_id),
    q AS (SELECT line_id, CASE WHEN u THEN aa ELSE start END AS a, CASE WHEN u THEN bb ELSE slope END AS b, CASE WHEN u THEN klo ELSE lo END AS lo, CASE WHEN u THEN khi ELSE hi END AS hi, CASE WHEN u THEN kept ELSE n END AS samples, n
          FROM (SELECT *, kept >= 3 AND krng >= 0.2 AS u FROM f) f2)
    SELECT line_id, round(least(greatest(a, lo - mg), hi + mg), 4) AS start_z, round(least(greatest(a + b, lo - mg), hi + mg), 4) AS end_z, samples, n - samples AS rejected, 'fitted' AS method
    FROM (SELECT *, greatest(0.5, (hi - lo)*0.25e0) AS mg FROM q) z UNION ALL SELECT line_id, round(med, 4), round(med, 4), n, 0, 'median' FROM b WHERE n < 3 OR rng < 0.2""")
def _(t):
    out = stats.robust_line_fit(line_samples(t))
    return out.select("line_id", F.round("start_z", 4).alias("start_z"), F.round("end_z", 4).alias("end_z"), "samples", "rejected", "method")


def _measured(t):
    s = way_segments(t)
    return s.join(s.groupBy("line_id").agg(F.sum("length").alias("line_length")), "line_id")


FOOT = "0.3048006096012192e0"
FIRST = "CAST(ceil((({at} - which*reach)/total - 0.1e0)/0.8e0*(n - 1) - 1e-9) AS BIGINT)"


@query("r23_road_width_samples", f"""
    WITH s AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY pos) - len AS st, sum(len) OVER (PARTITION BY line_id) AS total FROM (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len FROM {SEG} q WHERE x2 IS NOT NULL) l),
    u AS (SELECT *, least(greatest(ceil(total/(15/{FOOT})), 3), 30) AS n, least(5/{FOOT}, greatest(total*0.05e0, 0.2e0/{FOOT})) AS reach FROM s CROSS JOIN range(-1, 2) AS w(which) WHERE total > 0),
    a AS (SELECT *, unnest(range(greatest({FIRST.format(at='st')}, 0), CAST(least({FIRST.format(at='(st + len)')} - 1, n - 1) AS BIGINT) + 1)) AS i FROM u),
    p AS (SELECT line_id, i, which, x1 + (x2-x1)*al AS x, y1 + (y2-y1)*al AS y FROM (SELECT *, ((0.1e0 + i*0.8e0/(n - 1))*total + which*reach - st)/len AS al FROM a) b),
    m AS (SELECT line_id, i, max(x) FILTER (WHERE which = 0) AS px, max(y) FILTER (WHERE which = 0) AS py, max(x) FILTER (WHERE which = 1) - max(x) FILTER (WHERE which = -1) AS dx,
            max(y) FILTER (WHERE which = 1) - max(y) FILTER (WHERE which = -1) AS dy FROM p GROUP BY line_id, i),
    k AS (SELECT line_id, i, k, CAST(floor((px - dy/sqrt(dx*dx + dy*dy)*k*4)/4) AS BIGINT) AS cx, CAST(floor((py + dx/sqrt(dx*dx + dy*dy)*k*4)/4) AS BIGINT) AS cy FROM m CROSS JOIN range(-49, 50) AS kk(k) WHERE px IS NOT NULL AND dx*dx + dy*dy > 0),
    h AS (SELECT k.*, k - row_number() OVER (PARTITION BY line_id, i ORDER BY k) AS run FROM k JOIN (SELECT DISTINCT cx, cy FROM ({raster_sql(4)}) r) r USING (cx, cy)),
    w AS (SELECT line_id, i, run, min(abs(k)) AS nearest, count(*) AS cells FROM h GROUP BY 1, 2, 3)
    SELECT line_id, i AS place, round(max(cells)*4*{FOOT}, 6) AS width_m FROM w WHERE nearest*4 <= 1.5e0/{FOOT} GROUP BY 1, 2 HAVING max(cells)*4*{FOOT} BETWEEN 2.5 AND 60""")
def _(t):
    return roads.road_width_samples(_measured(t), spatial.cells_of_polygons(t.polygons, 4.0, []), 4.0).withColumn("width_m", F.round("width_m", 6))


@query("r24_road_ribbons", f"""
    SELECT cx, cy, count(*) AS lines FROM (SELECT DISTINCT line_id, cx, cy FROM (
      SELECT s.*, unnest(range(CAST(floor((least(x1, x2) - 6.01)/8) AS BIGINT), CAST(floor((greatest(x1, x2) + 6.01)/8) AS BIGINT) + 1)) AS cx FROM {SEG} s WHERE x2 IS NOT NULL) p,
      LATERAL (SELECT unnest(range(CAST(floor((least(p.y1, p.y2) - 6.01)/8) AS BIGINT), CAST(floor((greatest(p.y1, p.y2) + 6.01)/8) AS BIGINT) + 1)) AS cy) q,
      LATERAL (SELECT CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(greatest(((cx*8+4-x1)*(x2-x1) + (cy*8+4-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 0), 1) END AS sh) h
      WHERE pow(cx*8+4-x1-(x2-x1)*sh, 2) + pow(cy*8+4-y1-(y2-y1)*sh, 2) <= 36.1201e0) d GROUP BY cx, cy""")
def _(t):
    out = roads.road_ribbons(way_segments(t).withColumn("width_ft", F.lit(12.02)), 8.0)
    return out.groupBy("cx", "cy").agg(F.count("*").alias("lines"))


def _features(t):
    return t.polygons.select("id", F.when(C("id") % 9 == 0, "bridge").otherwise("building").alias("kind"), "name", "edges", *spatial.BOX)


def seam_lines(t):
    return t.seams.select("seam_id", F.lit(0).alias("pos"), "x1", "y1", "x2", "y2")


SEAM_INSIDE = """SELECT seam_id, id, sum(sg*(1 - least(greatest(pl, 0), 1)))*1000 AS inside FROM (
      SELECT s.seam_id, e.id, CASE WHEN s.x1 = s.x2 THEN CASE WHEN e.x1 <= s.x1 THEN 1 ELSE 0 END - CASE WHEN e.x2 <= s.x1 THEN 1 ELSE 0 END ELSE CASE WHEN e.y1 >= s.y1 THEN 1 ELSE 0 END - CASE WHEN e.y2 >= s.y1 THEN 1 ELSE 0 END END AS sg,
             CASE WHEN s.x1 = s.x2 THEN (e.y1 + (e.y2-e.y1)*(s.x1-e.x1)/nullif(e.x2-e.x1, 0) - s.y1)/1000 ELSE (e.x1 + (e.x2-e.x1)*(s.y1-e.y1)/nullif(e.y2-e.y1, 0) - s.x1)/1000 END AS pl
      FROM seams s JOIN footprints f ON s.x1 <= f.maxx AND s.x2 >= f.minx AND s.y1 <= f.maxy AND s.y2 >= f.miny JOIN edges e ON e.id = f.id) q WHERE sg <> 0 GROUP BY seam_id, id"""
NARROW = """SELECT id, CASE shape WHEN 1 THEN (maxx-minx)*(maxy-miny)/sqrt((maxx-minx)*(maxx-minx)+(maxy-miny)*(maxy-miny)) ELSE least(maxx-minx, maxy-miny) END AS narrow, name FROM footprints"""
SEAM_CROSSINGS = f"""SELECT seam_id, i.id AS polygon_id, CASE WHEN i.id % 9 = 0 THEN 'bridge' ELSE 'building' END AS kind, name, inside, narrow, inside > narrow*1.6e0 AS along_feature FROM ({SEAM_INSIDE}) i JOIN ({NARROW}) n ON n.id = i.id WHERE inside > 2.503"""


@query("j10_seam_crossings", f"""
    SELECT seam_id, polygon_id, kind, name, round(inside, 4) AS inside_length, round(narrow, 4) AS feature_width, along_feature,
           row_number() OVER (PARTITION BY seam_id ORDER BY round(inside, 6) DESC, polygon_id) AS rank FROM ({SEAM_CROSSINGS}) c""")
def _(t):
    out = roads.seam_crossings(seam_lines(t), _features(t), 64.0, 2.503)
    return out.select("seam_id", "polygon_id", "kind", "name", F.round("inside_length", 4).alias("inside_length"), F.round("feature_width", 4).alias("feature_width"), "along_feature", "rank")


@query("j11_carried_structures", """
    WITH l AS (SELECT line_id, id, sum(sg*(1-pl)*len) AS inside FROM (%s) c GROUP BY line_id, id HAVING sum(sg*(1-pl)*len) > 1e-9),
    r AS (SELECT id, sum(inside) AS road FROM l WHERE line_id %% 10 IN (0, 1, 2, 9) GROUP BY id)
    SELECT line_id AS way_id, l.id AS polygon_id, line_id %% 10 IN (0, 1, 2, 9) OR inside > coalesce(road, 0) AS kept FROM l LEFT JOIN r ON r.id = l.id""" % CROSSINGS)
def _(t):
    ways = ordered.segments(t.vertices).withColumn("carriageway", (C("way_id") % 10).isin(0, 1, 2, 9))
    return roads.carried_structures(ways, t.polygons, 64.0).select("way_id", "polygon_id", "kept")


def road_symbols(t, segments=None):
    """Routes with class, drawing and width: the street part of a map. ``segments`` are the ways' own, already written."""
    s = cut(way_segments(t), "segments") if segments is None else segments  # read four times below, each time with its windows if not written
    routes = _ways(t).join(spatial.line_support(s, t.polygons, 64.0), C("way_id") == C("line_id"))
    routes = t.dealt(routes, "customer", "way_id").withColumn(  # few bytes, but a long rule for each
        "v", tg.classify_highway(C("highway"), C("tags"), C("support"))).withColumn("route_key", tg.route_key(C("tags"), C("way_id")))
    routes = routes.select(
        "way_id", "highway", "tags", "route_key", "support", C("v.cls").alias("cls"), tg.grade_key(C("tags")).alias("grade"), (C("length") * MM_PER_FT).alias("length_mm"))
    drawn = routes.withColumn("drawn", tg.drawn_as(C("tags"), C("cls"), C("length_mm"), tg.minimum_crossing_mm()))
    drawn = cut(drawn, "routes")  # the spatial part runs once for the three uses below
    eligible = drawn.where(C("cls") == "carriageway")
    surface = eligible.where(C("grade") == "surface:0").select("route_key").distinct()
    widths = roads.route_widths(eligible, width_samples(t).join(surface, "route_key", "left_semi"))
    return drawn.join(widths.select("route_key", "width_m", "method", "printed_mm"), "route_key", "left").withColumn(
        "width_m", F.when(C("cls") == "carriageway", C("width_m"))).withColumn("printed_mm", F.when(C("cls") == "carriageway", C("printed_mm")))


SYMBOLS = f"""WITH s AS ({SUPPORT}), r AS (SELECT way_id, highway, support, length*{MM_PER_FT!r} AS length_mm, {KEY_SQL} AS route_key, {WIDTH_SQL} AS tw, {DEFAULT_SQL} AS dw, way_id % 9 = 0 AS bridge, way_id % 9 <> 0 AND way_id % 13 = 0 AS tunnel,
        CASE WHEN highway IN ('footway', 'cycleway', 'steps') THEN 'trail' WHEN highway IN ('motorway', 'primary', 'residential', 'tertiary_link') THEN 'carriageway'
             WHEN highway = 'pedestrian' THEN CASE WHEN way_id % 3 = 0 AND way_id % 5 < 2 AND (way_id % 4 <> 0 OR support >= 0.7) THEN 'carriageway' ELSE 'trail' END
             WHEN highway = 'service' THEN CASE WHEN way_id % 12 = 3 THEN 'other' WHEN (way_id % 5 < 2 OR way_id % 3 = 0) AND (way_id % 3 = 0 OR support >= 0.5) THEN 'carriageway' WHEN way_id % 4 <> 0 AND support >= 0.7 THEN 'carriageway' ELSE 'other' END
             WHEN highway = 'road' AND support >= 0.7 THEN 'carriageway' ELSE 'other' END AS cls FROM ways JOIN s ON s.line_id = way_id),
    sk AS (SELECT DISTINCT route_key FROM r WHERE cls = 'carriageway' AND NOT bridge AND NOT tunnel AND way_id % 9 <> 1),
    m AS (SELECT route_key, quantile_cont(width_m, 0.3) AS measured FROM ({SAMPLES_SQL}) q WHERE route_key IN (SELECT route_key FROM sk) GROUP BY 1),
    w AS (SELECT route_key, median(tw) AS tagged, max(dw) AS by_class, bool_or(highway IN ('motorway', 'primary')) AS major FROM r WHERE cls = 'carriageway' GROUP BY 1),
    d AS (SELECT r.*, CASE WHEN cls <> 'other' AND bridge AND length_mm >= 0.8 THEN 'deck' WHEN cls = 'carriageway' AND NOT tunnel THEN 'ribbon' ELSE 'none' END AS drawn,
             CASE WHEN cls = 'carriageway' THEN least(greatest(coalesce(measured, tagged, by_class), 2.5), 60) END AS width_m, CASE WHEN cls = 'carriageway' THEN CASE WHEN major THEN 1.0e0 ELSE 0.875e0 END END AS printed_mm
          FROM r LEFT JOIN w USING (route_key) LEFT JOIN m USING (route_key))"""


@query("q3_road_symbols", SYMBOLS + "SELECT cls, drawn, count(*) AS ways, round(sum(length_mm), 3) AS length_mm, round(min(width_m), 4) AS narrowest_m, round(max(width_m), 4) AS widest_m, round(avg(support), 6) AS support, max(printed_mm) AS printed_mm FROM d GROUP BY cls, drawn")
def _(t):
    return road_symbols(t).groupBy("cls", "drawn").agg(
        F.count("*").alias("ways"), F.round(F.sum("length_mm"), 3).alias("length_mm"), F.round(F.min("width_m"), 4).alias("narrowest_m"),
        F.round(F.max("width_m"), 4).alias("widest_m"), F.round(F.avg("support"), 6).alias("support"), F.max("printed_mm").alias("printed_mm"))
