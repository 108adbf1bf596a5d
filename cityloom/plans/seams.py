"""Queries on cut lines, plates and finished checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import audits, roads, seams, spatial
from ..operators import cells as cell_ops
from ..runtime import cut
from .buildings import box_edges
from .cells import COST_SQL, layers
from .registry import query
from .roads import SEAM_CROSSINGS, _features, seam_lines
from .spatial import BOX, SEG, way_segments

C = F.col


def priced(t):
    return cell_ops.cut_cost(layers(t))


BAND = f"SELECT concat(cx // 125, ':', cy // 25) AS band_id, cx AS step, cy AS level, cost, (cx + cy) % 11 <> 0 AS inside, (cy // 25)*25 + 12 AS nominal FROM ({COST_SQL}) c"


def band():
    return F.concat_ws(":", F.floor(C("cx") / 125), F.floor(C("cy") / 25))


def band_samples(t):
    return priced(t).select(band().alias("band_id"), C("cx").alias("step"), C("cy").alias("level"), "cost", ((C("cx") + C("cy")) % 11 != 0).alias("inside"),
                            (F.floor(C("cy") / 25) * 25 + 12).alias("nominal"))


@query("r21_best_straight_cut", f"""
    WITH b AS ({BAND}), l AS (SELECT band_id, level, nominal, sum(CASE WHEN NOT inside THEN 0 ELSE least(cost, 1e12) END) AS priced, count(*) AS steps, sum(cost) FILTER (WHERE cost < 1e12) AS fs, count(*) FILTER (WHERE cost < 1e12) AS fn FROM b GROUP BY 1, 2, 3),
    m AS (SELECT band_id, greatest(sum(fs)/nullif(sum(fn), 0), 1e-3) AS mean_cost FROM l GROUP BY 1),
    s AS (SELECT l.*, round(priced + coalesce(mean_cost, 1)*0.25e0*abs(level - nominal)*steps, 2) AS score FROM l JOIN m USING (band_id))
    SELECT band_id, arg_min(level, (score, level)) AS level, round(min(score), 0) AS score FROM s GROUP BY band_id""")
def _(t):
    return seams.best_straight_cut(band_samples(t)).select("band_id", "level", F.round("score", 0).alias("score"))


@query("r22_best_staircase_cut")
def _(t):
    return seams.best_staircase_cut(band_samples(t), run=6, jog=8.0, centering=0.25, least_jog=2)


EVIDENCE = f"""SELECT seam_id, count(*) AS samples, avg(least(cost, 1e12)) AS mean_cost, avg(CASE WHEN height_m IS NULL THEN 1.0e0 ELSE 0 END) AS nodata_fraction, avg(height_m) AS mean_above_ground_m,
      quantile_cont(height_m, 0.95) AS p95_above_ground_m, avg(CASE WHEN building THEN 1.0e0 ELSE 0 END) AS building_fraction, avg(CASE WHEN structure THEN 1.0e0 ELSE 0 END) AS structure_fraction,
      avg(CASE WHEN cheap_surface THEN 1.0e0 ELSE 0 END) AS cheap_surface_fraction, avg(CASE WHEN water THEN 1.0e0 ELSE 0 END) AS water_fraction,
      avg(CASE WHEN cost >= 1e12 THEN 1.0e0 ELSE 0 END) AS blocked_fraction, count(*) FILTER (WHERE cost >= 1e12) AS blocked_samples
    FROM (SELECT seam_id, CAST(floor((x1 + (x2-x1)*(k/125.0e0))/8) AS BIGINT) AS cx, CAST(floor((y1 + (y2-y1)*(k/125.0e0))/8) AS BIGINT) AS cy FROM seams CROSS JOIN range(126) AS kk(k)) s
    JOIN ({COST_SQL}) c ON c.cx = s.cx AND c.cy = s.cy GROUP BY seam_id"""
ROUNDED = ["mean_cost", "nodata_fraction", "mean_above_ground_m", "p95_above_ground_m", "building_fraction", "structure_fraction", "cheap_surface_fraction", "water_fraction", "blocked_fraction"]


def rounded(cols, n):
    return [F.round(c, n).alias(c) for c in cols]


@query("a19_seam_evidence", f"SELECT seam_id, samples, blocked_samples, {', '.join(f'round({c}, {2 if c == 'mean_cost' else 5}) AS {c}' for c in ROUNDED)} FROM ({EVIDENCE}) e")
def _(t):
    out = seams.seam_evidence(seam_lines(t), priced(t), 8.0)
    return out.select("seam_id", "samples", "blocked_samples", *rounded(ROUNDED[:1], 2), *rounded(ROUNDED[1:], 5))


PLATE_SQL = """SELECT d*25 + j*5 + i AS id, d AS district, (d % 32)*1000 + CASE WHEN i = 0 THEN 0 ELSE i*200 + (i*7 + d) % 3*10 END + 0.0e0 AS minx,
      (d % 32)*1000 + CASE WHEN i = 4 THEN 1000 ELSE (i + 1)*200 + ((i + 1)*7 + d) % 3*10 END + CASE WHEN j*5 + i = 7 THEN 5.0e0 ELSE 0.0e0 END AS maxx, (d // 32)*1000 + j*200.0e0 AS miny, (d // 32)*1000 + j*200.0e0 + 200 AS maxy
    FROM (SELECT DISTINCT c_custkey // 1500 AS d FROM customer) c CROSS JOIN range(5) AS a(i) CROSS JOIN range(5) AS b(j)"""


def plates(t):
    i, j, d = C("i"), C("j"), C("district")
    span = F.explode(F.sequence(F.lit(0), F.lit(4)))
    grid = t.districts.withColumn("i", span).withColumn("j", span)
    edge = lambda k: k * 200 + (k * 7 + d) % 3 * 10
    return box_edges(grid.select(
        (d * 25 + j * 5 + i).alias("id"), "district", (C("ox") + F.when(i == 0, 0).otherwise(edge(i))).alias("minx"), (C("oy") + j * 200.0).alias("miny"),
        (C("ox") + F.when(i == 4, 1000).otherwise(edge(i + 1)) + F.when(j * 5 + i == 7, 5.0).otherwise(0.0)).alias("maxx"), (C("oy") + j * 200.0 + 200).alias("maxy")))


@query("j12_shared_edges", f"""
    WITH p AS ({PLATE_SQL}), n AS (SELECT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, least(a.maxy, b.maxy) - greatest(a.miny, b.miny) AS len FROM p a JOIN p b ON a.maxx = b.minx AND a.maxy > b.miny AND b.maxy > a.miny
      UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), least(a.maxx, b.maxx) - greatest(a.minx, b.minx) FROM p a JOIN p b ON a.maxy = b.miny AND a.maxx > b.minx AND b.maxx > a.minx),
    o AS (SELECT a.id AS a_id, b.id AS b_id, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx))*(least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS area FROM p a JOIN p b ON a.id < b.id AND a.maxx > b.minx AND b.maxx > a.minx AND a.maxy > b.miny AND b.maxy > a.miny)
    SELECT n.a_id, n.b_id, round(sum(len), 4) AS length_ft, round(coalesce(max(area), 0), 4) AS overlap_ft2, coalesce(max(area), 0) > 0 AS overlapping FROM n LEFT JOIN o ON o.a_id = n.a_id AND o.b_id = n.b_id GROUP BY 1, 2""")
def _(t):
    out = seams.shared_edges(plates(t), 64.0)
    return out.select("a_id", "b_id", F.round("length_ft", 4).alias("length_ft"), F.round("overlap_ft2", 4).alias("overlap_ft2"), "overlapping")


def district_squares(t):
    return box_edges(t.districts.select(C("district").alias("id"), C("ox").alias("minx"), C("oy").alias("miny"), (C("ox") + 1000).alias("maxx"), (C("oy") + 1000).alias("maxy")))


@query("u3_validate_partition", f"""
    WITH p AS (SELECT *, district AS target_id FROM ({PLATE_SQL}) q WHERE id % 25 <> 18), t AS (SELECT DISTINCT target_id, (target_id % 32)*1000.0e0 AS x0, (target_id // 32)*1000.0e0 AS y0 FROM p),
    xs AS (SELECT target_id, x, lead(x) OVER (PARTITION BY target_id ORDER BY x) AS x2 FROM (SELECT target_id, minx AS x FROM p UNION SELECT target_id, maxx FROM p UNION SELECT target_id, x0 FROM t UNION SELECT target_id, x0 + 1000 FROM t) u),
    ys AS (SELECT target_id, y, lead(y) OVER (PARTITION BY target_id ORDER BY y) AS y2 FROM (SELECT target_id, miny AS y FROM p UNION SELECT target_id, maxy FROM p UNION SELECT target_id, y0 FROM t UNION SELECT target_id, y0 + 1000 FROM t) u),
    c AS (SELECT target_id, x, x2, y, y2, x >= x0 AND x2 <= x0 + 1000 AND y >= y0 AND y2 <= y0 + 1000 AS wanted FROM xs JOIN ys USING (target_id) JOIN t USING (target_id) WHERE x2 IS NOT NULL AND y2 IS NOT NULL),
    h AS (SELECT c.target_id, c.x, c.y, count(*) AS held FROM c JOIN p ON p.target_id = c.target_id AND p.minx <= c.x AND p.maxx >= c.x2 AND p.miny <= c.y AND p.maxy >= c.y2 GROUP BY 1, 2, 3),
    a AS (SELECT c.target_id, coalesce(sum((x2-c.x)*(y2-c.y)) FILTER (WHERE wanted AND held IS NULL), 0) AS missing, coalesce(sum((x2-c.x)*(y2-c.y)) FILTER (WHERE NOT wanted AND held > 0), 0) AS excess
      FROM c LEFT JOIN h ON h.target_id = c.target_id AND h.x = c.x AND h.y = c.y GROUP BY 1),
    o AS (SELECT p.target_id, max((least(p.maxx, q.maxx) - greatest(p.minx, q.minx))*(least(p.maxy, q.maxy) - greatest(p.miny, q.miny))) AS overlap FROM p JOIN p q ON p.target_id = q.target_id AND p.id < q.id
      AND p.maxx > q.minx AND q.maxx > p.minx AND p.maxy > q.miny AND q.maxy > p.miny GROUP BY 1),
    k AS (SELECT target_id, count(*) AS plates FROM p GROUP BY 1)
    SELECT target_id, plates, round(missing, 4) AS missing_ft2, round(excess, 4) AS excess_ft2, round(coalesce(overlap, 0), 4) AS overlap_ft2,
      concat_ws('; ', CASE WHEN missing > 1 THEN 'misses area' END, CASE WHEN excess > 1 THEN 'covers area outside' END, CASE WHEN coalesce(overlap, 0) > 1 THEN 'plates overlap' END) AS problems
    FROM k JOIN a USING (target_id) LEFT JOIN o USING (target_id)""")
def _(t):
    p = plates(t).where(C("id") % 25 != 18).withColumnRenamed("district", "target_id")
    out = seams.validate_partition(district_squares(t), p, 256.0, 1.0)
    return out.select("target_id", "plates", *rounded(["missing_ft2", "excess_ft2", "overlap_ft2"], 4), "problems")


CROSS_AGG = f"SELECT count(*) AS crossings, coalesce(sum(inside), 0) AS crossing_length_ft, coalesce(max(inside), 0)*0.3048006096012192e0*1000/4000 AS longest_crossing_mm, count(*) FILTER (WHERE along_feature) AS lengthwise_crossings FROM ({SEAM_CROSSINGS}) c"
SUMMARY = f"""SELECT seams, seam_length_ft, round(building_fraction, 5) AS building_fraction, round(structure_fraction, 5) AS structure_fraction, round(cheap_surface_fraction, 5) AS cheap_surface_fraction, round(mean_above_ground_m, 5) AS mean_above_ground_m,
      round(nodata_fraction, 5) AS nodata_fraction, blocked_samples, crossings, round(crossing_length_ft, 3) AS crossing_length_ft, round(longest_crossing_mm, 5) AS longest_crossing_mm, lengthwise_crossings, smallest_km2, largest_km2
    FROM (SELECT count(*) AS seams, count(*)*1000.0e0 AS seam_length_ft, avg(building_fraction) AS building_fraction, avg(structure_fraction) AS structure_fraction, avg(cheap_surface_fraction) AS cheap_surface_fraction, avg(mean_above_ground_m) AS mean_above_ground_m,
      avg(nodata_fraction) AS nodata_fraction, CAST(sum(blocked_samples) AS BIGINT) AS blocked_samples FROM ({EVIDENCE}) e) a CROSS JOIN ({CROSS_AGG}) b
      CROSS JOIN (SELECT round(min((maxx-minx)*(maxy-miny)), 4) AS smallest_km2, round(max((maxx-minx)*(maxy-miny)), 4) AS largest_km2 FROM ({PLATE_SQL}) p) p"""


def plan_summary(t):
    evidence = seams.seam_evidence(seam_lines(t), priced(t), 8.0).withColumn("length_ft", F.lit(1000.0))
    crossings = roads.seam_crossings(seam_lines(t), _features(t), 64.0, 2.503).select(C("inside_length").alias("length_ft"), "along_feature")
    chunks = plates(t).select(((C("maxx") - C("minx")) * (C("maxy") - C("miny"))).alias("area_km2"))
    return seams.seam_summary(evidence, crossings, chunks, 4000.0)


def _summary_columns(out):
    shares = ["building_fraction", "structure_fraction", "cheap_surface_fraction", "mean_above_ground_m", "nodata_fraction", "longest_crossing_mm"]
    return out.select("seams", "seam_length_ft", "blocked_samples", "crossings", F.round("crossing_length_ft", 3).alias("crossing_length_ft"), "lengthwise_crossings", "smallest_km2", "largest_km2", *rounded(shares, 5))


@query("a9_seam_summary", SUMMARY)
def _(t):
    return _summary_columns(plan_summary(t))


@query("q5_cut_surface_and_seams", f"""
    WITH b AS ({BAND}), l AS (SELECT band_id, level, nominal, sum(CASE WHEN NOT inside THEN 0 ELSE least(cost, 1e12) END) AS priced, count(*) AS steps, sum(cost) FILTER (WHERE cost < 1e12) AS fs, count(*) FILTER (WHERE cost < 1e12) AS fn FROM b GROUP BY 1, 2, 3),
    m AS (SELECT band_id, greatest(sum(fs)/nullif(sum(fn), 0), 1e-3) AS mean_cost FROM l GROUP BY 1), s AS (SELECT l.*, round(priced + coalesce(mean_cost, 1)*0.25e0*abs(level - nominal)*steps, 2) AS score FROM l JOIN m USING (band_id)),
    k AS (SELECT band_id, arg_min(level, (score, level)) AS level FROM s GROUP BY band_id),
    e AS (SELECT k.band_id, k.level, count(*) AS samples, round(avg(least(cost, 1e12)), 2) AS mean_cost, count(*) FILTER (WHERE building) AS building_cells, count(*) FILTER (WHERE cost >= 1e12) AS blocked_cells, round(avg(height_m), 5) AS mean_above_ground_m
          FROM k JOIN ({COST_SQL}) c ON c.cy = k.level AND c.cx // 125 = CAST(split_part(k.band_id, ':', 1) AS BIGINT) GROUP BY 1, 2)
    SELECT * FROM e""")
def _(t):
    surface = cut(priced(t), "surface")
    cells = surface.withColumn("band_id", band())
    samples = cells.select("band_id", C("cx").alias("step"), C("cy").alias("level"), "cost", ((C("cx") + C("cy")) % 11 != 0).alias("inside"), (F.floor(C("cy") / 25) * 25 + 12).alias("nominal"))
    chosen = seams.best_straight_cut(samples).select("band_id", C("level").alias("cy"))
    return cells.join(chosen, ["band_id", "cy"]).groupBy("band_id", C("cy").alias("level")).agg(
        F.count("*").alias("samples"), F.round(F.avg(F.least("cost", F.lit(1e12))), 2).alias("mean_cost"), F.count_if("building").alias("building_cells"),
        F.count_if("keep_out").alias("blocked_cells"), F.round(F.avg("height_m"), 5).alias("mean_above_ground_m"))


@query("a10_joint_summary", """
    WITH s AS (SELECT c_custkey AS seam_id, 50 + c_custkey % 37 + 0.5e0 AS l, c_custkey % 7 + 1 AS sides, c_custkey % 7 AS corners, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 3 + c_custkey % 11 END AS sh FROM customer)
    SELECT CAST(sum(sides) AS BIGINT) AS sides, CAST(sum(corners) AS BIGINT) AS corners, round(sum(corners)/(sum(l)*0.3048006096012192e0/4000*1000/1000), 6) AS corners_per_metre, round(min(sh) FILTER (WHERE sh > 0)*0.0762001524003048e0, 6) AS shortest_side_mm,
           round(min(l)*0.0762001524003048e0, 6) AS shortest_joint_mm, arg_max(seam_id, (corners, -seam_id)) FILTER (WHERE corners > 0) AS worst_joint FROM s""")
def _(t):
    k = C("c_custkey")
    s = t.customer.select(k.alias("seam_id"), (k % 37 + 50.5).alias("length_ft"), (k % 7 + 1).alias("sides"), (k % 7).alias("corners"), F.when(k % 5 == 0, 0.0).otherwise(k % 11 + 3.0).alias("shortest_side_ft"))
    out = seams.joint_summary(s, 4000.0)
    return out.select("sides", "corners", *rounded(["corners_per_metre", "shortest_side_mm", "shortest_joint_mm"], 6), "worst_joint")


@query("w3_turning_points", """
    WITH RECURSIVE v AS (SELECT way_id AS line_id, x, y, row_number() OVER (PARTITION BY way_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY way_id) AS total FROM vertices),
    f AS (SELECT a.line_id, b.n, b.total, a.x AS kx, a.y AS ky, b.x AS mx, b.y AS my, CAST(NULL AS DOUBLE) AS side FROM v a JOIN v b ON b.line_id = a.line_id AND a.n = 1 AND b.n = 2
      UNION ALL SELECT line_id, n, total, CASE WHEN turned THEN mx ELSE kx END, CASE WHEN turned THEN my ELSE ky END, x, y, CASE WHEN turned THEN sqrt((mx-kx)*(mx-kx) + (my-ky)*(my-ky)) END
      FROM (SELECT f.line_id, v.n, f.total, kx, ky, mx, my, v.x, v.y, (mx <> kx OR my <> ky) AND (v.x <> mx OR v.y <> my)
              AND abs(degrees(atan2((mx-kx)*(v.y-my) - (my-ky)*(v.x-mx), (mx-kx)*(v.x-mx) + (my-ky)*(v.y-my)))) > 0.5 AS turned FROM f JOIN v ON v.line_id = f.line_id AND v.n = f.n + 1) q),
    s AS (SELECT line_id, side FROM f WHERE side IS NOT NULL UNION ALL SELECT line_id, sqrt((mx-kx)*(mx-kx) + (my-ky)*(my-ky)) FROM f WHERE n = total)
    SELECT line_id, count(*) AS sides, count(*) - 1 AS corners, round(min(side), 4) AS shortest_side_ft FROM s GROUP BY line_id""")
def _(t):
    shape = seams.joint_shape(seams.turning_points(t.vertices.withColumnRenamed("way_id", "line_id")))
    return shape.withColumn("shortest_side_ft", F.round("shortest_side_ft", 4))


@query("w5_reopened_fraction", """
    WITH RECURSIVE o AS (SELECT *, CAST(repeat('0', CAST(s AS INTEGER)) || repeat('1', CAST(len AS INTEGER)) || repeat('0', CAST(10100 - s - len AS INTEGER)) AS BIT) AS mask, row_number() OVER (PARTITION BY route ORDER BY candidate) AS n
      FROM (SELECT o_custkey % 20 AS route, o_orderkey AS candidate, o_orderkey*37 % 9973 AS s, (o_orderkey % 7 + 1)*10 AS len FROM orders) q),
    f AS (SELECT route, n, candidate, 0.0e0 AS fraction, false AS repeated, mask AS held FROM o WHERE n = 1
      UNION ALL SELECT o.route, o.n, o.candidate, bit_count(f.held & o.mask)/(1.0e0*len), bit_count(f.held & o.mask) > 0.5*len, CASE WHEN bit_count(f.held & o.mask) > 0.5*len THEN f.held ELSE f.held | o.mask END
      FROM f JOIN o ON o.route = f.route AND o.n = f.n + 1)
    SELECT route, candidate, round(fraction, 6) AS fraction, repeated FROM f""")
def _(t):
    start = (C("o_orderkey") * 37 % 9973).cast("double")
    spans = t.orders.select((C("o_custkey") % 20).alias("route"), C("o_orderkey").alias("candidate"), start.alias("span_start"), (start + (C("o_orderkey") % 7 + 1) * 10).alias("span_end"))
    return seams.reopened_fraction(spans).withColumn("fraction", F.round("fraction", 6))


def bands_sql(name, low, high, sign):
    """Recursive SQL for the bands of the plates along one axis."""
    return f"""{name}_in AS (SELECT district, id, {low} AS lo, {high} AS hi, row_number() OVER (PARTITION BY district ORDER BY {sign}({low} + {high})/2, id) AS n FROM p),
    {name} AS (SELECT district, id, n, 0 AS band, lo AS a, hi AS b FROM {name}_in WHERE n = 1
      UNION ALL SELECT district, id, n, band + CASE WHEN apart THEN 1 ELSE 0 END, CASE WHEN apart THEN lo ELSE greatest(a, lo) END, CASE WHEN apart THEN hi ELSE least(b, hi) END
      FROM (SELECT i.*, f.band, f.a, f.b, least(f.b, i.hi) - greatest(f.a, i.lo) < 0.5*greatest(least(f.b - f.a, i.hi - i.lo), 1e-9) AS apart FROM {name} f JOIN {name}_in i ON i.district = f.district AND i.n = f.n + 1) q)"""


@query("w8_grid_labels", f"""
    WITH RECURSIVE p AS ({PLATE_SQL}), {bands_sql('across', 'minx', 'maxx', '')}, {bands_sql('down', 'miny', 'maxy', '-')},
    l AS (SELECT district AS plan_id, id, chr(65 + CAST(across.band AS INTEGER)) || (down.band + 1) AS base, row_number() OVER (PARTITION BY district, across.band, down.band ORDER BY id) AS n FROM across JOIN down USING (district, id))
    SELECT plan_id, id, CASE WHEN n = 1 THEN base ELSE base || '.' || n END AS label FROM l""")
def _(t):
    return seams.grid_labels(plates(t).withColumnRenamed("district", "plan_id"))


@query("p12_valid_frame_records", """
    WITH f AS (SELECT c_custkey AS id, 15 + c_custkey % 260 + CASE WHEN c_custkey % 13 = 0 THEN 0.1e0 ELSE 0 END AS w, 18 + c_custkey % 97*2.5e0 AS h, c_custkey % 50*2 + CASE WHEN c_custkey % 17 = 0 THEN 0.3e0 ELSE 0 END AS u, c_custkey % 30*2.0e0 AS v FROM customer),
    c AS (SELECT *, (w/1000*6000 + 20)/0.5e0*((h/1000*6000 + 20)/0.5e0) AS cells FROM f)
    SELECT id, round(cells, 3) AS elevation_cells, concat_ws(',', CASE WHEN NOT (w BETWEEN 20 AND 250 AND h BETWEEN 20 AND 250) THEN 'size' END, CASE WHEN w > 240 + 1e-9 OR h > 230 + 1e-9 THEN 'envelope' END,
           CASE WHEN abs(w/0.25e0 - round(w/0.25e0)) > 1e-6 OR abs(h/0.25e0 - round(h/0.25e0)) > 1e-6 THEN 'grid step' END, CASE WHEN cells > 30000000 THEN 'elevation cells' END,
           CASE WHEN abs(u/2 - round(u/2)) > 1e-6 OR abs(v/2 - round(v/2)) > 1e-6 THEN 'lattice' END) AS problems FROM c""")
def _(t):
    k = C("c_custkey")
    frames = t.customer.select(k.alias("id"), (k % 260 + 15 + F.when(k % 13 == 0, 0.1).otherwise(0.0)).alias("width_mm"), (k % 97 * 2.5 + 18).alias("height_mm"),
                               (k % 50 * 2 + F.when(k % 17 == 0, 0.3).otherwise(0.0)).alias("origin_u"), (k % 30 * 2.0).alias("origin_v"))
    out = seams.valid_frame_records(frames, scale=6000.0, grid_step_mm=0.25, envelope_mm=(240.0, 230.0), padding_m=10.0, cell_ft=2.0)
    return out.select("id", F.round("elevation_cells", 3).alias("elevation_cells"), F.array_join("problems", ",").alias("problems"))


@query("a22_grid_cell_coverage", """
    WITH f AS (SELECT id, maxx - minx AS w, maxy - miny AS h FROM footprints), r AS (SELECT f.*, rows FROM f CROSS JOIN range(1, 9) AS rr(rows)),
    c AS (SELECT r.*, unnest(range(CAST(greatest(1, floor(w*rows/(h*1.5e0))) AS BIGINT), CAST(least(ceil(w*rows*1.5e0/h), 8 // rows) AS BIGINT) + 1)) AS cols FROM r),
    a AS (SELECT *, w/cols AS cw, h/rows AS ch FROM c WHERE greatest((w/cols)/(h/rows), (h/rows)/(w/cols)) <= 1.5 + 1e-9),
    s AS (SELECT id, rows, cols, 1 - greatest((i + 1)*cw - greatest(i*cw, w/2), 0)*greatest((j + 1)*ch - greatest(j*ch, h/2), 0)/(cw*ch) AS share
          FROM (SELECT a.*, unnest(range(cols)) AS i FROM a) b, LATERAL (SELECT unnest(range(b.rows)) AS j) q)
    SELECT id, CAST(rows AS BIGINT) AS rows, cols, count(*) FILTER (WHERE share >= 0.6 - 1e-9) AS filled_cells, round(min(share), 6) AS least_share FROM s GROUP BY 1, 2, 3""")
def _(t):
    x0, y0, x1, y1 = (C(c) for c in BOX)
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    corners = [(x0, y0), (x1, y0), (x1, my), (mx, my), (mx, y1), (x0, y1)]
    shaped = t.dealt(t.footprints, "customer").withColumn("edges", F.array(*[g.edge(a[0], a[1], b[0], b[1]) for a, b in zip(corners, corners[1:] + corners[:1])]))
    out = seams.grid_cell_coverage(shaped.select("id", "edges", *BOX), 1.5, 8, 0.6)
    return out.select("id", C("rows").cast("bigint").alias("rows"), C("cols").cast("bigint").alias("cols"), "filled_cells", F.round("least_share", 6).alias("least_share"))


@query("a15_mesh_audit", """
    WITH m AS (SELECT s_suppkey AS part_id, s_suppkey % 5 = 0 AS opened, s_suppkey % 7 = 0 AS turned, pow(s_suppkey % 10 + 1.0e0, 3)/6 AS vol FROM supplier)
    SELECT part_id, CASE WHEN opened THEN 3 ELSE 4 END AS triangles, 0 AS bad_indices, 0 AS zero_area, round(vol, 6) AS volume,
           CASE WHEN opened AND turned THEN 5 WHEN opened THEN 3 WHEN turned THEN 3 ELSE 0 END AS bad_edges, NOT opened AND NOT turned AS accepted FROM m""")
def _(t):
    out = audits.mesh_audit(t.triangles, t.mesh_vertices)
    return out.select("part_id", "triangles", "bad_indices", "zero_area", F.round("volume", 6).alias("volume"), "bad_edges", "accepted")


@query("a16_shell_classes", "SELECT s_suppkey AS part_id, CASE WHEN s_suppkey % 5 = 0 THEN 3 ELSE 4 END AS triangles, 'printable' AS kind FROM supplier")
def _(t):
    return audits.shell_classes(t.triangles, t.mesh_vertices, 0.4, 0.2).select("part_id", "triangles", "kind")


def route_samples(t):
    cells = t.landcover.select("cx", "cy", (C("cls") % 4).alias("material"))
    return spatial.sample_lines(way_segments(t), cells, 8.0, keep=["material"]).select(C("line_id").alias("segment_id"), "material")


SAMPLED = f"""SELECT d.line_id AS segment_id, cls % 4 AS material FROM (
    SELECT line_id, x1 + (x2-x1)*(k/n) AS x, y1 + (y2-y1)*(k/n) AS y FROM (SELECT *, greatest(ceil(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/8), 1) AS n FROM {SEG} q WHERE x2 IS NOT NULL) s, LATERAL (SELECT unnest(range(CAST(n AS BIGINT))) AS k) u
    UNION ALL SELECT way_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY pos DESC) AS rn, count(*) OVER (PARTITION BY way_id) AS c FROM vertices) v WHERE rn = 1 AND c > 1) d
  JOIN landcover l ON l.cx = CAST(floor(d.x/8) AS BIGINT) AND l.cy = CAST(floor(d.y/8) AS BIGINT)"""


@query("a20_crossing_audit", f"""
    SELECT segment_id, count(*) AS samples, count(*) FILTER (WHERE material NOT IN (0, 3)) AS off_road, count(*) FILTER (WHERE segment_id % 2 = 0 AND material = 3) AS tan_on_carriageway,
           count(*) FILTER (WHERE material NOT IN (0, 3)) = 0 AND count(*) FILTER (WHERE segment_id % 2 = 0 AND material = 3) = 0 AS passed FROM ({SAMPLED}) s GROUP BY segment_id""")
def _(t):
    return audits.crossing_audit(route_samples(t), t.ways.select(C("way_id").alias("segment_id"), (C("way_id") % 2 == 0).alias("expects_ivory")))


OPENING_SQL = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'cut' WHEN 1 THEN 'water bridge opening' WHEN 2 THEN 'skipped' ELSE 'road/path overpass opening' END AS status,
    CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'wide' WHEN 2 THEN '-1' ELSE CAST((o_orderkey % 140)/100.0e0 AS VARCHAR) END AS sp, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST((o_orderkey % 100)/100.0e0 AS VARCHAR) END AS rf FROM orders"""


@query("a21_opening_audit", f"""
    WITH o AS (SELECT *, TRY_CAST(sp AS DOUBLE) AS s, TRY_CAST(rf AS DOUBLE) AS r FROM ({OPENING_SQL}) q WHERE status <> 'skipped'),
    p AS (SELECT *, CASE WHEN sp IS NULL THEN 'a' WHEN s IS NULL OR s <= 0 THEN 'b' WHEN rf IS NULL THEN 'c' WHEN r IS NULL OR r + 1e-9 < 0.6e0 THEN 'd' WHEN s > 1.2e0 + 1e-9 THEN 'e' END AS pr FROM o)
    SELECT count(*) AS openings, max(s) AS longest_span_mm, count(pr) AS offenders, count(*) FILTER (WHERE pr = 'a') AS span_missing, count(*) FILTER (WHERE pr = 'b') AS span_invalid, count(*) FILTER (WHERE pr = 'c') AS roof_missing,
           count(*) FILTER (WHERE pr = 'd') AS roof_too_thin, count(*) FILTER (WHERE pr = 'e') AS span_too_long FROM p""")
def _(t):
    k = C("o_orderkey")
    status = F.when(k % 4 == 0, "cut").when(k % 4 == 1, "water bridge opening").when(k % 4 == 2, "skipped").otherwise("road/path overpass opening")
    span = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, "wide").when(k % 9 == 2, "-1").otherwise((k % 140 / F.lit(100.0)).cast("string"))
    roof = F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, "x").otherwise((k % 100 / F.lit(100.0)).cast("string"))
    return audits.opening_report(audits.opening_audit(t.orders.select(status.alias("status"), span.alias("roof_span_mm"), roof.alias("roof_thickness_mm")), 0.4, 0.2))


@query("t6_stale_stages", """
    WITH a AS (SELECT c_custkey // 1500 AS job, c_custkey % 1500 AS stage, k AS depth, (c_custkey % 1500) // CAST(pow(3, k) AS BIGINT) AS source FROM customer CROSS JOIN range(8) AS kk(k)),
    c AS (SELECT c_custkey // 1500 AS job, c_custkey % 1500 AS stage FROM customer WHERE c_custkey % 97 = 5 AND c_custkey % 1500 > 4)
    SELECT a.job, a.stage, min(a.depth) AS depth FROM a JOIN c ON c.job = a.job AND c.stage = a.source GROUP BY a.job, a.stage""")
def _(t):
    k = C("c_custkey")
    job, stage = F.floor(k / 1500), k % 1500
    deps = t.customer.where(stage > 0).select(job.alias("job"), stage.alias("stage"), F.floor(stage / 3).alias("reads"))
    changed = t.customer.where((k % 97 == 5) & (stage > 4)).select(job.alias("job"), stage.alias("stage"))
    return audits.stale_stages(deps, changed)
