"""Neighbourhood and region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as ops
from ..operators import focal, regions
from .cells import BINNED, binned
from .registry import query

C = F.col
GROUND = f"SELECT cx, cy, ground_m FROM ({BINNED}) b WHERE ground_m IS NOT NULL"


def ground(t):
    return binned(t).where(C("ground_m").isNotNull()).select("cx", "cy", "ground_m")


def offsets(reach, limit):
    return f"(SELECT a.i AS dx, b.i AS dy, a.i*a.i + b.i*b.i AS d2 FROM range(-{reach}, {reach} + 1) a(i), range(-{reach}, {reach} + 1) b(i) WHERE a.i*a.i + b.i*b.i <= {limit})"


@query("r4_fill_nearest", f"""
    WITH g AS ({GROUND}), c AS (SELECT g.cx + dx AS cx, g.cy + dy AS cy, g.cx AS sx, g.cy AS sy, ground_m, d2 FROM g CROSS JOIN {offsets(4, 16)} o)
    SELECT cx, cy, round(arg_min(ground_m, (d2, sy, sx)), 6) AS ground_m, min(d2) > 0 AS filled, min(d2) AS d2 FROM c GROUP BY cx, cy""")
def _(t):
    return focal.fill_nearest(ground(t), "ground_m", 4).withColumn("ground_m", F.round("ground_m", 6))


@query("r5_smooth_gaussian", f"""
    WITH g AS (SELECT cx, cy, upper_m FROM ({BINNED}) b), k AS (SELECT i, exp(-0.5*(i/0.75e0)*(i/0.75e0)) AS w FROM range(-3, 4) r(i)), n AS (SELECT i, w/(SELECT sum(w) FROM k) AS w FROM k),
    o AS (SELECT a.i AS dx, b.i AS dy, a.w*b.w AS w FROM n a, n b)
    SELECT g.cx, g.cy, round(sum(w*h.upper_m)/greatest(sum(w), 0.01), 6) AS upper_m FROM g CROSS JOIN o JOIN g h ON h.cx = g.cx + o.dx AND h.cy = g.cy + o.dy GROUP BY g.cx, g.cy""")
def _(t):
    out = focal.smooth_gaussian(binned(t).select("cx", "cy", "upper_m"), "upper_m", 0.75)
    return out.withColumn("upper_m", F.round("upper_m", 6))


@query("r6_median3", f"""
    WITH g AS (SELECT cx, cy, upper_m FROM ({BINNED}) b WHERE upper_m IS NOT NULL), o AS (SELECT a.i AS dx, b.i AS dy FROM range(-1, 2) a(i), range(-1, 2) b(i))
    SELECT g.cx, g.cy, list_sort(list(coalesce(d.upper_m, v.upper_m, h.upper_m, g.upper_m)))[5] AS upper_m FROM g CROSS JOIN o
      LEFT JOIN g d ON d.cx = g.cx + dx AND d.cy = g.cy + dy LEFT JOIN g v ON v.cx = g.cx AND v.cy = g.cy + dy LEFT JOIN g h ON h.cx = g.cx + dx AND h.cy = g.cy GROUP BY g.cx, g.cy""")
def _(t):
    return focal.median3(binned(t).select("cx", "cy", "upper_m"), "upper_m")


def closing_sql(r):
    o = offsets(r, r * r)
    return f"""WITH l AS (SELECT cx, cy, cls IN (1, 2) AS m FROM landcover),
    d AS (SELECT l.cx, l.cy, bool_or(h.m) AS m FROM l CROSS JOIN {o} o JOIN l h ON h.cx = l.cx + o.dx AND h.cy = l.cy + o.dy GROUP BY l.cx, l.cy),
    e AS (SELECT l.cx, l.cy, count(*) FILTER (WHERE h.m) = 13 AS m FROM l CROSS JOIN {o} o JOIN d h ON h.cx = l.cx + o.dx AND h.cy = l.cy + o.dy GROUP BY l.cx, l.cy)
    SELECT d.cx, d.cy, d.m AS dilated, e.m AS closed FROM d JOIN e ON d.cx = e.cx AND d.cy = e.cy"""


@query("r7_morphology", closing_sql(2))
def _(t):
    green = t.landcover.select("cx", "cy", C("cls").isin(1, 2).cast("int").alias("m"))
    wide, closed = focal.morphology(green, "m", "dilate", 2), focal.morphology(green, "m", "close", 2)
    return wide.withColumnRenamed("m", "dilated").join(closed.withColumnRenamed("m", "closed"), ["cx", "cy"])


@query("r8_distance_to", f"""
    SELECT l.cx, l.cy, round(sqrt(min(d2) FILTER (WHERE h.cls = 4)), 6) AS distance FROM landcover l CROSS JOIN {offsets(6, 36)} o
    LEFT JOIN landcover h ON h.cx = l.cx + o.dx AND h.cy = l.cy + o.dy GROUP BY l.cx, l.cy""")
def _(t):
    out = focal.distance_to(t.landcover.select("cx", "cy", (C("cls") == 4).cast("int").alias("water")), "water", 6)
    return out.withColumn("distance", F.round("distance", 6))


#: One number that orders sources by distance, row and column, and gives row and column back.
NEAREST = "min(((g.cx - q.cx)*(g.cx - q.cx) + (g.cy - q.cy)*(g.cy - q.cy))*4294967296 + (g.cy + 32768)*65536 + g.cx + 32768)"


def relief_sql():
    """Every step as a table: known heights, the nearest of them anywhere, 3 x 3 median, Gaussian mean, closed footprint, roll-off."""
    disk2, disk3 = offsets(2, 4), offsets(3, 9)
    return f"""WITH l AS (SELECT l.cx, l.cy, (b.upper_m - b.ground_m)/2 AS h, l.cls IN (1, 2) AS veg, l.cls <> 5 AS ok FROM landcover l LEFT JOIN ({BINNED}) b ON b.cx = l.cx AND b.cy = l.cy),
    g AS (SELECT cx, cy, h FROM l WHERE veg AND h > 1 AND h <= 36),
    far AS (SELECT q.cx, q.cy, {NEAREST} AS k FROM l q, g WHERE NOT EXISTS (SELECT 1 FROM g x WHERE x.cx = q.cx AND x.cy = q.cy) GROUP BY q.cx, q.cy),
    f AS MATERIALIZED (SELECT cx, cy, h AS v FROM g UNION ALL SELECT far.cx, far.cy, g.h FROM far JOIN g ON g.cx = k % 65536 - 32768 AND g.cy = k // 65536 % 65536 - 32768),
    o AS (SELECT a.i AS dx, b.i AS dy FROM range(-1, 2) a(i), range(-1, 2) b(i)),
    calm AS (SELECT g.cx, g.cy, list_sort(list(coalesce(d.v, v.v, h.v, g.v)))[5] AS v FROM f g CROSS JOIN o
      LEFT JOIN f d ON d.cx = g.cx + dx AND d.cy = g.cy + dy LEFT JOIN f v ON v.cx = g.cx AND v.cy = g.cy + dy LEFT JOIN f h ON h.cx = g.cx + dx AND h.cy = g.cy GROUP BY g.cx, g.cy),
    wide AS (SELECT l.cx, l.cy FROM l CROSS JOIN {disk2} o JOIN l h ON h.cx = l.cx + o.dx AND h.cy = l.cy + o.dy WHERE h.veg GROUP BY l.cx, l.cy),
    closed AS MATERIALIZED (SELECT l.cx, l.cy FROM l CROSS JOIN {disk2} o JOIN wide h ON h.cx = l.cx + o.dx AND h.cy = l.cy + o.dy GROUP BY l.cx, l.cy HAVING count(*) = 13),
    usable AS MATERIALIZED (SELECT cx, cy, v FROM calm JOIN closed USING (cx, cy)),
    w AS (SELECT i, exp(-0.5*(i/1.5e0)*(i/1.5e0)) AS w FROM range(-6, 7) r(i)), n AS (SELECT i, w/(SELECT sum(w) FROM w) AS w FROM w),
    soft AS (SELECT u.cx + a.i AS cx, u.cy + b.i AS cy, sum(a.w*b.w*v)/greatest(sum(a.w*b.w), 0.01) AS v FROM usable u, n a, n b GROUP BY 1, 2),
    foot AS MATERIALIZED (SELECT l.cx, l.cy, l.veg FROM l JOIN closed USING (cx, cy) WHERE ok),
    rim AS (SELECT cx, cy FROM l ANTI JOIN foot USING (cx, cy)),
    edge AS (SELECT f.cx, f.cy, min(d2) AS d2 FROM foot f CROSS JOIN {disk3} o JOIN rim r ON r.cx = f.cx + o.dx AND r.cy = f.cy + o.dy GROUP BY f.cx, f.cy),
    t AS (SELECT f.cx, f.cy, f.veg, least(1, sqrt(coalesce(d2, 16))*0.5/1.5) AS t FROM foot f LEFT JOIN edge USING (cx, cy))
    SELECT l.cx, l.cy, round(CASE WHEN t IS NULL THEN 0 ELSE least(36, greatest(0, coalesce(soft.v, 0)))*t*t*(3 - 2*t) END, 6) AS relief_m, t IS NOT NULL AS footprint,
      coalesce(l.veg AND h > 1 AND h <= 36, false) AS measured, coalesce(NOT t.veg, false) AS closed_gap FROM l LEFT JOIN t USING (cx, cy) LEFT JOIN soft USING (cx, cy)"""


@query("r9_canopy_relief", relief_sql())
def _(t):
    cells = t.landcover.join(binned(t), ["cx", "cy"], "left").select(
        "cx", "cy", ((C("upper_m") - C("ground_m")) / 2).alias("height_m"), C("cls").isin(1, 2).cast("int").alias("vegetation"),
        (C("cls") != 5).cast("int").alias("eligible"))
    return focal.canopy_relief(cells, step_mm=0.5, scale=4000.0, smoothing_m=3.0, gap_mm=1.5, edge_mm=1.5).withColumn("relief_m", F.round("relief_m", 6))


def materials(t):
    return t.landcover.select(
        "cx", "cy", (C("cls") % 4).alias("material"), (C("cls") * F.lit(1.0) + (C("cx") + C("cy")) % 3).alias("height_mm"),
        ((C("cx") * 3 + C("cy")) % 29 == 0).alias("protected"))


def thin_sql(passes):
    """A pass as four tables: whole beads of one colour, what they cover, what they leave thin, and its nearest cell that passes."""
    o = offsets(1, 1)
    ctes = ["s0 AS (SELECT cx, cy, cls % 4 AS material, cls*1.0e0 + (cx + cy) % 3 AS height_mm, (cx*3 + cy) % 29 = 0 AS protected, false AS moved FROM landcover)"]
    for k in range(passes):
        ctes += [f"""e{k} AS (SELECT a.cx, a.cy, a.material FROM s{k} a CROSS JOIN {o} o JOIN s{k} b ON b.cx = a.cx + dx AND b.cy = a.cy + dy AND b.material = a.material GROUP BY 1, 2, 3 HAVING count(*) = 5)""",
                 f"c{k} AS (SELECT DISTINCT cx + dx AS cx, cy + dy AS cy, true AS held FROM e{k} CROSS JOIN {o} o)",
                 f"t{k} AS MATERIALIZED (SELECT s.*, NOT protected AND held IS NULL AS thin FROM s{k} s LEFT JOIN c{k} USING (cx, cy))",
                 f"n{k} AS MATERIALIZED (SELECT q.cx, q.cy, {NEAREST} AS k FROM t{k} q, t{k} g WHERE q.thin AND NOT g.thin GROUP BY q.cx, q.cy)",
                 f"""s{k + 1} AS MATERIALIZED (SELECT t.cx, t.cy, coalesce(g.material, t.material) AS material, coalesce(g.height_mm, t.height_mm) AS height_mm, t.protected, t.moved OR k IS NOT NULL AS moved
                   FROM t{k} t LEFT JOIN n{k} n ON n.cx = t.cx AND n.cy = t.cy LEFT JOIN t{k} g ON g.cx = k % 65536 - 32768 AND g.cy = k // 65536 % 65536 - 32768)"""]
    return f"WITH {', '.join(ctes)} SELECT cx, cy, CAST(material AS INT) AS material, height_mm, protected, moved FROM s{passes}"


@query("r10_absorb_thin", thin_sql(6))
def _(t):
    m = materials(t).withColumn("protected", C("protected").cast("int"))
    return focal.absorb_thin(m, nozzle_mm=1.0, step_mm=0.5)


def contacts_sql(rounds):
    step = """SELECT m.cx, m.cy, CASE WHEN ch THEN up ELSE material END AS material, protected, moved OR ch AS moved FROM (
      SELECT m.*, u.material AS up, NOT m.protected AND coalesce(
          (l1.material = m.material AND u.material <> m.material AND l0.material <> m.material) OR FALSE, false) OR NOT m.protected AND coalesce(
          (r1.material = m.material AND u.material <> m.material AND r0.material <> m.material) OR FALSE, false) AS ch
      FROM {src} m LEFT JOIN {src} u ON u.cx = m.cx AND u.cy = m.cy + 1 LEFT JOIN {src} l1 ON l1.cx = m.cx - 1 AND l1.cy = m.cy + 1 LEFT JOIN {src} l0 ON l0.cx = m.cx - 1 AND l0.cy = m.cy
      LEFT JOIN {src} r1 ON r1.cx = m.cx + 1 AND r1.cy = m.cy + 1 LEFT JOIN {src} r0 ON r0.cx = m.cx + 1 AND r0.cy = m.cy) m"""
    ctes = ["s0 AS (SELECT cx, cy, cls % 4 AS material, (cx*3 + cy) % 29 = 0 AS protected, false AS moved FROM landcover)"]
    ctes += [f"s{k + 1} AS MATERIALIZED ({step.format(src=f's{k}')})" for k in range(rounds)]
    return f"WITH {', '.join(ctes)} SELECT cx, cy, CAST(material AS INT) AS material, moved FROM s{rounds}"


@query("r11_diagonal_contacts", contacts_sql(12))
def _(t):
    m = materials(t).withColumn("protected", C("protected").cast("int"))
    return focal.diagonal_contacts(m).select("cx", "cy", "material", "moved")


def labels_sql(cells):
    """CTEs ``labelled (cx, cy, value, label)``: runs along rows, then every run a smaller one reaches through larger ones."""
    return f"""rows_ AS (SELECT l.cx, l.cy, l.value, l.cy*4294967296 + l.cx + 2147483648 AS id, CASE WHEN p.value = l.value THEN 0 ELSE 1 END AS opens FROM ({cells}) l LEFT JOIN ({cells}) p ON p.cx = l.cx - 1 AND p.cy = l.cy),
    runs_ AS (SELECT cx, cy, value, max(CASE WHEN opens = 1 THEN id END) OVER (ORDER BY id) AS run FROM rows_),
    touch AS (SELECT DISTINCT a.run AS u, b.run AS v FROM runs_ a JOIN runs_ b ON b.cx = a.cx AND b.cy = a.cy + 1 AND b.value = a.value),
    ways_ AS (SELECT u, v FROM touch UNION SELECT v, u FROM touch),
    reach AS (SELECT DISTINCT run AS root, run AS node FROM runs_ UNION SELECT root, v FROM reach JOIN ways_ ON u = node WHERE v > root),
    labelled AS (SELECT cx, cy, value, label FROM runs_ JOIN (SELECT node, min(root) AS label FROM reach GROUP BY node) m ON node = run)"""


@query("r1_label_regions", f"WITH RECURSIVE {labels_sql('SELECT cx, cy, cls AS value FROM landcover')} SELECT cx, cy, CAST(value AS DOUBLE) AS cls, label FROM labelled")
def _(t):
    return regions.label_regions(t.landcover, "cls", tile=64).select("cx", "cy", "cls", "label")


@query("r1_region_sizes", f"""
    WITH RECURSIVE {labels_sql('SELECT cx, cy, cls AS value FROM landcover WHERE cls = 4')}
    SELECT size, count(*) AS regions FROM (SELECT count(*) AS size FROM labelled GROUP BY label) s GROUP BY size""")
def _(t):
    water = regions.label_regions(t.landcover.where(C("cls") == 4), "cls", tile=64)
    sizes = regions.region_totals(water, size=F.lit(1)).select("label", "size").distinct()
    return sizes.groupBy("size").agg(F.count("*").alias("regions"))


@query("r3_vegetated_ground", f"""
    WITH RECURSIVE {labels_sql('SELECT cx, cy, 1 AS value FROM landcover WHERE cls IN (1, 2, 3)')},
    k AS (SELECT l.cx, l.cy, c.cls, avg(CASE WHEN c.cls IN (1, 2) THEN 1.0e0 ELSE 0 END) OVER (PARTITION BY label) AS green FROM labelled l JOIN landcover c ON c.cx = l.cx AND c.cy = l.cy)
    SELECT cx, cy, cls FROM k WHERE cls IN (1, 2) OR green > 0.5""")
def _(t):
    return regions.vegetated_ground(t.landcover, tile=64)


@query("r12_flat_zones")
def _(t):
    cells = binned(t).where(C("upper_m").isNotNull()).select(
        "cx", "cy", (C("upper_m") / 10).alias("z_mm"), F.concat_ws("_", F.floor(C("cx") / 125), F.floor(C("cy") / 125)).alias("plate"))
    return regions.flat_zones(cells, "z_mm", 0.2, 0.2, tile=64)


def buildings(t):
    plate = F.concat_ws("_", F.floor(C("cx") / 125), F.floor(C("cy") / 125))
    return binned(t).where(C("upper_m").isNotNull()).join(t.landcover, ["cx", "cy"]).select(
        "cx", "cy", C("upper_m").alias("height_mm"), (C("cls") % 4).alias("material"), (C("cls") != 4).alias("building"), plate.alias("plate"))


@query("r25_narrow_peaks")
def _(t):
    return regions.narrow_peaks(buildings(t), step_mm=0.5, diameter_mm=2.0, band_mm=6.0, sweep_mm=2.0)


@query("o4_suppress_peaks", """
    WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY peak_mm DESC, x, y) AS n
      FROM (SELECT x, y, elevation_ft AS peak_mm, CAST(floor(x/1000) AS BIGINT) || '_' || CAST(floor(y/1000) AS BIGINT) AS plate FROM spots) q),
    f AS (SELECT x, y, peak_mm, plate, n, true AS kept, [{'px': x, 'py': y}] AS held FROM c WHERE n = 1
      UNION ALL SELECT x, y, peak_mm, plate, n, free, CASE WHEN free THEN list_append(held, {'px': x, 'py': y}) ELSE held END
      FROM (SELECT c.*, f.held, len(list_filter(f.held, lambda h: sqrt((h.px - c.x)*(h.px - c.x) + (h.py - c.y)*(h.py - c.y)) < 30)) = 0 AS free FROM f JOIN c ON c.plate = f.plate AND c.n = f.n + 1) w)
    SELECT x, y, peak_mm, plate FROM f WHERE kept""")
def _(t):
    spots = t.spots.select("x", "y", C("elevation_ft").alias("peak_mm"), F.concat_ws("_", F.floor(C("x") / 1000), F.floor(C("y") / 1000)).alias("plate"))
    return regions.suppress_peaks(spots, 30.0)
