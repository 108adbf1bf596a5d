"""End-to-end queries, table functions and the streaming forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import levels, tables
from ..functions import tags as tg
from ..operators import audits, buildings, focal, ordered, paint, regions, roads, spatial
from ..operators import cells as cell_ops
from ..runtime import cut, scratch_path
from ..sources.derived import CELL_FT
from ..streaming import ingest
from .buildings import fixtures, ground_of, parts, stair_runs, surfaces
from .cells import BINNED, binned
from .focal import offsets
from .registry import query
from .roads import road_symbols
from .spatial import CROSSED, SEG, way_segments

C = F.col
REACH = 6


def elevation_cells(t):
    """Binned cells with ground filled from the nearest observed cell, upper raised to it."""
    cells = cut(binned(t), "binned")
    filled = focal.fill_nearest(cells.where(C("ground_m").isNotNull()), "ground_m", REACH).select("cx", "cy", "ground_m", "filled")
    both = filled.join(cells.select("cx", "cy", "upper_m"), ["cx", "cy"], "full")
    return both.withColumn("upper_m", F.when(C("upper_m").isNotNull(), F.greatest("upper_m", "ground_m")))


@query("q1_elevation_cache", f"""
    WITH b AS ({BINNED}), k AS (SELECT * FROM b WHERE ground_m IS NOT NULL),
    c AS (SELECT k.cx + dx AS cx, k.cy + dy AS cy, k.cx AS sx, k.cy AS sy, ground_m, d2 FROM k CROSS JOIN {offsets(REACH, REACH * REACH)} o),
    f AS (SELECT cx, cy, arg_min(ground_m, (d2, sy, sx)) AS ground_m, min(d2) > 0 AS filled FROM c GROUP BY cx, cy),
    j AS (SELECT coalesce(f.cx, b.cx) AS cx, coalesce(f.cy, b.cy) AS cy, f.ground_m, f.filled, greatest(b.upper_m, f.ground_m) AS up, b.upper_m FROM f FULL JOIN b ON b.cx = f.cx AND b.cy = f.cy)
    SELECT CAST(floor(cx/64) AS BIGINT) AS tile_x, CAST(floor(cy/64) AS BIGINT) AS tile_y, round(count(*) FILTER (WHERE ground_m IS NOT NULL AND NOT filled)/4096.0e0, 6) AS observed, round(count(*) FILTER (WHERE filled)/4096.0e0, 6) AS filled,
           round(count(upper_m)/4096.0e0, 6) AS upper_observed, round(avg(ground_m), 5) AS mean_ground_m, max(CASE WHEN upper_m IS NULL THEN NULL ELSE up END) AS top_m, count(*) AS cells FROM j GROUP BY 1, 2""")
def _(t):
    cells = cell_ops.with_tile(elevation_cells(t), 64)
    share = lambda c: F.round(F.count(F.when(c, 1)) / F.lit(4096.0), 6)
    return cells.groupBy("tile_x", "tile_y").agg(
        share(C("ground_m").isNotNull() & ~C("filled")).alias("observed"), share(C("filled")).alias("filled"), share(C("upper_m").isNotNull()).alias("upper_observed"),
        F.round(F.avg("ground_m"), 5).alias("mean_ground_m"), F.max("upper_m").alias("top_m"), F.count("*").alias("cells"))


#: Kinds of drawn route: which ways are drawn so, and how wide in feet.
DRAWN = {
    "roads": ("drawn = 'ribbon'", 12.0), "trails": ("cls = 'trail' AND drawn <> 'deck'", 8.0), "road_decks": ("drawn = 'deck' AND cls = 'carriageway'", 16.0),
    "trail_decks": ("drawn = 'deck' AND cls = 'trail'", 10.0), "tunnels": ("drawn = 'none' AND startswith(grade, 'tunnel:')", 12.0)}


def fixed_cells(stand, on_roofs):
    """Roof cells that fixtures stand on, with the highest top; which cells those are is worked out once."""
    on_roof = cut(buildings.fixtures_on_roofs(stand, on_roofs, CELL_FT, 20.0), "on-roof")
    tops = buildings.fixture_levels(on_roof, 0.8).where("top_m IS NOT NULL").select("id", C("top_m").alias("fixture_m"))
    return on_roof.join(tops.hint("merge"), "id").groupBy("cx", "cy").agg(F.max("fixture_m").alias("top_m"))


def material_fields(t):
    """Material and printed heights per cell from all layers of the map.

    Routes are drawn in one pass that carries their kind. Decks run between the ends that their bridge's profile gives,
    stairs in whole treads, fixtures stand on the roofs just computed; then the ground comes back over tunnels in parks.
    """
    ground = cut(t.landcover.withColumn("ground_m", ground_of()), "ground")
    base = ground.select("cx", "cy", "ground_m")
    lifted = lambda cells, material, lift: cells.select("cx", "cy").join(base, ["cx", "cy"]).select("cx", "cy", F.lit(material).alias("material"), (C("ground_m") + lift).alias("top_m"))
    segments = cut(way_segments(t), "segments")
    routes = road_symbols(t, segments).select("way_id", "cls", "drawn", "grade")
    kind = F.coalesce(*[F.when(F.expr(cond), name) for name, (cond, _) in DRAWN.items()])
    width = F.create_map(*[F.lit(x) for name, (_, feet) in DRAWN.items() for x in (name, feet)])[C("kind")]
    lines = cut(segments.join(routes.withColumn("kind", kind).where("kind IS NOT NULL"), C("line_id") == C("way_id")).withColumn("width_ft", width), "lines")
    ribbons = cut(roads.road_ribbons(lines, CELL_FT, ["kind"]), "ribbons")
    drawn = lambda *names: ribbons.where(C("kind").isin(*names)).select("cx", "cy")
    seen = cut(binned(t), "binned")

    spanning = lines.where(C("kind").isin("road_decks", "trail_decks"))
    spanning = cut(spanning.join(spanning.groupBy("way_id").agg(F.sum("length").alias("line_length")), "way_id").withColumn("carriageway", C("kind") == "road_decks"), "spanning")
    spots = t.spots.select("x", "y", C("elevation_ft").alias("value"))
    profiles = cut(paint.deck_profiles(spanning, surfaces(t).where(C("id") % 5 == 0), spots, base, size=CELL_FT, near_ft=6.56, spot_ft=3.0, ribbon_ft=20.0), "profiles")
    planned = [paint.deck_cells(spanning.where(C("kind") == name), profiles, CELL_FT, DRAWN[name][1], 0.48).withColumn("kind", F.lit(name)) for name in ("road_decks", "trail_decks")]
    spans = planned[0].unionByName(planned[1]).groupBy("kind", "cx", "cy").agg(F.max("top_m").alias("deck_m"))
    decks = ribbons.where(C("kind").isin("road_decks", "trail_decks")).join(base, ["cx", "cy"]).join(spans, ["kind", "cx", "cy"], "left")
    deck = lambda name, material: decks.where(C("kind") == name).select("cx", "cy", F.lit(material).alias("material"), F.coalesce("deck_m", C("ground_m") + 5.0).alias("top_m"))

    prints = cut(spatial.rasterize(t.polygons, CELL_FT).withColumnRenamed("id", "fid"), "prints")
    roofs = buildings.roof_surface(surfaces(t), CELL_FT).withColumn("roof_m", C("roof_m") - 20)
    massing = parts(t, every=True).select(F.floor(C("cx") / 2).alias("cx"), F.floor(C("cy") / 2).alias("cy"), "part_m", "part_owner").groupBy("cx", "cy").agg(
        F.max("part_m").alias("part_m"), F.max_by("part_owner", F.struct("part_m", "part_owner")).alias("part_owner"))
    heights = cut(buildings.building_heights(
        ground.select("cx", "cy", "ground_m", C("cls").isin(4, 7).alias("barred")).join(prints, ["cx", "cy"], "left"),
        t.footprints.select(C("id").alias("fid"), (C("height_roof") / 6).alias("recorded_m")), cut(roofs, "roofs"), cut(massing, "parts")), "heights")
    upper = seen.select("cx", "cy", (C("upper_m") / 2).alias("upper_m"))
    on_roofs = heights.join(upper, ["cx", "cy"], "left").select("cx", "cy", "top_m", "upper_m")
    fixed = fixed_cells(fixtures(t), on_roofs)
    treads, _ = paint.stair_treads(stair_runs(t, segments), base, prints.select("cx", "cy"), ground.where(C("cls") == 4).select("cx", "cy"), drawn("roads", "road_decks", "trail_decks"),
                                   size=CELL_FT, width_ft=12.0, mm_per_ft=0.0762, mm_per_m=0.375, relief_m=0.5)

    green = cut(regions.vegetated_ground(t.landcover, tile=64), "green")
    measured = seen.select("cx", "cy", ((C("upper_m") - F.coalesce("ground_m", F.lit(0.0))) / 2).alias("height_m"))
    canopy_in = ground.join(measured, ["cx", "cy"], "left").select("cx", "cy", "height_m", C("cls").isin(1, 2).cast("int").alias("vegetation"), (~C("cls").isin(4, 5)).cast("int").alias("eligible"))
    canopy = focal.canopy_relief(canopy_in, step_mm=0.5, scale=4000.0, smoothing_m=3.0, gap_mm=1.5, edge_mm=1.5).where("footprint and relief_m > 0")
    layers = {
        "fallback_green": lifted(ground.where(C("cls") == 8), 1, 0.0), "green": lifted(green, 1, 0.0), "water": lifted(ground.where(C("cls") == 4), 2, -0.5),
        "pads": lifted(ground.where(C("cls") == 7), 3, 0.16), "trails": lifted(drawn("trails"), 3, 0.48), "roads": lifted(drawn("roads"), 0, 0.48),
        "trail_decks": deck("trail_decks", 3), "road_decks": deck("road_decks", 0),
        "buildings": heights.select("cx", "cy", F.lit(0).alias("material"), "top_m"),
        "canopy": canopy.join(base, ["cx", "cy"]).select("cx", "cy", F.lit(1).alias("material"), (C("ground_m") + C("relief_m")).alias("top_m")),
        "fixtures": fixed.select("cx", "cy", F.lit(0).alias("material"), "top_m"), "stairs": treads.select("cx", "cy", "material", "top_m")}
    painted = paint.paint_priority(base, layers)
    holds = lambda *names: reduce(lambda a, b: a | b, [paint.has_layer(n) for n in names])
    flagged = painted.join(drawn("tunnels").distinct().withColumn("tunnel", F.lit(True)), ["cx", "cy"], "left").withColumns({
        "tunnel": F.coalesce("tunnel", F.lit(False)), "park": holds("green", "fallback_green"), "bridge": holds("road_decks", "trail_decks"), "surface_route": holds("roads", "trails")})
    printed = paint.restore_over_tunnels(flagged).withColumnRenamed("top_m", "surface_m")
    mm = cell_ops.relative_heights_mm(printed, 2.0, 4000.0, 1.5, 1.0, 0.8)
    return mm.withColumn("substrate_mm", levels.substrate_top(C("ground_mm"), C("surface_mm"), 0.0, levels.colour_depth(F.lit(0.2))))


@query("q4_material_fields")
def _(t):
    cells = material_fields(t)
    drawn = [F.count_if(paint.has_layer(n)).alias(f"{n}_cells") for n in ("road_decks", "trail_decks", "fixtures", "stairs")]
    return cells.groupBy("material").agg(
        F.count("*").alias("cells"), F.avg("surface_mm").alias("mean_surface_mm"), F.max("surface_mm").alias("top_mm"), F.min("substrate_mm").alias("lowest_substrate_mm"),
        F.count_if(paint.has_layer("trails") & paint.has_layer("roads")).alias("trails_yielded"), *drawn,
        F.count_if("tunnel").alias("tunnel_cells"), F.count_if("restored").alias("restored_cells"))


@query("q7_crossing_validation", f"""
    WITH s AS (SELECT * FROM (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM {SEG} q WHERE x2 IS NOT NULL) r),
    m AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY pos) - len AS st, sum(len) OVER (PARTITION BY line_id) AS total FROM s),
    p AS (SELECT a.line_id AS upper_id, a.pos AS upper_pos, b.st, b.total, b.len, (a.x2-a.x1)*(b.y2-b.y1) - (a.y2-a.y1)*(b.x2-b.x1) AS det, (b.x1-a.x1)*(b.y2-b.y1) - (b.y1-a.y1)*(b.x2-b.x1) AS tn, (b.x1-a.x1)*(a.y2-a.y1) - (b.y1-a.y1)*(a.x2-a.x1) AS un
          FROM m a JOIN m b ON a.line_id <> b.line_id AND a.line_id % 13 <> 0 AND a.line_id % 10 NOT IN (3, 8) AND b.line_id % 13 = 0
            AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2)),
    c AS (SELECT DISTINCT upper_id, upper_pos FROM p WHERE det <> 0 AND tn/det >= 0 AND tn/det < 1 AND un/det >= 0 AND un/det < 1 AND st + un/det*len BETWEEN 0.05 AND total - 0.05),
    d AS (SELECT s.line_id AS way, s.pos, x1 + (x2-x1)*(k/n) AS x, y1 + (y2-y1)*(k/n) AS y FROM (SELECT s.*, greatest(ceil(len/8), 1) AS n FROM s JOIN c ON c.upper_id = s.line_id AND c.upper_pos = s.pos) s, LATERAL (SELECT unnest(range(CAST(n AS BIGINT))) AS k) u
          UNION ALL SELECT s.line_id, s.pos, x2, y2 FROM s JOIN c ON c.upper_id = s.line_id AND c.upper_pos = s.pos),
    j AS (SELECT way, pos, cls % 4 AS material FROM d JOIN landcover l ON l.cx = CAST(floor(d.x/8) AS BIGINT) AND l.cy = CAST(floor(d.y/8) AS BIGINT))
    SELECT way AS upper_id, pos AS upper_pos, count(*) AS samples, count(*) FILTER (WHERE material NOT IN (0, 3)) AS off_road, count(*) FILTER (WHERE material = 3 AND way % 10 IN (0, 1, 2, 9)) AS tan_on_carriageway,
           count(*) FILTER (WHERE material NOT IN (0, 3)) = 0 AND count(*) FILTER (WHERE material = 3 AND way % 10 IN (0, 1, 2, 9)) = 0 AS passed FROM j GROUP BY way, pos""")
def _(t):
    s = cut(ordered.segments(t.vertices), "segments")
    ends = ["way_id", "pos", "x1", "y1", "x2", "y2"]
    total = s.groupBy("way_id").agg(F.sum("length").alias("line_length"))
    kind = tg.drawn_class(F.when((C("way_id") % 10).isin(3, 8), "other").when((C("way_id") % 10).isin(0, 1, 2, 9), "carriageway"), C("highway"))
    shown = t.ways.select("way_id", F.when((C("way_id") % 10) == 6, "trail").otherwise(kind).alias("cls")).where(C("cls") != "other")
    upper = s.where(C("way_id") % 13 != 0).join(shown, "way_id", "left_semi").select(*ends)
    lower = s.where(C("way_id") % 13 == 0).join(total, "way_id").select(*ends, "start_length", "line_length")
    crossed = spatial.route_crossings(upper, lower, 32.0).select(C("upper_id").alias("way_id"), C("upper_pos").alias("pos")).distinct()
    checked = upper.join(crossed, ["way_id", "pos"], "left_semi").select(
        F.struct("way_id", C("pos").alias("at")).alias("segment_id"), F.lit(0).alias("pos"), "x1", "y1", "x2", "y2")
    material = t.landcover.select("cx", "cy", (C("cls") % 4).alias("material"))
    samples = spatial.sample_lines(checked, material, 8.0, "segment_id")
    due = checked.select("segment_id", (C("segment_id.way_id") % 10).isin(0, 1, 2, 9).alias("expects_ivory"))
    return audits.crossing_audit(samples, due).select(C("segment_id.way_id").alias("upper_id"), C("segment_id.at").alias("upper_pos"), "samples", "off_road", "tan_on_carriageway", "passed")


@query("x1_cells_of_polygon", f"""
    SELECT id, count(*) AS cells, sum(cx) AS sum_cx, sum(cy) AS sum_cy FROM (SELECT p.id, cx, cy FROM (SELECT id, minx, miny, maxx, maxy, unnest(range(CAST(floor(minx/2) AS BIGINT), CAST(floor(maxx/2) AS BIGINT) + 1)) AS cx FROM footprints) p,
      LATERAL (SELECT unnest(range(CAST(floor(p.miny/2) AS BIGINT), CAST(floor(p.maxy/2) AS BIGINT) + 1)) AS cy) q, LATERAL (SELECT cx*2 + 1.0e0 AS px, cy*2 + 1.0e0 AS py) c JOIN edges e ON e.id = p.id GROUP BY p.id, cx, cy, px, py HAVING {CROSSED}) r GROUP BY id""")
def _(t):
    tables.register(t.spark)
    return t.spark.sql("""
        SELECT id, count(*) AS cells, sum(cx) AS sum_cx, sum(cy) AS sum_cy
        FROM {polygons} p LATERAL VIEW inline(cell_runs(p.edges, 2.0D)) r AS cy, low, high LATERAL VIEW explode(sequence(low, high)) c AS cx GROUP BY id""", polygons=t.polygons)


@query("x2_densify", f"""
    SELECT line_id, CAST(sum(greatest(ceil(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))/5), 1)) AS BIGINT) AS points FROM {SEG} q WHERE x2 IS NOT NULL GROUP BY line_id""")
def _(t):
    pieces = g.densify(*[C(c) for c in ("x1", "y1", "x2", "y2")], 5.0)  # as the table function, but without a Python call for every row
    return way_segments(t).select("line_id", F.explode(pieces).alias("d")).groupBy("line_id").agg(F.count("d.k").alias("points"))


def _files(t, df, name, key, base):
    """``df`` written as at least eight files, one for every million rows of the ``base`` table."""
    path = scratch_path(t.spark, name)
    df.repartition(max(8, -(-t.base(base).count() // 1_000_000)), key).write.parquet(path)
    return path


@query("t1_stream_pages", "SELECT id // 100 AS page, id % 100 AS position, id FROM footprints")
def _(t):
    pages = t.footprints.select("id", F.floor(C("id") / 100).alias("page"), (C("id") % 100).alias("position"))
    source, path = scratch_path(t.spark, "landing"), scratch_path(t.spark, "pages")
    for half in (0, 1):
        first = pages.where((C("id") < 700) if half == 0 else (C("id") >= 700) | (C("page") == 1))  # page 1 lands twice
        first.repartition(4, "page").write.mode("append").parquet(source)
        ingest.stream_pages(t.spark, source, "id bigint, page bigint, position bigint", path, "pages of 100")
    return ingest.landed_pages(t.spark, path).select("page", "position", "id")


@query("t2_stream_bin_points", f"SELECT cx, cy, round(ground_m, 6) AS ground_m, ground_points, upper_m, upper_points FROM ({BINNED}) b")
def _(t):
    points = cell_ops.read_points(t.points).select("x", "y", "z_ft", "cls", "withheld", "order_id")
    source = _files(t, points, "points", "order_id", "lineitem")
    cells = ingest.stream_bin_points(t.spark, source, "x double, y double, z_ft double, cls int, withheld boolean", scratch_path(t.spark, "live"), CELL_FT)
    return cells.withColumn("ground_m", F.round("ground_m", 6))


@query("t3_stream_dedupe", "SELECT event_id, event_type FROM events")
def _(t):
    events = t.events.select("event_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    source = _files(t, events.unionByName(events.where(C("event_id") % 3 == 0)), "events", "event_id", "events")
    stream = t.spark.readStream.schema("event_id bigint, event_type string, ts timestamp").option("maxFilesPerTrigger", 3).parquet(source)
    out = scratch_path(t.spark, "deduped")
    once = ingest.stream_dedupe(stream, ["event_id"], "ts", "400 days")
    once.writeStream.format("parquet").option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "event_type")


@query("t4_stream_stage_status", """
    SELECT job, stage, arg_max(status, (ts, event_id)) AS status FROM stage_events GROUP BY job, stage""")
def _(t):
    events = t.stage_events.select("event_id", C("ts").cast("timestamp").alias("ts"), "job", "stage", "status")
    source = _files(t, events, "stages", "event_id", "events")
    stream = t.spark.readStream.schema("event_id bigint, ts timestamp, job string, stage string, status string").parquet(source)
    out = scratch_path(t.spark, "status")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    status = ingest.stream_stage_status(stream, patience_minutes=10**8, lateness="400 days")
    status.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{out}/rows")
    return rows.groupBy("job", "stage").agg(F.max_by("status", "batch").alias("status"))


@query("t5_refresh_tiles", """
    SELECT CAST(floor(minx/100) AS BIGINT) AS tile_x, CAST(floor(miny/100) AS BIGINT) AS tile_y, count(*) AS rows, CASE WHEN bool_or(id % 500 = 3) THEN 1 ELSE 0 END AS run FROM footprints GROUP BY 1, 2""")
def _(t):
    rows = t.footprints.select(F.floor(C("minx") / 100).alias("tile_x"), F.floor(C("miny") / 100).alias("tile_y"), "id", "height_roof")
    path = scratch_path(t.spark, "refreshed")
    ingest.refresh_tiles(rows, path, "v1")
    changed = rows.withColumn("height_roof", F.when(C("id") % 500 == 3, -1.0).otherwise(C("height_roof")))
    ingest.refresh_tiles(changed, path, "v1")
    return ingest.refresh_tiles(changed, path, "v1").select("tile_x", "tile_y", "rows", "run")
