"""Queries on readers, writers and print logs. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tags as tg
from ..runtime import scratch_path
from ..sources import manifest, printlogs, tiles, vectors
from ..sources.plans import plan_records, write_plan
from .registry import query
from .scalar import ORACLE_LCC
from .seams import PLATE_SQL, plates
from .spatial import BOX

C = F.col
TILED = "SELECT id, source_order, minx, miny, maxx, maxy, tx AS tile_x, ty AS tile_y FROM (SELECT *, unnest(range(CAST(floor(minx/100) AS BIGINT), CAST(floor(maxx/100) AS BIGINT) + 1)) AS tx FROM footprints) f, LATERAL (SELECT unnest(range(CAST(floor(f.miny/100) AS BIGINT), CAST(floor(f.maxy/100) AS BIGINT) + 1)) AS ty) q"


def tiled(t):
    path = scratch_path(t.spark, "tiles")
    rows = t.footprints.select("id", "source_order", *BOX)
    again = rows.where(C("id") % 10 == 0).withColumn("source_order", C("source_order") + 10_000_000)
    tiles.write_tiles(rows.unionByName(again), path, 100.0, ["id"])
    return path


@query("s1_write_tiles", f"SELECT id, source_order, tile_x, tile_y FROM ({TILED}) q")
def _(t):
    return t.spark.read.parquet(tiled(t)).select("id", "source_order", C("tile_x").cast("bigint"), C("tile_y").cast("bigint"))


@query("s2_read_tiles", "SELECT id, minx, miny, maxx, maxy FROM footprints WHERE maxx >= 150 AND minx <= 420 AND maxy >= 210 AND miny <= 650")
def _(t):
    return tiles.read_tiles(t.spark, tiled(t), (150.0, 210.0, 420.0, 650.0), 100.0, ["id"]).select("id", *BOX)


@query("s3_tile_catalog", f"SELECT printf('x%+06d_y%+06d', tile_x, tile_y) AS tile, count(*) AS rows, tile_x*100.0e0 AS minx, tile_y*100.0e0 AS miny FROM ({TILED}) q GROUP BY tile_x, tile_y")
def _(t):
    return tiles.tile_catalog(t.spark, tiled(t), 100.0).select("tile", "rows", "minx", "miny")


@query("s4_publish", "SELECT count(*) AS rows, true AS production_ready, true AS same_is_current, false AS other_config_is_current, false AS other_sources_are_current FROM footprints")
def _(t):
    path = scratch_path(t.spark, "published")
    manifest.publish(t.footprints.select("id", *BOX), path, "span=100", "digest-1")
    state = [manifest.is_current(t.spark, path, c, s) for c, s in (("span=100", "digest-1"), ("span=50", "digest-1"), ("span=100", "digest-2"))]
    names = ["same_is_current", "other_config_is_current", "other_sources_are_current"]
    return manifest.versions(t.spark, path).select("rows", "production_ready", *[F.lit(v).alias(n) for v, n in zip(state, names)])


@query("s5_source_inventory")
def _(t):
    return manifest.source_inventory(t.spark, t.sf_dir)


def _csv(t, df, name):
    path = scratch_path(t.spark, name)
    df.write.option("header", True).csv(path)
    return path


def wkt_table(t):
    n = lambda c: C(c).cast("string")
    box = F.concat(F.lit("POLYGON (("), n("minx"), F.lit(" "), n("miny"), F.lit(", "), n("minx"), F.lit(" "), n("maxy"), F.lit(", "), n("maxx"), F.lit(" "), n("maxy"), F.lit(", "), n("maxx"), F.lit(" "), n("miny"), F.lit(", "), n("minx"), F.lit(" "), n("miny"), F.lit("))"))
    text = F.when(C("id") % 19 == 0, "POLYGON EMPTY").when(C("id") % 23 == 0, "POLYGON ((1 2, x 3, 4 5))").otherwise(box)
    return t.footprints.select(C("id").alias("Feature ID"), C("bin").alias("BIN"), text.alias("The_Geom"))


WKT_ROWS = "SELECT CAST(id AS VARCHAR) AS feature_id, bin, round(minx + 0.4005e0, 6) AS minx, round(miny - 3.0135e0, 6) AS miny, round(maxx + 0.4005e0, 6) AS maxx, round(maxy - 3.0135e0, 6) AS maxy, round((maxx-minx)*(maxy-miny), 4) AS area FROM footprints WHERE id % 19 <> 0 AND id % 23 <> 0"


@query("s6_ingest_wkt_csv", WKT_ROWS)
def _(t):
    rows = vectors.ingest_wkt_csv(t.spark, _csv(t, wkt_table(t), "wkt"), "the_geom", vectors.FOOTPRINT_SHIFT)
    return rows.select("feature_id", "bin", *[F.round(c, 6).alias(c) for c in BOX], F.round(g.area(C("edges")), 4).alias("area"))


@query("s7_ingest_lonlat_csv", f"SELECT CAST(p.id AS VARCHAR) AS stop_id, x, y FROM ({ORACLE_LCC}) p WHERE p.id % 7 <> 0 AND p.id % 11 <> 0")
def _(t):
    lon, lat = F.lit(-74.2) + (C("c_custkey") % 5000) / F.lit(10000.0), F.lit(40.5) + (C("c_custkey") % 3700) / F.lit(10000.0)
    k = C("c_custkey")
    table = t.customer.select(k.alias("Stop ID"), F.when(k % 7 != 0, lon).alias("GTFS Longitude"), F.when(k % 11 == 0, "n/a").otherwise(lat.cast("string")).alias("GTFS Latitude"))
    out = vectors.ingest_lonlat_csv(t.spark, _csv(t, table, "stops"), "gtfs_longitude", "gtfs_latitude")
    return out.select("stop_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("s8_ingest_feature_collection", """
    SELECT id AS source_order, CAST(id + 500000 AS VARCHAR) AS doitt_id, CASE WHEN id % 5 = 0 THEN NULL ELSE height_roof END AS height_roof, minx, miny, maxx, maxy FROM footprints""")
def _(t):
    p = lambda x, y: F.array(C(x), C(y))
    ring = F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"), p("minx", "miny"))
    feature = F.struct(
        F.struct("doitt_id", "bin", F.when(C("id") % 5 == 0, "tall").otherwise(C("height_roof").cast("string")).alias("height_roof")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    page = F.floor(C("id") / 250) * 250
    pages = t.dealt(t.footprints.select(page.alias("page_offset"), F.struct("id", feature.alias("f")).alias("r")), "customer", "page_offset").groupBy("page_offset").agg(
        F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["f"]).alias("features"))).alias("text"))
    parsed = pages.select("page_offset", F.from_json("text", vectors.FEATURES)["features"].alias("features"))
    return vectors.features_of_pages(parsed).select("source_order", "doitt_id", "height_roof", *BOX)


@query("s9_ingest_citygml", """
    SELECT concat('b', id) AS gml_id, CAST(id + 500000 AS VARCHAR) AS doitt_id, bin, 1 AS roof_count, 2 AS roof_levels, 1.5e0 AS z_min_ft, 20.5e0 + id % 9 AS z_max_ft, minx, miny, maxx, maxy FROM footprints WHERE minx <= 700""")
def _(t):
    xy = lambda x, y, z: F.concat(C(x).cast("string"), F.lit(" "), C(y).cast("string"), F.lit(" "), z)
    low, high = F.lit("1.5"), (F.lit(20.5) + C("id") % 9).cast("string")
    eave = (F.lit(18.5) + C("id") % 9).cast("string")

    def surface(kind, za, zb):
        ring = F.concat_ws(" ", xy("minx", "miny", za), xy("maxx", "miny", zb), xy("maxx", "maxy", zb), xy("minx", "maxy", za), xy("minx", "miny", za))
        return F.concat(F.lit(f"<bldg:boundedBy><bldg:{kind}><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), ring, F.lit(f"</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></bldg:{kind}></bldg:boundedBy>"))

    attr = lambda name, v: F.concat(F.lit(f"<gen:stringAttribute name='{name}'><gen:value>"), v, F.lit("</gen:value></gen:stringAttribute>"))
    doc = F.concat(
        F.lit("<bldg:Building gml:id='b"), C("id").cast("string"), F.lit("'>"), attr("DOITT_ID", (C("id") + 500000).cast("string")), attr("BIN", C("bin")),
        surface("GroundSurface", low, low), surface("RoofSurface", eave, high), surface("WallSurface", low, low), F.lit("</bldg:Building>"))
    path = scratch_path(t.spark, "gml")
    models = t.footprints.select(F.floor(C("id") / 250).alias("page"), doc.alias("doc")).groupBy("page").agg(
        F.concat(F.lit("<core:CityModel xmlns:core='c' xmlns:bldg='b' xmlns:gen='n' xmlns:gml='g'>"), F.concat_ws("", F.collect_list("doc")), F.lit("</core:CityModel>")).alias("value"))
    models.write.partitionBy("page").text(path)  # one model file per page of buildings
    buildings, _ = vectors.ingest_citygml(t.spark, path, (-1e9, -1e9, 700.0, 1e9))
    return buildings.select("gml_id", "doitt_id", "bin", "roof_count", "roof_levels", "z_min_ft", "z_max_ft", *BOX)


def osm_tables(t):
    v = t.vertices
    node = C("way_id") * 1000 + C("pos")
    nodes = v.select(node.alias("node_id"), "x", "y", F.create_map().cast("map<string,string>").alias("tags")).where(C("node_id") % 997 != 0)
    refs = v.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", node.alias("n")))), lambda s: s["n"]).alias("refs"))
    full = F.map_filter(tg.parse_tags(C("tags")), lambda k, x: x != "")
    ways = t.ways.select("way_id", full.alias("tags")).join(refs, "way_id")
    closed = F.when(C("way_id") % 3 == 0, F.concat("refs", F.slice("refs", 1, 1))).otherwise(C("refs"))
    return nodes, ways.withColumn("refs", closed)


@query("s10_assemble_osm_features", """
    WITH v AS (SELECT way_id, pos, x, y, (way_id*1000 + pos) % 997 = 0 AS lost FROM vertices),
    h AS (SELECT way_id, bool_or(lost) AS lost, count(*) AS n, min(x) FILTER (WHERE NOT lost) AS x0, max(x) FILTER (WHERE NOT lost) AS x1, min(y) FILTER (WHERE NOT lost) AS y0, max(y) FILTER (WHERE NOT lost) AS y1 FROM v GROUP BY way_id),
    k AS (SELECT way_id, 'line' AS kind, lost OR n < 2 AS bad, n + CASE WHEN way_id % 3 = 0 THEN 1 ELSE 0 END AS n, x0, x1, y0, y1 FROM h UNION ALL SELECT way_id, 'polygon', lost OR n < 3, n + 1, x0, x1, y0, y1 FROM h WHERE way_id % 3 = 0)
    SELECT way_id*4 + CASE kind WHEN 'line' THEN 1 ELSE 2 END AS source_order, kind, n AS vertices FROM k WHERE NOT bad AND x1 >= 100 AND x0 <= 800 AND y1 >= 100 AND y0 <= 900""")
def _(t):
    features, vertices, _ = vectors.assemble_osm_features(*osm_tables(t), (100.0, 100.0, 800.0, 900.0))
    counted = vertices.groupBy("source_order").agg(F.count("*").alias("vertices"))
    return features.select("source_order", "kind").join(counted, "source_order")


@query("s10_osm_errors", """
    SELECT way_id, kind, CASE WHEN lost THEN 'node missing' ELSE 'too few corners' END AS error FROM (
      SELECT way_id, kind, bool_or((way_id*1000 + pos) % 997 = 0) AS lost, count(*) AS n FROM vertices, (VALUES ('line'), ('polygon')) q(kind) WHERE kind = 'line' OR way_id % 3 = 0 GROUP BY way_id, kind) e
    WHERE lost OR n < CASE kind WHEN 'line' THEN 2 ELSE 3 END""")
def _(t):
    return vectors.assemble_osm_features(*osm_tables(t), (100.0, 100.0, 800.0, 900.0))[2]


@query("s12_raster_blocks", "SELECT cx, cy, cls FROM landcover")
def _(t):
    return tiles.blocks_to_cells(tiles.cells_to_blocks(t.landcover, "cls", 32), "cls", 32)


LOGS = """SELECT o_orderkey AS k, concat('plate_', o_orderkey, '.gcode') AS model, o_orderkey % 19 <> 0 AS ok, o_orderkey % 9*3600 + o_orderkey % 60*60 + 5.0e0 AS ms, 86400 + o_orderkey % 9*3600 + o_orderkey % 60*60 + 9.0e0 AS s,
    o_orderkey % 97 + 0.5e0 AS w1, o_orderkey % 31 + 0.25e0 AS w2, 20.0e0 + o_orderkey % 10 AS c1 FROM orders"""


@query("s13_print_log_stats", f"""
    SELECT model AS file, ms AS model_seconds, s AS seconds, k % 200 + 1 AS layers, CASE WHEN ok THEN w1 END AS first_g, CASE WHEN ok THEN w2 END AS second_g, (k % 89)*100 + 0.5e0 AS first_mm, 'PLA' AS first_type,
           CASE WHEN ok THEN 'ok' ELSE 'error: filament or time totals missing' END AS status FROM ({LOGS}) l""")
def _(t):
    out = printlogs.print_log_stats(t.log_lines)
    at = lambda c, i: F.get(c, F.lit(i))
    return out.select("file", "model_seconds", "seconds", "layers", at("weight_g", 0).alias("first_g"), at("weight_g", 1).alias("second_g"), at("length_mm", 0).alias("first_mm"), at("type", 0).alias("first_type"), "status")


def reports(t):
    k = C("s_suppkey")
    plate = lambda i: F.struct(
        (k % 7 + i).cast("double").alias("filament_change_times"), F.when((k + i) % 3 == 0, F.concat(F.lit("warn "), (k % 4).cast("string"))).alias("warning_message"),
        F.array(F.struct(F.lit("1").alias("id"), (k % 50 + i + 0.5).alias("main_used_g")), F.struct(F.lit("2").alias("id"), (k % 20 + 0.25).alias("main_used_g"))).alias("filaments"),
        F.create_map(F.lit("Flush"), (k % 100 + i).cast("double")).alias("feature_type_times"))
    return t.supplier.select(F.concat(F.lit("m"), k.cast("string")).alias("model"), F.to_json(F.struct(F.array(plate(0), plate(1)).alias("sliced_plates"))).alias("text"))


@query("s14_slice_report_stats", """
    SELECT concat('m', s_suppkey) AS model, (s_suppkey % 7)*2 + 1.0e0 AS changes, (s_suppkey % 100)*2 + 1.0e0 AS flush_seconds, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 3 = 2 THEN concat('warn ', s_suppkey % 4) ELSE '' END AS warnings,
           (s_suppkey % 50)*2 + 2.0e0 AS first_g, (s_suppkey % 20)*2 + 0.5e0 AS second_g FROM supplier""")
def _(t):
    totals, filaments = printlogs.slice_report_stats(reports(t))
    grams = filaments.groupBy("model").agg(F.max(F.when(C("extruder") == 1, C("model_g"))).alias("first_g"), F.max(F.when(C("extruder") == 2, C("model_g"))).alias("second_g"))
    return totals.select("model", "changes", "flush_seconds", F.array_join("warnings", ",").alias("warnings")).join(grams, "model")


def entries(t):
    filaments = printlogs.log_filaments(printlogs.print_log_stats(t.log_lines))
    k = F.regexp_extract("model", "([0-9]+)", 1).cast("bigint")
    named = filaments.withColumn("entry_order", k * 4 + C("extruder"))
    return named.withColumn("label", F.when((k >= 40) & (C("extruder") == 1), "Roads").otherwise(C("label"))).withColumn(
        "colour", F.when(k % 50 == 7, F.concat(F.lit("#"), k.cast("string")))).withColumn("model_g", F.when(k % 3 == 0, C("total_g") * 0.75))


ENTRIES = f"""SELECT k, model, s, e AS extruder, CASE e WHEN 1 THEN w1 ELSE w2 END AS total_g, CASE WHEN k % 3 = 0 THEN CASE e WHEN 1 THEN w1 ELSE w2 END*0.75e0 END AS model_g, CASE e WHEN 1 THEN w1/1000*c1 ELSE w2/1000*24 END AS cost FROM ({LOGS}) l, (VALUES (1), (2)) x(e) WHERE ok"""


@query("a8_print_summary", f"""
    WITH e AS ({ENTRIES}) SELECT extruder, CASE extruder WHEN 1 THEN 'Roads' ELSE 'Filament 2' END AS label, (SELECT concat('#', min(k)) FROM e WHERE k % 50 = 7) AS colour, round(sum(total_g), 4) AS total_g, round(sum(coalesce(model_g, 0)), 4) AS model_g,
      round(sum(coalesce(total_g - model_g, 0)), 4) AS purge_g, round(sum(cost), 4) AS cost_usd, round(sum(total_g) FILTER (WHERE model_g IS NULL), 4) AS unsplit_g, count(*) FILTER (WHERE model_g IS NULL) AS unsplit_entries FROM e GROUP BY extruder""")
def _(t):
    out = printlogs.print_summary(entries(t))
    return out.select(C("extruder").cast("bigint"), "label", "colour", *[F.round(c, 4).alias(c) for c in ("total_g", "model_g", "purge_g", "cost_usd", "unsplit_g")], "unsplit_entries")


@query("q6_print_report", f"""
    WITH e AS ({ENTRIES}), m AS (SELECT model, max(s) AS s FROM e GROUP BY model)
    SELECT models, models AS plates, seconds, shortest, round(mean, 4) AS mean, longest, round(total_g, 4) AS total_g, round(purge_share, 6) AS purge_share FROM (SELECT count(*) AS models, sum(s) AS seconds, min(s) AS shortest, avg(s) AS mean, max(s) AS longest FROM m) a
    CROSS JOIN (SELECT sum(total_g) AS total_g, sum(total_g - model_g)/sum(total_g) FILTER (WHERE model_g IS NOT NULL) AS purge_share FROM e) b""")
def _(t):
    out = printlogs.print_totals(entries(t))
    return out.select("models", "plates", "seconds", "shortest", F.round("mean", 4).alias("mean"), "longest", F.round("total_g", 4).alias("total_g"), F.round("purge_share", 6).alias("purge_share"))


@query("j16_drop_shadowed_models", """
    WITH m AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN concat('plate_', o_orderkey // 4, '.3mf') ELSE concat('plate_', o_orderkey // 3, '.gcode.3mf') END AS model, o_orderkey AS k FROM orders),
    d AS (SELECT * FROM m WHERE NOT (model LIKE '%.gcode.3mf' AND replace(model, '.gcode.3mf', '.3mf') IN (SELECT model FROM m)))
    SELECT k, model, CASE WHEN k % 5 = 0 THEN k*1.5e0 END AS seconds, k % 5 = 0 AS reused FROM d""")
def _(t):
    k = C("o_orderkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("plate_"), F.floor(k / 4).cast("string"), F.lit(".3mf"))).otherwise(F.concat(F.lit("plate_"), F.floor(k / 3).cast("string"), F.lit(".gcode.3mf")))
    models = printlogs.drop_shadowed_models(t.orders.select(k.alias("k"), name.alias("model"), F.sha2(k.cast("string"), 256).alias("sha256")))
    embedded = t.orders.where(k % 5 == 0).select(F.sha2(k.cast("string"), 256).alias("source_sha256"), (k * F.lit(1.5)).alias("seconds"))
    return printlogs.reuse_totals(models, embedded).select("k", "model", "seconds", "reused")


def gcode(t):
    """Event rows as lines of G-code, one file per user."""
    k = C("event_id")
    line = (
        F.when(k % 7 == 0, F.concat(F.lit("; Z_HEIGHT: "), (k % 40 / F.lit(5.0)).cast("string"))).when(k % 11 == 0, F.concat(F.lit("T"), (k % 4).cast("string")))
        .when(k % 5 == 0, F.element_at(F.array(*map(F.lit, ["; FEATURE: Bottom surface", "; FEATURE: Brim", "; FEATURE: Inner wall"])), (k % 3 + 1).cast("int")))
        .when(k % 101 == 0, "; WIPE_TOWER_START").when(k % 103 == 0, "; WIPE_TOWER_END").otherwise(F.concat(F.lit("G1 X1 Y1 E"), (k % 5 - 1).cast("string"))))
    return t.events.select(F.concat(F.lit("u"), C("user_id").cast("string")).alias("file"), k.alias("line_no"), line.alias("line"))


@query("a17_tool_starts", """
    WITH l AS (SELECT user_id, event_id AS k, CASE WHEN event_id % 7 = 0 THEN (event_id % 40)/5.0e0 END AS z0, CASE WHEN event_id % 7 <> 0 AND event_id % 11 = 0 THEN event_id % 4 END AS t0,
        CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'Bottom surface' WHEN 1 THEN 'Brim' ELSE 'Inner wall' END END AS f0,
        CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 THEN CASE WHEN event_id % 101 = 0 THEN 1 WHEN event_id % 103 = 0 THEN 0 END END AS w0,
        event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 5 > 1 AS mv FROM events),
    s AS (SELECT user_id, k, mv, last_value(z0 IGNORE NULLS) OVER w AS z, coalesce(last_value(t0 IGNORE NULLS) OVER w, 0) AS tool, last_value(f0 IGNORE NULLS) OVER w AS f, coalesce(last_value(w0 IGNORE NULLS) OVER w, 0) AS tw FROM l WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT * FROM s WHERE mv AND z IS NOT NULL AND tw = 0 AND coalesce(f, '') <> 'Brim'), lo AS (SELECT user_id, tool, min(z) AS z FROM m GROUP BY 1, 2)
    SELECT concat('u', m.user_id) AS file, m.tool, m.z, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS features, m.tool = 0 OR coalesce(bool_or(f = 'Bottom surface'), false) AS starts_solid FROM m JOIN lo ON lo.user_id = m.user_id AND lo.tool = m.tool AND lo.z = m.z GROUP BY m.user_id, m.tool, m.z""")
def _(t):
    return printlogs.tool_starts(gcode(t))


@query("s15_write_plan", f"""
    SELECT row_number() OVER (ORDER BY maxy DESC, minx, concat('P', id)) - 1 AS place, concat('P', id) AS label, concat('build --offline --polygon chunks/city_P', id, '.geojson --print-frame chunks/city_P', id, '.frame.json --output city_P', id, '.3mf') AS command FROM ({PLATE_SQL}) p""")
def _(t):
    mm = lambda a, b: (C(b) - C(a)) * F.lit(0.0762)
    chunks = plates(t).select(F.concat(F.lit("P"), C("id").cast("string")).alias("label"), *BOX, "edges", mm("minx", "maxx").alias("width_mm"), mm("miny", "maxy").alias("height_mm"))
    records = plan_records(chunks, "city", ["build", "--offline"])
    path = scratch_path(t.spark, "plan")
    write_plan(records, path)
    named = t.spark.read.json(f"{path}/chunks").select("place", "label")
    lines = t.spark.read.text(f"{path}/commands").select(C("value").alias("command"), F.regexp_extract("value", r"--output city_(\w+)\.3mf", 1).alias("label"))
    return named.join(lines, "label")


@query("q2_vector_cache", f"SELECT feature_id, bin, minx, miny, maxx, maxy FROM ({WKT_ROWS}) w WHERE maxx >= 150 AND minx <= 420 AND maxy >= 210 AND miny <= 650")
def _(t):
    rows = vectors.ingest_wkt_csv(t.spark, _csv(t, wkt_table(t), "wkt"), "the_geom", vectors.FOOTPRINT_SHIFT)
    path = scratch_path(t.spark, "cache")
    tiles.write_tiles(rows.withColumn("source_order", C("feature_id").cast("bigint")), path, 100.0, ["feature_id"])
    found = tiles.read_tiles(t.spark, path, (150.0, 210.0, 420.0, 650.0), 100.0, ["feature_id"])
    return found.select("feature_id", "bin", *[F.round(c, 6).alias(c) for c in BOX])
