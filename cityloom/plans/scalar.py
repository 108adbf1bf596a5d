"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice, levels, tags, text
from ..sources.derived import CELL_FT
from .registry import query

C = F.col


@query("p1_normalize_columns", "SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal AS acct_bal_usd FROM customer")
def _(t):
    raw = t.customer.select(C("c_custkey").alias("Cust Key"), C("c_name").alias("__Full--Name"), C("c_acctbal").alias("ACCT.Bal (USD)"))
    return text.normalize_columns(raw)


@query("p2_identity_keys", """
    SELECT id, CASE WHEN bin LIKE '%000000' THEN NULL ELSE bin END AS bin_key, replace(doitt_id, '.0', '') AS id_key FROM footprints""")
def _(t):
    return text.identity_keys(t.footprints).select("id", "bin_key", "id_key")


@query("p3_to_number", """
    SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN concat(CAST(value AS VARCHAR), ' m') ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number
    FROM events""")
def _(t):
    raw = F.when(C("event_id") % 3 == 0, F.concat(C("value").cast("string"), F.lit(" m"))).otherwise(C("event_id").cast("string"))
    return t.events.select("event_id", text.to_number(raw).alias("number"))


FRAME = lattice.Frame(bearing_rad=0.5, origin_x=120.0, origin_y=80.0, scale=4000.0, grid_step_mm=0.25)


@query("p4_frame", """
    SELECT point_id, x, y,
           round((x-120)*cos(0.5e0) - (y-80)*sin(0.5e0), 6) AS u, round((x-120)*sin(0.5e0) + (y-80)*cos(0.5e0), 6) AS v,
           x AS back_x, y AS back_y
    FROM points""")
def _(t):
    u, v = FRAME.to_frame(C("x"), C("y"))
    bx, by = FRAME.to_world(C("u"), C("v"))
    return t.points.select("point_id", "x", "y", u.alias("u"), v.alias("v")).select(
        "point_id", "x", "y", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"),
        F.round(bx, 6).alias("back_x"), F.round(by, 6).alias("back_y"),
    )


@query("p5_cell_of", """
    SELECT point_id, x, y, CAST(floor(x/8) AS BIGINT) AS cx, CAST(floor(y/8) AS BIGINT) AS cy,
           floor(x/8)*8 + 4 AS centre_x, floor(y/8)*8 + 4 AS centre_y FROM points""")
def _(t):
    return lattice.with_cells(t.points, CELL_FT).select(
        "point_id", "x", "y", "cx", "cy", lattice.cell_centre(C("cx"), CELL_FT).alias("centre_x"),
        lattice.cell_centre(C("cy"), CELL_FT).alias("centre_y"),
    )


ORACLE_LCC = """
    WITH c AS (SELECT c_custkey AS id, -74.2e0 + (c_custkey % 5000)/10000.0e0 AS lon, 40.5e0 + (c_custkey % 3700)/10000.0e0 AS lat FROM customer),
    k AS (SELECT sqrt(2/298.257222101e0 - (1/298.257222101e0)*(1/298.257222101e0)) AS e, radians(40 + 40/60.0e0) AS p1, radians(41 + 2/60.0e0) AS p2, radians(40 + 10/60.0e0) AS p0),
    m AS (SELECT *, cos(p1)/sqrt(1 - e*e*sin(p1)*sin(p1)) AS m1, cos(p2)/sqrt(1 - e*e*sin(p2)*sin(p2)) AS m2,
                 tan(pi()/4 - p1/2)/pow((1 - e*sin(p1))/(1 + e*sin(p1)), e/2) AS t1, tan(pi()/4 - p2/2)/pow((1 - e*sin(p2))/(1 + e*sin(p2)), e/2) AS t2,
                 tan(pi()/4 - p0/2)/pow((1 - e*sin(p0))/(1 + e*sin(p0)), e/2) AS t0 FROM k),
    n AS (SELECT *, (ln(m1) - ln(m2))/(ln(t1) - ln(t2)) AS n FROM m),
    g AS (SELECT *, 6378137.0e0*m1/(n*pow(t1, n)) AS f FROM n),
    r AS (SELECT id, f*pow(tan(pi()/4 - radians(lat)/2)/pow((1 - e*sin(radians(lat)))/(1 + e*sin(radians(lat))), e/2), n) AS rho, f*pow(t0, n) AS rho0,
                 n*radians(lon + 74) AS theta FROM c CROSS JOIN g)
    SELECT id, round((rho*sin(theta) + 300000)/0.3048006096012192e0, 3) AS x, round((rho0 - rho*cos(theta))/0.3048006096012192e0, 3) AS y FROM r"""


@query("p8_project_lcc", ORACLE_LCC)
def _(t):
    lon = F.lit(-74.2) + (C("c_custkey") % 5000) / F.lit(10000.0)
    lat = F.lit(40.5) + (C("c_custkey") % 3700) / F.lit(10000.0)
    x, y = lattice.project_lcc(lon, lat)
    return t.customer.select(C("c_custkey").alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _tags(t):
    return t.ways.select("way_id", "highway", tags.parse_tags(C("tags")).alias("tags"))


@query("p9_tag_predicates", """
    SELECT way_id, way_id % 8 IN (0, 2) AS recreation,
           CASE WHEN way_id % 8 = 0 THEN 'park' WHEN way_id % 8 = 1 THEN 'garden'
                WHEN way_id % 7 = 0 THEN 'grass' WHEN way_id % 7 = 1 THEN 'recreation_ground' END AS green,
           way_id % 6 = 0 AND way_id % 4 <> 0 AS parking FROM ways""")
def _(t):
    return _tags(t).select(
        "way_id", tags.recreation(C("tags")).alias("recreation"), tags.green_fallback(C("tags")).alias("green"),
        tags.surface_parking(C("tags")).alias("parking"),
    )


@query("p10_select_crossings", """
    SELECT way_id, CASE WHEN way_id % 9 = 0 THEN 'bridge' ELSE 'tunnel' END AS kind,
           CASE WHEN way_id % 4 = 0 THEN 'unnamed road crossing' ELSE concat('Street ', CAST(way_id % 40 AS VARCHAR)) END AS name
    FROM ways WHERE way_id % 9 = 0 OR way_id % 13 = 0""")
def _(t):
    kind = tags.crossing_kind(C("highway"), tags.tag(C("tags"), "bridge"), tags.tag(C("tags"), "tunnel"))
    name = F.coalesce(F.nullif(tags.tag(C("tags"), "name"), F.lit("")), F.lit("unnamed road crossing"))
    return _tags(t).select("way_id", kind.alias("kind"), name.alias("name")).where(C("kind").isNotNull())


@query("p13_display_name", """
    SELECT id, CASE WHEN id % 5 IN (0, 1, 2) THEN 'building' ELSE name END AS shown FROM footprints""")
def _(t):
    raw = F.when(C("id") % 5 == 0, F.lit("unset")).when(C("id") % 5 == 1, F.lit("  ")).when(C("id") % 5 == 2, F.lit(None)).otherwise(C("name"))
    return t.footprints.select("id", text.display_name(raw, "building").alias("shown"))


@query("f1_durations", """
    WITH d AS (SELECT event_id, CAST(event_id*37 % 200000 AS BIGINT) AS s FROM events)
    SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE CAST(s AS DOUBLE) END AS seconds,
           CASE WHEN event_id % 10 = 9 THEN NULL
                WHEN s >= 86400 THEN concat(s // 86400, 'd ', lpad(CAST(s // 3600 % 24 AS VARCHAR), 2, '0'), 'h ', lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0'), 'm')
                WHEN s >= 3600 THEN concat(s // 3600, 'h ', lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0'), 'm')
                ELSE concat(s // 60, 'm ', lpad(CAST(s % 60 AS VARCHAR), 2, '0'), 's') END AS long_form,
           CASE WHEN event_id % 10 = 9 THEN NULL
                WHEN s >= 3600 THEN concat(s // 3600, ':', lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0'))
                ELSE concat(s // 60, ':', lpad(CAST(s % 60 AS VARCHAR), 2, '0')) END AS clock
    FROM d""")
def _(t):
    s = C("event_id") * 37 % 200000
    parts = [F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60]
    written = F.concat_ws(" ", *[F.concat(p.cast("string"), F.lit(u)) for p, u in zip(parts, "dhms")])
    raw = F.when(C("event_id") % 10 == 9, "soon").otherwise(written)
    return t.events.select("event_id", text.parse_duration(raw).alias("seconds")).select(
        "event_id", "seconds", text.format_duration(C("seconds")).alias("long_form"), text.format_clock(C("seconds")).alias("clock"))


@query("f2_numeric_tag", """
    SELECT way_id, CASE way_id % 6 WHEN 0 THEN 9.0e0 WHEN 1 THEN round(30*0.3048e0, 6) END AS width_number FROM ways""")
def _(t):
    return _tags(t).select("way_id", F.round(tags.numeric_tag(tags.tag(C("tags"), "width")), 6).alias("width_number"))


@query("f3_tagged_width", """
    SELECT way_id, CASE WHEN way_id % 6 = 0 THEN 9.0e0 WHEN way_id % 6 = 1 THEN round(9.144e0, 6) WHEN way_id % 5 = 0 THEN 6.4e0 WHEN way_id % 5 = 1 THEN 12.8e0 END AS width_m,
           CASE WHEN way_id % 6 < 2 THEN 'width_tag' WHEN way_id % 5 < 2 THEN 'lane_count' END AS method FROM ways""")
def _(t):
    w = tags.tagged_width(C("tags"))
    return _tags(t).select("way_id", F.round(w["width_m"], 6).alias("width_m"), w["method"].alias("method"))


@query("f4_osm_height", """
    SELECT way_id, CASE way_id % 5 WHEN 0 THEN 12.5e0 WHEN 1 THEN round(40*0.3048006096012192e0, 6) END AS height_m FROM ways""")
def _(t):
    return _tags(t).select("way_id", F.round(tags.osm_height_m(tags.tag(C("tags"), "height")), 6).alias("height_m"))


@query("f5_printed_widths", """
    SELECT way_id, greatest(0.8e0, CASE WHEN way_id % 6 = 0 THEN 9.0e0 WHEN highway IN ('cycleway', 'pedestrian') THEN 3.0e0 ELSE 1.8e0 END*1000/4000.0e0) AS trail_mm,
           CASE WHEN highway IN ('motorway', 'primary') THEN 1.0e0 ELSE 0.875e0 END AS road_mm FROM ways""")
def _(t):
    return _tags(t).select(
        "way_id", tags.trail_width_mm(C("highway"), C("tags"), 0.8, 4000.0).alias("trail_mm"),
        tags.road_width_mm(C("highway").isin(tags.MAJOR)).alias("road_mm"))


GRADE_SQL = """concat(CASE WHEN way_id % 9 = 0 THEN 'bridge' WHEN way_id % 13 = 0 THEN 'tunnel' ELSE 'surface' END,
                      CASE way_id % 9 WHEN 0 THEN ':1' WHEN 1 THEN ':-1' ELSE ':0' END)"""


@query("f6_grade_key", f"""
    SELECT way_id, {GRADE_SQL} AS grade, {GRADE_SQL} = 'surface:0' AS at_grade FROM ways""")
def _(t):
    return _tags(t).select("way_id", tags.grade_key(C("tags")).alias("grade"), tags.is_surface(C("tags")).alias("at_grade"))


CLASS_SQL = """
    WITH w AS (SELECT way_id, highway, tags, (way_id*37 % 101)/100.0e0 AS support, way_id % 3 = 0 AS paved, way_id % 4 <> 0 AS named,
                      CASE WHEN way_id % 5 < 2 THEN 1 ELSE 0 END + CASE WHEN way_id % 3 = 0 THEN 1 ELSE 0 END AS evidence FROM ways),
    c AS (SELECT *, CASE
        WHEN highway IN ('footway', 'cycleway', 'steps') THEN 'trail'
        WHEN highway IN ('motorway', 'primary', 'residential', 'tertiary_link') THEN 'carriageway'
        WHEN highway = 'pedestrian' THEN CASE WHEN paved AND evidence >= 2 AND (named OR support >= 0.7) THEN 'carriageway' ELSE 'trail' END
        WHEN highway = 'service' THEN CASE WHEN way_id % 12 = 3 THEN 'other' WHEN evidence >= 1 AND (paved OR support >= 0.5) THEN 'carriageway'
                                           WHEN named AND support >= 0.7 THEN 'carriageway' ELSE 'other' END
        WHEN highway = 'road' AND support >= 0.7 THEN 'carriageway' ELSE 'other' END AS cls,
      CASE WHEN highway IN ('footway', 'cycleway', 'steps') THEN concat('by_class:', highway)
        WHEN highway IN ('motorway', 'primary', 'residential', 'tertiary_link') THEN concat('by_class:', highway)
        WHEN highway = 'pedestrian' THEN CASE WHEN paved AND evidence >= 2 AND (named OR support >= 0.7) THEN 'walk_tagged_as_road'
                                              ELSE 'walk' END
        WHEN highway = 'service' THEN CASE WHEN way_id % 12 = 3 THEN 'service_kind:alley' WHEN evidence >= 1 AND (paved OR support >= 0.5) THEN 'service_tagged'
                                           WHEN named AND support >= 0.7 THEN 'service_on_roadbed' ELSE 'service_unproven' END
        WHEN support >= 0.7 THEN 'road_on_roadbed' ELSE 'unknown:road' END AS reason FROM w)"""


def _classified(t):
    return (
        _tags(t).withColumn("support", C("way_id") * 37 % 101 / F.lit(100.0))
        .withColumn("verdict", tags.classify_highway(C("highway"), C("tags"), C("support")))
        .select("way_id", "highway", "tags", "verdict.cls", "verdict.reason")
    )


@query("f7_classify_highway", CLASS_SQL + "SELECT way_id, cls, reason FROM c")
def _(t):
    return _classified(t).select("way_id", "cls", "reason")


@query("f8_drawn_as", CLASS_SQL + """
    SELECT way_id, CASE WHEN cls <> 'other' AND way_id % 9 = 0 AND way_id % 50 / 10.0e0 >= 0.8 THEN 'deck'
                        WHEN cls = 'carriageway' AND NOT (way_id % 9 <> 0 AND way_id % 13 = 0) THEN 'ribbon' ELSE 'none' END AS drawn,
           CASE WHEN way_id % 2 = 0 THEN cls WHEN highway IN ('footway', 'cycleway', 'steps') THEN 'trail' ELSE 'other' END AS drawn_class FROM c""")
def _(t):
    known = F.when(C("way_id") % 2 == 0, C("cls"))
    return _classified(t).select(
        "way_id", tags.drawn_as(C("tags"), C("cls"), C("way_id") % 50 / F.lit(10.0), tags.minimum_crossing_mm()).alias("drawn"),
        tags.drawn_class(known, C("highway")).alias("drawn_class"))


@query("f9_normalized_name", """
    SELECT way_id, CASE WHEN way_id % 4 = 0 THEN '' ELSE concat('street ', CAST(way_id % 40 AS VARCHAR)) END AS route_name,
           CASE WHEN way_id % 4 = 0 THEN concat('osm:', CAST(way_id AS VARCHAR)) ELSE concat('street ', CAST(way_id % 40 AS VARCHAR)) END AS route_key FROM ways""")
def _(t):
    return _tags(t).select("way_id", tags.normalized_name(C("tags")).alias("route_name"), tags.route_key(C("tags"), C("way_id")).alias("route_key"))


@query("f10_layer_heights", """
    WITH s AS (SELECT p_partkey AS id, 0.08e0 + (p_size % 5)*0.04e0 AS layer, 0.2e0 + (p_size % 4)*0.2e0 AS nozzle, p_retailprice/100 AS v FROM part)
    SELECT id, round(ceil((v - 1e-9)/layer)*layer, 6) AS up, round(floor((v + 1e-9)/layer)*layer, 6) AS down,
           round(ceil((greatest(0.24e0, 2*layer) - 1e-9)/layer)*layer, 6) AS colour_mm, round(ceil((0.16e0 - 1e-9)/layer)*layer, 6) AS pad_mm,
           round(greatest(0.48e0, 2*layer, ceil((0.16e0 - 1e-9)/layer)*layer + layer), 6) AS line_mm,
           round(ceil((greatest(1.5e0*nozzle, 3*layer) - 1e-9)/layer)*layer, 6) AS roof_mm, round(greatest(0.5e0, 2*nozzle), 6) AS width_mm,
           round(round_even((v - 0.2e0)/layer, 0)*layer + 0.2e0, 6) AS snapped FROM s""")
def _(t):
    layer, nozzle, v = F.lit(0.08) + (C("p_size") % 5) * F.lit(0.04), F.lit(0.2) + (C("p_size") % 4) * F.lit(0.2), C("p_retailprice") / 100
    pad = levels.pad_relief(C("layer"))
    cols = {
        "up": levels.snap_up(C("v"), C("layer")), "down": levels.snap_down(C("v"), C("layer")), "colour_mm": levels.colour_depth(C("layer")),
        "pad_mm": pad, "line_mm": levels.line_relief(C("layer"), pad), "roof_mm": levels.structural_roof(C("nozzle"), C("layer")),
        "width_mm": levels.printable_width(F.lit(0.5), C("nozzle"), beads=2), "snapped": levels.snap_to_layers(C("v"), C("layer")),
    }
    base = t.part.select(C("p_partkey").alias("id"), layer.alias("layer"), nozzle.alias("nozzle"), v.alias("v"))
    return base.select("id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("f11_tunnel_profile", """
    WITH r AS (SELECT way_id, pos, (way_id*13 + pos*7) % 23 / 10.0e0 AS surface, (way_id*5 + pos*3) % 17 / 10.0e0 AS road, (way_id + pos) % 11 = 0 AS keep FROM vertices),
    g AS (SELECT way_id, count(*) AS n, max(surface - road) AS sep FROM r GROUP BY way_id HAVING count(*) >= 2),
    a AS (SELECT r.*, sep, sep >= 0.4 AS accepted,
                 CASE WHEN keep THEN 1.0e0 ELSE least(greatest(sin(pos/(n - 1.0e0)*pi())/sin(pi()*0.15e0), 0), 1) END AS weight FROM r JOIN g USING (way_id)),
    l AS (SELECT *, road - greatest(0, 0.6e0 + 0.8e0 - (surface - road))*weight AS low FROM a)
    SELECT way_id, pos, accepted, round(sep, 6) AS separation, round(CASE WHEN accepted THEN low ELSE road END, 6) AS printed_road,
           round(CASE WHEN accepted THEN greatest(least(surface - 0.6e0, low + 1.4e0), low + 0.8e0) ELSE road END, 6) AS ceiling FROM l""")
def _(t):
    rows = t.vertices.select(
        "way_id", "pos", ((C("way_id") * 13 + C("pos") * 7) % 23 / F.lit(10.0)).alias("surface_mm"),
        ((C("way_id") * 5 + C("pos") * 3) % 17 / F.lit(10.0)).alias("road_mm"), ((C("way_id") + C("pos")) % 11 == 0).alias("protected"))
    out = levels.tunnel_profile(rows, "way_id", cover=0.6, clearance=0.8, evidence=0.4)
    return out.select("way_id", "pos", "accepted", F.round("max_separation_mm", 6).alias("separation"),
                      F.round("printed_road_mm", 6).alias("printed_road"), F.round("ceiling_mm", 6).alias("ceiling"))


@query("f12_keys_and_labels", """
    SELECT id, printf('x%+06d_y%+06d', id - 700, id % 13 - 6) AS tile,
           CASE WHEN n < 26 THEN chr(CAST(65 + n AS INT)) WHEN n < 702 THEN concat(chr(CAST(64 + n // 26 AS INT)), chr(CAST(65 + n % 26 AS INT)))
                ELSE concat(chr(CAST(65 + (n - 702) // 676 AS INT)), chr(CAST(65 + (n - 702) // 26 % 26 AS INT)), chr(CAST(65 + (n - 702) % 26 AS INT))) END AS letters,
           concat('My_File_', name, '-', substr(sha1(concat('a/My File ', name, '.gml')), 1, 8)) AS slug
    FROM (SELECT *, id % 18278 AS n FROM footprints) f""")
def _(t):
    return t.footprints.select(
        "id", lattice.tile_key(C("id") - 700, C("id") % 13 - 6).alias("tile"), lattice.column_letters(C("id") % 18278).alias("letters"),
        text.slug_digest(F.concat(F.lit("a/My File "), C("name"), F.lit(".gml"))).alias("slug"))


@query("f13_parse_tags", """
    SELECT way_id, CASE WHEN way_id % 7 = 0 THEN 0 ELSE 15 END AS tags,
           CASE WHEN way_id % 7 = 0 THEN '' WHEN way_id % 8 = 0 THEN 'park|pitch' WHEN way_id % 8 = 1 THEN 'garden' WHEN way_id % 8 = 2 THEN 'track' ELSE '' END AS leisure
    FROM ways""")
def _(t):
    raw = F.when(C("way_id") % 7 == 0, "[1, 2]").otherwise(C("tags"))
    return t.ways.select("way_id", tags.parse_tags(raw).alias("m")).select(
        "way_id", F.size("m").cast("bigint").alias("tags"), F.array_join(tags.tag_values(C("m"), "leisure"), "|").alias("leisure"))


@query("f15_config_key", """
    SELECT s_suppkey AS id, substr(sha256(concat('{"grid":', CAST(s_suppkey % 4 AS VARCHAR), ',"name":"', s_name, '","scale":', CAST(s_suppkey AS VARCHAR), '}')), 1, 24) AS config
    FROM supplier""")
def _(t):
    return t.supplier.select(
        C("s_suppkey").alias("id"), text.config_key((C("s_suppkey") % 4).alias("grid"), C("s_name").alias("name"), C("s_suppkey").alias("scale")).alias("config"))


@query("f16_borough_for", """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Bronx' WHEN 1 THEN 'Brooklyn' WHEN 2 THEN 'Manhattan' WHEN 3 THEN 'Queens' WHEN 4 THEN 'Staten Island' END AS borough FROM events""")
def _(t):
    raw = F.element_at(F.array(*map(F.lit, ["The_BRONX.tif", "be Kings-17.tif", "New_York county", "hh_QN_2", "STATEN island", "yonkers"])), (C("event_id") % 6 + 1).cast("int"))
    return t.events.select("event_id", text.borough_for(F.concat(C("event_id").cast("string"), F.lit("_"), raw)).alias("borough"))
