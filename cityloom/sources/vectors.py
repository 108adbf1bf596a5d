"""Feature readers: text geometry in CSV, point lists, GeoJSON pages, building models in XML, street-map elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.lattice import project_lcc
from ..functions.text import clean_id, normalize_columns, to_number

# Shift between the published footprints and the survey grid, in feet.
FOOTPRINT_SHIFT = (0.4005, -3.0135)
# Tag keys that make a street-map element a feature.
AREA_KEYS = ["building", "building:part", "natural", "leisure", "landuse", "amenity", "man_made", "historic"]
LINE_KEYS = ["highway", "barrier", "railway"]
PROMOTED = [
    "highway", "building", "building:part", "natural", "leisure", "landuse", "amenity", "barrier", "man_made", "historic",
    "railway", "name", "width", "bridge", "tunnel", "layer", "surface", "sport", "area",
]


def _ring(points: Column) -> Column:
    """Ring without its closing point."""
    n = F.size(points)
    return F.when((n > 1) & (F.get(points, F.lit(0)) == F.get(points, n - 1)), F.slice(points, 1, n - 1)).otherwise(points)


def _turned(edges: Column, outer: Column) -> Column:
    """Edges running to the left for an outer ring and to the right for a hole."""
    right_way = (g.area(edges) >= 0) == outer
    back = F.transform(F.reverse(edges), lambda e: g.edge(e["x2"], e["y2"], e["x1"], e["y1"]))
    return F.when(right_way, edges).otherwise(back)


def with_wkt_edges(df: DataFrame, wkt_col: str, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``edges`` of a POLYGON or MULTIPOLYGON text; NULL for anything empty, unreadable or with fewer than three corners."""
    text = F.col(wkt_col)
    rings = F.regexp_extract_all(text, F.lit(r"(\({1,3}\s*[-0-9.][^()]*\))"), F.lit(1))

    def corner(pair: Column) -> Column:
        return F.struct((F.get(pair, F.lit(0)).try_cast("double") + shift[0]).alias("x"), (F.get(pair, F.lit(1)).try_cast("double") + shift[1]).alias("y"))

    def corners(ring: Column) -> Column:
        pairs = F.transform(F.split(F.regexp_replace(ring, "[()]", ""), ","), lambda p: F.split(F.trim(p), r"\s+"))
        return F.transform(pairs, corner)

    read = df.withColumn("_texts", rings).withColumn("_closed", F.transform("_texts", corners)).withColumn("_rings", F.transform("_closed", _ring))
    bad = F.exists("_rings", lambda r: (F.size(r) < 3) | F.exists(r, lambda p: p["x"].isNull() | p["y"].isNull()))
    outer = F.transform("_texts", lambda r: r.startswith("(("))
    edges = F.flatten(F.zip_with(F.transform("_rings", g.ring_edges), outer, _turned))
    sound = F.upper(F.trim(text)).rlike(r"^(MULTI)?POLYGON") & (F.size("_rings") > 0) & ~bad
    return read.withColumn("edges", F.when(sound, edges)).drop("_texts", "_closed", "_rings")


def with_box(df: DataFrame) -> DataFrame:
    box = g.bbox(F.col("edges"))
    return df.withColumn("_b", box).select("*", "_b.minx", "_b.miny", "_b.maxx", "_b.maxy").drop("_b")


def ingest_wkt_csv(spark: SparkSession, path: str, wkt_col: str, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """CSV with geometry text: every column as text, headers in snake_case, rows without a sound outline dropped."""
    rows = normalize_columns(spark.read.option("header", True).option("multiLine", False).csv(path))
    return with_box(with_wkt_edges(rows, wkt_col, shift).where(F.col("edges").isNotNull()).drop(wkt_col))


def ingest_lonlat_csv(spark: SparkSession, path: str, lon: str, lat: str) -> DataFrame:
    """CSV with longitude and latitude: rows without both dropped, the point in state-plane feet."""
    rows = normalize_columns(spark.read.option("header", True).csv(path))
    numbered = rows.withColumn("_lon", to_number(F.col(lon))).withColumn("_lat", to_number(F.col(lat))).where(F.col("_lon").isNotNull() & F.col("_lat").isNotNull())
    x, y = project_lcc(F.col("_lon"), F.col("_lat"))
    return numbered.withColumn("x", x).withColumn("y", y).drop("_lon", "_lat")


FEATURES = """features array<struct<properties: map<string,string>,
    geometry: struct<type: string, coordinates: string>>>"""


def features_of_pages(pages: DataFrame) -> DataFrame:
    """One row per feature of parsed GeoJSON pages; ``page_offset`` plus the place in the page is its source order."""
    rows = pages.select("page_offset", F.posexplode("features").alias("k", "f"))
    text, one = F.col("f.geometry.coordinates"), "array<array<array<double>>>"
    several = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(text, f"array<{one}>")).otherwise(F.array(F.from_json(text, one)))
    polygons = F.filter(several, lambda p: F.size(p) > 0)
    points = lambda ring: _ring(F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    props = F.col("f.properties")
    edges = F.flatten(F.transform(polygons, lambda p: F.flatten(F.transform(p, lambda ring, i: _turned(g.ring_edges(points(ring)), i == 0)))))
    parsed = rows.select(
        (F.col("page_offset") + F.col("k")).cast("bigint").alias("source_order"), clean_id(props["doitt_id"]).alias("doitt_id"), clean_id(props["bin"]).alias("bin"),
        to_number(props["height_roof"]).alias("height_roof"), F.when(F.size(polygons) > 0, edges).alias("edges"))
    return with_box(parsed.where(F.col("edges").isNotNull()))


def ingest_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON page files named by their offset (``page_000002000.json``)."""
    pages = spark.read.schema(FEATURES).option("multiLine", True).json(path).withColumn(
        "page_offset", F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)", 1).cast("bigint"))
    return features_of_pages(pages)


_POS = "struct<LinearRing: struct<posList: string>>"
_POLYGON = f"struct<exterior: {_POS}, interior: array<{_POS}>>"
_SURFACE = f"""struct<Polygon: array<{_POLYGON}>,
    lod2MultiSurface: struct<MultiSurface: struct<surfaceMember: array<struct<Polygon: {_POLYGON}>>>>>"""
_BUILDING = f"""_id string, stringAttribute array<struct<_name: string, value: string>>,
    boundedBy array<struct<GroundSurface: {_SURFACE}, RoofSurface: {_SURFACE}, WallSurface: {_SURFACE}>>"""


def _points3(text: Column) -> Column:
    """``x y z`` triples of a position list; NULL unless there are at least three and no rest."""
    values = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    n = F.size(values)
    triples = F.transform(F.sequence(F.lit(0), (n / 3).cast("int") - 1), lambda i: F.struct(
        F.get(values, i * 3).alias("x"), F.get(values, i * 3 + 1).alias("y"), F.get(values, i * 3 + 2).alias("z")))
    return F.when((n >= 9) & (n % 3 == 0), triples)


def ingest_citygml(spark: SparkSession, path: str, bounds: tuple[float, float, float, float], row_tag: str = "Building") -> tuple[DataFrame, DataFrame]:
    """Buildings and roof surfaces of building-model files near the bounds.

    Near is the closed box of the ground surfaces. A building needs a footprint; its roof levels are distinct heights
    to a tenth of a foot, its height range covers all surfaces. Roof rings keep their height.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).option("attributePrefix", "_").schema(_BUILDING).load(path)
    attribute = lambda name: F.get(F.filter("stringAttribute", lambda a: a["_name"] == name), F.lit(0))["value"]

    def polygons(kind: str) -> Column:
        surfaces = F.filter(F.transform("boundedBy", lambda b: b[kind]), lambda s: s.isNotNull())
        none = F.array().cast(f"array<{_POLYGON}>")
        members = lambda s: F.transform(s["lod2MultiSurface"]["MultiSurface"]["surfaceMember"], lambda m: m["Polygon"])
        flat = F.flatten(F.transform(surfaces, lambda s: F.concat(F.coalesce(s["Polygon"], none), F.coalesce(members(s), none))))
        outlines = F.transform(flat, lambda p: F.struct(
            _points3(p["exterior"]["LinearRing"]["posList"]).alias("outer"),
            F.filter(F.transform(F.coalesce(p["interior"], F.array().cast(f"array<{_POS}>")), lambda h: _points3(h["LinearRing"]["posList"])), lambda h: h.isNotNull()).alias("holes")))
        return F.filter(F.coalesce(outlines, F.array().cast("array<struct<outer:array<struct<x:double,y:double,z:double>>,holes:array<array<struct<x:double,y:double,z:double>>>>>")), lambda o: o["outer"].isNotNull())

    wide = raw.select(
        F.col("_id").alias("gml_id"), attribute("DOITT_ID").alias("doitt_id"), attribute("BIN").alias("bin"), polygons("GroundSurface").alias("ground"),
        polygons("RoofSurface").alias("roof"), polygons("WallSurface").alias("wall"),
        F.size(F.filter("boundedBy", lambda b: b["RoofSurface"].isNotNull())).alias("roof_count"))
    points = lambda c: F.flatten(F.transform(c, lambda o: o["outer"]))
    coords = lambda c, axis: F.transform(points(c), lambda p: p[axis])
    minx, miny, maxx, maxy = bounds
    near = wide.where(
        (F.size("ground") > 0) & (F.array_max(coords("ground", "x")) >= minx) & (F.array_min(coords("ground", "x")) <= maxx)
        & (F.array_max(coords("ground", "y")) >= miny) & (F.array_min(coords("ground", "y")) <= maxy))
    all_z = F.concat(coords("roof", "z"), coords("ground", "z"), coords("wall", "z"))
    rings = lambda o: F.concat(F.array(o["outer"]), o["holes"])
    flat = lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    flat_edges = lambda o: F.flatten(F.transform(F.transform(F.transform(F.transform(rings(o), flat), _ring), g.ring_edges), lambda r, i: _turned(r, i == 0)))
    buildings = near.select(
        "gml_id", "doitt_id", "bin", F.col("roof_count").cast("bigint").alias("roof_count"),
        F.size(F.array_distinct(F.transform(coords("roof", "z"), lambda z: F.round(z, 1)))).cast("bigint").alias("roof_levels"),
        F.array_min(all_z).alias("z_min_ft"), F.array_max(all_z).alias("z_max_ft"), F.flatten(F.transform("ground", flat_edges)).alias("edges"))
    roofs = near.select("gml_id", "doitt_id", "bin", F.posexplode("roof").alias("surface_order", "s")).select(
        "gml_id", "doitt_id", "bin", "surface_order", F.lit("roof").alias("kind"), F.array_min(F.transform("s.outer", lambda p: p["z"])).alias("z_min_ft"),
        F.array_max(F.transform("s.outer", lambda p: p["z"])).alias("z_max_ft"), _ring(F.col("s.outer")).alias("ring"), flat_edges(F.col("s")).alias("edges"))
    return with_box(buildings), with_box(roofs)


def assemble_osm_features(nodes: DataFrame, ways: DataFrame, bounds: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Street-map features: one row per feature, its vertices as rows, and the elements that could not be built.

    ``nodes`` have ``node_id, x, y, tags``; ``ways`` ``way_id, refs, tags`` with ``tags`` a map. A tagged node inside the
    bounds is a point; a way is a line when it has a line key (or is a tree row) and an area when it is closed and has
    an area key, so one way may give two features, told apart by ``source_order``. Vertices stay rows: a long way is
    never gathered into one.
    """
    minx, miny, maxx, maxy = bounds
    has = lambda keys: F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, keys)))
    promoted = [F.element_at("tags", k).alias(k.replace(":", "_")) for k in PROMOTED]
    points = nodes.where(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy) & (has(AREA_KEYS) | has(LINE_KEYS))).select(
        F.lit("node").alias("osm_type"), F.col("node_id").alias("osm_id"), F.lit("point").alias("kind"), (F.col("node_id") * 4).alias("source_order"), *promoted)
    as_line = has(LINE_KEYS) | (F.element_at("tags", "natural") == "tree_row")
    as_area = has(AREA_KEYS) & (F.size("refs") > 1) & (F.get("refs", F.lit(0)) == F.element_at("refs", -1))
    kinds = F.array_compact(F.array(F.when(as_line, "line"), F.when(as_area, "polygon")))
    drawn = ways.withColumn("kind", F.explode(kinds))
    placed = drawn.select("way_id", "kind", F.posexplode("refs").alias("pos", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id", "left")
    health = placed.groupBy("way_id", "kind").agg(
        F.count_if(F.col("x").isNull()).alias("lost"), F.countDistinct("node_id").alias("corners"),
        F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))
    broken = (F.col("lost") > 0) | (F.col("corners") < F.when(F.col("kind") == "polygon", 3).otherwise(2))
    errors = health.where(broken).select("way_id", "kind", F.when(F.col("lost") > 0, "node missing").otherwise("too few corners").alias("error"))
    sound = health.where(~broken & (F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy)).select("way_id", "kind")
    order = F.col("way_id") * 4 + F.when(F.col("kind") == "line", 1).otherwise(2)
    features = drawn.join(sound, ["way_id", "kind"], "left_semi").select(
        F.lit("way").alias("osm_type"), F.col("way_id").alias("osm_id"), "kind", order.alias("source_order"), *promoted).unionByName(points)
    vertices = placed.join(sound, ["way_id", "kind"], "left_semi").select(order.alias("source_order"), "pos", "x", "y")
    return features, vertices, errors


def error_examples(errors: DataFrame, most: int = 100) -> DataFrame:
    """The number of elements that failed and the first few of them, as the report shows them."""
    return errors.orderBy("way_id", "kind").limit(most)
