"""Checks of finished work: meshes, shells, crossings, openings, stale stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import structural_roof
from ..runtime import cut
from .regions import connected_components

ZERO_AREA = 1e-12
OPENINGS = ["cut", "water bridge opening", "road/path overpass opening"]


def mesh_triangles(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners; a corner the part does not have is NULL."""
    out = triangles
    for corner in ("v1", "v2", "v3"):
        named = vertices.select("part_id", F.col("vertex_id").alias(corner), F.struct("x", "y", "z").alias(f"p_{corner}"))
        out = out.join(named, ["part_id", corner], "left")
    return out


def _det(a, b, c):
    return (
        a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) - a["y"] * (b["x"] * c["z"] - b["z"] * c["x"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"]))


def _double_area(a, b, c):
    ux, uy, uz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
    vx, vy, vz = c["x"] - a["x"], c["y"] - a["y"], c["z"] - a["z"]
    nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    return F.sqrt(nx * nx + ny * ny + nz * nz)


def mesh_audit(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per part: watertight with agreeing winding, zero-area triangles, signed volume, bounds, sound indices.

    Watertight means every directed edge has its reverse exactly once. Edges are counted per edge before they are
    counted per part, so a part of any size combines on the map side.
    """
    placed = mesh_triangles(triangles, vertices)
    a, b, c = F.col("p_v1"), F.col("p_v2"), F.col("p_v3")
    sound = a.isNotNull() & b.isNotNull() & c.isNotNull()
    measures = placed.groupBy("part_id").agg(
        F.count("*").alias("triangles"), F.count_if(~sound).alias("bad_indices"), F.count_if(_double_area(a, b, c) / 2 < ZERO_AREA).alias("zero_area"),
        (F.sum(_det(a, b, c)) / 6).alias("volume"), F.min(F.least(a["z"], b["z"], c["z"])).alias("min_z"), F.max(F.greatest(a["z"], b["z"], c["z"])).alias("max_z"))
    directed = triangles.select("part_id", F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])).alias("e"))
    sides = directed.groupBy("part_id", F.least("e.u", "e.v").alias("lo"), F.greatest("e.u", "e.v").alias("hi")).agg(
        F.count_if(F.col("e.u") < F.col("e.v")).alias("up"), F.count_if(F.col("e.u") > F.col("e.v")).alias("down"))
    edges = sides.groupBy("part_id").agg(F.count_if((F.col("up") != 1) | (F.col("down") != 1)).alias("bad_edges"))
    return measures.join(edges, "part_id").withColumn("watertight", F.col("bad_edges") == 0).withColumn(
        "accepted", (F.col("bad_edges") == 0) & (F.col("bad_indices") == 0) & (F.col("zero_area") == 0) & (F.col("volume") > 0))


def shell_classes(triangles: DataFrame, vertices: DataFrame, nozzle_mm: float, layer_mm: float) -> DataFrame:
    """Connected shells of each part with their volume and what they are: printable or crumb, chamber or film.

    Parts are joined over shared vertices in parallel, whatever their size.
    """
    ids = cut(vertices.select("part_id", "vertex_id", F.struct("part_id", "vertex_id").alias("node")), "nodes")
    ends = triangles
    for corner in ("v1", "v2", "v3"):
        ends = ends.join(ids.select("part_id", F.col("vertex_id").alias(corner), F.col("node").alias(f"n_{corner}")), ["part_id", corner])
    ends = cut(ends, "ends")
    links = ends.select(F.explode(F.array(F.struct(F.col("n_v1").alias("a"), F.col("n_v2").alias("b")), F.struct(F.col("n_v2").alias("a"), F.col("n_v3").alias("b")))).alias("e")).select("e.*")
    roots = connected_components(links.distinct())
    shelled = mesh_triangles(ends, vertices).join(roots.select(F.col("node").alias("n_v1"), F.col("root").alias("shell")), "n_v1")
    a, b, c = F.col("p_v1"), F.col("p_v2"), F.col("p_v3")
    whole = shelled.groupBy("part_id", "shell").agg(
        F.count("*").alias("triangles"), (F.sum(_det(a, b, c)) / 6).alias("volume"), (F.sum(_double_area(a, b, c)) / 2).alias("area"))
    thick = F.when(F.col("area") > 0, F.abs("volume") * 2 / F.col("area")).otherwise(float("inf"))
    kind = (
        F.when(F.col("volume") > nozzle_mm ** 2 * layer_mm, "printable").when(F.col("volume") > 0, "crumb")
        .when((F.col("volume") < 0) & (thick >= min(nozzle_mm, layer_mm)), "cavity").when(F.col("volume") < 0, "film").otherwise("empty"))
    return whole.select("part_id", "triangles", "volume", "area", kind.alias("kind"))


def crossing_audit(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Per checked segment: samples, those off road and trail, tan ones where a carriageway is due, and the verdict.

    ``samples`` have ``segment_id, material``; ``segments`` ``segment_id, expects_ivory``.
    """
    counted = samples.join(segments, "segment_id").groupBy("segment_id").agg(
        F.count("*").alias("samples"), F.count_if(~F.col("material").isin(0, 3)).alias("off_road"),
        F.count_if(F.col("expects_ivory") & (F.col("material") == 3)).alias("tan_on_carriageway"))
    return counted.withColumn("passed", (F.col("off_road") == 0) & (F.col("tan_on_carriageway") == 0))


def opening_audit(openings: DataFrame, nozzle_mm: float, layer_mm: float, span_nozzles: float = 3.0) -> DataFrame:
    """Openings with the first rule they break: span missing or unusable, roof missing or thin, span too long."""
    span, roof = F.col("roof_span_mm").try_cast("double"), F.col("roof_thickness_mm").try_cast("double")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    least = structural_roof(F.lit(nozzle_mm), F.lit(layer_mm))
    problem = (
        F.when(F.col("roof_span_mm").isNull(), "span missing").when(~(finite(span) & (span > 0)), "span invalid")
        .when(F.col("roof_thickness_mm").isNull(), "roof missing").when(~(finite(roof) & (roof + 1e-9 >= least)), "roof too thin")
        .when(span > nozzle_mm * span_nozzles + 1e-9, "span too long"))
    return openings.where(F.col("status").isin(OPENINGS)).withColumn("span_mm", F.when(finite(span), span)).withColumn("problem", problem)


def opening_report(audited: DataFrame) -> DataFrame:
    """One row: openings, offenders per rule, the longest span."""
    return audited.agg(
        F.count("*").alias("openings"), F.max("span_mm").alias("longest_span_mm"), F.count("problem").alias("offenders"),
        *[F.count_if(F.col("problem") == p).alias(p.replace(" ", "_")) for p in ("span missing", "span invalid", "roof missing", "roof too thin", "span too long")])


def stale_stages(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """Stages that must run again: the changed ones and all that read them, directly or through others.

    ``deps`` are ``job, stage, reads``; ``changed`` ``job, stage``. The frontier moves one reader further per round and
    every round is written, so the plan never grows; a cycle ends because known stages are not visited twice.
    """
    stale = cut(changed.select("job", "stage").distinct().withColumn("depth", F.lit(0)), "stale")
    frontier = stale
    depth = 0
    while True:
        depth += 1
        readers = deps.join(frontier.select("job", F.col("stage").alias("reads")), ["job", "reads"]).select("job", "stage").distinct()
        fresh = cut(readers.join(stale, ["job", "stage"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not fresh.limit(1).count():
            return stale
        stale, frontier = cut(stale.unionByName(fresh), "stale"), fresh
