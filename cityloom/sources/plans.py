"""Files a plan leaves behind: outlines, frames, the chunk table, one command per chunk."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_rank


def plan_records(chunks: DataFrame, plan_id: str, command: list[str]) -> DataFrame:
    """Chunks in reading order with their outline and frame as JSON and their command line.

    ``chunks`` have ``label, minx, miny, maxx, maxy, edges`` (outer ring first) and ``width_mm, height_mm``.
    """
    ring = F.transform("edges", lambda e: F.array(e["x1"], e["y1"]))
    outline = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("label").alias("label")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(ring, F.slice(ring, 1, 1))).alias("coordinates")).alias("geometry")))
    frame = F.to_json(F.struct(F.array("minx", "miny").alias("origin_ft"), F.array("width_mm", "height_mm").alias("size_mm")))
    stem = F.concat(F.lit(plan_id + "_"), F.col("label"))
    words = " ".join(shlex.quote(w) for w in command)
    ranked = global_rank(chunks, [F.col("maxy").desc(), F.col("minx"), F.col("label")], "place")
    return ranked.select(
        "place", "label", "width_mm", "height_mm", outline.alias("outline"), frame.alias("frame"),
        F.concat(F.lit(words + " --polygon chunks/"), stem, F.lit(".geojson --print-frame chunks/"), stem, F.lit(".frame.json --output "), stem, F.lit(".3mf")).alias("command"))


def write_plan(records: DataFrame, path: str) -> None:
    """The plan's tables: chunks as JSON, outlines and frames as text per label, commands in reading order."""
    records.select("place", "label", "width_mm", "height_mm").write.mode("overwrite").json(f"{path}/chunks")
    records.select("label", "outline").write.mode("overwrite").json(f"{path}/outlines")
    records.select("label", "frame").write.mode("overwrite").json(f"{path}/frames")
    records.orderBy("place").select("command").write.mode("overwrite").text(f"{path}/commands")
