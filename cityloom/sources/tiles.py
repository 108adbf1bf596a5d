"""Tiled feature tables: a feature is stored in every tile its box touches and comes back once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import cell_of, tile_key
from ..operators.ordered import dedupe_first
from ..operators.spatial import clip_bbox

SPAN_FT = 10000.0


def assign_tiles(df: DataFrame, span: float) -> DataFrame:
    """One row per tile from ``floor(min / span)`` to ``floor(max / span)`` on both axes; rows without a box are out."""
    def tiles(lo: str, hi: str):
        return F.explode(F.sequence(cell_of(F.col(lo), span), cell_of(F.col(hi), span)))

    boxed = df.where(F.col("minx").isNotNull() & F.col("miny").isNotNull() & F.col("maxx").isNotNull() & F.col("maxy").isNotNull())
    return boxed.withColumn("tile_x", tiles("minx", "maxx")).withColumn("tile_y", tiles("miny", "maxy"))


def tile_rows(df: DataFrame, span: float, dedupe_by: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of each tile, the first by source order where a key repeats inside a tile."""
    return dedupe_first(assign_tiles(df, span), ["tile_x", "tile_y", *[k for k in dedupe_by if k in df.columns]], order or ["source_order"])


def write_tiles(df: DataFrame, path: str, span: float = SPAN_FT, dedupe_by: list[str] | None = None, files: int | None = None) -> None:
    """Write a tiled table in order of tile and of box centre inside it.

    Ranges over tile and centre decide the files, so a crowded tile becomes several files instead of one slow task, and
    every file covers few tiles and a small box for its statistics to prune by. Tiles have no folders of their own:
    those would be as many as the map is large, and each a file to create and to list.
    """
    rows = tile_rows(df, span, dedupe_by or ["source_order"])
    keyed = rows.withColumn("_cx", (F.col("minx") + F.col("maxx")) / 2).withColumn("_cy", (F.col("miny") + F.col("maxy")) / 2)
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tile_x", "tile_y", "_cx", "_cy", "source_order"]
    keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_cx", "_cy").write.mode("overwrite").parquet(path)


def read_tiles(
    spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, span: float = SPAN_FT,
    dedupe_by: list[str] | None = None, order: list[str] | None = None,
) -> DataFrame:
    """Features of a tiled table that touch the bounds, each once: tiles pruned, then boxes, then duplicates."""
    df = spark.read.parquet(path)
    if bounds is not None:
        minx, miny, maxx, maxy = bounds
        low = lambda v: int(v // span)
        df = clip_bbox(df.where(
            F.col("tile_x").between(low(minx), low(maxx)) & F.col("tile_y").between(low(miny), low(maxy))), bounds)
    return dedupe_first(df.drop("tile_x", "tile_y"), dedupe_by or ["source_order"], order or ["source_order"])


def tile_catalog(spark: SparkSession, path: str, span: float = SPAN_FT) -> DataFrame:
    """Rows, bytes and bounds per stored tile; the rows are counted per file first."""
    df = spark.read.parquet(path)
    files = df.groupBy("tile_x", "tile_y", F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    tiles = files.groupBy("tile_x", "tile_y").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
    x, y = F.col("tile_x").cast("bigint"), F.col("tile_y").cast("bigint")
    return tiles.select(
        tile_key(x, y).alias("tile"), "rows", "bytes", "files", (x * F.lit(span)).alias("minx"), (y * F.lit(span)).alias("miny"),
        ((x + 1) * F.lit(span)).alias("maxx"), ((y + 1) * F.lit(span)).alias("maxy"))


def cells_to_blocks(cells: DataFrame, value: str, tile: int) -> DataFrame:
    """Dense blocks of ``tile`` by ``tile`` values per tile, row by row; a missing cell is NULL.

    Cells are unique, so a block's rows are bounded by its size.
    """
    x, y = cell_of(F.col("cx"), tile), cell_of(F.col("cy"), tile)
    place = F.pmod(F.col("cy"), F.lit(tile)) * tile + F.pmod(F.col("cx"), F.lit(tile))
    packed = cells.where(F.col(value).isNotNull()).select(x.alias("tile_x"), y.alias("tile_y"), F.struct(place.alias("k"), F.col(value).alias("v")).alias("p"))
    listed = packed.groupBy("tile_x", "tile_y").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    last = F.size("_p") - 1

    def stretch(p, i):
        """NULLs between the cell before and this one, then this one."""
        before = F.when(i > 0, F.get("_p", i - 1)["k"]).otherwise(F.lit(-1))
        gap = (p["k"] - before - 1).cast("int")
        return F.concat(F.array_repeat(F.lit(None).cast(dict(cells.dtypes)[value]), gap), F.array(p["v"]))

    tail = (F.lit(tile * tile - 1) - F.get("_p", last)["k"]).cast("int")
    values = F.concat(F.flatten(F.transform("_p", stretch)), F.array_repeat(F.lit(None).cast(dict(cells.dtypes)[value]), tail))
    return listed.select("tile_x", "tile_y", values.alias("block"))


def blocks_to_cells(blocks: DataFrame, value: str, tile: int) -> DataFrame:
    exploded = blocks.select("tile_x", "tile_y", F.posexplode("block").alias("k", value)).where(F.col(value).isNotNull())
    return exploded.select(
        (F.col("tile_x") * tile + F.col("k") % tile).alias("cx"), (F.col("tile_y") * tile + F.floor(F.col("k") / tile)).alias("cy"), value)
