"""Operators that depend on order: de-duplication, running values, intervals, ranks.

A key may hold a third of all rows, so nothing here sorts one whole key in one task: keys are cut into blocks of their
position first, each block is one window group, and what a block needs from earlier blocks comes from one row per
block. De-duplication and top-k combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import floor_div
from ..runtime import cut

BLOCK = 4096


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``. Keys the table does not have are ignored."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def top_k(df: DataFrame, group: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each group on the map side before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Zero-based position of each row in the whole order, without one task that holds all rows.

    The table is range-partitioned and written once; a row's rank is its rank in its range plus the rows in earlier
    ranges, of which there are only as many as partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "rank")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    ranked = ranged.join(F.broadcast(offsets), "_range")
    return ranked.withColumn(name, (inside + F.col("_before")).cast("bigint")).drop("_range", "_before")


def spatial_sort(df: DataFrame, position: str = "source_order", partitions: int | None = None) -> DataFrame:
    """Rows laid out by box centre x, then y, then their old position, in range partitions."""
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    keyed = df.withColumn("centre_x", cx).withColumn("centre_y", cy)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(n, "centre_x", "centre_y", position).sortWithinPartitions("centre_x", "centre_y", position)


def reading_order(df: DataFrame, x: str = "x", y: str = "y", tie: str = "id") -> DataFrame:
    """Rank from the top row down, each row left to right."""
    return global_rank(df, [F.col(y).desc(), F.col(x), F.col(tie)], "reading_rank")


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("_block", floor_div(F.col(pos), block))


def running_sum(df: DataFrame, key: str, pos: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum along ``pos`` within ``key``."""
    rows = _blocked(df.withColumn("_value", value), pos, block)
    totals = rows.groupBy(key, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_inside", F.sum("_value").over(within)).join(offsets, [key, "_block"])
    return out.withColumn(name, F.col("_inside") + F.col("_before")).drop("_block", "_value", "_inside", "_before")


def carry_forward(df: DataFrame, key: str, pos: str, cols: list[str], block: int = BLOCK) -> DataFrame:
    """Each column filled with its last known value at or before the row, in ``pos`` order within ``key``."""
    rows = _blocked(df, pos, block)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_last_{c}") for c in cols]
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, "_block").agg(*last).select(
        key, "_block", *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in cols])
    within = Window.partitionBy(key, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select("*", *[F.last(c, ignorenulls=True).over(within).alias(f"_own_{c}") for c in cols])
    out = filled.join(carried, [key, "_block"])
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_own_{c}", f"_in_{c}"))
    return out.select(*df.columns)


def next_row(df: DataFrame, keys: list[str], order: str, block: Column, cols: list[str], prefix: str = "next_") -> DataFrame:
    """The named columns of the following row of the same key; ``block`` must not decrease along ``order``."""
    rows = df.withColumn("_block", block)
    want = F.struct(*cols)
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    first = rows.groupBy(*keys, "_block").agg(F.min_by(want, order).alias("_first"))
    following = first.select(*keys, "_block", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block")).alias("_across"))
    out = rows.withColumn("_inside", F.lead(want).over(within)).join(following, [*keys, "_block"])
    found = F.coalesce("_inside", "_across")
    return out.select(*df.columns, *[found[c].alias(prefix + c) for c in cols])


def segments(lines: DataFrame, line: str = "way_id", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Consecutive vertex pairs with their direction, length, and the length before them along the line.

    ``pos`` counts 0, 1, 2, … along a line. The first vertex of a block is copied into the block before it, so every
    pair meets in one window group of at most ``block + 1`` rows.
    """
    home = floor_div(F.col(pos), block)
    copied = F.when((F.col(pos) % block == 0) & (F.col(pos) > 0), F.array(home - 1, home)).otherwise(F.array(home))
    w = Window.partitionBy(line, "_block").orderBy(pos)
    pairs = lines.select(line, pos, "x", "y", F.explode(copied).alias("_block")).select(
        line, pos, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"),
    ).where(F.col("x2").isNotNull())
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    measured = pairs.withColumn("dx", dx).withColumn("dy", dy).withColumn("length", F.hypot(dx, dy))
    summed = running_sum(measured, line, pos, F.col("length"), "_end", block)
    return summed.withColumn("start_length", F.col("_end") - F.col("length")).drop("_end")


def _islands(spans: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    numbered = spans.withColumn("_open", opened).withColumn(
        "_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("_n")).drop("_island")


def merge_spans(spans: DataFrame, route: str, start: str, end: str, width: float) -> DataFrame:
    """Touching or overlapping intervals of a route joined into one, with how many made it.

    First within buckets of the start, ``width`` long, then across the few intervals each bucket leaves.
    """
    rows = spans.select(route, start, end, F.lit(1).cast("bigint").alias("_n"), F.floor(F.col(start) / width).alias("_bucket"))
    local = _islands(rows, [route, "_bucket"], start, end).drop("_bucket")
    return _islands(local, [route], start, end).withColumnRenamed("_n", "spans")


def printable_runs(samples: DataFrame, seam: str = "seam_id", pos: str = "pos", left: str = "left", right: str = "right") -> DataFrame:
    """Longest stretches of consecutive samples that have a different plate on each side; ``pos`` counts by one."""
    apart = samples.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    pair = apart.withColumn("_pair", F.concat_ws("|", left, right))
    before = pair.select(seam, (F.col(pos) + 1).alias(pos), F.col("_pair").alias("_pair_before"))
    flagged = pair.join(before, [seam, pos], "left")
    starts = F.when(F.col("_pair_before").isNull() | (F.col("_pair_before") != F.col("_pair")), 1).otherwise(0)
    runs = running_sum(flagged, seam, pos, starts, "run")
    return runs.groupBy(seam, "run").agg(
        F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("samples"),
        F.first(left).alias(left), F.first(right).alias(right))


def stage_durations(events: DataFrame, keys: list[str], time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each start of a stage with the end that follows it directly, and the seconds between them."""
    moment = events.withColumn("_at", F.struct(time, tie))
    paired = next_row(moment, keys, "_at", F.date_trunc("hour", F.col(time).cast("timestamp")), ["status", time, tie])
    ended = (F.col("status") == "running") & F.col("next_status").isin("completed", "failed")
    seconds = (F.unix_micros(F.col(f"next_{time}").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / F.lit(1e6)
    return paired.where(ended).select(*keys, F.col(tie).alias("start_event"), F.col("next_status").alias("result"), seconds.alias("seconds"))


def live_sources(uses: DataFrame, task_order: str = "task_rank", source: str = "source_id", block: int = BLOCK) -> DataFrame:
    """How many sources are open at each task when every source stays open from its first to its last use."""
    span = uses.groupBy(source).agg(F.min(task_order).alias("_first"), F.max(task_order).alias("_last"))
    steps = span.select(F.explode(F.array(
        F.struct(F.col("_first").alias(task_order), F.lit(1).alias("_step")),
        F.struct((F.col("_last") + 1).alias(task_order), F.lit(-1).alias("_step")))).alias("s")).select("s.*")
    tasks = uses.select(task_order, F.lit(0).alias("_step"))
    per_task = steps.union(tasks.select(task_order, "_step")).groupBy(task_order).agg(F.sum("_step").alias("_step"))
    open_now = running_sum(per_task.withColumn("_all", F.lit(0)), "_all", task_order, F.col("_step"), "open_sources", block)
    return open_now.join(tasks.select(task_order).distinct(), task_order, "left_semi").select(task_order, "open_sources")
