"""Incremental ingestion: pages of features, point files, duplicates across batches, stage status, tile refresh."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.lattice import FT, cell_of
from ..operators.cells import GROUND_CLASS, UPPER_CLASSES


def _fold_into(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def check_config(spark: SparkSession, path: str, config: str) -> None:
    """Remember the configuration of a landing table; a run with another one is refused."""
    known = _fold_into(spark, f"{path}/config")
    if known is None:
        spark.range(1).select(F.lit(config).alias("config")).write.parquet(f"{path}/config")
        return
    if known.first()["config"] != config:
        raise ValueError("this landing table was started with another configuration")


def stream_pages(spark: SparkSession, source: str, schema: str, path: str, config: str, per_trigger: int = 64) -> None:
    """Load page files that have landed and stop; a restart goes on after the last finished batch.

    A batch is written to a folder of its own number, so a batch that runs twice replaces itself. ``schema`` needs
    ``page`` (0, 1, 2, …) and ``position``, which together order and identify the rows: a page that lands again, in the
    same batch or later, adds nothing. Files may come in any order; ``landed_pages`` reads what has no hole before it.
    """
    check_config(spark, path, config)
    place = ["page", "position"]

    def land(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(place)
        known = _fold_into(batch.sparkSession, f"{path}/rows")
        if known is not None:
            same_pages = known.where(F.col("batch") != number).select(*place).join(batch.select("page").distinct(), "page", "left_semi")
            fresh = fresh.join(same_pages, place, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all pages before the first one that has not landed; later pages wait until it has."""
    rows = spark.read.parquet(f"{path}/rows")
    pages = rows.select("page").distinct()
    wanted = pages.select((F.col("page") + 1).alias("page")).union(spark.range(1).select(F.col("id").alias("page")))
    first_hole = wanted.join(pages, "page", "left_anti").agg(F.min("page").alias("page"))
    return rows.where(F.col("page") < first_hole.scalar())


def stream_bin_points(spark: SparkSession, source: str, schema: str, path: str, size: float, per_trigger: int = 4) -> DataFrame:
    """Elevation cells kept current as point files land: sums, counts and maxima are streaming state.

    Every batch leaves the cells it changed under its own number; the newest row of a cell is its value.
    """
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(source)
    ground, upper = F.col("cls") == GROUND_CLASS, F.col("cls").isin(UPPER_CLASSES)
    z = F.col("z_ft") * FT
    cells = points.where(~F.col("withheld") & (ground | upper)).groupBy(
        cell_of(F.col("x"), size).alias("cx"), cell_of(F.col("y"), size).alias("cy")).agg(
        F.sum(F.when(ground, z)).alias("ground_sum"), F.count(F.when(ground, 1)).alias("ground_points"),
        F.max(F.when(upper, z)).alias("upper_m"), F.count(F.when(upper, 1)).alias("upper_points"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/cells/batch={number}")

    query = cells.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.parquet(f"{path}/cells")
    newest = changes.groupBy("cx", "cy").agg(F.max_by(F.struct("ground_sum", "ground_points", "upper_m", "upper_points"), "batch").alias("v"))
    mean = F.when(F.col("v.ground_points") > 0, F.col("v.ground_sum") / F.col("v.ground_points"))
    return newest.select("cx", "cy", mean.alias("ground_m"), "v.ground_points", "v.upper_m", "v.upper_points")


def stream_dedupe(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Rows repeated by overlapping pages dropped, across batches, for as long as the watermark remembers them."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


STATUS_OUT = "job string, stage string, status string, started timestamp, seconds double"
STATUS_KEPT = ["job", "stage", "status", "started", "seconds", "seen", "seen_id"]
STATUS_STATE = "job array<string>, stage array<string>, status array<string>, started array<bigint>, seconds array<double>, seen array<bigint>, seen_id array<bigint>"
NEVER = 2**63 - 1


def stream_stage_status(events: DataFrame, patience_minutes: int, lateness: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """Latest status of every stage of every job with its elapsed seconds; a running stage nobody ends is ``overdue``.

    Stages share ``buckets`` by a hash, so Python is called for a bucket and not for every stage; state is one small
    entry per stage. Events of a batch are taken in time order whatever batch brings them; one without a time is last.
    """
    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(dict(zip(STATUS_KEPT, state.get)) if state.exists else {c: [] for c in STATUS_KEPT}, dtype=object)
        fresh = [] if state.hasTimedOut else [rows for rows in batches if len(rows)]
        told, known = fold_status(known, pd.concat(fresh)) if fresh else (None, known)
        now = state.getCurrentWatermarkMs()
        due = [int(at) // 1000 + patience_minutes * 60_000 if status == "running" and at is not None and at != NEVER else NEVER
               for status, at in zip(known["status"], known["started"])]
        late = np.array([d <= now for d in due], dtype=bool)
        if told is not None:
            late &= ~known["_told"].to_numpy(dtype=bool)
        overdue = known[late].assign(status="overdue")
        known, waiting = known[~late], [d for d, gone in zip(due, late) if not gone and d != NEVER]
        if len(known):
            state.update(tuple(known[c].tolist() for c in STATUS_KEPT))
            if waiting:
                state.setTimeoutTimestamp(max(min(waiting), now + 1))
        elif state.exists:
            state.remove()
        out = overdue if told is None else pd.concat([told, overdue]) if len(overdue) else told
        started = pd.to_datetime([None if at is None or at == NEVER else at for at in out["started"]], unit="us", utc=True)
        yield pd.DataFrame({"job": out["job"].array, "stage": out["stage"].array, "status": out["status"].array, "started": started,
                            "seconds": out["seconds"].to_numpy(dtype=float, na_value=np.nan)}).astype({"seconds": "Float64"})

    # the time itself goes along as it carries the watermark
    marked = events.withWatermark("ts", lateness).select(
        "ts", "job", "stage", "status", "event_id", F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("at"),
        F.pmod(F.xxhash64("job", "stage"), F.lit(buckets)).alias("bucket"))
    return marked.groupBy("bucket").applyInPandasWithState(follow, STATUS_OUT, STATUS_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def fold_status(known: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The entries of the stages that ``rows`` name, and all entries with those renewed; ``_told`` marks them.

    A stage's last event counts as one of its rows. Rows that are not later than it are left out. The time a stage has
    run is that from its last start to the event after it.
    """
    n = len(known)
    events = pd.concat([known.rename(columns={"seen": "at", "seen_id": "event_id"}), rows], ignore_index=True)
    code = events.groupby(["job", "stage"], sort=False, dropna=False).ngroup().to_numpy()  # those known come first, as they stand
    at, event = events["at"].to_numpy(dtype=np.int64), events["event_id"].to_numpy(dtype=np.int64)
    before = code < n
    prior = np.where(before, code, 0)
    later = ~before | (at > at[prior]) | ((at == at[prior]) & (event > event[prior]))
    later[:n] = True
    order = np.flatnonzero(later)
    order = order[np.lexsort((event[order], at[order], code[order]))]
    code_in, running = code[order], (events["status"].to_numpy()[order] == "running")
    stages = int(code.max()) + 1
    last, start = np.zeros(stages, np.int64), np.full(stages, -1, np.int64)
    last[code_in] = np.arange(len(order))
    start[code_in[running]] = np.flatnonzero(running)
    newest = events.iloc[order[last]]
    ended = start < last
    after = np.where(ended, start + 1, 0)
    seconds = (at[order[after]] - at[order[start]]) / 1e6
    old = lambda name: known[name].tolist() + [None] * (stages - n)
    started = [int(at[order[s]]) if s >= 0 else o for s, o in zip(start, old("started"))]
    took = [o if s < 0 else float(v) if e else None for s, e, v, o in zip(start, ended, seconds, old("seconds"))]
    touched = np.zeros(stages, dtype=bool)
    touched[code[n:]] = True
    all_ = pd.DataFrame({
        "job": newest["job"].tolist(), "stage": newest["stage"].tolist(), "status": newest["status"].tolist(), "started": started, "seconds": took,
        "seen": at[order[last]].tolist(), "seen_id": event[order[last]].tolist(), "_told": touched}, dtype=object)
    return all_[touched], all_


def refresh_tiles(df: DataFrame, path: str, config: str) -> DataFrame:
    """Recompute a tiled table only where its sources changed and return the catalog of all published tiles.

    A tile's signature folds its rows' hashes and the configuration; tiles whose signature is on record are left alone.
    The changed tiles of a run go into a folder of its number, in ranges of tiles, and stand for theirs (``refreshed_rows``)
    once their signatures are recorded, which is last; a run that broke off is written over. There is no folder per
    tile, as those would be as many as the map is large. ``df`` has ``tile_x, tile_y``.
    """
    spark = df.sparkSession
    content = [c for c in df.columns if c not in ("tile_x", "tile_y")]
    signed = df.groupBy("tile_x", "tile_y").agg(
        F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.lit(config), F.count("*").cast("string"), F.sum(F.xxhash64(*content).cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(F.lit(7), *content)).cast("string")), 256).alias("signature"))
    known = _fold_into(spark, f"{path}/signatures")
    stale = signed if known is None else signed.join(latest_signatures(known), ["tile_x", "tile_y", "signature"], "left_anti")
    run = 0 if known is None else known.agg(F.max("run") + 1).first()[0]
    marked = stale.select("tile_x", "tile_y", "rows", "signature", F.lit(run).cast("bigint").alias("run"))
    marked.write.mode("overwrite").parquet(f"{path}/pending")
    pending = spark.read.parquet(f"{path}/pending")
    fresh = df.join(pending.select("tile_x", "tile_y"), ["tile_x", "tile_y"], "left_semi")
    ranged = fresh.repartitionByRange("tile_x", "tile_y").sortWithinPartitions("tile_x", "tile_y")
    ranged.write.mode("overwrite").parquet(f"{path}/rows/written={run}")
    pending.write.mode("append").parquet(f"{path}/signatures")
    return latest_signatures(spark.read.parquet(f"{path}/signatures"))


def refreshed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a refreshed table: those of each tile's latest run."""
    latest = latest_signatures(spark.read.parquet(f"{path}/signatures")).select("tile_x", "tile_y", F.col("run").alias("written"))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.join(latest.hint("merge"), ["tile_x", "tile_y", "written"]).select(*[c for c in rows.columns if c != "written"])


def latest_signatures(signatures: DataFrame) -> DataFrame:
    newest = signatures.groupBy("tile_x", "tile_y").agg(F.max_by(F.struct("rows", "signature", "run"), "run").alias("s"))
    return newest.select("tile_x", "tile_y", "s.rows", "s.signature", "s.run")
