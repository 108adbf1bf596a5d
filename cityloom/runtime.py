"""Session settings, lineage cuts and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "cityloom", **conf) -> SparkSession:
    """A local session for tests and the bench. On a cluster use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the session has it, else one below its warehouse."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cityloom-scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/cityloom-{name}-{uuid.uuid4().hex[:12]}"


def _write(df: DataFrame, path: str) -> None:
    """Write ``df`` and delete the shuffle files this took: once the table is there nothing reads them."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        conf.unset(CLEANUP_CONF) if before is None else conf.set(CLEANUP_CONF, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so loops never grow lineage.

    The written table survives lost executors, and its file sizes give later joins true statistics.
    """
    path = scratch_path(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of earlier rounds, in whatever file system holds them."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Rounds:
    """Tables of a loop: each is written to the shared folder and read back; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.live, self.made = spark, scratch_path(spark, name), {}, 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the newest table of this name. The one before stays until ``drop``, as plans may still read it."""
        self.made += 1
        path = f"{self.base}/{name}-{self.made}"
        _write(df, path)
        self.live.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, newest: int = 1) -> None:
        """Delete all but the ``newest`` tables of this name."""
        paths = self.live.get(name, [])
        gone = paths[: len(paths) - newest]
        discard(self.spark, *gone)
        self.live[name] = paths[len(gone):]
