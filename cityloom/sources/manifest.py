"""Published dataset versions: data first, the list of its files next, the commit record last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def source_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row for a folder of sources: a digest over all names, sizes and times, the number of files, their bytes.

    Files are digested in 256 groups and the groups in order, so no task ever lists the whole folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    line = F.concat_ws("|", "path", "length", F.unix_micros("modificationTime").cast("string"))
    grouped = files.select(F.substring(F.sha1("path"), 1, 2).alias("g"), line.alias("line"), "length").groupBy("g").agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("digest"), F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return grouped.agg(
        F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("g", "digest"))), lambda r: r["digest"])), 256).alias("digest"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def _files_below(spark: SparkSession, path: str) -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.col("length").alias("bytes"))


def publish(df: DataFrame, path: str, config: str, sources: str, limited: bool = False, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new version below ``path`` and return the version.

    The commit record is written after the data and after the list of its files; a version without one does not exist.
    A run on limited sources is complete but not ``production_ready``.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex[:16]
    counted = Observation("rows")
    target = f"{path}/data/{version}"
    writer = df.observe(counted, F.count(F.lit(1)).alias("n")).write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    _files_below(spark, target).withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/files")
    record = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), F.lit("complete").alias("status"), F.lit(config).alias("config"),
        F.lit(sources).alias("sources"), F.lit(int(counted.get["n"])).cast("bigint").alias("rows"), F.lit(not limited).alias("production_ready"))
    record.write.mode("append").parquet(f"{path}/versions")
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/versions")


def current_version(spark: SparkSession, path: str, config: str, sources: str) -> str | None:
    """The newest complete version of this configuration and these sources whose files are all there unchanged."""
    try:
        found = versions(spark, path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise
    match = found.where((F.col("status") == "complete") & (F.col("config") == config) & (F.col("sources") == sources))
    newest = match.orderBy(F.col("published_at").desc()).limit(1).collect()
    if not newest:
        return None
    version = newest[0]["version"]
    expected = spark.read.parquet(f"{path}/files").where(F.col("version") == version)
    present = _files_below(spark, f"{path}/data/{version}")
    changed = expected.join(present, ["file", "bytes"], "left_anti").limit(1).count()
    return None if changed else version


def is_current(spark: SparkSession, path: str, config: str, sources: str) -> bool:
    return current_version(spark, path, config, sources) is not None


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data/{version}")
