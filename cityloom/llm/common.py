"""What the text operators share: reading, slicing Arrow batches, hashing words, components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..runtime import Rounds

#: Text bytes that a task holds as Python objects at a time; a longer text is held alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def extended(docs: DataFrame, column: str, added: dict, make) -> DataFrame:
    """``docs`` with more columns, worked out from ``column`` slice by slice; columns of the new names are replaced.

    ``added`` gives the Spark and the Arrow type of each; ``make`` is called once a task and returns the function from a
    list of values to one list for each new column. Other columns pass through as they are, whatever their names.
    """
    kept = docs.select(F.col(f"`{column}`"), *[F.col(f"`{c}`") for c in docs.columns if c not in added])
    schema = StructType([*kept.schema.fields[1:], *[StructField(name, of) for name, (of, _) in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, 0):
            new = [pa.array(values, of) for values, (_, of) in zip(work(part.column(0).to_pylist()), added.values())]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=schema.names)

    return kept.mapInArrow(run, schema)


def packed(docs: DataFrame, *apart: str, **columns) -> DataFrame:
    """The columns of ``docs`` but ``apart`` in the one column ``row``, and ``columns`` beside it, whatever the names in ``docs``."""
    held = [F.col(f"`{c}`") for c in docs.columns if c not in apart] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*held).alias("row"), *[value.alias(name) for name, value in columns.items()])


def unpacked(rows: DataFrame, docs: DataFrame, **columns) -> DataFrame:
    """The columns that ``docs`` had, out of ``row``; ``columns`` replace those of the same names or follow after them."""
    old = [(columns[c] if c in columns else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*old, *[value.alias(c) for c, value in columns.items() if c not in docs.columns])


def whole_row(docs: DataFrame, *first: str) -> Column:
    """A 64-bit hash of a row: of the columns ``first`` and of all others, so that every attempt at a task gives it the same."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in first]
    return F.xxhash64(*[F.col(f"`{c}`") for c in first], *([F.to_json(F.struct(*rest))] if rest else []))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(links: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """``node, root`` for every end of a link ``a, b``: the smallest node that links reach.

    Every round a node takes the smallest label among its neighbours, combined on the map side, and then the label of
    its label, so chains shorten by halves. Each round is written to the shared folder; the driver sees one count a round.
    """
    rounds = Rounds(spark, name)
    once = rounds.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    ends = once.select(F.col("a").alias("node"), "a").union(once.select(F.col("b").alias("node"), "a"))
    labels = rounds.keep(ends.groupBy("node").agg(F.min("a").alias("root")), "labels")
    while True:
        down = once.join(labels, once.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("root").alias("offer"))
        up = once.join(labels, once.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        offered = down.unionByName(up).groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = labels.join(offered, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = hooked.join(above, "root", "left").select("node", "old", F.least("root", F.coalesce("higher", "root")).alias("root"))
        step = rounds.keep(jumped, "labels")
        labels = step.select("node", "root")
        rounds.drop("labels", 1)
        if step.where("old <> root").limit(1).count() == 0:
            return labels
