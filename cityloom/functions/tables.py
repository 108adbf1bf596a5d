"""Functions for SQL: cells of a polygon and points along a line as table functions called with LATERAL, and the rows of
cells of many polygons at a time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf


class CellsOfPolygon:
    """Cells whose centre lies inside a polygon given as an array of edges."""

    def eval(self, edges: list, size: float):
        if not edges:
            return
        low, high = (f(f(e["y1"], e["y2"]) for e in edges) for f in (min, max))
        for cy in range(math.ceil(low / size - 0.5), math.ceil(high / size - 0.5)):
            y = (cy + 0.5) * size
            marks = sorted(
                math.ceil((e["x1"] + (e["x2"] - e["x1"]) * ((y - e["y1"]) / (e["y2"] - e["y1"]))) / size - 0.5)
                for e in edges if (e["y1"] > y) != (e["y2"] > y))
            for start, stop in zip(marks[::2], marks[1::2]):
                for cx in range(start, stop):
                    yield cx, cy


class Densify:
    """Points from the start of a segment to before its end, at most ``step`` apart."""

    def eval(self, x1: float, y1: float, x2: float, y2: float, step: float):
        n = max(1, math.ceil(math.hypot(x2 - x1, y2 - y1) / step))
        for k in range(n):
            yield k, x1 + (x2 - x1) * (k / n), y1 + (y2 - y1) * (k / n)


RUNS = "array<struct<cy: bigint, low: bigint, high: bigint>>"


def cell_runs(edges: pa.Array, size: pa.Array) -> pa.Array:
    """The cells ``low`` to ``high`` of each row ``cy`` whose centres lie inside each polygon, a batch of polygons at once."""
    kind = pa.list_(pa.struct([("cy", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
    corners = edges.flatten()
    x1, y1, x2, y2 = (corners.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x1", "y1", "x2", "y2"))
    if not np.isfinite([x1, y1, x2, y2]).all():
        raise ValueError("an outline lacks a coordinate")
    counts = edges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(edges)), counts)
    step = size.to_numpy(zero_copy_only=False).astype(float)[owner]
    # a row meets an edge when its centre is at or above the lower end and below the upper
    first = np.floor(np.minimum(y1, y2) / step - 0.5).astype(np.int64) - 1
    last = np.ceil(np.maximum(y1, y2) / step - 0.5).astype(np.int64) + 1
    rows = last - first + 1
    e = np.repeat(np.arange(len(owner)), rows)
    cy = np.arange(len(e)) - np.repeat(np.cumsum(rows) - rows, rows) + first[e]
    y = (cy + 0.5) * step[e]
    meets = (y1[e] > y) != (y2[e] > y)
    e, cy, y = e[meets], cy[meets], y[meets]
    mark = np.ceil((x1[e] + (x2[e] - x1[e]) * ((y - y1[e]) / (y2[e] - y1[e]))) / step[e] - 0.5).astype(np.int64)
    order = np.lexsort((mark, cy, owner[e]))
    who, cy, mark = owner[e][order], cy[order], mark[order]
    begins = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (cy[1:] != cy[:-1])][:len(who)])
    place = np.arange(len(who)) - np.repeat(begins, np.diff(np.r_[begins, len(who)]))
    opens = np.flatnonzero((place[:-1] % 2 == 0) & (place[1:] == place[:-1] + 1))  # the odd mark of an outline left open is dropped
    who, cy, low, high = who[opens], cy[opens], mark[opens], mark[opens + 1] - 1
    some = low <= high
    who, cy, low, high = who[some], cy[some], low[some], high[some]
    ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(edges)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(cy), pa.array(low), pa.array(high)], ["cy", "low", "high"])).cast(kind)


def register(spark: SparkSession) -> None:
    """Make ``cells_of_polygon(edges, size)``, ``densify(x1, y1, x2, y2, step)`` and ``cell_runs(edges, size)`` known to SQL.

    Spark calls a table function once for every row; for large tables ``cell_runs`` takes a batch of rows in one call.
    """
    def runs(edges: pa.Array, size: pa.Array) -> pa.Array:
        return cell_runs(edges, size)

    runs.__annotations__ = {"edges": pa.Array, "size": pa.Array, "return": pa.Array}
    spark.udf.register("cell_runs", arrow_udf(runs, RUNS))
    spark.udtf.register("cells_of_polygon", udtf(CellsOfPolygon, returnType="cx bigint, cy bigint", useArrow=True))
    spark.udtf.register("densify", udtf(Densify, returnType="k int, x double, y double", useArrow=True))
