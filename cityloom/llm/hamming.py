"""Exact top-k search over binary codes by incremental multi-index hashing.

Every different 64-bit code lies in one block, and a block is cut into segments that are each indexed by their value. Step
by step the open queries look up segment values that differ in one bit more from their own, one segment after the other.
A code not met yet has more differing bits in each segment than the radius reached there, hence at least the sum of those
radii plus one each: once the k-th verified distance is smaller, nothing better can come and the query is closed in that
block. The last possible step has met every code.

A query first searches the block that its own code falls into. The k-th distance found there bounds how far the radii must
grow in all other blocks, which the second pass searches. Blocks and runs of queries both have a greatest size, and a task
holds one of each, so memory does not grow with the tables; what the blocks found meets in one map-side limited window.

Copies of a code are indexed once, with the k smallest ids among them, which is all that any answer can need, ties going
to the smaller id. Equal queries are searched once.

Null vectors have no code: they are neither found nor searched, and rows without an id are not found. Rows that repeat are
candidates each. Fewer than k rows in all give as many results. A query finds itself too. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Rounds
from .common import shuffle_partitions

WIDTH = 64
SEGMENTS = 4
TOP = 10
#: Different codes in a block: enough blocks for all tasks, within these sizes.
BLOCK_LEAST, BLOCK_MOST = 1 << 14, 1 << 18
#: Different queries that a task holds.
RUN = 1 << 16
#: Candidates that a task verifies at a time; one query meets each code of a block at most once per segment.
AT_ONCE = 1 << 20


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 values as bits, the first value the lowest; missing values count as negative."""
    bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint") for i in range(WIDTH)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return F.when(vector.isNotNull(), total)


class SegmentIndex:
    """The codes of one block by the value of each segment."""

    def __init__(self, codes: np.ndarray, copies: np.ndarray, segments: int):
        self.codes, self.copies, self.width = codes, copies, WIDTH // segments
        self.values = np.arange(1 << self.width, dtype=np.int64)
        self.weight = np.bitwise_count(self.values)
        self.order, self.starts = [], []
        for i in range(segments):
            own = self.part(codes, i)
            order = np.argsort(own, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(own[order], np.arange((1 << self.width) + 1)))

    def part(self, codes: np.ndarray, i: int) -> np.ndarray:
        return ((codes >> np.uint64(i * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def met(self, queries: np.ndarray, i: int, flips: np.ndarray):
        """Runs of ``(query number, code number)`` whose segment ``i`` differs by one of ``flips``."""
        step = max(1, AT_ONCE // len(flips))
        for a in range(0, len(queries), step):
            values = self.part(queries[a:a + step], i)[:, None] ^ flips
            first, sizes = self.starts[i][values], self.starts[i][values + 1] - self.starts[i][values]
            run = np.cumsum(sizes.sum(axis=1)) // AT_ONCE
            for r in np.unique(run):
                mine = run == r
                n, at = sizes[mine].ravel(), first[mine].ravel()
                ends = np.cumsum(n)
                place = np.arange(ends[-1]) + np.repeat(at - (ends - n), n)
                yield a + np.repeat(np.flatnonzero(mine), sizes[mine].sum(axis=1)), self.order[i][place]

    def search(self, queries: np.ndarray, bound: np.ndarray, k: int):
        """``(query number, code number, distance)`` of all codes up to each query's k-th distance here, or its bound."""
        segments = len(self.order)
        reach, worst, seen = [-1] * segments, bound.astype(np.int64), np.zeros((len(queries), WIDTH + 1), dtype=np.int64)
        found, open_ = [], np.arange(len(queries))
        for radius in range(self.width + 1):
            flips = self.values[self.weight == radius]
            for i in range(segments):
                open_ = open_[worst[open_] >= sum(r + 1 for r in reach)]  # a code not met yet differs in at least so many bits
                if not len(open_):
                    break
                for who, code in self.met(queries[open_], i, flips):
                    who = open_[who]
                    differ = queries[who] ^ self.codes[code]
                    distance = np.bitwise_count(differ).astype(np.int64)
                    fresh = distance <= worst[who]
                    for j in range(segments):  # count a pair only where it is met first
                        if j != i:
                            apart = np.bitwise_count(self.part(differ, j))
                            fresh &= apart >= radius + (j < i)
                    who, code, distance = who[fresh], code[fresh], distance[fresh]
                    np.add.at(seen, (who, distance), self.copies[code])
                    found.append((who, code, distance))
                reach[i] = radius
                enough = np.cumsum(seen[open_], axis=1) >= k
                worst[open_] = np.minimum(worst[open_], np.where(enough[:, -1], enough.argmax(axis=1), WIDTH))
                found = [tuple(a[d <= worst[w]] for a in (w, c, d)) for w, c, d in found] if len(found) > 64 else found
        none = np.zeros(0, dtype=np.int64)
        who, code, distance = (np.concatenate([none, *column]) for column in (zip(*found) if found else ((), (), ())))
        near = distance <= worst[who]
        return who[near], code[near], distance[near]


def search(rows: DataFrame, queries: DataFrame, k: int = TOP, segments: int = SEGMENTS, block: int | None = None, run: int = RUN) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the ``k`` rows nearest to each query. Both tables have ``id, code``."""
    spark = rows.sparkSession
    rounds, parts = Rounds(spark, "hamming"), shuffle_partitions(spark)
    known = rows.where("code IS NOT NULL AND id IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = rounds.keep(known.withColumn("n", nth).where(F.col("n") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = rounds.keep(queries.where("code IS NOT NULL").select("id", "code"), "queries")
    wanted = rounds.keep(asked.select(F.col("code").alias("query")).distinct(), "wanted")
    n_codes, n_queries = codes.count(), wanted.count()
    size = block or min(max(-(-n_codes // (2 * parts)), BLOCK_LEAST), BLOCK_MOST)
    blocks, runs = max(1, -(-n_codes // size)), max(1, -(-n_queries // run))
    groups = min(blocks * runs, 8 * parts)

    def dealt(code: str, n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(code, F.lit(salt)), F.lit(n)).cast("int")

    def of_block(here: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        codes_, copies = here["code"].to_numpy(np.int64).view(np.uint64), here["copies"].to_numpy(np.int64)
        queries_ = asking["query"].to_numpy(np.int64).view(np.uint64)
        who, code, distance = SegmentIndex(codes_, copies, segments).search(queries_, asking["bound"].to_numpy(np.int64), k)
        return pd.DataFrame({"query": queries_[who].view(np.int64), "code": codes_[code].view(np.int64), "distance": distance.astype(np.int32), "copies": copies[code].astype(np.int32)})

    every_run = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    data = codes.select(dealt("code", blocks, 0).alias("block"), every_run.alias("run"), "code", F.size("ids").alias("copies"))
    data = data.repartition(groups, "block", "run").groupBy("block", "run")

    def searched(asking: DataFrame) -> DataFrame:
        return data.cogroup(asking.repartition(groups, "block", "run").groupBy("block", "run")).applyInPandas(
            of_block, "query bigint, code bigint, distance int, copies int")

    placed = wanted.select("query", dealt("query", blocks, 0).alias("home"), dealt("query", runs, 1).alias("run"))
    first = rounds.keep(searched(placed.select(F.col("home").alias("block"), "run", "query", F.lit(WIDTH).alias("bound"))), "first")
    reached = first.groupBy("query").agg(F.when(F.sum("copies") >= k, F.max("distance")).alias("bound"))
    bounded = placed.join(reached, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(WIDTH)))
    others = bounded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> home")
    second = rounds.keep(searched(others.select("block", "run", "query", "bound")), "second")
    # codes at one distance compete by their ids, so all of the k-th distance are listed
    listed = first.unionByName(second).join(codes.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))
    top = listed.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(top, asked.code == top["query"]).select(F.col("id").alias("query_id"), "rank", "neighbor_id", "distance")
