"""Sharding by histogram sort.

Rows are ordered by a key: the hash of their text, then their id, so copies lie together and large groups can still be
cut. Candidate boundaries in that order are probed together: one pass counts the exact bytes and rows below each. Where a
shard's ideal boundary still lies in a gap of too many bytes, or a gap holds too many rows for one task, the next
round probes inside it. When every boundary is within tolerance the rows move once, to their gap; a row's slot is its
rank in the gap plus the rows that the counts say lie before.

The driver holds the counts of the probes: some per shard and one per ``gap_rows`` rows. Null texts have no bytes and
are ordered as empty ones; null ids come first. Rows equal in text and id cannot be told apart: no boundary cuts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .common import packed, unpacked

SHARDS = 40
FIXED_BYTES = 16
GAP_ROWS = 200_000
TOLERANCE = 0.002
FANOUT = 16
MOST_ROUNDS = 40
LOW = 1 << 63


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as ``row``, with its size, the two parts of its key and the checksum of its text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return packed(docs, size=(F.octet_length(whole) + FIXED_BYTES).cast("bigint"), text_crc32=F.crc32(F.encode(whole, "utf-8")),
                  _hash=F.xxhash64(whole), _id=F.coalesce(F.col(id).cast("bigint"), F.lit(-LOW)))


def _codes(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that compare like the pair (hash, id)."""
    both = np.stack([hashes.astype(np.int64), ids.astype(np.int64)], axis=1).view(np.uint64) ^ np.uint64(LOW)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _probe_codes(probes: list[int]) -> np.ndarray:
    pairs = np.array([[p >> 64, p & (2**64 - 1)] for p in probes], np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(pairs.astype(">u8")).view("S16").ravel()


def _counted(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, rows, least and greatest key of every gap between probes; gap i has the keys from probe i - 1 up to probe i."""
    codes = _probe_codes(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(codes) + 1, np.int64), np.zeros(len(codes) + 1, np.int64)
        least, most = {}, {}
        for batch in batches:
            own = _codes(batch.column("_hash").to_numpy(zero_copy_only=False), batch.column("_id").to_numpy(zero_copy_only=False))
            gap = np.searchsorted(codes, own, side="right")
            np.add.at(size, gap, batch.column("size").to_numpy(zero_copy_only=False))
            np.add.at(rows, gap, 1)
            order = np.argsort(own, kind="stable")
            gaps = gap[order]
            first = np.flatnonzero(np.r_[True, gaps[1:] != gaps[:-1]]) if len(gaps) else np.zeros(0, np.int64)
            for a, b in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(gaps) - 1]):
                g, low, high = int(gaps[a]), own[order[a]].ljust(16, b"\0"), own[order[b]].ljust(16, b"\0")
                least[g], most[g] = min(low, least.get(g, low)), max(high, most.get(g, high))
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(size[held], pa.int64()), pa.array(rows[held], pa.int64()),
                                          pa.array([least[int(g)] for g in held], pa.binary()), pa.array([most[int(g)] for g in held], pa.binary())], names=["gap", "size", "rows", "least", "most"])

    parts = keys.mapInArrow(run, "gap bigint, size bigint, rows bigint, least binary, most binary")
    summed = parts.groupBy("gap").agg(F.sum("size"), F.sum("rows"), F.min("least"), F.max("most")).collect()  # a row per gap, at most
    return {g: (s, r, int.from_bytes(a), int.from_bytes(b)) for g, s, r, a, b in summed}


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, gap_rows: int = GAP_ROWS) -> tuple[list[int], list[int], list[int]]:
    """Probes in order, the shard of each gap between them, and the slot at which each gap begins in its shard.

    Refines until every shard boundary lies within ``tolerance`` of a shard's bytes from its ideal and no gap has more than
    ``gap_rows`` rows, or what is left in the gap is one key.
    """
    rows = keys.count()
    n = max(shards * 4, -(-rows // gap_rows) * 2)
    probes = [(i << 128) // n for i in range(1, n)]
    for _ in range(MOST_ROUNDS):
        gaps = _counted(keys, probes)
        total = sum(g[0] for g in gaps.values())
        ideal = [total * i // shards for i in range(1, shards)]
        below = np.cumsum([0, *(gaps.get(i, (0,))[0] for i in range(len(probes) + 1))])
        new = set()
        for g, (size, count, least, most) in gaps.items():
            inside = np.searchsorted(ideal, [below[g], below[g + 1]])
            wanted = [t for t in ideal[inside[0]:inside[1]] if min(t - below[g], below[g + 1] - t) > tolerance * total / shards]
            if most == least or not (wanted or count > gap_rows):
                continue
            width = most - least
            marks = {least + 1 + width * i // FANOUT for i in range(FANOUT)}
            for t in wanted:  # closer probes around where the boundary should lie if keys are spread evenly
                guess = least + width * int(t - below[g]) // size
                marks |= {min(most, max(least + 1, guess + width * j // (FANOUT * 64))) for j in range(-FANOUT // 2, FANOUT // 2 + 1)}
            new |= marks
        if not new - set(probes):
            break
        probes = sorted({*probes, *new})
    else:
        raise RuntimeError("the shard boundaries did not settle")  # a round narrows every open gap sixteenfold: 32 rounds reach single keys
    bounds = [int(np.abs(below[1:-1] - t).argmin()) + 1 for t in ideal] if len(probes) else []
    shard_of = np.searchsorted(bounds, np.arange(len(probes) + 1), side="right").tolist()
    slot, slots, last = 0, [], -1
    for g, shard in enumerate(shard_of):
        slot = slot if shard == last else 0
        slots.append(slot)
        slot, last = slot + gaps.get(g, (0, 0))[1], shard
    return probes, shard_of, slots


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size, text_crc32, shard, slot``: shards of near equal bytes, slots gapless from 0 in each.

    Columns of ``docs`` named like a new one are replaced, all others are kept.
    """
    rows = sized(docs, id, text)
    keys = cut(rows.select("_hash", "_id", "size"), "shard-keys")
    probes, shard_of, slots = splitters(keys, shards)
    codes, base, shard = _probe_codes(probes), np.array(slots, np.int64), np.array(shard_of, np.int32)

    @F.pandas_udf("struct<gap:int,shard:int,base:bigint>")
    def place(hashes, ids):
        import pandas as pd

        gap = np.searchsorted(codes, _codes(hashes.to_numpy(), ids.to_numpy()), side="right")
        return pd.DataFrame({"gap": gap.astype(np.int32), "shard": shard[gap], "base": base[gap]})

    dealt = rows.withColumn("_at", place("_hash", "_id"))
    rank = F.row_number().over(Window.partitionBy("_at.gap").orderBy("_hash", "_id", "size", "text_crc32"))
    slot = (F.col("_at.base") + rank - 1).cast("bigint")
    return unpacked(dealt.withColumn("slot", slot), docs, size=F.col("size"), text_crc32=F.col("text_crc32"), shard=F.col("_at.shard"), slot=F.col("slot"))
