"""Packing token sequences by the configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The linear program "fewest configurations that cover
every length as often as it occurs" is solved by multiplicative weights: each round prices every length by its weight,
a knapsack over capacities finds the configuration worth most with each length, and lengths they cover lose weight,
until every length is covered. The fractional solution is rounded to whole copies; what is left over goes
best-fit-decreasing, by length and count, not by item.

The program sees only the histogram: at most ``capacity`` numbers, whatever the data. Items are numbered within their
length in parallel: by part of the table first, then by the count of earlier parts.

Null texts count as empty; every document has at least its closing id, so each row gives at least one piece. Rows that
repeat are packed as often as they occur. Rows of a null id are packed like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .bpe import SLICE, WordBpe
from .common import packed, slices, unpacked, whole_row

CAPACITY = 2048
#: A length counts as covered when this share of its items, at most, is open; rounding and best fit place those.
TOLERANCE = 0.02
#: A round covers at most this share of a length, and a step ahead lowers its price by about this part.
STEP, SHARPNESS = 0.5, 0.2
SMALL = 1e-9


def pieces(docs: DataFrame, vocab: Broadcast, capacity: int = CAPACITY, closing: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: its ids and the closing id, cut only where longer than ``capacity``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = int(closing).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocab.value)
        for part in slices(batches, "text", SLICE):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), bpe.encode(part.column("text").to_pylist())):
                ids += end
                for i, start in enumerate(range(0, len(ids) // 4, capacity)):
                    held = ids[4 * start:4 * (start + capacity)]
                    rows.append((doc, i, start, len(held) // 4, zlib.crc32(held)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    chosen = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def worth_of_rooms(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The worth of the best configuration for every room up to ``capacity`` and the length taken last for it, 0 for none."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = prices[lengths]
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        n = fits[room]
        value[room] = value[room - 1]
        if n:
            offer = value[room - lengths[:n]] + worth[:n]
            best = int(offer.argmax())
            if offer[best] > value[room]:
                value[room], last[room] = offer[best], lengths[best]
    return value, last


def program(counts: np.ndarray, capacity: int, rounds: int | None = None) -> dict[tuple, float]:
    """Copies, in fractions, of configurations ``((length, many), ...)`` that cover every length up to the tolerance, none twice.

    Covering by multiplicative weights: a length's price is its size, lowered by the share of its demand that is covered
    and nothing once that is within ``TOLERANCE`` of all. One knapsack a round prices every room, so it gives
    the best configuration with each length; they are used from the most worth down, as often as no length is covered by
    more than a step. A round brings the dearest length a step forward, so the rounds end and grow with the lengths at most.
    """
    demand = counts.astype(float)
    covered, used = np.zeros(len(counts)), {}
    most = counts.tolist()
    done = 0
    while rounds is None or done < rounds:
        wanted = np.flatnonzero(demand - covered > TOLERANCE * demand)
        if not len(wanted):
            break
        done += 1
        share = covered[wanted] / demand[wanted]
        prices = np.zeros(len(counts))
        prices[wanted] = wanted * np.exp(-(share - share.min()) / STEP * SHARPNESS)
        value, last = worth_of_rooms(prices, wanted, capacity)
        filled = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0)).tolist()
        last = last.tolist()
        free = np.minimum(STEP * demand, demand - covered).tolist()
        for length in wanted[np.argsort(-(prices[wanted] + value[capacity - wanted]), kind="stable")].tolist():
            if free[length] <= SMALL:
                continue
            taken, room = {length: 1}, filled[capacity - length]
            while room:
                taken[last[room]] = taken.get(last[room], 0) + 1
                room = filled[room - last[room]]
            key = tuple(sorted(((x, min(many, most[x])) for x, many in taken.items()), reverse=True))
            copies = min(free[x] / many for x, many in key)
            if copies > SMALL:
                used[key] = used.get(key, 0.0) + copies
                for x, many in key:
                    free[x] -= copies * many
                    covered[x] += copies * many
    return used


def rounded(counts: np.ndarray, used: dict[tuple, float]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole copies, then one more for a fraction where all its items are still there; and the items left over."""
    left, copies = counts.tolist(), {}

    def take(key: tuple, wished: int) -> None:
        whole = min(wished, min(left[length] // many for length, many in key))
        if whole > 0:
            copies[key] = copies.get(key, 0) + whole
            for length, many in key:
                left[length] -= whole * many

    for key, x in sorted(used.items(), key=lambda u: (-filling(u[0]), u[0])):
        take(key, int(x + SMALL))
    for key, x in sorted(used.items(), key=lambda u: (-(u[1] % 1), u[0])):
        if SMALL < x % 1 < 1 - SMALL:
            take(key, 1)
    return [(np.array(key), n) for key, n in copies.items()], np.array(left, np.int64)


def filling(key: tuple) -> int:
    return sum(length * many for length, many in key)


def configurations(counts: np.ndarray, capacity: int, rounds: int | None = None) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole numbers of copies that hold every length as often as ``counts`` says.

    The program's solution is rounded several times, with configurations that leave ever more room unused; the fewest
    sequences win, then the fewest items left to best fit. Best fit alone is taken only where it needs fewer sequences.
    """
    if not counts.any():
        return []
    used = program(counts, capacity, rounds)
    best, fewest = None, None
    for waste in sorted({0, *(1 << i for i in range(capacity.bit_length())), capacity}):
        whole, left = rounded(counts, {key: x for key, x in used.items() if capacity - filling(key) <= waste})
        chosen = whole + best_fit(left, capacity)
        rank = sum(copies for _, copies in chosen), int(left.sum())
        if fewest is None or rank < fewest:
            best, fewest = chosen, rank
    plain = best_fit(counts, capacity)
    return plain if sum(copies for _, copies in plain) < fewest[0] else best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Longest first, each into the fullest open sequence it fits; equal lengths and equal sequences go together."""
    open_by_room: dict[int, dict[tuple, int]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r in open_by_room if r >= length), default=None)
            if room is None:
                fit = capacity // length
                for many, copies in ((fit, left // fit), (left % fit, 1)):
                    if many and copies:
                        at = open_by_room.setdefault(capacity - many * length, {})
                        key = ((length, many),)
                        at[key] = at.get(key, 0) + copies
                left = 0
                break
            key, copies = open_by_room[room].popitem()
            if not open_by_room[room]:
                del open_by_room[room]
            many = min(room // length, max(1, left // copies))
            taken = min(copies, left // many)
            left -= taken * many
            if copies > taken:
                open_by_room.setdefault(room, {})[key] = copies - taken
            at = open_by_room.setdefault(room - many * length, {})
            grown = (*key, (length, many))
            at[grown] = at.get(grown, 0) + taken
    return [(np.array(key), copies) for held in open_by_room.values() for key, copies in held.items()]


@dataclass
class Plan:
    """Where the n-th item of each length goes: runs of item numbers, sorted by length and number."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    many: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of items given by length and number within it."""
        span = int(self.first.max()) + int(number.max()) + 2
        run = np.searchsorted(self.length * span + self.first, length * span + number, side="right") - 1
        copy, inside = np.divmod(number - self.first[run], self.many[run])
        return self.sequence[run] + copy, self.offset[run] + inside * length


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> Plan:
    """The packing of ``counts[length]`` items of each length. Full-length items need no program."""
    inner = counts.copy()
    inner[capacity] = 0
    chosen = configurations(inner, capacity, rounds)
    if counts[capacity]:
        chosen.append((np.array([[capacity, 1]]), int(counts[capacity])))
    runs, done, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for parts, copies in chosen:
        offset = 0
        for length, many in parts.tolist():
            runs.append((length, int(done[length]), sequence, many, offset))
            done[length] += many * copies
            offset += many * length
        sequence += copies
    return Plan(*np.array(sorted(runs), np.int64).reshape(-1, 5).T)


def pack(items: DataFrame, capacity: int = CAPACITY, rounds: int | None = None) -> DataFrame:
    """``items`` (with a ``length`` up to ``capacity``) with ``sequence_id`` and ``offset``, gapless in each sequence.

    Other columns pass through as they are. Columns named like the two new ones are replaced.
    """
    own = items.drop("sequence_id", "offset")
    kept = cut(packed(own, length=F.col("length").cast("bigint"), part=F.spark_partition_id(), tie=whole_row(own)), "pieces")
    tally = cut(kept.groupBy("part", "length").agg(F.count("*").alias("rows")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, rows in tally.groupBy("length").agg(F.sum("rows")).collect():  # one row per length: at most the capacity
        counts[length] = rows
    packing = plan(counts, capacity, rounds)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select("part", "length", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    # the start of a part's items of one length comes first among them, so it needs no join
    empty = {c: F.lit(None).cast(kept.schema[c].dataType) for c in ("row", "tie")}
    both = kept.withColumns({"before": F.lit(None).cast("bigint"), "item": F.lit(True)}).unionByName(starts.withColumns({**empty, "item": F.lit(False)}))
    order = Window.partitionBy("part", "length").orderBy("item", "tie")
    number = F.max("before").over(order) + F.row_number().over(order) - 2

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = packing.place(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = both.withColumn("number", number).where("item").withColumn("place", place("length", "number"))
    return unpacked(placed, own, sequence_id=F.col("place.sequence_id"), offset=F.col("place.offset"))
