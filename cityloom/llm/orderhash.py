"""Document fingerprints by order MinHash.

A text's k-mers (runs of ``k`` bytes of its UTF-8, numbered where they occur more than once) are ordered by a hash. The
smallest few are taken, put back in the order in which they stand in the text, and hashed together to one number. Under
many orders these numbers form the fingerprint. Two texts agree in a number only if the same k-mers are smallest and
stand in the same order, so the share of equal numbers falls with edit distance, not just with shared content.

Null texts count as empty. Empty texts have the all-zero fingerprint, alike among themselves only. A text shorter than k
is its own single k-mer. Rows that repeat have equal fingerprints. The document after the last is the first; a table of
one row is its own next document; rows of equal id follow each other in the order of their texts, null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import mix, shuffle_partitions, slices

K = 12
SMALLEST = 2
ORDERS = 32
CHUNK = 1 << 13
ODD = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(2**64 - 1)


class OrderMinHash:
    def __init__(self, k: int = K, smallest: int = SMALLEST, orders: int = ORDERS):
        self.k, self.smallest, self.orders = k, smallest, orders
        self.factors = (np.random.default_rng(11).integers(0, 2**63, orders, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def kmers(self, data: bytes) -> np.ndarray:
        """A hash of every k-mer in its place, different for its first, second, … occurrence."""
        part, size = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1
        k = min(self.k, len(data))
        while 2 * size <= k:
            part = part[:-size] * ODD ** np.uint64(size) + part[size:]
            size *= 2
        if size < k:
            shift = k - size
            part = mix(part[:-shift]) * ODD + part[shift:]
        hashes = mix(part)
        ranked = np.sort(hashes)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
            at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
            several = np.flatnonzero(twice[at] == hashes)
            several = several[np.argsort(at[several], kind="stable")]
            group = at[several]
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            number = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
            hashes[several] = mix(hashes[several] + number.astype(np.uint64) * ODD)
        return hashes

    def __call__(self, data: bytes) -> bytes:
        """The fingerprint: one unsigned 32-bit number for each order."""
        if not data:
            return bytes(4 * self.orders)
        hashes, rows = self.kmers(data), np.arange(self.orders)
        ranks, places = [], []
        for at in range(0, len(hashes), CHUNK):
            ordered = self.factors * hashes[None, at:at + CHUNK]
            for _ in range(min(self.smallest, ordered.shape[1])):
                best = ordered.argmin(1)
                ranks.append(ordered[rows, best])
                places.append(best + at)
                ordered[rows, best] = LAST
        ranks, places = np.stack(ranks, 1), np.stack(places, 1)
        taken = np.sort(np.take_along_axis(places, np.argsort(ranks, 1, kind="stable")[:, :self.smallest], 1), 1)
        number = np.full(self.orders, taken.shape[1], np.uint64)
        for i in range(taken.shape[1]):
            number = mix(number * ODD + hashes[taken[:, i]])
        return (number >> np.uint64(32)).astype("<u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal numbers."""
    return float((np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")).mean())


def fingerprints(docs: DataFrame, k: int = K, smallest: int = SMALLEST, orders: int = ORDERS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row, the fingerprint as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, smallest, orders)
        for part in slices(batches, "text"):
            held = [sketch((t or "").encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(held, pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fingerprint binary")


def edited_text(text: str, after: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as much, or all, of the start of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _compared(sketch: OrderMinHash, doc, text: str, own: bytes, after: str, next_own: bytes) -> tuple:
    edited = edited_text(text, after)
    own_edited = own if edited == text else sketch(edited.encode())
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, own_edited, likeness(own, own_edited), likeness(own, next_own)


def with_edits(docs: DataFrame, k: int = K, smallest: int = SMALLEST, orders: int = ORDERS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text, and its likeness to that and to the next document's.

    Texts move once, into ranges of the id. A range works through its rows in order and holds two at a time; it hands out
    its first and last row, which alone are joined across ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    order = ["doc_id", "_tie", "text"]
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "_tie").sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, part, held = OrderMinHash(k, smallest, orders), TaskContext.get().partitionId(), None

        def out(kind: str, rows: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
            fixed = [pa.array([part] * len(rows), pa.int32()), pa.array([kind] * len(rows), pa.string()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays([*fixed, *[pa.array(c, t) for c, t in zip(zip(*rows), TYPES)]], names=["part", "kind", "text", *NAMES])

        edge = lambda kind, doc, text, own: out(kind, [(doc, len(text), None, own, None, None, None)], [text])
        for batch in slices(batches, "text"):
            done = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = held[2] if held is not None and held[1] == text else sketch(text.encode())
                if held is None:
                    yield edge("first", doc, text, own)
                else:
                    done.append(_compared(sketch, *held, text, own))
                held = doc, text, own
            if done:
                yield out("row", done, [None] * len(done))
        if held is not None:
            yield edge("last", *held)

    found = cut(ranged.mapInArrow(run, f"part int, kind string, text string, {OUT}"), "orderhash")
    parts = sorted(r[0] for r in found.where("kind = 'first'").select("part").collect())  # one number per range
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = found.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    across = found.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(first, "next_part")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderMinHash(k, smallest, orders)
        for batch in batches:
            rows = [_compared(sketch, r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_print"]) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    return found.where("kind = 'row'").select(*NAMES).unionByName(across.mapInArrow(join, OUT))
