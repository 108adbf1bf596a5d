"""Near-duplicates by SimHash, linked through deletion-variant signatures.

Two fingerprints with at most three differing bits, cut into two halves, have a half that differs in one bit at most; with
up to five, one of three segments does. So every segment is indexed once for each of its bits with that bit left out: near
fingerprints then share a signature, which an equality join finds, and full comparison verifies. Only different
fingerprints are indexed; copies share one.

A signature's fingerprints are searched like a graph: from one, all unvisited ones near it are reached and dropped from
the search, so a dense group of n gives n - 1 links, never all its pairs. A signature with more than ``crowd``
fingerprints is dealt out again over further keys, one part each of the bits it leaves free; there is one part more than
bits can differ, so near fingerprints share one.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Rows that repeat
keep their rows. Rows of a null id are linked too, and a group of none but null ids has a null component. Columns beside
id and text play no part and may be called anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Rounds, cut
from .common import components, mix, packed, shuffle_partitions, slices, unpacked, whole_row

SEED = 42
CROWD = 20_000


def fingerprint(text: str | None, width: int = 3, tables: int = 1) -> list[int]:
    """Majority of each bit over the hashes of all word shingles, repeats included; set only if over half have it.

    Further tables repeat this with the hashes mixed anew: independent fingerprints of the same shingles.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * tables
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        begins = (ends - sizes)[: len(words) - width + 1].tolist()
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1:].tolist())]
    set_bits = np.zeros((tables, 64), np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = np.array(hashes[i:i + (1 << 14)], "<u8")
        for t in range(tables):
            own = block if t == 0 else mix(block + np.uint64(t * 0x9E3779B97F4A7C15 % 2**64))
            set_bits[t] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes), axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprints(docs: DataFrame, width: int = 3, tables: int = 1, id: str = "doc_id", text: str = "text", tie: Column | None = None) -> DataFrame:
    """``doc_id, tie, fp0, fp1, …`` of every row: a fingerprint for each table, as signed 64-bit integers; ``tie`` is passed on."""
    names = ["doc_id", "tie", *[f"fp{t}" for t in range(tables)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            prints = np.array([fingerprint(t, width, tables) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), *[pa.array(prints[:, t], pa.int64()) for t in range(tables)]], names=names)

    chosen = docs.select(F.col(id).cast("bigint").alias("doc_id"), (F.lit(0).cast("bigint") if tie is None else tie).alias("tie"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def segments(radius: int) -> list[tuple[int, int]]:
    """First bit and width of the segments, of which one differs in one bit at most between fingerprints within ``radius``."""
    n = max(2, radius // 2 + 1)
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def free_parts(segment: int, radius: int) -> list[tuple[int, int]]:
    """Bits outside of a segment in one part more than can differ: first bit and width of each, none across the segment."""
    begin, width = segments(radius)[segment]
    sides = [(0, begin), (begin + width, 64 - begin - width)]
    many = [round((radius + 1) * size / (64 - width)) for _, size in sides]
    return [(at + size * i // n, size * (i + 1) // n - size * i // n) for (at, size), n in zip(sides, many) for i in range(n)]


def _bits(values: np.ndarray, at: int, width: int) -> np.ndarray:
    return (values >> np.uint64(at)) & np.uint64((1 << width) - 1)


def signatures(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``signature, fp``: 64 rows a fingerprint. A signature is segment, bit left out, and the segment without it, in one integer."""
    names, types, cuts = ["signature", "fp"], [pa.int64(), pa.int64()], segments(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                fp = batch.column("fp").slice(at, 1 << 13).to_numpy(zero_copy_only=False)
                keys = [np.uint64((begin + bit) << 32) | (_bits(fp.view(np.uint64), begin, width) & ~np.uint64(1 << bit)) for begin, width in cuts for bit in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64), types[0]), pa.array(np.tile(fp, 64), types[1])], names=names)

    return prints.select(F.col("fingerprint").alias("fp")).mapInArrow(run, "signature bigint, fp bigint")


def spanning(points: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect whatever fingerprints of a group chains of near ones connect: a forest, not all pairs."""
    left, right, rest = [], [], np.sort(points)  # smallest first: the same centres in every signature, hence the same links
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop(0)
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                reached = rest[near]
                frontier.extend(reached)
                left.extend([int(node)] * len(reached))
                right.extend(reached.tolist())
                rest = rest[~near]
    return left, right


def _grouped(keyed: DataFrame, radius: int, crowd: int | None) -> DataFrame:
    """Links ``a, b`` within each signature; with ``crowd``, members of larger groups come back as ``signature, fp``."""
    names = ["signature", "a", "b"]
    types = [pa.int64(), pa.int64(), pa.int64()]

    def pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of groups that lie complete in the sorted ``keys``."""
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.append(starts, len(keys)))
        a, b = [], []
        twos = starts[sizes == 2]
        near = np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= radius
        a.append(fps[twos[near]])
        b.append(fps[twos[near] + 1])
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            left, right = spanning(fps[start:start + size], radius)
            a.append(np.array(left, np.uint64))
            b.append(np.array(right, np.uint64))
        return np.concatenate(a), np.concatenate(b)

    def out(keys, a, b):
        return pa.RecordBatch.from_arrays([pa.array(keys, types[0]), pa.array(a.view(np.int64), types[1]), b if isinstance(b, pa.Array) else pa.array(b.view(np.int64), types[2])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by signature; the last group of one may go on in the next."""
        held_keys, held_fps, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = batch.column("signature").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if crowded is not None:
                n = int(np.searchsorted(keys, crowded, side="right"))
                if n:
                    yield out(keys[:n], fps[:n], pa.nulls(n, types[2]))
                if n == len(keys):
                    continue
                keys, fps, crowded = keys[n:], fps[n:], None
            keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, fps])
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            if crowd is not None:
                sizes = np.diff(np.append(edges, len(keys)))
                over = np.repeat(sizes > crowd, sizes)
                if over.any():
                    yield out(keys[over], fps[over], pa.nulls(int(over.sum()), types[2]))
                    if over[-1]:
                        crowded = keys[-1]
                    keys, fps = keys[~over], fps[~over]
                    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            last = int(edges[-1]) if len(edges) and crowded is None else len(keys)
            if last:
                a, b = pairs(keys[:last], fps[:last])
                if len(a):
                    yield out(np.zeros(len(a), np.int64), a, b)
            held_keys, held_fps = keys[last:], fps[last:]
        if len(held_keys):
            a, b = pairs(held_keys, held_fps)
            if len(a):
                yield out(np.zeros(len(a), np.int64), a, b)

    n = shuffle_partitions(keyed.sparkSession)
    return keyed.repartition(n, "signature").sortWithinPartitions("signature").mapInArrow(run, "signature bigint, a bigint, b bigint")


def _subkeys(crowded: DataFrame, radius: int) -> DataFrame:
    """Members of crowded signatures under further keys: the signature and one part of the bits it leaves free; near ones share a part."""
    names, types, cuts = ["signature", "fp"], [pa.int64(), pa.int64()], segments(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("signature").to_numpy(zero_copy_only=False).view(np.uint64)
            prints = batch.column("a").to_numpy(zero_copy_only=False)
            out = np.searchsorted([begin for begin, _ in cuts], every >> np.uint64(32), side="right") - 1
            for segment in np.unique(out).tolist():
                key, fp = every[out == segment], prints[out == segment]
                parts = free_parts(segment, radius)
                keys = [key | np.uint64(1 << 62 | i << 38) | _bits(fp.view(np.uint64), at, width) << np.uint64(41) for i, (at, width) in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64), types[0]), pa.array(np.tile(fp, len(parts)), types[1])], names=names)

    return crowded.select("signature", "a").mapInArrow(run, "signature bigint, fp bigint")


def near_links(prints: DataFrame, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` between different fingerprints: enough to connect all that differ in at most ``radius`` bits."""
    if radius > 5:
        raise ValueError("two or three segments hold one differing bit at most only up to a radius of 5")
    rounds = Rounds(prints.sparkSession, "simhash")
    found = rounds.keep(_grouped(signatures(prints.select("fingerprint").distinct(), radius), radius, crowd), "links")
    links = found.where("b IS NOT NULL").select("a", "b")
    again = _grouped(_subkeys(found.where("b IS NULL"), radius), radius, None).select("a", "b")
    return links.unionByName(again).distinct()


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same: an end ``b`` goes to its smallest partner, and so do its other partners.

    Every signature spans its own tree, so a member of a large group has another parent in each of them. The smallest
    partners of all members are few, so most of these links become the same. An end is a child once a signature at most,
    which bounds its partners ``a``.
    """
    led = links.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    ends = led.select(F.col("least").alias("a"), "b").unionByName(led.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b")))
    return ends.distinct()


def _members(prints: DataFrame, columns: list[str], radius: int, crowd: int) -> DataFrame:
    """``class, root`` for each class of rows with the same fingerprints: the first row that chains of near ones reach.

    A class is named by its own first row: the smallest id (null ids last), then tie, then the class itself. So the smallest
    name that links reach is the answer, and nothing has to be looked up by root. A fingerprint stands for the first
    class that has it: classes that share one link to that class, and near fingerprints link the classes they stand for.
    """
    name = F.struct(F.isnull("first.doc_id").alias("none"), F.col("first.doc_id").alias("doc_id"), F.col("first.tie").alias("tie"), F.col("class").alias("class"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tie")).alias("first")
    classes = cut(prints.groupBy(_class(columns).alias("class"), *columns).agg(first).select("class", *columns, name.alias("name")), "classes")
    links = None
    for column in columns:
        stands = cut(classes.groupBy(F.col(column).alias("fingerprint")).agg(F.min("name").alias("stands")), "stands")
        near = near_links(stands, radius, crowd)
        ends = [stands.select(F.col("fingerprint").alias(x), F.col("stands").alias(f"of_{x}")) for x in ("a", "b")]
        found = near.join(ends[0], "a").join(ends[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        if len(columns) > 1:
            shared = classes.join(stands, F.col(column) == F.col("fingerprint")).where("name <> stands")
            found = found.unionByName(shared.select(F.col("stands").alias("a"), F.col("name").alias("b")))
        links = found if links is None else links.unionByName(found)
    for _ in range(2):  # the second round finds most links alike
        links = contracted(cut(links.distinct(), "links"))
    labels = components(links, prints.sparkSession, "simhash")
    return classes.join(labels, F.col("name") == F.col("node"), "left").select("class", F.coalesce("root", "name").alias("root"))


def _class(columns: list[str]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, tables: int = 1, id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row: the smallest id that chains of near fingerprints, of any table, reach."""
    prints, columns = cut(fingerprints(docs, width, tables, id, text), "prints"), [f"fp{t}" for t in range(tables)]
    named = cut(_members(prints, columns, radius, crowd).select("class", F.col("root.doc_id").alias("component_id")), "named")
    return prints.withColumn("class", _class(columns)).join(named, "class").select("doc_id", F.col("fp0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 3, tables: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, null ids last, and among equal ids the one whose hash is smallest.

    A repeated id says nothing: rows of one id and different texts stay unless their texts are near. Rows equal in every
    column leave one. All columns are kept, whatever their names.
    """
    tie = whole_row(docs, id, text)
    prints = cut(fingerprints(docs, width, tables, id, text, tie), "prints")
    roots = _members(prints, [f"fp{t}" for t in range(tables)], radius, CROWD).select(F.col("root.doc_id").alias("kept_id"), F.col("root.tie").alias("kept_tie")).distinct()
    rows = packed(docs, doc_id=F.col(id).cast("bigint"), tie=tie)
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tie") == F.col("kept_tie"))
    return unpacked(rows.join(roots, same, "left_semi").dropDuplicates(["doc_id", "tie"]), docs)
