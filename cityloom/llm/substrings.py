"""Repeated passages: windows of words that occur more than once, by level-wise doubling.

The first level judges every window of half the length (rounded up). A window of twice the length, or of ``window`` words
where twice would be more, can only repeat if its two halves do, which then overlap; so each further level extends the
windows that repeated, and them alone. The level of ``window`` words decides what is removed. The levels above it go on
until no candidate survives; a document's ``longest`` is the longest of them at which it still shares a window.

Documents are dealt into blocks of bounded text by a hash. A block announces the sorted, distinct hashes of its candidates,
cut into ranges of the hash; a window that fills a third of the corpus is one number per block. Whoever gets a range knows
which numbers several blocks have, or one block twice, and answers with one bit for each. So what travels is some 4 bytes
a window at the first level, never positions or words, and no group depends on how often a passage repeats. There are at
most as many rows as windows, however many blocks and ranges there are.

Words are runs of bytes other than space and \\x09-\\x0D. Null texts have none. Documents shorter than a window lose
nothing. Rows that repeat are copies of each other: their windows repeat. A text is held whole by its block, however long.
Columns of the caller named like the new ones are replaced; the pipeline packs them away first. The level that decides
compares 96 bits made of 64-bit hashes of the words, the levels before it 48, those after it 64: a chance hit there makes
one more candidate, or a ``longest`` too long, never a word less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, BinaryType, IntegerType

from ..runtime import Rounds
from .common import mix, shuffle_partitions

WINDOW = 35
BLOCK_BYTES = 6 << 20
RANGE_BYTES = 12 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)  # sets the second stream of hashes apart
#: Bytes compared of each stream of hashes: before the level that decides, there, and after it.
BEFORE, DECIDES, AFTER = (6,), (8, 4), (8,)


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a window from those of its two parts, in their order."""
    return mix(left * ODD + right)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows at every place, by doubling: parts of 1, 2, 4, … words, the last two of which may overlap."""
    size, part = 1, words
    while 2 * size <= window:
        part = joined_hash(part[:-size], part[size:]) if len(part) > size else part[:0]
        size *= 2
    if size < window:
        shift = window - size
        part = joined_hash(part[:-shift], part[shift:]) if len(part) > shift else part[:0]
    return part


def _words(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, where each text's words begin among all, and the hashes of all words."""
    words = [(t or "").encode().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.append(0, np.cumsum(sizes))
    return words, starts, np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(starts[-1]))


def _places(starts: np.ndarray, length: int) -> np.ndarray:
    """Where a window of ``length`` words begins and lies within one text."""
    fits = np.maximum(np.diff(starts) - length + 1, 0)
    ends = np.cumsum(fits)
    return np.repeat(starts[:-1] - (ends - fits), fits) + np.arange(ends[-1] if len(ends) else 0)


def level_lengths(window: int, first: int | None = None) -> list[int]:
    """Lengths of the levels up to the one that decides: ``first`` (half the window), doubled until it is reached."""
    lengths = [min(window, first or (window + 1) // 2)]
    while lengths[-1] < window:
        lengths.append(min(2 * lengths[-1], window))
    return lengths


def _hashes(flat: np.ndarray, places: np.ndarray, length: int, widths: tuple[int, ...]) -> np.ndarray:
    """One row of window hashes for each stream, of which the highest bytes, as many as ``widths`` says, are kept."""
    if not len(places):
        return np.zeros((len(widths), 0), np.uint64)
    streams = (flat, mix(flat ^ SECOND))
    return np.stack([window_hashes(words, length)[places] >> np.uint64(64 - 8 * width) << np.uint64(64 - 8 * width) for words, width in zip(streams, widths)])


ANNOUNCED = StructType([StructField("range", IntegerType()), StructField("block", LongType()), StructField("numbers", BinaryType()), StructField("twice", BinaryType())])
ANSWERED = StructType([StructField("block", LongType()), StructField("range", IntegerType()), StructField("repeated", BinaryType())])


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different columns of ``hashes`` in order, how often each occurs, and which of them each column is."""
    order = np.argsort(hashes[0]) if len(hashes) == 1 else np.lexsort(hashes[::-1])
    ranked = hashes[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[:, 1:] != ranked[:, :-1]).any(0)
    which = np.cumsum(new) - 1
    inverse = np.empty(len(order), np.int64)
    inverse[order] = which
    return ranked[:, new], np.bincount(which), inverse


def _ranges(numbers: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """``range, from, to`` of the ranges in which sorted numbers lie."""
    part = ((numbers >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(part)]))


def _planes(numbers: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)[:, 8 - width:].T.tobytes()


def _numbers(planes: bytes, widths: tuple[int, ...]) -> np.ndarray:
    size, at, out = len(planes) // sum(widths), 0, []
    for width in widths:
        own = np.zeros((size, 8), np.uint8)
        own[:, 8 - width:] = np.frombuffer(planes, np.uint8, size * width, at).reshape(width, size).T
        out.append(own.view(np.uint64)[:, 0])
        at += size * width
    return np.stack(out)


def announce(block: int, hashes: np.ndarray, ranges: int, widths: tuple[int, ...] = AFTER) -> pa.Table:
    """A row for each range in which the block has hashes: the bytes of the sorted hashes, plane by plane, which compresses well."""
    numbers, counts, _ = distinct(hashes)
    rows = [(i, block, b"".join(_planes(own[a:b], width) for own, width in zip(numbers, widths)), np.packbits(counts[a:b] > 1).tobytes())
            for i, a, b in _ranges(numbers[0], ranges)]
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=ANNOUNCED.names)


def answer(group: pa.Table, widths: tuple[int, ...] = AFTER) -> pa.Table:
    """For every block's hashes in one range: which of them occur more than once anywhere."""
    lists = [_numbers(x, widths) for x in group.column("numbers").to_pylist()]
    sizes = [x.shape[1] for x in lists]
    own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group.column("twice").to_pylist(), sizes)])
    _, counts, which = distinct(np.concatenate(lists, 1))
    several = counts > 1
    several[which[own > 0]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(several[which], np.cumsum(sizes)[:-1])]
    return pa.table([group.column("block"), group.column("range"), pa.array(bits, pa.binary())], names=ANSWERED.names)


def repeated(hashes: np.ndarray, answers: pa.Table, ranges: int) -> np.ndarray:
    """Whether each window of a block repeats, from the answers to what the block announced."""
    numbers, _, which = distinct(hashes)
    edges = {i: (a, b) for i, a, b in _ranges(numbers[0], ranges)}
    flags = np.zeros(numbers.shape[1], bool)
    for at, bits in zip(answers.column("range").to_pylist(), answers.column("repeated").to_pylist()):
        a, b = edges[at]
        flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return flags[which]


def _answers(announced: DataFrame, widths: tuple[int, ...] = AFTER) -> DataFrame:
    return announced.groupBy("range").applyInArrow(lambda group: answer(group, widths), ANSWERED)


def _halves(key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted window places: which have another ``length`` words on, and its position."""
    at = np.searchsorted(key, key + length)
    both = at < len(key)
    both[both] = key[at[both]] == key[both] + length
    return np.flatnonzero(both), at[both]


def handed_on(key: np.ndarray, length: int) -> np.ndarray:
    """Whether each window is a half of one of twice the length; others are of no use to the next level."""
    out = np.zeros(len(key), bool)
    for half in _halves(key, length):
        out[half] = True
    return out


def _steps(starts: np.ndarray) -> bytes:
    """Rising starts as differences, which compress well."""
    return np.diff(starts, prepend=0).astype("<i4").tobytes()


def candidates(flat: np.ndarray, starts: np.ndarray, lengths: list[int], answers: list[pa.Table], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of a block's windows: those that repeat at the last level answered, or the next level's candidates."""
    for level, length in enumerate(lengths):
        places = _places(starts, length)
        if level:
            live = np.zeros(len(flat), bool)
            live[at] = True
            places = places[live[places] & live[places + (length - lengths[level - 1])]]
        hashes = _hashes(flat, places, length, DECIDES if length == lengths[-1] else BEFORE)
        if level == len(answers):
            return places, hashes
        hit = repeated(hashes, answers[level], ranges)
        at, hashes = places[hit], hashes[:, hit]
    return at, hashes


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", first: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_words, n_removed, kept`` and the windows that repeat.

    ``kept`` is the words left, joined by one space: those in no window that occurs elsewhere too. ``block`` and
    ``ordinal`` name the row; ``starts`` and ``hashes`` hold those of its repeated windows that may be part of longer ones, 4
    and 8 bytes each. The text is shuffled once, whatever the number of levels; each of them reads it again.
    """
    spark = docs.sparkSession
    added = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()),
                        StructField("block", LongType()), StructField("ordinal", LongType()), StructField("starts", BinaryType()), StructField("hashes", BinaryType())])
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added.names])
    size = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = shuffle_partitions(spark)
    blocks, ranges = max(n, size // BLOCK_BYTES), max(n, size // RANGE_BYTES)
    names, lengths = own.columns, level_lengths(window, first)
    dealt = own.withColumn("block", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(blocks))).repartition(n, "block")

    def widths(level: int) -> tuple[int, ...]:
        return DECIDES if lengths[level] == window else BEFORE

    def by_level(answers: pa.Table, levels: int) -> list[pa.Table]:
        return [answers.filter(pc.equal(answers.column("level"), i)) for i in range(levels)]

    def tell(block: pa.Table, answers: pa.Table | None, level: int) -> pa.Table:
        _, starts, flat = _words(block.column(text).to_pylist())
        return announce(block.column("block")[0].as_py(), candidates(flat, starts, lengths, by_level(answers, level), ranges)[1], ranges, widths(level))

    def clean(block: pa.Table, answers: pa.Table) -> pa.Table:
        words, starts, flat = _words(block.column(text).to_pylist())
        places, hashes = candidates(flat, starts, lengths, by_level(answers, len(lengths)), ranges)
        change = np.zeros(starts[-1] + 1, np.int32)
        change[places] += 1
        change[places + window] -= 1
        covered = np.cumsum(change[:-1]) > 0
        longer = handed_on(places + (np.searchsorted(starts, places, side="right") << 40), window)
        places, hashes = places[longer], hashes[0, longer]
        edges = np.searchsorted(places, starts)
        rows = []
        for i, own_words in enumerate(words):
            gone = covered[starts[i]:starts[i + 1]]
            at = slice(edges[i], edges[i + 1])
            left = own_words if not gone.any() else [w for w, g in zip(own_words, gone.tolist()) if not g]
            rows.append((len(own_words), int(gone.sum()), b" ".join(left).decode(), block.column("block")[i].as_py(), i, _steps(places[at] - starts[i]), hashes[at].tobytes()))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        extra = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        return pa.table([*(block.column(c) for c in names), *extra], names=[*names, *added.names])

    def teller(level: int):
        return lambda block, answers: tell(block, answers, level)

    by_block, answers = dealt.groupBy("block"), None
    for level in range(len(lengths)):
        told = by_block.applyInArrow(lambda block: tell(block, None, 0), ANNOUNCED) if answers is None else by_block.cogroup(answers.groupBy("block")).applyInArrow(teller(level), ANNOUNCED)
        given = _answers(told, widths(level)).repartition(n, "block").withColumn("level", F.lit(level))
        answers = given if answers is None else answers.unionByName(given)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(clean, StructType([*own.schema.fields, *added.fields]))


def longest_repeats(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``block, ordinal, longest``: the longest level of each row whose windows were handed on. ``found`` must be a written table."""
    rounds = Rounds(found.sparkSession, "substrings")
    size = found.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    ranges = max(shuffle_partitions(found.sparkSession), size // RANGE_BYTES)
    schema = StructType([StructField("block", LongType()), StructField("ordinal", LongType()), StructField("starts", BinaryType()), StructField("hashes", BinaryType())])
    state = found.select(*schema.names).where(F.octet_length("hashes") > 0)
    levels, length = state.select("block", "ordinal", F.lit(window).cast("bigint").alias("longest")), window

    def extend(block: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, starts and hashes of windows of twice the length of which both halves repeat."""
        starts = [np.cumsum(np.frombuffer(x, "<i4"), dtype=np.int64) for x in block.column("starts").to_pylist()]
        key = np.concatenate([s + (i << 40) for i, s in enumerate(starts)])
        order = np.argsort(key)
        key, hashes = key[order], np.frombuffer(b"".join(block.column("hashes").to_pylist()), np.uint64)[order]
        left, right = _halves(key, length)
        return key[left] >> 40, key[left] & ((1 << 40) - 1), joined_hash(hashes[left], hashes[right])

    def level(length: int):
        """What a block announces and what survives when windows of ``length`` are extended."""

        def tell(block: pa.Table) -> pa.Table:
            return announce(block.column("block")[0].as_py(), extend(block, length)[2][None], ranges)

        def survive(block: pa.Table, answers: pa.Table) -> pa.Table:
            row, start, hashes = extend(block, length)
            hit = repeated(hashes[None], answers, ranges)
            row, start, hashes = row[hit], start[hit], hashes[hit]
            held = np.unique(row)
            longer = handed_on((row << 40) + start, 2 * length)
            row, start, hashes = row[longer], start[longer], hashes[longer]
            edges = np.searchsorted(row, np.arange(block.num_rows + 1))
            columns = [block.column("block").take(pa.array(held)), block.column("ordinal").take(pa.array(held))]
            columns += [pa.array([_steps(start[edges[i]:edges[i + 1]]) for i in held], pa.binary()), pa.array([hashes[edges[i]:edges[i + 1]].tobytes() for i in held], pa.binary())]
            return pa.table(columns, names=schema.names)

        return tell, survive

    while True:
        tell, survive = level(length)
        by_block = state.where(F.octet_length("hashes") > 0).groupBy("block")
        answers = _answers(by_block.applyInArrow(tell, ANNOUNCED))
        state = rounds.keep(by_block.cogroup(answers.groupBy("block")).applyInArrow(survive, schema), "level")
        length *= 2
        if state.limit(1).count() == 0:
            return levels.groupBy("block", "ordinal").agg(F.max("longest").alias("longest"))
        levels = levels.unionByName(rounds.keep(state.select("block", "ordinal", F.lit(length).cast("bigint").alias("longest")), "longest-%d" % length))
        rounds.drop("level", 1)


def repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, longest`` per row (``longest`` 0 where no window repeats)."""
    rounds = Rounds(docs.sparkSession, "repeats")
    cleaned = remove_repeats(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), window)
    found = rounds.keep(cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"), "block", "ordinal", "starts", "hashes"), "found")
    result = found.drop("starts", "hashes").join(longest_repeats(found, window), ["block", "ordinal"], "left")
    return result.select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("longest", F.when(F.col("n_removed") > 0, window).otherwise(0).cast("bigint")).alias("longest"))
