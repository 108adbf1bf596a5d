"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers who speaks.

A transcript is lines of text, in rows of ``conv_id, turn, text``. Each line is in one of six states: it begins or goes on
with a turn of the system, the user or the assistant. It shows a symbol: which speaker a marker names, if any, whether
it is empty or asks, and how long it is. Start, transition and symbol probabilities are counted on rows whose role is
known. Viterbi finds the likeliest states, and every row is rendered anew: each turn that begins gets the canonical
header of its role, markers as found are dropped, and the rows of a conversation in order make its canonical text.

Rows are sorted into ranges of (conversation, turn), so a conversation of any length is cut into stretches. A stretch that
may go on in another range gives its best score from every state before it to every state at its end; those small
matrices, two a range at most, are chained, and then each stretch is decoded by itself between the states so fixed.

Null texts count as one empty line. Rows without a conversation form one. Rows that repeat follow each other and are
parsed as often as they occur. Without any row of known role all probabilities are even.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import shuffle_partitions, slices

ROLES = ["system", "user", "assistant"]
#: The names by which markers call the roles.
NAMES = {"system": 0, "instructions": 0, "user": 1, "human": 1, "question": 1, "q": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "agent": 2}
_NAME = "|".join(sorted(NAMES, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:(?:#{{1,6}}\s*|<\|?|\[|\*\*)({_NAME})(?:\|?>|\]|\*\*)?\s*:?|({_NAME})\s*[:>])\s*", re.IGNORECASE | re.ASCII)
STATES = 2 * len(ROLES)  # even: begins a turn of role s // 2, odd: goes on with it
SYMBOLS = 4 * 2 * 4


def symbol(line: str) -> tuple[int, int]:
    """What a line shows, and how many characters of it are its marker."""
    found = MARKER.match(line)
    said = NAMES[(found[1] or found[2]).lower()] + 1 if found else 0
    rest = line[found.end():] if found else line
    length = 0 if not rest.strip() else 1 if len(rest) < 80 else 2 if len(rest) < 320 else 3
    return (said * 2 + rest.rstrip().endswith("?")) * 4 + length, found.end() if found else 0


@dataclass
class Hmm:
    """Log probabilities: ``start`` by state, ``move`` from state to state, ``show`` of each symbol by state."""

    start: np.ndarray
    move: np.ndarray
    show: np.ndarray

    def path(self, symbols: list[int], entry: int | None = None, exit: int | None = None) -> list[int]:
        """Likeliest states of a stretch, after state ``entry`` (none: at the start) and ending in ``exit`` (none: any)."""
        score = (self.start if entry is None else self.move[entry]) + self.show[:, symbols[0]]
        back = np.empty((len(symbols), STATES), np.int8)
        for i, s in enumerate(symbols[1:], 1):
            every = score[:, None] + self.move
            back[i] = every.argmax(0)
            score = every.max(0) + self.show[:, s]
        states = [int(score.argmax()) if exit is None else exit]
        for i in range(len(symbols) - 1, 0, -1):
            states.append(int(back[i, states[-1]]))
        return states[::-1]

    def bridge(self, symbols: list[int]) -> np.ndarray:
        """Best score from each state before a stretch (the last row: from the start) to each state at its end."""
        score = np.vstack([self.move, self.start]) + self.show[:, symbols[0]]
        for s in symbols[1:]:
            score = (score[:, :, None] + self.move[None]).max(1) + self.show[:, s]
        return score


def fit(rows: DataFrame) -> Hmm:
    """Counts on rows of ``conv_id, turn, role, text``, smoothed by one each. Rows of another role are left out."""
    number = F.create_map(*[x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(i))])
    known = rows.select("conv_id", "turn", number[F.col("role")].alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("role IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((STATES, SYMBOLS), np.int64)
        for part in slices(batches, "text"):
            for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist()):
                for i, line in enumerate(text.split("\n")):
                    seen[2 * role + (i > 0), symbol(line)[0]] += 1
        state, shown = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (state, shown, seen[state, shown])], names=["state", "shown", "times"])

    show = np.ones((STATES, SYMBOLS))
    for s, o, n in known.select("role", "text").mapInArrow(run, "state bigint, shown bigint, times bigint").groupBy("state", "shown").agg(F.sum("times")).collect():
        show[s, o] += n  # a row for each state and symbol
    follow, begin = np.ones((len(ROLES), len(ROLES))), np.ones(len(ROLES))
    turns = known.select("conv_id", "turn", "role")
    times = turns.groupBy("conv_id", "turn", "role").count()  # a turn that repeats is one row of the join
    after = times.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"), F.col("count").alias("next_count"))
    pairs = times.join(after, ["conv_id", "turn"]).groupBy("role", "next_role")
    for a, b, n in pairs.agg(F.sum(F.col("count").cast("double") * F.col("next_count"))).collect():
        follow[a, b] += n
    for r, n in turns.where("turn = 0").groupBy("role").count().collect():
        begin[r] += n
    follow, begin = follow / follow.sum(1, keepdims=True), begin / begin.sum()
    move, start = np.zeros((STATES, STATES)), np.zeros(STATES)
    start[::2] = begin
    lines = show.sum(1)
    for r in range(len(ROLES)):
        turns_of, more = lines[2 * r], lines[2 * r + 1]
        going = more / (turns_of + more)  # a line is followed by one of the same turn
        for s in (2 * r, 2 * r + 1):
            move[s, 2 * r + 1] = going
            move[s, ::2] = (1 - going) * follow[r]
    with np.errstate(divide="ignore"):
        return Hmm(np.log(start), np.log(move), np.log(show / show.sum(1, keepdims=True)))


OUT = "conv_id bigint, turn bigint, roles string, n_turns int, rendered string"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
COLUMNS = ["conv_id", "turn", "roles", "n_turns", "rendered"]


def _render(rows: list[tuple], hmm: Hmm, entry: int | None = None, exit: int | None = None) -> list[tuple]:
    """Rows ``(conv_id, turn, text)`` of one stretch with what was recovered."""
    lines = [text.split("\n") for _, _, text in rows]
    shown = [[symbol(x) for x in own] for own in lines]
    states = iter(hmm.path([s for own in shown for s, _ in own], entry, exit))
    out, last = [], None if entry is None else entry // 2
    for (conv, turn, _), own, marks in zip(rows, lines, shown):
        text, roles, turns = [], [], 0
        for line, (_, mark) in zip(own, marks):
            state = next(states)
            role = state // 2
            begins = state % 2 == 0 or role != last
            if begins:
                text.append(f"<|{ROLES[role]}|>")
                turns += 1
            if begins or not roles:
                roles.append(ROLES[role])
            text.append(line[mark:] if begins else line)
            last = role
        out.append((conv, turn, ",".join(roles), turns, "\n".join(text)))
    return out


def parse(rows: DataFrame, hmm: Hmm) -> DataFrame:
    """``conv_id, turn, roles, n_turns, rendered`` for every row: the roles that speak in it, the turns that begin in it, its canonical text."""
    spark = rows.sparkSession
    own = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ranged = own.repartitionByRange(shuffle_partitions(spark), "conv_id", "turn", "_tie").sortWithinPartitions("conv_id", "turn", "_tie", "text").drop("_tie")
    names, types = ["part", "stretch", "place", "bridge", "text", *COLUMNS], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), *TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def open_(held: list[tuple], stretch: int) -> pa.RecordBatch:
            bridge = hmm.bridge([symbol(x)[0] for _, _, text in held for x in text.split("\n")])
            rows = [(part, stretch, -1, bridge.tobytes(), None, held[0][0], None, None, None, None)]
            return out(rows + [(part, stretch, i, None, text, conv, turn, None, None, None) for i, (conv, turn, text) in enumerate(held)])

        held, stretch = [], 0
        for batch in slices(batches, "text"):
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
                if held and held[0][0] != row[0]:
                    if stretch:
                        done += [(part, stretch, None, None, None, *x) for x in _render(held, hmm)]
                    else:
                        yield open_(held, 0)
                    held, stretch = [], stretch + 1
                held.append(row)
            if done:
                yield out(done)
        if held:
            yield open_(held, stretch)

    found = cut(ranged.mapInArrow(run, f"part int, stretch int, place int, bridge binary, text string, {OUT}"), "transcripts")
    chain = found.where("place = -1").select("part", "stretch", "conv_id", "bridge").collect()  # two rows a range, at most
    chain.sort(key=lambda r: (r["part"], r["stretch"]))
    fixed, at = [], 0
    while at < len(chain):
        end = at + 1
        while end < len(chain) and chain[end]["conv_id"] == chain[at]["conv_id"]:
            end += 1
        score, backs = None, []
        for r in chain[at:end]:
            bridge = np.frombuffer(r["bridge"]).reshape(STATES + 1, STATES)
            every = bridge[-1:] if score is None else score[:, None] + bridge[:-1]
            backs.append(every.argmax(0))
            score = every.max(0)
        exit = int(score.argmax())
        for r, back in zip(chain[at:end][::-1], backs[::-1]):
            entry = None if r is chain[at] else int(back[exit])
            fixed.append((r["part"], r["stretch"], entry, exit))
            exit = entry
        at = end
    states = spark.createDataFrame(fixed, "part int, stretch int, entry int, exit int")

    def between(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("place", "conv_id", "turn", "text"))), key=lambda r: r[0])
        done = _render([r[1:] for r in rows], hmm, group.column("entry")[0].as_py(), group.column("exit")[0].as_py())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*done), TYPES)], names=COLUMNS)

    open_rows = found.where("place >= 0").select("part", "stretch", "place", "conv_id", "turn", "text").join(F.broadcast(states), ["part", "stretch"])
    return found.where("place IS NULL").select(*COLUMNS).unionByName(open_rows.groupBy("part", "stretch").applyInArrow(between, OUT))


def transcript(role: Column, conv: Column, turn: Column, text: Column) -> Column:
    """A row of a raw transcript as people keep them: the conversation's own style of marker, left out on every fifth turn."""
    style = F.pmod(F.xxhash64(conv), F.lit(4))
    speaker = F.when(role == "user", F.lit("Human")).when(role == "assistant", F.lit("AI")).otherwise(F.lit("System"))
    marked = (F.when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
              .when(style == 1, F.concat(speaker, F.lit("> ")))
              .when(style == 2, F.concat(F.lit("### "), F.initcap(role), F.lit(":\n")))
              .otherwise(F.concat(F.lit("["), role, F.lit("] "))))
    return F.concat(F.when(F.pmod(F.xxhash64(conv, turn), F.lit(5)) == 0, F.lit("")).otherwise(F.coalesce(marked, F.lit(""))), F.coalesce(text, F.lit("")))
