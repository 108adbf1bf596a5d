"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A document's score is the sum of the weights of its features; grade j or less has probability F(threshold_j - score), with
F the logistic function and the thresholds in order. All grades share the weights. Features are words, word beginnings,
trailing symbols and a few bands of shape (repetition, symbols, digits, length), each hashed once per document.

The model is fitted on a bounded sample of the graded rows, ``sample`` at most, chosen by the hash of their id; the
driver holds only their hashed features. Features seen in fewer than ``least_rows`` sampled rows get no weight. Every
document is scored in one pass, whole.

Null texts count as empty and have the shape features only. Rows whose grade is null are not fitted. Without any graded
row the weights are zero and every document has the middle grade and tail probability 1/2. Rows that repeat are scored
alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import extended, packed, slices, unpacked

BITS = 22
SAMPLE = 12_000
LEAST_ROWS = 6
ROUNDS = 120
RIDGE = 1e-3
GRADES = 3
#: Below an even chance: doubt speaks for the document.
LEAST_TAIL = 0.35
MEMO = 200_000
EDGE = ".,;:!?\"'()[]"


class Features:
    """Hashed features of texts; what a word contributes is remembered, up to ``MEMO`` words."""

    def __init__(self, bits: int = BITS):
        self.mask = (1 << bits) - 1
        self.memo: dict[str, tuple[int, ...]] = {}

    def _hash(self, kind: str, value: str) -> int:
        return xxhash.xxh3_64_intdigest(f"{kind}:{value}") & self.mask

    def _word(self, token: str) -> tuple[int, ...]:
        bare = token.strip(EDGE)
        out = [self._hash("word", bare), self._hash("begin", bare[:5])] if bare else []
        body = bare.rstrip("#$%&*+-/<=>@\\^_`|~")
        if body != bare or not bare:
            out.append(self._hash("symbols", bare[len(body):] or token))
        return tuple(out)

    def _shape(self, text: str, tokens: list[str], distinct: int) -> list[int]:
        n, chars = len(tokens), max(1, len(text))
        letters = sum(map(len, tokens)) or 1
        symbols = sum(text.count(c) for c in "#$%&*+=<>@^|~{}")
        lines = text.split("\n")
        bands = {
            "distinct": int(20 * distinct / max(1, n)) if n >= 8 else -1, "wordlength": min(30, letters // max(1, n)), "symbols": min(20, int(100 * symbols / chars)),
            "digits": min(20, int(50 * sum(text.count(c) for c in "0123456789") / chars)), "words": n.bit_length(),
            "lines": int(10 * len(set(lines)) / len(lines)) if len(lines) >= 4 else -1,
        }
        return [self._hash(k, str(v)) for k, v in bands.items()]

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        tokens = text.lower().split()
        distinct = set(tokens)
        memo, found = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        for token in distinct:
            own = memo.get(token)
            if own is None:
                own = memo[token] = self._word(token)
            found.update(own)
        found.update(self._shape(text, tokens, len(distinct)))
        return np.fromiter(found, np.int32, len(found))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights by hashed feature, and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Probability of a grade above each threshold, one column each."""
        return logistic(scores[:, None] - self.thresholds[None, :])


def fit_rows(indices: np.ndarray, sizes: np.ndarray, grades: np.ndarray, bits: int = BITS, levels: int = GRADES, least_rows: int = LEAST_ROWS, rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam over all sampled rows."""
    dense = np.zeros(1 << bits, np.float32)
    if not len(grades):
        return Model(dense, np.linspace(0, 0, levels - 1))
    seen = np.bincount(indices, minlength=1 << bits)
    used = np.flatnonzero(seen >= least_rows)
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    row, column = np.repeat(np.arange(len(grades), dtype=np.int32), sizes), place[indices]
    row, column = row[column >= 0], column[column >= 0]
    del place, seen
    share = np.bincount(grades, minlength=levels) / len(grades)
    upto = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    first = np.log(upto / (1 - upto))
    x = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v, cut = np.zeros_like(x), np.zeros_like(x), len(used)
    known = np.concatenate([[0], np.ones(levels - 1), [0]])
    for step in range(1, rounds + 1):
        gaps = np.exp(x[cut + 1:])
        thresholds = x[cut] + np.append(0, np.cumsum(gaps))
        score = np.bincount(row, x[column], len(grades))
        below = logistic(np.concatenate([[-np.inf], thresholds, [np.inf]])[None, :] - score[:, None])
        below[:, 0], below[:, -1] = 0, 1
        slope = below * (1 - below) * known
        here = np.arange(len(grades))
        chance = np.maximum(below[here, grades + 1] - below[here, grades], 1e-9)
        by_score = (slope[here, grades + 1] - slope[here, grades]) / chance / len(grades)
        by_threshold = np.zeros(levels + 1)
        np.add.at(by_threshold, grades + 1, -slope[here, grades + 1] / chance / len(grades))
        np.add.at(by_threshold, grades, slope[here, grades] / chance / len(grades))
        inner = by_threshold[1:-1]
        gradient = np.concatenate([np.bincount(column, by_score[row], cut) + ridge * x[:cut], [inner.sum()], [inner[i:].sum() * g for i, g in enumerate(gaps, 1)]])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    dense[used] = x[:cut]
    return Model(dense, x[cut] + np.append(0, np.cumsum(np.exp(x[cut + 1:]))))


def grade(quality: Column, toxic: Column) -> Column:
    """The rating that two labels give: 0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2).cast("int")


def fit(docs: DataFrame, rated: DataFrame, sample: int = SAMPLE, bits: int = BITS, id: str = "doc_id", text: str = "text") -> Model:
    """A model from the graded documents; of more than ``sample`` of them, those whose ids hash lowest."""
    known = rated.where(F.col("grade").isNotNull()).select(F.col(id).alias("_rated"), "grade")
    lowest = known.groupBy("_rated").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("_rated"), "_rated").limit(sample)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(lowest), F.col("_id") == F.col("_rated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for part in slices(batches, "text"):
            held = [features(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(held, pa.binary())], names=["grade", "features"])

    held = rows.select("grade", "text").mapInArrow(run, "grade int, features binary").toArrow()
    lists = [np.frombuffer(x, np.int32) for x in held.column("features").to_pylist()]
    indices = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    sizes, grades = np.fromiter(map(len, lists), np.int64, len(lists)), held.column("grade").to_numpy().astype(np.int64)
    del held, lists
    return fit_rows(indices, sizes, grades, bits)


def score(docs: DataFrame, model: Model, bits: int = BITS, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``expected_grade`` and ``tail``, the probability of the highest grade.

    Columns of ``docs`` by these three names are replaced; ``select`` keeps them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2^bits weights, whatever the data

    def make():
        features, own = Features(bits), Model(*shared.value)

        def work(texts: list[str | None]) -> list[np.ndarray]:
            scores = np.array([own.weights[features(t)].sum(dtype=np.float64) for t in texts])
            tails = own.tails(scores)
            return [scores, tails.sum(1), tails[:, -1]]

        return work

    return extended(docs, text, {c: (DoubleType(), pa.float64()) for c in ("score", "expected_grade", "tail")}, make)


def select(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL, text: str = "text") -> DataFrame:
    """The documents that deserve the highest grade with a probability of ``least_tail`` or more by the model."""
    rated = score(packed(docs, text, text=F.col(text)), model).where(F.col("tail") >= least_tail)
    return unpacked(rated, docs, **{text: F.col("text")})
