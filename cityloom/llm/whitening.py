"""Embedding whitening by a bidiagonal qd solver.

Every different vector counts once. Its rows, less the exact mean, are reduced block by block to a triangle R with the same
R'R (blockwise QR; triangles meet in groups until few are left). Householder steps turn R into a bidiagonal B and the
rotation from the right. The qd algorithm with shifts (dqds) works on the squares of B and finds every singular value to
high relative accuracy. The direction of a singular value comes from the twisted factorization of B'B less its square,
which meets in the place where the value lies loosest, and is turned back to the space of the vectors.

What the driver holds is triangles and sums: some tens of squares of the dimension, whatever the rows. Sums of integers
are exact. The whitened fit list is measured in one more pass, which gives the reported error.

Rows with a null vector, or a null in it, take no part. Shorter vectors count as padded with zeros. Rows that repeat are
answered each and fitted once. Directions without spread (fewer different vectors than dimensions, or one vector) have
``explained`` 0 and no whitened value; without any spread ``explained`` and the error are null as well. A deviation
beyond 64 bits is null. Empty tables and empty vectors give no rows. Rows of a null id are answered like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Rounds
from .negatives import matrix

COMPONENTS = 4
#: Rows factored at a time, and triangles that one task joins.
BLOCK, FAN = 4096, 32
EPS = float(np.finfo(np.float64).eps)
TINY = 1e-290
MOST = 2**63 - 1


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V with ``square = U B V'``, by Householder reflections from both sides in turn."""
    a, n = square.astype(np.float64).copy(), len(square)
    v = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        """The unit vector whose reflection leaves of ``x`` its first entry alone."""
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        w = x.copy()
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w)

    for i in range(n):
        if (w := mirror(a[i:, i])) is not None:
            a[i:, i:] -= 2 * np.outer(w, w @ a[i:, i:])
        if i + 2 < n and (w := mirror(a[i, i + 1:])) is not None:
            a[i:, i + 1:] -= 2 * np.outer(a[i:, i + 1:] @ w, w)
            v[:, i + 1:] -= 2 * np.outer(v[:, i + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform with a shift; none if the shift was too large."""
    d, out_q, out_e = q[0] - shift, [], []
    for k, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        ratio = q[k + 1] / top if top > 0 else 0.0
        out_q.append(top)
        out_e.append(off * ratio)
        d = d * ratio - shift if top > 0 else q[k + 1] - shift
    return None if d < 0 else ([*out_q, d], out_e)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of a bidiagonal matrix, falling."""
    found, todo = [], [((diagonal * diagonal).tolist(), (above * above).tolist(), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while len(q) > 1:
            small = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1])) or e[k] <= TINY), None)
            if small is not None:  # two parts that no longer touch
                todo.append((q[:small + 1], e[:small], moved))
                q, e = q[small + 1:], e[small + 1:]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = max(0.0, min(q[-1], min(q)) * (1 - 4 * EPS) - e[-1]) if e[-1] < q[-1] / 4 else 0.0
            while (step := qd_step(q, e, shift)) is None:
                shift = shift / 4 if shift > TINY else 0.0
            q, e = step
            moved += shift
        found.append(moved + q[0])
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B at ``value``, from its factorizations from the top and from the bottom."""
    n = len(diagonal)
    floor = EPS * max(np.abs(diagonal).max(), TINY)
    a = np.where(np.abs(diagonal) < floor * EPS, floor * EPS, diagonal)
    d, low = a * a, above / a[:-1]
    for _ in range(3):
        s, p = np.empty(n), np.empty(n)
        down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
        s[0] = -value
        for i in range(n - 1):
            pivot = s[i] + d[i]
            pivot = pivot if abs(pivot) > TINY else TINY
            down[i] = d[i] * low[i] / pivot
            s[i + 1] = down[i] * low[i] * s[i] - value
        p[-1] = d[-1] - value
        meet = np.empty(n)
        meet[-1] = s[-1] + d[-1]
        for i in range(n - 2, -1, -1):
            pivot = d[i] * low[i] * low[i] + p[i + 1]
            pivot = pivot if abs(pivot) > TINY else TINY
            ratio = d[i] / pivot
            up[i] = low[i] * ratio
            meet[i] = s[i] + ratio * p[i + 1]
            p[i] = p[i + 1] * ratio - value
        at = int(np.abs(meet).argmin())
        z = np.zeros(n)
        z[at] = 1.0
        for i in range(at - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(at, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = float(z @ z)
        change = meet[at] / size
        value += change
        if abs(change) <= 2 * EPS * abs(value):
            break
    return z / np.sqrt(size)


def directions(triangle: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values and, as columns, the directions that belong to them.

    Where B falls apart each part is solved by itself. Directions of values too close to tell apart by their factorizations
    are made orthogonal, and one lost to its neighbours is found again by inverse iteration in what is left.
    """
    n = len(triangle)
    scale = np.abs(triangle).max(initial=0)
    if not scale:
        return np.zeros(min(most, n)), np.eye(n)[:, :most]
    diagonal, above, v = bidiagonal(triangle / scale)
    limit = EPS * np.abs(np.append(diagonal, above)).max()
    cuts = [0, *(np.flatnonzero(np.abs(above) <= limit * EPS) + 1).tolist(), n]
    pairs = []
    for x, y in zip(cuts, cuts[1:]):
        part = diagonal[x:y], above[x:y - 1]
        pairs += [(value, x, y) for value in dqds(*part)]
    pairs.sort(key=lambda p: (-p[0], p[1]))
    values, chosen = [], []
    for value, x, y in pairs[:most]:
        z = np.zeros(n)
        z[x:y] = twisted(diagonal[x:y], above[x:y - 1], value)
        for attempt in range(3):
            whole = np.linalg.norm(z)
            for _ in range(2):
                for other in chosen:
                    z -= (other @ z) * other
            if np.linalg.norm(z) > 0.5 * whole:
                break
            square = np.diag(diagonal[x:y] ** 2 + np.append(0, above[x:y - 1] ** 2))
            off = diagonal[x:y - 1] * above[x:y - 1]
            square[np.arange(y - x - 1), np.arange(1, y - x)] = square[np.arange(1, y - x), np.arange(y - x - 1)] = off
            start = np.random.default_rng(attempt).normal(size=n)
            for other in chosen:
                start -= (other @ start) * other
            z[:] = 0
            z[x:y] = np.linalg.solve(square - (value + EPS * pairs[0][0] * (attempt + 1)) * np.eye(y - x), start[x:y])
            z /= np.linalg.norm(z)
        chosen.append(z / np.linalg.norm(z))
        values.append(value * scale * scale)
    turned = v @ np.array(chosen).T
    lead = np.take_along_axis(turned, np.abs(turned).argmax(0)[None, :], 0)[0]
    return np.array(values), turned * np.where(lead < 0, -1.0, 1.0)


def triangle(rows: Iterator[np.ndarray], width: int) -> np.ndarray:
    """R of all rows, block by block."""
    r = np.zeros((0, width))
    for block in rows:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def _centred(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield matrix(batch.column("x").slice(at, BLOCK), len(mean)) - mean


def _sums(x: pa.Array, width: int) -> list[int]:
    """Exact column sums: the halves of each number are summed apart."""
    rows = matrix(x, width)
    return [(int(a) << 32) + int(b) for a, b in zip((rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0))]


class Fit:
    """Number of different vectors, their sums, the largest ``components`` values and directions, the trace, and the error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, turned: np.ndarray, trace: float):
        self.n, self.sums, self.trace, self.error = n, sums, trace, None
        self.mean = np.array([s / n for s in sums])
        self.values = values
        self.spread = values > EPS * len(sums) * (values[0] if len(values) else 0)
        self.project = turned[:, self.spread] / np.sqrt(values[self.spread])


def fit(distinct: DataFrame, width: int, components: int, rounds: Rounds) -> Fit | None:
    """What whitening needs from a written table of different vectors ``x`` of up to ``width`` entries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * width
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows += len(batch.column("x").slice(at, BLOCK))
                total = [a + b for a, b in zip(total, _sums(batch.column("x").slice(at, BLOCK), width))]
        numbers = [rows, *total]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([v >> 32 for v in numbers], pa.int64()), pa.array([v & 0xFFFFFFFF for v in numbers], pa.int64())], names=["at", "high", "low"])

    added = {r["at"]: (r["high"] << 32) + r["low"] for r in distinct.mapInArrow(add, "at int, high bigint, low bigint")
             .groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}  # a number per dimension
    n, sums = added.get(0, 0), [added.get(i + 1, 0) for i in range(width)]
    if not n:
        return None
    mean = np.array([s / n for s in sums])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle(_centred(batches, mean), width)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def join(group: pa.Table) -> pa.Table:
        parts = (np.frombuffer(b).reshape(-1, width) for b in group.column("r").to_pylist())
        return pa.table([pa.array([triangle(parts, width).tobytes()], pa.binary())], names=["r"])

    triangles = rounds.keep(distinct.mapInArrow(own, "r binary"), "triangles")
    while (left := triangles.count()) > FAN:
        keyed = triangles.withColumn("deal", F.pmod(F.xxhash64("r"), F.lit(-(-left // (FAN // 2)))))
        triangles = rounds.keep(keyed.groupBy("deal").applyInArrow(join, "r binary"), "triangles")
        rounds.drop("triangles", 1)
    parts = [np.frombuffer(r["r"]).reshape(-1, width) for r in triangles.collect()]  # at most FAN triangles
    whole = triangle(iter(parts), width)
    whole = np.vstack([whole, np.zeros((width - len(whole), width))])
    values, turned = directions(whole, components)
    found = Fit(n, sums, values / n, turned, float((whole * whole).sum() / n))
    project, mean = found.project, found.mean

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = project.shape[1]
        total = np.zeros((k, k + 1))
        for block in _centred(batches, mean):
            white = block @ project
            total += np.hstack([white.T @ white, white.sum(0)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    if project.shape[1]:
        k = project.shape[1]
        total = np.zeros(k * (k + 1))
        for r in distinct.mapInArrow(measure, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            total[r["at"]] = r["value"] / n
        second, first = total.reshape(k, k + 1)[:, :k], total.reshape(k, k + 1)[:, k]
        found.error = float(np.abs(second - np.outer(first, first) - np.eye(k)).max())
    return found


def whiten(rows: DataFrame, components: int = COMPONENTS, id: str = "id", vector: str = "x") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each row and component; vectors are longs."""
    rounds = Rounds(rows.sparkSession, "whitening")
    kept = rows.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("x")).where("x IS NOT NULL AND forall(x, v -> v IS NOT NULL)")
    out = f"`{id}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = [id, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    least, width = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not width:
        return rows.sparkSession.createDataFrame([], out)
    if least < width:
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))))
    found = fit(rounds.keep(kept.select("x").distinct(), "different"), width, components, rounds)
    n, sums, mean, project = found.n, found.sums, found.mean, found.project
    shown, spread, count = found.values / found.trace if found.trace else None, np.flatnonzero(found.spread), min(components, width)
    error = found.error

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = max(n * max(-int(x.min()), int(x.max()), 0) + max(map(abs, sums)), 1)
        if reach * reach * width <= MOST:
            gap = n * x - np.array(sums)
            return (gap * gap).sum(1).tolist()
        exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
        return [v if v <= MOST else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, m = matrix(part.column("x"), width), part.num_rows
                white = np.full((m, count), np.nan)
                white[:, spread] = (x - mean) @ project
                order = pa.array(np.repeat(np.arange(m), count))
                flat = white.ravel()
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(order), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n, np.int64)),
                    pa.array(deviations(x), types[3]).take(order), pa.array(flat, types[4], mask=np.isnan(flat)),
                    pa.nulls(m * count, types[5]) if shown is None else pa.array(np.tile(np.where(found_spread, shown, 0.0), m), types[5]),
                    pa.array([error] * (m * count), types[6])], names=names)

    found_spread = found.spread
    return kept.mapInArrow(run, out)
