"""Hard negatives by anchor spanning-tree bounds, exact.

The score of a row is its inner product with an anchor. Anchors near each other score a row alike: with p the parent of
anchor c, the score under c lies within |c - p| * |x| of the score under p. So anchors are joined into trees, each edge
as short as possible; a tree's root scores every row, and from parent to child every row carries an interval that
holds its score. Only rows whose interval meets a window that the child asks for are scored; the others hand their
widened interval on. Two searches run so: the ``positives`` best rows of the anchor's own label, and then, between
two shares of each positive's score, the ``negatives`` best rows of other labels. Both windows rise while better rows
are found.

Rows and anchors are dealt by a hash into blocks and runs of bounded size, and a task holds one of each; what the blocks
found meets in windows limited on the map side. Every anchor meets every block: that is the stated query set against
all rows, and the work grows with their product.

Rows with a null label or vector take no part. Shorter vectors count as padded with zeros; an empty one scores 0. Scores
must fit 64-bit integers, otherwise the job says so and ends. Higher scores come first, ties by the smaller id, then null
ids. Rows that repeat are candidates each, and anchors that repeat give their results each. Fewer rows than asked for
give as many. Empty tables give no rows. Only the three named columns are read, so others may be called anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Rounds
from .common import shuffle_partitions

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's must lie.
LEAST_SHARE, MOST_SHARE = 30, 90
#: Rows in a block: enough blocks for all tasks, within these sizes. Anchors in a run.
BLOCK_LEAST, BLOCK_MOST, RUN = 1 << 10, 1 << 17, 1 << 14
#: Anchors in a tree, and rows that a tree looks at together.
TREE, CHUNK = 1 << 10, 1 << 10
EXACT = 2.0**52
NONE = np.iinfo(np.int64).min


def quantized(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each value as a long; null where a value is null or not finite."""
    value = lambda x: x.cast("double")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(value(x)) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(value(x) * scale).cast("bigint")))


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parent of each point in the shortest spanning tree (the root's is itself), and the points level by level."""
    n = len(points)
    squares, parent, depth = (points * points).sum(1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    far = np.full(n, np.inf)
    outside, at = np.ones(n, bool), 0
    for _ in range(n - 1):
        outside[at] = False
        near = squares + squares[at] - 2 * (points @ points[at])
        closer = outside & (near < far)
        far[closer], parent[closer] = near[closer], at
        at = int(np.where(outside, far, np.inf).argmin())
        depth[at] = depth[parent[at]] + 1
    return parent, depth


def groves(points: np.ndarray, most: int = TREE) -> list[np.ndarray]:
    """The points dealt to trees of at most ``most``, neighbours along the widest direction together."""
    if len(points) <= most:
        return [np.arange(len(points))]
    centred = points - points.mean(0)
    along = centred @ np.linalg.svd(centred[:: max(1, len(points) // 4096)], full_matrices=False)[2][0]
    order = np.argsort(along, kind="stable")
    return [order[i:i + most] for i in range(0, len(order), most)]


class Best:
    """The best ``k`` rows for each of some places: pairs (score, number), higher scores first, then lower numbers."""

    def __init__(self, places: int, k: int):
        self.k, self.size = k, np.zeros(places, np.int64)
        self.score, self.row = np.full((places, k), NONE), np.zeros((places, k), np.int64)

    @property
    def bar(self) -> np.ndarray:
        """The score of each place's last row, which a later one must exceed."""
        return self.score[:, -1]

    def offer(self, place: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Rows must be offered in rising order of their numbers, so that one equal to the bar comes too late."""
        touched = np.unique(place)
        there, slot = np.nonzero(np.arange(self.k) < self.size[touched, None])
        place = np.concatenate([touched[there], place])
        score, row = np.concatenate([self.score[touched[there], slot], score]), np.concatenate([self.row[touched[there], slot], row])
        order = np.lexsort((row, -score, place))
        place, score, row = place[order], score[order], row[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sizes = np.diff(np.append(first, len(place)))
        nth = np.arange(len(place)) - np.repeat(first, sizes)
        held = nth < self.k
        self.score[place[held], nth[held]], self.row[place[held], nth[held]] = score[held], row[held]
        self.size[place[first]] = np.minimum(sizes, self.k)


class Grove:
    """One tree of anchors, which finds for each of its windows the best rows of a block."""

    def __init__(self, anchors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """Window w belongs to anchor ``owner[w]`` and asks for scores from ``low[w]`` to ``high[w]``."""
        order = np.argsort(owner, kind="stable")
        self.anchors, self.points, self.k = anchors, anchors.astype(np.float64), k
        self.owner, self.low, self.high, self.window = owner[order], low[order], high[order], order
        self.parent, depth = spanning_tree(self.points)
        edge = np.sqrt(((self.points - self.points[self.parent]) ** 2).sum(1))
        by_level = np.argsort(depth, kind="stable")
        self.levels = np.split(by_level, np.flatnonzero(np.diff(depth[by_level])) + 1)
        self.edge = edge * (1 + 1e-9) + 1e-9
        self.starts = np.searchsorted(self.owner, np.arange(len(anchors) + 1))
        self.best = Best(len(owner), k)
        self.scored = 0

    def _scores(self, anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return np.rint(anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
        return anchors @ rows.T

    def search(self, rows: np.ndarray, numbers: np.ndarray, allowed) -> None:
        """``rows`` in rising order of ``numbers``; ``allowed(anchor numbers)`` says which rows each may return."""
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        reach = np.sqrt((self.points ** 2).sum(1).max()) * lengths.max(initial=0)
        if reach > 9e18:
            raise ValueError("inner products of these vectors do not fit 64-bit integers")
        slack = 1e-9 * reach + 1e-6
        held_low = held_high = place = None
        for level in self.levels:
            if place is None:
                may = np.ones((len(level), len(rows)), bool)
                low = high = np.zeros(may.shape)
            else:
                above = place[self.parent[level]]
                widen = self.edge[level, None] * lengths[None, :] + slack
                low, high = held_low[above] - widen, held_high[above] + widen
                may = np.zeros(low.shape, bool)
                for nth in range(int(np.diff(self.starts)[level].max(initial=0))):
                    at = self.starts[level] + nth
                    has = np.flatnonzero(at < self.starts[level + 1])
                    w = at[has]
                    least = np.maximum(self.low[w], self.best.bar[w]).astype(np.float64)
                    may[has] |= (high[has] >= least[:, None]) & (low[has] <= self.high[w].astype(np.float64)[:, None])
                may &= allowed(level)
            asked = np.flatnonzero(may.any(0))
            low, high = low.copy(), high.copy()
            if len(asked):
                scores = self._scores(self.anchors[level], rows[asked], reach < EXACT)
                self.scored += int(may.sum())
                inner = may[:, asked]
                if place is None:
                    inner = inner & allowed(level)[:, asked]
                low[:, asked] = np.where(may[:, asked], scores, low[:, asked])
                high[:, asked] = np.where(may[:, asked], scores, high[:, asked])
                self._offer(level, scores, inner, numbers[asked])
            held_low, held_high = low, high
            place = np.zeros(len(self.anchors), np.int64)
            place[level] = np.arange(len(level))

    def _offer(self, level: np.ndarray, scores: np.ndarray, inner: np.ndarray, numbers: np.ndarray) -> None:
        for nth in range(int(np.diff(self.starts)[level].max(initial=0))):
            at = self.starts[level] + nth
            has = np.flatnonzero(at < self.starts[level + 1])
            w = at[has]
            own = scores[has]
            fits = inner[has] & (own >= self.low[w][:, None]) & (own <= self.high[w][:, None]) & (own > self.best.bar[w][:, None])
            if fits.sum() > 4 * self.k * len(w) and own.shape[1] > self.k:  # the kth best here is a bar already
                bar = np.partition(np.where(fits, own, NONE), own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k]
                fits &= own >= bar[:, None]
            anchor, row = np.nonzero(fits)
            if len(anchor):
                self.best.offer(w[anchor], own[anchor, row], numbers[row])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, score and row number of all that stand."""
        place, nth = np.nonzero(np.arange(self.k) < self.best.size[:, None])
        return self.window[place], self.best.score[place, nth], self.best.row[place, nth]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of longs, padded with zeros to ``width``."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(whole), width), np.int64)
    sizes = np.diff(whole.offsets.to_numpy())
    out[np.arange(width)[None, :] < sizes[:, None]] = whole.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(t.column("x").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables if t.num_rows), default=0)


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


FOUND = "anchor bigint, mark bigint, window bigint, score bigint, id bigint"
FOUND_TYPES = [pa.int64()] * 5


def _searched(block: pa.Table, run: pa.Table, windows, same: bool, k: int) -> pa.Table:
    """The best rows of a block for every window of a run of anchors; ``windows(run)`` gives owner, low and high."""
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    parts = []
    if block.num_rows and run.num_rows:
        width = _width(block, run)
        rows, anchors = matrix(block.column("x"), width), matrix(run.column("x"), width)
        label, anchor_label = _labels(block.column("label")), _labels(run.column("label"))
        ids = block.column("id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(), ~known))  # null ids last
        owner, low, high = windows(run)
        if same:  # an anchor sees its own label alone
            kinds = [(anchor_label == v, order[label[order] == v]) for v in np.unique(anchor_label)]
        else:
            kinds = [(np.ones(len(anchors), bool), order)]
        for mine, numbers in kinds:
            mine = np.flatnonzero(mine & (np.bincount(owner, minlength=len(anchors)) > 0))
            if not len(mine) or not len(numbers):
                continue
            for part in groves(anchors[mine].astype(np.float64)):
                tree = mine[part]
                back = np.full(len(anchors), -1)
                back[tree] = np.arange(len(tree))
                own = np.flatnonzero(back[owner] >= 0)
                grove = Grove(anchors[tree], back[owner[own]], low[own], high[own], k)
                for at in range(0, len(numbers), CHUNK):
                    chunk = numbers[at:at + CHUNK]
                    tags = label[chunk]
                    allowed = lambda level: (anchor_label[tree][level][:, None] == tags[None, :]) == same  # noqa: B023, E731
                    grove.search(rows[chunk], np.arange(at, at + len(chunk)), allowed)
                window, score, number = grove.found()
                w = own[window]
                parts.append((owner[w], w, score, numbers[number]))
        if parts:
            anchor, window, score, number = (np.concatenate(c) for c in zip(*parts))
            value = run.column("positive").combine_chunks().flatten() if not same else None
            return pa.table([run.column("id").combine_chunks().take(pa.array(anchor)), run.column("mark").combine_chunks().take(pa.array(anchor)),
                             pa.array(np.zeros(len(anchor), np.int64)) if same else value.take(pa.array(window)), pa.array(score), ids.take(pa.array(number))], names=names)
    return pa.table([pa.array([], t) for t in FOUND_TYPES], names=names)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_SHARE, most: int = MOST_SHARE,
         block: int | None = None, run: int = RUN) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; both tables have ``id, label, x`` (longs)."""
    spark = rows.sparkSession
    rounds, parts = Rounds(spark, "negatives"), shuffle_partitions(spark)
    whole = lambda df: df.where("label IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL)").select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "x")
    mark = F.xxhash64("label", "x").alias("mark")  # tells apart anchors of one id
    known = rounds.keep(whole(rows), "rows")
    asked = rounds.keep(whole(anchors).groupBy("id", "label", "x").agg(F.count("*").alias("copies")).withColumn("mark", mark), "anchors")
    n_rows, n_anchors = known.count(), asked.count()
    size = block or min(max(-(-n_rows // (2 * parts)), BLOCK_LEAST), BLOCK_MOST)
    blocks, runs = max(1, -(-n_rows // size)), max(1, -(-n_anchors // run))
    groups = min(blocks * runs, 8 * parts)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = known.select(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int").alias("block"), each(runs).alias("run"), "id", "label", "x")
    here = here.repartition(groups, "block", "run").groupBy("block", "run")

    def search(asking: DataFrame, windows, same: bool, k: int) -> DataFrame:
        dealt = asking.select(each(blocks).alias("block"), F.pmod(F.xxhash64("id", "mark", F.lit(1)), F.lit(runs)).cast("int").alias("run"), "*")
        return here.cogroup(dealt.repartition(groups, "block", "run").groupBy("block", "run")).applyInArrow(lambda a, b: _searched(a, b, windows, same, k), FOUND)

    def everything(run: pa.Table):
        n = run.num_rows
        return np.arange(n), np.full(n, NONE + 1), np.full(n, np.iinfo(np.int64).max)

    def shares(run: pa.Table):
        scores = run.column("positive").combine_chunks()
        owner = np.repeat(np.arange(run.num_rows), np.diff(scores.offsets.to_numpy()))
        p = [int(v) for v in scores.flatten().to_pylist()]
        return owner, np.array([-(-least * v // 100) for v in p], np.int64), np.array([most * v // 100 for v in p], np.int64)

    better = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    best = lambda found, k, *by: found.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*better))).where(F.col("nth") <= k)
    key = ["anchor", "mark"]
    # one more than asked for, as an anchor meets itself
    near = best(search(asked.select("id", "mark", "label", "x"), everything, True, positives + 1), positives + 1, *key)
    listed = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))).alias("tops"))
    own_score = F.aggregate("x", F.lit(0).cast("bigint"), lambda s, v: s + v * v)
    met = asked.join(listed, (F.col("anchor").eqNullSafe(F.col("id"))) & (asked["mark"] == listed["mark"])).select(asked["id"], asked["mark"], "label", "x", "copies", "tops", own_score.alias("own"))
    itself = F.array_position(F.transform("tops", lambda t: (t["score"] == F.col("own")) & t["id"].eqNullSafe(F.col("id"))), True)
    others = F.slice(F.filter("tops", lambda t, i: i + 1 != F.col("self")), 1, positives)
    chosen = rounds.keep(met.withColumn("self", itself).select("id", "mark", "label", "x", "copies", others.alias("others")), "positives")
    worth = F.array_sort(F.array_distinct(F.filter(F.transform("others", lambda t: t["score"]), lambda s: s >= 0)))
    found = search(chosen.select("id", "mark", "label", "x", worth.alias("positive")).where(F.size("positive") > 0), shares, False, negatives)
    hard = best(found, negatives, *key, "window").select("anchor", "mark", F.col("window").alias("positive_score"), F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = chosen.select(F.col("id").alias("anchor"), "mark", F.explode("others").alias("positive"), "copies").select(
        "anchor", "mark", F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return pairs.join(hard, ["anchor", "mark", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (SELECT a.rid AS aid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM kept a, kept b WHERE a.vec_id % 100 = 0 AND a.rid <> b.rid),
positives AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) AS n FROM scores WHERE same QUALIFY n <= {POSITIVES}),
pairs AS (SELECT p.aid, p.rid AS pid, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score
  FROM positives p JOIN scores s ON s.aid = p.aid AND NOT s.same AND {LEAST_SHARE} * p.score <= 100 * s.score AND 100 * s.score <= {MOST_SHARE} * p.score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY aid, pid ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM pairs QUALIFY rank <= {NEGATIVES}"""
