"""Connected regions of cells and of graphs, flat zones, and what is counted per region.

Inside a tile a region is found with numpy; across tiles only one pair of labels per touching pair of regions is left,
and those are joined until nothing changes. A region that covers a third of the map is one label per tile, never one
group of cells: everything that needs a whole region is first summed per tile-local label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .focal import TILE, Patch, tile_map

HALF = 1 << 31
WIDE = 1 << 32


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by hooking larger roots to smaller and jumping pointers."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if np.array_equal(lo, hi):
            return parent
        np.minimum.at(parent, hi, lo)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped


def _label_patch(p: Patch, value: str, gap: float | None) -> np.ndarray:
    """Local region label (smallest cell id) of every valued cell; ``gap`` joins unequal values nearer than it.

    Cells joined along a row form a run; runs of neighbouring rows that touch are then joined.
    """
    v = p[value]
    known = ~np.isnan(v)
    if not known.any():
        return np.zeros(v.shape, dtype=np.int64)
    alike = np.equal if gap is None else lambda one, other: np.abs(one - other) < gap
    heads = known.copy()
    heads[:, 1:] &= ~alike(v[:, 1:], v[:, :-1])
    run = np.cumsum(heads).reshape(v.shape) - 1
    touching = alike(v[1:], v[:-1])
    above, below = np.unique(np.stack([run[:-1][touching], run[1:][touching]]), axis=1)
    ys, xs = np.nonzero(heads)
    first_cell = (ys + p.y0) * WIDE + (xs + p.x0 + HALF)
    return np.where(known, first_cell[_union(len(ys), above, below)][np.maximum(run, 0)], 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected graph, the root being the component's smallest node.

    Each round every node hooks to its smallest neighbour, pointers jump twice, and the graph is contracted, so the
    rounds grow with the logarithm of the graph. Every round is written and read back; it ends when no edge is left.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    live = cut(edges.select(low.alias("u"), high.alias("v")).where("u < v").distinct(), "edges")
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("root")), "labels")
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "hook")
        for _ in range(2):
            further = hooked.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hooked = hooked.join(further, "p").select("u", F.col("pp").alias("p"))
        hooked = cut(hooked, "jump")
        labels = cut(labels.join(hooked.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        left, right = hooked.select("u", F.col("p").alias("pu")), hooked.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = live.join(left, "u").join(right, "v")
        live = cut(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u < v").distinct(), "edges")
    return labels


def label_regions(cells: DataFrame, value: str, gap: float | None = None, tile: int = TILE) -> DataFrame:
    """Edge-connected regions of equal (or, with ``gap``, nearly equal) numeric value.

    Adds ``local_label``, the region's part inside one tile, and ``label``, the whole region; both are the smallest
    cell id of what they name.
    """
    def kernel(p: Patch):
        return ~np.isnan(p[value]), {value: p[value], "local_label": _label_patch(p, value, gap)}

    local = cut(tile_map(cells, [value], 0, kernel, {value: "double", "local_label": "bigint"}, tile), "regions")
    seams = []
    for along, across in (("cx", "cy"), ("cy", "cx")):
        side = F.pmod(F.col(along), F.lit(tile))
        here = local.where(side == tile - 1).select((F.col(along) + 1).alias(along), across, F.col(value).alias("va"), F.col("local_label").alias("a"))
        there = local.where(side == 0).select(along, across, F.col(value).alias("vb"), F.col("local_label").alias("b"))
        match = F.col("va") == F.col("vb") if gap is None else F.abs(F.col("va") - F.col("vb")) < gap
        seams.append(here.join(there, [along, across]).where(match).select("a", "b"))
    roots = connected_components(seams[0].union(seams[1]).distinct())
    return local.join(roots.withColumnRenamed("node", "local_label"), "local_label", "left").select(
        "cx", "cy", value, "local_label", F.coalesce("root", "local_label").alias("label"))


def region_totals(labelled: DataFrame, **totals) -> DataFrame:
    """Sums per region for each tile-local label: ``totals`` are summable expressions over the cells."""
    local = labelled.groupBy("local_label", "label").agg(*[F.sum(e).alias(n) for n, e in totals.items()])
    whole = local.groupBy("label").agg(*[F.sum(n).alias(n) for n in totals])
    return local.select("local_label", "label").join(whole, "label")


def vegetated_ground(cells: DataFrame, cls: str = "cls", tile: int = TILE) -> DataFrame:
    """Vegetated ground: classes 1 and 2, and bare soil (3) in a region that is more than half vegetation."""
    veg = F.col(cls).isin(1, 2)
    field = label_regions(cells.where(F.col(cls).isin(1, 2, 3)).select("cx", "cy", F.lit(1.0).alias("field")), "field", tile=tile)
    keyed = field.join(cells.select("cx", "cy", cls), ["cx", "cy"])
    share = region_totals(keyed, green=veg.cast("int"), size=F.lit(1))
    green = veg | (F.col("green") > F.col("size") * 0.5)
    return keyed.join(share.select("local_label", "green", "size"), "local_label").where(green).select("cx", "cy", cls)


def _zone_ranges(key: np.ndarray, z: np.ndarray, rise: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of each cell's zone; ``key`` is sorted and grows by one along a row, by ``WIDE`` per row.

    Neighbours join by smallest difference, ties in order of place, unless their zones would then span ``rise``. A pair
    that comes first among all pending pairs of both its zones can be settled at once, as no earlier pair touches
    either; so every round settles all such pairs together and drops those that can never join. Cells of one value
    form a zone before the first round.
    """
    pairs = []
    for k, step in enumerate((1, WIDE)):
        at = np.searchsorted(key, key + step)
        has = np.flatnonzero(np.take(key, at, mode="clip") == key + step)
        pairs.append((has, at[has], 2 * has + k))
    one, other, place = (np.concatenate(c) for c in zip(*pairs))
    weight = np.abs(z[one] - z[other])
    level = weight == 0
    zone = _union(len(z), one[level], other[level])
    low, high = z.copy(), z.copy()
    order = np.lexsort((place, weight))
    order = order[weight[order] > 0]
    one, other = one[order], other[order]
    while True:
        one, other = zone[one], zone[other]
        span = np.maximum(high[one], high[other]) - np.minimum(low[one], low[other])
        may = (one != other) & (span < rise)
        one, other = one[may], other[may]
        if not len(one):
            return low[zone], high[zone]
        turn, first = np.arange(len(one)), np.full(len(z), len(one))
        np.minimum.at(first, one, turn)
        np.minimum.at(first, other, turn)
        now = (first[one] == turn) & (first[other] == turn)
        kept, gone = one[now], other[now]
        low[kept], high[kept] = np.minimum(low[kept], low[gone]), np.maximum(high[kept], high[gone])
        zone[gone] = kept
        zone = zone[zone]


def flat_zones(cells: DataFrame, height: str, layer: float, first: float, tile: int = TILE, plate: str = "plate") -> DataFrame:
    """Heights settled on layer planes so that ground flatter than a layer prints at one level.

    Regions grow by smallest height difference while they rise less than a layer, which is an order over all pairs of a
    plate and so runs in one task per piece. Pairs a whole layer apart never join, so a plate first falls into the
    pieces those steps leave; a piece is at most a plate. No cell moves a whole layer. Pieces that begin in one tile
    share a group: they never join each other, so the answer is the same.
    """
    pieces = label_regions(cells.select("cx", "cy", height), height, gap=layer - 1e-9, tile=tile)
    rows = pieces.join(cells.select("cx", "cy", plate), ["cx", "cy"])

    def settle(pdf):
        key = pdf["cy"].to_numpy() * WIDE + pdf["cx"].to_numpy()
        order = np.argsort(key)
        out = pdf.iloc[order][["cx", "cy", plate, height]].copy()
        low, high = _zone_ranges(key[order], out[height].to_numpy(float), layer - 1e-9)
        out["settled_mm"] = first + np.rint(((low + high) / 2 - first) / layer) * layer
        return out

    kind = dict(cells.dtypes)[plate]
    home_y, home_x = F.floor(F.col("label") / WIDE / tile), F.floor((F.pmod(F.col("label"), F.lit(WIDE)) - HALF) / tile)
    keyed = rows.select("cx", "cy", plate, height, home_y.alias("home_y"), home_x.alias("home_x"))
    return keyed.groupBy(plate, "home_y", "home_x").applyInPandas(settle, f"cx bigint, cy bigint, `{plate}` {kind}, `{height}` double, settled_mm double")


def narrow_peaks(cells: DataFrame, *, step_mm: float, diameter_mm: float, band_mm: float, sweep_mm: float, by: str = "plate", tile: int = TILE) -> DataFrame:
    """Building tops in the highest band of each plate that are no wider than the diameter.

    At each sweep level the building cells above it fall into regions; small enough ones give a candidate with its peak
    height, the mean place of its peak cells and their commonest material. The same candidate at several levels is one.
    """
    top = cells.groupBy(by).agg(F.max("height_mm").alias("_top"))
    high = cells.where("building").join(top, by).where(F.col("height_mm") > F.col("_top") - band_mm)
    steps = int(np.ceil(band_mm / sweep_mm - 1e-9))
    found = None
    for k in range(steps):
        level = F.col("_top") - band_mm + k * sweep_mm
        above = high.where(F.col("height_mm") > level).select("cx", "cy", F.lit(1.0).alias("on"), "height_mm", "material", by)
        spots = label_regions(above, "on", tile=tile).join(above.drop("on"), ["cx", "cy"])
        local = spots.groupBy("local_label", "label").agg(
            F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.max("height_mm").alias("h"))
        small = local.groupBy("label").agg(
            F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("_extent"), F.max("h").alias("peak_mm")
        ).where((F.col("_extent") + 1) * step_mm <= diameter_mm).drop("_extent")
        small_parts = local.join(small, "label").select("local_label", "peak_mm")
        crest = spots.join(small_parts, "local_label").where(F.col("height_mm") >= F.col("peak_mm") - 0.0001)
        colour = F.mode(F.when(F.col("material") < 4, F.col("material")), True)
        part = crest.groupBy("label", by).agg(
            F.round((F.avg("cx") + 0.5) * step_mm, 4).alias("x"), F.round((F.avg("cy") + 0.5) * step_mm, 4).alias("y"),
            F.round(F.max("peak_mm"), 4).alias("peak_mm"), F.coalesce(colour, F.lit(0)).alias("material")).drop("label")
        found = part if found is None else found.unionByName(part)
    return found.groupBy(by, "x", "y", "peak_mm").agg(F.min("material").alias("material"))


def suppress_peaks(candidates: DataFrame, distance: float, by: str = "plate") -> DataFrame:
    """Keep the highest candidates so that none lies within ``distance`` of a kept higher one.

    Each round keeps every candidate no undecided higher one is near, then drops the neighbours of the kept, until all
    are decided: the greedy answer, found in parallel. Near means within one square of ``distance``, so a candidate
    only meets its nine squares.
    """
    rank = F.struct(-F.col("peak_mm"), "x", "y")
    rest = cut(candidates.withColumn("_rank", rank), "peaks")
    kept = None
    around = F.sequence(F.lit(-1), F.lit(1))
    while rest.limit(1).count():
        home = rest.withColumn("bx", F.floor(F.col("x") / distance)).withColumn("by_", F.floor(F.col("y") / distance))
        asked = home.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select(
            by, F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("_rank").alias("q_rank"), (F.col("bx") + F.col("dx")).alias("bx"), (F.col("by_") + F.col("dy")).alias("by_"))
        near = (F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")) < distance)
        blocked = home.join(asked, [by, "bx", "by_"]).where(near & (F.col("_rank") < F.col("q_rank"))).select(by, "q_rank").distinct()
        fresh = cut(rest.join(blocked.withColumnRenamed("q_rank", "_rank"), [by, "_rank"], "left_anti"), "kept")
        done = fresh.withColumn("bx", F.floor(F.col("x") / distance)).withColumn("by_", F.floor(F.col("y") / distance))
        beaten = done.join(asked, [by, "bx", "by_"]).where(near).select(by, "q_rank").distinct()
        kept = fresh if kept is None else kept.unionByName(fresh)
        rest = cut(rest.join(beaten.withColumnRenamed("q_rank", "_rank"), [by, "_rank"], "left_anti"), "peaks")
    return (candidates.limit(0) if kept is None else kept).select(*candidates.columns)
