"""Joins in space.

Both sides are cut on one square lattice and meet in an equi-join on the square, so no pair is ever tried outside a
shared square. Of the several squares two boxes share only one reports the pair: the one that holds the corner
``(max(minx), max(miny))`` of their overlap. Squares that hold a crowd are split over several tasks by ``spread_hot``.

Spark takes a table cut into squares to be as small as before the cut and would send it whole through the driver, so
these joins ask for a merge of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.lattice import cell_of

BOX = ["minx", "miny", "maxx", "maxy"]
HOT_ROWS = 500_000
HOT_SHARE = 100_000


def cover(df: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """One row per lattice square that a row's box, grown by ``grow``, touches."""
    def span(lo: str, hi: str) -> Column:
        return F.sequence(cell_of(F.col(lo) - grow, size), cell_of(F.col(hi) + grow, size))

    return (
        df.where(F.col("minx").isNotNull() & F.col("miny").isNotNull() & F.col("maxx").isNotNull() & F.col("maxy").isNotNull())
        .withColumn("bx", F.explode(span("minx", "maxx"))).withColumn("by", F.explode(span("miny", "maxy"))))


def hot_keys(crowd: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with many rows and the number of parts, ``_parts``, that each is to be dealt out in.

    A key is hot above ``hot_rows`` rows and above one part in ``HOT_SHARE`` of all rows, far less than a task's share on
    any cluster, so there are fewer than ``HOT_SHARE`` hot keys at any scale and the list of them may be broadcast.
    """
    counts = crowd.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = F.greatest(F.lit(hot_rows), counts.agg(F.ceil(F.sum("_n") / HOT_SHARE).alias("n")).scalar())
    return F.broadcast(counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")))


def deal_out(crowd: DataFrame, hot: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Rows of a hot key shared out over its parts by a hash of all other columns; other rows stay in part 0."""
    hashed = [c for c, kind in crowd.dtypes if c not in keys and "map<" not in kind]
    parts = F.coalesce("_parts", F.lit(1))
    return crowd.join(hot, keys, "left").withColumn(salt, F.when(parts > 1, F.pmod(F.xxhash64(*hashed), parts)).otherwise(0).cast("int")).drop("_parts")


def repeat_for(other: DataFrame, hot: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Rows that meet a hot key once for each of its parts."""
    return other.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def spread_hot(crowd: DataFrame, other: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Give both sides a ``salt`` so that a key with many rows of ``crowd`` is shared out over several tasks."""
    hot = hot_keys(crowd, keys, hot_rows)
    return deal_out(crowd, hot, keys, "salt"), repeat_for(other, hot, keys, "salt")


def _prune_edges(size: float) -> Column:
    """The edges a ray to the right from inside a square can meet."""
    low, high, left = F.col("by") * F.lit(float(size)), (F.col("by") + 1) * F.lit(float(size)), F.col("bx") * F.lit(float(size))
    return F.filter("edges", lambda e: (
        (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low) & (F.greatest(e["x1"], e["x2"]) >= left)))


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, size: float, how: str = "inner", boundary: bool = False,
    keep: list[str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Points joined to the polygons that hold them: ``inner`` with the polygon's ``keep`` columns, ``left_semi``, ``left_anti``.

    A point lies in exactly one square, so semi and anti joins need no de-duplication; a polygon carries into each
    square only the edges that matter there.
    """
    keyed = points.withColumn("bx", cell_of(F.col("x"), size)).withColumn("by", cell_of(F.col("y"), size))
    names = keep or ["id"]
    cut_up = cover(polygons, size).select("bx", "by", *BOX, _prune_edges(size).alias("edges"), *[F.col(c).alias(f"_p_{c}") for c in names])
    dealt, repeated = spread_hot(keyed, cut_up, ["bx", "by"], hot_rows)
    a, b = dealt.alias("a"), repeated.alias("b")
    x, y = F.col("a.x"), F.col("a.y")
    test = g.covers if boundary else g.contains
    on = (
        (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by")) & (F.col("a.salt") == F.col("b.salt"))
        & x.between(F.col("b.minx"), F.col("b.maxx")) & y.between(F.col("b.miny"), F.col("b.maxy"))
        & test(F.col("b.edges"), x, y))
    joined = a.join(b.hint("merge"), on, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*points.columns)
    return joined.select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b._p_{c}").alias(f"polygon_{c}") for c in names])


def bbox_join(
    left: DataFrame, right: DataFrame, size: float, grow: float = 0.0, same: bool = False, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of rows with overlapping closed boxes, each once; columns come prefixed ``a_`` and ``b_``.

    ``grow`` widens the left boxes on every side. ``same`` joins a table with itself: each unordered pair once, by ``id``.
    A square crowded on either side is shared out: over parts of its left rows, of its right rows, or of both.
    """
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns], *[
        (F.col(c) + s * grow).alias(c) for c, s in zip(BOX, (-1, -1, 1, 1))])
    a = cover(a, size).withColumnsRenamed({c: f"_a_{c}" for c in BOX})
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns], *BOX)
    b = cover(b, size).withColumnsRenamed({c: f"_b_{c}" for c in BOX})
    square = ["bx", "by"]
    hot_a, hot_b = hot_keys(a, square, hot_rows), hot_keys(b, square, hot_rows)
    a = repeat_for(deal_out(a, hot_a, square, "salt_a"), hot_b, square, "salt_b")
    b = repeat_for(deal_out(b, hot_b, square, "salt_b"), hot_a, square, "salt_a")
    pairs = a.join(b.hint("merge"), [*square, "salt_a", "salt_b"]).where(
        (F.col("_a_minx") <= F.col("_b_maxx")) & (F.col("_b_minx") <= F.col("_a_maxx"))
        & (F.col("_a_miny") <= F.col("_b_maxy")) & (F.col("_b_miny") <= F.col("_a_maxy"))
        & (F.col("bx") == cell_of(F.greatest("_a_minx", "_b_minx"), size))
        & (F.col("by") == cell_of(F.greatest("_a_miny", "_b_miny"), size)))
    if same:
        pairs = pairs.where(F.col("a_id") < F.col("b_id"))
    return pairs.select(*[f"a_{c}" for c in left.columns], *[f"b_{c}" for c in right.columns])


def clip_bbox(df: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose box touches the closed bounds: four comparisons that reach the Parquet statistics."""
    minx, miny, maxx, maxy = bounds
    return df.where((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))


def tile_sources(tiles: DataFrame, sources: DataFrame, halo: float, size: float) -> DataFrame:
    """For each output tile the ids of the sources its box, widened by the halo, touches; in id order."""
    pairs = bbox_join(tiles, sources.select("id", *BOX), size, grow=halo)
    return pairs.groupBy(F.col("a_id").alias("tile_id")).agg(
        F.count("*").alias("sources"), F.array_sort(F.collect_list("b_id")).alias("source_ids"))


def split_segments(segments: DataFrame, longest: float) -> DataFrame:
    """Segments ``(x1, y1, x2, y2)`` cut into equal pieces no longer than ``longest``, so none spans many squares."""
    pieces = g.densify(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), longest)
    n = F.size("_parts")
    out = segments.withColumn("_parts", pieces).withColumn("_n", n).withColumn("_p", F.explode("_parts"))
    k = F.col("_p.k") + 1
    x2 = F.when(k == F.col("_n"), F.col("x2")).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (k / F.col("_n")))
    y2 = F.when(k == F.col("_n"), F.col("y2")).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * (k / F.col("_n")))
    keep = [c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")]
    return out.select(*keep, F.col("_p.k").alias("piece"), F.col("_p.x").alias("x1"), F.col("_p.y").alias("y1"), x2.alias("x2"), y2.alias("y2"))


def segment_box(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "minx": F.least("x1", "x2"), "miny": F.least("y1", "y2"), "maxx": F.greatest("x1", "x2"), "maxy": F.greatest("y1", "y2")})


def line_in_polygon_length(segments: DataFrame, polygons: DataFrame, size: float, line: str = "line_id", keep: list[str] | None = None) -> DataFrame:
    """Length of each line inside each polygon it meets; ``segments`` hold ``x1, y1, x2, y2`` per line."""
    pieces = segment_box(split_segments(segments.select(line, "x1", "y1", "x2", "y2"), size * 4))
    names = keep or ["id"]
    pairs = bbox_join(pieces, polygons.select(*names, "edges", *BOX), size)
    ends = [F.col(f"a_{c}") for c in ("x1", "y1", "x2", "y2")]
    inside = g.covered_share(F.col("b_edges"), *ends) * F.hypot(ends[2] - ends[0], ends[3] - ends[1])
    return pairs.groupBy(F.col(f"a_{line}").alias(line), *[F.col(f"b_{c}").alias(f"polygon_{c}") for c in names]).agg(
        F.sum(inside).alias("inside_length")).where(F.col("inside_length") > 1e-9)


def line_support(segments: DataFrame, polygons: DataFrame, size: float, line: str = "line_id") -> DataFrame:
    """Share of each line's length that any of the polygons covers; overlapping polygons count once.

    Entries and exits of all polygons are summed per place on a piece, then swept in order; pieces are short, so one
    sweep only meets the polygons of a square.
    """
    lines = segments.groupBy(line).agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))
    pieces = segment_box(split_segments(segments.select(line, "pos", "x1", "y1", "x2", "y2"), size))
    pairs = bbox_join(pieces, polygons.select("edges", *BOX), size)
    ends = [F.col(f"a_{c}") for c in ("x1", "y1", "x2", "y2")]
    key = [F.col(f"a_{line}").alias(line), F.col("a_pos").alias("pos"), F.col("a_piece").alias("piece")]
    events = pairs.select(
        *key, F.hypot(ends[2] - ends[0], ends[3] - ends[1]).alias("piece_length"),
        F.explode(g.crossings(F.col("b_edges"), *ends)).alias("c"),
    ).groupBy(line, "pos", "piece", "piece_length", F.col("c.at").alias("at")).agg(F.sum("c.sign").alias("sign"))
    w = Window.partitionBy(line, "pos", "piece", "piece_length").orderBy("at")
    depth = F.sum("sign").over(w.rowsBetween(Window.unboundedPreceding, 0))
    reach = F.coalesce(F.lead("at").over(w), F.lit(1.0)) - F.col("at")
    covered = events.select(line, F.when(depth > 0, reach * F.col("piece_length")).otherwise(0.0).alias("_c")).groupBy(line).agg(F.sum("_c").alias("covered"))
    share = F.when(F.col("length") > 0, F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)) / F.col("length"))).otherwise(0.0)
    return lines.join(covered, line, "left").select(line, "length", share.alias("support"))


def nearest_within(points: DataFrame, spots: DataFrame, k: int, radius: float, guard: float) -> DataFrame:
    """Median value of the ``k`` nearest spots within reach whose value lies near the point's own fallback.

    ``points`` have ``id, x, y, fallback``; ``spots`` have ``id, x, y, value``. A point with no such spot keeps its
    fallback. Distances stay in squares of one radius, so a point looks at nine of them.
    """
    around = F.sequence(F.lit(-1), F.lit(1))
    asked = points.select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), "fallback",
                          cell_of(F.col("x"), radius).alias("_cx"), cell_of(F.col("y"), radius).alias("_cy"))
    asked = asked.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).select(
        "pid", "px", "py", "fallback", (F.col("_cx") + F.col("_dx")).alias("bx"), (F.col("_cy") + F.col("_dy")).alias("by"))
    known = spots.select(F.col("id").alias("sid"), "x", "y", "value", cell_of(F.col("x"), radius).alias("bx"), cell_of(F.col("y"), radius).alias("by"))
    known, asked = spread_hot(known, asked, ["bx", "by"])
    d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    near = known.join(asked.hint("merge"), ["bx", "by", "salt"]).withColumn("d2", d2).where(
        (F.col("d2") <= radius * radius) & (F.abs(F.col("value") - F.col("fallback")) <= guard))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy("d2", "sid"))).where(F.col("rank") <= k)
    found = best.groupBy("pid").agg(F.median("value").alias("found"), F.count("*").alias("spots"))
    return points.join(found.hint("merge"), points.id == found.pid, "left").select(
        *[points[c] for c in points.columns], F.coalesce("found", "fallback").alias("value"), F.coalesce("spots", F.lit(0)).alias("spots"),
        F.when(F.col("found").isNotNull(), "spot").otherwise("ground").alias("method"))


def rasterize(polygons: DataFrame, size: float, mode: str = "centre", value: str = "id", order: list[str] | None = None) -> DataFrame:
    """Cells the polygons cover; where several do, the one last by ``order`` wins, as if drawn in that order."""
    cells = {"centre": g.covered_cells, "all_touched": g.met_cells}[mode](F.col("edges"), size)
    if order in (None, [value]):
        burnt = polygons.select(F.explode(cells).alias("c"), value).select("c.cx", "c.cy", value)
        return burnt.groupBy("cx", "cy").agg(F.max(value).alias(value))
    burnt = polygons.select(F.explode(cells).alias("c"), F.col(value).alias("_value"), *[F.col(o).alias(f"_o_{o}") for o in order])
    return burnt.groupBy("c.cx", "c.cy").agg(F.max_by("_value", F.struct(*[f"_o_{o}" for o in order])).alias(value))


def cells_of_polygons(polygons: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """Every covered cell of every polygon, overlaps included."""
    return polygons.select(*keep, F.explode(g.covered_cells(F.col("edges"), size)).alias("c")).select(*keep, "c.cx", "c.cy")


def sample_lines(segments: DataFrame, cells: DataFrame, size: float, line: str = "line_id", keep: list[str] | None = None) -> DataFrame:
    """Points along each line at most one cell apart, with the values of the cell below; samples outside are dropped.

    ``segments`` need ``pos`` and their end points; the last vertex of a line is a sample too.
    """
    names = keep or [c for c in cells.columns if c not in ("cx", "cy")]
    ends = segments.groupBy(line).agg(F.max_by(F.struct("pos", "x2", "y2"), "pos").alias("e"))
    last = ends.select(line, (F.col("e.pos") + 1).alias("pos"), F.lit(0).alias("k"), F.col("e.x2").alias("x"), F.col("e.y2").alias("y"))
    dense = segments.select(line, "pos", F.explode(g.densify(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)).alias("d"))
    points = dense.select(line, "pos", "d.k", "d.x", "d.y").unionByName(last)
    located = points.withColumn("cx", cell_of(F.col("x"), size)).withColumn("cy", cell_of(F.col("y"), size))
    return located.hint("merge").join(cells.select("cx", "cy", *names), ["cx", "cy"])


def route_crossings(upper: DataFrame, lower: DataFrame, size: float, inset: float = 0.05) -> DataFrame:
    """Points where an upper way crosses a lower way away from the lower way's ends.

    Segments carry ``way_id, pos, x1, y1, x2, y2``; lower ones also ``start_length`` and ``line_length``. Upper ways
    that are tunnels, or not drawn at all, are left out by the caller.
    """
    lower = lower.withColumn("ox", F.col("x1")).withColumn("oy", F.col("y1"))
    pairs = bbox_join(segment_box(split_segments(upper, size * 4)), segment_box(split_segments(lower, size * 4)), size)
    a = [F.col(f"a_{c}") for c in ("x1", "y1", "x2", "y2")]
    b = [F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    det = ax * by - ay * bx
    safe = F.when(det != 0, det)
    t = ((b[0] - a[0]) * by - (b[1] - a[1]) * bx) / safe
    u = ((b[0] - a[0]) * ay - (b[1] - a[1]) * ax) / safe
    hit = pairs.withColumn("t", t).withColumn("u", u).where(
        F.col("t").isNotNull() & (F.col("a_way_id") != F.col("b_way_id"))
        & (F.col("t") >= 0) & (F.col("t") < 1) & (F.col("u") >= 0) & (F.col("u") < 1))
    at = F.col("b_start_length") + F.hypot(b[0] + F.col("u") * bx - F.col("b_ox"), b[1] + F.col("u") * by - F.col("b_oy"))
    return hit.withColumn("at", at).where((F.col("at") >= inset) & (F.col("at") <= F.col("b_line_length") - inset)).select(
        F.col("a_way_id").alias("upper_id"), F.col("a_pos").alias("upper_pos"), F.col("b_way_id").alias("lower_id"),
        F.col("b_pos").alias("lower_pos"), (a[0] + F.col("t") * ax).alias("x"), (a[1] + F.col("t") * ay).alias("y"), "at")


def linear_reference(points: DataFrame, segments: DataFrame, reach: float, point: str = "point_id", line: str = "line_id") -> DataFrame:
    """Place (0 to 1) along each near line of the point of it nearest to each point.

    ``segments`` carry ``start_length`` and ``line_length``. A line is near within ``reach``.
    """
    boxes = points.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})
    pairs = bbox_join(boxes, segment_box(segments), reach, grow=reach)
    near = g.distance_to_segment(F.col("a_x"), F.col("a_y"), *[F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    close = pairs.withColumn("_near", near).where(F.col("_near.dist") <= reach)
    place = (F.col("b_start_length") + F.col("_near.share") * F.hypot(F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1"))) / F.col("b_line_length")
    return close.groupBy(F.col(f"a_{point}").alias(point), F.col(f"b_{line}").alias(line)).agg(
        F.min("_near.dist").alias("dist"), F.min_by(place, F.struct(F.col("_near.dist"), F.col("b_start_length"))).alias("place"))


def too_close_pairs(items: DataFrame, gap: float, size: float) -> DataFrame:
    """Pairs of placed boxes nearer than ``gap``, each once, with their distance; 0 for boxes that overlap or touch."""
    pairs = bbox_join(items, items, size, grow=2 * gap, same=True)
    dx = F.greatest(F.col("b_minx") - F.col("a_maxx"), F.col("a_minx") - F.col("b_maxx"), F.lit(0.0))
    dy = F.greatest(F.col("b_miny") - F.col("a_maxy"), F.col("a_miny") - F.col("b_maxy"), F.lit(0.0))
    return pairs.withColumn("gap", F.hypot(dx, dy)).where(F.col("gap") < gap).select("a_id", "b_id", "gap")
