"""Window, sort and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice
from ..operators import ordered
from .registry import query

C = F.col


@query("w1_dedupe_first", """
    SELECT order_id, point_id, x, y FROM (
      SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY x, y, point_id) AS rn FROM points) p WHERE rn = 1""")
def _(t):
    return ordered.dedupe_first(t.points.select("order_id", "point_id", "x", "y"), ["order_id", "no_such_key"], ["x", "y", "point_id"])


@query("w2_segments", """
    SELECT way_id, pos, x1, y1, x2, y2, round(length, 6) AS length, round(start_length, 4) AS start_length FROM (
      SELECT *, coalesce(sum(length) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_length
      FROM (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS length FROM (
        SELECT way_id, pos, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices WINDOW w AS (PARTITION BY way_id ORDER BY pos)) v
        WHERE x2 IS NOT NULL) s) q""")
def _(t):
    return ordered.segments(t.vertices).select(
        "way_id", "pos", "x1", "y1", "x2", "y2", F.round("length", 6).alias("length"), F.round("start_length", 4).alias("start_length"))


SPAN = """SELECT o_custkey % 20 AS route, (o_orderkey*37 % 9973)/10.0e0 AS s, (o_orderkey*37 % 9973)/10.0e0 + (o_orderkey % 7)/20.0e0 AS e FROM orders"""


@query("w4_merge_spans", f"""
    WITH sp AS ({SPAN}), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY route ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM sp),
    n AS (SELECT *, sum(o) OVER (PARTITION BY route ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM f)
    SELECT route, min(s) AS span_start, max(e) AS span_end, count(*) AS spans FROM n GROUP BY route, isl""")
def _(t):
    start = C("o_orderkey") * 37 % 9973 / F.lit(10.0)
    spans = t.orders.select((C("o_custkey") % 20).alias("route"), start.alias("span_start"), (start + C("o_orderkey") % 7 / F.lit(20.0)).alias("span_end"))
    return ordered.merge_spans(spans, "route", "span_start", "span_end", width=25.0)


@query("w6_carry_state", """
    SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS last_click,
           last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER w AS last_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    rows = t.events.select("user_id", "event_id", F.when(C("event_type") == "click", C("value")).alias("last_click"),
                           F.when(C("event_id") % 4 == 0, C("event_type")).alias("last_type"))
    return ordered.carry_forward(rows, "user_id", "event_id", ["last_click", "last_type"], block=512)


@query("w7_live_sources", """
    WITH u AS (SELECT o_orderkey AS task_rank, o_custkey AS source_id FROM orders),
    s AS (SELECT source_id, min(task_rank) AS a, max(task_rank) AS b FROM u GROUP BY source_id),
    ev AS (SELECT a AS task_rank, 1 AS step FROM s UNION ALL SELECT b + 1, -1 FROM s UNION ALL SELECT task_rank, 0 FROM u),
    r AS (SELECT DISTINCT task_rank, sum(step) OVER (ORDER BY task_rank) AS open_sources FROM ev)
    SELECT task_rank, CAST(open_sources AS BIGINT) AS open_sources FROM r WHERE task_rank IN (SELECT task_rank FROM u)""")
def _(t):
    return ordered.live_sources(t.orders.select(C("o_orderkey").alias("task_rank"), C("o_custkey").alias("source_id")))


@query("w9_printable_runs", """
    WITH s AS (SELECT o_custkey % 40 AS seam_id, o_orderkey AS pos, o_orderkey // 13 % 5 AS l, (o_orderkey + 20) // 9 % 5 AS r FROM orders),
    a AS (SELECT *, concat(l, '|', r) AS pair FROM s WHERE l <> r),
    f AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(pair) OVER w = pair THEN 0 ELSE 1 END AS st FROM a WINDOW w AS (PARTITION BY seam_id ORDER BY pos)),
    g AS (SELECT *, sum(st) OVER (PARTITION BY seam_id ORDER BY pos) AS run FROM f)
    SELECT seam_id, CAST(run AS BIGINT) AS run, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS samples, min(l) AS "left", min(r) AS "right" FROM g GROUP BY seam_id, run""")
def _(t):
    k = C("o_orderkey")
    samples = t.orders.select((C("o_custkey") % 40).alias("seam_id"), k.alias("pos"), (F.floor(k / 13) % 5).alias("left"), (F.floor((k + 20) / 9) % 5).alias("right"))
    return ordered.printable_runs(samples)


@query("w10_stage_durations", """
    SELECT job, stage, event_id AS start_event, nstat AS result, (epoch_us(nts) - epoch_us(ts))/1e6 AS seconds FROM (
      SELECT *, lead(status) OVER w AS nstat, lead(ts) OVER w AS nts FROM stage_events WINDOW w AS (PARTITION BY job, stage ORDER BY ts, event_id)) e
    WHERE status = 'running' AND nstat IN ('completed', 'failed')""")
def _(t):
    return ordered.stage_durations(t.stage_events, ["job", "stage"])


@query("o1_spatial_sort", """
    SELECT id, (minx + maxx)/2 AS centre_x, (miny + maxy)/2 AS centre_y,
           row_number() OVER (ORDER BY (minx + maxx)/2, (miny + maxy)/2, source_order) - 1 AS sort_rank FROM footprints""")
def _(t):
    laid_out = ordered.spatial_sort(t.footprints).select("id", "centre_x", "centre_y", "source_order")
    return ordered.global_rank(laid_out, [C("centre_x"), C("centre_y"), C("source_order")], "sort_rank").drop("source_order")


@query("o2_reading_order", """
    SELECT id, row_number() OVER (ORDER BY floor(y/100) DESC, floor(x/100), id) - 1 AS reading_rank FROM spots""")
def _(t):
    plates = t.spots.select("id", F.floor(C("x") / 100).alias("x"), F.floor(C("y") / 100).alias("y"))
    return ordered.reading_order(plates).select("id", "reading_rank")


@query("o3_top_k", """
    SELECT order_id, point_id, z_ft, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY z_ft DESC, point_id, x, y) AS rank FROM points) p WHERE rank <= 3""")
def _(t):
    return ordered.top_k(t.points, ["order_id"], 3, [C("z_ft").desc(), C("point_id"), C("x"), C("y")]).select("order_id", "point_id", "z_ft", "rank")
