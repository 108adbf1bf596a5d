"""Geodata derived from the given tables: each view is SQL that runs on Spark and on the checking engine alike.

The world grows with the data: every 1,500 customers (15,000 orders, 2,000 parts, 100 suppliers) make one district of
1,000 x 1,000 ft, so the density of points and features per square foot stays the same at any scale factor.
Where SQL would need a cross join against a small constant range, the Spark side explodes an array instead
(``Inputs.edges`` and others); the SQL stays as the definition for the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
CELL_FT = 8.0
DISTRICT_FT = 1000.0
ROWS_PER_TASK = 10_000

VIEWS = {
    "points": """
        SELECT l_orderkey*8 + l_linenumber AS point_id, l_partkey AS part_id, l_orderkey AS order_id,
               CAST(d % 32 AS DOUBLE)*1000 + CAST((l_orderkey*7919 + l_linenumber*104729) % 8000 AS DOUBLE)/8 AS x,
               CAST(floor(d / 32) AS DOUBLE)*1000
                 + CAST((l_partkey*6101 + l_suppkey*3571 + l_orderkey*13) % 8000 AS DOUBLE)/8 AS y,
               l_extendedprice/1000 AS z_ft,
               CASE l_linenumber % 7 WHEN 0 THEN 1 WHEN 3 THEN 17 WHEN 4 THEN 25 WHEN 5 THEN 7 ELSE 2 END AS cls,
               CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN 40 ELSE 0 END AS cls_ext,
               l_returnflag = 'R' AS withheld
        FROM (SELECT *, CAST(floor(l_orderkey / 15000) AS BIGINT) AS d FROM lineitem) l""",
    "footprints": """
        SELECT c_custkey AS id, c_custkey AS source_order, c_custkey % 3 AS shape, d AS district,
               ox + CAST((c_custkey*7919) % 7600 AS DOUBLE)/8 AS minx, oy + CAST((c_custkey*6101) % 7600 AS DOUBLE)/8 AS miny,
               ox + CAST((c_custkey*7919) % 7600 AS DOUBLE)/8 + 4 + (c_custkey % 5)*4 AS maxx,
               oy + CAST((c_custkey*6101) % 7600 AS DOUBLE)/8 + 4 + (c_custkey % 7)*4 AS maxy,
               CASE WHEN c_custkey % 11 = 0 THEN concat(CAST(c_custkey % 5 + 1 AS STRING), '000000')
                    ELSE CAST((c_custkey % 5 + 1)*1000000 + c_custkey AS STRING) END AS bin,
               concat(CAST(c_custkey + 500000 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END) AS doitt_id,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal/50 END AS height_roof, c_name AS name
        FROM (SELECT *, CAST(d % 32 AS DOUBLE)*1000 AS ox, CAST(floor(d / 32) AS DOUBLE)*1000 AS oy
              FROM (SELECT *, CAST(floor(c_custkey / 1500) AS BIGINT) AS d FROM customer) c) c2""",
    "roofs": """
        SELECT p_partkey AS id, f.id AS true_owner,
               f.minx + p_partkey % 5 - 2 AS minx, f.miny + p_partkey % 3 - 1 AS miny,
               f.maxx + p_partkey % 5 - 2 AS maxx, f.maxy + p_partkey % 3 - 1 AS maxy,
               CASE WHEN p_partkey % 4 = 0 THEN '9000001' ELSE f.bin END AS bin,
               CASE WHEN p_partkey % 8 = 0 THEN f.doitt_id ELSE NULL END AS doitt_id,
               p_retailprice/10 - p_size % 3 AS z_min_ft, p_retailprice/10 AS z_max_ft
        FROM part JOIN footprints f
          ON f.id = CAST(floor(p_partkey / 2000) AS BIGINT)*1500 + (p_partkey*17) % 1500""",
    "edges": """
        SELECT id, k AS pos,
          CASE WHEN k >= 4 THEN CASE k WHEN 4 THEN minx + 1 WHEN 5 THEN minx + 1 WHEN 6 THEN maxx - 1 ELSE maxx - 1 END
               WHEN shape = 1 THEN CASE k WHEN 0 THEN mx WHEN 1 THEN maxx WHEN 2 THEN mx ELSE minx END
               ELSE CASE k WHEN 0 THEN minx WHEN 1 THEN maxx WHEN 2 THEN maxx ELSE minx END END AS x1,
          CASE WHEN k >= 4 THEN CASE k WHEN 4 THEN miny + 1 WHEN 5 THEN maxy - 1 WHEN 6 THEN maxy - 1 ELSE miny + 1 END
               WHEN shape = 1 THEN CASE k WHEN 0 THEN miny WHEN 1 THEN my WHEN 2 THEN maxy ELSE my END
               ELSE CASE k WHEN 0 THEN miny WHEN 1 THEN miny WHEN 2 THEN maxy ELSE maxy END END AS y1,
          CASE WHEN k >= 4 THEN CASE k WHEN 4 THEN minx + 1 WHEN 5 THEN maxx - 1 WHEN 6 THEN maxx - 1 ELSE minx + 1 END
               WHEN shape = 1 THEN CASE k WHEN 0 THEN maxx WHEN 1 THEN mx WHEN 2 THEN minx ELSE mx END
               ELSE CASE k WHEN 0 THEN maxx WHEN 1 THEN maxx WHEN 2 THEN minx ELSE minx END END AS x2,
          CASE WHEN k >= 4 THEN CASE k WHEN 4 THEN maxy - 1 WHEN 5 THEN maxy - 1 WHEN 6 THEN miny + 1 ELSE miny + 1 END
               WHEN shape = 1 THEN CASE k WHEN 0 THEN my WHEN 1 THEN maxy WHEN 2 THEN my ELSE miny END
               ELSE CASE k WHEN 0 THEN miny WHEN 1 THEN maxy WHEN 2 THEN maxy ELSE miny END END AS y2
        FROM (SELECT *, (minx + maxx)/2 AS mx, (miny + maxy)/2 AS my FROM footprints) f CROSS JOIN range(8) AS t(k)
        WHERE k < 4 OR shape = 2""",
    "vertices": """
        SELECT o_custkey AS way_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos,
               CAST(CAST(floor(o_custkey / 1500) AS BIGINT) % 32 AS DOUBLE)*1000 + CAST((o_custkey*7919) % 7600 AS DOUBLE)/8
                 + sum(CAST((o_orderkey*31) % 41 - 20 AS DOUBLE))
                   OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS x,
               CAST(floor(o_custkey / 48000) AS DOUBLE)*1000 + CAST((o_custkey*6101) % 7600 AS DOUBLE)/8
                 + sum(CAST((o_orderkey*53) % 37 - 18 AS DOUBLE))
                   OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS y
        FROM orders""",
    "ways": """
        SELECT way_id, highway,
               concat('{"highway":"', highway, '","name":"', CASE WHEN way_id % 4 = 0 THEN '' ELSE concat('Street ', CAST(way_id % 40 AS STRING)) END,
                      '","width":"', CASE way_id % 6 WHEN 0 THEN '9' WHEN 1 THEN '30 ft' WHEN 2 THEN 'wide' ELSE '' END,
                      '","lanes":"', CASE way_id % 5 WHEN 0 THEN '2' WHEN 1 THEN '4' ELSE '' END,
                      '","maxspeed":"', CASE way_id % 3 WHEN 0 THEN '25 mph' ELSE '' END,
                      '","bridge":"', CASE WHEN way_id % 9 = 0 THEN 'yes' ELSE 'no' END,
                      '","tunnel":"', CASE WHEN way_id % 13 = 0 THEN 'building_passage' ELSE 'no' END,
                      '","leisure":"', CASE way_id % 8 WHEN 0 THEN 'park; pitch' WHEN 1 THEN 'garden' WHEN 2 THEN 'track' ELSE '' END,
                      '","landuse":"', CASE way_id % 7 WHEN 0 THEN 'grass' WHEN 1 THEN 'retail;recreation_ground' ELSE '' END,
                      '","amenity":"', CASE way_id % 6 WHEN 0 THEN 'parking' ELSE 'bench' END,
                      '","parking":"', CASE way_id % 4 WHEN 0 THEN 'rooftop' ELSE 'surface' END,
                      '","service":"', CASE way_id % 12 WHEN 3 THEN 'alley' ELSE '' END,
                      '","height":"', CASE way_id % 5 WHEN 0 THEN '12.5' WHEN 1 THEN '40 ft' WHEN 2 THEN 'tall' WHEN 3 THEN '0' ELSE '' END,
                      '","layer":"', CASE way_id % 9 WHEN 0 THEN '1' WHEN 1 THEN '-1.0' WHEN 2 THEN 'x' ELSE '' END,
                      '","surface":"', CASE WHEN way_id % 3 = 0 THEN 'asphalt' ELSE 'gravel' END, '"}') AS tags
        FROM (SELECT c_custkey AS way_id,
                     CASE c_custkey % 10 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' WHEN 3 THEN 'service'
                       WHEN 4 THEN 'footway' WHEN 5 THEN 'cycleway' WHEN 6 THEN 'pedestrian' WHEN 7 THEN 'steps' WHEN 8 THEN 'road'
                       ELSE 'tertiary_link' END AS highway FROM customer) w""",
    "landcover": """
        SELECT cx, cy, CAST((floor(cx/9)*5 + floor(cy/11)*3 + CASE WHEN max(part_id) % 17 = 0 THEN 1 ELSE 0 END) % 8 AS INT) + 1 AS cls
        FROM (SELECT CAST(floor(x/8) AS BIGINT) AS cx, CAST(floor(y/8) AS BIGINT) AS cy, part_id FROM points) p
        GROUP BY cx, cy""",
    "spots": """
        SELECT p_partkey AS id,
               CAST(d % 32 AS DOUBLE)*1000 + CAST((p_partkey*4801) % 8000 AS DOUBLE)/8 AS x,
               CAST(floor(d / 32) AS DOUBLE)*1000 + CAST((p_partkey*3307) % 8000 AS DOUBLE)/8 AS y,
               p_retailprice/20 AS elevation_ft,
               CASE p_size % 3 WHEN 0 THEN 300000 WHEN 1 THEN 300020 ELSE 301000 END AS sub_feature_code
        FROM (SELECT *, CAST(floor(p_partkey / 2000) AS BIGINT) AS d FROM part) p""",
    "overrides": """
        SELECT s_suppkey AS request_id,
               CASE s_suppkey % 3 WHEN 0 THEN 'bin' WHEN 1 THEN 'doitt_id' ELSE 'point' END AS selector,
               CASE s_suppkey % 3 WHEN 0 THEN CAST((s_suppkey % 5 + 1)*1000000 + s_suppkey AS STRING)
                    WHEN 1 THEN CAST(s_suppkey + 500000 AS STRING) ELSE NULL END AS id_value,
               CAST(CAST(floor(s_suppkey / 100) AS BIGINT) % 32 AS DOUBLE)*1000 + CAST((s_suppkey*7919) % 7600 AS DOUBLE)/8 + 2 AS x,
               CAST(floor(s_suppkey / 3200) AS DOUBLE)*1000 + CAST((s_suppkey*6101) % 7600 AS DOUBLE)/8 + 2 AS y,
               CAST(s_suppkey % 4 AS INT) AS material
        FROM supplier""",
    "seams": """
        SELECT d*8 + k AS seam_id, d AS district,
               ox + CASE WHEN k < 4 THEN (k + 1)*200.0e0 ELSE 0.0e0 END AS x1, oy + CASE WHEN k < 4 THEN 0.0e0 ELSE (k - 3)*200.0e0 END AS y1,
               ox + CASE WHEN k < 4 THEN (k + 1)*200.0e0 ELSE 1000.0e0 END AS x2, oy + CASE WHEN k < 4 THEN 1000.0e0 ELSE (k - 3)*200.0e0 END AS y2
        FROM (SELECT d, CAST(d % 32 AS DOUBLE)*1000 AS ox, CAST(floor(d / 32) AS DOUBLE)*1000 AS oy
              FROM (SELECT DISTINCT CAST(floor(c_custkey / 1500) AS BIGINT) AS d FROM customer) c) c2 CROSS JOIN range(8) AS t(k)""",
    "stage_events": """
        SELECT event_id, ts, concat('job_', CAST(user_id AS STRING)) AS job, event_type AS stage,
               CASE event_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'running' WHEN 4 THEN 'failed' ELSE 'completed' END AS status
        FROM events""",
    "log_lines": """
        SELECT file, n AS line_no,
               CASE n WHEN 1 THEN concat('; model printing time: ', h, 'h ', m, 'm 5s; total estimated time: 1d ', h, 'h ', m, 'm 9s')
                      WHEN 2 THEN concat('; total layer number: ', CAST(k % 200 + 1 AS STRING))
                      WHEN 3 THEN concat('; total filament weight [g] : ', CAST(k % 97 AS STRING), '.5,', CAST(k % 31 AS STRING), '.25')
                      WHEN 4 THEN concat('; total filament length [mm] : ', CAST(k % 89 AS STRING), '00.5,', CAST(k % 29 AS STRING), '0.25')
                      WHEN 5 THEN '; filament_type = PLA;PLA'
                      WHEN 6 THEN concat('; filament_cost = 2', CAST(k % 10 AS STRING), ';24')
                      ELSE 'G1 X1 Y1 E1' END AS line
        FROM (SELECT o_orderkey AS k, concat('plate_', CAST(o_orderkey AS STRING), '.gcode') AS file,
                     CAST(o_orderkey % 9 AS STRING) AS h, CAST(o_orderkey % 60 AS STRING) AS m FROM orders) o
             CROSS JOIN range(1, 8) AS t(n)
        WHERE NOT (n = 3 AND k % 19 = 0)""",
    "triangles": """
        SELECT s_suppkey AS part_id, t AS tri_id,
               CASE t WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS v1,
               CASE WHEN s_suppkey % 7 = 0 AND t = 0 THEN 1 ELSE CASE t WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END END AS v2,
               CASE WHEN s_suppkey % 7 = 0 AND t = 0 THEN 2 ELSE CASE t WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 3 END END AS v3
        FROM supplier CROSS JOIN range(4) AS r(t)
        WHERE NOT (s_suppkey % 5 = 0 AND t = 3)""",
    "mesh_vertices": """
        SELECT s_suppkey AS part_id, v AS vertex_id,
               CASE WHEN v = 1 THEN s ELSE 0.0e0 END AS x, CASE WHEN v = 2 THEN s ELSE 0.0e0 END AS y, CASE WHEN v = 3 THEN s ELSE 0.0e0 END AS z
        FROM (SELECT s_suppkey, CAST(s_suppkey % 10 + 1 AS DOUBLE) AS s FROM supplier) p CROSS JOIN range(4) AS r(v)""",
}
_NAMES = re.compile(r"\b(" + "|".join(sorted([*VIEWS, *BASE_TABLES], key=len, reverse=True)) + r")\b")


def _used(sql: str) -> list[str]:
    """Views a text needs, dependencies first."""
    out: list[str] = []
    for name in _NAMES.findall(re.sub(r"'[^']*'", "''", sql)):
        if name in VIEWS and name not in out:
            out += [n for n in _used(VIEWS[name]) if n not in out] + [name]
    return list(dict.fromkeys(out))


def with_views(sql: str) -> str:
    """``sql`` with the derived views it names defined in front of it."""
    views = _used(sql)
    if not views:
        return sql
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + f"\nSELECT * FROM ({sql}) answer"


class Inputs:
    """The derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        def located(match: re.Match) -> str:
            word = match.group(1)
            return f"parquet.`{self.sf_dir}/{word}.parquet`" if word in BASE_TABLES else word

        return self.spark.sql(_NAMES.sub(located, with_views(f"SELECT * FROM {name}")))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self._view(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    def dealt(self, df: DataFrame, base: str, key: str = "id") -> DataFrame:
        """``df`` shared out by ``key``, about ``ROWS_PER_TASK`` rows of the ``base`` table to a task.

        A table of short rows is one small file and thus one task, however many cells are then made of each row.
        """
        parts = -(-self.base(base).count() // ROWS_PER_TASK)
        return df.repartition(parts, key) if parts > 1 else df

    @property
    def spots(self) -> DataFrame:
        return self.dealt(self._view("spots"), "part")

    @property
    def polygons(self) -> DataFrame:
        """Footprints with their boundary as directed edges: outer rings left-turning, holes right-turning."""
        f = self.dealt(self._view("footprints"), "customer")
        box = ("minx", "miny", "maxx", "maxy")
        col = F.col
        mx, my = (col("minx") + col("maxx")) / 2, (col("miny") + col("maxy")) / 2

        def ring(*corners):
            return [
                F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
                for a, b in zip(corners, corners[1:] + corners[:1])
            ]

        x0, y0, x1, y1 = (col(c) for c in box)
        outer = ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
        diamond = ring((mx, y0), (x1, my), (mx, y1), (x0, my))
        inner = ring((x0 + 1, y0 + 1), (x0 + 1, y1 - 1), (x1 - 1, y1 - 1), (x1 - 1, y0 + 1))
        return f.withColumn(
            "edges",
            F.when(col("shape") == 1, F.array(*diamond)).when(col("shape") == 2, F.array(*outer, *inner)).otherwise(F.array(*outer)),
        )

    @property
    def edges(self) -> DataFrame:
        return self.polygons.select("id", F.posexplode("edges").alias("pos", "e")).select("id", "pos", "e.*")

    @property
    def roof_polygons(self) -> DataFrame:
        col = F.col
        corners = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy")]
        edges = [
            F.struct(col(a[0]).alias("x1"), col(a[1]).alias("y1"), col(b[0]).alias("x2"), col(b[1]).alias("y2"))
            for a, b in zip(corners, corners[1:] + corners[:1])
        ]
        return self.dealt(self._view("roofs"), "part").withColumn("edges", F.array(*edges))

    @property
    def districts(self) -> DataFrame:
        d = self.base("customer").select(F.floor(F.col("c_custkey") / 1500).cast("bigint").alias("district")).distinct()
        return d.select(
            "district", (F.col("district") % 32).cast("double").__mul__(1000).alias("ox"),
            F.floor(F.col("district") / 32).cast("double").__mul__(1000).alias("oy"),
        )

    @property
    def seams(self) -> DataFrame:
        k = F.col("k")
        down, across = k < 4, (k - 3) * 200.0
        along = (k + 1) * 200.0
        return self.districts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
            (F.col("district") * 8 + k).alias("seam_id"), "district",
            (F.col("ox") + F.when(down, along).otherwise(0.0)).alias("x1"), (F.col("oy") + F.when(down, 0.0).otherwise(across)).alias("y1"),
            (F.col("ox") + F.when(down, along).otherwise(1000.0)).alias("x2"),
            (F.col("oy") + F.when(down, 1000.0).otherwise(across)).alias("y2"),
        )

    def _repeated(self, name: str, first: int, last: int, var: str) -> DataFrame:
        """A view whose SQL cross joins a constant range, with the range exploded instead."""
        sql = re.sub(r"CROSS JOIN range\([^)]*\) AS \w+\((\w+)\)", rf"LATERAL VIEW explode(sequence({first}, {last})) ex AS {var}", VIEWS[name])
        return self.spark.sql(_NAMES.sub(lambda m: f"parquet.`{self.sf_dir}/{m.group(1)}.parquet`", sql))

    @property
    def log_lines(self) -> DataFrame:
        return self._repeated("log_lines", 1, 7, "n")

    @property
    def triangles(self) -> DataFrame:
        return self._repeated("triangles", 0, 3, "t")

    @property
    def mesh_vertices(self) -> DataFrame:
        return self._repeated("mesh_vertices", 0, 3, "v")
