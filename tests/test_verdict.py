"""Cases that once were dropped or refused."""

import json

from cityloom.operators.audits import stale_stages
from cityloom.sources.vectors import ingest_feature_collection


def test_multipolygons_are_kept(spark, folder):
    square = lambda x: [[[x, 0], [x + 4, 0], [x + 4, 4], [x, 4], [x, 0]]]
    kinds = [("Polygon", square(0)), ("MultiPolygon", [square(10), square(20)]), ("Polygon", square(30))]
    page = {"features": [{"properties": {"bin": str(i)}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(kinds)]}
    with open(f"{folder}/page_000000000.json", "w") as out:
        json.dump(page, out)
    rows = ingest_feature_collection(spark, folder).orderBy("minx").collect()
    assert [(r.minx, r.maxx) for r in rows] == [(0, 4), (10, 24), (30, 34)]
    assert [len(r.edges) for r in rows] == [4, 8, 4]


def test_long_chains_of_stages(spark):
    n = 70
    deps = spark.createDataFrame([("j", f"s{i + 1}", f"s{i}") for i in range(n)], "job string, stage string, reads string")
    changed = spark.createDataFrame([("j", "s0")], "job string, stage string")
    assert stale_stages(deps, changed).count() == n + 1
