"""Exposures of routes: the segments are grouped once, and the comparison of variants reads stored exposures."""

from catalog.base import Tables
from catalog.routes import exposed, trip_routes


def test_exposures_group_the_segments_once(spark, tmp_path):
    lines = spark.range(60).selectExpr("id div 3 AS l_orderkey", "cast(id%3+1 as int) AS l_linenumber", "cast(id%40+1 as double) AS l_quantity",
                                       "0.05D AS l_tax", "id*10.0D AS l_extendedprice")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    got = exposed(t)
    assert "l_orderkey" not in got._jdf.queryExecution().optimizedPlan().toString()
    lengths = {r["route_id"]: r["distance_m"] for r in got.collect()}
    assert lengths == {k: sum(2.0 * (i % 40 + 1) for i in range(3 * k, 3 * k + 3)) for k in range(20)}
    trips = trip_routes(t)
    assert "osm_way_id" not in trips._jdf.queryExecution().optimizedPlan().toString() and trips.count() == 20
