"""Points and sites near each other: pairs beyond the radius are not handed on, and midpoints are worked out once."""

import math

from pyspark.sql import functions as F

from kerbside.operators import exposure
from kerbside.operators.spatial import points_near_points


def test_kept_points_meet_only_sites_within_the_radius(spark):
    rows = [(i, 37.0 * i % 500, 91.0 * i % 500) for i in range(60)] + [(60, 9000.0, 9000.0)]
    sites = [(j, 53.0 * j % 500, 17.0 * j % 500) for j in range(40)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double")
    spots = spark.createDataFrame(sites, "site_id long, sx double, sy double")
    want = {(i, j): math.dist((x, y), (a, b)) for i, x, y in rows for j, a, b in sites if math.dist((x, y), (a, b)) <= 60}
    alone = {i for i, _, _ in rows} - {i for i, _ in want}
    for size in (None, 30.0):
        for least in (1, 50_000):
            kept = points_near_points(points, spots, 60.0, "point_id", size=size, keep_points=True, min_rows=least).collect()
            assert sorted((r["point_id"], r["site_id"]) for r in kept if r["site_id"] is not None) == sorted(want)
            assert sorted(r["point_id"] for r in kept if r["site_id"] is None) == sorted(alone) and 60 in alone
            assert all(abs(r["distance_m"] - want[r["point_id"], r["site_id"]]) < 1e-9 for r in kept if r["site_id"] is not None)
            inner = points_near_points(points, spots, 60.0, "point_id", size=size, min_rows=least).collect()
            assert sorted((r["point_id"], r["site_id"]) for r in inner) == sorted(want)


def test_industrial_exposure_reads_stored_midpoints(spark):
    segments = spark.range(30).selectExpr("id AS segment_id", "array(named_struct('x', id*100.0D, 'y', 0.0D), named_struct('x', id*100.0D+50.0D, 'y', 0.0D)) AS pts")
    clusters = spark.createDataFrame([(0.0, 0.0), (25.0, 30.0), (25.0, 30.0)], "x double, y double")
    out = exposure.industrial_exposure(segments, clusters)
    assert "array(" not in out._jdf.queryExecution().optimizedPlan().toString()
    first = out.where(F.col("segment_id") == 0).first()
    assert first["facility_count"] == 3 and first["nearest_facility_m"] == 25.0
    far = out.where(F.col("segment_id") == 29).first()
    assert far["facility_count"] == 0 and far["nearest_facility_m"] is None and far["raw_kernel"] == 0.0


def test_traffic_exposure_searches_from_stored_midpoints(spark, monkeypatch):
    """Hot cells are counted in them before the search, so they are worked out once."""
    segments = spark.range(30).selectExpr("id AS segment_id", "array(named_struct('x', id*100.0D, 'y', 0.0D), named_struct('x', id*100.0D+50.0D, 'y', 0.0D)) AS pts")
    roads = spark.createDataFrame([("primary", [(0.0, 40.0), (500.0, 40.0)])], "highway_class string, pts array<struct<x: double, y: double>>")
    given, plain = [], exposure.nearest_leg_by_class
    monkeypatch.setattr(exposure, "nearest_leg_by_class", lambda points, *more, **named: given.append(points._jdf.queryExecution().optimizedPlan().toString()) or plain(points, *more, **named))
    first = exposure.traffic_exposure(segments, roads).where(F.col("segment_id") == 0).first()
    assert first["road_class_count"] == 1 and first["nearest_road_m"] == 40.0
    assert len(given) == 1 and "array(" not in given[0]
