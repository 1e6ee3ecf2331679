"""Streets meet areas cell by cell: one row per cell, legs never broadcast."""

import pytest

from kerbside.operators import profiles

AREA = "hazard string, severity int, cx long, cy long"


@pytest.mark.parametrize("most", [200_000, 5])
def test_areas_are_put_together_and_legs_stay_where_they_are(spark, monkeypatch, most):
    monkeypatch.setattr(profiles, "SMALL_ROWS", most, raising=False)
    # Edge 1 crosses two cells on two legs, edge 2 comes twice, edge 3 is in no area's cell; edges may lack an id.
    legs = [(1, 10.0, 10.0, 150.0, 10.0), (1, 150.0, 10.0, 160.0, 20.0), (2, 250.0, 10.0, 260.0, 10.0), (2, 250.0, 10.0, 260.0, 10.0),
            (3, 9010.0, 9010.0, 9020.0, 9010.0), (None, 20.0, 20.0, 30.0, 20.0)]
    areas = [("pm25", 1 + c % 4, c, 0) for c in range(40)] + [("pm25", 1, 0, 0), ("ozone", 2, 0, 0), ("ozone", 2, 1, 0), (None, 3, 2, 0), ("heat", None, 2, 0), ("heat", 1, None, 0)]
    got = profiles.edges_in_areas(spark.createDataFrame(legs, "edge_id long, x1 double, y1 double, x2 double, y2 double"),
                                  spark.createDataFrame(areas, AREA), 100.0)
    assert got.dtypes == [("edge_id", "bigint"), ("hazard", "string"), ("severity", "int")]
    want = [(1, "pm25", 1), (1, "pm25", 2), (1, "ozone", 2), (2, "pm25", 3), (2, None, 3), (2, "heat", None), (None, "pm25", 1), (None, "ozone", 2)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (most > 5) and "BuildLeft" not in plan
