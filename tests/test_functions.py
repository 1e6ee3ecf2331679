"""Known values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from kerbside.functions import geo, numbers, rules, text
from kerbside.operators import profiles, raster
from kerbside.vocab import WAY_SCORES


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_recency_weight_falls_to_1_over_e_after_one_tau(spark):
    as_of = F.timestamp_seconds(F.lit(1_700_000_000))
    then = F.timestamp_seconds(F.lit(1_700_000_000 - int(5 * 365.25 * 86400)))
    assert value(spark, numbers.recency_weight(then, as_of, 5.0)) == pytest.approx(0.367879, abs=1e-6)
    assert value(spark, numbers.recency_weight(as_of, then, 5.0)) == 1.0


def test_grade_limits(spark):
    for za, zb, length, want, hit in ((0.0, 5.0, 100.0, 5.0, False), (0.0, 50.0, 100.0, 20.0, True),
                                      (50.0, 0.0, 100.0, -20.0, True), (0.0, 5.0, 0.0, None, False)):
        grade, clamped = raster.grade_pct(F.lit(za), F.lit(zb), F.lit(length))
        assert value(spark, grade) == want and value(spark, clamped) is hit
    assert value(spark, raster.grade_pct(F.lit(None).cast("double"), F.lit(1.0), F.lit(10.0))[0]) is None


def test_packing_round_trip(spark):
    scores = [1, 20.6, 40.4, 59.2, 78.1, 99.9, 120, 6.4, 100, 12, 89]
    packs = numbers.pack_scores([F.lit(float(s)) for s in scores])
    got = [value(spark, numbers.unpack_score(packs, n)) for n in WAY_SCORES]
    assert got == [1, 21, 40, 59, 78, 100, 100, 6, 100, 12, 89]
    empty = numbers.pack_scores([F.lit(float("nan"))] * 9 + [F.lit(127.0)] * 2)
    assert value(spark, numbers.unpack_score(empty, "svf")) == 127
    assert value(spark, numbers.unpack_score(empty, "pm25")) == 0


def test_negative_distance_is_refused(spark):
    with pytest.raises(Exception, match="must not be negative"):
        value(spark, numbers.distance_decay(F.lit(-1.0), 300.0))


def test_projection_anchor_points(spark):
    # Central meridian and equator of zone 18, and the origin of the Long Island plane.
    east, north = geo.to_utm18(F.lit(-75.0), F.lit(0.0))
    assert value(spark, east) == pytest.approx(500000.0) and value(spark, north) == pytest.approx(0.0, abs=1e-6)
    x, y = geo.to_long_island_ft(F.lit(-74.0), F.lit(40 + 10 / 60))
    assert value(spark, x) == pytest.approx(984250.0, abs=0.01) and value(spark, y) == pytest.approx(0.0, abs=0.01)
    # One degree of latitude near New York is about 111.05 km times the scale factor.
    a, b = geo.to_utm18(F.lit(-75.0), F.lit(40.0))[1], geo.to_utm18(F.lit(-75.0), F.lit(41.0))[1]
    assert value(spark, b) - value(spark, a) == pytest.approx(111_000, rel=2e-3)


def test_band_multipliers(spark):
    row = spark.createDataFrame([(80, 40, 127, 10)], "pm25 int, no2 int, svf int, shade int")
    got = row.select(profiles.band_multiplier("pm25", F.lit(3.0), False).alias("a"),
                     profiles.band_multiplier("pm25", F.lit(6.0), False).alias("b"),
                     profiles.band_multiplier("no2", F.lit(3.0), False).alias("c"),
                     profiles.band_multiplier("svf", F.lit(3.0), True).alias("d"),
                     profiles.band_multiplier("shade", F.lit(3.0), True).alias("e")).first()
    assert (got.a, got.b, got.c, got.d, got.e) == (0.25, 0.1429, round(1 / 1.99, 4), 1.0, 0.25)


def test_area_multiplier(spark):
    assert value(spark, profiles.area_multiplier(F.lit(3.0), F.lit(1.0), F.lit(4))) == 0.25
    assert value(spark, profiles.area_multiplier(F.lit(1.5), F.lit(1.0), F.lit(2))) == pytest.approx(0.8125)


def test_daylight_includes_the_last_minute_of_hour_17(spark):
    at = lambda s: rules.is_daylight(F.to_timestamp(F.lit(s)))
    assert value(spark, at("2024-01-10 22:59:00")) is True   # 17:59 in New York
    assert value(spark, at("2024-01-10 23:00:00")) is False


def test_texts(spark):
    assert text.normalise_header("3. FRS ID") == "frsid"
    assert value(spark, text.first_number(F.lit("10 to 15 mph"))) == 10.0
    assert value(spark, text.first_number(F.lit("calm"))) is None
    assert value(spark, text.fmt_offset(F.lit(1234.0))) == "1.2 km"
    assert value(spark, text.fmt_signed_percent(F.lit(0.01))) == "Same"
    with pytest.raises(Exception, match="unknown key"):
        value(spark, text.canonical_key(F.lit("hover"), {"foot": "foot"}))
    with pytest.raises(Exception, match="unsupported severity"):
        value(spark, text.area_name(F.lit("pm25"), F.lit(0)))


def test_point_at_and_distance(spark):
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (30, 0), (30, 40))])
    spot = value(spark, geo.point_at(line, F.lit(0.5)))
    assert (spot.x, spot.y) == (30.0, 5.0)
    assert value(spark, geo.line_length(line)) == 70.0
    d = geo.point_leg_m(F.lit(10.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(0.0))
    assert value(spark, d) == 5.0
    far = geo.point_leg_m(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert math.isclose(value(spark, far), 5.0)


def test_a_straight_line_is_walked_like_any_other(spark):
    """Two points take the compiled path; the same line with its start repeated takes the other."""
    def line(*pts):
        return F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in pts])

    for a, b in [((1.0, 2.0), (4.0, 6.0)), ((3.0, 3.0), (3.0, 3.0)), ((0.1, 0.7), (None, 1.0)), ((-5.0, 0.3), (7.7, 0.3))]:
        for share in (-0.5, 0.0, 0.25, 1 / 3, 1.0, 2.0):
            straight = value(spark, geo.point_at(line(a, b), F.lit(share)))
            assert straight == value(spark, geo.point_at(line(a, a, b), F.lit(share)))
    plan = spark.range(1).select(geo.point_at(line((0, 0), (1, 1)), F.rand())["x"].alias("x"))
    assert "CASE WHEN" in plan._jdf.queryExecution().analyzed().toString()
