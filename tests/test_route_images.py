"""Sampling images along routes: every input is worked through once, and steps at corners are right."""

import math

import pytest

from kerbside.operators import imagery


def walk(pts, at):
    legs = [(a, b, math.dist(a, b)) for a, b in zip(pts, pts[1:])]
    done = 0.0
    for k, (a, b, m) in enumerate(legs):
        if at < done + m or k == len(legs) - 1:
            share = (at - done) / m if m else 0.0
            return a[0] + (b[0] - a[0]) * share, a[1] + (b[1] - a[1]) * share
        done += m


def test_steps_of_crooked_routes_equal_a_walk(spark):
    routes = {1: [(0, 0), (100, 0), (100, 75)], 2: [(5 * i, 4 * (i % 2)) for i in range(60)], 3: [(0, 0), (53, 0), (53, 3), (60, 3), (60, 90)],
              4: [(0, 0), (50, 0), (50, 0), (100, 0)], 5: [(7, 7), (7, 7)], 6: [(0, 0), (9, 0)]}
    rows = [(k, [(float(x), float(y)) for x, y in pts]) for k, pts in routes.items()]
    got = {(r["route_id"], r["step"]): r for r in imagery.route_steps(
        spark.createDataFrame(rows, "route_id long, pts array<struct<x:double,y:double>>")).collect()}
    want = 0
    for k, pts in routes.items():
        length = sum(math.dist(a, b) for a, b in zip(pts, pts[1:]))
        for step in range(int(length // 50) + 1):
            want += 1
            r, t = got[k, step], step * 50.0
            a, b = walk(pts, max(t - 10, 0.0)), walk(pts, min(t + 10, length))
            assert (r["x"], r["y"]) == pytest.approx(walk(pts, t)) and r["distance_offset_m"] == t
            bearing = 0.0 if a == b else math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])) % 360
            assert r["bearing_deg"] == pytest.approx(bearing)
    assert len(got) == want


def test_the_window_steps_read_stored_frames(spark):
    routes = spark.createDataFrame([(k, [(0.0, 10.0 * k), (400.0, 10.0 * k)]) for k in range(20)],
                                   "route_id long, pts array<struct<x:double,y:double>>")
    images = spark.createDataFrame([(i, 13.0 * i, 7.0 * (i % 20), 90.0) for i in range(30)],
                                   "image_id long, x double, y double, compass_angle double")
    frames = imagery.sample_route_images(routes, images)
    plan = frames._jdf.queryExecution().optimizedPlan().toString()
    # The search spreads legs and cells by generators; numbering must not repeat it.
    assert frames.count() > 0 and "Generate" not in plan
