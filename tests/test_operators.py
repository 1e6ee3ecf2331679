"""Operators against brute force on small data, with hot keys forced where they matter."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import exposure, imagery, paths, profiles, ranking, routes, skew, spatial

RNG = random.Random(7)


def bent_lines(n, rng):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 3000), rng.uniform(0, 3000)
        pts = [(x, y)]
        for _ in range(rng.randint(1, 3)):
            pts.append((pts[-1][0] + rng.uniform(-60, 60), pts[-1][1] + rng.uniform(-60, 60)))
        out.append((i, pts))
    return out


def to_leg(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0 if n == 0 else min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n, 0), 1)
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def to_line(p, pts):
    return min(to_leg(p, a, b) for a, b in zip(pts, pts[1:]))


def line_frame(spark, lines):
    rows = [(i, [{"x": x, "y": y} for x, y in pts], sum(math.dist(a, b) for a, b in zip(pts, pts[1:]))) for i, pts in lines]
    return spark.createDataFrame(rows, "segment_id long, pts array<struct<x:double,y:double>>, length_m double")


@pytest.mark.parametrize("min_rows", [1, 50_000])
def test_tree_exposure_on_bent_lines_with_copies(spark, min_rows):
    lines = bent_lines(60, RNG)
    trees = [(i, RNG.choice(["Quercus", "Acer", "Other"]), RNG.uniform(0, 3000), RNG.uniform(0, 3000)) for i in range(400)]
    trees += [(1000 + i, "Acer", *lines[0][1][1]) for i in range(200)]  # a third of all trees at one corner
    got = {r.segment_id: (r.tree_count, r.allergen_weight) for r in exposure.tree_exposure(
        line_frame(spark, lines), spark.createDataFrame(trees, "tree_id long, genus string, x double, y double"),
        exposure.genus_table(spark), radius=40.0, min_rows=min_rows).collect()}
    rating = {"Quercus": 3.0, "Acer": 2.0, "Other": 0.0}
    for i, pts in lines:
        near = [t for t in trees if to_line((t[2], t[3]), pts) <= 40.0]
        assert got[i] == (len(near), sum(rating[t[1]] for t in near))


@pytest.mark.parametrize("min_rows", [1, 50_000])
def test_traffic_exposure_levels_match_brute_force(spark, min_rows):
    rng = random.Random(3)
    lines = bent_lines(80, rng)
    roads = [(i, rng.choice(["motorway", "primary", "secondary"]), pts) for i, pts in bent_lines(40, rng)]
    frame = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in pts]) for _, k, pts in roads],
                                  "highway_class string, pts array<struct<x:double,y:double>>")
    got = {r.segment_id: r for r in exposure.traffic_exposure(line_frame(spark, lines), frame, radius=500.0, min_rows=min_rows).collect()}
    weight = {"motorway": 5.0, "primary": 3.0, "secondary": 2.0}
    mids = {r.segment_id: (r.x, r.y) for r in exposure.midpoints(line_frame(spark, lines)).collect()}
    for i, _ in lines:
        best = {}
        for _, k, pts in roads:
            d = to_line(mids[i], pts)
            if d <= 500.0:
                best[k] = min(best.get(k, d), d)
        assert got[i].road_class_count == len(best)
        assert got[i].raw_kernel == pytest.approx(sum(weight[k] * math.exp(-d / 300) for k, d in best.items()), abs=1e-9)


def test_kernel_golden_value(spark):
    segments = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 0.0}], 0.0)],
                                     "segment_id long, pts array<struct<x:double,y:double>>, length_m double")
    roads = spark.createDataFrame([("motorway", [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}]),
                                   ("primary", [{"x": 0.0, "y": 300.0}, {"x": 9.0, "y": 300.0}])],
                                  "highway_class string, pts array<struct<x:double,y:double>>")
    row = exposure.traffic_exposure(segments, roads).first()
    assert row.raw_kernel == pytest.approx(5 + 3 * math.exp(-1))


@pytest.mark.parametrize("min_rows", [1, 50_000])
def test_lookup_join_with_hot_and_null_keys(spark, min_rows):
    left = spark.range(3000).select("id", F.expr("CASE WHEN id%3=0 THEN 1 WHEN id%50=1 THEN NULL ELSE id%700 END").alias("k"))
    right = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = {(r.id, r.k, r.v) for r in left.join(right, "k", "left").select("id", "k", "v").collect()}
    got = skew.lookup_join(left, right, ["k"], F.col("id"), "left", min_rows)
    assert got.columns == ["id", "k", "v"] and {tuple(r) for r in got.collect()} == want
    inner = skew.lookup_join(left, right, ["k"], F.col("id"), "inner", min_rows)
    assert {tuple(r) for r in inner.collect()} == {w for w in want if w[2] is not None}


def test_hot_keys_are_bounded_and_found(spark):
    df = spark.range(10_000).select(F.expr("CASE WHEN id%3=0 THEN -1 ELSE id END").alias("k"))
    hot = {r.k: r.hot_salts for r in skew.hot_keys(df, ["k"], min_rows=100).collect()}
    assert set(hot) == {-1} and hot[-1] >= 33
    assert skew.hot_keys(df, ["k"]) is None


@pytest.mark.parametrize("min_rows", [1, 50_000])
def test_percent_rank_matches_window_function(spark, min_rows):
    from pyspark.sql import Window

    rng = random.Random(5)
    values = [rng.choice([0.0, 0.0, rng.uniform(-5, 5), rng.expovariate(1), None, 1e-30, 1e30]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").withColumn("v", F.col("v").cast("float").cast("double"))
    got = {r.id: r.s for r in ranking.percent_rank_pct(df, "id", "v", "s", True, min_rows).collect()}
    want = {r.id: r.s for r in df.where("v IS NOT NULL").select(
        "id", (F.percent_rank().over(Window.orderBy("v")) * 100).alias("s")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (None if v is None else pytest.approx(want[i], abs=1e-9))
    every = {r.id: r.s for r in ranking.percent_rank_pct(df, "id", "v", "s", False, min_rows).collect()}
    ordered = {r.id: r.s for r in df.select("id", (F.percent_rank().over(Window.orderBy(F.asc_nulls_last("v"))) * 100).alias("s")).collect()}
    assert all(every[i] == pytest.approx(ordered[i], abs=1e-9) for i in every)


def test_single_row_ranks_zero(spark):
    df = spark.createDataFrame([(1, 5.0)], "id long, v double")
    assert ranking.percent_rank_pct(df, "id", "v", "s").first().s == 0.0


def test_exact_quantiles_match_numpy(spark):
    data = np.random.default_rng(1).gamma(2.0, 3.0, 999)
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    got = {r.fraction: r.quantile for r in ranking.exact_quantiles(df, "v", (0.25, 0.5, 0.75)).collect()}
    assert all(got[f] == pytest.approx(np.percentile(data, f * 100)) for f in got)


@pytest.mark.parametrize("values,weights,want", [
    ([1.0, 2.0, 3.0], [1, 1, 1], 2.0), ([1.0, 2.0, 3.0], [5, 1, 1], 1.0), ([1.0, 2.0], [1, 1], 1.0),
    ([1.0, 2.0, 3.0], [0, 0, 0], 2.0), ([4.0], [0], 4.0), ([1.0, 2.0, 3.0, 4.0], [0, 0, 0, 0], 3.0)])
def test_weighted_lower_median(spark, values, weights, want):
    df = spark.createDataFrame([(1, v, float(w)) for v, w in zip(values, weights)], "k int, v double, w double")
    assert ranking.weighted_lower_median(df, "k", "v", "w", "m").first().m == want


def test_clusters_match_brute_force_components(spark):
    rng = random.Random(11)
    pts = [(i, rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(300)]
    pts += [(300 + i, 1000.0 + 24.9 * i, 50.0) for i in range(40)]       # a long chain
    pts += [(400 + i, 2000.0 + (i % 7) * 0.5, 80.0) for i in range(200)]  # a dense heap with copies
    parent = {p[0]: p[0] for p in pts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(pts, 2):
        if math.dist(a[1:], b[1:]) <= 25.0:
            parent[find(a[0])] = find(b[0])
    want = {}
    for p in pts:
        want.setdefault(find(p[0]), set()).add(p[0])
    named = spatial.cluster_points(spark.createDataFrame(pts, "facility_id long, x double, y double"), 25.0).collect()
    got = {}
    for r in named:
        got.setdefault(r.cluster_id, set()).add(r.facility_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_snap_breaks_ties_by_id_and_drops_far_points(spark):
    lines = [(9, [(0.0, 10.0), (100.0, 10.0)]), (4, [(0.0, -10.0), (100.0, -10.0)])]
    pts = spark.createDataFrame([(1, 50.0, 0.0), (2, 50.0, 90.0)], "image_id long, x double, y double")
    got = spatial.snap_to_lines(pts, line_frame(spark, lines), 25.0, "image_id", "segment_id").collect()
    assert [(r.image_id, r.segment_id, r.distance_m) for r in got] == [(1, 4, 10.0)]


def test_cheapest_paths_avoid_blocked_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 10.0), ("b", "d", 1.0, 10.0), ("a", "c", 2.0, 5.0), ("c", "d", 2.0, 5.0),
                                   ("b", "a", 1.0, 10.0), ("d", "e", None, 1.0)], "src string, dst string, cost double, length_m double")
    trips = spark.createDataFrame([(1, "a", "d"), (2, "a", "e"), (3, "c", "c")], "od_id int, origin string, destination string")
    got = {r.od_id: (r.cost, r.length_m, r.hops) for r in paths.cheapest_paths(edges, trips).collect()}
    assert got == {1: (2.0, 20.0, 2), 3: (0.0, 0.0, 0)}
    with_plan = edges.withColumn("plan", F.lit("x")).unionByName(edges.where("src<>'b'").withColumn("plan", F.lit("y")))
    both = trips.where("od_id=1").withColumn("plan", F.explode(F.array(F.lit("x"), F.lit("y"))))
    assert {r.plan: r.cost for r in paths.cheapest_paths(with_plan, both, plan="plan").collect()} == {"x": 2.0, "y": 4.0}


def test_variant_selection_golden_case(spark):
    rows = [("fastest", 1, 0.0, 1000.0), ("balanced", 1, 1.0, 1300.0), ("balanced", 2, 0.5, 1150.0), ("balanced", 3, 0.25, 1080.0),
            ("cleanest", 1, 2.0, 1500.0), ("cleanest", 2, 1.0, 1300.0), ("cleanest", 3, 0.5, 1250.0)]
    frame = spark.createDataFrame([(1, *r) for r in rows], "od_id int, variant string, attempt int, weight_scale double, distance_m double")
    people = spark.createDataFrame([(1, 0.1)], "od_id int, detour_tolerance double")
    got = {r.variant: r for r in routes.compare_variants(frame, people).collect()}
    assert (got["balanced"].distance_m, got["balanced"].weight_scale, got["balanced"].detour_cap_exceeded) == (1080.0, 0.25, False)
    assert (got["cleanest"].distance_m, got["cleanest"].weight_scale, got["cleanest"].attempts, got["cleanest"].detour_cap_exceeded) == (1250.0, 0.5, 3, True)


def test_instances_ignore_speckle_and_join_diagonals(spark):
    grid = np.zeros((40, 40), dtype=int)
    grid[2:8, 2:8] = 3
    grid[8:14, 8:14] = 3      # touches the first block at a corner
    grid[30, 30] = 3          # speckle
    grid[20:26, 30:36] = 4
    masks = spark.createDataFrame([(1, 40, 40, grid.ravel().tolist())], "image_id long, height int, width int, mask array<int>")
    row = imagery.instance_counts(masks, {0: "sky", 3: "car", 4: "person"}).first()
    assert (row.vehicle_count, row.person_count) == (1, 1)


def test_crowd_uses_dashboard_frames_only_without_others(spark):
    rows = [(1, 10, "2024-01-01", 0.4, 0.9, 0.8), (2, 10, "2024-01-01", 0.6, 0.2, 0.1), (3, 11, "2024-01-01", 0.5, 0.7, 0.9)]
    frames = spark.createDataFrame(rows, "image_id int, segment_id int, d string, sky_view_factor double, crowd_density double, ego_vehicle_frac double") \
        .withColumn("captured_at", F.to_timestamp("d"))
    got = {r.segment_id: r for r in imagery.image_features(frames, F.to_timestamp(F.lit("2024-02-01"))).collect()}
    assert got[10].crowd_density_raw == 0.2 and got[10].sky_view_factor_raw == 0.4 and got[10].frame_count == 2
    assert got[11].crowd_density_raw == 0.7


def test_presets_merge_key_by_key(spark):
    req = spark.createDataFrame([(1, "Asthma", {"pm25": 1.0}, None, None, None, None)],
                                "profile_id int, preset string, weights map<string,double>, hard_avoids array<string>, max_grade_pct double, "
                                "detour_tolerance double, conservatism double")
    row = profiles.expand_profiles(req).first()
    assert row.weights == {"pm25": 1.0, "ozone": 3.0, "traffic_prox": 2.0, "construction": 2.0, "cold_air": 1.5}
    assert (row.max_grade_pct, row.detour_tolerance, row.conservatism) == (20.0, 0.25, 1.0)


def test_long_paths_are_exact_and_their_edges_come_in_order(spark):
    chain = [(i, i + 1, 1.0, 10.0, i) for i in range(40)] + [(0, 40, 100.0, 5.0, 99), (50, 51, 1.0, 1.0, 100)]
    edges = spark.createDataFrame(chain, "src long, dst long, cost double, length_m double, edge_id long")
    trips = spark.createDataFrame([(1, 0, 40), (2, 0, 51), (3, 7, 7), (4, 0, 3)], "od_id long, origin long, destination long")
    labels = paths.path_labels(edges, trips)
    got = {r["od_id"]: (r["cost"], r["hops"], r["reached"]) for r in paths.arrivals(labels, trips).collect()}
    assert got == {1: (40.0, 40, True), 2: (None, None, False), 3: (0.0, 0, True), 4: (3.0, 3, True)}
    steps = sorted(tuple(r) for r in paths.path_edges(labels, trips).collect())
    assert steps == [(1, i + 1, i, i + 1, i) for i in range(40)] + [(4, i + 1, i, i + 1, i) for i in range(3)]


def test_searches_from_both_ends_meet_on_the_same_paths_and_see_little_of_the_streets(spark):
    import random
    rng = random.Random(12)
    rows = [(n * 2 + k, n, to, float(rng.randint(1, 3)), float(rng.randint(1, 9))) for n in range(600) for k, to in enumerate((rng.randrange(600), (n + 1) % 600))]
    rows += [(5000, 3, 700, 0.0, 1.0), (5001, 700, 3, 0.0, 1.0), (5002, 3, 8, None, 1.0), (5003, 701, 3, 1.0, 1.0)] + rows[:20]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, cost double, length_m double")
    ends = [(rng.randrange(600), rng.randrange(600)) for _ in range(12)] + [(5, 5), (3, 700), (700, 90), (4, 701), (701, 17), (5, 40), (9, 40), (5, None), (None, 5), (999, 5)]
    trips = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)] + [(0, *ends[0])], "od_id long, origin long, destination long")
    told = []
    for meet in (False, True):
        labels = paths.path_labels(edges, trips, meet=meet)
        assert labels.groupBy("origin", "node").count().where("count > 1").isEmpty()
        told.append((sorted(map(repr, paths.arrivals(labels, trips).collect())), sorted(tuple(r) for r in paths.path_edges(labels, trips).collect()), labels.count()))
    assert told[0][0] == told[1][0] and told[0][1] == told[1][1] and len(told[0][1]) > 60
    assert told[1][2] < 0.6 * told[0][2]


def test_profiles_of_their_own_price_their_trips(spark):
    from kerbside.plans.compare import compare_trips, explain_trips
    from kerbside.vocab import WAY_SCORES
    low = {n: 10 for n in WAY_SCORES} | {"grade": 1, "industrial_within_200m": 0}
    rows = [(1, 10, "a", "b", 100.0, low | {"pm25": 95}), (2, 20, "a", "c", 55.0, low), (3, 30, "c", "b", 54.0, low)]
    names = list(WAY_SCORES)
    edges = spark.createDataFrame([(*r[:5], 1.25, *[float(r[5][n]) for n in names]) for r in rows],
                                  "edge_id long, osm_way_id long, src string, dst string, length_m double, speed_mps double, "
                                  + ", ".join(f"{n} double" for n in names))
    people = spark.createDataFrame([("asthma", {"pm25": 3.0}, [], 20.0, 0.1, 1.0), ("none", {}, [], 20.0, 0.1, 1.0), ("strict", {"pm25": 3.0}, [], 20.0, 0.01, 1.0)],
                                   "profile_id string, weights map<string,double>, hard_avoids array<string>, max_grade_pct double, "
                                   "detour_tolerance double, conservatism double")
    trips = spark.createDataFrame([(1, "asthma", "a", "b"), (2, "none", "a", "b"), (3, "strict", "a", "b"), (4, "none", "b", "a")],
                                  "od_id long, profile_id string, origin string, destination string")
    chosen, walked = compare_trips(edges, people, trips)
    got = {(r["od_id"], r["variant"]): (r["distance_m"], r["attempts"], r["detour_cap_exceeded"]) for r in chosen.collect()}
    assert {k: v[0] for k, v in got.items() if k[0] < 3} == {(1, "fastest"): 100.0, (1, "balanced"): 109.0, (1, "cleanest"): 109.0,
                                                           (2, "fastest"): 100.0, (2, "balanced"): 100.0, (2, "cleanest"): 100.0}
    assert got[3, "balanced"][1] > 1 and got[3, "fastest"] == (100.0, 1, False) and not any(k[0] == 4 for k in got)
    steps = sorted((r["od_id"], r["variant"], r["position"], r["osm_way_id"]) for r in walked.collect())
    assert [s for s in steps if s[:2] == (1, "balanced")] == [(1, "balanced", 1, 20), (1, "balanced", 2, 30)]
    ways = edges.select("osm_way_id", *names)
    told = {(r["od_id"], r["variant"]): r for r in explain_trips(chosen, walked, ways).collect()}
    assert told[1, "fastest"]["pm25"] == 95.0 and told[1, "balanced"]["pm25"] == 10.0 and told[1, "balanced"]["pm25_change"] < 0


def test_any_number_of_rasters_and_the_first_valid_value_wins(spark):
    from kerbside.operators import raster
    meta = spark.createDataFrame([(f"r{i}", i, 0.0, 10.0, 5.0, 5.0, 2, 2, -9999.0) for i in range(100)] + [("far", 0, 500.0, 510.0, 5.0, 5.0, 2, 2, None)],
                                 "raster string, priority int, origin_x double, origin_y double, cell_x double, cell_y double, n_rows int, n_cols int, nodata double")
    cells = spark.createDataFrame([(f"r{i}", 0, 0, -9999.0 if i < 70 else float(i)) for i in range(100)] + [("r3", 1, 1, 7.0), ("far", 1, 0, float("nan"))],
                                  "raster string, row int, col int, value double")
    points = spark.createDataFrame([(1, 2.0, 8.0), (2, 7.0, 2.0), (3, 2.0, 2.0), (4, 501.0, 501.0), (5, -1.0, 8.0), (6, 2.0, 8.0)], "id int, x double, y double")
    got = {r.id: r.v for r in raster.sample_raster(points, cells, meta, "v").collect()}
    assert got == {1: 70.0, 2: 7.0, 3: None, 4: None, 5: None, 6: 70.0}


def grid_city(rng, side=12):
    """Streets of a square city, 100 m apart, of unequal scores; some are one-way."""
    from kerbside.vocab import WAY_SCORES
    rows, at = [], {}
    for x in range(side):
        for y in range(side):
            at[x * side + y] = (100.0 * x, 100.0 * y)
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < side and y + dy < side:
                    a, b = x * side + y, (x + dx) * side + y + dy
                    for src, dst in ((a, b), (b, a))[: 1 if rng.random() < 0.1 else 2]:
                        scores = {n: float(rng.randint(0, 100)) for n in WAY_SCORES} | {"grade": 1.0, "industrial_within_200m": 0.0}
                        rows.append((len(rows), len(rows), src, dst, 100.0 + rng.random(), 1.25, *scores.values()))
    names = ", ".join(f"{n} double" for n in {n: 0 for n in WAY_SCORES} | {"grade": 0, "industrial_within_200m": 0})
    return rows, at, f"edge_id long, osm_way_id long, src long, dst long, length_m double, speed_mps double, {names}"


def dijkstra(edges, cost, origin):
    import heapq
    out, heap = {}, [(0.0, origin, None)]
    follow = {}
    for e in edges:
        follow.setdefault(e[2], []).append(e)
    while heap:
        c, n, via = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = (c, via)
        for e in follow.get(n, []):
            w = cost.get(e[0])
            if w is not None and e[3] not in out:
                heapq.heappush(heap, (c + w, e[3], e[0]))
    return out


def test_searches_price_edges_as_they_reach_them(spark):
    import random

    from kerbside.plans.compare import attempt_price
    rng = random.Random(8)
    rows, at, schema = grid_city(rng, 7)
    edges = spark.createDataFrame(rows, schema)
    people = spark.createDataFrame([("a", "balanced", {"pm25": 3.0, "no2": 1.0}, [], 20.0, 1.0), ("b", "balanced", {"ozone": 2.0}, [], 20.0, 1.0), ("b", "fastest", {"ozone": 2.0}, [], 20.0, 1.0)],
                                   "profile_id string, variant string, weights map<string,double>, hard_avoids array<string>, max_grade_pct double, conservatism double")
    ends = [(0, 48), (5, 33), (20, 21), (48, 6), (0, 15), (9, 9), (16, 18)]
    trips = spark.createDataFrame([(i, p, v, *e) for i, e in enumerate(ends) for p, v in (("a", "balanced"), ("b", "balanced"), ("b", "fastest"))],
                                  "od_id long, profile_id string, variant string, origin long, destination long")
    places = spark.createDataFrame([(n, *p) for n, p in at.items()], "node long, x double, y double")
    price = attempt_price(F.when(F.col("variant") == "fastest", 0.0).otherwise(1.0))
    full = price(edges.withColumn("areas", F.lit(None).cast("array<struct<hazard:string,severity:int>>")).crossJoin(people)).select("profile_id", "variant", "edge_id", "cost").collect()
    costs = {}
    for r in full:
        costs.setdefault((r[0], r[1]), {})[r[2]] = r[3]
    want = {(i, p, v): dijkstra(rows, costs[p, v], e[0])[e[1]][0] for i, e in enumerate(ends) for p, v in costs}
    network = edges.withColumn("areas", F.lit(None).cast("array<struct<hazard:string,severity:int>>"))
    sizes = []
    for known, every in ((None, 8), (places, 1)):
        labels = paths.path_labels(network, trips, ["profile_id", "variant"], people, price, known, settle_every=every)
        got = {(r["od_id"], r["profile_id"], r["variant"]): r["cost"] for r in paths.arrivals(labels, trips, ["profile_id", "variant"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        assert labels.groupBy("profile_id", "variant", "origin", "node").count().where("count > 1").isEmpty()
        sizes.append(labels.count())
    assert sizes[1] < 0.9 * sizes[0]     # the bound keeps searches from looking everywhere


def test_smoke_moves_routes_and_only_concerned_searches_run_again(spark, monkeypatch):
    import random

    from kerbside.plans import compare
    rng = random.Random(9)
    rows, at, schema = grid_city(rng, 5)
    edges = spark.createDataFrame(rows, schema)
    people = spark.createDataFrame([("lungs", {"pm25": 3.0}, [], 20.0, 0.5, 1.0), ("none", {}, [], 20.0, 0.5, 1.0)],
                                   "profile_id string, weights map<string,double>, hard_avoids array<string>, max_grade_pct double, detour_tolerance double, conservatism double")
    trips = spark.createDataFrame([(1, "lungs", 0, 24), (2, "none", 0, 24), (3, "lungs", 4, 20), (4, "lungs", 24, 23)],
                                  "od_id long, profile_id string, origin long, destination long")
    places = spark.createDataFrame([(n, *p) for n, p in at.items()], "node long, x double, y double")
    smoke = spark.createDataFrame([(r[0], "pm25", 4) for r in rows if 1 <= r[2] % 5 <= 2 and r[2] // 5 < 3], "edge_id long, hazard string, severity int")
    again = []
    plain = compare.paths.path_labels
    monkeypatch.setattr(compare.paths, "path_labels", lambda network, waiting, *more: again.append(
        {tuple(r) for r in waiting.select("profile_id", "variant", "origin").distinct().collect()}) or plain(network, waiting, *more))
    stale = compare.paths.stale_searches
    monkeypatch.setattr(compare.paths, "stale_searches", lambda *given: again.append("stale") or stale(*given))
    moved = {(r["od_id"], r["variant"]): r for r in compare.compare_scenarios(edges, people, trips, None, smoke, places=places).collect()}
    first_again = again[again.index("stale") + 1]
    assert not any(p == "none" or v == "fastest" for p, v, _ in first_again) and {o for _, _, o in first_again} >= {0, 4}
    fresh, walked = compare.compare_trips(edges, people, trips, smoke, places=places)
    clear, walked_clear = compare.compare_trips(edges, people, trips, places=places)
    far = {(r["od_id"], r["variant"]): r["distance_m"] for r in fresh.collect()}
    near = {(r["od_id"], r["variant"]): r["distance_m"] for r in clear.collect()}
    way = [{}, {}]
    for side, steps in zip(way, (walked_clear, walked)):
        for r in steps.collect():
            side.setdefault((r["od_id"], r["variant"]), set()).add((r["position"], r["edge_id"]))
    assert len(moved) == 12
    for key, r in moved.items():
        assert abs(r["shift_m"] - abs(far[key] - near[key])) < 1e-9 and r["path_changed"] == (way[0].get(key) != way[1].get(key))
    assert moved[1, "balanced"]["path_changed"] and not moved[2, "cleanest"]["path_changed"] and not moved[1, "fastest"]["path_changed"]


def test_selection_of_values_that_hardly_differ(spark):
    """Order numbers tell all doubles apart; quantiles and weighted medians need no sort."""
    import random
    import struct
    rng = random.Random(10)
    odd = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 1e-310, -1e-310, 1.0, 1.0 + 2 ** -52, 1.0 - 2 ** -53, 2.0, 8.0, 7.999999999999999, -8.0, 1e308, 1.7976931348623157e308, float("inf"), -float("inf")]
    odd += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(500)]
    odd = sorted(v for v in odd if v == v)
    numbers = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v double").select("i", ranking.order_number(F.col("v")).alias("o")).orderBy("i").select("o").collect()]
    assert all((a < b) == (x < y) for a, b, x, y in zip(odd, odd[1:], numbers, numbers[1:])) and numbers == sorted(numbers)
    assert spark.sql("select double('NaN') v").select(ranking.order_number(F.col("v"))).first()[0] == 2 ** 63 - 1
    close = [100.0 + rng.random() * 0.1 for _ in range(5000)]
    rows = [(None if i % 7 == 0 else i % 3, v, rng.choice([0.0, 1.0, 2.5])) for i, v in enumerate(close)] + [(9, None, 1.0), (8, 5.0, 0.0), (8, 7.0, 0.0), (8, 6.0, None)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    got = {(r["g"], r["fraction"]): r["quantile"] for r in ranking.exact_quantiles(df, "v", (0.0, 0.3, 1.0), ["g"]).collect()}
    for g in (None, 0, 1, 2, 8):
        mine = [v for k, v, _ in rows if k == g and v is not None]
        assert all(abs(got[g, q] - np.quantile(mine, q)) < 1e-12 for q in (0.0, 0.3, 1.0))
    assert len(got) == 15
    medians = {r["g"]: r["m"] for r in ranking.weighted_lower_median(df.where("g is not null"), "g", "v", "w", "m").collect()}
    for g in (0, 1, 2):
        mine = sorted((v, w) for k, v, w in rows if k == g)
        run, half = 0.0, sum(w for _, w in mine) / 2
        for v, w in mine:
            run += w
            if run >= half:
                break
        assert medians[g] == v
    assert medians[8] == 6.0 and 9 not in medians


def test_many_ranks_at_once_agree_with_one_at_a_time(spark):
    import random
    rng = random.Random(11)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()]), rng.choice([None, 5.0, rng.random()]), None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    for skip in (True, False):
        got = {r["id"]: tuple(r)[1:] for r in ranking.percent_ranks_pct(df, "id", {"a": "ra", "b": "rb", "c": "rc"}, skip, 20).collect()}
        want = [{r["id"]: r["s"] for r in ranking.percent_rank_pct(df, "id", v, "s", skip).select("id", "s").collect()} for v in "abc"]
        assert got == {i: tuple(w[i] for w in want) for i in got} and len(got) == 300


@pytest.mark.parametrize("levels", [None, 1, 7])
def test_nearest_legs_are_exact_and_no_copy_of_a_leg_is_broadcast(spark, monkeypatch, levels):
    """A few long legs become many rows over the cells, which the planner takes for a few."""
    rng = random.Random(5)
    plans = []

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    kept = spatial.stored
    monkeypatch.setattr(spatial, "stored", watched)
    legs = [(rng.choice("ab"), rng.uniform(0, 4000), rng.uniform(0, 4000)) for _ in range(60)]
    legs = [(c, x, y, x + rng.uniform(-900, 900), y + rng.uniform(-900, 900)) for c, x, y in legs]
    points = [(i, rng.uniform(-500, 4500), rng.uniform(-500, 4500)) for i in range(150)] + [(7, 100.0, 100.0), (7, 100.0, 100.0), (900, None, 5.0)]
    got = spatial.nearest_leg_by_class(
        spark.createDataFrame(points, "segment_id long, x double, y double"),
        spark.createDataFrame(legs, "kind string, x1 double, y1 double, x2 double, y2 double"), 1000.0, "segment_id", "kind", ["a", "b", "c"], levels).collect()
    assert len(got) == 3 * len(set(points))
    for r in got:
        near = [to_leg((r.x, r.y), leg[1:3], leg[3:]) for leg in legs if leg[0] == r.kind] if r.x is not None else []
        want = min((d for d in near if d <= 1000), default=None)
        assert (r.nearest_m is None) == (want is None) and (want is None or abs(r.nearest_m - want) < 1e-6)
    assert plans and not any("BroadcastHashJoin" in p or "BroadcastNestedLoop" in p for p in plans)


def test_few_cells_are_broadcast_and_many_are_not(spark, monkeypatch):
    from kerbside.operators import raster
    meta = spark.createDataFrame([("g", 0, 0.0, 20.0, 10.0, 10.0, 2, 2, -9.0)], "raster string, priority int, origin_x double, origin_y double, "
                                 "cell_x double, cell_y double, n_rows int, n_cols int, nodata double")
    cells = spark.createDataFrame([("g", r, c, float(10 * r + c)) for r in range(2) for c in range(2)], "raster string, row int, col int, value double")
    points = spark.createDataFrame([(1, 5.0, 15.0), (2, 15.0, 5.0), (3, 25.0, 5.0)], "point_id long, x double, y double")
    found = raster.sample_raster(points, cells, meta)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    few = {r.point_id: r.value for r in found.collect()}
    monkeypatch.setattr(raster, "SMALL_ROWS", 0)
    assert few == {r.point_id: r.value for r in raster.sample_raster(points, cells, meta).collect()} == {1: 0.0, 2: 11.0, 3: None}
