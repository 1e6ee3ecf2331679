"""Profiles, edge pricing, route comparison, announcements, history and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, PERMIT_DAY, Tables, q4, r4, register, ts
from catalog.live import CONDITIONS, aqi_readings
from kerbside.functions.geo import MERCATOR_HALF_M
from kerbside.functions.text import speech_key
from kerbside.operators import live, paths, profiles, routes, tiles
from kerbside.operators.spatial import legs_of
from kerbside.session import stored
from kerbside.vocab import CLOSING_LINE, HAZARD_LINES, HAZARDS, OPENING_CALM, OPENING_ELEVATED, PRESETS, ROUTE_EXPOSURES

PRESET_NAMES = list(PRESETS)


# --- profiles ----------------------------------------------------------------------------------------
def requests(t: Tables):
    """One request per customer: a preset by number, sometimes with an own weight and grade limit."""
    preset = F.element_at(F.array(*[F.lit(p) for p in PRESET_NAMES]), (F.col("c_custkey") % 6).cast("int") + 1)
    own = F.create_map(F.lit("no2"), (F.col("c_nationkey") % 4).cast("double"), F.lit("pm25"), F.lit(1.0))
    return t.raw("customer").select(
        F.col("c_custkey").alias("profile_id"), preset.alias("preset"), F.lit("foot").alias("mode"),
        F.when(F.col("c_custkey") % 4 == 0, own).alias("weights"), F.lit(None).cast("array<string>").alias("hard_avoids"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(7.5)).alias("max_grade_pct"), F.lit(None).cast("double").alias("detour_tolerance"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(1.5)).alias("conservatism"))


def _preset_rows() -> str:
    return " UNION ALL ".join(f"SELECT {i} AS n, '{h}' AS hazard, {w}::double AS weight"
                              for i, p in enumerate(PRESET_NAMES) for h, w in PRESETS[p][0].items())


GRADES = "[" + ",".join(f"{PRESETS[p][2]}::double" for p in PRESET_NAMES) + "]"
WEIGHTS = f"""pw AS ({_preset_rows()}),
prof AS (SELECT c_custkey AS profile_id, c_custkey%6 AS n, c_nationkey, coalesce(CASE WHEN c_custkey%5=0 THEN 7.5::double END, ({GRADES})[cast(c_custkey%6 as int)+1]) AS max_grade_pct, CASE WHEN c_custkey%3=0 THEN 1.5::double ELSE 1.0::double END AS conservatism FROM customer),
own AS (SELECT profile_id, 'no2' AS hazard, cast(c_nationkey%4 as double) AS weight FROM prof WHERE profile_id%4=0 UNION ALL SELECT profile_id, 'pm25', 1.0 FROM prof WHERE profile_id%4=0),
weight AS (SELECT profile_id, hazard, weight FROM own UNION ALL SELECT profile_id, hazard, weight FROM prof JOIN pw USING (n) WHERE NOT (profile_id%4=0 AND hazard IN ('no2','pm25')))"""


@register("k1_expand_profiles", f"WITH {WEIGHTS} SELECT profile_id, hazard, weight, max_grade_pct, conservatism FROM prof JOIN weight USING (profile_id)")
def k1(t: Tables):
    out = profiles.expand_profiles(requests(t))
    return out.select("profile_id", F.explode("weights").alias("hazard", "weight"), "max_grade_pct", "conservatism")


@register("k2_effective_weights", f"""WITH {CONDITIONS}, {WEIGHTS}, g AS (SELECT max(CASE WHEN hazard='pollen_grass' THEN mean_value END)>=2 AS grass, max(CASE WHEN hazard='pollen_weed' THEN mean_value END)>=2 AS weed FROM cond)
SELECT profile_id, hazard, weight*2.0::double AS weight FROM weight, g WHERE weight>0 AND hazard<>'pollen_tree' AND hazard<>'shade_deficit' AND (hazard<>'pollen_grass' OR coalesce(grass,false)) AND (hazard<>'pollen_weed' OR coalesce(weed,false))""", ("fx_reading",))
def k2(t: Tables):
    # January: the tree pollen season is over, whatever the index says.
    gates = live.seasonal_gates(live.hazard_conditions(aqi_readings(t), ts(AS_OF)), ts(AS_OF))
    return profiles.effective_weights(profiles.expand_profiles(requests(t)), gates, 2.0)


@register("f5_top_priorities", f"""WITH {WEIGHTS} SELECT profile_id, hazard, place FROM (SELECT profile_id, hazard, cast(row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, list_position({list(HAZARDS)!r}, hazard)) as bigint) AS place FROM weight WHERE weight>0) WHERE place<=4""")
def f5(t: Tables):
    return routes.top_priorities(profiles.expand_profiles(requests(t))).select("profile_id", "hazard", F.col("place").cast("long").alias("place"))


# --- edge prices: every segment is an edge and carries the profile of one customer ----------------------
EDGES = f"""{WEIGHTS}, nc AS (SELECT count(*) AS n_customers FROM customer),
ed AS (SELECT s.segment_id AS edge_id, s.x, s.y, s.length_m, w.*, s.osm_way_id % nc.n_customers AS profile_id FROM fx_segment s JOIN fx_wayq w USING (osm_way_id), nc),
wide AS (SELECT profile_id, {', '.join(f"coalesce(max(CASE WHEN hazard='{h}' THEN weight END),0) AS w_{h}" for h in HAZARDS)} FROM weight GROUP BY 1)"""


def _factor(score: str, sens: str, inverse: bool = False) -> str:
    guard = f"{score}<127 AND " if score in ("svf", "crowd") else ""
    arms = " ".join(f"WHEN {guard}{score} {'<' if inverse else '>'} {100 - b if inverse else b} THEN floor(greatest(0.1,1/(1+({sens})*{f}))*10000+0.5)/10000"
                    for b, f in ((75, 1.0), (50, 0.67), (25, 0.33)))
    return f"(CASE WHEN ({sens})>0 THEN CASE {arms} ELSE 1.0 END ELSE 1.0 END)"


def _priority(scale: str) -> str:
    direct = {"pm25": "pm25", "no2": "no2", "ozone": "ozone", "traffic_prox": "traffic", "industrial_prox": "industrial",
              "grade": "grade", "crowd_density": "crowd", "pollen_tree": "pollen"}
    terms = [_factor(s, f"coalesce(w_{h},0)*{scale}*conservatism") for h, s in direct.items()]
    terms += [_factor("shade", f"coalesce(w_shade_deficit,0)*{scale}*conservatism", True),
              _factor("svf", f"coalesce(w_pm25,0)*{scale}*0.5*conservatism", True)]
    return "*".join(terms)


def edges(t: Tables):
    customers = t.raw("customer").agg(F.count(F.lit(1))).scalar()
    out = (t.segment().join(t.ways_quantised(), "osm_way_id")
           .withColumn("profile_id", F.col("osm_way_id") % customers)
           .withColumnRenamed("segment_id", "edge_id"))
    return out.join(profiles.expand_profiles(requests(t)).drop("preset", "mode"), "profile_id")


@register("k3_k4_edge_priority", f"WITH {EDGES} SELECT edge_id, {q4(_priority('1.0'), 6)} AS priority FROM ed LEFT JOIN wide USING (profile_id) JOIN prof USING (profile_id)", ("fx_segment", "fx_wayq"))
def k3(t: Tables):
    return profiles.edge_priority(edges(t)).select("edge_id", r4("priority", 6).alias("priority"))


@register("k6_hard_avoid", f"""WITH {EDGES} SELECT edge_id, cast(grade>max_grade_pct OR (n=2 AND grade>6) OR (n=4 AND grade>5) OR (n=3 AND industrial_within_200m>0) as bigint) AS blocked FROM ed JOIN prof USING (profile_id)""", ("fx_segment", "fx_wayq"))
def k6(t: Tables):
    return profiles.hard_avoid(edges(t)).select("edge_id", F.col("blocked").cast("long").alias("blocked"))


@register("k7_pm25_variant", "SELECT osm_way_id, CASE WHEN pm25>70 THEN 0.4::double ELSE 1.0::double END AS priority FROM fx_wayq", ("fx_wayq",))
def k7(t: Tables):
    return profiles.pm25_variant(t.ways_quantised()).select("osm_way_id", "priority")


AREA_CELLS = f"""ac AS (SELECT 'pm25' AS hazard, cast(1+col%4 as bigint) AS severity, col AS cx, row AS cy FROM fx_cell
  UNION SELECT 'construction', cast(severity as bigint), cast(floor(x/400) as bigint), cast(floor(y/400) as bigint) FROM fx_permit WHERE expires_at>=DATE '{PERMIT_DAY}')"""
TOUCHED = f"""{EDGES}, {AREA_CELLS}, touched AS (SELECT DISTINCT edge_id, hazard, severity FROM ed, generate_series(cast(floor(x/400) as bigint), cast(floor((x+length_m)/400) as bigint)) g(c), ac WHERE ac.cx=c AND ac.cy=cast(floor(y/400) as bigint))"""


def touched(t: Tables):
    grid = t.grid().selectExpr("'pm25' AS hazard", "cast(1+col%4 as int) AS severity", "col AS cx", "row AS cy")
    sites = live.active_permits(t.permit(), ts(PERMIT_DAY)).selectExpr(
        "'construction' AS hazard", "severity", "floor(x/400) AS cx", "floor(y/400) AS cy").distinct()
    legs = legs_of(t.segment().select(F.col("segment_id").alias("edge_id"), "pts"))
    return profiles.edges_in_areas(legs, grid.unionByName(sites), 400.0)


@register("k5_edges_in_areas", f"WITH {TOUCHED} SELECT edge_id, hazard, severity FROM touched", ("fx_segment", "fx_wayq", "fx_cell", "fx_permit"))
def k5_areas(t: Tables):
    return touched(t).select("edge_id", "hazard", F.col("severity").cast("long").alias("severity"))


SNAPSHOT = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hazard, station_id ORDER BY observed_at DESC) AS rn
  FROM fx_reading WHERE source<>'airnow' AND observed_at >= (SELECT max(observed_at) FROM fx_reading) - INTERVAL 24 HOUR) WHERE rn=1),
mean AS (SELECT hazard, avg(value) AS v, max(observed_at) AS seen_at FROM latest GROUP BY 1),
gc AS (SELECT 'pm25' AS hazard, col, row, pm25 AS value FROM fx_cell UNION ALL SELECT 'no2', col, row, no2 FROM fx_cell WHERE no2<>-9999 UNION ALL SELECT 'ozone', col, row, ozone FROM fx_cell),
stat AS (SELECT hazard, avg(value) AS m, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.5) AS q2, quantile_cont(value,0.75) AS q3 FROM gc GROUP BY hazard),
scaled AS (SELECT g.hazard, col, row, g.value*greatest(least(v/m,10),0.1) AS s, q1, q2, q3 FROM gc g JOIN stat USING (hazard) JOIN mean USING (hazard)
  WHERE mean.seen_at >= (SELECT max(observed_at) FROM fx_reading) - INTERVAL 2 HOUR),
sites AS (SELECT DISTINCT severity, x, y FROM fx_permit WHERE expires_at + INTERVAL 26 YEAR >= (SELECT cast(max(observed_at) AS date) FROM fx_reading)),
ac AS (SELECT hazard, cast(1+(q1<=s)::int+(q2<=s)::int+(q3<=s)::int as bigint) AS severity, col AS cx, row AS cy FROM scaled
  UNION SELECT 'construction', severity, cx, cy FROM sites, generate_series(cast(floor((x-40)/400) as bigint), cast(floor((x+40)/400) as bigint)) a(cx),
    generate_series(cast(floor((y-40)/400) as bigint), cast(floor((y+40)/400) as bigint)) b(cy)
  WHERE power(greatest(cx*400-x, x-(cx+1)*400, 0),2)+power(greatest(cy*400-y, y-(cy+1)*400, 0),2) <= 1600)"""


@register("k5_from_snapshot", f"""WITH {SNAPSHOT} SELECT DISTINCT segment_id AS edge_id, hazard, severity FROM fx_segment,
  generate_series(cast(floor(x/400) as bigint), cast(floor((x+length_m)/400) as bigint)) g(c), ac WHERE ac.cx=c AND ac.cy=cast(floor(y/400) as bigint)""",
          ("fx_segment", "fx_reading", "fx_cell", "fx_permit"))
def k5_snapshot(t: Tables):
    """Readings stored, areas built and stored with their cells, streets met from the stored snapshot."""
    from kerbside.plans import live as plan
    from kerbside.session import scratch_path

    root = scratch_path(t.spark, "fields")
    plan.ingest(root, t.reading().withColumn("unit", F.lit("")))
    now = t.reading().select(F.max("observed_at")).scalar()
    cells = t.cells().where("value <> -9999").withColumns({"cx": F.col("col"), "cy": F.col("row")})
    permits = t.permit().withColumn("expires_at", F.add_months("expires_at", 312))
    plan.refresh_fields(t.spark, root, cells, permits, now, 400.0)
    legs = legs_of(t.segment().select(F.col("segment_id").alias("edge_id"), "pts"))
    return plan.streets_in_fields(t.spark, root, legs, now, 400.0).select("edge_id", "hazard", F.col("severity").cast("long").alias("severity"))


@register("k5_live_priority", f"""WITH {TOUCHED}, m AS (SELECT e.edge_id, CASE WHEN n=3 AND bool_or(t.hazard='construction') THEN 0.0 ELSE
  coalesce(product(CASE WHEN t.hazard IS NULL THEN 1.0 WHEN (CASE t.hazard WHEN 'pm25' THEN w_pm25 ELSE w_construction END)>0 THEN floor(greatest(0.1, 1-t.severity*0.1875*least(greatest((CASE t.hazard WHEN 'pm25' THEN w_pm25 ELSE w_construction END)*conservatism/3,0),1))*10000+0.5)/10000 ELSE 1.0 END),1.0) END AS live_priority
  FROM ed e JOIN prof USING (profile_id) LEFT JOIN wide USING (profile_id) LEFT JOIN touched t USING (edge_id) GROUP BY e.edge_id, n)
SELECT edge_id, {q4('live_priority', 6)} AS live_priority FROM m""", ("fx_segment", "fx_wayq", "fx_cell", "fx_permit"))
def k5(t: Tables):
    return profiles.live_priority(edges(t), touched(t)).select("edge_id", r4("live_priority", 6).alias("live_priority"))


@register("c20_enabled_areas", f"WITH {EDGES}, {AREA_CELLS} SELECT w.profile_id, a.hazard, count(*) AS cells FROM ac a JOIN (SELECT * FROM weight WHERE weight>0) w USING (hazard) GROUP BY 1, 2", ("fx_segment", "fx_wayq", "fx_cell", "fx_permit"))
def c20(t: Tables):
    grid = t.grid().selectExpr("'pm25' AS hazard", "cast(1+col%4 as int) AS severity", "col AS cx", "row AS cy")
    sites = live.active_permits(t.permit(), ts(PERMIT_DAY)).selectExpr(
        "'construction' AS hazard", "severity", "floor(x/400) AS cx", "floor(y/400) AS cy").distinct()
    sizes = grid.unionByName(sites).groupBy("hazard").agg(F.count(F.lit(1)).alias("cells"))
    return profiles.enabled_areas(sizes, profiles.expand_profiles(requests(t))).select("profile_id", "hazard", "cells")


# --- comparison: an order is a trip; its segments are the fastest route ---------------------------------
SCORES = sorted(set(ROUTE_EXPOSURES.values()))


def _exposure(hazard: str, score: str) -> str:
    mean = f"coalesce(sum({score}*length_m)/nullif(sum(CASE WHEN {score} IS NOT NULL THEN length_m END),0),0)"
    return f"floor(({'100-' if hazard == 'shade_deficit' else ''}{mean})*100+0.5)/100 AS {hazard}"


# Way of an edge on somebody's route: neighbours share streets.
ROUTE_EDGES = "re AS (SELECT osm_way_id AS route_id, (osm_way_id*7+seq*13)%15000 AS osm_way_id, length_m FROM fx_segment)"
EXPOSURE = f"{ROUTE_EDGES}, ex AS (SELECT route_id, {', '.join(_exposure(h, s) for h, s in ROUTE_EXPOSURES.items())}, sum(length_m) AS distance_m FROM re LEFT JOIN fx_wayq USING (osm_way_id) GROUP BY route_id)"


def route_edges(segments):
    return segments.selectExpr("osm_way_id AS route_id", "(osm_way_id*7+seq*13)%15000 AS osm_way_id", "length_m")


def exposed(t: Tables):
    # Lengths, ways, their scores and the exposures all read the segments, which are grouped once.
    segments = stored(t.segment().select("segment_id", "osm_way_id", "seq", "length_m", "grade_pct"), "segments")
    edges = route_edges(segments)
    lengths = edges.groupBy("route_id").agg(F.sum("length_m").alias("distance_m"))
    return routes.route_exposure(edges, t.ways_quantised(segments)).join(lengths, "route_id")


@register("d19_route_exposure", f"WITH {EXPOSURE} SELECT * FROM ex", ("fx_segment", "fx_wayq"))
def d19(t: Tables):
    return exposed(t)


def _diff(h: str) -> str:
    n = "distance_m" if h == "distance" else h
    return f"CASE WHEN b.{n}=0 THEN CASE WHEN v.{n}=0 THEN 0.0 END ELSE floor((v.{n}-b.{n})/b.{n}*10000+0.5)/10000 END AS {h}"


TRIP = f"{EXPOSURE}, tr AS (SELECT *, route_id//3 AS od_id, (['fastest','balanced','cleanest'])[cast(route_id%3 as int)+1] AS variant FROM ex)"
DIFF = ", ".join(_diff(h) for h in [*ROUTE_EXPOSURES, "distance"])


def trip_routes(t: Tables):
    name = F.element_at(F.array(*[F.lit(v) for v in ("fastest", "balanced", "cleanest")]), (F.col("route_id") % 3).cast("int") + 1)
    return stored(exposed(t), "exposures").withColumn("od_id", F.expr("route_id div 3")).withColumn("variant", name)


@register("k10_exposure_diff", f"WITH {TRIP} SELECT v.od_id, v.variant, {DIFF} FROM tr v JOIN tr b ON b.od_id=v.od_id AND b.variant='fastest'", ("fx_segment", "fx_wayq"))
def k10(t: Tables):
    return routes.exposure_diff(trip_routes(t))


LONG_DIFF = f"ld AS (SELECT v.route_id, unnest({[*ROUTE_EXPOSURES, 'distance']!r}) AS hazard, unnest([{', '.join(_diff(h).rsplit(' AS ', 1)[0] for h in [*ROUTE_EXPOSURES, 'distance'])}]) AS value FROM tr v JOIN tr b ON b.od_id=v.od_id AND b.variant='fastest')"


def long_diff(t: Tables):
    wide = routes.exposure_diff(trip_routes(t)).withColumn("route_id", F.col("od_id") * 3 + F.expr("CASE variant WHEN 'fastest' THEN 0 WHEN 'balanced' THEN 1 ELSE 2 END"))
    names = [*ROUTE_EXPOSURES, "distance"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("hazard"), F.col(n).alias("value")) for n in names]))
    return wide.select("route_id", pairs.alias("p")).select("route_id", "p.*")


@register("f4_top_deltas", f"""WITH {TRIP}, {LONG_DIFF}, rk AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY abs(value) DESC, list_position({list(HAZARDS)!r}, hazard)) AS place FROM ld WHERE hazard<>'distance' AND value IS NOT NULL)
SELECT route_id, hazard, value, cast(place as bigint) AS place FROM rk WHERE place<=2 UNION ALL SELECT route_id, 'exposure', 0.0, 1 FROM ld WHERE route_id NOT IN (SELECT route_id FROM rk) AND hazard='distance'
UNION ALL SELECT route_id, 'distance', coalesce(value,0), 2 FROM ld WHERE route_id NOT IN (SELECT route_id FROM rk) AND hazard='distance'""", ("fx_segment", "fx_wayq"))
def f4(t: Tables):
    return routes.top_deltas(long_diff(t)).select("route_id", "hazard", "value", F.col("place").cast("long").alias("place"))


@register("f4_strongest_improvement", f"""WITH {TRIP}, {LONG_DIFF} SELECT route_id, hazard, value FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY value, list_position({list(HAZARDS)!r}, hazard)) AS rn FROM ld WHERE hazard<>'distance' AND value<0) WHERE rn=1""", ("fx_segment", "fx_wayq"))
def f4_best(t: Tables):
    return routes.strongest_improvement(long_diff(t))


# Candidates: seven attempts per order with distances from its total price.
CANDIDATES = """cd AS (SELECT o_orderkey AS od_id, 'fastest' AS variant, 1 AS attempt, 0.0::double AS weight_scale, 1000.0+o_orderkey%700 AS distance_m FROM orders
 UNION ALL SELECT o_orderkey, 'balanced', a, 1.0/power(2,a-1), 1000.0+o_orderkey%700+(o_custkey*31+a*o_orderkey*17)%900-a*60 FROM orders, generate_series(1,3) g(a)
 UNION ALL SELECT o_orderkey, 'cleanest', a, 2.0/power(2,a-1), 1000.0+o_orderkey%700+(o_custkey*37+a*o_orderkey*19)%1500-a*90 FROM orders, generate_series(1,3) g(a)),
cap AS (SELECT c.*, f.distance_m*(1+CASE variant WHEN 'fastest' THEN 0 WHEN 'balanced' THEN 0.25 ELSE 0.5 END) AS cap FROM cd c JOIN (SELECT od_id, distance_m FROM cd WHERE variant='fastest') f USING (od_id)),
ch AS (SELECT *, row_number() OVER (PARTITION BY od_id, variant ORDER BY CASE WHEN distance_m<=cap THEN 0 ELSE 1 END, CASE WHEN distance_m<=cap THEN attempt ELSE distance_m END, attempt) AS rn FROM cap)"""


def candidates(t: Tables):
    orders = t.raw("orders")
    base = F.lit(1000.0) + F.col("o_orderkey") % 700
    fastest = orders.select(F.col("o_orderkey").alias("od_id"), F.lit("fastest").alias("variant"), F.lit(1).alias("attempt"),
                            F.lit(0.0).alias("weight_scale"), base.alias("distance_m"))
    tried = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(a).alias("attempt"), F.lit(s).alias("weight_scale"))
                                for v, a, s in routes.variant_attempts()]))
    d = F.when(F.col("variant") == "balanced", (F.col("o_custkey") * 31 + F.col("attempt") * F.col("o_orderkey") * 17) % 900 - F.col("attempt") * 60) \
        .otherwise((F.col("o_custkey") * 37 + F.col("attempt") * F.col("o_orderkey") * 19) % 1500 - F.col("attempt") * 90)
    others = orders.select("o_orderkey", "o_custkey", tried.alias("t")).select("*", "t.*").select(
        F.col("o_orderkey").alias("od_id"), "variant", "attempt", "weight_scale", (base + d).alias("distance_m"))
    return fastest.unionByName(others)


def tolerances(t: Tables):
    return t.raw("orders").select(F.col("o_orderkey").alias("od_id"), F.lit(0.25).alias("detour_tolerance"))


@register("k9_compare_variants", f"WITH {CANDIDATES} SELECT od_id, variant, {q4('distance_m')} AS distance_m, weight_scale, cast(CASE WHEN distance_m<=cap THEN attempt ELSE 3 END as bigint) AS attempts, {q4('cap')} AS distance_cap_m, cast(distance_m>cap as bigint) AS detour_cap_exceeded FROM ch WHERE rn=1")
def k9(t: Tables):
    out = routes.compare_variants(candidates(t), tolerances(t))
    return out.select("od_id", "variant", r4("distance_m").alias("distance_m"), "weight_scale", F.col("attempts").cast("long").alias("attempts"),
                      r4("distance_cap_m").alias("distance_cap_m"), F.col("detour_cap_exceeded").cast("long").alias("detour_cap_exceeded"))


@register("k14_scenario_diff", f"""WITH {CANDIDATES}, c2 AS (SELECT od_id, variant, attempt, cap, distance_m+CASE WHEN variant='fastest' THEN 0 ELSE od_id%50 END AS distance_m FROM cap),
ch2 AS (SELECT *, row_number() OVER (PARTITION BY od_id, variant ORDER BY CASE WHEN distance_m<=cap THEN 0 ELSE 1 END, CASE WHEN distance_m<=cap THEN attempt ELSE distance_m END, attempt) AS rn FROM c2)
SELECT a.od_id, a.variant, {q4('abs(b.distance_m-a.distance_m)')} AS shift_m, cast(a.attempt<>b.attempt as bigint) AS path_changed FROM ch a JOIN ch2 b USING (od_id, variant) WHERE a.rn=1 AND b.rn=1""")
def k14(t: Tables):
    smoke = candidates(t).withColumn("distance_m", F.col("distance_m") + F.when(F.col("variant") == "fastest", 0).otherwise(F.col("od_id") % 50))
    a = routes.compare_variants(candidates(t), tolerances(t)).withColumn("path_key", F.col("chosen_attempt"))
    b = routes.compare_variants(smoke, tolerances(t)).withColumn("path_key", F.col("chosen_attempt"))
    return routes.scenario_diff(a, b).select("od_id", "variant", r4("shift_m").alias("shift_m"), F.col("path_changed").cast("long").alias("path_changed"))


# --- announcements -----------------------------------------------------------------------------------
LONG = f"lg AS (SELECT route_id, distance_m, unnest({list(ROUTE_EXPOSURES)!r}) AS hazard, unnest([{', '.join(ROUTE_EXPOSURES)}]) AS exposure FROM ex)"
TOP = f"tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY exposure DESC, list_position({list(HAZARDS)!r}, hazard)) AS place FROM lg WHERE exposure>=60) WHERE place<=3)"
_LINES = "CASE hazard " + " ".join(f"WHEN '{h}' THEN '{line}'" for h, line in HAZARD_LINES.items()) + " END"
SAID = f"""{EXPOSURE}, {LONG}, {TOP}, n AS (SELECT ex.route_id, ex.distance_m, count(tp.place) AS k FROM ex LEFT JOIN tp USING (route_id) GROUP BY 1,2),
said AS (SELECT route_id, 0 AS seq, 0.0::double AS distance_offset_m, CASE WHEN k>0 THEN '{OPENING_ELEVATED}' ELSE '{OPENING_CALM}' END AS text FROM n
 UNION ALL SELECT tp.route_id, place, floor(n.distance_m/(k+1)*place+0.5), {_LINES} FROM tp JOIN n USING (route_id)
 UNION ALL SELECT route_id, k+1, greatest(distance_m-30,0), '{CLOSING_LINE}' FROM n)"""


def long_exposure(t: Tables):
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("hazard"), F.col(h).alias("exposure")) for h in ROUTE_EXPOSURES]))
    return exposed(t).select("route_id", pairs.alias("p")).select("route_id", "p.*", F.lit(1.0).alias("weight"))


@register("f3_top_hazards", f"WITH {EXPOSURE}, {LONG}, {TOP} SELECT route_id, hazard, cast(place as bigint) AS place FROM tp", ("fx_segment", "fx_wayq"))
def f3(t: Tables):
    return routes.top_hazards(long_exposure(t)).select("route_id", "hazard", F.col("place").cast("long").alias("place"))


@register("k12_announcements", f"WITH {SAID} SELECT route_id, cast(seq as bigint) AS seq, {q4('distance_offset_m')} AS distance_offset_m, text FROM said", ("fx_segment", "fx_wayq"))
def k12(t: Tables):
    return routes.announcements(long_exposure(t), exposed(t)).select("route_id", F.col("seq").cast("long").alias("seq"), r4("distance_offset_m").alias("distance_offset_m"), "text")


@register("k13_lines_to_synthesise", r"""WITH k AS (SELECT sha256(lower(regexp_replace(regexp_replace(text,'^\s+|\s+$','','g'),'\s+',' ','g')) || '|amy|1.0') AS speech_key, role, text FROM conversations WHERE trim(text)<>'')
SELECT speech_key, min(text) AS text FROM k WHERE speech_key NOT IN (SELECT speech_key FROM k WHERE role='assistant') GROUP BY 1""")
def k13(t: Tables):
    lines = t.raw("conversations")
    voice, speed = F.lit("amy"), F.lit(1.0)
    cache = lines.where("role='assistant'").select(speech_key(F.col("text"), voice, speed).alias("speech_key")).distinct()
    return routes.lines_to_synthesise(lines, cache, voice, speed)


# --- ownership ---------------------------------------------------------------------------------------
@register("c14_owned_routes", "SELECT route_id, user_id FROM fx_route WHERE user_id=route_id%1500", ("fx_route",))
def c14(t: Tables):
    callers = t.raw("orders").selectExpr("o_orderkey AS route_id", "o_orderkey%1500 AS user_id")
    return routes.owned_routes(t.route(), callers).select("route_id", "user_id")


@register("c15_erase_users", """WITH gone AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal<0), dead AS (SELECT route_id FROM fx_route WHERE user_id IN (SELECT user_id FROM gone))
SELECT 'app_user' AS tbl, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM gone) UNION ALL SELECT 'route', count(*) FROM fx_route WHERE route_id NOT IN (SELECT route_id FROM dead)
UNION ALL SELECT 'route_feedback', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT route_id FROM dead) UNION ALL SELECT 'route_analysis', count(*) FROM fx_route WHERE route_id%2=0 AND route_id NOT IN (SELECT route_id FROM dead)
UNION ALL SELECT 'route_analysis_frame', count(*) FROM lineitem WHERE NOT (l_orderkey%2=0 AND l_orderkey IN (SELECT route_id FROM dead))""", ("fx_route",))
def c15(t: Tables):
    users = t.raw("customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    left = routes.erase_users({
        "app_user": users, "route": t.route(),
        "route_feedback": t.raw("lineitem").selectExpr("l_orderkey AS route_id"),
        "route_analysis": t.route().where("route_id%2=0").selectExpr("route_id AS analysis_id", "route_id"),
        "route_analysis_frame": t.raw("lineitem").selectExpr("l_orderkey AS analysis_id")}, users.where("c_acctbal<0"))
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("k11_accepted_feedback", """SELECT o_orderkey AS feedback_id, cast(o_orderkey%26 as bigint) AS segments FROM orders WHERE o_custkey%10<>0 AND o_orderkey%26<=20 AND (o_orderkey%11<>0 OR o_orderkey%26=0)""")
def k11(t: Tables):
    marks = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.when((F.col("o_orderkey") % 11 == 0), F.lit(-1)).otherwise(i))
    feedback = t.raw("orders").select(
        F.col("o_orderkey").alias("feedback_id"), F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("user_id"), F.lit(True).alias("felt_worse"),
        F.when(F.col("o_orderkey") % 26 > 0, F.slice(marks, F.lit(1), (F.col("o_orderkey") % 26).cast("int"))).alias("which_segments"))
    kept = routes.accepted_feedback(feedback, t.route())
    return kept.select("feedback_id", F.size("which_segments").cast("long").alias("segments"))


# --- tiles -------------------------------------------------------------------------------------------
ZOOM = 16
SIZE = 2 * MERCATOR_HALF_M / (1 << ZOOM)
H, PAD, UNIT = f"{MERCATOR_HALF_M!r}", f"{SIZE * 64 / 4096!r}", f"{4096 / SIZE!r}"


@register("c16_tile_features", f"""
WITH sg AS (SELECT s.segment_id, x-8260000.0 AS x1, x+length_m-8260000.0 AS x2, y+4960000.0 AS y, cast(floor(c.traffic_prox+0.5) as bigint) AS score FROM fx_segment s JOIN fx_scores c USING (segment_id) WHERE c.traffic_prox IS NOT NULL),
tl AS (SELECT sg.*, tx, ty, tx*{SIZE!r}-{H} AS w, {H}-ty*{SIZE!r} AS n FROM sg, generate_series(cast(floor((x1-{PAD}+{H})/{SIZE!r}) as bigint), cast(floor((x2+{PAD}+{H})/{SIZE!r}) as bigint)) a(tx),
  generate_series(cast(floor(({H}-y-{PAD})/{SIZE!r}) as bigint), cast(floor(({H}-y+{PAD})/{SIZE!r}) as bigint)) b(ty)),
cl AS (SELECT *, greatest(x1, w-{PAD}) AS a, least(x2, w+{SIZE!r}+{PAD}) AS b FROM tl WHERE x2>=w AND x1<=w+{SIZE!r} AND y<=n AND y>=n-{SIZE!r})
SELECT segment_id, tx AS tile_x, ty AS tile_y, score, cast(floor((a-w)*{UNIT}+0.5) as bigint) AS qx1, cast(floor((b-w)*{UNIT}+0.5) as bigint) AS qx2, cast(floor((n-y)*{UNIT}+0.5) as bigint) AS qy1
FROM cl WHERE a<=b AND floor((a-w)*{UNIT}+0.5)<>floor((b-w)*{UNIT}+0.5)""", ("fx_segment", "fx_scores"))
def c16(t: Tables):
    moved = t.segment().withColumn("pts", F.transform("pts", lambda p: F.struct((p["x"] - 8260000.0).alias("x"), (p["y"] + 4960000.0).alias("y"))))
    out = tiles.tile_features(moved, t.scores(), "traffic", ZOOM)
    return out.select("segment_id", "tile_x", "tile_y", *[F.col(c).cast("long").alias(c) for c in ("score", "qx1", "qx2", "qy1")])


# --- cheapest paths: parts form a sparse graph, suppliers are trips ---------------------------------------
GRAPH = """nn AS (SELECT count(*) AS n FROM part), eg AS (SELECT p_partkey AS src, (p_partkey*7+3)%n AS dst, p_size*10.0::double AS length_m FROM part, nn
  UNION ALL SELECT p_partkey, (p_partkey+1)%n, 30.0+p_size*5.0 FROM part, nn UNION ALL SELECT p_partkey, (p_partkey*3+11)%n, 100.0+p_size FROM part, nn WHERE p_type<>'SMALL'),
og AS (SELECT s_suppkey AS od_id, (s_suppkey*31)%n AS origin, (s_suppkey*57+5)%n AS destination FROM supplier, nn)"""


def graph(t: Tables):
    n = t.raw("part").agg(F.count(F.lit(1))).scalar()
    p = t.raw("part").withColumn("n", n)
    edges = (p.selectExpr("p_partkey AS src", "(p_partkey*7+3)%n AS dst", "p_size*10.0D AS length_m")
             .unionByName(p.selectExpr("p_partkey AS src", "(p_partkey+1)%n AS dst", "30.0D+p_size*5.0D AS length_m"))
             .unionByName(p.where("p_type<>'SMALL'").selectExpr("p_partkey AS src", "(p_partkey*3+11)%n AS dst", "100.0D+p_size AS length_m")))
    trips = t.raw("supplier").withColumn("n", n).selectExpr("s_suppkey AS od_id", "(s_suppkey*31)%n AS origin", "(s_suppkey*57+5)%n AS destination")
    return edges, trips


@register("k8_cheapest_paths", f"""WITH RECURSIVE {GRAPH}, walk(od_id, node, cost) USING KEY (od_id, node) AS (SELECT od_id, origin, 0.0::double FROM og
  UNION SELECT od_id, dst, c FROM (SELECT w.od_id, e.dst, min(w.cost+e.length_m/1.25) AS c FROM walk w JOIN eg e ON e.src=w.node LEFT JOIN recurring.walk r ON r.od_id=w.od_id AND r.node=e.dst WHERE r.cost IS NULL OR w.cost+e.length_m/1.25 < r.cost GROUP BY 1,2))
SELECT og.od_id, {q4('cost')} AS cost FROM walk w JOIN og ON og.od_id=w.od_id AND og.destination=w.node""")
def k8(t: Tables):
    edges, trips = graph(t)
    priced = edges.withColumn("cost", paths.edge_cost(F.col("length_m"), F.lit(1.25), F.lit(1.0)))
    return paths.cheapest_paths(priced, trips).select("od_id", r4("cost").alias("cost"))


# A fraction that differs between edges leaves one cheapest path per trip.
UNIQUE = "length_m+((src*7919+dst*104729)%10007)/10007.0"


@register("k8_path_edges", f"""WITH RECURSIVE {GRAPH}, ug AS (SELECT src, dst, {UNIQUE} AS length_m FROM eg), walk(od_id, node, cost, path) USING KEY (od_id, node) AS (
  SELECT od_id, origin, 0.0::double, [origin] FROM og
  UNION SELECT od_id, dst, c, p FROM (SELECT w.od_id, e.dst, min(w.cost+e.length_m) AS c, arg_min(list_append(w.path, e.dst), w.cost+e.length_m) AS p
    FROM walk w JOIN ug e ON e.src=w.node LEFT JOIN recurring.walk r ON r.od_id=w.od_id AND r.node=e.dst WHERE r.cost IS NULL OR w.cost+e.length_m < r.cost GROUP BY 1,2))
SELECT og.od_id, position, path[position] AS src, path[position+1] AS dst FROM walk w JOIN og ON og.od_id=w.od_id AND og.destination=w.node, unnest(range(1, len(path))) u(position)""")
def k8_edges(t: Tables):
    edges, trips = graph(t)
    priced = edges.withColumn("length_m", F.expr(UNIQUE.replace("10007.0", "10007.0D"))).withColumn("cost", F.col("length_m"))
    steps = paths.path_edges(paths.path_labels(priced, trips, meet=True), trips)
    return steps.select("od_id", F.col("position").cast("long").alias("position"), "src", "dst")
