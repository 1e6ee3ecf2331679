"""Static clock: kernels, percentiles, network, grids and way scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import PERMIT_DAY, Tables, q4, r4, register, ts
from kerbside.functions.geo import haversine_m
from kerbside.operators import exposure, network, quality, raster, ways
from kerbside.operators.ranking import exact_quantiles, percent_rank_pct, running_length
from kerbside.operators.spatial import cluster_points
from kerbside.session import stored
from kerbside.vocab import WAY_SCORES

LEG_DX = "greatest({s}.x-{p}.x, 0, {p}.x-{s}.x-{s}.length_m)"

TRAFFIC_SQL = """
WITH d AS (
  SELECT s.segment_id, r.highway_class, max(r.proxy_weight) AS w,
    min(sqrt(power(greatest(r.x-s.mx, 0, s.mx-r.x-r.length_m),2)+power(s.y-r.y,2))) AS d
  FROM (SELECT segment_id, x+length_m*0.5 AS mx, y FROM fx_segment) s JOIN fx_road r
    ON sqrt(power(greatest(r.x-s.mx, 0, s.mx-r.x-r.length_m),2)+power(s.y-r.y,2)) <= 1000
  GROUP BY 1, 2),
traffic AS (
  SELECT f.segment_id, count(d.d) AS road_class_count, min(d.d) AS nearest_road_m,
    coalesce(sum(d.w*exp(-d.d/300)),0) AS raw_kernel
  FROM fx_segment f LEFT JOIN d USING (segment_id) GROUP BY 1)"""


@register("c5_traffic_exposure", TRAFFIC_SQL + f"""
SELECT segment_id, road_class_count, {q4('nearest_road_m')} AS nearest_road_m, {q4('raw_kernel')} AS raw_kernel
FROM traffic""", ("fx_segment", "fx_road"))
def c5(t: Tables):
    out = exposure.traffic_exposure(t.segment(), t.road())
    return out.select("segment_id", "road_class_count", r4("nearest_road_m").alias("nearest_road_m"),
                      r4("raw_kernel").alias("raw_kernel"))


@register("traffic_percentile_per_segment", TRAFFIC_SQL + f"""
SELECT segment_id, {q4('percent_rank() OVER (ORDER BY k)*100')} AS traffic_prox
FROM (SELECT segment_id, cast({q4('raw_kernel', 6)} as float) AS k FROM traffic)""", ("fx_segment", "fx_road"))
def traffic_percentile(t: Tables):
    samples = stored(exposure.traffic_exposure(t.segment(), t.road())
                     .withColumn("raw_kernel", r4("raw_kernel", 6)), "segment_traffic_sample")
    return exposure.traffic_percentiles(samples).select("segment_id", r4("traffic_prox").alias("traffic_prox"))


INDUSTRIAL_SQL = """
WITH industrial AS (
  SELECT s.segment_id, count(f.facility_id) AS facility_count,
    min(sqrt(power(f.x-s.mx,2)+power(f.y-s.y,2))) AS nearest_facility_m,
    coalesce(sum(exp(-sqrt(power(f.x-s.mx,2)+power(f.y-s.y,2))/300)),0) AS raw_kernel
  FROM (SELECT segment_id, x+length_m*0.5 AS mx, y FROM fx_segment) s LEFT JOIN fx_facility f
    ON sqrt(power(f.x-s.mx,2)+power(f.y-s.y,2)) <= 1000
  GROUP BY 1)"""


@register("c4_industrial_exposure", INDUSTRIAL_SQL + f"""
SELECT segment_id, facility_count, {q4('nearest_facility_m')} AS nearest_facility_m,
  {q4('raw_kernel')} AS raw_kernel FROM industrial""", ("fx_segment", "fx_facility"))
def c4(t: Tables):
    out = exposure.industrial_exposure(t.segment(), t.facility())
    return out.select("segment_id", "facility_count", r4("nearest_facility_m").alias("nearest_facility_m"),
                      r4("raw_kernel").alias("raw_kernel"))


@register("e2_industrial_percentile", INDUSTRIAL_SQL + f"""
SELECT segment_id, {q4('percent_rank() OVER (ORDER BY k)*100')} AS industrial_prox,
  cast(coalesce(nearest_facility_m<=200,false) as bigint) AS industrial_within_200m
FROM (SELECT segment_id, nearest_facility_m, cast({q4('raw_kernel', 6)} as float) AS k FROM industrial)""",
          ("fx_segment", "fx_facility"))
def e2_industrial(t: Tables):
    samples = stored(exposure.industrial_exposure(t.segment(), t.facility())
                     .withColumn("raw_kernel", r4("raw_kernel", 6)), "segment_industrial_sample")
    return exposure.industrial_percentiles(samples).select(
        "segment_id", r4("industrial_prox").alias("industrial_prox"),
        F.col("industrial_within_200m").cast("long").alias("industrial_within_200m"))


TREE_SQL = """
WITH trees AS (
  SELECT s.segment_id, count(t.tree_id) AS tree_count,
    coalesce(sum(CASE t.genus WHEN 'Quercus' THEN 3.0 WHEN 'Acer' THEN 2.0 ELSE 0.0 END),0)::double AS allergen_weight,
    any_value(s.length_m) AS length_m
  FROM fx_segment s LEFT JOIN fx_tree t
    ON sqrt(power(greatest(s.x-t.x, 0, t.x-s.x-s.length_m),2)+power(s.y-t.y,2)) <= 15
  GROUP BY 1)"""


@register("c3_tree_exposure", TREE_SQL + f"""
SELECT segment_id, tree_count, allergen_weight, {q4('tree_count*100.0/length_m')} AS trees_per_100m,
  {q4('allergen_weight*100.0/length_m')} AS pollen_weight_per_100m FROM trees""", ("fx_segment", "fx_tree"))
def c3(t: Tables):
    out = exposure.tree_exposure(t.segment(), t.tree(), exposure.genus_table(t.spark))
    return out.select("segment_id", "tree_count", "allergen_weight", r4("trees_per_100m").alias("trees_per_100m"),
                      r4("pollen_weight_per_100m").alias("pollen_weight_per_100m"))


@register("e2_tree_percentiles", TREE_SQL + f"""
SELECT segment_id, {q4('percent_rank() OVER (ORDER BY a)*100')} AS shade_benefit,
  {q4('percent_rank() OVER (ORDER BY b)*100')} AS pollen_source
FROM (SELECT segment_id, cast({q4('tree_count*100.0/length_m', 6)} as float) AS a,
        cast({q4('allergen_weight*100.0/length_m', 6)} as float) AS b FROM trees)""", ("fx_segment", "fx_tree"))
def e2_trees(t: Tables):
    samples = stored(exposure.tree_exposure(t.segment(), t.tree(), exposure.genus_table(t.spark)).select(
        "segment_id", r4("trees_per_100m", 6).alias("trees_per_100m"),
        r4("pollen_weight_per_100m", 6).alias("pollen_weight_per_100m")), "segment_tree_sample")
    return exposure.tree_percentiles(samples).select(
        "segment_id", r4("shade_benefit").alias("shade_benefit"), r4("pollen_source").alias("pollen_source"))


@register("c6_construction_scores", f"""
SELECT s.segment_id, coalesce(max(p.severity)*25.0,0)::double AS construction, '{PERMIT_DAY}' AS valid_for_date
FROM fx_segment s LEFT JOIN (SELECT * FROM fx_permit WHERE expires_at >= DATE '{PERMIT_DAY}') p
  ON sqrt(power(greatest(s.x-p.x, 0, p.x-s.x-s.length_m),2)+power(s.y-p.y,2)) <= 40
GROUP BY 1""", ("fx_segment", "fx_permit"))
def c6(t: Tables):
    out = exposure.construction_scores(t.segment(), t.permit(), ts(PERMIT_DAY))
    return out.select("segment_id", "construction", F.col("valid_for_date").cast("string").alias("valid_for_date"))


@register("e2_percent_rank", f"""
SELECT segment_id, {q4('percent_rank() OVER (ORDER BY v)*100')} AS score
FROM (SELECT segment_id, cast(raw_value as float) AS v FROM fx_segment)""", ("fx_segment",))
def e2(t: Tables):
    samples = stored(t.segment().select("segment_id", "raw_value"), "raw_sample")
    out = percent_rank_pct(samples, "segment_id", "raw_value", "score")
    return out.select("segment_id", r4("score").alias("score"))


@register("d7_cluster_facilities", """
WITH RECURSIVE place AS (
  SELECT c_custkey AS id, cast((c_custkey*10007)%3000 as double) AS x, cast((c_custkey*20011)%2900 as double) AS y
  FROM customer),
link AS (
  SELECT a.id AS a, b.id AS b FROM place a JOIN place b
    ON abs(a.x-b.x) <= 25 AND abs(a.y-b.y) <= 25 AND sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)) <= 25),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
label AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)
SELECT root AS cluster_root, count(*) AS members, """ + q4("avg(x)") + " AS x, " + q4("avg(y)") + """ AS y
FROM label JOIN place USING (id) GROUP BY root""")
def d7(t: Tables):
    places = t.raw("customer").selectExpr(
        "c_custkey AS facility_id", "cast((c_custkey*10007)%3000 as double) AS x",
        "cast((c_custkey*20011)%2900 as double) AS y")
    named = cluster_points(places, 25.0)
    return named.groupBy("cluster_id").agg(
        F.min("facility_id").alias("cluster_root"), F.count(F.lit(1)).alias("members"),
        r4(F.avg("x")).alias("x"), r4(F.avg("y")).alias("y")).drop("cluster_id")


@register("d7_supplier_clusters", f"""
SELECT count(*) AS members, {q4('avg(x)')} AS x, {q4('avg(y)')} AS y
FROM fx_facility f GROUP BY (SELECT min(g.facility_id) FROM fx_facility g
  WHERE sqrt(power(f.x-g.x,2)+power(f.y-g.y,2)) <= 0.5)""", ("fx_facility",))
def d7_supplier(t: Tables):
    out = exposure.cluster_facilities(t.facility(), 0.5)
    return out.select("members", r4("x").alias("x"), r4("y").alias("y"))


WAY_OUT = ", ".join(f"{q4(n)} AS {n}" for n in WAY_SCORES)


@register("d8_way_scores", f"SELECT osm_way_id, {WAY_OUT} FROM fx_way", ("fx_way",))
def d8(t: Tables):
    return t.ways().select("osm_way_id", *[r4(n).alias(n) for n in WAY_SCORES])


@register("h13_pack_scores", """
SELECT osm_way_id,
  cast(pm25+no2*128+ozone*16384+traffic*2097152 as bigint) AS pack0,
  cast(industrial+shade*128+pollen*16384+grade*2097152 as bigint) AS pack1,
  cast(industrial_within_200m+svf*128+crowd*16384 as bigint) AS pack2 FROM fx_wayq""", ("fx_wayq",))
def h13_pack(t: Tables):
    return ways.packed_ways(t.ways()).select(
        "osm_way_id", *[F.col(f"pack{i}").cast("long").alias(f"pack{i}") for i in range(3)])


@register("h13_unpack_scores", "SELECT * FROM fx_wayq", ("fx_wayq",))
def h13_unpack(t: Tables):
    return ways.unpacked_ways(ways.packed_ways(t.ways()))


@register("d22_verify_scores", f"""
SELECT cast(count(*) as bigint) AS scored_edges FROM fx_segment JOIN fx_wayq USING (osm_way_id)
WHERE greatest({', '.join(WAY_SCORES)}) > 0""", ("fx_segment", "fx_wayq"))
def d22(t: Tables):
    edges = t.segment().select("segment_id", "osm_way_id").join(t.ways_quantised(), "osm_way_id")
    return ways.verify_scores(edges, t.ways_quantised())


# --- network -----------------------------------------------------------------------------------------
WAY_POINTS = """
SELECT o_orderkey AS way_id, i AS pos, -74.0+((o_orderkey*31+i*97)%1000)*1e-5+i*0.0007 AS lon,
  40.6+((o_orderkey*17+i*53)%1000)*1e-5 AS lat
FROM orders, generate_series(0, o_orderkey%4+1) g(i)"""
HAVERSINE = ("2*6371008.8*asin(sqrt(power(sin((radians(lat2)-radians(lat1))/2),2)+cos(radians(lat1))"
             "*cos(radians(lat2))*power(sin((radians(lon2)-radians(lon1))/2),2)))")
LEGS_SQL = f"""
WITH wp AS ({WAY_POINTS}),
lag_legs AS (SELECT way_id, pos, lag(lon) OVER w AS lon1, lag(lat) OVER w AS lat1, lon AS lon2, lat AS lat2
  FROM wp WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
legs AS (SELECT *, {HAVERSINE} AS m FROM lag_legs WHERE lon1 IS NOT NULL),
run AS (SELECT *, sum(m) OVER (PARTITION BY way_id ORDER BY pos) AS b FROM legs)"""


def way_points(t: Tables):
    lon = F.expr("-74.0D+((o_orderkey*31+i*97)%1000)*1e-5D+i*0.0007D")
    lat = F.expr("40.6D+((o_orderkey*17+i*53)%1000)*1e-5D")
    return (t.raw("orders").select("o_orderkey", F.explode(F.expr("sequence(0L, o_orderkey%4+1)")).alias("i"))
            .select(F.col("o_orderkey").alias("way_id"), F.col("i").alias("pos"), lon.alias("lon"), lat.alias("lat")))


def way_lines(t: Tables):
    pts = F.transform(F.expr("sequence(0L, o_orderkey%4+1)"), lambda i: F.struct(
        (F.lit(-74.0) + ((F.col("o_orderkey") * 31 + i * 97) % 1000) * F.lit(1e-5) + i * F.lit(0.0007)).alias("x"),
        (F.lit(40.6) + ((F.col("o_orderkey") * 17 + i * 53) % 1000) * F.lit(1e-5)).alias("y")))
    return t.raw("orders").select(F.col("o_orderkey").alias("way_id"), pts.alias("pts"))


@register("h2_split_ways", LEGS_SQL + f""",
total AS (SELECT way_id, max(b) AS len FROM run GROUP BY 1),
chunks AS (SELECT way_id, len, k AS seq, k*99.0 AS f, least((k+1)*99.0, len) AS t
  FROM total, generate_series(0, cast(ceil(len/99.0) as bigint)-1) g(k)),
starts AS (SELECT c.way_id, c.seq, c.f, c.t, r.lon1+(r.lon2-r.lon1)*(c.f-(r.b-r.m))/r.m AS lon,
    r.lat1+(r.lat2-r.lat1)*(c.f-(r.b-r.m))/r.m AS lat,
    row_number() OVER (PARTITION BY c.way_id, c.seq ORDER BY r.pos) AS rn
  FROM chunks c JOIN run r ON r.way_id=c.way_id AND r.b-r.m <= c.f+1e-9 AND c.f <= r.b),
inner_points AS (SELECT c.way_id, c.seq, count(r.pos) AS n FROM chunks c LEFT JOIN run r
    ON r.way_id=c.way_id AND r.b > c.f AND r.b < c.t-1e-7 GROUP BY 1, 2)
SELECT s.way_id, s.seq, {q4('s.t-s.f')} AS chunk_m, {q4('s.lon', 7)} AS start_lon, {q4('s.lat', 7)} AS start_lat,
  i.n+2 AS n_points FROM starts s JOIN inner_points i USING (way_id, seq) WHERE rn=1""")
def h2(t: Tables):
    out = network.split_ways(way_lines(t))
    return out.select("way_id", "seq", r4("chunk_m").alias("chunk_m"), r4(F.col("pts")[0]["x"], 7).alias("start_lon"),
                      r4(F.col("pts")[0]["y"], 7).alias("start_lat"), F.size("pts").cast("long").alias("n_points"))


@register("e5_running_length", LEGS_SQL + f"SELECT way_id, pos, {q4('b')} AS running_m FROM run")
def e5(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("way_id").orderBy("pos")
    legs = (way_points(t).withColumn("lon1", F.lag("lon").over(w)).withColumn("lat1", F.lag("lat").over(w))
            .where("lon1 IS NOT NULL")
            .withColumn("m", haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon"), F.col("lat"))))
    return running_length(legs, "way_id", "pos", "m", chunk=2).select("way_id", "pos", r4("running_m").alias("running_m"))


@register("d18_segment_stats", f"""
SELECT cast(count(*) as bigint) AS segment_count, count(DISTINCT osm_way_id) AS way_count,
  max(length_m) AS maximum_length_m, {q4('avg(length_m)')} AS average_length_m FROM fx_segment""", ("fx_segment",))
def d18_segments(t: Tables):
    return network.segment_stats(t.segment()).withColumn("average_length_m", r4("average_length_m"))


# --- grids -------------------------------------------------------------------------------------------
def cell_join(alias: str, x: str, y: str, column: str) -> str:
    return (f"LEFT JOIN fx_cell {alias} ON {alias}.col=cast(floor(({x})/400) as bigint) AND "
            f"{alias}.row=cast(floor((20000-({y}))/400) as bigint) AND ({x})>=0 AND ({x})<20000 "
            f"AND {alias}.{column}<>-9999")


GRADE_SQL = f"""
WITH z AS (SELECT s.segment_id, s.length_m, a.no2 AS za, b.no2 AS zb FROM fx_segment s
  {cell_join('a', 's.x', 's.y', 'no2')} {cell_join('b', 's.x+s.length_m', 's.y', 'no2')}),
g AS (SELECT segment_id, (zb-za)/length_m*100.0 AS raw FROM z)"""


def graded(t: Tables):
    cells = t.cells().where("hazard='no2'")
    return raster.segment_grades(t.segment(), cells, t.raster_meta().where("hazard='no2'"))


@register("d14_segment_grades", GRADE_SQL + f"""
SELECT segment_id, CASE WHEN raw IS NOT NULL THEN {q4('greatest(least(raw,20),-20)')} END AS grade_pct,
  cast(coalesce(raw>20 OR raw<-20,false) as bigint) AS was_clamped FROM g""", ("fx_segment", "fx_cell"))
def d14(t: Tables):
    return graded(t).select("segment_id", r4("grade_pct").alias("grade_pct"),
                            F.col("was_clamped").cast("long").alias("was_clamped"))


@register("d18_grade_stats", GRADE_SQL + f"""
SELECT cast(count(*) as bigint) AS segment_count, count(raw) AS graded_count,
  count(*) FILTER (WHERE raw>20 OR raw<-20) AS clamped_count,
  {q4('min(CASE WHEN raw IS NOT NULL THEN greatest(least(raw,20),-20) END)')} AS minimum_grade_pct,
  {q4('max(CASE WHEN raw IS NOT NULL THEN greatest(least(raw,20),-20) END)')} AS maximum_grade_pct FROM g""", ("fx_segment", "fx_cell"))
def d18_grades(t: Tables):
    return (network.grade_stats(graded(t)).withColumn("minimum_grade_pct", r4("minimum_grade_pct"))
            .withColumn("maximum_grade_pct", r4("maximum_grade_pct")))


POLLUTANT_SQL = f"""
WITH spot AS (SELECT segment_id, x+length_m*f AS px, y FROM (
  SELECT segment_id, x, y, length_m, unnest(CASE WHEN length_m>=75 THEN [0.25,0.5,0.75] ELSE [0.5] END) AS f
  FROM fx_segment)),
samples AS (SELECT s.segment_id, avg(a.pm25) AS pm25_raw, avg(b.no2) AS no2_raw, avg(c.ozone) AS ozone_raw FROM spot s
  {cell_join('a', 's.px', 's.y', 'pm25')} {cell_join('b', 's.px', 's.y', 'no2')}
  {cell_join('c', 's.px', 's.y', 'ozone')} GROUP BY 1)"""


@register("d15_pollutant_samples", POLLUTANT_SQL + f"""
SELECT segment_id, {q4('pm25_raw')} AS pm25_raw, {q4('no2_raw')} AS no2_raw, {q4('ozone_raw')} AS ozone_raw
FROM samples""", ("fx_segment", "fx_cell"))
def d15(t: Tables):
    out = raster.pollutant_samples(t.segment(), t.cells(), t.raster_meta())
    return out.select("segment_id", *[r4(f"{h}_raw").alias(f"{h}_raw") for h in ("pm25", "no2", "ozone")])


def _ranked(h: str) -> str:
    return (f"{h} AS (SELECT segment_id, percent_rank() OVER (ORDER BY cast({q4(h + '_raw', 6)} as float))*100 AS s "
            f"FROM samples WHERE {h}_raw IS NOT NULL)")


@register("e2_pollutant_percentiles", POLLUTANT_SQL + f""", {_ranked('pm25')}, {_ranked('no2')}, {_ranked('ozone')}
SELECT m.segment_id, {q4('pm25.s')} AS pm25_prior, {q4('no2.s')} AS no2_prior, {q4('ozone.s')} AS ozone_prior
FROM samples m LEFT JOIN pm25 USING (segment_id) LEFT JOIN no2 USING (segment_id) LEFT JOIN ozone USING (segment_id)
""", ("fx_segment", "fx_cell"))
def e2_pollutants(t: Tables):
    samples = stored(raster.pollutant_samples(t.segment(), t.cells(), t.raster_meta()).select(
        "segment_id", *[r4(f"{h}_raw", 6).alias(f"{h}_raw") for h in ("pm25", "no2", "ozone")]),
        "segment_nyccas_sample")
    return exposure.pollutant_percentiles(samples).select(
        "segment_id", *[r4(f"{h}_prior").alias(f"{h}_prior") for h in ("pm25", "no2", "ozone")])


@register("d18_pollutant_stats", POLLUTANT_SQL + """
SELECT cast(count(*) as bigint) AS sampled_count, count(pm25_raw) AS pm25_count, count(no2_raw) AS no2_count,
  count(ozone_raw) AS ozone_count, (SELECT count(*) FROM fx_segment) AS segment_count FROM samples""",
          ("fx_segment", "fx_cell"))
def d18_pollutants(t: Tables):
    return network.pollutant_stats(raster.pollutant_samples(t.segment(), t.cells(), t.raster_meta()), t.segment())


@register("c17_sample_raster", f"""
SELECT i.image_id, {q4('coalesce(a.no2, b.pm25)')} AS value FROM fx_image i
{cell_join('a', 'i.x', 'i.y', 'no2')} {cell_join('b', 'i.x', 'i.y', 'pm25')}""", ("fx_image", "fx_cell"))
def c17(t: Tables):
    meta = t.raster_meta().where("hazard <> 'ozone'").withColumn(
        "priority", F.when(F.col("hazard") == "no2", 0).otherwise(1))
    out = raster.sample_raster(t.image().select("image_id", "x", "y"), t.cells(), meta)
    return out.select("image_id", r4("value").alias("value"))


@register("d18_traffic_stats", TRAFFIC_SQL + f"""
SELECT cast(count(*) as bigint) AS segment_count, count(*) FILTER (WHERE road_class_count>0) AS exposed_segment_count,
  {q4('max(raw_kernel)')} AS maximum_raw_kernel, (SELECT count(*) FROM fx_road) AS source_count FROM traffic""",
          ("fx_segment", "fx_road"))
def d18_traffic(t: Tables):
    out = network.kernel_stats(exposure.traffic_exposure(t.segment(), t.road()), "road_class_count", t.road())
    return out.withColumn("maximum_raw_kernel", r4("maximum_raw_kernel"))


@register("d18_industrial_stats", INDUSTRIAL_SQL + f"""
SELECT cast(count(*) as bigint) AS segment_count, count(*) FILTER (WHERE facility_count>0) AS exposed_segment_count,
  {q4('max(raw_kernel)')} AS maximum_raw_kernel, (SELECT count(*) FROM fx_facility) AS source_count FROM industrial""",
          ("fx_segment", "fx_facility"))
def d18_industrial(t: Tables):
    out = network.kernel_stats(exposure.industrial_exposure(t.segment(), t.facility()), "facility_count", t.facility())
    return out.withColumn("maximum_raw_kernel", r4("maximum_raw_kernel"))


@register("d18_tree_stats", TREE_SQL + """
SELECT cast(count(*) as bigint) AS segment_count, count(*) FILTER (WHERE tree_count>0) AS shaded_segment_count,
  count(*) FILTER (WHERE allergen_weight>0) AS pollen_segment_count, (SELECT count(*) FROM fx_tree) AS tree_count,
  (SELECT count(*) FROM fx_tree WHERE genus<>'Other') AS allergenic_tree_count FROM trees""", ("fx_segment", "fx_tree"))
def d18_trees(t: Tables):
    genera = exposure.genus_table(t.spark)
    return network.tree_stats(exposure.tree_exposure(t.segment(), t.tree(), genera), t.tree(), genera)


@register("c1_geocode_permits", """
SELECT o.o_orderkey AS permit_id, cast((o.o_custkey*3)%20000 as double) AS x, cast((o.o_custkey*7)%20000 as double) AS y
FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey WHERE c.c_mktsegment<>'MACHINERY'""")
def c1(t: Tables):
    permits = t.raw("orders").selectExpr("o_orderkey AS permit_id", "o_custkey AS bin")
    centroids = t.raw("customer").where("c_mktsegment<>'MACHINERY'").selectExpr(
        "c_custkey AS bin", "cast((c_custkey*3)%20000 as double) AS x", "cast((c_custkey*7)%20000 as double) AS y")
    return exposure.geocode_permits(permits, centroids, min_rows=1).select("permit_id", "x", "y")


@register("b14_check_rules", """
SELECT 'positive_length' AS rule, cast(count(*) FILTER (WHERE NOT length_m>0) as bigint) AS broken FROM fx_segment
UNION ALL SELECT 'two_points', cast(0 as bigint)
UNION ALL SELECT 'seq_from_zero', count(*) FILTER (WHERE NOT seq>=0) FROM fx_segment
UNION ALL SELECT 'steep', count(*) FILTER (WHERE NOT abs(grade_pct)<=15) FROM fx_segment""", ("fx_segment",))
def b14(t: Tables):
    rules = {**quality.TABLE_RULES["segment"](), "steep": F.abs("grade_pct") <= 15}
    return quality.check(t.segment(), rules)


@register("d20_exact_quantiles", f"""
SELECT hazard, fraction, {q4('quantile_cont(value, fraction)')} AS quantile
FROM (SELECT * FROM fx_reading) GROUP BY hazard, fraction""".replace(
    "(SELECT * FROM fx_reading)", "fx_reading, (VALUES (0.25),(0.5),(0.9)) v(fraction)").replace(
    "quantile_cont(value, fraction)",
    "CASE fraction WHEN 0.25 THEN quantile_cont(value,0.25) WHEN 0.5 THEN quantile_cont(value,0.5) "
    "ELSE quantile_cont(value,0.9) END").replace("fraction, (floor", "fraction::double AS fraction, (floor"),
    ("fx_reading",))
def d20_quantiles(t: Tables):
    out = exact_quantiles(t.reading(), "value", (0.25, 0.5, 0.9), ["hazard"])
    return out.select("hazard", "fraction", r4("quantile").alias("quantile"))
