"""Feed parsers over documents that Spark writes from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, Tables, micros, q4, r4, register, ts
from catalog.scalars import TAGS_SQL, tags
from kerbside import sinks
from kerbside.sources import feeds


def doc(df, *columns):
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def way_rows(t: Tables):
    lon, lat = (F.col("p_partkey") % 1000) * 0.0005 - 74.2, (F.col("p_partkey") % 700) * 0.0005 + 40.5
    point = lambda d: F.array(lon + d, lat)
    feature = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.concat(F.when(F.col("p_size") % 10 == 0, "a").otherwise("w"), F.col("p_partkey")).alias("id"),
        F.struct(F.lit("LineString").alias("type"), F.array(point(0.0), point(0.001)).alias("coordinates")).alias("geometry"),
        F.map_filter("tags", lambda k, v: v.isNotNull()).alias("properties")))
    named = tags(t).join(t.raw("part").select("p_partkey", "p_size"), "p_partkey")
    return named.select(F.concat(F.lit("\u001e"), feature).alias("value"))


@register("a1_ways", f"""
SELECT p_partkey AS osm_way_id, highway AS highway_class, cast(CASE sidewalk WHEN 'Left' THEN true WHEN 'no' THEN false END as bigint) AS has_sidewalk, 2::bigint AS n_points
FROM {TAGS_SQL.replace('FROM part', ', p_size FROM part')} WHERE p_size%10<>0 AND coalesce(highway,'')<>'' AND highway<>'motorway' AND (
    (foot<>'no' AND (access NOT IN ('no','Private') OR foot='yes')) OR (highway<>'steps' AND bicycle<>'no' AND (access NOT IN ('no','Private') OR bicycle='designated')))""")
def a1(t: Tables):
    return feeds.parse_ways(way_rows(t)).select("osm_way_id", "highway_class", F.col("has_sidewalk").cast("long").alias("has_sidewalk"),
                                                F.size("pts").cast("long").alias("n_points"))


@register("a15_traffic_roads", """SELECT p_partkey AS osm_way_id, CASE WHEN p_type IN ('LARGE','MEDIUM') THEN 'primary' ELSE 'trunk' END AS highway_class, CASE WHEN p_type IN ('LARGE','MEDIUM') THEN 3.0::double ELSE 4.0::double END AS proxy_weight FROM part WHERE p_type IN ('LARGE','MEDIUM','STANDARD')""")
def a15(t: Tables):
    kind = F.expr("CASE p_type WHEN 'LARGE' THEN 'Primary' WHEN 'MEDIUM' THEN 'primary_link' WHEN 'STANDARD' THEN 'trunk' ELSE 'residential' END")
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(2.0))).alias("coordinates"))
    rows = doc(t.raw("part"), F.concat(F.lit("w"), F.col("p_partkey")).alias("id"), line.alias("geometry"), F.struct(kind.alias("highway")).alias("properties"))
    return feeds.parse_traffic_roads(rows).select("osm_way_id", "highway_class", "proxy_weight")


def tri_raw(t: Tables):
    return t.raw("supplier").select(
        F.col("s_suppkey").alias("row_order"), (F.col("s_suppkey") % 70).cast("string").alias("3. FRS ID"), F.concat(F.lit(" "), F.col("s_name")).alias("4. FACILITY NAME"),
        F.when(F.col("s_nationkey") == 3, "NJ").otherwise("NY").alias("8. ST"), F.when(F.col("s_nationkey") == 5, "n/a").otherwise((F.col("s_suppkey") % 50 * 0.01 + 40.5).cast("string")).alias("12. LATITUDE"),
        F.lit("-74.0").alias("13. LONGITUDE"))


TRI = """tri AS (SELECT s_suppkey, cast(s_suppkey%70 as varchar) AS source_id, s_name AS name, s_suppkey%50*0.01+40.5 AS latitude FROM supplier WHERE s_nationkey NOT IN (3,5) AND s_suppkey%50*0.01+40.5 <= 40.937577),
tri1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s_suppkey) AS rn FROM tri) WHERE rn=1)"""
ECHO = """echo AS (SELECT c_custkey, cast(c_custkey%900 as varchar) AS source_id, c_name AS name, CASE WHEN c_nationkey%2=0 THEN 'CAA' ELSE '' END || CASE WHEN c_nationkey%3=0 THEN 'RCRA' ELSE '' END || CASE WHEN c_nationkey%5=0 THEN 'EIS' ELSE '' END AS programs FROM customer WHERE c_nationkey%2=0 OR c_nationkey%5=0)"""


def echo_raw(t: Tables):
    flag = lambda n: F.when(F.col("c_nationkey") % n == 0, "X1").otherwise("  ")
    return t.raw("customer").select(
        F.col("c_custkey").alias("row_order"), F.col("c_name").alias("FacName"), F.lit("NY").alias("FacState"), (F.col("c_custkey") % 900).cast("string").alias("RegistryID"),
        F.lit("40.7").alias("FacLat"), F.lit("-74.0").alias("FacLong"), flag(2).alias("AIRIDs"), flag(3).alias("RCRAIDs"), flag(5).alias("EisIDs"))


@register("a2_tri_facilities", f"WITH {TRI} SELECT source_id, name, {q4('latitude')} AS latitude FROM tri1")
def a2(t: Tables):
    return feeds.parse_tri(tri_raw(t)).select("source_id", "name", r4("latitude").alias("latitude"))


@register("a3_echo_facilities", f"WITH {ECHO} SELECT source_id, name, programs FROM echo")
def a3(t: Tables):
    return feeds.parse_echo(echo_raw(t)).select("source_id", "name", F.array_join("programs", "").alias("programs"))


@register("g1_union_facilities", f"WITH {TRI}, {ECHO} SELECT 'TRI' AS source, source_id, name FROM tri1 UNION ALL SELECT 'ECHO', source_id, name FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY c_custkey DESC) AS rn FROM echo) WHERE rn=1")
def g1(t: Tables):
    return sinks.union_facilities(feeds.parse_tri(tri_raw(t)), feeds.parse_echo(echo_raw(t))).select("source", "source_id", "name")


def openaq_rows(t: Tables):
    e = t.raw("events")
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    name = F.expr("CASE event_type WHEN 'view' THEN 'PM2.5' WHEN 'click' THEN 'o3' WHEN 'purchase' THEN 'no2' ELSE 'co' END")
    parameter = F.struct(F.when(F.col("event_id") % 2 == 0, name).alias("name"), name.alias("displayName"), F.lit("ppm").alias("units"))
    first = F.when(F.col("event_id") % 3 > 0, F.struct(stamp.alias("utc"))).alias("datetimeFrom")
    period = F.struct(first, F.struct(stamp.alias("utc")).alias("datetimeTo"))
    result = F.struct(F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"), period.alias("period"))
    return doc(e, F.struct((F.col("user_id") % 5).alias("id")).alias("location"), F.struct(F.col("user_id").alias("id"), parameter.alias("parameter")).alias("sensor"), F.array(result).alias("results"))


@register("a4_sensor_hours", """SELECT CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'ozone' ELSE 'no2' END AS hazard, 'openaq:'||(user_id%5)||':'||user_id AS station_id, epoch_us(ts) AS observed_us, value, 'ppm' AS unit FROM events WHERE event_type IN ('view','click','purchase') AND event_id%7>0""")
def a4(t: Tables):
    return feeds.parse_openaq(openaq_rows(t)).select("hazard", "station_id", micros("observed_at").alias("observed_us"), "value", "unit")


@register("a5_air_quality_index", """SELECT CASE event_type WHEN 'view' THEN 'pm25_aqi' ELSE 'ozone_aqi' END AS hazard, 'airnow:'||CASE WHEN event_id%4=0 THEN 'nyc' ELSE 'Area '||(user_id%3) END AS station_id, value FROM events WHERE event_type IN ('view','click')""")
def a5(t: Tables):
    row = F.struct(F.expr("CASE event_type WHEN 'view' THEN 'PM2.5' WHEN 'click' THEN 'OZONE' ELSE 'PM10' END").alias("ParameterName"),
                   F.expr("CASE WHEN event_id%4>0 THEN concat('Area ', user_id%3) END").alias("ReportingArea"), F.col("value").alias("AQI"))
    rows = t.raw("events").select(F.to_json(F.array(row)).alias("value"))
    return feeds.parse_airnow(rows, ts(AS_OF)).select("hazard", "station_id", "value")


@register("a6_weather", f"""SELECT hazard, {q4('v')} AS value, count(*) AS n FROM (SELECT unnest(['heat','humidity','wind_speed','wind_bearing']) AS hazard,
  unnest([CASE WHEN event_id%2=0 THEN (value-32)*5/9 ELSE value END, CASE WHEN event_id%3>0 THEN cast(user_id as double) END, CASE WHEN event_id%5>0 THEN cast(user_id%30 as double) END, 225.0]) AS v FROM events) WHERE v IS NOT NULL GROUP BY 1, 2""")
def a6(t: Tables):
    period = F.struct(F.lit("2024-01-01T00:00:00-05:00").alias("startTime"), F.col("value").alias("temperature"), F.when(F.col("event_id") % 2 == 1, "C").alias("temperatureUnit"),
                      F.struct(F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("value")).alias("relativeHumidity"),
                      F.expr("CASE WHEN event_id%5>0 THEN concat(user_id%30, ' to 99 mph') ELSE 'calm' END").alias("windSpeed"), F.lit("sw").alias("windDirection"))
    rows = doc(t.raw("events"), F.struct(F.array(period).alias("periods")).alias("properties"))
    return feeds.parse_weather(rows).groupBy("hazard", r4("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@register("a7_alerts", """SELECT 'a'||event_id AS id, 'Notice' AS event, CASE WHEN event_id%3>0 THEN epoch_us(date_trunc('second', ts)) END AS onset_us, CASE WHEN event_id%2>0 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(TIMESTAMP '2024-01-30 12:00:00') END AS updated_us FROM events WHERE event_id%11>0""")
def a7(t: Tables):
    stamp = F.concat(F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "-05:00"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    own = F.concat(F.lit("a"), F.col("event_id"))
    properties = F.struct(F.when(F.col("event_id") % 2 > 0, own).alias("id"), F.when(F.col("event_id") % 11 > 0, "Notice").alias("event"),
                          F.when(F.col("event_id") % 3 > 0, stamp).alias("onset"), F.when(F.col("event_id") % 2 > 0, stamp).alias("sent"))
    rows = doc(t.raw("events"), F.array(F.struct(own.alias("id"), properties.alias("properties"))).alias("features"))
    return feeds.parse_alerts(rows, ts(AS_OF)).select("id", "event", micros("onset").alias("onset_us"), micros("updated_at").alias("updated_us"))


@register("a8_pollen", """SELECT hazard, 'google-pollen:40.'||printf('%05d', user_id)||':-74.00000' AS station_id, epoch_us(date_trunc('day', ts)) AS observed_us, v AS value FROM (SELECT user_id, ts, unnest(['pollen_tree','pollen_grass']) AS hazard, unnest([value, 0.0]) AS v FROM events)""")
def a8(t: Tables):
    c = F.col("ts").cast("timestamp")
    info = F.array(F.struct(F.lit("tree").alias("code"), F.struct(F.col("value").alias("value")).alias("indexInfo")),
                   F.struct(F.lit("GRASS").alias("code"), F.lit(None).cast("struct<value:double>").alias("indexInfo")),
                   F.struct(F.lit("MOLD").alias("code"), F.struct(F.col("value").alias("value")).alias("indexInfo")))
    day = F.struct(F.struct(F.year(c).alias("year"), F.month(c).alias("month"), F.day(c).alias("day")).alias("date"), info.alias("pollenTypeInfo"))
    rows = doc(t.raw("events"), (F.lit(40.0) + F.col("user_id") * 0.00001).alias("latitude"), F.lit(-74.0).alias("longitude"), F.struct(F.array(day).alias("dailyInfo")).alias("forecast"))
    return feeds.parse_pollen(rows).select("hazard", "station_id", micros("observed_at").alias("observed_us"), "value")


@register("a9_permits", """SELECT 'P'||o_orderkey AS permit_id, cast(o_custkey as varchar) AS bin, cast(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END as bigint) AS severity, strftime(o_orderdate,'%Y-%m-%d') AS expires_at FROM orders WHERE o_orderdate>=TIMESTAMP '1998-06-01' AND o_orderstatus<>'F' AND o_orderkey%13>0""")
def a9(t: Tables):
    kind = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'Partial DEMOLITION' WHEN '2-HIGH' THEN 'Foundation' WHEN '3-MEDIUM' THEN 'Supported Scaffold' ELSE 'Plumbing' END")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.000")
    rows = doc(t.raw("orders"), F.concat(F.lit("P"), F.col("o_orderkey")).alias("work_permit"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_custkey")).alias("bin"), kind.alias("work_type"),
               F.when(F.col("o_orderstatus") == "F", "Expired").otherwise("Permit Issued").alias("permit_status"), stamp.alias("issued_date"), stamp.alias("expired_date"))
    return feeds.parse_permits(rows, ts("1998-06-01")).select("permit_id", "bin", F.col("severity").cast("long").alias("severity"), F.col("expires_at").cast("string").alias("expires_at"))


@register("a10_centroids", "SELECT cast(c_custkey%300 as varchar) AS bin, max(c_custkey)*0.001 AS longitude FROM customer GROUP BY 1".replace("max(c_custkey)*0.001", "max(c_custkey)*0.001::double"))
def a10(t: Tables):
    feature = F.struct(F.struct((F.col("c_custkey") % 300).alias("bin")).alias("properties"), F.struct(F.array(F.col("c_custkey") * F.lit(0.001), F.lit(40.0)).alias("coordinates")).alias("geometry"))
    rows = t.raw("customer").select(F.col("c_custkey").alias("row_order"), F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))
    return feeds.parse_centroids(rows).select("bin", "longitude")


@register("a11_trees", """SELECT c_custkey AS tree_id, CASE WHEN c_nationkey%4=0 THEN NULL ELSE 'Quercus' END AS genus, CASE WHEN c_nationkey%3=0 THEN NULL ELSE cast(c_nationkey as double) END AS dbh_inches FROM customer WHERE c_mktsegment<>'BUILDING' AND c_custkey%7>0 AND c_nationkey<20""")
def a11(t: Tables):
    rows = doc(t.raw("customer"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey").cast("string")).otherwise("x").alias("tree_id"),
               F.when(F.col("c_nationkey") % 4 == 0, " ").otherwise(" Quercus rubra").alias("spc_latin"), F.when(F.col("c_mktsegment") == "BUILDING", "Dead").otherwise("Alive").alias("status"),
               F.when(F.col("c_nationkey") % 3 == 0, "big").otherwise(F.col("c_nationkey").cast("string")).alias("tree_dbh"),
               (F.lit(40.5) + F.when(F.col("c_nationkey") < 20, 0.1).otherwise(5)).cast("string").alias("latitude"), F.lit("-74.0").alias("longitude"))
    return feeds.parse_trees(rows).select("tree_id", "genus", "dbh_inches")


@register("a12_images", """SELECT cast(image_id as varchar) AS image_id, cast((compass_angle+720)%360 as double) AS compass_angle, captured_s*1000000 AS captured_us FROM fx_image WHERE image_id%9>0""", ("fx_image",))
def a12(t: Tables):
    i = t.image()
    seconds = F.unix_seconds("captured_at")
    iso = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss")
    captured = F.when(F.col("image_id") % 3 == 0, (seconds * 1000).cast("string")).when(F.col("image_id") % 3 == 1, seconds.cast("string")).otherwise(F.concat(iso, F.lit("Z")))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.lit(-74.0), F.lit(40.7)).alias("coordinates"))
    # Every image is listed twice; the later copy has the right heading.
    twice = i.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = twice.select((F.col("image_id") * 2 + F.col("copy")).alias("row_order"), F.to_json(F.struct(
        F.col("image_id").cast("string").alias("id"), point.alias("geometry"), (F.when(F.col("copy") == 1, F.col("compass_angle") - 720).otherwise(F.lit(1.0))).alias("compass_angle"),
        captured.alias("captured_at"), F.when(F.col("image_id") % 9 > 0, F.col("thumb_url")).otherwise(" ").alias("thumb_1024_url"))).alias("value"))
    return feeds.parse_images(rows).select("image_id", "compass_angle", micros("captured_at").alias("captured_us"))


@register("a13_latest_grids", """SELECT hazard, cast(max(y) as bigint) AS year FROM (SELECT unnest(['pm25','no2','ozone']) AS hazard, p_size AS y FROM part) GROUP BY 1""")
def a13(t: Tables):
    names = F.explode(F.array(F.concat(F.lit("grids/AA"), F.col("p_size"), F.lit("_pm300m/hdr.adf")), F.concat(F.lit("grids/aa"), F.col("p_size"), F.lit("_no2300m/hdr.adf")),
                              F.concat(F.lit("grids/s"), F.col("p_size"), F.lit("_o3300m/hdr.adf")), F.concat(F.lit("grids/w"), F.col("p_size"), F.lit("_o3300m/hdr.adf"))))
    return feeds.latest_grids(t.raw("part").select(names.alias("path"))).select("hazard", F.col("year").cast("long").alias("year"))


@register("a14_boundary_membership", """SELECT image_id, r_regionkey::bigint AS area_id FROM fx_image, region WHERE x>=r_regionkey*4000 AND x<r_regionkey*4000+3500 AND y>=1000 AND y<15000""", ("fx_image",))
def a14(t: Tables):
    from kerbside.operators.spatial import in_areas

    x = (F.col("r_regionkey") * 4000).cast("double")
    corner = lambda dx, y: F.array(x + dx, F.lit(float(y)))
    ring = F.array(corner(0, 1000), corner(3500, 1000), corner(3500, 15000), corner(0, 15000), corner(0, 1000))
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    features = t.raw("region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", feature.alias("f")))).alias("all"))
    rows = features.select(F.to_json(F.struct(F.transform("all", lambda a: a["f"]).alias("features"))).alias("value"))
    area = feeds.borough_boundary(rows)
    inside = in_areas(t.image().select("image_id", "x", "y"), area, "image_id")
    return inside.select("image_id", F.col("area_id").cast("long").alias("area_id"))
