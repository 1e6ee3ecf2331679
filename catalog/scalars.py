"""Column functions and row predicates over the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from catalog.base import Tables, q4, r4, register
from kerbside.functions import geo, numbers, rules, text
from kerbside.operators import quality
from kerbside.operators.spatial import in_areas
from kerbside.vocab import AQI_CATEGORIES, MODE_ALIASES, WIND_BEARINGS

LONLAT = "-74.2+(o_custkey%500)*0.001 AS lon1, 40.5+(o_orderkey%400)*0.001 AS lat1, " \
         "-74.1+(o_orderkey%300)*0.001 AS lon2, 40.6+(o_custkey%200)*0.001 AS lat2"


def lonlat(t: Tables):
    return t.raw("orders").selectExpr(
        "o_orderkey", "-74.2D+(o_custkey%500)*0.001D AS lon1", "40.5D+(o_orderkey%400)*0.001D AS lat1",
        "-74.1D+(o_orderkey%300)*0.001D AS lon2", "40.6D+(o_custkey%200)*0.001D AS lat2")


@register("h1_haversine", f"""
SELECT o_orderkey, {q4('2*6371008.8*asin(sqrt(power(sin((radians(lat2)-radians(lat1))/2),2)+cos(radians(lat1))*cos(radians(lat2))*power(sin((radians(lon2)-radians(lon1))/2),2)))')} AS metres
FROM (SELECT o_orderkey, {LONLAT} FROM orders)""")
def h1(t: Tables):
    c = F.col
    return lonlat(t).select("o_orderkey", r4(geo.haversine_m(c("lon1"), c("lat1"), c("lon2"), c("lat2"))).alias("metres"))


@register("h3_line_measures", f"""
SELECT segment_id, length_m, {q4('x+length_m*0.25')} AS quarter_x, y AS quarter_y, {q4('x+length_m/2')} AS centroid_x,
  x AS start_x, x+length_m AS end_x FROM fx_segment""", ("fx_segment",))
def h3(t: Tables):
    pts = F.col("pts")
    quarter, middle = geo.point_at(pts, F.lit(0.25)), geo.centroid(pts)
    return t.segment().select(
        "segment_id", geo.line_length(pts).alias("length_m"), r4(quarter["x"]).alias("quarter_x"),
        quarter["y"].alias("quarter_y"), r4(middle["x"]).alias("centroid_x"),
        geo.start_point(pts)["x"].alias("start_x"), geo.end_point(pts)["x"].alias("end_x"))


BEARING = "CASE WHEN dx=0 AND dy=0 THEN 0.0 WHEN degrees(atan2(dx,dy))<0 THEN degrees(atan2(dx,dy))+360 ELSE degrees(atan2(dx,dy)) END"


@register("h4_h5_bearings", f"""
SELECT o_orderkey, {q4('b')} AS bearing, {q4('abs(((o_custkey%360)-b+540)-360*floor(((o_custkey%360)-b+540)/360)-180)')} AS turn
FROM (SELECT *, {BEARING} AS b FROM (SELECT o_orderkey, o_custkey, cast(o_custkey%41-20 as double) AS dx,
  cast(o_orderkey%37-18 as double) AS dy FROM orders))""")
def h4(t: Tables):
    moved = t.raw("orders").selectExpr("o_orderkey", "o_custkey", "cast(o_custkey%41-20 as double) AS dx",
                                       "cast(o_orderkey%37-18 as double) AS dy")
    b = geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.col("dx"), F.col("dy"))
    return moved.select("o_orderkey", r4(b).alias("bearing"),
                        r4(geo.angle_diff((F.col("o_custkey") % 360).cast("double"), b)).alias("turn"))


def _utm_sql() -> str:
    f = 1 / 298.257223563
    n = f / (2 - f)
    a_hat = 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    al = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    east = "+".join(f"{al[j - 1]:.17e}*cos({2 * j}*xi)*(exp({2 * j}*eta)-exp(-{2 * j}*eta))/2" for j in (1, 2, 3))
    return f"""SELECT o_orderkey, {q4(f"500000+{0.9996 * a_hat:.17e}*(eta+{east})", 3)} AS east FROM (
      SELECT o_orderkey, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM (
      SELECT o_orderkey, radians(lon1+75) AS dl, (exp(u)-exp(-u))/2 AS t FROM (
      SELECT o_orderkey, lon1, atanh(sin(radians(lat1)))-{e:.17e}*atanh({e:.17e}*sin(radians(lat1))) AS u
      FROM (SELECT o_orderkey, {LONLAT} FROM orders))))"""


@register("h6_utm18", _utm_sql())
def h6(t: Tables):
    east, _ = geo.to_utm18(F.col("lon1"), F.col("lat1"))
    return lonlat(t).select("o_orderkey", r4(east, 3).alias("east"))


@register("h6_mercator", f"""
SELECT o_orderkey, {q4('radians(lon1)*6378137.0', 3)} AS mx, {q4('ln(tan(pi()/4+radians(lat1)/2))*6378137.0', 3)} AS my
FROM (SELECT o_orderkey, {LONLAT} FROM orders)""")
def h6_mercator(t: Tables):
    mx, my = geo.to_mercator(F.col("lon1"), F.col("lat1"))
    return lonlat(t).select("o_orderkey", r4(mx, 3).alias("mx"), r4(my, 3).alias("my"))


@register("h7_tile_of", f"""
SELECT o_orderkey, cast(floor((lon1+180)/360*65536+1e-7) as bigint) AS tile_x,
  cast(floor((1-ln(tan(radians(lat1))+1/cos(radians(lat1)))/pi())/2*65536) as bigint) AS tile_y
FROM (SELECT o_orderkey, {LONLAT} FROM orders)""")
def h7(t: Tables):
    x, y = geo.tile_of(F.col("lon1") + 1e-12, F.col("lat1"), 16)
    return lonlat(t).select("o_orderkey", x.alias("tile_x"), y.alias("tile_y"))


@register("h8_lattice", """
SELECT cast(i as bigint) AS i, cast(j as bigint) AS j FROM
  (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_facility),
  generate_series(0, 40) a(i), generate_series(0, 40) b(j)
WHERE x0+250+i*500 <= x1 AND y0+250+j*500 <= y1""", ("fx_facility",))
def h8(t: Tables):
    from kerbside.operators.live import lattice

    hull = t.facility().agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    area = hull.select(F.array(F.array(corner("a", "c"), corner("b", "c"), corner("b", "d"), corner("a", "d"))).alias("rings"))
    return lattice(area, 500.0).select("i", "j")


@register("h9_weather_text", """
SELECT event_id, floor(((value-32.0)*5.0/9.0)*10000+0.500001)/10000 AS celsius, cast(user_id%30 as double) AS wind,
  CASE user_id%4 WHEN 0 THEN 0.0 WHEN 1 THEN 247.5 WHEN 2 THEN 337.5 ELSE NULL END::double AS bearing FROM events""")
def h9(t: Tables):
    feed = t.raw("events").selectExpr(
        "event_id", "value", "concat(user_id%30, ' to ', user_id%30+5, ' mph') AS speed",
        "element_at(array('n','WSW','nnw','calm'), cast(user_id%4 as int)+1) AS direction")
    return feed.select("event_id", r4(text.f_to_c(F.col("value"))).alias("celsius"),
                       text.first_number(F.col("speed")).alias("wind"),
                       text.wind_bearing(F.col("direction")).alias("bearing"))


@register("h10_instants", """
SELECT event_id, epoch_us(ts) AS iso_us, epoch_us(date_trunc('second', ts)) AS seconds_us,
  epoch_us(date_trunc('millisecond', ts)) AS millis_us, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def h10(t: Tables):
    e = t.raw("events").withColumn("at", F.col("ts").cast("timestamp"))
    iso = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return e.select("event_id", F.unix_micros(text.parse_instant(iso)).alias("iso_us"),
                    F.unix_micros(text.parse_epoch(F.unix_seconds("at"))).alias("seconds_us"),
                    F.unix_micros(text.parse_epoch(F.unix_millis("at"))).alias("millis_us"),
                    text.date_prefix(iso).cast("string").alias("day"))


@register("h11_recency_weight", f"""
SELECT image_id, {q4('exp(-greatest(1704067200-captured_s,0)/31557600.0/0.5)', 6)} AS weight FROM fx_image""", ("fx_image",))
def h11(t: Tables):
    w = numbers.recency_weight(F.col("captured_at"), F.timestamp_seconds(F.lit(1704067200)), 0.5)
    return t.image().select("image_id", r4(w, 6).alias("weight"))


@register("h12_percentage_change", """
SELECT o_orderkey, CASE WHEN b=0 THEN CASE WHEN v=0 THEN 0.0 END ELSE floor((v-b)/b*10000.0+0.5)/10000.0 END AS change
FROM (SELECT o_orderkey, cast(o_custkey%7 as double) AS b, cast(o_orderkey%11 as double) AS v FROM orders)""")
def h12(t: Tables):
    return t.raw("orders").select("o_orderkey", numbers.percentage_change(
        (F.col("o_orderkey") % 11).cast("double"), (F.col("o_custkey") % 7).cast("double")).alias("change"))


@register("h14_speech_key", r"""
SELECT conv_id, turn, sha256(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) || '|amy|1.0') AS speech_key
FROM conversations""")
def h14(t: Tables):
    return t.raw("conversations").select("conv_id", "turn", text.speech_key(
        F.col("text"), F.lit("amy"), F.lit(1.0)).alias("speech_key"))


@register("h15_first_value", """
SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id%3=0 THEN '  ' ELSE lang END),''), nullif(trim(source),'')) AS value,
  try_cast(CASE WHEN doc_id%4=0 THEN 'n/a' ELSE cast(n_chars as varchar) END as double) AS number FROM documents""")
def h15(t: Tables):
    d = t.raw("documents")
    return d.select("doc_id", text.first_value(F.expr("CASE WHEN doc_id%3=0 THEN '  ' ELSE lang END"), F.col("source")).alias("value"),
                    text.optional_double(F.expr("CASE WHEN doc_id%4=0 THEN 'n/a' ELSE cast(n_chars as string) END")).alias("number"))


@register("h16_hist_value", "SELECT image_id, car_frac AS car, 0.25::double AS bus FROM fx_analysis", ("fx_analysis",))
def h16(t: Tables):
    from kerbside.operators.imagery import hist_value

    h = F.col("raw_class_hist")
    return t.analysis().select("image_id", hist_value(h, "car").alias("car"), hist_value(h, "bus", 0.25).alias("bus"))


@register("h17_email_key", "SELECT c_custkey, lower(trim('  '||c_name||'@Example.ORG ')) AS email FROM customer")
def h17(t: Tables):
    return t.raw("customer").select("c_custkey", text.email_key(
        F.concat(F.lit("  "), F.col("c_name"), F.lit("@Example.ORG "))).alias("email"))


@register("h18_area_name", """
SELECT permit_id, 'construction_' || CASE severity WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' WHEN 3 THEN 'high' ELSE 'severe' END AS area
FROM fx_permit""", ("fx_permit",))
def h18(t: Tables):
    return t.permit().select("permit_id", text.area_name(F.lit("construction"), F.col("severity")).alias("area"))


@register("h19_formats", """
SELECT o_orderkey,
  CASE WHEN m>=1000 THEN printf('%.1f km', m/1000) ELSE printf('%.0f m', m) END AS offset_text,
  CASE WHEN m/1609.344<0.1 THEN cast(cast(floor(m+0.5) as bigint) as varchar)||' m' ELSE printf('%.1f mi', m/1609.344) END AS distance_text,
  CASE WHEN mi<60 THEN mi||' min' WHEN mi%60>0 THEN (mi//60)||' hr '||(mi%60)||' min' ELSE (mi//60)||' hr' END AS duration_text
FROM (SELECT o_orderkey, o_custkey*7.3+0.013 AS m, greatest(1, cast(floor(o_custkey*41.0/60+0.5) as bigint)) AS mi FROM orders)""")
def h19(t: Tables):
    m = F.col("o_custkey") * F.lit(7.3) + F.lit(0.013)
    return t.raw("orders").select("o_orderkey", text.fmt_offset(m).alias("offset_text"),
                                  text.fmt_distance(m).alias("distance_text"),
                                  text.fmt_duration(F.col("o_custkey") * F.lit(41.0)).alias("duration_text"))


@register("h20_with_steps", """
SELECT segment_id, cast(s as bigint) AS step, s*20.0::double AS distance_offset_m
FROM fx_segment, generate_series(0, cast(floor(length_m/20) as bigint)) g(s)""", ("fx_segment",))
def h20(t: Tables):
    return geo.with_steps(t.segment(), F.col("length_m"), 20.0).select("segment_id", "step", "distance_offset_m")


@register("h21_canonical_key", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'foot' WHEN 'click' THEN 'bike' WHEN 'error' THEN 'foot' END AS mode FROM events""")
def h21(t: Tables):
    alias = F.expr("CASE event_type WHEN 'view' THEN ' Walking' WHEN 'click' THEN 'BICYCLE' WHEN 'error' THEN '' ELSE 'hover' END")
    return t.raw("events").select("event_id", text.canonical_key(alias, MODE_ALIASES, "foot", strict=False).alias("mode"))


@register("h22_request_id", "SELECT page_id, CASE WHEN length(url)<=64 THEN regexp_replace(url, '[^A-Za-z0-9_.:-]', '', 'g') ELSE '36' END AS request_id FROM pages")
def h22(t: Tables):
    """Overlong ids get a new random one, of which only the length can be compared."""
    clean = text.clean_request_id(F.col("url"))
    return t.raw("pages").select("page_id", F.when(F.length("url") <= 64, clean)
                                 .otherwise(F.length(clean).cast("string")).alias("request_id"))


# --- predicates ------------------------------------------------------------------------------------
TAGS_SQL = """(SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'motorway' WHEN 'SMALL' THEN 'steps' WHEN 'PROMO' THEN NULL ELSE 'footway' END AS highway,
  CASE p_size%5 WHEN 0 THEN 'no' WHEN 1 THEN 'Private' ELSE '' END AS access, CASE p_size%3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE '' END AS foot,
  CASE p_size%7 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' ELSE '' END AS bicycle,
  CASE p_size%4 WHEN 0 THEN 'no' WHEN 1 THEN 'Left' END AS sidewalk FROM part)"""


def tags(t: Tables):
    p = t.raw("part").selectExpr(
        "p_partkey", "CASE p_type WHEN 'LARGE' THEN 'motorway' WHEN 'SMALL' THEN 'steps' WHEN 'PROMO' THEN NULL ELSE 'footway' END AS highway",
        "CASE p_size%5 WHEN 0 THEN 'no' WHEN 1 THEN 'Private' END AS access", "CASE p_size%3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS foot",
        "CASE p_size%7 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' END AS bicycle", "CASE p_size%4 WHEN 0 THEN 'no' WHEN 1 THEN 'Left' END AS sidewalk")
    names = ("highway", "access", "foot", "bicycle", "sidewalk")
    return p.withColumn("tags", F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))]))


@register("b1_b2_access_sidewalk", f"""
SELECT p_partkey, cast(coalesce(highway,'')<>'' AND highway<>'motorway' AND (
    (foot<>'no' AND (access NOT IN ('no','Private') OR foot='yes'))
    OR (highway<>'steps' AND bicycle<>'no' AND (access NOT IN ('no','Private') OR bicycle='designated'))) as bigint) AS accessible,
  cast(CASE sidewalk WHEN 'Left' THEN true WHEN 'no' THEN false END as bigint) AS sidewalk FROM {TAGS_SQL}""".replace(
    "cast(coalesce(highway,'')<>'' AND", "cast(coalesce(highway,'')<>'' AND").replace("as bigint) AS accessible", "as bigint) AS accessible"))
def b1(t: Tables):
    return tags(t).select("p_partkey", rules.accessible(F.col("tags")).cast("long").alias("accessible"),
                          rules.sidewalk(F.col("tags")).cast("long").alias("sidewalk"))


WORK = "['Full Demolition','General Construction','Sidewalk Shed','Plumbing','Suspended Scaffold','Structural']"


@register("b3_permit_severity", f"""
SELECT o_orderkey, cast(([4,3,2,1,2,3])[cast(o_orderkey%6 as int)+1] as bigint) AS severity FROM orders""")
def b3(t: Tables):
    kinds = F.array(*[F.lit(w.strip("'")) for w in WORK.strip("[]").split(",")])
    return t.raw("orders").select("o_orderkey", rules.permit_severity(
        F.element_at(kinds, (F.col("o_orderkey") % 6).cast("int") + 1)).cast("long").alias("severity"))


@register("b4_b13_points", f"""
SELECT o_orderkey, cast(lon1 BETWEEN -74.25909 AND -73.700272 AND lat2*1.005 BETWEEN 40.477399 AND 40.917577 as bigint) AS inside,
  cast(lat1*2.22 <= 90 as bigint) AS valid FROM (SELECT o_orderkey, {LONLAT} FROM orders)""")
def b4(t: Tables):
    c = F.col
    return lonlat(t).select("o_orderkey", geo.in_bbox(c("lon1"), c("lat2") * 1.005).cast("long").alias("inside"),
                            geo.valid_point(c("lat1") * 2.22, c("lon2")).cast("long").alias("valid"))


@register("b7_in_areas", """
WITH area AS (SELECT n_nationkey AS area_id, cast(n_nationkey%5*4000+200 as double) AS ax, cast(n_nationkey//5*4000+300 as double) AS ay FROM nation),
edge AS (SELECT area_id, ax AS x1, ay AS y1, ax+3500 AS x2, ay+700 AS y2 FROM area
  UNION ALL SELECT area_id, ax+3500, ay+700, ax+900, ay+3600 FROM area
  UNION ALL SELECT area_id, ax+900, ay+3600, ax, ay FROM area)
SELECT image_id, area_id FROM fx_image, edge WHERE (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1
GROUP BY image_id, area_id HAVING count(*)%2=1""", ("fx_image",))
def b7(t: Tables):
    base = t.raw("nation").selectExpr("n_nationkey AS area_id", "cast(n_nationkey%5*4000+200 as double) AS ax",
                                      "cast(n_nationkey div 5*4000+300 as double) AS ay")
    p = lambda dx, dy: F.struct((F.col("ax") + dx).alias("x"), (F.col("ay") + dy).alias("y"))
    areas = base.select("area_id", F.array(F.array(p(0, 0), p(3500, 700), p(900, 3600))).alias("rings"))
    return in_areas(t.image().select("image_id", "x", "y"), areas, "image_id").select("image_id", "area_id")


_AQI = " ".join(f"WHEN a<={limit} THEN '{name}'" for limit, name in AQI_CATEGORIES if limit)


@register("b8_b9_categories", f"""
SELECT event_id, CASE {_AQI} ELSE 'Hazardous' END AS aqi,
  (['None','Very low','Low','Moderate','High','Very high'])[cast(greatest(0,least(5,floor(value/10+0.5))) as int)+1] AS pollen
FROM (SELECT event_id, value, cast(floor(value+0.5) as bigint) AS a FROM events)""")
def b8(t: Tables):
    return t.raw("events").select("event_id", rules.aqi_category(numbers.half_up(F.col("value")).cast("long")).alias("aqi"),
                                  rules.pollen_category(F.col("value") / 10).alias("pollen"))


@register("b11_valid_tile", """
SELECT o_orderkey, cast(z<=22 AND x<power(2,z) AND y<power(2,z) as bigint) AS valid
FROM (SELECT o_orderkey, o_orderkey%25 AS z, o_custkey AS x, o_orderkey%9000 AS y FROM orders)""")
def b11(t: Tables):
    return t.raw("orders").select("o_orderkey", geo.valid_tile(
        F.col("o_orderkey") % 25, F.col("o_custkey"), F.col("o_orderkey") % 9000).cast("long").alias("valid"))


@register("b12_validate_profiles", """
SELECT c_custkey AS profile_id, CASE WHEN c_acctbal<0 OR c_acctbal/3000>3 THEN 'weights' WHEN c_nationkey=3 THEN 'mode'
  WHEN c_nationkey>20 THEN 'max_grade_pct' WHEN c_nationkey=0 THEN 'conservatism' END AS problem FROM customer
WHERE c_acctbal<0 OR c_acctbal/3000>3 OR c_nationkey IN (0,3) OR c_nationkey>20""")
def b12(t: Tables):
    profiles = t.raw("customer").select(
        F.col("c_custkey").alias("profile_id"), F.create_map(F.lit("pm25"), F.col("c_acctbal") / 3000).alias("weights"),
        F.expr("CASE WHEN c_nationkey<>3 THEN 'foot' END").alias("mode"), F.array().cast("array<string>").alias("hard_avoids"),
        F.col("c_nationkey").cast("double").alias("max_grade_pct"), F.lit(0.25).alias("detour_tolerance"),
        (F.col("c_nationkey") / 20).alias("conservatism"), F.col("c_name").alias("label"))
    profiles = profiles.withColumn("conservatism", F.least(F.col("conservatism"), F.lit(2.0)))
    return quality.validate_profiles(profiles)[1].select("profile_id", "problem")
