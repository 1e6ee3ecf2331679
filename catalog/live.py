"""Live clock: citywide means, conditions, gates, hazard fields, quotas and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import AS_OF, PERMIT_DAY, Tables, micros, q4, r4, register, ts
from kerbside.operators import live, ranking, usage
from kerbside.operators.routes import within_quota

LATEST = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hazard, station_id
  ORDER BY observed_at DESC) AS rn FROM fx_reading WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) WHERE rn=1)"""
LATEST_SENSOR = LATEST.replace("FROM fx_reading WHERE", "FROM fx_reading WHERE source<>'airnow' AND")
AQI_READINGS = "SELECT hazard || CASE WHEN hazard IN ('pm25','ozone','no2') THEN '_aqi' ELSE '' END AS hazard, station_id, observed_at, source, CASE WHEN hazard='pollen_tree' THEN value/40 ELSE value END AS value, unit FROM fx_reading"


def aqi_readings(t: Tables):
    return (t.reading()
            .withColumn("value", F.when(F.col("hazard") == "pollen_tree", F.col("value") / 40).otherwise(F.col("value")))
            .withColumn("hazard", F.when(F.col("hazard").isin("pm25", "ozone", "no2"), F.concat("hazard", F.lit("_aqi")))
                        .otherwise(F.col("hazard"))))


CONDITIONS = f"""r2 AS ({AQI_READINGS}), {LATEST.replace('fx_reading', 'r2')},
cond AS (SELECT hazard, avg(value) AS mean_value, arg_min(unit, station_id) AS unit, count(*) AS station_count,
  max(observed_at) AS seen_at, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM latest GROUP BY hazard)"""


@register("e1_latest_per_station", f"WITH {LATEST} SELECT hazard, station_id, epoch_us(observed_at) AS observed_us, source, value, unit FROM latest",
          ("fx_reading",))
def e1(t: Tables):
    return live.latest_readings(t.reading(), ts(AS_OF)).select(
        "hazard", "station_id", micros("observed_at").alias("observed_us"), "source", "value", "unit")


@register("d1_citywide_means", f"WITH {LATEST_SENSOR} SELECT hazard, {q4('avg(value)')} AS value, epoch_us(max(observed_at)) AS observed_us FROM latest GROUP BY hazard",
          ("fx_reading",))
def d1(t: Tables):
    return live.citywide_means(t.reading(), ts(AS_OF)).select("hazard", r4("value").alias("value"), micros("observed_at").alias("observed_us"))


@register("d2_hazard_conditions", f"WITH {CONDITIONS} SELECT hazard, {q4('mean_value')} AS mean_value, unit, station_count, epoch_us(seen_at) AS latest_us, source FROM cond",
          ("fx_reading",))
def d2(t: Tables):
    return live.hazard_conditions(aqi_readings(t), ts(AS_OF)).select(
        "hazard", r4("mean_value").alias("mean_value"), "unit", "station_count", micros("latest_observed_at").alias("latest_us"), "source")


@register("d3_air_quality", f"""WITH {CONDITIONS} SELECT pollutant, aqi, CASE WHEN aqi<=50 THEN 'Good' WHEN aqi<=100 THEN 'Moderate'
  WHEN aqi<=150 THEN 'Unhealthy for sensitive groups' WHEN aqi<=200 THEN 'Unhealthy' WHEN aqi<=300 THEN 'Very unhealthy' ELSE 'Hazardous' END AS category
FROM (SELECT replace(hazard,'_aqi','') AS pollutant, cast(floor(mean_value+0.5) as bigint) AS aqi FROM cond WHERE hazard LIKE '%\\_aqi' ESCAPE '\\')""",
          ("fx_reading",))
def d3(t: Tables):
    return live.air_quality(live.hazard_conditions(aqi_readings(t), ts(AS_OF))).select("pollutant", "aqi", "category")


@register("d4_pollen_weather", f"""WITH {CONDITIONS} SELECT {q4("max(CASE WHEN hazard='pollen_tree' THEN mean_value END)")} AS tree_upi,
  {q4("max(CASE WHEN hazard='heat' THEN mean_value END)")} AS temperature_c, max(CASE WHEN hazard='humidity' THEN mean_value END) AS humidity_pct FROM cond""",
          ("fx_reading",))
def d4(t: Tables):
    return live.pollen_weather(live.hazard_conditions(aqi_readings(t), ts(AS_OF))).select(
        r4("tree_upi").alias("tree_upi"), r4("temperature_c").alias("temperature_c"), "humidity_pct")


ALERTS = "SELECT event_id AS id, 'Notice ' || (user_id%7) AS event, ts AS onset0, CASE WHEN event_id%3=0 THEN NULL ELSE ts END AS onset, CASE WHEN event_id%5=0 THEN NULL ELSE ts + INTERVAL 48 HOUR END AS expires_at FROM events WHERE event_type='error'"


def alerts(t: Tables):
    return t.raw("events").where("event_type='error'").selectExpr(
        "event_id AS id", "concat('Notice ', user_id%7) AS event",
        "CASE WHEN event_id%3=0 THEN NULL ELSE cast(ts as timestamp) END AS onset",
        "CASE WHEN event_id%5=0 THEN NULL ELSE cast(ts as timestamp) + INTERVAL 48 HOURS END AS expires_at")


@register("d5_summary", f"""WITH {CONDITIONS}, al AS ({ALERTS}),
a AS (SELECT upper(replace(hazard,'_aqi','')) AS name, cast(floor(mean_value+0.5) as bigint) AS aqi FROM cond
  WHERE hazard LIKE '%\\_aqi' ESCAPE '\\' ORDER BY aqi DESC, hazard LIMIT 1),
p AS (SELECT mean_value AS v FROM cond WHERE hazard='pollen_tree'),
e AS (SELECT event FROM al WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}' ORDER BY onset DESC NULLS FIRST, event LIMIT 1)
SELECT 'Air quality is ' || CASE WHEN aqi<=50 THEN 'good' WHEN aqi<=100 THEN 'moderate' WHEN aqi<=150 THEN 'unhealthy for sensitive groups' ELSE 'unhealthy' END
  || ' (' || name || ' AQI ' || aqi || ').' || CASE WHEN v>=2 THEN ' Tree pollen is ' || (['none','very low','low','moderate','high','very high'])[cast(least(5,floor(v+0.5)) as int)+1] || '.' ELSE '' END
  || ' An active NWS ' || event || ' is in effect.' AS summary FROM a, p, e""", ("fx_reading",))
def d5(t: Tables):
    return live.summarize(live.hazard_conditions(aqi_readings(t), ts(AS_OF)), alerts(t), ts(AS_OF))


@register("b6_active_alerts", f"SELECT id, event, epoch_us(onset) AS onset_us FROM ({ALERTS}) WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}'")
def b6_alerts(t: Tables):
    return live.active_alerts(alerts(t), ts(AS_OF)).select("id", "event", micros("onset").alias("onset_us"))


@register("b6_active_permits", f"SELECT permit_id, cast(severity as bigint) AS severity FROM fx_permit WHERE expires_at >= DATE '{PERMIT_DAY}'", ("fx_permit",))
def b6_permits(t: Tables):
    return live.active_permits(t.permit(), ts(PERMIT_DAY)).select("permit_id", F.col("severity").cast("long").alias("severity"))


@register("b10_seasonal_gates", f"""WITH {CONDITIONS} SELECT cast(coalesce(max(CASE WHEN hazard='heat' THEN mean_value END)>27,false) as bigint) AS shade_active,
  0::bigint AS tree_season, cast(coalesce(max(CASE WHEN hazard='pollen_tree' THEN mean_value END)>=2,false) as bigint) AS pollen_tree_active,
  0::bigint AS pollen_grass_active FROM cond""", ("fx_reading",))
def b10(t: Tables):
    gates = live.seasonal_gates(live.hazard_conditions(aqi_readings(t), ts(AS_OF)), ts(AS_OF))
    return gates.select(*[F.col(c).cast("long").alias(c) for c in ("shade_active", "tree_season", "pollen_tree_active", "pollen_grass_active")])


BANDS = f"""{LATEST_SENSOR}, mean AS (SELECT hazard, avg(value) AS v, max(observed_at) AS seen_at FROM latest GROUP BY hazard),
grid AS (SELECT 'pm25' AS hazard, pm25 AS value FROM fx_cell UNION ALL SELECT 'no2', no2 FROM fx_cell WHERE no2<>-9999 UNION ALL SELECT 'ozone', ozone FROM fx_cell),
stat AS (SELECT hazard, avg(value) AS m, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.5) AS q2, quantile_cont(value,0.75) AS q3 FROM grid GROUP BY hazard),
scaled AS (SELECT g.hazard, mean.seen_at, g.value*greatest(least(v/m,10),0.1) AS s, q1, q2, q3 FROM grid g JOIN stat USING (hazard) JOIN mean USING (hazard) WHERE m>0),
raster_band AS (SELECT hazard, cast(1+(q1<=s)::int+(q2<=s)::int+(q3<=s)::int as bigint) AS severity, max(seen_at) AS seen_at, min(s) AS band_min, max(s) AS band_max, count(*) AS cell_count FROM scaled GROUP BY 1,2),
con_band AS (SELECT 'construction' AS hazard, cast(severity as bigint) AS severity, TIMESTAMP '{AS_OF}' AS seen_at, (severity-1)*25.0::double AS band_min, severity*25.0::double AS band_max, count(DISTINCT (x,y)) AS cell_count
  FROM fx_permit WHERE expires_at >= DATE '{PERMIT_DAY}' GROUP BY severity)"""


def raster_bands(t: Tables):
    cells = t.cells().where("value <> -9999")
    return live.hazard_bands(cells, live.citywide_means(t.reading(), ts(AS_OF)))


def construction_bands(t: Tables):
    return live.construction_bands(t.permit(), ts(PERMIT_DAY)).withColumn("observed_at", ts(AS_OF))


def out(df):
    return df.select("hazard", F.col("severity").cast("long").alias("severity"), micros("observed_at").alias("observed_us"),
                     r4("band_min").alias("band_min"), r4("band_max").alias("band_max"), "cell_count")


OUT = f"hazard, severity, epoch_us(seen_at) AS observed_us, {q4('band_min')} AS band_min, {q4('band_max')} AS band_max, cell_count"


@register("d16_hazard_bands", f"WITH {BANDS} SELECT {OUT} FROM raster_band", ("fx_reading", "fx_cell", "fx_permit"))
def d16(t: Tables):
    return out(raster_bands(t))


@register("d17_construction_bands", f"WITH {BANDS} SELECT {OUT} FROM con_band", ("fx_reading", "fx_cell", "fx_permit"))
def d17(t: Tables):
    return out(construction_bands(t))


@register("d17_construction_cells", f"""
WITH c AS (SELECT DISTINCT severity, x, y FROM fx_permit WHERE expires_at >= DATE '{PERMIT_DAY}')
SELECT DISTINCT cast(severity as bigint) AS severity, cast(cx as bigint) AS cx, cast(cy as bigint) AS cy
FROM c, generate_series(cast(floor((x-40)/100) as bigint), cast(floor((x+40)/100) as bigint)) a(cx),
  generate_series(cast(floor((y-40)/100) as bigint), cast(floor((y+40)/100) as bigint)) b(cy)
WHERE power(greatest(cx*100-x, x-(cx+1)*100, 0),2)+power(greatest(cy*100-y, y-(cy+1)*100, 0),2) <= 1600""", ("fx_permit",))
def d17_cells(t: Tables):
    circles = live.construction_circles(t.permit(), ts(PERMIT_DAY))
    return live.circle_cells(circles, 100.0).select(F.col("severity").cast("long").alias("severity"), "cx", "cy")


@register("f1_g3_budgeted_fields", f"WITH {BANDS} SELECT {OUT} FROM (SELECT * FROM raster_band UNION ALL SELECT * FROM con_band ORDER BY severity DESC, hazard, band_max DESC LIMIT 7)",
          ("fx_reading", "fx_cell", "fx_permit"))
def f1(t: Tables):
    return out(live.budget_fields(live.union_bands(raster_bands(t), construction_bands(t)), 7))


FIELDS = "SELECT CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'ozone' WHEN 'purchase' THEN 'no2' ELSE 'construction' END AS hazard, date_trunc('hour', ts) AS seen_at, cast(user_id%4+1 as bigint) AS severity, max(value) AS band_max FROM events GROUP BY 1,2,3"


@register("c9_current_fields", f"""WITH f AS ({FIELDS}), m AS (SELECT hazard, max(seen_at) AS seen_at FROM f WHERE seen_at >= TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 2 HOUR GROUP BY 1)
SELECT hazard || '_' || (['low','moderate','high','severe'])[severity] AS area_id, epoch_us(seen_at) AS observed_us, band_max FROM f JOIN m USING (hazard, seen_at)""")
def c9(t: Tables):
    hazard = F.expr("CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'ozone' WHEN 'purchase' THEN 'no2' ELSE 'construction' END")
    fields = (t.raw("events").groupBy(hazard.alias("hazard"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("observed_at"),
                                      (F.col("user_id") % 4 + 1).cast("int").alias("severity")).agg(F.max("value").alias("band_max")))
    return live.current_fields(fields, ts("2024-01-30 23:30:00")).select("area_id", micros("observed_at").alias("observed_us"), "band_max")


@register("f6_even_sample", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id)-1 AS k FROM events)
WHERE k IN (SELECT cast(round_even(i*((SELECT count(*) FROM events)-1)/59.0, 0) as bigint) FROM generate_series(0,59) g(i))""")
def f6(t: Tables):
    return ranking.even_sample(t.raw("events").select("event_id"), "event_id", 60)


@register("f7_within_quota", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY cast(ts - INTERVAL 5 HOUR as date) ORDER BY ts, event_id) AS rn FROM events) WHERE rn<=15""")
def f7(t: Tables):
    calls = t.raw("events").selectExpr("event_id AS call_id", "cast(ts as timestamp) AS called_at")
    return within_quota(calls, 15).select(F.col("call_id").alias("event_id"))


@register("g2_union_readings", """SELECT hazard, count(*) AS n FROM (SELECT hazard FROM fx_reading UNION ALL SELECT 'wind_speed' FROM events WHERE event_type='view') GROUP BY hazard""", ("fx_reading",))
def g2(t: Tables):
    from kerbside.sinks import union_readings

    wind = t.reading().where("hazard='pm25'").withColumn("hazard", F.lit("wind_speed"))
    return union_readings(t.reading(), wind).groupBy("hazard").agg(F.count(F.lit(1)).alias("n"))


@register("d20_latency_percentiles", f"""SELECT event_type, cast(f as double) AS fraction, {q4('v[greatest(cast(ceil(f*len(v)) as bigint)-1,0)+1]')} AS quantile
FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1), (VALUES (0.5),(0.95)) p(f)""")
def d20(t: Tables):
    return usage.latency_percentiles(t.raw("events"), "value", group=["event_type"]).select(
        "event_type", "fraction", r4("quantile").alias("quantile"))


@register("d21_usage_metrics", f"""SELECT cast(user_id%10 as bigint) AS shard, count(*) FILTER (WHERE event_type='view') AS speech_requests,
  {q4("count(*) FILTER (WHERE event_type='view' AND event_id%3=0)*1.0/nullif(count(*) FILTER (WHERE event_type='view'),0)")} AS cache_hit_rate,
  cast(sum(CASE WHEN event_type='click' THEN user_id%20 ELSE 0 END) as bigint) AS images_scored, count(*) FILTER (WHERE event_type='error') AS analyses_requested FROM events GROUP BY 1""")
def d21(t: Tables):
    events = t.raw("events").selectExpr(
        "user_id%10 AS shard", "CASE event_type WHEN 'view' THEN 'speech' WHEN 'click' THEN 'scored' WHEN 'error' THEN 'analysis' ELSE '' END AS kind",
        "event_id%3=0 AS cached", "user_id%20 AS amount")
    return usage.usage_metrics(events, ["shard"]).withColumn("cache_hit_rate", r4("cache_hit_rate"))
