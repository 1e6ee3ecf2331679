"""Streaming jobs, run over the event files until all input is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, micros, q4, r4, register
from kerbside import sinks
from kerbside.session import ensure_checkpoint_dir, scratch_path
from kerbside.streaming import jobs

ONCE = {"availableNow": True}


def events(t: Tables):
    schema = t.raw("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


def reading_stream(t: Tables):
    return events(t).selectExpr(
        "CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'ozone' WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'pollen_tree' ELSE 'heat' END AS hazard",
        "concat('st-', cast(user_id%20 as string)) AS station_id", "cast(ts as timestamp) AS observed_at",
        "CASE WHEN event_id%4=0 THEN 'airnow' ELSE 'openaq' END AS source", "value", "CASE WHEN event_type='view' THEN 'ug/m3' ELSE 'ppb' END AS unit")


def finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def drained(t: Tables, stream, label: str):
    """Run a stream to the end of its input into files and read the result."""
    ensure_checkpoint_dir(t.spark)
    base = scratch_path(t.spark, label)
    finish(stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
           .option("checkpointLocation", f"{base}/chk").trigger(**ONCE).start())
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


LATEST = """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hazard, station_id ORDER BY observed_at DESC) AS rn
  FROM fx_reading WHERE source<>'airnow' AND observed_at >= (SELECT max(observed_at) FROM fx_reading) - INTERVAL 24 HOUR) WHERE rn=1),
mean AS (SELECT hazard, avg(value) AS v, max(observed_at) AS seen_at FROM latest GROUP BY 1)"""


@register("i1_stream_readings", "SELECT hazard, station_id, epoch_us(observed_at) AS observed_us, source, value FROM fx_reading", ("fx_reading",))
def i1(t: Tables):
    base = scratch_path(t.spark, "readings")
    finish(jobs.stream_readings(reading_stream(t), f"{base}/t", f"{base}/chk", ONCE))
    out = sinks.read_partitions(t.spark, f"{base}/t")
    return out.select("hazard", "station_id", micros("observed_at").alias("observed_us"), "source", "value")


@register("i2_stream_citywide_means", LATEST + f" SELECT hazard, {q4('v')} AS value FROM mean", ("fx_reading",))
def i2(t: Tables):
    base = scratch_path(t.spark, "means")
    finish(jobs.stream_citywide_means(reading_stream(t), f"{base}/t", f"{base}/out", f"{base}/chk", ONCE))
    return sinks.read_table(t.spark, f"{base}/out").select("hazard", r4("value").alias("value"))


@register("i3_stream_hazard_fields", LATEST + f""", grid AS (SELECT 'pm25' AS hazard, pm25 AS value FROM fx_cell UNION ALL SELECT 'no2', no2 FROM fx_cell WHERE no2<>-9999 UNION ALL SELECT 'ozone', ozone FROM fx_cell),
stat AS (SELECT hazard, avg(value) AS m, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.5) AS q2, quantile_cont(value,0.75) AS q3 FROM grid GROUP BY hazard),
scaled AS (SELECT g.hazard, g.value*greatest(least(v/m,10),0.1) AS s, q1, q2, q3 FROM grid g JOIN stat USING (hazard) JOIN mean USING (hazard))
SELECT hazard, cast(1+(q1<=s)::int+(q2<=s)::int+(q3<=s)::int as bigint) AS severity, {q4('min(s)')} AS band_min, {q4('max(s)')} AS band_max FROM scaled GROUP BY 1, 2""", ("fx_reading", "fx_cell"))
def i3(t: Tables):
    base = scratch_path(t.spark, "fields")
    # All permits have ended by the time of the readings, so only raster bands appear.
    cells = t.cells().where("value <> -9999")
    finish(jobs.stream_hazard_fields(reading_stream(t), cells, t.permit(), f"{base}/t", f"{base}/out", f"{base}/chk", ONCE))
    return t.spark.read.parquet(f"{base}/out").select("hazard", F.col("severity").cast("long").alias("severity"), r4("band_min").alias("band_min"), r4("band_max").alias("band_max"))


@register("i3_batch_over_streamed", LATEST + f""", grid AS (SELECT 'pm25' AS hazard, pm25 AS value FROM fx_cell UNION ALL SELECT 'no2', no2 FROM fx_cell WHERE no2<>-9999 UNION ALL SELECT 'ozone', ozone FROM fx_cell),
stat AS (SELECT hazard, avg(value) AS m, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.5) AS q2, quantile_cont(value,0.75) AS q3 FROM grid GROUP BY hazard),
scaled AS (SELECT g.hazard, g.value*greatest(least(v/m,10),0.1) AS s, q1, q2, q3 FROM grid g JOIN stat USING (hazard) JOIN mean USING (hazard))
SELECT hazard, cast(1+(q1<=s)::int+(q2<=s)::int+(q3<=s)::int as bigint) AS severity, {q4('min(s)')} AS band_min, {q4('max(s)')} AS band_max
FROM scaled JOIN mean USING (hazard) WHERE mean.seen_at >= (SELECT max(observed_at) FROM fx_reading) - INTERVAL 2 HOUR GROUP BY 1, 2""", ("fx_reading", "fx_cell"))
def i3_batch(t: Tables):
    """The scheduled batch job over a table that a stream filled."""
    from kerbside.plans import live as plan

    base = scratch_path(t.spark, "batch")
    finish(jobs.stream_readings(reading_stream(t), f"{base}/citywide_reading", f"{base}/chk", ONCE))
    now = sinks.read_partitions(t.spark, f"{base}/citywide_reading").select(F.max("observed_at")).scalar()
    out = plan.refresh_fields(t.spark, base, t.cells().where("value <> -9999"), t.permit(), now)
    return out.select("hazard", F.col("severity").cast("long").alias("severity"), r4("band_min").alias("band_min"), r4("band_max").alias("band_max"))


@register("i4_stream_conditions", """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hazard, station_id ORDER BY observed_at DESC) AS rn FROM fx_reading WHERE observed_at >= (SELECT max(observed_at) FROM fx_reading) - INTERVAL 24 HOUR) WHERE rn=1)
SELECT hazard, """ + q4("avg(value)") + " AS mean_value, count(*) AS station_count FROM latest GROUP BY 1", ("fx_reading",))
def i4(t: Tables):
    base = scratch_path(t.spark, "conditions")
    alerts = t.raw("events").where("event_type='error'").selectExpr("'Heat Advisory' AS event", "cast(ts as timestamp) AS onset", "cast(null as timestamp) AS expires_at")
    finish(jobs.stream_conditions(reading_stream(t), alerts, f"{base}/t", f"{base}/out", f"{base}/chk", ONCE))
    return sinks.read_table(t.spark, f"{base}/out/hazards").select("hazard", r4("mean_value").alias("mean_value"), "station_count")


@register("i5_stream_analysis", """SELECT user_id AS analysis_id, 'frame' AS event, count(*) AS n FROM (SELECT DISTINCT user_id, event_id%7 AS seq FROM events) GROUP BY 1 UNION ALL
SELECT user_id, 'complete', 1 FROM (SELECT user_id, count(DISTINCT event_id%7) AS k FROM events GROUP BY 1) WHERE k=7""")
def i5(t: Tables):
    scored = events(t).selectExpr("user_id AS analysis_id", "7 AS frame_count", "cast(event_id%7 as int) AS seq", "cast(ts as timestamp) AS scored_at")
    out = drained(t, jobs.stream_analysis(scored, 60 * 86_400_000), "analysis")
    return out.where("event IN ('frame', 'complete')").groupBy("analysis_id", "event").agg(F.count(F.lit(1)).alias("n"))


@register("i7_stream_metrics", """WITH w AS (SELECT date_trunc('day', ts) AS d, * FROM events), m AS (SELECT max(ts) - INTERVAL 5 MINUTE AS wm FROM events)
SELECT epoch_us(d) AS start_us, count(*) FILTER (WHERE event_type='view') AS speech_requests, cast(sum(CASE WHEN event_type='click' THEN user_id%20 ELSE 0 END) as bigint) AS images_scored,
  count(*) FILTER (WHERE event_type='error') AS analyses_requested FROM w, m WHERE d + INTERVAL 1 DAY <= wm GROUP BY 1""")
def i7(t: Tables):
    timed = events(t).selectExpr(
        "cast(ts as timestamp) AS happened_at", "value AS latency_ms", "CASE event_type WHEN 'view' THEN 'speech' WHEN 'click' THEN 'scored' WHEN 'error' THEN 'analysis' ELSE '' END AS kind",
        "event_id%3=0 AS cached", "user_id%20 AS amount")
    out = drained(t, jobs.stream_metrics(timed, "1 day"), "metrics")
    return out.select(micros("start").alias("start_us"), "speech_requests", "images_scored", "analyses_requested")


@register("i8_stream_work_queue", "SELECT user_id AS image_id, 1::bigint AS n FROM events WHERE event_id%3>0 GROUP BY 1")
def i8(t: Tables):
    frames = events(t).selectExpr("user_id AS image_id", "concat('req-', event_id) AS request_id", "event_id%3=0 AS scored", "cast(ts as timestamp) AS queued_at")
    out = drained(t, jobs.stream_work_queue(frames, "60 days"), "queue")
    return out.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
