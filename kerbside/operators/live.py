"""The live layer: citywide means, conditions, gates and hazard fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.numbers import clamp, finite, half_up
from kerbside.functions.rules import aqi_category, pollen_category
from kerbside.functions.text import area_name
from kerbside.operators.exposure import active_permits
from kerbside.operators.ranking import exact_quantiles, latest_per
from kerbside.operators.spatial import cell, in_areas
from kerbside.vocab import (CONSTRUCTION_RADIUS_M, FIELD_LOOKBACK_HOURS, HAZARDS, MAX_HAZARD_FIELDS,
                            POLLEN_ACTIVE_UPI, POLLEN_HAZARDS, RASTER_HAZARDS, READING_LOOKBACK_HOURS,
                            SCALAR_RANGE, SHADE_HEAT_C, TREE_POLLEN_MONTHS)

STATION = ("hazard", "station_id")


def latest_readings(readings: DataFrame, as_of: Column, hours: float = READING_LOOKBACK_HOURS) -> DataFrame:
    return latest_per(readings, STATION, "observed_at", as_of, hours)


def citywide_means(readings: DataFrame, as_of: Column) -> DataFrame:
    """Mean of each station's newest value per hazard; the index feed does not take part."""
    latest = latest_readings(readings.where(F.col("source") != "airnow"), as_of)
    return latest.groupBy("hazard").agg(F.avg("value").alias("value"),
                                        F.max("observed_at").alias("observed_at"))


def hazard_conditions(readings: DataFrame, as_of: Column) -> DataFrame:
    """Current value per hazard over all feeds, with the contributing sources.

    The unit is that of the smallest station id, so that it does not depend on row order.
    """
    latest = latest_readings(readings, as_of)
    return (latest.groupBy("hazard")
            .agg(F.avg("value").alias("mean_value"),
                 F.min_by("unit", "station_id").alias("unit"),
                 F.count(F.lit(1)).alias("station_count"),
                 F.max("observed_at").alias("latest_observed_at"),
                 F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"))
            .orderBy("hazard"))


def air_quality(conditions: DataFrame) -> DataFrame:
    aqi = half_up(F.col("mean_value")).cast("long")
    pollutant = F.regexp_replace("hazard", "_aqi", "")
    return (conditions.where(F.col("hazard").endswith("_aqi"))
            .select(pollutant.alias("pollutant"), aqi.alias("aqi"), aqi_category(aqi).alias("category"),
                    F.col("latest_observed_at").alias("observed_at"))
            .orderBy(F.desc("aqi"), "pollutant"))


def pollen_weather(conditions: DataFrame) -> DataFrame:
    """One row with the pollen indices and the weather."""
    wanted = {"tree_upi": "pollen_tree", "grass_upi": "pollen_grass", "weed_upi": "pollen_weed",
              "temperature_c": "heat", "humidity_pct": "humidity", "wind_speed_mph": "wind_speed",
              "wind_bearing_deg": "wind_bearing"}
    return conditions.agg(*[F.max(F.when(F.col("hazard") == h, F.col("mean_value"))).alias(n)
                            for n, h in wanted.items()])


def circular_mean_deg(value: Column) -> Column:
    """Mean of headings on the circle: the alternative to the plain mean used for wind bearing."""
    turned = F.degrees(F.atan2(F.avg(F.sin(F.radians(value))), F.avg(F.cos(F.radians(value)))))
    return F.pmod(turned, F.lit(360.0))


def active_alerts(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Alerts without an end or not yet over; newest onset first, an unknown onset before all."""
    return (alerts.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
            .orderBy(F.desc_nulls_first("onset"), "event"))


def summarize(conditions: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row with the summary sentence of the current conditions."""
    is_aqi = F.col("hazard").endswith("_aqi")
    aqi = half_up(F.col("mean_value")).cast("long")
    name = F.upper(F.regexp_replace("hazard", "_aqi", ""))
    # Highest index first; equal ones in hazard order.
    top_aqi = F.min(F.when(is_aqi, F.struct((-aqi).alias("k"), F.col("hazard").alias("h"),
                                            name.alias("name"), aqi.alias("aqi"))))
    order = F.array_position(F.array(*[F.lit(h) for h in POLLEN_HAZARDS]), F.col("hazard"))
    top_pollen = F.min(F.when(F.col("hazard").isin(*POLLEN_HAZARDS),
                              F.struct((-F.col("mean_value")).alias("k"), order.alias("o"),
                                       F.col("hazard").alias("h"), F.col("mean_value").alias("v"))))
    event = (alerts.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
             .agg(F.min_by("event", F.struct(F.col("onset").isNotNull(),
                                             -F.unix_micros("onset"), F.col("event")))).scalar())
    row = conditions.agg(top_aqi.alias("a"), top_pollen.alias("p"), F.count(F.lit(1)).alias("n"))
    kind = F.initcap(F.regexp_replace(F.col("p.h"), "pollen_", ""))
    air = F.when(F.col("a").isNotNull(), F.format_string(
        "Air quality is %s (%s AQI %d).", F.lower(aqi_category(F.col("a.aqi"))), F.col("a.name"), F.col("a.aqi")))
    pollen = F.when(F.col("p.v") >= POLLEN_ACTIVE_UPI, F.format_string(
        "%s pollen is %s.", kind, F.lower(pollen_category(F.col("p.v")))))
    warned = row.withColumn("event", event)
    alert = F.when(F.col("event").isNotNull(),
                   F.format_string("An active NWS %s is in effect.", F.col("event")))
    text = F.concat_ws(" ", air, pollen, alert)
    return warned.select(
        F.when(text != "", text)
        .when(F.col("n") == 0, F.lit("No live environmental readings are available yet."))
        .otherwise(F.lit("Current environmental conditions are available with no elevated citywide signal."))
        .alias("summary"))


def seasonal_gates(conditions: DataFrame, as_of: Column) -> DataFrame:
    """One row of switches: is shade, tree pollen season and each pollen kind in play?"""
    def value(hazard: str) -> Column:
        return F.max(F.when(F.col("hazard") == hazard, F.col("mean_value")))

    return conditions.agg(
        F.coalesce(value("heat") > SHADE_HEAT_C, F.lit(False)).alias("shade_active"),
        F.month(F.max(as_of)).alias("month"),
        *[F.coalesce(value(h) >= POLLEN_ACTIVE_UPI, F.lit(False)).alias(f"{h}_active")
          for h in POLLEN_HAZARDS]) \
        .select("shade_active",
                F.coalesce(F.col("month"), F.month(as_of)).between(*TREE_POLLEN_MONTHS)
                .alias("tree_season"), *[f"{h}_active" for h in POLLEN_HAZARDS])


# --- hazard fields ---------------------------------------------------------------------------------
def band_cells(cells: DataFrame, means: DataFrame) -> DataFrame:
    """Scaled value and severity 1..4 of every grid cell whose hazard has a live mean.

    The grid is scaled by the ratio of live to long-term mean; severity counts the long-term quartiles
    at or below the scaled value. Only the raster hazards take part, so the per-hazard table is at
    most three rows and is broadcast.
    """
    valid = cells.where(F.col("hazard").isin(*RASTER_HAZARDS) & finite(F.col("value")))
    prior = valid.groupBy("hazard").agg(F.avg("value").alias("prior_mean"))
    quartiles = (exact_quantiles(valid, "value", (0.25, 0.5, 0.75), ["hazard"])
                 .groupBy("hazard")
                 .agg(*[F.max(F.when(F.col("fraction") == f, F.col("quantile"))).alias(n)
                        for n, f in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]))
    live = (means.where(F.col("hazard").isin(*RASTER_HAZARDS))
            .select("hazard", F.col("value").alias("live_mean"), "observed_at"))
    table = (prior.where(F.col("prior_mean") > 0).join(quartiles, "hazard").join(live, "hazard")
             .withColumn("scalar", clamp(F.col("live_mean") / F.col("prior_mean"), *SCALAR_RANGE)))
    scaled = valid.join(F.broadcast(table), "hazard").withColumn("scaled", F.col("value") * F.col("scalar"))
    severity = F.lit(1)
    for q in ("q1", "q2", "q3"):
        severity = severity + (F.col(q) <= F.col("scaled")).cast("int")
    return scaled.withColumn("severity", severity).drop(
        "prior_mean", "q1", "q2", "q3", "live_mean", "scalar")


def hazard_bands(cells: DataFrame, means: DataFrame) -> DataFrame:
    """One row per raster hazard and severity with the range of scaled values."""
    return (band_cells(cells, means).groupBy("hazard", "severity")
            .agg(F.max("observed_at").alias("observed_at"), F.min("scaled").alias("band_min"),
                 F.max("scaled").alias("band_max"), F.count(F.lit(1)).alias("cell_count")))


def construction_circles(permits: DataFrame, as_of: Column, radius: float = CONSTRUCTION_RADIUS_M) -> DataFrame:
    """The construction area of each severity as the circles that make it up."""
    return (active_permits(permits, as_of).select("severity", "x", "y").distinct()
            .withColumn("radius_m", F.lit(float(radius))))


def construction_bands(permits: DataFrame, as_of: Column, radius: float = CONSTRUCTION_RADIUS_M) -> DataFrame:
    circles = construction_circles(permits, as_of, radius)
    return (circles.groupBy("severity").agg(F.count(F.lit(1)).alias("cell_count"))
            .select(F.lit("construction").alias("hazard"), "severity", as_of.alias("observed_at"),
                    ((F.col("severity") - 1) * 25.0).alias("band_min"),
                    (F.col("severity") * 25.0).alias("band_max"), "cell_count"))


def circle_cells(circles: DataFrame, size: float) -> DataFrame:
    """Grid cells each severity's circles touch, once per cell."""
    low_x, high_x = cell(F.col("x") - F.col("radius_m"), size), cell(F.col("x") + F.col("radius_m"), size)
    low_y, high_y = cell(F.col("y") - F.col("radius_m"), size), cell(F.col("y") + F.col("radius_m"), size)
    spread = (circles.withColumn("cx", F.explode(F.sequence(low_x, high_x)))
              .withColumn("cy", F.explode(F.sequence(low_y, high_y))))
    side = F.lit(float(size))
    near_x = F.greatest(F.col("cx") * side - F.col("x"), F.col("x") - (F.col("cx") + 1) * side, F.lit(0.0))
    near_y = F.greatest(F.col("cy") * side - F.col("y"), F.col("y") - (F.col("cy") + 1) * side, F.lit(0.0))
    return (spread.where(near_x * near_x + near_y * near_y <= F.col("radius_m") * F.col("radius_m"))
            .select("severity", "cx", "cy").distinct())


def field_cells(cells: DataFrame, means: DataFrame, permits: DataFrame, bands: DataFrame, as_of: Column, size: float) -> DataFrame:
    """The grid cells (hazard, severity, observed_at, cx, cy) that make up the areas of ``bands``.

    ``cells`` carries the routing grid's cx and cy of each raster cell; construction areas are the cells of ``size``
    that their circles touch. ``bands`` are the budgeted ones, at most MAX_HAZARD_FIELDS rows, and are broadcast.
    """
    raster = band_cells(cells, means).select("hazard", "severity", "observed_at", "cx", "cy")
    built = circle_cells(construction_circles(permits, as_of), size).select(
        F.lit("construction").alias("hazard"), "severity", as_of.alias("observed_at"), "cx", "cy")
    kept = F.broadcast(bands.select("hazard", "severity").distinct())
    return raster.unionByName(built).join(kept, ["hazard", "severity"], "left_semi")


def union_bands(raster: DataFrame, construction: DataFrame) -> DataFrame:
    return raster.unionByName(construction)


def budget_fields(bands: DataFrame, n: int = MAX_HAZARD_FIELDS) -> DataFrame:
    """The ``n`` most severe bands; ties by hazard name, then by the higher range."""
    return bands.orderBy(F.desc("severity"), "hazard", F.desc("band_max")).limit(n)


def newest_snapshots(fields: DataFrame, as_of: Column, hours: float = FIELD_LOOKBACK_HOURS) -> DataFrame:
    """Rows (bands or their cells) of each hazard's newest snapshot, unless that is older than the lookback."""
    recent = fields.where((F.col("observed_at") >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))
                          & F.col("hazard").isin(*HAZARDS))
    newest = recent.groupBy("hazard").agg(F.max("observed_at").alias("observed_at"))
    return recent.join(F.broadcast(newest), ["hazard", "observed_at"])  # at most one row per hazard


def current_fields(fields: DataFrame, as_of: Column, hours: float = FIELD_LOOKBACK_HOURS) -> DataFrame:
    """Current bands with the names of their areas."""
    return (newest_snapshots(fields, as_of, hours).withColumn("area_id", area_name(F.col("hazard"), F.col("severity")))
            .orderBy("hazard", "severity"))


def lattice(boundary: DataFrame, spacing_m: float) -> DataFrame:
    """Regular points inside a boundary, half a step in from its box; i and j number columns and rows.

    ``boundary`` holds one area per row with ``rings``; points inside several are listed once.
    """

    flat = F.flatten(F.col("rings"))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    box = boundary.agg(F.min(F.array_min(xs)).alias("x0"), F.max(F.array_max(xs)).alias("x1"),
                       F.min(F.array_min(ys)).alias("y0"), F.max(F.array_max(ys)).alias("y1"))
    step = F.lit(float(spacing_m))
    last = lambda a, b: F.floor((F.col(b) - F.col(a)) / step - 0.5)
    columns = box.where(last("x0", "x1") >= 0).where(last("y0", "y1") >= 0).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), last("x0", "x1"))))
    points = columns.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last("y0", "y1")))).select(
        "i", "j", (F.col("x0") + (F.col("i") + 0.5) * step).alias("x"),
        (F.col("y0") + (F.col("j") + 0.5) * step).alias("y"))
    named = boundary.select("rings").withColumn("area_id", F.xxhash64("rings"))
    spaced = points.withColumn("point_id", F.struct("i", "j"))
    inside = in_areas(spaced, named, "point_id", size=max(spacing_m * 4, 1.0))
    return inside.select("i", "j", "x", "y").distinct()
