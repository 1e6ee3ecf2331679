"""Sensitivity profiles and what they make of each street edge.

A profile travels with the edge rows it applies to (as a weights map and a few numbers), so every rule
is a column expression: pricing edges needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.numbers import clamp
from kerbside.operators.raster import SMALL_ROWS
from kerbside.operators.spatial import CELL, legs_in_cells
from kerbside.session import stored
from kerbside.vocab import (CANYON_SENSITIVITY, DEFAULT_CONSERVATISM, DEFAULT_DETOUR_TOLERANCE, DIRECT_SCORES,
                            EXPOSURE_BANDS, INVERSE_SCORES, LIVE_SEVERITY_STEP, MAX_WEIGHT, NO_DATA,
                            OPTIONAL_WAY_SCORES, POLLEN_HAZARDS, PRESETS, PRIORITY_FLOOR)


def preset_table(spark: SparkSession) -> DataFrame:
    """The six presets."""
    rows = [(name, weights, list(avoids), grade) for name, (weights, avoids, grade) in PRESETS.items()]
    return spark.createDataFrame(
        rows, "preset string, preset_weights map<string,double>, preset_avoids array<string>, preset_grade double")


def expand_profiles(requests: DataFrame) -> DataFrame:
    """Fill requests from their preset; explicit weights win key by key, explicit lists replace."""
    presets = F.broadcast(preset_table(requests.sparkSession))
    key = F.lower(F.trim(F.col("preset")))
    named = requests.withColumn("preset", F.when(F.coalesce(key, F.lit("")) == "", "none").otherwise(key))
    empty = F.create_map().cast("map<string,double>")
    own = F.coalesce("weights", empty)
    kept = F.map_filter("preset_weights", lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return named.join(presets, "preset").select(
        *[c for c in named.columns if c not in
          ("weights", "hard_avoids", "max_grade_pct", "detour_tolerance", "conservatism")],
        F.map_concat(kept, own).alias("weights"),
        F.coalesce("hard_avoids", "preset_avoids").alias("hard_avoids"),
        F.coalesce("max_grade_pct", "preset_grade").alias("max_grade_pct"),
        F.coalesce("detour_tolerance", F.lit(DEFAULT_DETOUR_TOLERANCE)).alias("detour_tolerance"),
        F.coalesce("conservatism", F.lit(DEFAULT_CONSERVATISM)).alias("conservatism"))


def weight_of(hazard: str, scale: Column, gates: dict[str, Column] | None = None) -> Column:
    """Effective weight of one hazard: scaled, and 0 where its season or condition is off.

    ``gates`` holds the columns of ``seasonal_gates``; without it every gate is open.
    """
    weight = F.coalesce(F.col("weights")[hazard], F.lit(0.0)) * scale
    positive = F.greatest(weight, F.lit(0.0))
    if gates is None:
        return positive
    if hazard == "shade_deficit":
        return F.when(gates["shade_active"], positive).otherwise(F.lit(0.0))
    if hazard == "pollen_tree":
        return F.when(gates["tree_season"] & gates["pollen_tree_active"], positive).otherwise(F.lit(0.0))
    if hazard in POLLEN_HAZARDS:
        return F.when(gates[f"{hazard}_active"], positive).otherwise(F.lit(0.0))
    return positive


def effective_weights(profiles: DataFrame, gates: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row per profile and hazard that still carries weight."""
    if scale < 0:
        raise ValueError("scale must not be negative")
    switches = _gate_columns(gates)
    long = profiles.select("profile_id", F.explode("weights").alias("hazard", "weight"))
    on = (F.when(F.col("hazard") == "shade_deficit", switches["shade_active"])
          .when(F.col("hazard") == "pollen_tree", switches["tree_season"] & switches["pollen_tree_active"])
          .when(F.col("hazard") == "pollen_grass", switches["pollen_grass_active"])
          .when(F.col("hazard") == "pollen_weed", switches["pollen_weed_active"])
          .otherwise(F.lit(True)))
    return (long.withColumn("weight", F.col("weight") * F.lit(float(scale)))
            .where(on & (F.col("weight") > 0)))


def _gate_columns(gates: DataFrame) -> dict[str, Column]:
    """The one-row switch table as scalar columns."""
    return {name: gates.select(name).scalar() for name in gates.columns}


def band_multiplier(score: str, sensitivity: Column, inverse: bool) -> Column:
    """Priority factor of one score: the first exposure band that applies, else 1."""
    value = F.col(score)
    chain = None
    for threshold, share in EXPOSURE_BANDS:
        applies = value < (100 - threshold) if inverse else value > threshold
        if score in OPTIONAL_WAY_SCORES:
            applies = applies & (value < NO_DATA)  # an unmeasured way matches no band
        factor = F.round(F.greatest(F.lit(PRIORITY_FLOOR), F.lit(1.0) / (F.lit(1.0) + sensitivity * F.lit(share))), 4)
        chain = F.when(applies, factor) if chain is None else chain.when(applies, factor)
    return F.when(sensitivity > 0, F.coalesce(chain, F.lit(1.0))).otherwise(F.lit(1.0))


def static_priority(scale: Column | None = None, gates: dict[str, Column] | None = None,
                    grade_bands: bool = True) -> Column:
    """Product of the static rules over the way scores in the row, for the profile in the row.

    The grade bands only bite above 25 while grades end at 20, so they never apply; they are kept for
    parity and can be switched off.
    """
    scale = F.lit(1.0) if scale is None else scale
    conservatism = F.col("conservatism")
    product = F.lit(1.0)
    for hazard, score in DIRECT_SCORES.items():
        if hazard == "grade" and not grade_bands:
            continue
        product = product * band_multiplier(score, weight_of(hazard, scale, gates) * conservatism, False)
    for hazard, score in INVERSE_SCORES.items():
        product = product * band_multiplier(score, weight_of(hazard, scale, gates) * conservatism, True)
    canyon = weight_of("pm25", scale, gates) * F.lit(CANYON_SENSITIVITY) * conservatism
    return product * band_multiplier("svf", canyon, True)


def edge_priority(edges: DataFrame, gates: DataFrame | None = None, scale: Column | None = None) -> DataFrame:
    """Edges (way scores plus profile columns) with their static ``priority``."""
    switches = None if gates is None else _gate_columns(gates)
    return edges.withColumn("priority", static_priority(scale, switches))


def pm25_variant(edges: DataFrame) -> DataFrame:
    """The plain low-PM2.5 variant: streets above 70 count for 0.4."""
    return edges.withColumn("priority", F.when(F.col("pm25") > 70, F.lit(0.4)).otherwise(F.lit(1.0)))


def area_multiplier(weight: Column, conservatism: Column, severity: Column) -> Column:
    normal = clamp(weight * conservatism / F.lit(MAX_WEIGHT), 0.0, 1.0)
    return F.round(F.greatest(F.lit(PRIORITY_FLOOR),
                              F.lit(1.0) - severity * F.lit(LIVE_SEVERITY_STEP) * normal), 4)


def edges_in_areas(legs: DataFrame, area_cells: DataFrame, size: float, edge_id: str = "edge_id") -> DataFrame:
    """(edge, hazard, severity) once per area the edge passes through.

    ``area_cells`` lists the grid cells of each area (hazard, severity, cx, cy). A cell's areas are put together first, so a leg
    meets one row per cell and repeats fold where an edge's cells meet. Few cells, by a count, are broadcast; legs never
    are, as the planner's estimate does not count their copies over cells.
    """
    pair = F.struct("hazard", "severity")
    areas = stored(area_cells.groupBy(*CELL).agg(F.collect_set(pair).alias("areas")), "area-cells")
    small = areas.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    through = legs_in_cells(legs, size).select(edge_id, *CELL)
    met = (through.join(F.broadcast(areas) if small else areas.hint("shuffle_hash"), list(CELL))
           .groupBy(edge_id).agg(F.collect_set("areas").alias("areas")))
    return (met.select(edge_id, F.explode(F.array_distinct(F.flatten("areas"))).alias("area"))
            .select(edge_id, "area.hazard", "area.severity"))


AREAS = "array<struct<hazard:string,severity:int>>"


def with_areas(edges: DataFrame, touched: DataFrame | None, edge_id: str = "edge_id") -> DataFrame:
    """Edges with ``areas``: the (hazard, severity) pairs they touch, sorted, null for none.

    ``touched`` comes from ``edges_in_areas``. At most one row per hazard and severity for an edge, so a
    small array carries them all.
    """
    if touched is None:
        return edges.withColumn("areas", F.lit(None).cast(AREAS))
    pair = F.struct(F.col("hazard"), F.col("severity").cast("int").alias("severity"))
    per_edge = touched.groupBy(edge_id).agg(F.array_sort(F.collect_set(pair)).alias("areas"))
    return edges.join(per_edge, edge_id, "left")


def area_priority(scale: Column, gates: dict[str, Column] | None = None) -> Column:
    """The product over the row's ``areas`` of what the row's profile makes of them; 0 where it refuses one.

    Areas of hazards without weight are left out, and an edge inside an active construction area is
    impassable for profiles that avoid those.
    """
    known = [*DIRECT_SCORES, *INVERSE_SCORES, "construction", "heat", "cold_air", "humidity",
             "pollen_grass", "pollen_weed"]
    effective = F.create_map(*[c for h in dict.fromkeys(known) for c in (F.lit(h), weight_of(h, scale, gates))])
    areas = F.coalesce("areas", F.array().cast(AREAS))
    product = F.aggregate(
        areas, F.lit(1.0),
        lambda p, a: p * F.when(F.coalesce(effective[a["hazard"]], F.lit(0.0)) > 0,
                                area_multiplier(effective[a["hazard"]], F.col("conservatism"), a["severity"])).otherwise(F.lit(1.0)))
    blocked = (F.array_contains("hard_avoids", "active_construction_frontage")
               & F.exists(areas, lambda a: a["hazard"] == "construction"))
    return F.when(blocked, F.lit(0.0)).otherwise(product)


def live_priority(edges: DataFrame, touched: DataFrame, edge_id: str = "edge_id",
                  scale: Column | None = None, gates: dict[str, Column] | None = None) -> DataFrame:
    """Edges with ``live_priority``: the product over touched areas the profile cares about."""
    scale = F.lit(1.0) if scale is None else scale
    return with_areas(edges, touched, edge_id).withColumn("live_priority", area_priority(scale, gates)).drop("areas")


def hard_avoid(edges: DataFrame) -> DataFrame:
    """Edges with ``blocked`` set where the profile refuses the street outright.

    Grades are compared as stored, in whole percent.
    """
    avoids = F.col("hard_avoids")
    grade = F.col("grade")
    blocked = ((grade > F.col("max_grade_pct"))
               | (F.array_contains(avoids, "grade_above_5_pct") & (grade > 5.0))
               | (F.array_contains(avoids, "grade_above_6_pct") & (grade > 6.0))
               | (F.array_contains(avoids, "industrial_within_200m") & (F.col("industrial_within_200m") > 0)))
    return edges.withColumn("blocked", blocked)


def enabled_areas(areas: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, area) for the areas of hazards a profile gives weight to."""
    wanted = profiles.select("profile_id", F.explode("weights").alias("hazard", "weight")).where("weight > 0")
    return wanted.join(areas, "hazard")
