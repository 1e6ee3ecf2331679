"""Static exposure per street segment: trees, industry, traffic and construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.geo import point_at
from kerbside.functions.numbers import distance_decay
from kerbside.operators.ranking import percent_rank_pct, percent_ranks_pct
from kerbside.operators.skew import HOT_MIN_ROWS, lookup_join
from kerbside.operators.spatial import (PLACE, cluster_points, legs_of, nearest_leg_by_class,
                                        points_near_legs, points_near_points)
from kerbside.session import stored
from kerbside.vocab import (ALLERGENIC_GENERA, CONSTRUCTION_RADIUS_M, FACILITY_MERGE_M, INDUSTRIAL_NEAR_M,
                            KERNEL_DECAY_M, KERNEL_RADIUS_M, TRAFFIC_CLASS_WEIGHTS, TREE_RADIUS_M)


def genus_table(spark: SparkSession) -> DataFrame:
    """The seven allergenic genera with their ratings and seasons."""
    return spark.createDataFrame(
        list(ALLERGENIC_GENERA),
        "genus string, common_group string, allergenicity_rating double, season_start int, season_end int")


def midpoints(segments: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    middle = point_at(F.col("pts"), F.lit(0.5))
    return (segments.select("segment_id", *extra, middle.alias("mid"))
            .select("segment_id", *extra, F.col("mid.x").alias("x"), F.col("mid.y").alias("y")))


def _per_line(segments: DataFrame, places: DataFrame, radius: float, merge: dict[str, Column],
              total: dict[str, Column], empty: dict[str, Column], carry: Sequence[str],
              min_rows: int) -> DataFrame:
    """Aggregate point places near each line, keeping lines without any.

    ``places`` holds one row per position. Its columns are first merged per (line, position), because
    a bent line meets a position once per leg, then totalled together with one neutral row per line:
    a union instead of an outer join, so a single shuffle on the line id finishes the job.
    """
    legs = legs_of(segments.select("segment_id", "pts"))
    pairs = points_near_legs(places, legs, radius, "place_id", size=max(radius, 128.0), min_rows=min_rows)
    met = pairs.groupBy("segment_id", "place_id").agg(*[c.alias(n) for n, c in merge.items()])
    rows = met.select("segment_id", *merge, *[F.lit(None).cast(segments.schema[c].dataType).alias(c)
                                              for c in carry])
    base = segments.select("segment_id", *[empty[n].alias(n) for n in merge], *carry)
    return (rows.unionByName(base).groupBy("segment_id")
            .agg(*[c.alias(n) for n, c in total.items()], *[F.max(c).alias(c) for c in carry]))


def tree_exposure(segments: DataFrame, trees: DataFrame, genera: DataFrame,
                  radius: float = TREE_RADIUS_M, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Trees and allergen weight within ``radius`` of each segment, and both per 100 m."""
    rated = trees.join(F.broadcast(genera.select("genus", "allergenicity_rating")), "genus", "left")
    # Several trees at one position (copies included) become one place.
    places = (rated.groupBy("x", "y")
              .agg(F.count("tree_id").alias("trees"),
                   F.coalesce(F.sum("allergenicity_rating"), F.lit(0.0)).alias("rating"))
              .withColumn("place_id", F.struct("x", "y")))
    per_line = _per_line(
        segments, places, radius,
        merge={"trees": F.max("trees"), "rating": F.max("rating")},
        total={"tree_count": F.sum("trees"), "allergen_weight": F.sum("rating")},
        empty={"trees": F.lit(0).cast("long"), "rating": F.lit(0.0)},
        carry=["length_m"], min_rows=min_rows)
    return per_line.select(
        "segment_id", "tree_count", "allergen_weight",
        (F.col("tree_count") * 100.0 / F.col("length_m")).alias("trees_per_100m"),
        (F.col("allergen_weight") * 100.0 / F.col("length_m")).alias("pollen_weight_per_100m"))


def active_permits(permits: DataFrame, as_of: Column) -> DataFrame:
    """Permits not yet expired on the day."""
    return permits.where(F.col("expires_at") >= F.to_date(as_of))


def construction_scores(segments: DataFrame, permits: DataFrame, as_of: Column,
                        radius: float = CONSTRUCTION_RADIUS_M, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Worst active permit along each segment's frontage, 25 points per severity step."""
    places = (active_permits(permits, as_of).groupBy("x", "y").agg(F.max("severity").alias("severity"))
              .withColumn("place_id", F.struct("x", "y")))
    per_line = _per_line(
        segments, places, radius,
        merge={"severity": F.max("severity")},
        total={"worst": F.max("severity")},
        empty={"severity": F.lit(0).cast("int")}, carry=[], min_rows=min_rows)
    return per_line.select("segment_id", (F.col("worst") * 25.0).alias("construction"),
                           F.to_date(as_of).alias("valid_for_date"))


def cluster_facilities(facilities: DataFrame, eps: float = FACILITY_MERGE_M) -> DataFrame:
    """Merge facilities chained within ``eps`` of each other; one row per cluster at its mean position."""
    named = cluster_points(facilities.select("facility_id", "x", "y"), eps)
    return named.groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"),
                                           F.count(F.lit(1)).alias("members"))


def industrial_exposure(segments: DataFrame, clusters: DataFrame, radius: float = KERNEL_RADIUS_M,
                        decay_m: float = KERNEL_DECAY_M, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Count, nearest distance and decayed sum of facility clusters around each midpoint.

    Clusters at one position are counted once with a multiplicity, so copies do not multiply pairs.
    Midpoints are stored: hot cells are counted in them first.
    """
    sites = (clusters.groupBy(F.col("x").alias("sx"), F.col("y").alias("sy"))
             .agg(F.count(F.lit(1)).alias("copies")))
    near = points_near_points(stored(midpoints(segments), "midpoints"), sites, radius, "segment_id",
                              keep_points=True, min_rows=min_rows)
    hit = F.col("distance_m").isNotNull()
    return (near.groupBy(*PLACE, "segment_id")
            .agg(F.coalesce(F.sum(F.when(hit, F.col("copies"))), F.lit(0)).alias("facility_count"),
                 F.min("distance_m").alias("nearest_facility_m"),
                 F.coalesce(F.sum(F.when(hit, F.col("copies")
                                         * distance_decay(F.col("distance_m"), decay_m))), F.lit(0.0))
                 .alias("raw_kernel"))
            .select("segment_id", "facility_count", "nearest_facility_m", "raw_kernel"))


def traffic_exposure(segments: DataFrame, roads: DataFrame, radius: float = KERNEL_RADIUS_M,
                     decay_m: float = KERNEL_DECAY_M, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Decayed sum over the nearest road of each class around every midpoint.

    Midpoints are stored: hot cells are counted in them first.
    """
    legs = legs_of(roads.select("highway_class", "pts"))
    nearest = nearest_leg_by_class(stored(midpoints(segments), "midpoints"), legs, radius, "segment_id", "highway_class",
                                   list(TRAFFIC_CLASS_WEIGHTS), min_rows=min_rows)
    # The weight belongs to the class, so it is looked up rather than carried through the search.
    weights = F.create_map(*[F.lit(v) for pair in TRAFFIC_CLASS_WEIGHTS.items() for v in pair])
    kernel = weights[F.col("highway_class")] * distance_decay(F.col("nearest_m"), decay_m)
    return (nearest.groupBy("segment_id")
            .agg(F.count("nearest_m").alias("road_class_count"),
                 F.min("nearest_m").alias("nearest_road_m"),
                 F.coalesce(F.sum(kernel), F.lit(0.0)).alias("raw_kernel")))


# --- percentiles -----------------------------------------------------------------------------------
def tree_percentiles(samples: DataFrame) -> DataFrame:
    return percent_ranks_pct(samples, "segment_id", {"trees_per_100m": "shade_benefit", "pollen_weight_per_100m": "pollen_source"})


def industrial_percentiles(samples: DataFrame) -> DataFrame:
    ranked = percent_rank_pct(samples, "segment_id", "raw_kernel", "industrial_prox")
    return ranked.select("segment_id", "industrial_prox",
                         F.coalesce(F.col("nearest_facility_m") <= INDUSTRIAL_NEAR_M, F.lit(False))
                         .alias("industrial_within_200m"))


def traffic_percentiles(samples: DataFrame) -> DataFrame:
    return (percent_rank_pct(samples, "segment_id", "raw_kernel", "traffic_prox")
            .select("segment_id", "traffic_prox"))


def pollutant_percentiles(samples: DataFrame) -> DataFrame:
    """Each pollutant ranks only the segments that have a value for it."""
    return percent_ranks_pct(samples, "segment_id", {f"{h}_raw": f"{h}_prior" for h in ("pm25", "no2", "ozone")}, skip_null=True)


def image_percentiles(samples: DataFrame) -> DataFrame:
    return percent_ranks_pct(samples, "segment_id", {"sky_view_factor_raw": "sky_view_factor", "crowd_density_raw": "crowd_prior"})


def geocode_permits(permits: DataFrame, centroids: DataFrame, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Place permits at their building's centroid; permits of unknown buildings are left out.

    Permits without a single match point to a broken feed, and fail when the result is used.
    """
    located = lookup_join(permits, centroids, ["bin"], F.col("permit_id"), "inner", min_rows)
    matched = located.agg(F.count(F.lit(1))).scalar()
    asked = permits.agg(F.count(F.lit(1))).scalar()
    broken = permits.sparkSession.range(1).where((asked > 0) & (matched == 0)).select(
        *[F.raise_error(F.lit("permits were read, but none matched a building centroid"))
          .cast(f.dataType).alias(f.name) for f in located.schema.fields])
    return located.unionByName(broken)
