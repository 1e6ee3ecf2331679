"""Row validation and table rules, each evaluated in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import valid_point
from kerbside.functions.numbers import finite
from kerbside.vocab import HARD_AVOIDS, HAZARDS


def check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule: one aggregation whatever the number of rules.

    Like a table constraint, a rule that evaluates to null is not broken.
    """
    counted = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules]))
    return counted.select(pairs.alias("r")).select("r.rule", "r.broken")


def score_rules(columns: list[str]) -> dict[str, Column]:
    return {f"{c}_in_0_100": F.col(c).between(0, 100) for c in columns}


TABLE_RULES = {
    "segment": lambda: {"positive_length": F.col("length_m") > 0, "two_points": F.size("pts") >= 2,
                        "seq_from_zero": F.col("seq") >= 0},
    "segment_static_score": lambda: score_rules(
        ["pm25_prior", "no2_prior", "ozone_prior", "traffic_prox", "industrial_prox", "shade_benefit",
         "pollen_source", "sky_view_factor", "crowd_prior"]),
    "hazard_field": lambda: {"severity_0_4": F.col("severity").between(0, 4),
                             "band_order": F.col("band_max") >= F.col("band_min")},
    "construction_permit": lambda: {"severity_1_4": F.col("severity").between(1, 4)},
    "street_image": lambda: {"compass": (F.col("compass_angle") >= 0) & (F.col("compass_angle") < 360)},
    "image_analysis": lambda: {f"{c}_in_0_1": F.col(c).between(0, 1) for c in
                               ("vegetation_frac", "sky_frac", "road_frac", "sidewalk_frac",
                                "sky_view_factor", "ego_vehicle_frac")},
    "traffic_road": lambda: {"positive_weight": F.col("proxy_weight") > 0},
    "street_tree": lambda: {"dbh": F.col("dbh_inches") >= 0},
}


def profile_problem() -> Column:
    """First reason a profile row is unusable, null for a good one."""
    weights = F.map_values("weights")
    bad_weight = ~F.forall(weights, lambda w: finite(w) & w.between(0.0, 3.0))
    unknown = ~F.forall(F.map_keys("weights"), lambda k: k.isin(*HAZARDS))
    bad_avoid = ~F.forall("hard_avoids", lambda a: F.lower(a).isin(*HARD_AVOIDS))

    def outside(name: str, low: float, high: float, open_low: bool = False) -> Column:
        value = F.col(name)
        inside = finite(value) & value.between(low, high)
        return ~(inside & (value > low) if open_low else inside)

    return (F.when(F.col("weights").isNull() | bad_weight, "weights")
            .when(unknown | (F.size("weights") > len(HAZARDS)), "hazard")
            .when(F.col("hard_avoids").isNull() | bad_avoid, "hard_avoids")
            .when(F.col("mode").isNull(), "mode")
            .when(outside("max_grade_pct", 0.0, 20.0), "max_grade_pct")
            .when(outside("detour_tolerance", 0.0, 2.0), "detour_tolerance")
            .when(outside("conservatism", 0.0, 2.0, open_low=True), "conservatism")
            .when(F.length("label") > 120, "label"))


def validate_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into usable profiles and rejected ones with a ``problem``."""
    judged = profiles.withColumn("problem", profile_problem())
    return judged.where(F.col("problem").isNull()).drop("problem"), judged.where(F.col("problem").isNotNull())


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route requests whose end points are finite and in range, and the others with a ``problem``."""
    problem = (F.when(~F.coalesce(valid_point(F.col("origin_lat"), F.col("origin_lon")), F.lit(False)), "origin")
               .when(~F.coalesce(valid_point(F.col("dest_lat"), F.col("dest_lon")), F.lit(False)), "destination"))
    judged = requests.withColumn("problem", problem)
    return judged.where(F.col("problem").isNull()).drop("problem"), judged.where(F.col("problem").isNotNull())
