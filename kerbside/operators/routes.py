"""Comparing routes: exposure, variants, differences, announcements and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.numbers import half_up, percentage_change
from kerbside.functions.text import lookup, speech_key
from kerbside.operators.ranking import top_per
from kerbside.operators.skew import HOT_MIN_ROWS, lookup_join
from kerbside.vocab import (CLOSING_LINE, HAZARD_LINES, HAZARDS, MAX_MENTIONS, MAX_VARIANT_ATTEMPTS,
                            MENTION_THRESHOLD, OPENING_CALM, OPENING_ELEVATED, ROUTE_EXPOSURES, VARIANT_PLAN)


def route_exposure(route_edges: DataFrame, ways: DataFrame, key: Sequence[str] = ("route_id",),
                   min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Length-weighted mean score per hazard along each route, 2 places.

    Edges without a score are skipped; shade is turned into a deficit, which makes a route without
    any shade score read 100.
    """
    key = list(key)
    scores = sorted(set(ROUTE_EXPOSURES.values()))
    # A busy way is part of many routes: the lookup tolerates a hot way id.
    joined = lookup_join(route_edges.select(*key, "osm_way_id", "length_m"),
                         ways.select("osm_way_id", *scores), ["osm_way_id"], F.struct(*key), "left", min_rows)
    columns = []
    for hazard, score in ROUTE_EXPOSURES.items():
        value = F.col(score).cast("double")
        weight = F.sum(F.when(value.isNotNull(), F.col("length_m")))
        mean = F.coalesce(F.try_divide(F.sum(value * F.col("length_m")), weight), F.lit(0.0))
        columns.append(half_up(F.lit(100.0) - mean if hazard == "shade_deficit" else mean, 2).alias(hazard))
    return joined.groupBy(*key).agg(*columns)


def exposure_diff(routes: DataFrame, key: str = "od_id", variant: str = "variant") -> DataFrame:
    """Relative change of each exposure and of distance against the fastest variant of the same trip."""
    names = [*ROUTE_EXPOSURES, "distance_m"]
    base = routes.where(F.col(variant) == "fastest").select(key, *[F.col(n).alias(f"base_{n}") for n in names])
    return routes.join(base, key).select(
        key, variant,
        *[percentage_change(F.col(n), F.col(f"base_{n}")).alias("distance" if n == "distance_m" else n)
          for n in names])


# --- variants --------------------------------------------------------------------------------------
def variant_attempts() -> list[tuple[str, int, float]]:
    """(variant, attempt, weight scale) in the order they are tried."""
    return [(name, n, scale / 2 ** (n - 1)) for name, (scale, _) in VARIANT_PLAN.items()
            for n in range(1, MAX_VARIANT_ATTEMPTS + 1)]


def compare_variants(candidates: DataFrame, profiles: DataFrame, key: str = "od_id") -> DataFrame:
    """Pick each trip's fastest, balanced and cleanest route under the detour caps.

    ``candidates`` carries (od, variant, attempt, weight_scale, distance_m); the fastest variant has one
    attempt at scale 0. The first attempt within its cap wins; if none is, the shortest one (earliest on
    ties) is taken and marked as exceeding the cap, with all attempts spent.
    """
    base = candidates.where(F.col("variant") == "fastest").select(key, F.col("distance_m").alias("fastest_m"))
    tolerance = profiles.select(key, "detour_tolerance")
    share = lookup(F.col("variant"), {name: multiple for name, (_, multiple) in VARIANT_PLAN.items()})
    cap = F.when(F.col("variant") == "fastest", F.col("fastest_m")) \
        .otherwise(F.col("fastest_m") * (F.lit(1.0) + F.col("detour_tolerance") * share))
    judged = candidates.join(base, key).join(tolerance, key).withColumn("distance_cap_m", cap)
    details = F.struct("attempt", "weight_scale", "distance_m", "distance_cap_m")
    fits = F.col("distance_m") <= F.col("distance_cap_m")
    picked = judged.groupBy(key, "variant").agg(
        F.min(F.when(fits, details)).alias("within"),
        F.min(F.struct("distance_m", "attempt", "weight_scale", "distance_cap_m")).alias("shortest"))
    exceeded = F.col("within").isNull()
    return picked.select(
        key, "variant",
        F.when(exceeded, F.col("shortest.distance_m")).otherwise(F.col("within.distance_m")).alias("distance_m"),
        F.when(exceeded, F.col("shortest.weight_scale")).otherwise(F.col("within.weight_scale"))
        .alias("weight_scale"),
        F.when(exceeded, F.lit(MAX_VARIANT_ATTEMPTS)).otherwise(F.col("within.attempt")).alias("attempts"),
        F.when(exceeded, F.col("shortest.attempt")).otherwise(F.col("within.attempt")).alias("chosen_attempt"),
        F.col("shortest.distance_cap_m").alias("distance_cap_m"), exceeded.alias("detour_cap_exceeded"))


def scenario_diff(clear: DataFrame, smoke: DataFrame, key: str = "od_id") -> DataFrame:
    """How far the chosen routes move between two sets of readings."""
    a = clear.select(key, "variant", F.col("distance_m").alias("clear_m"), F.col("path_key").alias("clear_path"))
    b = smoke.select(key, "variant", F.col("distance_m").alias("smoke_m"), F.col("path_key").alias("smoke_path"))
    return a.join(b, [key, "variant"]).select(
        key, "variant", "clear_m", "smoke_m", F.abs(F.col("smoke_m") - F.col("clear_m")).alias("shift_m"),
        (~F.col("clear_path").eqNullSafe(F.col("smoke_path"))).alias("path_changed"))


# --- ranking of hazards ------------------------------------------------------------------------------
def hazard_order(hazard: Column) -> Column:
    return F.array_position(F.array(*[F.lit(h) for h in HAZARDS]), hazard)


def top_hazards(exposures: DataFrame, n: int = MAX_MENTIONS, key: str = "route_id") -> DataFrame:
    """The hazards worth mentioning per route: exposure of at least 60, by weight times exposure."""
    worth = exposures.where((F.col("weight") > 0) & (F.col("exposure") >= MENTION_THRESHOLD)
                            & F.col("hazard").isin(*HAZARDS))
    return top_per(worth, [key], [F.desc(F.col("weight") * F.col("exposure")), hazard_order(F.col("hazard"))],
                   n, "place")


def top_deltas(diffs: DataFrame, n: int = 2, key: str = "route_id") -> DataFrame:
    """Largest absolute changes per route; a route without any shows exposure 0 and its distance change."""
    real = diffs.where((F.col("hazard") != "distance") & F.col("value").isNotNull())
    top = top_per(real, [key], [F.desc(F.abs("value")), hazard_order(F.col("hazard"))], n, "place")
    distance = diffs.groupBy(key).agg(
        F.max(F.when(F.col("hazard") == "distance", F.col("value"))).alias("distance"),
        F.count_if((F.col("hazard") != "distance") & F.col("value").isNotNull()).alias("changes"))
    fallback = F.explode(F.array(
        F.struct(F.lit("exposure").alias("hazard"), F.lit(0.0).alias("value"), F.lit(1).alias("place")),
        F.struct(F.lit("distance").alias("hazard"), F.coalesce("distance", F.lit(0.0)).alias("value"),
                 F.lit(2).alias("place"))))
    filler = distance.where(F.col("changes") == 0).select(key, fallback.alias("f")).select(key, "f.*")
    return top.select(key, "hazard", "value", "place").unionByName(filler)


def strongest_improvement(diffs: DataFrame, key: str = "route_id") -> DataFrame:
    """The most negative change per route; routes without an improvement are absent."""
    better = diffs.where((F.col("hazard") != "distance") & (F.col("value") < 0))
    return better.groupBy(key).agg(
        F.min(F.struct("value", hazard_order(F.col("hazard")).alias("o"), "hazard")).alias("best")) \
        .select(key, F.col("best.hazard").alias("hazard"), F.col("best.value").alias("value"))


def top_priorities(profiles: DataFrame, n: int = 4) -> DataFrame:
    """A profile's heaviest hazards."""
    long = profiles.select("profile_id", F.explode("weights").alias("hazard", "weight")).where("weight > 0")
    return top_per(long, ["profile_id"], [F.desc("weight"), hazard_order(F.col("hazard"))], n, "place")


# --- announcements -----------------------------------------------------------------------------------
def announcements(exposures: DataFrame, routes: DataFrame, key: str = "route_id") -> DataFrame:
    """Spoken lines of each route: opening, up to three hazards spread over the way, arrival.

    ``exposures`` is long (route, hazard, exposure, weight); stored routes have no profile, so callers
    use weight 1 for every scored hazard.
    """
    # At most three rows per route are gathered here.
    mentioned = top_hazards(exposures, key=key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", "hazard"))).alias("top"))
    full = routes.select(key, "distance_m").join(mentioned, key, "left")
    top = F.coalesce("top", F.array().cast("array<struct<place:int,hazard:string>>"))
    spacing = F.col("distance_m") / (F.size(top) + 1)
    line = F.struct
    hazard_lines = F.transform(top, lambda t: line(
        t["place"].alias("seq"), half_up(spacing * t["place"]).alias("distance_offset_m"),
        lookup(t["hazard"], HAZARD_LINES).alias("text")))
    opening = F.array(line(F.lit(0).alias("seq"), F.lit(0.0).alias("distance_offset_m"),
                           F.when(F.size(top) > 0, OPENING_ELEVATED).otherwise(OPENING_CALM).alias("text")))
    closing = F.array(line((F.size(top) + 1).alias("seq"),
                           F.greatest(F.col("distance_m") - 30.0, F.lit(0.0)).alias("distance_offset_m"),
                           F.lit(CLOSING_LINE).alias("text")))
    return full.select(key, F.explode(F.concat(opening, hazard_lines, closing)).alias("l")).select(key, "l.*")


def lines_to_synthesise(lines: DataFrame, cache: DataFrame, voice: Column, speed: Column) -> DataFrame:
    """Distinct spoken lines that have no clip yet; repeats collapse before the shuffle."""
    keyed = lines.where(F.trim("text") != "").select(speech_key(F.col("text"), voice, speed).alias("speech_key"), "text")
    wanted = keyed.groupBy("speech_key").agg(F.min("text").alias("text"))
    return wanted.join(cache.select("speech_key"), "speech_key", "left_anti")


# --- history -----------------------------------------------------------------------------------------
ROUTE_SCHEMA = ("route_id string, user_id string, variant string, pts array<struct<x:double,y:double>>, "
                "distance_m double, duration_s double, exposure_breakdown map<string,double>, "
                "instructions array<struct<sign:int,name:string,distance_m:double,duration_s:double>>, "
                "computed_at timestamp")
FEEDBACK_SCHEMA = ("feedback_id string, route_id string, user_id string, felt_worse boolean, "
                   "which_segments array<int>, created_at timestamp")


def route_rows(explained: DataFrame, walked: DataFrame, edges: DataFrame, places: DataFrame, owners: DataFrame,
               computed_at: Column) -> DataFrame:
    """Chosen routes as rows of the history (``ROUTE_SCHEMA``), one per trip and variant.

    ``explained`` and ``walked``: what the comparison returns. ``edges``: edge_id and speed_mps; ``places``: node, x, y;
    ``owners``: od_id, user_id (null for nobody). The points are those of the edges in order. Edges in a row on one way make
    one instruction: 0 at first, then 1 for each further way. A route without edges has neither.
    """
    key = ["od_id", "variant"]
    step = F.struct("position", "x", "y", "osm_way_id", "length_m", "seconds")
    at = places.select("node", "x", "y")
    legs = walked.join(edges.select("edge_id", (F.lit(1.0) / F.col("speed_mps")).alias("pace")), "edge_id").withColumn("seconds", F.col("length_m") * F.col("pace"))
    ends = legs.join(at.withColumnRenamed("node", "dst"), "dst")
    starts = (legs.where("position = 1").join(at.withColumnRenamed("node", "src"), "src")
              .withColumns({"position": F.lit(0), "length_m": F.lit(0.0), "seconds": F.lit(0.0)}))
    names = [*key, "position", "x", "y", "osm_way_id", "length_m", "seconds"]
    path = ends.select(*names).unionByName(starts.select(*names)).groupBy(*key).agg(F.array_sort(F.collect_list(step)).alias("path"))
    instruction = "array<struct<sign:int,name:string,distance_m:double,duration_s:double>>"

    def told(done: Column, leg: Column) -> Column:
        name, last = leg["osm_way_id"].cast("string"), F.element_at(done, -1)
        same = (F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1))["name"].eqNullSafe(name), F.lit(False))
        longer = F.struct(last["sign"].alias("sign"), name.alias("name"), (last["distance_m"] + leg["length_m"]).alias("distance_m"),
                          (last["duration_s"] + leg["seconds"]).alias("duration_s"))
        new = F.struct(F.when(F.size(done) > 0, 1).otherwise(0).alias("sign"), name.alias("name"), leg["length_m"].alias("distance_m"), leg["seconds"].alias("duration_s"))
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(new)))

    legs_of = F.filter("path", lambda s: s["position"] > 0)
    told_all = F.aggregate(legs_of, F.array().cast(instruction), lambda done, leg: told(done, leg).cast(instruction))
    pts = F.transform("path", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    seconds = F.aggregate("path", F.lit(0.0), lambda total, s: total + s["seconds"])
    breakdown = F.create_map(*[c for h in ROUTE_EXPOSURES for c in (F.lit(h), F.col(h).cast("double"))])
    return (explained.join(path, key, "left").join(owners.select("od_id", "user_id"), "od_id", "left").select(
        F.concat_ws("-", F.col("od_id").cast("string"), "variant", F.date_format(computed_at, "yyyyMMddHHmmss")).alias("route_id"),
        F.col("user_id").cast("string").alias("user_id"), "variant", F.coalesce(pts, F.array().cast("array<struct<x:double,y:double>>")).alias("pts"),
        F.col("distance_m").cast("double").alias("distance_m"), F.coalesce(seconds, F.lit(0.0)).alias("duration_s"), breakdown.alias("exposure_breakdown"),
        F.coalesce(told_all, F.array().cast(instruction)).alias("instructions"), computed_at.alias("computed_at")))


def owned_routes(routes: DataFrame, callers: DataFrame) -> DataFrame:
    """Routes belonging to one of the callers; routes without an owner belong to nobody."""
    return routes.join(callers.select("route_id", "user_id").distinct(), ["route_id", "user_id"], "left_semi")


def accepted_feedback(feedback: DataFrame, routes: DataFrame) -> DataFrame:
    """Feedback of route owners with at most 20 non-negative segment numbers."""
    segments = F.coalesce("which_segments", F.array().cast("array<int>"))
    usable = feedback.withColumn("which_segments", segments).where(
        F.col("felt_worse").isNotNull() & (F.size("which_segments") <= 20)
        & F.forall("which_segments", lambda s: s >= 0))
    return usable.join(routes.select("route_id", "user_id").distinct(), ["route_id", "user_id"], "left_semi")


def erase_users(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """What remains of every table once the users are gone: routes, feedback, analyses, frames."""
    gone = user_ids.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    routes = tables["route"]
    dead_routes = routes.join(gone, "user_id", "left_semi").select("route_id").distinct()
    out = {"app_user": tables["app_user"].join(gone, "user_id", "left_anti"),
           "route": routes.join(gone, "user_id", "left_anti")}
    if "route_feedback" in tables:
        out["route_feedback"] = tables["route_feedback"].join(dead_routes, "route_id", "left_anti")
    if "route_analysis" in tables:
        analyses = tables["route_analysis"]
        out["route_analysis"] = analyses.join(dead_routes, "route_id", "left_anti")
        if "route_analysis_frame" in tables:
            dead = analyses.join(dead_routes, "route_id", "left_semi").select("analysis_id").distinct()
            out["route_analysis_frame"] = tables["route_analysis_frame"].join(dead, "analysis_id", "left_anti")
    return out


def within_quota(calls: DataFrame, budget: int, ts: str = "called_at", call_id: str = "call_id",
                 zone: str = "America/New_York") -> DataFrame:
    """The first ``budget`` calls of each local day."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts), zone))
    return top_per(calls.withColumn("local_date", day), ["local_date"], [F.col(ts), F.col(call_id)], budget)


def ordered(df: DataFrame, *columns) -> DataFrame:
    return df.orderBy(*columns)
