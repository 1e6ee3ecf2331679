"""Scores per street way: assembling, averaging and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.numbers import pack_scores, quantise, unpack_score
from kerbside.vocab import NO_DATA, OPTIONAL_WAY_SCORES, WAY_SCORES

# way score -> column of the wide segment table
SEGMENT_COLUMNS = {"pm25": "pm25_prior", "no2": "no2_prior", "ozone": "ozone_prior",
                   "traffic": "traffic_prox", "industrial": "industrial_prox", "shade": "shade_benefit",
                   "pollen": "pollen_source", "svf": "sky_view_factor", "crowd": "crowd_prior"}


def way_scores(segments: DataFrame, scores: DataFrame) -> DataFrame:
    """Length-weighted scores per way.

    A score nobody measured reads 0, except imagery scores, which read the no-data mark.
    """
    joined = segments.select("segment_id", "osm_way_id", "length_m", "grade_pct").join(
        scores, "segment_id", "left")

    def mean(value: Column, missing: float) -> Column:
        measured = F.sum(F.when(value.isNotNull(), F.col("length_m")))
        return F.coalesce(F.try_divide(F.sum(value * F.col("length_m")), measured), F.lit(float(missing)))

    columns = []
    for name in WAY_SCORES:
        if name == "grade":
            columns.append(mean(F.abs(F.col("grade_pct")), 0).alias(name))
        elif name == "industrial_within_200m":
            columns.append(F.max(F.when(F.col(name), F.lit(100.0)).otherwise(F.lit(0.0))).alias(name))
        else:
            missing = NO_DATA if name in OPTIONAL_WAY_SCORES else 0
            columns.append(mean(F.col(SEGMENT_COLUMNS[name]).cast("double"), missing).alias(name))
    return joined.groupBy("osm_way_id").agg(*columns)


def quantised_ways(ways: DataFrame) -> DataFrame:
    """Scores as the routing side reads them: integers, after seven-bit storage."""
    return ways.select(*[c for c in ways.columns if c not in WAY_SCORES],
                       *[quantise(F.col(n), n in OPTIONAL_WAY_SCORES).alias(n) for n in WAY_SCORES])


def packed_ways(ways: DataFrame) -> DataFrame:
    packs = pack_scores([F.col(n) for n in WAY_SCORES])
    return ways.select("osm_way_id", *[p.alias(f"pack{i}") for i, p in enumerate(packs)])


def unpacked_ways(packed: DataFrame) -> DataFrame:
    packs = [F.col("pack0"), F.col("pack1"), F.col("pack2")]
    return packed.select("osm_way_id", *[unpack_score(packs, n).alias(n) for n in WAY_SCORES])


def verify_scores(edges: DataFrame, indexed_ways: DataFrame) -> DataFrame:
    """Edges with any score above zero; fails when ways were indexed but no edge has a score."""
    scored = F.greatest(*[F.col(n) for n in WAY_SCORES]) > 0
    counted = edges.agg(F.count_if(scored).alias("scored_edges"))
    ways = indexed_ways.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        F.when((ways > 0) & (F.col("scored_edges") == 0),
               F.raise_error(F.lit("ways were indexed but no edge received a score")).cast("long"))
        .otherwise(F.col("scored_edges")).alias("scored_edges"))
