"""Street network: cutting ways into segments, and reports over the static tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import haversine_m, leg_array
from kerbside.vocab import MAX_SEGMENT_LENGTH_M


def split_ways(ways: DataFrame, max_m: float = MAX_SEGMENT_LENGTH_M) -> DataFrame:
    """Cut each way into chunks of at most ``max_m``; neighbours share their end points.

    A way's coordinates are one array in one row, so the cut happens inside the row: legs with running
    offsets first, then chunk k covers [k*max, min((k+1)*max, length)]. Nothing is shuffled. Legs
    without length are skipped and cut points are linear in longitude and latitude.
    """
    if max_m <= 0:
        raise ValueError("max_m must be positive")
    measured = F.filter(
        F.transform(leg_array(F.col("pts")), lambda g: F.struct(
            g["x1"].alias("x1"), g["y1"].alias("y1"), g["x2"].alias("x2"), g["y2"].alias("y2"),
            haversine_m(g["x1"], g["y1"], g["x2"], g["y2"]).alias("m"))),
        lambda g: g["m"] > 0)
    start = F.struct(F.lit(0.0).alias("at"),
                     F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,a:double,b:double>>")
                     .alias("legs"))
    offsets = F.aggregate(
        F.col("__legs"), start,
        lambda s, g: F.struct(
            (s["at"] + g["m"]).alias("at"),
            F.concat(s["legs"], F.array(F.struct(
                g["x1"].alias("x1"), g["y1"].alias("y1"), g["x2"].alias("x2"), g["y2"].alias("y2"),
                s["at"].alias("a"), (s["at"] + g["m"]).alias("b")))).alias("legs")))
    run = (ways.withColumn("__legs", measured).where(F.size("__legs") > 0)
           .withColumn("__run", offsets).withColumn("__length", F.col("__run.at")))
    last = F.greatest(F.ceil(F.col("__length") / F.lit(float(max_m))) - 1, F.lit(0))
    chunked = (run.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), last)))
               .withColumn("__from", F.col("seq") * F.lit(float(max_m)))
               .withColumn("__to", F.least((F.col("seq") + 1) * F.lit(float(max_m)), F.col("__length"))))

    def at(offset: Column) -> Column:
        on = F.filter(F.col("__run.legs"), lambda g: (g["a"] <= offset) & (offset <= g["b"]))[0]
        share = (offset - on["a"]) / (on["b"] - on["a"])
        return F.struct((on["x1"] + (on["x2"] - on["x1"]) * share).alias("x"),
                        (on["y1"] + (on["y2"] - on["y1"]) * share).alias("y"))

    inner = F.transform(
        F.filter(F.col("__run.legs"), lambda g: (g["b"] > F.col("__from")) & (g["b"] < F.col("__to"))),
        lambda g: F.struct(g["x2"].alias("x"), g["y2"].alias("y")))
    # The way's own end point closes the last chunk exactly.
    final = F.element_at(F.col("__run.legs"), -1)
    end = F.when(F.col("seq") == last, F.struct(final["x2"].alias("x"), final["y2"].alias("y"))) \
        .otherwise(at(F.col("__to")))
    keep = [c for c in ways.columns if c != "pts"]
    return chunked.select(*keep, "seq", F.concat(F.array(at(F.col("__from"))), inner, F.array(end)).alias("pts"),
                          (F.col("__to") - F.col("__from")).alias("chunk_m"))


def segment_stats(segments: DataFrame) -> DataFrame:
    return segments.agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_distinct("osm_way_id").alias("way_count"),
        F.coalesce(F.max("length_m"), F.lit(0.0)).alias("maximum_length_m"),
        F.coalesce(F.avg("length_m"), F.lit(0.0)).alias("average_length_m"))


def grade_stats(segments: DataFrame) -> DataFrame:
    return segments.agg(
        F.count(F.lit(1)).alias("segment_count"), F.count("grade_pct").alias("graded_count"),
        F.count_if("was_clamped").alias("clamped_count"),
        F.coalesce(F.min("grade_pct"), F.lit(0.0)).alias("minimum_grade_pct"),
        F.coalesce(F.max("grade_pct"), F.lit(0.0)).alias("maximum_grade_pct"))


def kernel_stats(samples: DataFrame, count_col: str, sources: DataFrame) -> DataFrame:
    """Segments scored and exposed for a proximity kernel, with the size of its source table."""
    total = sources.agg(F.count(F.lit(1))).scalar()
    return samples.agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_if(F.col(count_col) > 0).alias("exposed_segment_count"),
        F.coalesce(F.max("raw_kernel"), F.lit(0.0)).alias("maximum_raw_kernel")) \
        .withColumn("source_count", total)


def tree_stats(samples: DataFrame, trees: DataFrame, genera: DataFrame) -> DataFrame:
    counted = trees.join(F.broadcast(genera.select("genus", F.lit(1).alias("listed"))), "genus", "left").agg(
        F.count(F.lit(1)).alias("tree_count"), F.count("listed").alias("allergenic_tree_count"))
    return samples.agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.count_if(F.col("tree_count") > 0).alias("shaded_segment_count"),
        F.count_if(F.col("allergen_weight") > 0).alias("pollen_segment_count")) \
        .withColumn("tree_count", counted.select("tree_count").scalar()) \
        .withColumn("allergenic_tree_count", counted.select("allergenic_tree_count").scalar())


def pollutant_stats(samples: DataFrame, segments: DataFrame) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("sampled_count"),
        *[F.count(f"{h}_raw").alias(f"{h}_count") for h in ("pm25", "no2", "ozone")]) \
        .withColumn("segment_count", segments.agg(F.count(F.lit(1))).scalar())


def feature_stats(frames: DataFrame, samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames used and held back, segments covered and the covered share of the network."""
    network = segments.agg(F.count(F.lit(1))).scalar()
    covered = samples.agg(F.count(F.lit(1))).scalar()
    return frames.agg(F.count_if("daylight").alias("frame_count"),
                      F.count_if(~F.col("daylight")).alias("excluded_dark_count")) \
        .withColumn("segment_count", covered).withColumn("network_segment_count", network) \
        .withColumn("coverage_fraction", F.when(network > 0, covered / network).otherwise(F.lit(0.0)))
