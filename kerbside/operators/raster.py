"""Sampling grids of cells: elevation grades and pollutant means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import end_point, point_at, start_point
from kerbside.functions.numbers import clamp, finite
from kerbside.vocab import LONG_SEGMENT_FRACTIONS, LONG_SEGMENT_M, MAX_GRADE_PCT


SMALL_ROWS = 200_000       # counted lookup rows up to which they are sent to all tasks instead of moving the places


def _small(rows: DataFrame) -> DataFrame:
    """Lookup rows marked for broadcast when a count finds few of them; the joins are the same either way."""
    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def raster_values(places: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """(x, y, raster, priority, value) for every valid cell of any raster under the distinct ``places`` (x, y).

    ``meta`` has one row per raster (raster, priority, origin_x, origin_y, cell_x, cell_y, n_rows, n_cols, nodata);
    rows count downwards from origin_y. Rasters are found by the squares of a coarse grid as wide as the widest
    of them, so that each lies in four at most, whatever their number; cells are met by (raster, row, col). Few rasters
    or cells, by a count, are broadcast: every place of a city lies in one square, whose key would gather them all.
    """
    side = meta.agg(F.max(F.greatest(F.col("n_cols") * F.col("cell_x"), F.col("n_rows") * F.col("cell_y")))).scalar()
    wide, high = F.col("n_cols") * F.col("cell_x"), F.col("n_rows") * F.col("cell_y")
    square = lambda v: F.floor(v / side)
    frames = (meta.withColumn("tx", F.explode(F.sequence(square(F.col("origin_x")), square(F.col("origin_x") + wide))))
              .withColumn("ty", F.explode(F.sequence(square(F.col("origin_y") - high), square(F.col("origin_y")))))
              .select("raster", "priority", "origin_x", "origin_y", "cell_x", "cell_y", "n_rows", "n_cols", "nodata", "tx", "ty"))
    col = F.floor((F.col("x") - F.col("origin_x")) / F.col("cell_x"))
    row = F.floor((F.col("origin_y") - F.col("y")) / F.col("cell_y"))
    over = (places.select("x", "y", square(F.col("x")).alias("tx"), square(F.col("y")).alias("ty")).join(_small(frames), ["tx", "ty"])
            .withColumn("col", col).withColumn("row", row)
            .where(F.col("col").between(0, F.col("n_cols") - 1) & F.col("row").between(0, F.col("n_rows") - 1)))
    grid = cells.select("raster", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
                        F.col("value").cast("double").alias("value")).where(finite(F.col("value")))
    valid = F.col("nodata").isNull() | (F.col("value") != F.col("nodata"))
    return over.join(_small(grid), ["raster", "row", "col"]).where(valid).select("x", "y", "raster", "priority", "value")


def sample_raster(points: DataFrame, cells: DataFrame, meta: DataFrame, value: str = "value") -> DataFrame:
    """Cell value under each point; null outside the grids or on no-data.

    Where several rasters cover a point, the first by ``priority`` with a valid value wins. Points at one place
    are looked up once.
    """
    found = raster_values(points.select("x", "y").distinct(), cells, meta)
    first = found.groupBy("x", "y").agg(F.min_by("value", "priority").alias(value))
    return points.join(first, ["x", "y"], "left").select(*points.columns, value)


def grade_pct(z_start: Column, z_end: Column, length_m: Column) -> tuple[Column, Column]:
    """Slope in percent, limited, and whether the limit applied; null when it cannot be known."""
    known = z_start.isNotNull() & z_end.isNotNull() & (length_m > 0)
    raw = (z_end - z_start) / length_m * 100.0
    limited = clamp(raw, -MAX_GRADE_PCT, MAX_GRADE_PCT)
    return F.when(known, limited), F.coalesce(F.when(known, limited != raw), F.lit(False))


def segment_grades(segments: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Segments with grade_pct replaced by the slope between their end points.

    Both ends are sampled in one pass and brought together by segment id.
    """
    ends = F.explode(F.array(F.struct(F.lit("a").alias("end"), start_point(F.col("pts")).alias("p")),
                             F.struct(F.lit("b").alias("end"), end_point(F.col("pts")).alias("p"))))
    points = (segments.select("segment_id", ends.alias("e"))
              .select("segment_id", "e.end", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y")))
    z = (sample_raster(points, cells, meta, "z").groupBy("segment_id")
         .agg(F.max(F.when(F.col("end") == "a", F.col("z"))).alias("za"),
              F.max(F.when(F.col("end") == "b", F.col("z"))).alias("zb")))
    graded, clamped = grade_pct(F.col("za"), F.col("zb"), F.col("length_m"))
    return (segments.drop("grade_pct").join(z, "segment_id", "left")
            .withColumn("grade_pct", graded).withColumn("was_clamped", clamped).drop("za", "zb"))


def pollutant_samples(segments: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Mean pm25, no2 and ozone along each segment: the middle, or three spots on long segments.

    ``meta`` names the hazard of each raster; all hazards are looked up in one pass.
    """
    spots = (F.when(F.col("length_m") >= LONG_SEGMENT_M, F.array(*[F.lit(f) for f in LONG_SEGMENT_FRACTIONS]))
             .otherwise(F.array(F.lit(0.5))))
    points = (segments.withColumn("fraction", F.explode(spots))
              .withColumn("p", point_at(F.col("pts"), F.col("fraction")))
              .select("segment_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    hazards = ("pm25", "no2", "ozone")
    found = raster_values(points.select("x", "y").distinct(), cells, meta).join(_small(meta.select("raster", "hazard")), "raster")
    # The first valid raster of each hazard; others than the hazard's have no order and no value here.
    first = found.groupBy("x", "y").agg(*[
        F.min_by("value", F.when(F.col("hazard") == h, F.col("priority"))).alias(f"{h}_raw") for h in hazards])
    return (points.join(first, ["x", "y"], "left").groupBy("segment_id")
            .agg(*[F.avg(f"{h}_raw").alias(f"{h}_raw") for h in hazards]))
