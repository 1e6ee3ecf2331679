"""Map tiles: which segments show on which tile, and their clipped, quantised legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import MERCATOR_HALF_M, leg_array, mercator_tile, tile_bounds_m
from kerbside.functions.numbers import half_up
from kerbside.vocab import TILE_COLUMNS

EXTENT = 4096
BUFFER = 64


def clip_leg(x1: Column, y1: Column, x2: Column, y2: Column, west: Column, south: Column, east: Column,
             north: Column) -> tuple[Column, Column]:
    """Entry and exit share of a leg inside a box; the leg misses the box when entry > exit."""
    def side(start: Column, delta: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(low - start, delta), F.try_divide(high - start, delta)
        inside = (start >= low) & (start <= high)
        enter = F.when(delta == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(a, b))
        leave = F.when(delta == 0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(a, b))
        return enter, leave

    ex, lx = side(x1, x2 - x1, west, east)
    ey, ly = side(y1, y2 - y1, south, north)
    return F.greatest(ex, ey, F.lit(0.0)), F.least(lx, ly, F.lit(1.0))


def tile_features(segments: DataFrame, scores: DataFrame, hazard: str, zoom: int) -> DataFrame:
    """Scored segment legs per tile at ``zoom``, clipped to the tile plus buffer, in tile units.

    Points are web-mercator metres. A segment belongs to a tile only if it touches the tile itself; legs
    are then clipped to the buffered tile. Each leg names the tiles under its own box, so there is no
    spatial join at all.
    """
    column = TILE_COLUMNS[hazard]
    size = 2 * MERCATOR_HALF_M / (1 << zoom)
    pad = size * BUFFER / EXTENT
    scored = segments.select("segment_id", "pts").join(
        scores.where(F.col(column).isNotNull()).select("segment_id", half_up(F.col(column)).cast("int").alias("score")),
        "segment_id")
    legs = (scored.select("segment_id", "score", F.posexplode(leg_array(F.col("pts"))).alias("leg_no", "leg"))
            .select("segment_id", "score", "leg_no", "leg.*"))
    west_x, east_x = F.least("x1", "x2") - pad, F.greatest("x1", "x2") + pad
    south_y, north_y = F.least("y1", "y2") - pad, F.greatest("y1", "y2") + pad
    first_col, first_row = mercator_tile(west_x, north_y, zoom)
    last_col, last_row = mercator_tile(east_x, south_y, zoom)
    spread = (legs.withColumn("tile_x", F.explode(F.sequence(first_col, last_col)))
              .withColumn("tile_y", F.explode(F.sequence(first_row, last_row))))
    west, south, east, north = tile_bounds_m(F.col("tile_x"), F.col("tile_y"), zoom)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    strict_in, strict_out = clip_leg(*ends, west, south, east, north)
    enter, leave = clip_leg(*ends, west - pad, south - pad, east + pad, north + pad)
    clipped = (spread.withColumn("touches", strict_in <= strict_out)
               .withColumn("enter", enter).withColumn("leave", leave)
               .where(F.col("enter") <= F.col("leave")))
    unit = F.lit(EXTENT / size)

    def grid(share: Column) -> tuple[Column, Column]:
        x = F.col("x1") + (F.col("x2") - F.col("x1")) * share
        y = F.col("y1") + (F.col("y2") - F.col("y1")) * share
        return half_up((x - west) * unit).cast("int"), half_up((north - y) * unit).cast("int")

    (qx1, qy1), (qx2, qy2) = grid(F.col("enter")), grid(F.col("leave"))
    placed = clipped.select("segment_id", "score", "leg_no", "tile_x", "tile_y", "touches",
                            qx1.alias("qx1"), qy1.alias("qy1"), qx2.alias("qx2"), qy2.alias("qy2"))
    visible = (placed.groupBy("segment_id", "tile_x", "tile_y").agg(F.max("touches").alias("seen"))
               .where("seen").drop("seen"))
    return (placed.join(visible, ["segment_id", "tile_x", "tile_y"])
            .where((F.col("qx1") != F.col("qx2")) | (F.col("qy1") != F.col("qy2")))
            .drop("touches").withColumn("zoom", F.lit(zoom)))
