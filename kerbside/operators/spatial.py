"""Distance joins on a square grid, nearest neighbours and area membership.

One side of every join is a point and so lies in exactly one cell; the other side is repeated into
each cell its padded box touches. Every pair therefore meets exactly once and needs no clean-up.
Hot cells are split with salts (see ``skew``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.geo import in_rings, leg_array, planar_m, point_leg_m
from kerbside.functions.numbers import half_up
from kerbside.operators.skew import HOT_MIN_ROWS, hot_keys, lookup_join, salted_pair
from kerbside.session import stored

CELL = ("cx", "cy")
PLACE = ("cx", "cy", "salt")
MAX_LEG_CELLS = 8  # longer legs are cut before they are spread over cells


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def in_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumn("cx", cell(F.col(x), size)).withColumn("cy", cell(F.col(y), size))


def over_cells(df: DataFrame, size: float, pad: float) -> DataFrame:
    """Repeat each leg (x1,y1,x2,y2) into the cells its box, padded, touches."""
    def span(a: str, b: str) -> Column:
        low = F.least(F.col(a), F.col(b)) - F.lit(float(pad))
        high = F.greatest(F.col(a), F.col(b)) + F.lit(float(pad))
        return F.sequence(cell(low, size), cell(high, size))

    return (df.withColumn("cx", F.explode(span("x1", "x2")))
            .withColumn("cy", F.explode(span("y1", "y2"))))


def legs_of(lines: DataFrame, pts: str = "pts") -> DataFrame:
    """One row per straight leg with x1,y1,x2,y2; the array itself is dropped."""
    return (lines.withColumn("__leg", F.explode(leg_array(F.col(pts))))
            .select(*[c for c in lines.columns if c != pts], "__leg.x1", "__leg.y1", "__leg.x2", "__leg.y2"))


def cut_legs(legs: DataFrame, max_len: float) -> DataFrame:
    """Cut legs longer than ``max_len`` into equal pieces, so a box never covers mostly empty cells."""
    length = planar_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    pieces = F.greatest(F.ceil(length / F.lit(float(max_len))), F.lit(1))
    cut = legs.withColumn("__n", pieces).withColumn(
        "__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))

    def at(axis: str, step: Column) -> Column:
        a, b = F.col(f"{axis}1"), F.col(f"{axis}2")
        return (F.when(step == 0, a).when(step == F.col("__n"), b)
                .otherwise(a + (b - a) * step / F.col("__n")))

    names = [c for c in legs.columns if c not in ("x1", "y1", "x2", "y2")]
    return cut.select(*names, at("x", F.col("__i")).alias("x1"), at("y", F.col("__i")).alias("y1"),
                      at("x", F.col("__i") + 1).alias("x2"), at("y", F.col("__i") + 1).alias("y2"))


def _spread(copies: DataFrame) -> DataFrame:
    """Legs repeated over cells, never broadcast: the planner takes them for as small as the legs' own files."""
    return copies.hint("merge")


def points_near_legs(points: DataFrame, legs: DataFrame, radius: float, point_id: str,
                     size: float | None = None, keep_points: bool = False,
                     min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """All (point, leg) pairs within ``radius``, with ``distance_m``.

    ``points`` needs x,y and ``legs`` x1,y1,x2,y2. A leg is cut only when very long, so callers that
    count pairs per line must merge the pieces. With ``keep_points`` a point without any leg appears
    once, with a null distance. Grouping by PLACE and the point id reuses the join's partitioning.
    """
    size = float(size or radius)
    right = over_cells(cut_legs(legs, MAX_LEG_CELLS * size), size, radius)
    distance = point_leg_m(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    return _within(in_cell(points, "x", "y", size), right, distance, radius, point_id, keep_points, min_rows)


def _within(left: DataFrame, right: DataFrame, distance: Column, radius: float, point_id: str, keep_points: bool,
            min_rows: int) -> DataFrame:
    """Points and copies of the other side that share a cell and are within ``radius``."""
    left, right = salted_pair(left, right, CELL, F.col(point_id), hot_keys(left, CELL, min_rows))
    if not keep_points:
        joined = left.join(right, list(PLACE))
        return joined.withColumn("distance_m", distance).where(F.col("distance_m") <= F.lit(float(radius)))
    # The distance is part of the join, so pairs beyond the radius are not handed on.
    right = right.withColumnsRenamed({c: f"__{c}" for c in PLACE})
    near = [F.col(c) == F.col(f"__{c}") for c in PLACE] + [distance <= F.lit(float(radius))]
    return left.join(right, near, "left").drop(*[f"__{c}" for c in PLACE]).withColumn("distance_m", distance)


def points_near_points(points: DataFrame, sites: DataFrame, radius: float, point_id: str, size: float | None = None,
                       keep_points: bool = False, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """All (point, site) pairs within ``radius``; ``sites`` carries sx,sy. See ``points_near_legs``."""
    size = float(size or radius)
    spots = sites.select(*[c for c in sites.columns if c not in ("sx", "sy")],
                         *[F.col(f"s{a}").alias(f"{a}{k}") for k in (1, 2) for a in ("x", "y")])
    right = over_cells(spots, size, radius).drop("x2", "y2")
    distance = planar_m(F.col("x1"), F.col("y1"), F.col("x"), F.col("y"))
    return _within(in_cell(points, "x", "y", size), right, distance, radius, point_id, keep_points, min_rows).drop("x1", "y1")


def nearest_leg_by_class(points: DataFrame, legs: DataFrame, radius: float, point_id: str,
                         class_col: str, classes: Sequence[str], levels: int | None = None,
                         min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Per point and class: distance to the nearest leg within ``radius``, null when there is none.

    The search radius doubles level by level. The first level meets the legs of all classes at once; a point
    that found its nearest leg of a class within a level's radius leaves the search for that class, so dense areas
    are settled with few candidates and only sparse ones reach the full radius. The result is exact, whatever
    the number of ``levels``; by default it follows the density of the legs.
    """
    classes = list(classes)
    lines = legs.select(class_col, "x1", "y1", "x2", "y2").distinct()  # copies cannot change a minimum
    reaches = [radius / 2 ** level for level in range((levels or _search_levels(legs, radius)) - 1, -1, -1)]
    # Cells are twice as wide as the radius: a third of the copies of a leg for a third more candidates.
    # Hot cells of all levels are read off the points in one job.
    hot = hot_keys(points.withColumn("reach", F.explode(F.array(*[F.lit(float(r)) for r in reaches])))
                   .withColumn("cx", F.floor(F.col("x") / (F.col("reach") * 2)))
                   .withColumn("cy", F.floor(F.col("y") / (F.col("reach") * 2))), ["reach", *CELL], min_rows)
    distance = point_leg_m(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])

    def met(state: DataFrame, reach: float, by: Sequence[str]) -> DataFrame:
        left = in_cell(state, "x", "y", 2 * reach)
        right = over_cells(cut_legs(lines, MAX_LEG_CELLS * reach), 2 * reach, reach)
        here = None if hot is None else hot.where(F.col("reach") == reach).drop("reach")
        left, right = salted_pair(left, right, CELL, F.col(point_id), here)
        return (left.join(_spread(right), [*by, *PLACE], "left")
                .withColumn("d", F.when(distance <= F.lit(reach), distance)))

    # Grouping keys contain the join keys, so these aggregations need no second shuffle.
    near = [F.min(F.when(F.col(class_col) == c, F.col("d"))).alias(f"__near{i}") for i, c in enumerate(classes)]
    wide = (met(points, reaches[0], []).groupBy(*PLACE, *[c for c in points.columns if c not in PLACE]).agg(*near)
            .select(*points.columns, *[f"__near{i}" for i in range(len(classes))]))
    wide = stored(wide, "nearest-first")
    state = wide.select(*points.columns, F.explode(F.array(*[
        F.struct(F.lit(c).alias(class_col), F.col(f"__near{i}").alias("nearest_m"))
        for i, c in enumerate(classes)])).alias("__n")).select(*points.columns, "__n.*")
    found = None
    for reach in reaches[1:]:
        waiting = state.where("nearest_m is null")
        if waiting.isEmpty():
            break
        settled = state.where("nearest_m is not null")
        found = settled if found is None else found.unionByName(settled)
        keys = [class_col, *PLACE]
        state = stored(met(waiting.drop("nearest_m"), reach, [class_col])
                       .groupBy(*keys, *[c for c in points.columns if c not in keys])
                       .agg(F.min("d").alias("nearest_m")).select(*points.columns, class_col, "nearest_m"), "nearest")
    return state if found is None else found.unionByName(state)


def _search_levels(legs: DataFrame, radius: float) -> int:
    """Levels from a radius at which a point meets some 64 legs, yet a leg has at most about 64 copies."""
    wide, high = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    r = legs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest(wide, high)).alias("long"),
                 (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"),
                 (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h")).first()
    levels = 4
    if r["n"] and r["w"] is not None and r["h"] is not None:
        area = max(r["w"], 2 * radius) * max(r["h"], 2 * radius)
        while levels < 10:
            reach = radius / 2 ** (levels - 1)
            copies = (r["long"] or 0.0) / reach + 4
            if r["n"] * copies * 4 * reach * reach / area <= 64 or copies > 32:
                break
            levels += 1
    return levels


def snap_to_lines(points: DataFrame, lines: DataFrame, max_m: float, point_id: str, line_id: str,
                  pts: str = "pts", min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Nearest line per point within ``max_m``; ties (to a micrometre) go to the smallest id.

    Points without a line are dropped. Identical legs are merged first: only the smallest id can win.
    """
    legs = (legs_of(lines.select(line_id, pts), pts)
            .groupBy("x1", "y1", "x2", "y2").agg(F.min(line_id).alias(line_id)))
    pairs = points_near_legs(points.select(point_id, "x", "y"), legs, max_m, point_id,
                             size=max(max_m, 100.0), min_rows=min_rows)
    best = (pairs.groupBy(point_id)
            .agg(F.min(F.struct(half_up(F.col("distance_m"), 6).alias("distance_m"),
                                F.col(line_id).alias(line_id))).alias("best")))
    return points.join(best.select(point_id, F.col("best")[line_id].alias(line_id),
                                   F.col("best")["distance_m"].alias("distance_m")), point_id)


def in_areas(points: DataFrame, areas: DataFrame, point_id: str, area_id: str = "area_id",
             size: float = 1000.0, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """(point, area) pairs where the point lies inside the area's rings (even-odd).

    ``areas`` carries ``rings`` as an array of rings, each an array of x,y structs. Areas are spread
    over grid cells, so a point only meets the areas whose box reaches its own cell.
    """
    xs = F.transform(F.flatten(F.col("rings")), lambda p: p["x"])
    ys = F.transform(F.flatten(F.col("rings")), lambda p: p["y"])
    boxed = (areas.select(area_id, "rings", F.array_min(xs).alias("x1"), F.array_max(xs).alias("x2"),
                          F.array_min(ys).alias("y1"), F.array_max(ys).alias("y2")))
    right = over_cells(boxed, size, 0.0)
    left = in_cell(points, "x", "y", size)
    left, right = salted_pair(left, right, CELL, F.col(point_id), hot_keys(left, CELL, min_rows))
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    return (left.join(right, [*CELL, "salt"]).where(inside)
            .where(in_rings(F.col("x"), F.col("y"), F.col("rings")))
            .select(*points.columns, area_id))


def legs_in_cells(legs: DataFrame, size: float) -> DataFrame:
    """The grid cells each leg really passes through (box test plus corner side test)."""
    spread = over_cells(legs, size, 0.0)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = []
    for ox in (0, 1):
        for oy in (0, 1):
            gx, gy = (F.col("cx") + ox) * F.lit(float(size)), (F.col("cy") + oy) * F.lit(float(size))
            sides.append(dx * (gy - F.col("y1")) - dy * (gx - F.col("x1")))
    return spread.where((F.least(*sides) <= 0) & (F.greatest(*sides) >= 0))


def spatially_ordered(df: DataFrame, x: str, y: str, size: float, partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by grid cell, so neighbours are stored and read together."""
    celled = in_cell(df, x, y, size)
    spread = (celled.repartitionByRange(partitions, *CELL) if partitions
              else celled.repartitionByRange(*CELL))
    return spread.sortWithinPartitions(*CELL).drop(*CELL)


# --- clusters ------------------------------------------------------------------------------------
def cluster_points(points: DataFrame, eps: float, point_id: str = "facility_id") -> DataFrame:
    """Connected components of "within ``eps``" (density clustering with one point per core).

    Points are grouped into cells whose diagonal is ``eps``: points of one cell are connected without
    looking at pairs. Only neighbouring cells need a test, and cell pairs whose occupied sub-boxes
    settle the question either way skip the point test. Labels then spread over the cell graph,
    each round ending in a reliable checkpoint.
    """
    from kerbside.session import ensure_checkpoint_dir

    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    side = eps / 2 ** 0.5 * 0.999999
    places = in_cell(points.select("x", "y").distinct(), "x", "y", side).withColumn(
        "node", F.concat_ws(":", "cx", "cy"))
    fine = side / 8
    boxes = (places.withColumn("bx", cell(F.col("x"), fine)).withColumn("by", cell(F.col("y"), fine))
             .groupBy("node", *CELL, "bx", "by")
             .agg(F.min("x").alias("xa"), F.max("x").alias("xb"),
                  F.min("y").alias("ya"), F.max("y").alias("yb")))
    # Half of the 24 surrounding cells is enough: the relation is symmetric.
    around = F.explode(F.array(*[
        F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
        for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]))

    def shifted(df: DataFrame, names: Sequence[str]) -> DataFrame:
        return (df.withColumn("o", around)
                .select((F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"),
                        *[F.col(n).alias(f"{n}_2") for n in names]))

    met = boxes.join(shifted(boxes, ["node", "bx", "by", "xa", "xb", "ya", "yb"]), list(CELL))
    gap_x = F.greatest(F.col("xa") - F.col("xb_2"), F.col("xa_2") - F.col("xb"), F.lit(0.0))
    gap_y = F.greatest(F.col("ya") - F.col("yb_2"), F.col("ya_2") - F.col("yb"), F.lit(0.0))
    far_x = F.greatest(F.col("xb") - F.col("xa_2"), F.col("xb_2") - F.col("xa"))
    far_y = F.greatest(F.col("yb") - F.col("ya_2"), F.col("yb_2") - F.col("ya"))
    limit = F.lit(eps * eps)
    judged = (met.where(gap_x * gap_x + gap_y * gap_y <= limit)
              .withColumn("sure", far_x * far_x + far_y * far_y <= limit))
    sure = judged.groupBy("node", "node_2").agg(F.max("sure").alias("sure"))
    open_boxes = (judged.join(sure.where(~F.col("sure")).select("node", "node_2"), ["node", "node_2"])
                  .select("node", "bx", "by", "node_2", "bx_2", "by_2"))
    boxed = places.withColumn("bx", cell(F.col("x"), fine)).withColumn("by", cell(F.col("y"), fine))
    tested = (open_boxes.join(boxed.select("node", "bx", "by", "x", "y"), ["node", "bx", "by"])
              .join(boxed.select(F.col("node").alias("node_2"), F.col("bx").alias("bx_2"),
                                 F.col("by").alias("by_2"), F.col("x").alias("x_2"), F.col("y").alias("y_2")),
                    ["node_2", "bx_2", "by_2"])
              .where(planar_m(F.col("x"), F.col("y"), F.col("x_2"), F.col("y_2")) <= F.lit(float(eps)))
              .select("node", "node_2"))
    pairs = sure.where("sure").select("node", "node_2").unionByName(tested).distinct()
    edges = pairs.unionByName(pairs.select(F.col("node_2").alias("node"), F.col("node").alias("node_2"))) \
        .checkpoint()
    labels = connected_labels(places.select("node").distinct(), edges)
    located = in_cell(points, "x", "y", side).withColumn("node", F.concat_ws(":", "cx", "cy"))
    named = lookup_join(located, labels.select("node", F.col("label").alias("cluster_id")), ["node"],
                        F.col(point_id), "inner")
    return named.drop("node", *CELL)


def connected_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node name of each connected component; ``edges`` lists both directions.

    Each node points to a smaller-named node. Per round the smallest grandparent among a node's neighbours
    is offered to the node and to the node it points to, and pointers are shortened, so whole trees merge at
    once and the number of rounds grows with the logarithm of the longest chain.
    """
    from kerbside.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(nodes.sparkSession)
    labels = nodes.select("node", F.col("node").alias("label")).checkpoint()
    while True:
        # One label may cover a third of the nodes, so this lookup is the skew-safe kind.
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        pointed = lookup_join(labels, parents, ["label"], F.col("node"), "inner")
        offered = (edges.join(pointed.select(F.col("node").alias("node_2"), F.col("top").alias("offer")), "node_2")
                   .groupBy("node").agg(F.min("offer").alias("offer")))
        reach = pointed.join(offered, "node", "left")
        # (node to change, its present label where the row is its own, new label)
        moves = F.explode(F.array(
            F.struct(F.col("node").alias("node"), F.col("label").alias("old"),
                     F.least("top", F.coalesce("offer", "top")).alias("new")),
            F.struct(F.col("label").alias("node"), F.lit(None).cast("string").alias("old"),
                     F.coalesce("offer", "label").alias("new"))))
        moved = (reach.select(moves.alias("m")).groupBy(F.col("m.node").alias("node"))
                 .agg(F.max("m.old").alias("old"), F.min("m.new").alias("label")).checkpoint())
        labels = moved.select("node", "label")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return labels
