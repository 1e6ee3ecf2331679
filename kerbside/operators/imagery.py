"""Street imagery: snapping, sampling along routes, scoring of frames and segment features."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.geo import angle_diff, bearing_deg, leg_array, planar_m
from kerbside.functions.numbers import clamp, half_up, recency_weight
from kerbside.functions.rules import is_daylight
from kerbside.operators.ranking import drop_repeats, number_rows, running_length, weighted_lower_median
from kerbside.operators.skew import HOT_MIN_ROWS, lookup_join
from kerbside.operators.spatial import PLACE, points_near_points, snap_to_lines
from kerbside.session import stored
from kerbside.vocab import (BEARING_SPAN_M, BEARING_TOLERANCE_DEG, EGO_BACKFILL_CAR_FRACTION, EGO_BAND_FRACTION,
                            IMAGE_SNAP_M, MAX_EGO_FRACTION, MIN_INSTANCE_FRACTION, MIN_INSTANCE_PIXELS,
                            MODEL_VERSION, PERSON_CLASSES, SAMPLE_INTERVAL_M, SAMPLE_RADIUS_M, TAU_YEARS_CROWD,
                            TAU_YEARS_SKY, VEHICLE_CLASSES)


# --- placing images --------------------------------------------------------------------------------
def snap_images(images: DataFrame, segments: DataFrame, max_m: float = IMAGE_SNAP_M,
                min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Images with their nearest segment; images farther than ``max_m`` from any are dropped."""
    snapped = snap_to_lines(images.drop("nearest_segment_id"), segments, max_m, "image_id", "segment_id",
                            min_rows=min_rows)
    return (snapped.withColumnRenamed("segment_id", "nearest_segment_id")
            .withColumnRenamed("distance_m", "snap_distance_m"))


def route_steps(routes: DataFrame, interval_m: float = SAMPLE_INTERVAL_M,
                span_m: float = BEARING_SPAN_M) -> DataFrame:
    """Points every ``interval_m`` along each route with the heading there.

    Every leg produces the step points (and the points ``span_m`` before and after a step) that fall on
    it, so the work is linear in legs plus steps and a long route is spread over many rows. Only steps
    whose points lie on several legs are grouped.
    """
    legs = (routes.select("route_id", F.posexplode(leg_array(F.col("pts"))).alias("pos", "leg"))
            .select("route_id", "pos", "leg.*")
            .withColumn("leg_m", planar_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))))
    run = running_length(legs, "route_id", "pos", "leg_m", "end_m")
    total = run.groupBy("route_id").agg(F.max("end_m").alias("length_m"))
    placed = lookup_join(run, total, ["route_id"], F.col("pos"), "inner", hot_source=legs).withColumn(
        "start_m", F.col("end_m") - F.col("leg_m"))
    first = F.greatest(F.floor((F.col("start_m") - span_m) / interval_m), F.lit(0))
    last = F.least(F.ceil((F.col("end_m") + span_m) / interval_m), F.floor(F.col("length_m") / interval_m))
    stepped = (placed.where(first <= last).withColumn("step", F.explode(F.sequence(first, last))))
    at = F.col("step") * F.lit(float(interval_m))
    stepped = (stepped.withColumn("t0", at).withColumn("t1", F.greatest(at - span_m, F.lit(0.0)))
               .withColumn("t2", F.least(at + span_m, F.col("length_m"))))
    # Most steps lie on one leg with both their points and need no grouping. The margin keeps rounded ends of legs out.
    margin = 1e-6
    whole = ((F.col("leg_m") > 0) & ((F.col("t1") >= F.col("start_m") + margin) | (F.col("t1") == 0) & (F.col("start_m") == 0))
             & ((F.col("t2") < F.col("end_m") - margin) | (F.col("t2") == F.col("length_m")) & (F.col("end_m") == F.col("length_m"))))

    def on(axis: str, t: Column) -> Column:
        share = F.when(F.col("leg_m") > 0, (t - F.col("start_m")) / F.col("leg_m")).otherwise(F.lit(0.0))
        return F.col(f"{axis}1") + (F.col(f"{axis}2") - F.col(f"{axis}1")) * share

    at_once = stepped.where(whole).select(
        "route_id", "step", *[on(a, F.col(f"t{k}")).alias(f"at_{a}{k}") for k in (0, 1, 2) for a in ("x", "y")])
    targets = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"t{k}").alias("t")) for k in (0, 1, 2)]))
    spots = stepped.where(~whole).withColumn("target", targets).select("*", "target.kind", "target.t")
    on_leg = ((F.col("t") >= F.col("start_m")) & (F.col("t") < F.col("end_m"))
              | (F.col("leg_m") > 0) & (F.col("end_m") == F.col("length_m")) & (F.col("t") == F.col("length_m"))
              | (F.col("length_m") == 0) & (F.col("pos") == 0))
    points = spots.where(on_leg).select("route_id", "step", "kind", on("x", F.col("t")).alias("x"), on("y", F.col("t")).alias("y"))

    def pick(kind: int, axis: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(axis)))

    wide = points.groupBy("route_id", "step").agg(
        *[pick(k, a).alias(f"at_{a}{k}") for k in (0, 1, 2) for a in ("x", "y")]).unionByName(at_once)
    return wide.select(
        "route_id", "step", (F.col("step") * F.lit(float(interval_m))).alias("distance_offset_m"),
        F.col("at_x0").alias("x"), F.col("at_y0").alias("y"),
        F.coalesce(bearing_deg(F.col("at_x1"), F.col("at_y1"), F.col("at_x2"), F.col("at_y2")), F.lit(0.0))
        .alias("bearing_deg"))


def sample_route_images(routes: DataFrame, images: DataFrame, radius: float = SAMPLE_RADIUS_M,
                        tolerance_deg: float = BEARING_TOLERANCE_DEG,
                        min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """The image that faces along the route at each step, with repeats of the previous frame dropped.

    Of several images the nearest wins, ties by image id. Images sharing position and heading are
    merged first, keeping the smallest id, which is the only one that could win. Steps and frames are
    stored, since counting hot cells and both window operators read them more than once.
    """
    steps = stored(route_steps(routes), "route-steps").withColumn("step_key", F.struct("route_id", "step"))
    sites = (images.groupBy(F.col("x").alias("sx"), F.col("y").alias("sy"), "compass_angle")
             .agg(F.min("image_id").alias("image_id")))
    pairs = points_near_points(steps, sites, radius, "step_key", min_rows=min_rows)
    facing = pairs.where(angle_diff(F.col("compass_angle"), F.col("bearing_deg")) <= tolerance_deg)
    best = (facing.groupBy(*PLACE, "route_id", "step")
            .agg(F.min(F.struct(half_up(F.col("distance_m"), 6).alias("image_distance_m"),
                                F.col("image_id"))).alias("best"),
                 F.first("distance_offset_m").alias("distance_offset_m"),
                 F.first("bearing_deg").alias("bearing_deg"))
            .select("route_id", "step", "distance_offset_m", "bearing_deg",
                    F.col("best.image_id").alias("image_id"),
                    F.col("best.image_distance_m").alias("image_distance_m")))
    kept = drop_repeats(stored(best, "nearest-images"), "route_id", "step", "image_id")
    return number_rows(stored(kept, "kept-images"), "route_id", "step", "seq")


# --- what still needs scoring ----------------------------------------------------------------------
def hist_value(histogram: Column, name: str, default: float = 0.0) -> Column:
    return F.coalesce(histogram[name].cast("double"), F.lit(default))


def unscored_images(images: DataFrame, analyses: DataFrame, model: str = MODEL_VERSION,
                    limit: int | None = None) -> DataFrame:
    """Snapped images without a usable analysis by this model, newest first.

    An older analysis without the ego measurement is usable only when few of its pixels are cars.
    """
    usable = analyses.where(
        (F.col("model_version") == model)
        & (F.col("ego_vehicle_frac").isNotNull()
           # The stored share is 32-bit and is compared as such against a 64-bit limit.
           | (hist_value(F.col("raw_class_hist"), "car").cast("float").cast("double")
              <= F.lit(EGO_BACKFILL_CAR_FRACTION))))
    waiting = images.where(F.col("nearest_segment_id").isNotNull()).join(
        usable.select("image_id").distinct(), "image_id", "left_anti")
    return newest(waiting, limit)


def newest(images: DataFrame, n: int | None = None) -> DataFrame:
    ordered = images.orderBy(F.desc("captured_at"), "image_id")
    return ordered if n is None else ordered.limit(n)


def unscored_frames(frames: DataFrame, analyses: DataFrame, model: str = MODEL_VERSION) -> DataFrame:
    """Frames of route analyses whose image this model has not scored."""
    done = analyses.where(F.col("model_version") == model).select("image_id").distinct()
    return frames.join(done, "image_id", "left_anti").orderBy("analysis_id", "seq")


def frame_detail(frames: DataFrame, images: DataFrame, analyses: DataFrame, model: str = MODEL_VERSION,
                 min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Frames with their image and, where scored, the image's metrics."""
    pictures = images.select("image_id", "x", "y", "thumb_url")
    metrics = analyses.where(F.col("model_version") == model).select(
        "image_id", "sky_view_factor", "vegetation_frac", "sidewalk_frac", "vehicle_count", "person_count")
    # A popular image is part of many frames: both lookups tolerate a hot image id.
    known = lookup_join(frames, pictures, ["image_id"], F.struct("analysis_id", "seq"), "inner", min_rows)
    scored = lookup_join(known, metrics, ["image_id"], F.struct("analysis_id", "seq"), "left", min_rows)
    return scored.withColumn("scored", F.col("sky_view_factor").isNotNull())


def frame_coverage(frames: DataFrame, interval_m: float = SAMPLE_INTERVAL_M) -> DataFrame:
    return frames.groupBy("analysis_id").agg(
        F.count_if("scored").alias("scored_count"),
        (F.count(F.lit(1)) * F.lit(float(interval_m))).alias("covered_m"))


def analysis_status(analyses: DataFrame, frames: DataFrame) -> DataFrame:
    """no_imagery without frames, ready when every frame is scored, else pending."""
    progress = frames.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.count_if(~F.col("scored")).alias("pending_count"))
    return (analyses.join(progress, "analysis_id", "left")
            .withColumn("frame_count", F.coalesce("frame_count", F.lit(0)))
            .withColumn("pending_count", F.coalesce("pending_count", F.lit(0)))
            .withColumn("status", F.when(F.col("frame_count") == 0, "no_imagery")
                        .when(F.col("pending_count") == 0, "ready").otherwise("pending")))


# --- segment features ------------------------------------------------------------------------------
def crowd_density(histogram: Column) -> Column:
    """Share of pixels covered by vehicles and people."""
    names = [*VEHICLE_CLASSES, *PERSON_CLASSES]
    total = sum((hist_value(histogram, n) for n in names[1:]), hist_value(histogram, names[0]))
    return F.when(histogram.isNull(), F.lit(0.0)).otherwise(clamp(total, 0.0, 1.0))


def scored_frames(images: DataFrame, analyses: DataFrame, model: str = MODEL_VERSION) -> DataFrame:
    """Snapped images with their metrics and whether they were taken in daylight."""
    metrics = analyses.where(F.col("model_version") == model).select(
        "image_id", "sky_view_factor", crowd_density(F.col("raw_class_hist")).alias("crowd_density"),
        F.coalesce(F.col("ego_vehicle_frac"), F.lit(0.0)).cast("double").alias("ego_vehicle_frac"))
    placed = images.where(F.col("nearest_segment_id").isNotNull()).select(
        "image_id", F.col("nearest_segment_id").alias("segment_id"), "captured_at")
    return placed.join(metrics, "image_id").withColumn("daylight", is_daylight(F.col("captured_at")))


def daylight(frames: DataFrame, enabled: bool = True) -> DataFrame:
    return frames.where("daylight") if enabled else frames


def dark_count(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count_if(~F.col("daylight")).alias("excluded_dark_count"))


def image_features(frames: DataFrame, as_of: Column) -> DataFrame:
    """Recency-weighted lower medians of sky view and crowding per segment.

    Frames that mostly show the camera car are left out of crowding unless a segment has no others.
    """
    weighted = (frames.withColumn("sky_w", recency_weight(F.col("captured_at"), as_of, TAU_YEARS_SKY))
                .withColumn("crowd_w", recency_weight(F.col("captured_at"), as_of, TAU_YEARS_CROWD))
                .withColumn("usable", F.col("ego_vehicle_frac") <= MAX_EGO_FRACTION))
    counts = frames.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.max(F.col("ego_vehicle_frac") <= MAX_EGO_FRACTION).alias("any_usable"))
    sky = weighted_lower_median(weighted, "segment_id", "sky_view_factor", "sky_w", "sky_view_factor_raw")
    judged = lookup_join(weighted, counts, ["segment_id"], F.col("image_id"), "inner")
    crowd = weighted_lower_median(judged.where(F.col("usable") | ~F.col("any_usable")), "segment_id",
                                  "crowd_density", "crowd_w", "crowd_density_raw")
    return (sky.join(crowd, "segment_id").join(counts.select("segment_id", "frame_count"), "segment_id"))


# --- label masks -----------------------------------------------------------------------------------
def _pixel_runs(masks: DataFrame) -> DataFrame:
    """Pixel counts per image, row and class: the form every mask measure is computed from."""
    pixels = masks.select("image_id", "height", "width", F.posexplode("mask").alias("pos", "class_id"))
    return (pixels.withColumn("row", F.floor(F.col("pos") / F.col("width")).cast("int"))
            .groupBy("image_id", "height", "width", "row", "class_id").agg(F.count(F.lit(1)).alias("n")))


def label_names(class_id: Column, labels: Mapping[int, str]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(table[class_id.cast("int")], F.concat(F.lit("class_"), class_id.cast("string")))


def class_histogram(masks: DataFrame, labels: Mapping[int, str]) -> DataFrame:
    """Fraction of pixels per label as a map, rounded to 6 places."""
    counted = _pixel_runs(masks).groupBy("image_id", "height", "width", "class_id").agg(F.sum("n").alias("n"))
    share = F.bround(F.col("n") / (F.col("height") * F.col("width")), 6)
    # A label map has as many entries as there are classes, never as many as pixels.
    entry = F.struct(label_names(F.col("class_id"), labels).alias("key"), share.alias("value"))
    return counted.groupBy("image_id").agg(F.map_from_entries(F.collect_list(entry)).alias("class_fractions"))


def frame_metrics(masks: DataFrame, labels: Mapping[int, str]) -> DataFrame:
    """Sky view factor, ego-vehicle share and the main class fractions of each mask."""
    ids = {name: [i for i, n in labels.items() if n == name] for name in set(labels.values())}

    def any_of(names: Sequence[str]) -> Column:
        wanted = [i for n in names for i in ids.get(n, [])]
        return F.col("class_id").isin(wanted) if wanted else F.lit(False)

    runs = _pixel_runs(masks)
    height, width = F.col("height"), F.col("width")
    # Row weights fall evenly from 1 at the top to 0 at the bottom; a single row weighs 1.
    weight = F.when(height > 1, F.lit(1.0) - F.col("row") / (height - 1)).otherwise(F.lit(1.0))
    weight_sum = F.when(F.first(height) > 1, F.first(height) / 2.0).otherwise(F.lit(1.0)) * F.first(width)
    band = F.greatest(F.bround(height * F.lit(EGO_BAND_FRACTION)), F.lit(1.0))
    in_band = F.col("row") >= height - band
    total = F.first(height) * F.first(width)

    def fraction(name: str) -> Column:
        return F.bround(F.sum(F.when(any_of([name]), F.col("n")).otherwise(0)) / total, 6)

    sky = F.sum(F.when(any_of(["sky"]), weight * F.col("n")).otherwise(F.lit(0.0)))
    ego = F.sum(F.when(any_of(VEHICLE_CLASSES) & in_band, F.col("n")).otherwise(0))
    band_pixels = F.greatest(F.bround(F.first(height) * F.lit(EGO_BAND_FRACTION)), F.lit(1.0)) * F.first(width)
    return runs.groupBy("image_id").agg(
        F.bround(clamp(sky / weight_sum, 0.0, 1.0), 6).alias("sky_view_factor"),
        F.bround(ego / band_pixels, 6).alias("ego_vehicle_frac"),
        fraction("vegetation").alias("vegetation_frac"), fraction("sky").alias("sky_frac"),
        fraction("road").alias("road_frac"), fraction("sidewalk").alias("sidewalk_frac"))


def _components(hit: np.ndarray, minimum: float) -> int:
    """8-connected components of at least ``minimum`` pixels, by spreading labels over the array."""
    labels = np.where(hit, np.arange(1, hit.size + 1).reshape(hit.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        around = np.max([padded[i:i + hit.shape[0], j:j + hit.shape[1]]
                         for i in range(3) for j in range(3)], axis=0)
        spread = np.where(hit, around, 0)
        if (spread == labels).all():
            break
        # Jump to the label of the pixel a label names: long shapes settle in few passes.
        flat = np.concatenate([[0], spread.ravel()])
        labels = np.where(hit, flat[spread], 0)
    _, areas = np.unique(labels[hit], return_counts=True)
    return int((areas >= minimum).sum())


def instance_counts(masks: DataFrame, labels: Mapping[int, str]) -> DataFrame:
    """Vehicles and people per mask as connected blobs above the speckle size.

    Frames are independent rows, so this is a map over Arrow batches without a shuffle.
    """
    groups = {"vehicle_count": [i for i, n in labels.items() if n in VEHICLE_CLASSES],
              "person_count": [i for i, n in labels.items() if n in PERSON_CLASSES]}
    schema = T.StructType([masks.schema["image_id"], T.StructField("vehicle_count", T.IntegerType()),
                           T.StructField("person_count", T.IntegerType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"image_id": batch["image_id"], "vehicle_count": [], "person_count": []}
            for mask, height, width in zip(batch["mask"], batch["height"], batch["width"]):
                grid = np.asarray(mask).reshape(height, width)
                minimum = max(float(MIN_INSTANCE_PIXELS), grid.size * MIN_INSTANCE_FRACTION)
                for name, wanted in groups.items():
                    hit = np.isin(grid, wanted)
                    out[name].append(_components(hit, minimum) if hit.any() else 0)
            yield pd.DataFrame(out)

    return masks.select("image_id", "height", "width", "mask").mapInPandas(count, schema)


def score_masks(masks: DataFrame, labels: Mapping[int, str], model: str = MODEL_VERSION) -> DataFrame:
    """Complete analysis rows for a table of label masks (rows whose mask has the wrong size are left out)."""
    good = masks.where(F.size("mask") == F.col("height") * F.col("width"))
    return (frame_metrics(good, labels).join(class_histogram(good, labels), "image_id")
            .join(instance_counts(good, labels), "image_id")
            .withColumnRenamed("class_fractions", "raw_class_hist")
            .withColumn("model_version", F.lit(model)))


def bad_masks(masks: DataFrame) -> DataFrame:
    """Masks that do not match their image's dimensions, for reporting."""
    return masks.where(F.coalesce(F.size("mask") != F.col("height") * F.col("width"), F.lit(True))) \
        .select("image_id", F.lit("mask does not match its image dimensions").alias("reason"))


def segment_images(images: DataFrame, segmenter, input_col: str = "image", batch_size: int = 32) -> DataFrame:
    """Run a segmentation model over image tensors.

    ``segmenter`` is a zero-argument function that loads the model on the executor and returns a batch
    function, as ``pyspark.ml.functions.predict_batch_udf`` expects; it yields flat label masks.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(segmenter, return_type=T.ArrayType(T.IntegerType()), batch_size=batch_size)
    return images.withColumn("mask", predict(F.col(input_col)))


def class_manifest(images: DataFrame, masks: DataFrame, labels: Mapping[int, str], sample: int) -> DataFrame:
    """Classes seen in the newest ``sample`` snapped images and each image's fractions.

    Fails when used if fewer snapped images exist than asked for.
    """
    if sample <= 0:
        raise ValueError("sample must be positive")
    snapped = images.where(F.col("nearest_segment_id").isNotNull())
    picked = newest(snapped, sample).select("image_id")
    fractions = class_histogram(masks.join(picked, "image_id", "left_semi"), labels)
    found = picked.agg(F.count(F.lit(1))).scalar()
    seen = fractions.select(F.explode(F.map_keys("class_fractions")).alias("label")).distinct()
    classes = seen.agg(F.array_join(F.array_sort(F.collect_set("label")), ",")).scalar()
    return (fractions.withColumn("detected_classes", classes)
            .withColumn("sample_count", F.when(
                found < sample, F.raise_error(F.lit(f"need {sample} snapped images")).cast("long"))
                .otherwise(found)))
