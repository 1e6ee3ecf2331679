"""The live clock as batch jobs, for schedules without a running stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from kerbside import sinks
from kerbside.operators import live, profiles
from kerbside.session import stored
from kerbside.streaming.jobs import store_readings


def ingest(root: str, *feeds: DataFrame) -> str:
    """Store all feeds' readings by day, as the streams do; on equal keys later feeds win."""
    path = f"{root}/citywide_reading"
    store_readings(sinks.union_readings(*feeds), path)
    return path


def refresh_fields(spark: SparkSession, root: str, cells: DataFrame, permits: DataFrame, as_of: Column,
                   size: float | None = None) -> DataFrame:
    """Rebuild hazard fields from the stored readings, streamed or not, and return the current ones.

    With ``size``, the side of the routing grid's cells, the areas' cells are stored with the snapshot too.
    """
    means = live.citywide_means(sinks.read_partitions(spark, f"{root}/citywide_reading"), as_of)
    raster = live.hazard_bands(cells, means)
    bands = stored(live.budget_fields(live.union_bands(raster, live.construction_bands(permits, as_of))), "bands")
    if size is not None:
        sinks.write_snapshot(live.field_cells(cells, means, permits, bands, as_of, size), f"{root}/hazard_field_cell")
    sinks.write_snapshot(bands, f"{root}/hazard_field")
    return live.current_fields(spark.read.parquet(f"{root}/hazard_field"), as_of)


def streets_in_fields(spark: SparkSession, root: str, legs: DataFrame, as_of: Column, size: float) -> DataFrame:
    """(edge, hazard, severity) of the streets that current hazard areas touch, from the stored snapshot."""
    cells = live.newest_snapshots(spark.read.parquet(f"{root}/hazard_field_cell"), as_of)
    return profiles.edges_in_areas(legs, cells.select("hazard", "severity", "cx", "cy"), size)


def refresh_permits(located: DataFrame, root: str) -> None:
    """Replace one source's permits, leaving other sources alone."""
    sinks.replace_source(located, f"{root}/construction_permit", "nyc_dob_now")


def replace_alerts(alerts: DataFrame, root: str) -> str:
    return sinks.replace_table(alerts, f"{root}/nws_alert")
