"""Table writes: versioned replace, keyed upsert, column families, partitions and snapshots.

A table is a folder with one sub-folder per version and a small ``_current`` file naming the live one. A
write builds a complete new version first and then replaces that file, so a failed job leaves the old
table readable and readers never see a half-written one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.vocab import STAGING_TABLES


# --- version pointer -----------------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _read_pointer(spark: SparkSession, path: str) -> str | None:
    fs, pointer = _fs(spark, f"{path}/_current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the live version, or None for a table not yet written."""
    name = _read_pointer(spark, path)
    return None if name is None else f"{path}/{name}"


class ConflictingWrite(RuntimeError):
    """Another writer has published a version since the one this write builds on."""


ANY = object()


def _publish(spark: SparkSession, path: str, content: str, built_on: object = ANY) -> None:
    """Replace the pointer file in one rename; refuse if it no longer reads ``built_on``."""
    if built_on is not ANY and _read_pointer(spark, path) != built_on:
        raise ConflictingWrite(f"{path} has changed since it was read")
    fs, pointer = _fs(spark, f"{path}/_current")
    _, staged = _fs(spark, f"{path}/_next-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(content.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(staged, pointer, options)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version of {path} has been published")
    return spark.read.parquet(version)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), allow_empty: bool = True, built_on: object = ANY) -> str:
    """Write a full new version and make it the live one; the old version survives a failure.

    A writer that read the table first passes the version it read as ``built_on`` and must start again if
    another one came in between.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{version}")
    if not allow_empty and spark.read.schema(df.schema).parquet(f"{path}/{version}").isEmpty():
        raise ValueError(f"refusing to replace {path} by an empty table")
    _publish(spark, path, version, built_on)
    return f"{path}/{version}"


def replace_segments(df: DataFrame, path: str, dependents: Mapping[str, DataFrame]) -> None:
    """Replace the segment table and empty every table that refers to it (given with its schema)."""
    replace_table(df, path)
    for dependent, schema_of in dependents.items():
        replace_table(schema_of.limit(0), dependent)


# --- merging rows ----------------------------------------------------------------------------------------
def last_per_key(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """One row per key: the last in ``order`` (an aggregate, so repeats combine before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.lit(0) if order is None else order
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("row"))
    return packed.select(*[F.col(k) if k in keys else F.col("row")[k].alias(k) for k in df.columns])


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, plus all of ``new``."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*new.columns).unionByName(new)


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: Column | None = None,
           partition_by: Sequence[str] = ()) -> str:
    """Insert or overwrite by key; of several incoming rows per key the last one counts."""
    incoming = last_per_key(df, keys, order)
    spark = df.sparkSession
    before = _read_pointer(spark, path)
    if before is None:
        return replace_table(incoming, path, partition_by, built_on=None)
    return replace_table(merged(spark.read.parquet(f"{path}/{before}"), incoming, keys), path, partition_by, built_on=before)


def _manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """Live folder of every partition, relative to the table."""
    text = _read_pointer(spark, path)
    return json.loads(text) if text else {}


def upsert_partitions(df: DataFrame, path: str, keys: Sequence[str], partition: str,
                      order: Column | None = None) -> None:
    """Upsert into a partitioned table, reading and rewriting only the partitions the batch touches.

    The pointer file maps each partition to its folder. One job writes the touched partitions to a new
    folder, then the pointer is replaced, so all of them change at once or not at all. Meant for small
    frequent batches: the partitions named here are the days of one batch.
    """
    spark = df.sparkSession
    incoming = last_per_key(df, keys, order).withColumn("__part", F.col(partition).cast("string")).persist()
    try:
        touched = sorted(r["__part"] for r in incoming.select("__part").distinct().toLocalIterator())
        if not touched:
            return
        manifest = _manifest(spark, path)
        old = [f"{path}/{manifest[p]}" for p in touched if p in manifest]
        rows = incoming
        if old:
            kept = spark.read.schema(df.schema).parquet(*old).join(incoming.select(*keys), list(keys), "left_anti")
            rows = kept.select(*df.columns).withColumn("__part", F.col(partition).cast("string")).unionByName(incoming)
        version = f"v-{uuid.uuid4().hex}"
        # One file set per partition: rows of a partition meet in the shuffle, which splits it by its measured size.
        rows.hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{path}/{version}")
        _publish(spark, path, json.dumps({**manifest, **{p: f"{version}/__part={p}" for p in touched}}),
                 json.dumps(manifest) if manifest else None)
    finally:
        incoming.unpersist()


def partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of the live partitions, in order; no folder is opened for this."""
    return sorted(_manifest(spark, path))


def read_partitions(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Live partitions of a table written by ``upsert_partitions``, from ``first`` to ``last`` where given."""
    manifest = _manifest(spark, path)
    if not manifest:
        raise FileNotFoundError(f"no partition of {path} has been published")
    wanted = [folder for p, folder in sorted(manifest.items()) if (first is None or p >= first) and (last is None or p <= last)]
    if not wanted:
        return spark.read.parquet(f"{path}/{next(iter(manifest.values()))}").limit(0)
    return spark.read.parquet(*[f"{path}/{folder}" for folder in wanted])


def expire_versions(spark: SparkSession, path: str, older_than_hours: float) -> list[str]:
    """Delete versions of a table that are not live and were written longer ago than any reader may still run."""
    fs, folder = _fs(spark, path)
    text = _read_pointer(spark, path) or ""
    live = {f.split("/")[0] for f in (json.loads(text).values() if text.startswith("{") else [text])}
    limit = (time.time() - older_than_hours * 3600) * 1000
    gone = [s.getPath() for s in fs.listStatus(folder)
            if s.getPath().getName().startswith("v-") and s.getPath().getName() not in live and s.getModificationTime() < limit]
    for old in gone:
        fs.delete(old, True)
    return sorted(old.getName() for old in gone)


def merge_family(scores: DataFrame | None, update: DataFrame, columns: Sequence[str], key: str = "segment_id",
                 reset: bool = False) -> DataFrame:
    """Overwrite one family of columns of the wide score table.

    Rows in ``update`` take its values, null included; rows it does not mention keep what they had, unless
    ``reset`` clears the family first. New keys are added.
    """
    fresh = update.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    if scores is None:
        return update.select(key, *columns)
    both = scores.join(fresh, key, "full_outer")
    others = [c for c in scores.columns if c != key and c not in columns]
    kept = [F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(
        F.lit(None) if reset or c not in scores.columns else F.col(c)).alias(c) for c in columns]
    return both.select(key, *others, *kept)


def replace_partition(df: DataFrame, path: str, column: str = "source") -> None:
    """Overwrite only the partitions present in ``df`` of a plainly partitioned table."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def replace_source(df: DataFrame, path: str, source: str, column: str = "source") -> None:
    """Replace all rows of one source, also by none at all; other sources stay.

    The rows go to a folder of their own and the pointer file, which names the live folder of every source, is
    replaced at once: readers (``read_partitions``) see the old rows or the new ones.
    """
    spark = df.sparkSession
    before = _read_pointer(spark, path)
    manifest, version = json.loads(before) if before else {}, f"v-{uuid.uuid4().hex}"
    foreign = F.when(F.col(column).eqNullSafe(F.lit(source)), F.col(column)).otherwise(
        F.raise_error(F.lit(f"a row is not of the source {source}")))
    df.withColumn(column, foreign.cast(df.schema[column].dataType)).write.parquet(f"{path}/{version}")
    _publish(spark, path, json.dumps({**manifest, source: version}), before)


def write_snapshot(bands: DataFrame, path: str) -> None:
    """Replace the (hazard, observed_at) snapshots contained in ``bands``; other snapshots stay."""
    stamped = bands.withColumn("snapshot_us", F.unix_micros("observed_at")).withColumn("hazard_key", F.col("hazard"))
    (stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("hazard_key", "snapshot_us").parquet(path))


def append_rows(df: DataFrame, path: str, schema: str) -> None:
    """Append after checking that the columns fit the table's schema."""
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    problems = [f.name for f in wanted if f.name not in df.columns
                or df.schema[f.name].dataType.simpleString() != f.dataType.simpleString()]
    if problems or len(df.columns) != len(wanted):
        raise ValueError(f"columns do not fit the table: {problems or df.columns}")
    df.select(*[f.name for f in wanted]).write.mode("append").parquet(path)


def append_routes(rows: DataFrame, path: str) -> None:
    """Add routes to the history; their ids carry the time of their computation, so nothing is replaced."""
    from kerbside.operators.routes import ROUTE_SCHEMA

    append_rows(rows, path, ROUTE_SCHEMA)


def union_readings(*feeds: DataFrame) -> DataFrame:
    """All reading feeds, one row per (hazard, station, time); later feeds overwrite earlier ones."""
    keys = ["hazard", "station_id", "observed_at"]
    columns = [*keys, "source", "value", "unit"]
    stacked = None
    for i, feed in enumerate(feeds):
        part = feed.select(*columns, F.lit(i).alias("__feed"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return last_per_key(stacked, keys, F.struct("__feed", "source", "value", "unit")).drop("__feed")


def union_facilities(tri: DataFrame, echo: DataFrame) -> DataFrame:
    """Both facility feeds, the last row per (source, source_id) in file order (``row_order``)."""
    both = tri.unionByName(echo)
    return last_per_key(both, ["source", "source_id"], F.col("row_order")).drop("row_order")


def upsert_images(images: DataFrame, segments: DataFrame, path: str) -> str:
    """Store freshly harvested images with their segment; those without one nearby disappear.

    A re-harvested image loses its old segment first, so it is kept only if it snaps again.
    """
    from kerbside.operators.imagery import snap_images

    snapped = snap_images(images, segments).drop("snap_distance_m")
    spark = images.sparkSession
    if current_version(spark, path) is None:
        return replace_table(snapped, path)
    untouched = read_table(spark, path).join(images.select("image_id"), "image_id", "left_anti")
    return replace_table(untouched.unionByName(snapped), path)


def export_runtime(spark: SparkSession, source: str, target: str, tables: Sequence[str],
                   drop: Sequence[str] = STAGING_TABLES) -> list[str]:
    """Copy the tables a serving system needs; staging tables are left out."""
    kept = [t for t in tables if t not in drop]
    for table in kept:
        replace_table(read_table(spark, f"{source}/{table}"), f"{target}/{table}")
    return kept
