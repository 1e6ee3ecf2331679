"""Line dedup: a line that several alerts share stays only in the first of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import SPACES, ascii_lower, text_of


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the positions in the sorted array ``dropped``: the runs between them, put together.

    Linear in the lines. The array of one struct binds both inputs once, so that nothing is evaluated
    again for each run.
    """
    bound = F.array(F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines))).alias("cuts")))
    kept = F.transform(bound, lambda s: F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(s["cuts"]) - 2),
        lambda i: F.slice(s["lines"], s["cuts"][i] + 2, s["cuts"][i + 1] - s["cuts"][i] - 1))))
    return kept[0]


def drop_repeated_lines(alerts: DataFrame, alert_id: str = "alert_id", description: str = "description",
                        min_length: int = 10, min_alerts: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """Remove lines that ``min_alerts`` or more alerts share, except in the alert with the smallest id.

    Lines end at ``\\n``. Two lines are the same if they agree after stripping ASCII white space at both
    ends and lower-casing A-Z; lines of fewer than ``min_length`` characters are never dropped. Returns one
    row per input row: ``alert_id``, ``description`` (what is left), ``n_lines`` and ``n_dropped``, and the
    columns named in ``carry`` unchanged.

    Lines are exploded and hashed to 128 bits; alerts are counted per hash with map-side combining, the
    hashes over the threshold meet the lines again in a join that adaptive execution can split, and each
    description is put together again by position. All steps are built-in expressions.

    Defined cases: a null or empty description is one empty line; repeated rows count as one alert; a row
    without an id is returned unchanged and counts nowhere; lines repeated inside one alert alone stay; an
    empty table gives an empty result; other columns are not read.
    """
    carried = F.struct(F.lit(None).alias("none"), *[F.col(f"`{c}`") for c in carry])
    rows = alerts.select(F.col(f"`{alert_id}`").alias("key"), text_of(description).alias("text"), carried.alias("carried")).withColumn(
        "version", F.xxhash64("text"))
    exploded = rows.where("key is not null").select("key", "version", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    normal = ascii_lower(F.btrim(F.col("line"), F.lit(SPACES)))
    lines = (exploded.select("key", "version", "at", normal.alias("line")).where(F.char_length("line") >= min_length)
             .select("key", "version", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    if min_alerts == 2:  # two alerts hold a line exactly if its smallest and largest id differ
        shared = lines.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    else:
        shared = (lines.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count_distinct("key").alias("n"))
                  .where(F.col("n") >= min_alerts))
    dropped = (lines.join(shared.select("h1", "h2", "first"), ["h1", "h2"]).where("key > first")
               .groupBy("key", "version").agg(F.array_sort(F.collect_set("at")).alias("dropped")))
    split = rows.join(dropped, ["key", "version"], "left").select("key", "carried", "dropped", "text", F.split("text", "\n").alias("lines"))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(_without(F.col("lines"), F.col("dropped")), "\n"))
    return split.select(F.col("key").alias(alert_id), kept.alias(description), F.size("lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                        *[F.col("carried")[c].alias(c) for c in carry])
