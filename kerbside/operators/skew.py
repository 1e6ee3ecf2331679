"""Joins that stay balanced when one key holds a large share of the rows.

A key is *hot* when it holds at least 1/1000 of all rows (and at least a minimum number of them). At most
1000 keys can satisfy that, whatever the data, so the list of hot keys is the one thing that may be
fetched and broadcast without looking at its size. Results never depend on which keys are found hot; only
the spreading of work does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1000          # a hot key holds >= 1/HOT_SHARE of the rows, so there are <= HOT_SHARE
HOT_MIN_ROWS = 50_000     # below this a key is never worth special treatment
MIN_ROWS_CONF = "kerbside.hotKeyMinRows"   # a session's own bound; 1 takes the salted plans on small inputs too


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_MIN_ROWS) -> DataFrame | None:
    """Hot keys with ``hot_salts``, the number of parts each is to be split into; None when there are none.

    One counting job over the key columns only. It runs when the join is built, so that the usual case,
    no hot key, leaves the join's plan untouched.
    """
    watch = Observation()
    counts = (df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_rows"))
              .observe(watch, F.sum("hot_rows").alias("total")))
    top = counts.orderBy(F.desc("hot_rows")).limit(HOT_SHARE).collect()
    if not top:
        return None
    least = min(min_rows, int(df.sparkSession.conf.get(MIN_ROWS_CONF, str(min_rows))))
    share = max((watch.get["total"] or 0) / HOT_SHARE, float(max(least, 1)))
    rows = [(*[r[k] for k in keys], int(-(-r["hot_rows"] // share))) for r in top if r["hot_rows"] >= share]
    if not rows:
        return None
    schema = T.StructType([*[df.select(k).schema[0] for k in keys], T.StructField("hot_salts", T.IntegerType())])
    return df.sparkSession.createDataFrame(rows, schema)


def salted_pair(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column,
                hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Add a ``salt`` column to both sides: left rows of a hot key are spread, right rows repeated.

    Joining on ``keys + ['salt']`` gives every pair exactly once.
    """
    if hot is None:
        return left.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    hot = F.broadcast(hot)
    salted_left = (left.join(hot, list(keys), "left")
                   .withColumn("salt", F.when(F.col("hot_salts").isNull(), F.lit(0))
                               .otherwise(F.pmod(F.xxhash64(spread), F.col("hot_salts")).cast("int")))
                   .drop("hot_salts"))
    salted_right = (right.join(hot, list(keys), "left")
                    .withColumn("salt", F.explode(F.sequence(
                        F.lit(0), F.coalesce(F.col("hot_salts"), F.lit(1)) - 1)))
                    .drop("hot_salts"))
    return salted_left, salted_right


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column,
                how: str = "left", min_rows: int = HOT_MIN_ROWS,
                hot_source: DataFrame | None = None) -> DataFrame:
    """Many-to-one join (``right`` has one row per key) that a hot or null left key cannot skew.

    The right rows of the hot keys (at most HOT_SHARE) are broadcast; the left rows they serve, and rows
    with a null key, are scattered over the shuffle by a second key part that matches nothing. Keys are
    counted in ``hot_source`` where given: a cheaper input with the same key distribution as ``left``.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    hot = hot_keys((left if hot_source is None else hot_source).select(*keys).na.drop(), keys, min_rows)
    if how == "inner":
        left = left.na.drop(subset=keys)
        if hot is None:
            return left.join(right, keys).select(*left.columns, *payload)
    scattered = F.lit(False)
    for key in keys:
        scattered = scattered | F.col(key).isNull()
    marked = left
    if hot is not None:
        hot = F.broadcast(hot.drop("hot_salts"))
        served = right.join(hot, keys, "left_semi").select(
            *keys, F.struct(*payload, F.lit(1).alias("__hit")).alias("__hot_row"))
        marked = (left.join(hot.withColumn("__hot", F.lit(True)), keys, "left")
                  .join(F.broadcast(served), keys, "left"))
        scattered = scattered | F.col("__hot").isNotNull()
    part = F.when(scattered, F.pmod(F.xxhash64(spread), F.lit(65536)) + F.lit(1)).otherwise(F.lit(0))
    cold = right.select(*keys, F.lit(0).cast("long").alias("__part"),
                        F.struct(*payload, F.lit(1).alias("__hit")).alias("__cold_row"))
    joined = marked.withColumn("__part", part.cast("long")).join(cold, [*keys, "__part"], "left")
    row = F.coalesce(F.col("__hot_row"), F.col("__cold_row")) if hot is not None else F.col("__cold_row")
    if how == "inner":
        joined = joined.where(row.isNotNull())
    return joined.select(*left.columns, *[row[c].alias(c) for c in payload])
