"""Operational numbers: latency percentiles, counters and request limits over logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.ranking import exact_quantiles
from kerbside.vocab import RATE_LIMITS


def latency_percentiles(df: DataFrame, value: str = "latency_ms", fractions: Sequence[float] = (0.5, 0.95),
                        group: Sequence[str] = ()) -> DataFrame:
    """Exact nearest-rank percentiles per group."""
    return exact_quantiles(df, value, fractions, group, method="nearest")


def usage_metrics(events: DataFrame, group: Sequence[str | Column] = ()) -> DataFrame:
    """Speech cache hits, images scored and analyses asked for."""
    speech = F.col("kind") == "speech"
    return events.groupBy(*group).agg(
        F.count_if(speech).alias("speech_requests"),
        F.try_divide(F.count_if(speech & F.col("cached")), F.count_if(speech)).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.when(F.col("kind") == "scored", F.col("amount"))), F.lit(0)).alias("images_scored"),
        F.count_if(F.col("kind") == "analysis").alias("analyses_requested"))


def limit_name(path: Column) -> Column:
    """Which allowance a request path counts against; null for unlimited paths."""
    return (F.when(path == "/api/v1/auth/register", "registration")
            .when(path.endswith("/analysis") | path.startswith("/api/v1/analysis/"), "analysis")
            .when(path.isin("/api/v1/routes", "/api/v1/routes/compare") | path.endswith("/audio"), "routing"))


def caller_key(user: Column, address: Column) -> Column:
    return F.when(user.isNotNull(), F.concat(F.lit("user:"), user)).otherwise(F.concat(F.lit("ip:"), address))


def limited_requests(requests: DataFrame, limits: Mapping[str, tuple[int, int]] = RATE_LIMITS) -> DataFrame:
    """Requests that count against an allowance, with its bucket key, capacity and window."""
    names = [v for name, (n, s) in limits.items() for v in (F.lit(name), F.struct(
        F.lit(n).alias("capacity"), F.lit(s).alias("window_s")))]
    table = F.create_map(*names)
    return (requests.withColumn("limit_name", limit_name(F.col("path")))
            .where(F.col("limit_name").isNotNull())
            .withColumn("bucket_key", F.concat_ws(":", "limit_name", caller_key(F.col("user_id"), F.col("address"))))
            .withColumn("__limit", table[F.col("limit_name")])
            .select("*", "__limit.capacity", "__limit.window_s").drop("__limit"))
