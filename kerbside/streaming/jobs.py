"""Streaming jobs of the live layer.

Jobs that keep tables current do so in ``foreachBatch`` with the batch operators, so batch and stream share
one definition. Jobs that need per-key memory use ``transformWithStateInPandas`` with a state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kerbside import sinks
from kerbside.operators import live
from kerbside.operators.usage import limited_requests
from kerbside.vocab import RATE_LIMITS, READING_LOOKBACK_HOURS

CLOCK_SKEW = timedelta(minutes=15)     # how far ahead of the present a station's clock may be
READING_KEYS = ("hazard", "station_id", "observed_at")


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start())


# --- readings ------------------------------------------------------------------------------------------
def store_readings(batch: DataFrame, path: str) -> None:
    """Merge one batch into the reading table, which is kept by day of observation.

    Merging by key makes a replayed batch harmless, and a late correction overwrites whatever its age.
    """
    dated = batch.withColumn("observed_on", F.to_date("observed_at").cast("string"))
    sinks.upsert_partitions(dated, path, [*READING_KEYS, "observed_on"], "observed_on",
                            order=F.struct("source", "value", "unit"))


def stream_readings(readings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    def merge(batch: DataFrame, _: int) -> None:
        store_readings(batch, path)

    return _start(readings, merge, checkpoint, trigger or {"processingTime": "1 minute"})


def recent_readings(spark, path: str, as_of: datetime | None = None) -> tuple[DataFrame, datetime | None]:
    """The readings of the last 24 hours and the present: the newest observation time.

    Only the days concerned are opened. With ``as_of``, readings dated more than CLOCK_SKEW after it are left out,
    so that one station with a wrong clock does not push the present ahead of all others.
    """
    latest = None if as_of is None else as_of + CLOCK_SKEW
    believed = F.lit(True) if latest is None else F.col("observed_at") <= F.lit(latest)
    days = [d for d in sinks.partitions(spark, path) if latest is None or d <= (latest + timedelta(hours=24)).date().isoformat()]
    now = None
    while days and now is None:     # the newest day that holds a believed reading, as a rule the last one
        day = days.pop()
        now = sinks.read_partitions(spark, path, day, day).where(believed).agg(F.max("observed_at")).first()[0]
    if now is None:
        return sinks.read_partitions(spark, path).limit(0), None
    # Days are those of the session's zone and ``now`` that of this process: a day more on both sides is enough.
    first, last = (now - timedelta(hours=READING_LOOKBACK_HOURS + 24)).date(), (now + timedelta(hours=24)).date()
    stored = sinks.read_partitions(spark, path, first.isoformat(), last.isoformat())
    return stored.where(F.col("observed_at") <= F.lit(now)), now


def stream_citywide_means(readings: DataFrame, path: str, out: str, checkpoint: str,
                          trigger: dict | None = None, clock: Callable[[], datetime] = datetime.now) -> StreamingQuery:
    """Store each batch and refresh the citywide means from the stored readings.

    ``clock`` tells the time of a trigger: readings dated later than CLOCK_SKEW after it are stored but not believed.
    """
    def refresh(batch: DataFrame, _: int) -> None:
        store_readings(batch, path)
        stored, now = recent_readings(batch.sparkSession, path, clock())
        sinks.replace_table(live.citywide_means(stored, F.lit(now)), out)

    return _start(readings, refresh, checkpoint, trigger or {"processingTime": "1 minute"})


def stream_hazard_fields(readings: DataFrame, cells: DataFrame, permits: DataFrame, path: str, out: str,
                         checkpoint: str, trigger: dict | None = None, clock: Callable[[], datetime] = datetime.now) -> StreamingQuery:
    """Every 15 minutes: store readings, rebuild the bands, keep the budget, write the snapshot."""
    def rebuild(batch: DataFrame, _: int) -> None:
        store_readings(batch, path)
        stored, now = recent_readings(batch.sparkSession, path, clock())
        raster = live.hazard_bands(cells, live.citywide_means(stored, F.lit(now)))
        bands = live.union_bands(raster, live.construction_bands(permits, F.lit(now)))
        sinks.write_snapshot(live.budget_fields(bands), out)

    return _start(readings, rebuild, checkpoint, trigger or {"processingTime": "15 minutes"})


def stream_conditions(readings: DataFrame, alerts: DataFrame, path: str, out: str, checkpoint: str,
                      trigger: dict | None = None, clock: Callable[[], datetime] = datetime.now) -> StreamingQuery:
    """Keep the condition tables current: hazards, air quality, pollen and weather, summary."""
    def refresh(batch: DataFrame, _: int) -> None:
        store_readings(batch, path)
        stored, now = recent_readings(batch.sparkSession, path, clock())
        sinks.replace_table(live.hazard_conditions(stored, F.lit(now)), f"{out}/hazards")
        conditions = sinks.read_table(batch.sparkSession, f"{out}/hazards")
        sinks.replace_table(live.air_quality(conditions), f"{out}/air_quality")
        sinks.replace_table(live.pollen_weather(conditions), f"{out}/pollen_weather")
        sinks.replace_table(live.summarize(conditions, alerts, F.lit(now)), f"{out}/summary")

    return _start(readings, refresh, checkpoint, trigger or {"processingTime": "1 minute"})


# --- analysis progress ---------------------------------------------------------------------------------
PROGRESS_SCHEMA = "analysis_id long, event string, seq int, frame_count int, delivered_count int, status string"


class AnalysisProgress(StatefulProcessor):
    """Remembers which frames of an analysis were sent.

    Input rows: frame_count (the size of the analysis) and seq, null in the opening row. Each frame is
    emitted once; then ``complete``, ``no-imagery`` for an empty analysis, or ``timeout`` with what was
    delivered by then. The wait is measured on the rows' own time, so a replay ends the same way. After the
    end the state is gone and later frames open a new round, as a re-opened stream would.
    """

    def __init__(self, max_wait_ms: int):
        self.max_wait_ms = max_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", T.StructType([T.StructField("seq", T.IntegerType())]),
                                       T.StructType([T.StructField("on", T.BooleanType())]))
        self.size = handle.getValueState("size", T.StructType([T.StructField("frames", T.IntegerType()),
                                                               T.StructField("sent", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.size.get() if self.size.exists() else None
        frames, delivered = (known[0], known[1]) if known else (None, 0)
        out = []
        opened = None
        for batch in rows:
            first = int(batch["scored_us"].min()) // 1000
            opened = first if opened is None else min(opened, first)
            for frame_count, seq in zip(batch["frame_count"], batch["seq"]):
                frames = int(frame_count)
                if not pd.isna(seq) and not self.sent.containsKey((int(seq),)):
                    self.sent.updateValue((int(seq),), (True,))
                    delivered += 1
                    out.append((key[0], "frame", int(seq), frames, delivered, "pending"))
        self.size.update((frames, delivered))
        if known is None:
            deadline = max(opened, timerValues.getCurrentWatermarkInMs()) + self.max_wait_ms
            self.handle.registerTimer(deadline)
        if frames == 0:
            out.append((key[0], "no-imagery", None, 0, 0, "no_imagery"))
            self._finish()
        elif delivered == frames:
            out.append((key[0], "complete", None, frames, delivered, "ready"))
            self._finish()
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.size.exists():
            frames, delivered = self.size.get()
            self._finish()
            yield self._rows([(key[0], "timeout", None, frames, delivered, "pending")])

    def _finish(self) -> None:
        self.size.clear()
        self.sent.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _rows(out) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["analysis_id", "event", "seq", "frame_count", "delivered_count", "status"])
        for name in ("seq", "frame_count", "delivered_count"):
            frame[name] = frame[name].astype("Int32")
        return frame

    def close(self) -> None:
        pass


def stream_analysis(scored: DataFrame, max_wait_ms: int = 90_000, lateness: str = "10 seconds") -> DataFrame:
    """Progress events from a stream of (analysis_id, frame_count, seq, scored_at)."""
    timed = scored.withWatermark("scored_at", lateness).withColumn("scored_us", F.unix_micros("scored_at"))
    return timed.groupBy("analysis_id").transformWithStateInPandas(
        AnalysisProgress(max_wait_ms), T._parse_datatype_string(PROGRESS_SCHEMA), "Append", "EventTime")


# --- request limits --------------------------------------------------------------------------------------
class TokenBucket(StatefulProcessor):
    """Greedy-refill bucket per key; emits every request with whether it went over the limit.

    Refill follows the request times, so a replay gives the same answer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", T.StructType([
            T.StructField("tokens", T.DoubleType()), T.StructField("seen_us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tokens, seen = self.bucket.get() if self.bucket.exists() else (None, None)
        batches = [b for b in rows]
        # Requests of one caller within a micro-batch: bounded by the batch, sorted by time.
        batch = pd.concat(batches).sort_values(["requested_us", "request_id"])
        over = []
        for at, capacity, window in zip(batch["requested_us"], batch["capacity"], batch["window_s"]):
            tokens = float(capacity) if tokens is None else min(
                float(capacity), tokens + max(at - seen, 0) / 1e6 * capacity / window)
            seen = int(at) if seen is None else max(seen, int(at))
            allowed = tokens >= 1.0
            tokens -= 1.0 if allowed else 0.0
            over.append(not allowed)
        self.bucket.update((tokens, seen))
        yield pd.DataFrame({"request_id": batch["request_id"].to_numpy(), "bucket_key": key[0],
                            "over_limit": over})

    def close(self) -> None:
        pass


def stream_over_limit(requests: DataFrame, limits=RATE_LIMITS) -> DataFrame:
    """Requests (request_id, path, user_id, address, requested_at) beyond their caller's allowance.

    The report of abuse; blocking a request is the web server's business.
    """
    keyed = limited_requests(requests, limits).select(
        "bucket_key", "request_id", F.unix_micros("requested_at").alias("requested_us"), "capacity", "window_s")
    judged = keyed.groupBy("bucket_key").transformWithStateInPandas(
        TokenBucket(), T._parse_datatype_string("request_id long, bucket_key string, over_limit boolean"),
        "Append", "None")
    return judged.where("over_limit")


# --- metrics and work queue --------------------------------------------------------------------------------
def stream_metrics(events: DataFrame, window: str = "1 minute", lateness: str = "5 minutes") -> DataFrame:
    """Per time window: latency percentiles (sketched, bounded memory) and the usage counters."""
    timed = events.withWatermark("happened_at", lateness)
    grouped = timed.groupBy(F.window("happened_at", window))
    speech = F.col("kind") == "speech"
    return grouped.agg(
        F.percentile_approx("latency_ms", [0.5, 0.95], 10_000).alias("latency"),
        F.count_if(speech).alias("speech_requests"),
        F.try_divide(F.count_if(speech & F.col("cached")), F.count_if(speech)).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.when(F.col("kind") == "scored", F.col("amount"))), F.lit(0)).alias("images_scored"),
        F.count_if(F.col("kind") == "analysis").alias("analyses_requested")) \
        .select("window.start", "window.end", F.col("latency")[0].alias("p50"), F.col("latency")[1].alias("p95"),
                "speech_requests", "cache_hit_rate", "images_scored", "analyses_requested")


def stream_work_queue(frames: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Image ids to score, each once while it is fresh, with the request that first asked for it."""
    return (frames.where(~F.col("scored")).withWatermark("queued_at", lateness)
            .dropDuplicatesWithinWatermark(["image_id"])
            .select("image_id", "request_id", "queued_at"))


