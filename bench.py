"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import load_all  # noqa: E402
from kerbside.session import build_session  # noqa: E402

HEADLINE = (
    "d1_citywide_means", "d16_hazard_bands", "d8_way_scores",
    "k9_compare_variants", "d19_route_exposure",
    "k3_k4_edge_priority",              # edge prices over the whole network
    "e2_percent_rank", "c6_construction_scores", "c3_tree_exposure", "c4_industrial_exposure",
    "d15_pollutant_samples",
    "c8_sample_route_images",           # image sampling for all routes at once
    "traffic_percentile_per_segment",   # kernel and percentile over all segments
    "d7_cluster_facilities", "d9_image_features", "d12_frame_metrics", "k5_live_priority",
    "i2_stream_citywide_means",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue, times = load_all(), {}
    # Start-up (class loading, the first Python worker) belongs to no query.
    catalogue["d1_citywide_means"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        catalogue[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))[2:]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
