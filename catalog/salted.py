"""The skew-safe joins once more, with their salted plans taken at any size: same rows, same SQL."""

from catalog.base import REGISTRY, Entry
from kerbside.operators.skew import MIN_ROWS_CONF

NAMES = ("c3_tree_exposure", "c4_industrial_exposure", "c5_traffic_exposure", "c6_construction_scores", "c7_snap_images",
         "c8_sample_route_images", "d19_route_exposure", "k5_edges_in_areas", "b7_in_areas", "e2_percent_rank")


def salted(name: str) -> Entry:
    plain = REGISTRY[name]

    def run(spark, sf_dir):
        # Hot keys are counted while the frame is built, so the bound need not outlive this call.
        spark.conf.set(MIN_ROWS_CONF, "1")
        try:
            return plain.run(spark, sf_dir)
        finally:
            spark.conf.unset(MIN_ROWS_CONF)

    return Entry(run, plain.sql)


for query in NAMES:
    REGISTRY[f"{query}_salted"] = salted(query)
