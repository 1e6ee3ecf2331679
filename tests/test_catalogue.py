"""Catalogued queries against their SQL on the smallest tables.

All of them run by default; KERBSIDE_QUICK=1 runs a cross-section.
"""

import os

import pytest

from catalog import load_all
from tests.compare import compare, connect

SF_DIR = os.environ.get("KERBSIDE_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ("traffic_percentile_per_segment", "c3_tree_exposure", "c4_industrial_exposure", "c6_construction_scores", "d7_cluster_facilities",
          "d8_way_scores", "h2_split_ways", "d14_segment_grades", "d15_pollutant_samples", "d2_hazard_conditions", "d5_summary",
          "d16_hazard_bands", "c7_snap_images", "c8_sample_route_images", "d9_image_features", "d13_instance_counts", "k1_expand_profiles",
          "k3_k4_edge_priority", "k5_live_priority", "k8_cheapest_paths", "k9_compare_variants", "d19_route_exposure", "k12_announcements",
          "c16_tile_features", "a2_tri_facilities", "s2_upsert", "i1_stream_readings")
ENTRIES = load_all()
NAMES = [n for n in SAMPLE if n in ENTRIES] if os.environ.get("KERBSIDE_QUICK") else list(ENTRIES)


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    status, detail, _, _ = compare(spark, duck, ENTRIES[name], SF_DIR)
    assert status in ("ok", "rows-only"), detail
