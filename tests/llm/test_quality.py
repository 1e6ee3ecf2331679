import random

import pytest

from kerbside.llm.quality import alert_quality
from tests.llm.fixtures import prose, rows_of

SCHEMA = "alert_id long, description string, publisher string, section string, key string, host string, p_text string"
LABELS = "alert_id long, quality int, y int"


def junk(rng):
    return rng.choice([lambda: "SALE " * rng.randint(20, 90), lambda: prose(rng, 60).upper().replace(" ", "!! "),
                       lambda: " | ".join(prose(rng, 1) for _ in range(50))])()


def case(rng, n=400):
    rows, truth = [], {}
    for i in range(n):
        bad = rng.random() < 0.3
        truth[i] = int(not bad)
        rows.append((i, junk(rng) if bad else prose(rng, rng.randint(20, 90)), f"agency{i % 7}", "en", "x", "x", "x"))
    return rows, truth


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(13)
    rows, truth = case(rng)
    extra = [(3, rows[3][1], "agency3", "en", "x", "x", "x"), (900, None, None, None, "x", "x", "x"), (901, "", "agency1", None, "x", "x", "x"),
             (None, prose(rng, 50), "agency1", "en", "x", "x", "x"), (902, "calm air " * 40000, "agency2", "en", "x", "x", "x")]
    labels = [(i, truth[i], 0) for i in range(0, 400, 2)] + [(0, None, 0), (2, 7, 0), (5000, 1, 0), (None, 1, 0), (4, truth[4], 0)]
    got = alert_quality(spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 405 and all(0 <= r["p_quality"] <= 1 for r in got)
    kept = {r["alert_id"]: r["keep"] for r in got}
    right = sum(kept[i] == bool(truth[i]) for i in range(1, 400, 2))
    assert right >= 190
    clean = [i for i in range(1, 400, 2) if truth[i]]
    assert sum(kept[i] for i in clean) >= 0.97 * len(clean)


def test_sites_move_the_odds_and_sparse_ones_shrink(spark):
    rng = random.Random(14)
    rows = []
    for i in range(600):
        bad = i % 3 == 0 if i < 300 else i % 20 == 0
        rows.append((i, junk(rng) if bad else prose(rng, 40), "poor" if i < 300 else "good", f"s{i % 2}", "x", "x", "x"))
    rows += [(1000, junk(rng), "single", "s0", "x", "x", "x")]
    truth = [(i, int(not (i % 3 == 0 if i < 300 else i % 20 == 0)), 0) for i in range(600)]
    got = {r["alert_id"]: r for r in alert_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(truth, LABELS)).collect()}
    mean = sum(r["p_text"] for r in got.values()) / len(got)
    assert got[1]["p_publisher"] < mean < got[301]["p_publisher"]
    assert got[1]["p_quality"] < got[1]["p_text"] and got[301]["p_quality"] > got[301]["p_text"]
    assert abs(got[1000]["p_section"] - mean) < abs(got[1000]["p_text"] - mean) / 2


@pytest.mark.parametrize("labels, kept", [([], True), ([(0, 1, 0)], True), ([(0, 0, 0)], False)])
def test_without_labels_of_both_kinds(spark, labels, kept):
    rows, _ = case(random.Random(15), 20)
    got = alert_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert {r["keep"] for r in got} == {kept}


def test_empty_table(spark):
    assert rows_of(alert_quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))) == []
