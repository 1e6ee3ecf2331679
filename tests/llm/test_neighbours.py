import numpy as np
import pytest

from kerbside.llm import neighbours
from kerbside.llm.neighbours import chi_square, leaves, planes, quantile, similar_segments
from tests.llm.fixtures import rows_of

SCHEMA = "segment_id long, scores array<float>, v string, id string, leaf string"


def usable(v):
    return v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, queries, k):
    known = sorted({(i, tuple(np.float32(v).astype(float))) for i, v in rows if i is not None and usable(v)})
    ids, points = np.array([i for i, _ in known]), np.array([v for _, v in known])
    out = {}
    for q, v in queries:
        if q is not None and usable(v):
            far = ((points - np.float32(v).astype(float)) ** 2).sum(axis=1)
            order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(np.sqrt(far[j]))) for j in order]
    return out


def case(rng, n=1500):
    centres = rng.standard_normal((12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.standard_normal(8)).tolist()) for i in range(n)]
    rows += [(n + i, rows[30][1]) for i in range(40)]              # one very common vector
    rows += [(9000, None), (9001, [0.0] * 8), (9002, [1.0, None] * 4), (9003, [float("nan")] * 8), (9004, [float("inf")] * 8),
             (9005, [1.0, 2.0]), (None, rows[1][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("leaf_rows", [64, 4096])
def test_recall_order_and_ties(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    rows = case(np.random.default_rng(16))
    queries = [r for r in rows if r[0] is not None and r[0] % 30 == 0]
    frame = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    got, want = {}, brute(rows, queries, 10)
    for r in similar_segments(frame, frame.where("segment_id % 30 = 0"), dimensions=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["segment_id"], r["distance"]))
    assert got.keys() == want.keys()
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        exact = {i: d for i, d in brute(rows, [(q, dict(queries)[q])], len(rows))[q]}
        assert all(abs(exact[i] - d) < 1e-12 for _, i, d in found)
        assert [(d, i) for _, i, d in found] == sorted((d, i) for _, i, d in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
        total += 10
    assert hits / total >= 0.95
    assert [i for _, i, _ in got[30]] == list(range(1500, 1510))


def test_few_candidates_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], "x", "x", "x"), (2, [1.0, 3.0], "x", "x", "x"), (3, [1.0, 1.0], "x", "x", "x")], SCHEMA)
    assert rows_of(similar_segments(frame, frame.where("segment_id = 1"))) == [(1, 1, 2, 1.0), (1, 2, 3, 1.0)]
    empty = frame.limit(0)
    assert rows_of(similar_segments(empty, empty)) == [] and rows_of(similar_segments(frame, empty)) == []


def test_chi_square_and_tree():
    assert abs(chi_square(np.array([quantile(0.9, 6)]), 6)[0] - 0.9) < 1e-9 and abs(quantile(0.95, 2) - 5.991464547) < 1e-6
    points = np.random.default_rng(17).standard_normal((1000, 3))
    at = leaves(points, planes(points, 4))
    assert set(at) == set(range(16)) and np.bincount(at).max() <= 70
    assert set(leaves(points, planes(points, 0))) == {0}


def test_routed_queries_are_never_broadcast(spark, monkeypatch):
    """A few queries that reach many leaves become many rows, which the planner does not know."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(41).standard_normal((600, 8)))]
    table = spark.createDataFrame(rows, "segment_id long, scores array<double>")
    plans, plain = [], type(table).mapInArrow
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, *more: plans.append(self._jdf.queryExecution().executedPlan().toString()) or plain(self, *more))
    got = neighbours.similar_segments(table, table.where("segment_id % 100 = 0")).collect()
    searched = [p for p in plans if "asked" in p]
    assert len(searched) == 2 and all("SortMergeJoin [leaf" in p for p in searched)
    assert len(got) == 60
