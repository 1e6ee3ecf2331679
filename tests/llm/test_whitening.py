import math

import numpy as np
import pytest

from kerbside.llm.whitening import polar, principal, whitened_scores

SCHEMA = "segment_id long, scores array<float>, x string, key string, v string, n string"


def rows_for(vectors):
    return [(i, v, "a", "b", "c", "d") for i, v in enumerate(vectors)]


@pytest.mark.parametrize("values", [
    np.geomspace(1, 1e-9, 12), np.array([5.0, 5.0, 5.0, 1.0]), np.ones(6), np.array([3.0]), np.arange(40.0, 0, -1),
    np.concatenate([np.full(3, 2.0), 2.0 + np.arange(5) * 1e-10, [0.0, 0.0]])])
def test_components_agree_with_a_dense_solver(values):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = turn @ np.diag(values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    for wanted in (len(values), max(1, len(values) // 2)):
        found, vectors = principal(matrix, wanted)
        want = np.linalg.eigvalsh(matrix)[::-1][:wanted]
        assert np.allclose(found, want, rtol=0, atol=1e-13 * max(values))
        assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * max(values)


def test_polar_factor_is_orthogonal_and_symmetric():
    rng = np.random.default_rng(2)
    m = rng.standard_normal((20, 20))
    u = polar(m + m.T)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-13 and np.linalg.eigvalsh(u @ (m + m.T)).min() > 0
    assert polar(np.zeros((3, 3)) + np.diag([1.0, 0.0, 2.0])) is None


def plain(vectors, components):
    """By definition, in one array."""
    width = 6
    used = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in enumerate(vectors)
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    covariance = centre.T @ centre / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)),
                np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ axes / np.sqrt(values), values / np.trace(covariance)) for i, x in used}


def test_rows_agree_with_the_definition(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in rng.standard_normal(6) * [9, 5, 3, 2, 1, 0.5]] for _ in range(300)]
    vectors += [vectors[0]] * 50 + [None, [], [1.0] * 5, [1.0] * 7, [None] + [1.0] * 5, [math.nan] * 6, [math.inf] + [0.0] * 5, [0.0] * 6, [3e38] * 6]
    frame = spark.createDataFrame(rows_for(vectors), SCHEMA).repartition(5)
    got = {}
    for r in whitened_scores(frame, components=4).collect():
        got.setdefault(r["segment_id"], []).append(r)
    want = plain(vectors[:-1], 4)
    assert set(got) == set(want)
    signs = None
    for i, (n, deviation, whitened, explained) in want.items():
        mine = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == [1, 2, 3, 4]
        assert all(r["n"] == n == 301 and int(r["deviation"]) == deviation and r["identity_error"] < 1e-9 for r in mine)
        here = np.array([r["whitened"] for r in mine])
        signs = np.sign(here * whitened) if signs is None else signs
        assert np.allclose(here, signs * whitened, atol=1e-9) and np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)


def test_large_steps_keep_deviations_exact(spark):
    vectors = [[1e13, -1e13], [1e13, 1e13], [0.0, 3.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "segment_id long, scores array<double>")
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    for r in whitened_scores(frame).collect():
        assert int(r["deviation"]) == sum((3 * a - s) ** 2 for a, s in zip(x[r["segment_id"]], sums))


def test_flat_directions_and_empty_tables_have_no_components(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)] + [(None, [4.0, 1.0, 8.0])], "segment_id long, scores array<float>")
    got = whitened_scores(frame).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10 and {r["n"] for r in got} == {9}
    assert whitened_scores(frame.limit(0)).collect() == []
    alike = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "segment_id long, scores array<float>")
    assert whitened_scores(alike).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "segment_id long, scores array<float>")
    assert whitened_scores(nothing).columns == ["segment_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitened_scores(nothing).collect() == []
