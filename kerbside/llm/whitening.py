"""Whitening of score vectors: principal components by spectral divide and conquer on polar decompositions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.session import stored

LARGEST = 1 << 53          # scaled scores beyond this have no exact double
EPS = np.finfo(float).eps


def polar(matrix: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    ``None`` if the matrix is singular to working precision.
    """
    n = len(matrix)
    x = matrix / np.abs(matrix).sum(axis=0).max()
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        return None
    if not low > n * EPS:
        return None
    while True:
        square = min(low * low, 1.0)
        d = np.cbrt(4 * (1 - square) / square ** 2)
        root = np.sqrt(1 + d)
        a = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        following = b / c * x + (a - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        following = (following + following.T) / 2
        low = min(low * (a + b * square) / (1 + c * square), 1.0)
        moved = np.linalg.norm(following - x)
        x = following
        if moved <= np.cbrt(5 * EPS) and 1 - low <= 10 * EPS:
            return x


def _range_of(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of what a projector keeps."""
    basis = rng.standard_normal((len(projector), rank))
    for _ in range(3):
        basis, _ = np.linalg.qr(projector @ basis)
    return basis


def principal(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    The polar factor U of the matrix shifted by a point inside its spectrum gives the projector (U + I) / 2 on
    the eigenvectors above that point. Both invariant subspaces are split on until they have one dimension or
    all their eigenvalues agree to working precision; a lower one only if components are still wanted.
    """
    scale, rng = np.linalg.norm(matrix), np.random.default_rng(11)
    values, vectors = [], []

    def split(part: np.ndarray, basis: np.ndarray) -> None:
        n = len(part)
        if len(values) >= wanted:
            return
        shift = np.trace(part) / n
        if n == 1 or np.linalg.norm(part - shift * np.eye(n)) <= 4 * EPS * max(scale, 1e-300):
            values.extend(np.diag(part).tolist())
            vectors.extend(basis.T)
            return
        spread = np.linalg.norm(part - shift * np.eye(n)) / np.sqrt(n)
        # The mean always lies inside the spectrum; a shift that meets an eigenvalue is moved a little.
        for move in [0.0, *(s * k * spread / 16 for k in range(1, 16) for s in (1, -1))]:
            unitary = polar(part - (shift + move) * np.eye(n))
            if unitary is None:
                continue
            above = (unitary + np.eye(n)) / 2
            rank = int(round(np.trace(above)))
            if 0 < rank < n:
                break
        else:
            raise ArithmeticError("no shift splits the spectrum")
        upper = _range_of(above, rank, rng)
        lower = np.eye(n) - above
        lower = _range_of(lower - upper @ (upper.T @ lower), n - rank, rng)
        for side in (upper, lower):
            inner = side.T @ part @ side
            split((inner + inner.T) / 2, basis @ side)

    if len(matrix):
        split((matrix + matrix.T) / 2, np.eye(len(matrix)))
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order], np.array(vectors).reshape(-1, len(matrix))[order].T


def _rows(column: pa.ListArray, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _scaled(vectors: DataFrame, width: int, factor: int, offset: int) -> DataFrame:
    """(key, x): scores in whole steps, of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            # Rows of another length or with null entries went before, so all values are there.
            values = np.floor(_rows(lists, width, np.float64) * factor) + offset
            keep = (np.isfinite(values) & (np.abs(values) < LARGEST)).all(axis=1)
            kept = values[keep].astype(np.int64)
            ends = pa.array(np.arange(0, len(kept) * width + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(pa.array(keep)), pa.ListArray.from_arrays(ends, pa.array(kept.ravel()))],
                                             names=["key", "x"])

    whole = vectors.where(F.col("v").isNotNull() & (F.size("v") == width) & ~F.exists("v", lambda e: e.isNull()))
    return whole.mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, x array<long>")


def _summed(fit: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``partial(x)``, a matrix of this shape, over all batches of the fit list.

    Each task sends one matrix, dealt out by row, so that no task or driver sees more than its rows of all of them.
    """
    width = len(fit.first()["x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += partial(_rows(batch.column("x"), width, np.int64))
        i, j = np.indices(shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros(shape)
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        total[r["i"], r["j"]] = r["v"]
    return total


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: whole numbers of 64 bits where they suffice."""
    bound = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if bound < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviation(apart: np.ndarray) -> pa.Array:
    if apart.dtype != object and len(apart) and int(np.abs(apart).max()) ** 2 * apart.shape[1] >= 1 << 62:
        apart = apart.astype(object)
    return pa.array([v if v < 10 ** 38 else None for v in (apart * apart).sum(axis=1).tolist()], pa.decimal128(38, 0))


def whitened_scores(vectors: DataFrame, segment_id: str = "segment_id", scores: str = "scores", components: int = 16,
                    steps: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Whitened principal components of segments' score vectors.

    Scores become whole steps x = floor(``steps`` * score) + ``offset``. The fit list holds each distinct x vector
    once: n vectors of per-dimension sums S and covariance V (divisor n, centred before multiplying). Returns, for each
    row that takes part and each of the first ``components`` eigenvectors of V by falling eigenvalue e: ``segment_id``,
    ``component`` (from 1), ``n``, ``deviation`` (decimal: the exact sum over dimensions of (n x - S) ** 2), ``whitened``
    (x - S / n projected on the component, over the root of e), ``explained`` (e over V's trace) and ``identity_error``
    (the largest absolute entry of the covariance of ``whitened`` over the fit list minus the identity).

    The eigenvectors come from QDWH: polar decompositions of the shifted covariance split its invariant subspaces
    until components are left (``principal``). The fit list is stored once; sums, covariance and the check of the result
    are three passes with one small matrix per task. Only matrices of dimensions squared reach the driver, and only
    ``components`` eigenvectors are broadcast.

    Defined cases: null vectors, vectors with a null, infinite or not-a-number entry or one whose step number has no exact
    double, and vectors that are empty or not of the most frequent length (of equally frequent ones the longest) take no part; repeated rows
    each get their result and count once in the fit list; equal eigenvalues keep any basis of their subspace, the
    same for all rows; components without spread (e of at most 1e-12 of the largest) have no whitened form and are left
    out, all of them if the vectors are all alike; an empty table gives an empty result; other columns are not read.
    """
    source = vectors.select(F.col(f"`{segment_id}`").alias("key"), F.col(f"`{scores}`").alias("v"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    named = {"key": segment_id}
    usual = (source.where("size(v) > 0").groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
             .orderBy(F.desc("rows"), F.desc("width")).first())
    width = usual["width"] if usual else 0
    empty = source.sparkSession.createDataFrame([], schema).withColumnsRenamed(named)
    if not width:
        return empty
    scaled = _scaled(source, width, steps, offset)
    fit = stored(scaled.select("x").distinct(), "whitening-fit")
    place = F.posexplode("x").alias("j", "x")
    counted = fit.select(place).groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    if not counted:
        return empty
    n, sums = counted[0]["n"], [int(r["s"]) for r in counted]

    def centred(x: np.ndarray) -> np.ndarray:
        return _apart(x, n, sums).astype(np.float64) / n

    def product(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    covariance = _summed(fit, product, (width, width)) / n
    values, axes = principal(covariance, min(components, width))
    whole = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    values, axes = values[whole], axes[:, whole]
    k = len(values)
    if not k:
        return empty
    turn, explained = axes / np.sqrt(values), values / np.trace(covariance)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn
        return w.T @ w

    error = float(np.abs(_summed(fit, spread, (k, k)) / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(_rows(batch.column("x"), width, np.int64), n, sums)
            rows = len(apart)
            whitened = (apart.astype(np.float64) / n) @ turn
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                 _deviation(apart).take(each), pa.array(whitened.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return scaled.mapInArrow(run, schema).withColumnsRenamed(named)
