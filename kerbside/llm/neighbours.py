"""Approximate nearest neighbours: segments with alike score vectors, by stable projections and a kd-tree."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import hashed_share
from kerbside.session import stored

SAMPLE_ROWS = 20_000       # projected vectors that the tree's planes are fitted on at most
LEAF_ROWS = 4_096          # vectors of a leaf that one task row holds; fuller leaves are split into several
TREE_DEPTH = 12            # of the part of the tree that is known everywhere: at most 4096 leaves
QUERY_ROWS = 256           # queries that meet a leaf together


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """Distribution function of the chi-square law: the series of the lower incomplete gamma function."""
    a, half = freedom / 2, np.asarray(x, float) / 2
    held = np.minimum(half, 500.0)
    term = total = np.full(held.shape, 1 / a)
    for n in range(1, 2000):
        term = term * held / (a + n)
        total = total + term
        if (term <= 1e-12 * total).all():
            break
    with np.errstate(divide="ignore"):
        value = np.exp(a * np.log(held) - held - lgamma(a)) * total
    return np.minimum(np.where(half > 500, 1.0, value), 1.0)


def quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array([mid]), freedom)[0] < p else (low, mid)
    return high


def planes(sample: np.ndarray, depth: int) -> np.ndarray:
    """A kd-tree's cuts in heap order, (axis, value) per node: the axis of largest spread at its median."""
    cuts = np.zeros((max(2 ** depth - 1, 0), 2))
    parts = {0: sample}
    for node in range(len(cuts)):
        part = parts.pop(node)
        axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
        value = float(np.median(part[:, axis])) if len(part) else 0.0
        cuts[node] = axis, value
        side = part[:, axis] < value
        parts[2 * node + 1], parts[2 * node + 2] = part[side], part[~side]
    return cuts


def leaves(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Leaf of each projected point."""
    node = np.zeros(len(points), np.int64)
    while len(points) and len(cuts) and node[0] < len(cuts):
        axis, value = cuts[node, 0].astype(int), cuts[node, 1]
        node = 2 * node + 1 + (points[np.arange(len(points)), axis] >= value)
    return node - len(cuts)


def nearest(query: np.ndarray, seen: np.ndarray, vectors: np.ndarray, projected: np.ndarray, bound: float, k: int,
            reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one leaf verified for one query in the order of their projected distance, and their distances.

    Stops when the chance that a nearer vector projects further out is small: the squared projected distance
    has passed ``reach`` times the squared distance of the k-th best so far, in this leaf or known before.
    """
    far = ((projected - seen) ** 2).sum(axis=1)
    order = np.argsort(far, kind="stable")
    rows, found, best = [], [], bound
    for at in range(0, len(order), 256):
        if far[order[at]] > reach * best:
            break
        part = order[at: at + 256]
        part = part[far[part] <= reach * best]
        rows.append(part)
        found.append(((vectors[part] - query) ** 2).sum(axis=1))
        near = np.concatenate(found)
        if len(near) >= k:
            best = min(best, float(np.partition(near, k - 1)[k - 1]))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def similar_segments(segments: DataFrame, queries: DataFrame, segment_id: str = "segment_id", scores: str = "scores",
                     k: int = 10, dimensions: int = 6, confidence: float = 0.97, seed: int = 7) -> DataFrame:
    """The ``k`` segments with the nearest score vectors for each query segment, by Euclidean distance.

    ``queries`` has the same two columns and is searched for among all ``segments``, itself (the same id) left
    out. Returns ``query_id``, ``rank`` (from 1, ties to the smaller id), ``segment_id`` and ``distance``, in
    double precision on the original vectors.

    Vectors are projected to a few dimensions by a Gaussian (2-stable) matrix, so that a squared projected
    distance over the squared true one follows a chi-square law. A kd-tree over the projections, its planes
    fitted on a sample of at most SAMPLE_ROWS vectors (smallest hashes), deals every vector out to a leaf. A query
    first searches its own leaf; the k-th distance found bounds how far out, at ``confidence``, a nearer vector
    can project, and only leaves whose boxes come that near are searched too. In a leaf, vectors are verified in
    the order of their projected distance until the chi-square test holds. There is no cap on candidates.

    Equal vectors are one entry with its k + 1 smallest ids, which is all that any answer can use, so a
    very common vector is one candidate. Leaves meet queries in blocks of bounded size.

    Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do
    those of another length than most and rows without an id; repeated ids of queries are one query, the smallest
    vector wins; repeated rows of segments are one; with fewer than ``k`` candidates all are returned; empty
    tables give an empty result; other columns are not read.
    """
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        return (df.select(F.col(f"`{segment_id}`").cast("long").alias("id"), F.col(f"`{scores}`").cast("array<double>").alias("v"))
                .where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists(v, lambda x: x != 0)))

    spark = segments.sparkSession
    result = "query_id long, rank int, segment_id long, distance double"
    rows = usable(segments)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], result)
    width, count = size["d"], size["n"]
    matrix = np.random.default_rng(seed).standard_normal((width, dimensions))
    rows, asked = rows.where(F.size("v") == width), usable(queries).where(F.size("v") == width)
    # One entry per vector: the smallest k + 1 ids, limited before the shuffle already.
    ranked = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    entries = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(0)) @ matrix if batch.num_rows else np.zeros((0, dimensions))
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], names=["p"])

    depth = int(np.clip(np.ceil(np.log2(max(count / LEAF_ROWS, 1))), 0, TREE_DEPTH))
    sample = rows.select("v").where(hashed_share("v", SAMPLE_ROWS, count)).orderBy(F.pmod(F.xxhash64("v"), F.lit(1 << 40))).limit(SAMPLE_ROWS).mapInArrow(sketch, "p array<double>").collect() if depth else []
    cuts = planes(np.array([r["p"] for r in sample]).reshape(-1, dimensions), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v")) @ matrix if batch.num_rows else np.zeros((0, dimensions))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(points), pa.list_(pa.float64())), pa.array(leaves(points, cuts))],
                                             names=[*batch.schema.names, "p", "leaf"])

    indexed = stored(entries.mapInArrow(place, "v array<double>, ids array<long>, p array<double>, leaf long")
                     .withColumn("part", F.pmod(F.xxhash64("v"), F.lit(1 << 20))), "vectors")
    parts = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF_ROWS).alias("parts"),
                                        *[F.min(F.col("p")[i]).alias(f"low{i}") for i in range(dimensions)],
                                        *[F.max(F.col("p")[i]).alias(f"high{i}") for i in range(dimensions)])
    boxes = parts.orderBy("leaf").toPandas()           # one row per leaf, at most 2 ** TREE_DEPTH
    low, high = (boxes[[f"{s}{i}" for i in range(dimensions)]].to_numpy(float) for s in ("low", "high"))
    leaf_numbers, reach = boxes["leaf"].to_numpy(), quantile(confidence, dimensions)
    blocks = (indexed.join(F.broadcast(parts.select("leaf", "parts")), "leaf")
              .withColumn("part", F.pmod("part", F.col("parts"))).repartition("leaf")
              .groupBy("leaf", "part").agg(F.collect_list(F.struct("v", "ids", "p")).alias("rows")))
    one = asked.groupBy("id").agg(F.min("v").alias("v"))
    placed = stored(one.mapInArrow(place, "id long, v array<double>, p array<double>, leaf long"), "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pair of a leaf's block and a block of queries, the best k + 1 rows of every query."""
        for batch in batches:
            out: list[list] = [[], [], []]
            for own, group in zip(batch.column("rows"), batch.column("asked")):
                own, group = own.values, group.values
                vectors, points, ids = _matrix(own.field("v")), _matrix(own.field("p")), own.field("ids").to_pylist()
                queries_, seen = _matrix(group.field("v")), _matrix(group.field("p"))
                for q, v, p, bound in zip(group.field("id").to_pylist(), queries_, seen, group.field("bound").to_pylist()):
                    limit = np.inf if bound is None else bound
                    at, far = nearest(v, p, vectors, points, limit, k + 1, reach)
                    # Behind the k + 1 nearest rows, one of which may be the query, none counts.
                    near = far <= (min(limit, np.partition(far, k)[k]) if len(far) > k else limit)
                    at, far = at[near], far[near]
                    found = sorted((float(d), i) for d, r in zip(far, at) for i in ids[r] if i != q)[:k]
                    out[0] += [q] * len(found)
                    out[1] += [i for _, i in found]
                    out[2] += [d for d, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                                             names=["query_id", "segment_id", "square"])

    def met(routed: DataFrame) -> DataFrame:
        block = F.floor((F.row_number().over(Window.partitionBy("leaf").orderBy("id")) - 1) / QUERY_ROWS)
        groups = routed.withColumn("block", block).groupBy("leaf", "block").agg(F.collect_list(F.struct("id", "v", "p", "bound")).alias("asked"))
        # Never broadcast: the planner takes queries routed to many leaves for as few as the queries.
        return groups.join(blocks.hint("merge"), "leaf").select("rows", "asked").mapInArrow(search, "query_id long, segment_id long, square double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("square", "segment_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    home = stored(met(placed.withColumn("bound", F.lit(None).cast("double"))), "home")
    bound = best(home).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("s")).select(
        F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("s")).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every other leaf whose box the query's reach touches."""
        for batch in batches:
            points = _matrix(batch.column("p"))
            row, to = [], []
            for i, (p, leaf, limit) in enumerate(zip(points, batch.column("leaf").to_pylist(), batch.column("bound").to_pylist())):
                gap = np.maximum(np.maximum(low - p, p - high), 0.0)
                near = (gap ** 2).sum(axis=1) <= (np.inf if limit is None else limit * reach)
                wanted = leaf_numbers[near & (leaf_numbers != leaf)]
                row += [i] * len(wanted)
                to += wanted.tolist()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "v", "p", "bound")), pa.array(to, pa.int64())],
                                             names=["id", "v", "p", "bound", "leaf"])

    away = placed.join(bound, "id", "left").mapInArrow(route, "id long, v array<double>, p array<double>, bound double, leaf long")
    final = best(home.unionByName(met(away)))
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "segment_id", F.sqrt("square").alias("distance"))
