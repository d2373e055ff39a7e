"""Lloyd's centroid clustering over distinct quantised vectors with multiplicities, in exact integers.

Equal quantised vectors are one row with a count; rounds run over those rows only. A round broadcasts the
centroids (k x dimensions numbers), assigns in Arrow batches and sums by centroid in each task before the
shuffle. At the end the assignments are joined back to the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Quantised components beyond this would overflow 64-bit distances; such vectors are left out.
LARGEST = 1 << 27
#: Vectors that one vectorised step looks at.
STEP = 1 << 13


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as integers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def usable(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """If a vector has exactly that many components, none null, NaN or infinite, none whose quantised value is beyond LARGEST."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) >= LARGEST)
    return vector.isNotNull() & (F.size(vector) == dimensions) & ~F.exists(vector, bad)


def matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy().reshape(-1, dimensions).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and its squared distance, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # doubles hold every sum of products exactly
        y, c = x.astype(np.float64), centroids.astype(np.float64)
        d = ((y * y).sum(axis=1)[:, None] - 2 * (y @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _sums(distinct: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """cluster, vectors and componentwise sums of the clusters that have any: at most one row for each centroid."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                piece = batch.slice(at, STEP)
                x, n = matrix(piece.column("vector"), dimensions), piece.column("n").to_numpy()
                best, _ = nearest(x, centroids)
                for c in np.unique(best).tolist():
                    own = best == c
                    count[c] += n[own].sum()
                    total[c] += n[own] @ x[own]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": some.astype(np.int32), "n": count[some], "sums": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = distinct.mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    return [(r["cluster"], r["n"], [int(r[f"s{i}"]) for i in range(dimensions)]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect()]


def clusters(vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid of every usable vector (see usable).

    Centroids 0, 1, ... start as the k vectors of least sha256 of `salt:vec_id` (equal ids: the least vector first; a
    null vec_id never starts one). Each round assigns every vector to the nearest centroid by squared Euclidean distance
    (ties: the smaller number) and replaces each centroid that has vectors by the floor of their mean, in every
    component; then vectors are assigned once more. distance is squared; inertia is summed over all vectors, repeated
    rows included; centroid is the final one. Fewer than k usable vectors: as many centroids; no usable vector, or none
    with an id: no rows. Null vectors and those of another length are left out; extra columns are ignored.
    """
    spark = vectors.sparkSession
    ok = vectors.where(usable(F.col("embedding"), dimensions, scale)).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("vector"))
    rows = staged(ok, "vectors")
    distinct = staged(rows.groupBy("vector").agg(F.count("*").alias("n")), "distinct")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id is not null").orderBy(order, "vector").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["vector"] for r in first], np.int64)
    for _ in range(rounds):
        before = centroids.copy()
        for cluster, n, sums in _sums(distinct, centroids):
            centroids[cluster] = [s // n for s in sums]
        if (centroids == before).all():  # later rounds would change nothing
            break
    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                piece = batch.slice(at, STEP)
                best, distance = nearest(matrix(piece.column("vector"), dimensions), last)
                yield pa.RecordBatch.from_pydict({"vector": piece.column("vector"), "n": piece.column("n"), "cluster": best.astype(np.int32), "distance": distance})

    placed = staged(distinct.mapInArrow(assign, "vector array<int>, n long, cluster int, distance long"), "placed")
    by_cluster = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).cast("long").alias("inertia")).collect()
    own = {r["cluster"]: r["inertia"] for r in by_cluster}
    final = spark.createDataFrame([(c, x, sum(own.values()), last[c].tolist()) for c, x in own.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    back = rows.join(placed.drop("n").hint("merge"), "vector").drop("vector")
    return back.join(F.broadcast(final), "cluster").select(*[c.split()[0] for c in schema.split(", ")])
