"""k-means on integer vectors with balls instead of all distances.

A cluster's members within a batch form a ball around its centroid, with the distance of
its farthest member as radius. Half the distance between two centroids tells how near a
member must be to its own to be safe from the other: if 2 d(x, c) < d(c, c'), x is nearer
to c. So another centroid is a ball's neighbour only if half its distance is within the
radius. The members nearer than half the distance of the nearest neighbour are the stable
core, which isn't compared with anything; the others lie in annuli between the half
distances of one neighbour and the next, and are compared with the neighbours up to
theirs alone. All of it is on squared integers, so ties are exact: a centroid at exactly
the same distance wins by its smaller number.

Every vector is read once a round; what leaves a task are sums by cluster and component.
The vectors, as small integers, and their clusters are written to the shared folder
after each round, so a lost executor repeats one round at most. The driver holds the
centroids alone, ``k`` times ``size`` numbers whatever the table's length.

Kept are vectors with exactly ``size`` components, none null or not finite; a component
x becomes floor(scale * x). Components of 2^27 and more after that are beyond what
squared distances of 64 bits hold; such vectors count as not finite. The first centroids
are the vectors whose ids have the smallest sha256 of ``<seed>:<id>``; of rows that share
an id, that with the smaller vector comes first, and rows without an id come last, as an
empty one. With fewer vectors than ``k`` there are as many centroids as vectors. Repeated
rows are vectors of their own; without any kept one, as in an empty table, the result is
empty. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settled

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
LIMIT = 1 << 27
#: Rows worked on at a time: a row takes some 2 KB while it is.
STEP = 16_384


def integral(vectors: DataFrame, id_col: str, vector_col: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and x of the vectors that count."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.filter(F.size(x) == size).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    scaled = F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v))
    fit = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.lit(float(scale)) * v) < float(LIMIT)))
    return rows.filter(fit).select("vec_id", scaled.cast("array<int>").alias("x"))


def nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row and the squared distance to it, from the clusters the rows are in; also how many distances that took."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    best, distance = own.copy(), np.empty(len(x), np.int64)
    took = 0
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        to_own = ((x[members] - centroids[c]) ** 2).sum(1)
        order = np.argsort(-to_own, kind="stable")  # the outermost first
        members, to_own = members[order], to_own[order]
        found, at = to_own.copy(), np.full(len(members), c)
        took += len(members)
        radius = to_own[0]
        others = np.flatnonzero(between[c] <= 4 * radius)  # neighbours
        for n in others[np.argsort(between[c][others], kind="stable")]:
            if n == c:
                continue
            # beyond half the way to n: a prefix, as the outermost come first
            some = int(np.searchsorted(-4 * to_own, -between[c, n], side="right"))
            d = ((x[members[:some]] - centroids[n]) ** 2).sum(1)
            took += some
            nearer = (d < found[:some]) | ((d == found[:some]) & (n < at[:some]))
            found[:some][nearer], at[:some][nearer] = d[nearer], n
        best[members], distance[members] = at, found
    return best, distance, took


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, size)


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, x, cluster, distance of rows (vec_id, x, cluster)."""
    size = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), STEP):
                b = whole.slice(i, STEP)
                cluster, distance, _ = nearest(_vectors(b.column(1), size), np.asarray(b.column(2)).astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "x", "cluster", "distance"])

    return rows.select("vec_id", "x", "cluster").mapInArrow(lean(run), "vec_id long, x array<int>, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; a centroid without any stays."""
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(18,0)")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in sums.collect():  # one row a cluster
        out[r["cluster"]] = [int(r[f"s{i}"] or Decimal(0)) // r["n"] for i in range(centroids.shape[1])]
    return out


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(F.col("vec_id").isNull().alias("none"), digest.alias("h"), "x").orderBy("none", "h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every kept vector, and the centroids."""
    rows = settled(integral(vectors, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    rows = rows.withColumn("cluster", F.lit(0))
    for _ in range(rounds):
        rows = settled(assigned(rows, centroids), "vectors-assigned")
        centroids = moved(rows, centroids)
    return settled(assigned(rows, centroids).select("vec_id", "cluster", "distance"), "vectors-nearest"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The result with the inertia of each row's cluster and of all, and the sha256 of its centroid."""
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # one row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values, kind: str):
        of = F.array(*[F.lit(v).cast(kind) for v in values]) if len(values) else F.array().cast(f"array<{kind}>")
        return F.get(of, F.col("cluster"))

    return found.select(
        "vec_id", "cluster", "distance",
        by_cluster([sums.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        by_cluster(digests, "string").alias("centroid_sha256"),
    )
