"""Clustering around centroids with a vantage-point tree over the centroids.

Each round builds the tree anew on the driver (its size is the number of centroids) and broadcasts it. A vector searches
it best-first: of its open nodes it takes the one with the least lower bound, measures the node's vantage centroid with
exact integers, and opens the children with the bounds that the triangle inequality gives. It ends when the least bound is
beyond its best distance; bounds equal to it are still followed, so of equally near centroids the smallest number wins.
All vectors of a batch take their steps together in numpy, each with its own bounds and its own end. New centroids are exact
integer sums per cluster and component, added up per task and then by Spark.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchlens.llm.common import stored

#: Components of a greater size are not clustered: their squared distances would not fit a long.
LARGEST = 1 << 27
#: Vectors that step together.
TOGETHER = 4096


@dataclass
class Tree:
    """Nodes in arrays. Node i has its vantage centroid and two children, -1 if missing, with the least and greatest distance
    of a child's centroids to the vantage centroid."""

    points: np.ndarray
    vantage: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_tree(points: np.ndarray) -> Tree:
    """The vantage is the point farthest from the first one; the others are halved at the median distance."""
    n = len(points)
    vantage, child = np.full(n, -1), np.full((n, 2), -1)
    low, high = np.zeros((n, 2)), np.zeros((n, 2))
    made = 0
    todo = [(np.arange(n), -1, 0)] if n else []
    while todo:
        members, parent, side = todo.pop()
        node, made = made, made + 1
        if parent >= 0:
            child[parent, side] = node
        v = members[int(np.argmax(squared(points[members], points[members[0]])))]
        vantage[node] = v
        rest = members[members != v]
        away = np.sqrt(squared(points[rest], points[v]).astype(np.float64))
        order = np.argsort(away, kind="stable")
        for k, part in enumerate(np.array_split(order, 2)):
            if len(part):
                low[node, k], high[node, k] = away[part].min(), away[part].max()
                todo.append((rest[part], node, k))
    return Tree(points, vantage, child, low, high)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each row of x, and the distances that were measured."""
    n, nodes = len(x), len(tree.vantage)
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, nodes)
    bound = np.full((n, nodes), np.inf)
    if nodes:
        bound[:, 0] = 0
    active, measured = np.arange(n), 0
    while len(active) and nodes:
        node = np.argmin(bound[active], axis=1)
        least = bound[active, node]
        # bounds are rounded; the margin keeps equal distances open
        go = np.isfinite(least) & (least <= np.sqrt(best[active].astype(np.float64)) * (1 + 1e-9) + 1e-6)
        active, node, least = active[go], node[go], least[go]
        bound[active, node] = np.inf
        v = tree.vantage[node]
        d = squared(x[active], tree.points[v])
        measured += len(d)
        better = (d < best[active]) | ((d == best[active]) & (v < number[active]))
        best[active[better]], number[active[better]] = d[better], v[better]
        away = np.sqrt(d.astype(np.float64))
        for side in (0, 1):
            has = tree.child[node, side] >= 0
            rows, at = active[has], node[has]
            gap = np.maximum(tree.low[at, side] - away[has], away[has] - tree.high[at, side])
            bound[rows, tree.child[at, side]] = np.maximum(np.maximum(gap, least[has]), 0)
    return number, best, measured


def whole_vectors(table: DataFrame, width: int, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and v, the floors of scale times the components, of the rows that are clustered."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(F.col(vec_col), lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST))  # not of nan
    return table.select(F.col(id_col).alias("vec_id"), F.col(vec_col)).filter((F.size(vec_col) == width) & fits).select("vec_id", v.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hash of seed and id, in its order; of equal hashes the lesser vector first."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(build_tree(centroids))
    width = centroids.shape[1]
    id_type = vectors.schema["vec_id"].dataType

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                number, best, _ = nearest(shared.value, _matrix(part.column(1), width))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.mapInArrow(run, schema)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means of their vectors; those without vectors stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(build_tree(centroids))
    k, width = centroids.shape

    def run(batches):
        sums, count, seen = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                x = _matrix(batch.slice(at, TOGETHER).column(0), width)
                if seen + len(x) >= 1 << 34:  # before a sum of LARGEST components could pass a long
                    yield from partial(sums, count)
                    sums[:], count[:], seen = 0, 0, 0
                number = nearest(shared.value, x)[0]
                np.add.at(sums, number, x)
                count += np.bincount(number, minlength=k)
                seen += len(x)
        yield from partial(sums, count)

    def partial(sums, count):
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, width + 1).astype(np.int32)), pa.array(np.tile(np.arange(width + 1), len(some)).astype(np.int32)),
             pa.array(np.hstack([sums[some], count[some, None]]).ravel())], names=["cluster", "place", "part"])

    total = vectors.select("v").mapInArrow(run, "cluster int, place int, part long").groupBy("cluster", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    exact = {(r["cluster"], r["place"]): int(r["total"]) for r in total.collect()}  # k times width + 1 numbers
    out = centroids.copy()
    for c in range(k):
        n = exact.get((c, width), 0)
        if n:
            out[c] = [exact[c, j] // n for j in range(width)]
    return out


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one row per clustered row of table.

    Rows without exactly `width` components, with a null, infinite or nan one, or with one whose size times scale is
    2^27 or more have no row. A null id hashes as empty text; rows that repeat an id are vectors of their own. With fewer
    than k vectors there are as many centroids as vectors; an empty table gives an empty result. Distances are squared,
    ties go to the smaller number. Other columns are not read."""
    spark = table.sparkSession
    vectors = whole_vectors(table, width, id_col, vec_col, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                              F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = stored(assign(vectors, centroids))
    exact = lambda: F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    per = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(exact()).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(i, per.get(i, 0), sum(per.values()), d) for i, d in enumerate(digest)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
