"""Centroid clustering with Drake's adaptive bounds.

Beside its centroid and an upper bound of the distance to it, each vector keeps lower bounds for its several nearest other
centroids, in order, and one remainder bound for all the rest. When centroids have moved, the upper bound grows by its
centroid's way, each lower bound shrinks by its own centroid's, and the remainder by the longest of all. A vector whose upper
bound stays under all of them is left alone. Otherwise its upper bound is made exact; if that does not do, the listed
centroids are measured and put in order again, and where the nearest of these does not stay under the remainder bound, all
centroids are. What is measured is measured exactly, in integers. The number of bounds adapts block by block: to the
deepest one that the block's last round had to look behind, between an eighth and a quarter of the centroids.

Defined results: vectors that are null, hold null or non-finite components or have not ``dims`` components are dropped; ties
between centroids go to the smaller number, and between starting vectors of one id by their components; null ids are
clustered but never start a centroid (without any id, one of zeros starts); repeated rows are clustered each; where there are fewer vectors than centroids,
there are as few centroids; an empty table gives no rows; further columns are ignored, whatever their names; a component
beyond 131,072 is an error, as its distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import vector_blocks as vb

CENTROIDS, ROUNDS, SEED = 40, 5, 2
STATE = ("own", "upper", "near", "lower", "rest", "sums")


class Bounds:
    """The assignment of a block's vectors and its bounds; ``near`` and ``lower`` have a column for each listed centroid."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.own, self.upper, self.near, self.lower, self.rest = own, upper, near, lower, rest

    @classmethod
    def fresh(cls, n: int, listed: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, listed), np.int32), np.zeros((n, listed)), np.zeros(n))

    @classmethod
    def of(cls, block: dict) -> Bounds:
        own = vb.numbers(block["own"], np.int32, -1)
        n = len(own)
        return cls(own, vb.numbers(block["upper"], np.float64, n), vb.numbers(block["near"], np.int32, n, -1), vb.numbers(block["lower"], np.float64, n, -1), vb.numbers(block["rest"], np.float64, n))

    def packed(self) -> tuple[bytes, ...]:
        return tuple(a.tobytes() for a in (self.own, self.upper, self.near, self.lower, self.rest))

    def shifted(self, way: np.ndarray) -> None:
        self.upper += way[self.own]
        self.lower -= way[self.near]
        self.rest -= way.max()

    def measure_all(self, x: np.ndarray, rows: np.ndarray, centers: np.ndarray) -> None:
        """All centroids for some rows."""
        listed = self.near.shape[1]
        d = vb.squared(x[rows], centers)
        order = np.argsort(d, axis=1, kind="stable")  # ties by number
        length = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        self.own[rows], self.upper[rows] = order[:, 0], length[:, 0]
        self.near[rows], self.lower[rows] = order[:, 1 : 1 + listed], length[:, 1 : 1 + listed]
        self.rest[rows] = length[:, 1 + listed] if len(centers) > 1 + listed else np.inf

    def settle(self, x: np.ndarray, centers: np.ndarray) -> int:
        """Makes the assignment exact; returns the deepest bound that had to be looked behind."""
        listed = self.near.shape[1]
        least = np.minimum(self.lower.min(1, initial=np.inf), self.rest)
        under = lambda a, b: a * (1 + vb.EPS) + vb.EPS < b * (1 - vb.EPS)
        rows = np.flatnonzero(~under(self.upper, least))
        self.upper[rows] = np.sqrt(vb.own_squared(x[rows], centers[self.own[rows]]).astype(np.float64))
        rows = rows[~under(self.upper[rows], least[rows])]
        if not len(rows):
            return 0
        depth = int((~under(self.upper[rows, None], self.lower[rows])).sum(1).max(initial=0))
        listable = under(self.upper[rows], self.rest[rows])
        some = rows[listable]
        if len(some):
            options = np.sort(np.concatenate([self.own[some, None], self.near[some]], axis=1), axis=1)  # by number, so ties go to the smaller
            d = vb.own_squared(x[some][:, None, :], centers[options])
            order = np.argsort(d, axis=1, kind="stable")
            length = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            options = np.take_along_axis(options, order, 1)
            self.own[some], self.upper[some] = options[:, 0], length[:, 0]
            self.near[some], self.lower[some] = options[:, 1:], length[:, 1:]
        whole = rows[~listable]
        if len(whole):
            self.measure_all(x, whole, centers)
            depth = listed
        return depth

    def narrowed(self, listed: int) -> None:
        """Keeps the nearest so many bounds; the others go into the remainder."""
        if listed < self.near.shape[1]:
            order = np.argsort(self.lower, axis=1, kind="stable")
            near, lower = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.lower, order, 1)
            self.rest = np.minimum(self.rest, lower[:, listed:].min(1))
            self.near, self.lower = near[:, :listed].copy(), lower[:, :listed].copy()


def listed_range(k: int) -> tuple[int, int]:
    """Fewest and most bounds of a vector."""
    return min(max(k // 8, 1), k - 1), min(max(k // 4, 1), k - 1)


def row_of(ids: pa.Array, labels: pa.Array, x: np.ndarray, bounds: Bounds, k: int) -> pa.RecordBatch:
    return vb.block_row(ids, labels, x, dict(zip(STATE, (*bounds.packed(), vb.group_sums(x, bounds.own, k).tobytes()), strict=True)))


def first_blocks(kept: DataFrame, centers: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x in vb.batches_of_blocks(batches, centers.shape[1]):
            bounds = Bounds.fresh(len(x), listed_range(len(centers))[1])
            bounds.measure_all(x, np.arange(len(x)), centers)
            yield row_of(ids, labels, x, bounds, len(centers))

    return kept.mapInArrow(run, vb.block_schema(kept, *STATE))


def next_bounds(block: dict, centers: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, Bounds]:
    x, bounds = vb.numbers(block["x"], np.int32, -1, centers.shape[1]), Bounds.of(block)
    bounds.shifted(way)
    depth = bounds.settle(x, centers)
    bounds.narrowed(max(depth, listed_range(len(centers))[0]))
    return x, bounds


def clustered(vectors: DataFrame, dims: int = 64, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each kept vector as a stored table, and the centroids. They start as the kept vectors with
    the k smallest SHA-256 of ``seed:id``."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    kept = vb.scaled(vectors, dims, id_col, vector_col, label_col="")
    centers = vb.first_vectors(kept.where(F.col("_id").isNotNull()), k, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256))
    if not len(centers):  # all ids are null, or there are no vectors
        centers = np.zeros((1, dims), np.int64)
    blocks, path = vb.stored(first_blocks(kept, centers), "centroids-0")
    schema, way = vb.block_schema(kept, *STATE), np.zeros(len(centers))
    for r in range(1, rounds + 1):
        new = vb.new_centers(blocks, centers)
        way, centers = vb.drift(centers, new), new
        if r == rounds:
            break

        def again(block: dict, centers=centers, way=way) -> pa.RecordBatch:
            x, bounds = next_bounds(block, centers, way)
            return row_of(block["ids"].values, block["labels"].values, x, bounds, len(centers))

        after, next_path = vb.stored(vb.map_blocks(blocks, again, schema), f"centroids-{r}")
        common.removed(spark, path)
        blocks, path = after, next_path

    def last(block: dict) -> pa.RecordBatch:
        x, bounds = next_bounds(block, centers, way)
        return pa.RecordBatch.from_arrays([block["ids"].values, pa.array(bounds.own, pa.int32()), pa.array(vb.own_squared(x, centers[bounds.own]), pa.int64())], names=["id", "cluster", "distance"])

    kind = kept.schema["_id"].dataType.simpleString()
    out, _ = common.stored(vb.map_blocks(blocks, last, f"id {kind}, cluster int, distance long"), "centroids")
    common.removed(spark, path)
    return out, centers


def cluster_digests(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector. A row a centroid is broadcast."""
    rows, centers = clustered(vectors, id_col=id_col, **options)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    facts = vectors.sparkSession.createDataFrame([(c, s, sum(sums.values()), sha[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
