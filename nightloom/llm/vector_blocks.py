"""Integer vectors in blocks of a few thousand, for clustering rounds that keep bounds between them.

A kept vector has the wanted number of components, none null or non-finite; each component x becomes floor(256 * x). One
row of a block table holds the ids, the labels and the components (32-bit, row by row) of up to BLOCK vectors of one
partition, with whatever a method keeps for them between rounds, and the sums of each of its groups. A round reads the
blocks, writes new ones to the shared folder and then adds the sums up; only the sums of groups, as many as the model has
parameters, reach the driver. A lost executor costs the blocks that it was writing.

Distances are exact: in doubles where all terms stay under 2^53, in 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 256
#: Vectors of a block: their state is one row, so this bounds it.
BLOCK = 4096
#: Scaled components up to here: squared distances of 1,024 components fit a long.
LARGEST = 1 << 25
#: Relative room that floating-point bounds leave for rounding.
EPS = 1e-9
#: Bytes of a Parquet row group of blocks, so that a task holds few blocks at once.
ROW_GROUP = 16 << 20


def scaled(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """_id, _label and _x, the scaled components, of all kept vectors. A missing label column is null."""
    have = set(vectors.columns)
    label = F.col(f"`{label_col}`") if label_col in have else F.lit(None).cast("string")
    x = F.col(f"`{vector_col}`")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    small = vectors.where(x.isNotNull() & (F.size(x) == dims)).where(F.forall(x, fine))
    return small.select(F.col(f"`{id_col}`").alias("_id"), label.alias("_label"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("_x"))


def first_vectors(kept: DataFrame, k: int, *order: Column) -> np.ndarray:
    """The components of the first k vectors by the order, ties by the components; k rows reach the driver."""
    rows = kept.orderBy(*order, F.col("_x")).limit(k).select("_x").collect()
    return np.array([r[0] for r in rows], dtype=np.int64)


def checked(x: np.ndarray) -> np.ndarray:
    if x.size and max(int(x.max()), -int(x.min())) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: its distances need not fit a long")
    return x.astype(np.int32)


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centers, exact, as 64-bit integers."""
    if not x.size or not centers.size:
        return np.zeros((len(x), len(centers)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(centers).max()))
    if most * most * 4 * x.shape[1] < 1 << 52:
        a, b = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a = x.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in centers.astype(np.int64)], axis=1)


def own_squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the row of centers beside it."""
    return ((x.astype(np.int64) - centers.astype(np.int64)) ** 2).sum(-1)


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each center has moved at most."""
    return np.sqrt(own_squared(new, old).astype(np.float64)) * (1 + EPS)


def group_sums(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """(k, 1 + components): the number of rows and the sums of each group."""
    out = np.zeros((k, 1 + x.shape[1]), np.int64)
    np.add.at(out[:, 0], group, 1)
    np.add.at(out[:, 1:], group, x.astype(np.int64))
    return out


def batches_of_blocks(batches: Iterator[pa.RecordBatch], dims: int, block: int = BLOCK) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids, labels and components of up to ``block`` rows at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[pa.Array, pa.Array, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, labels = (pa.concat_arrays(whole.column(i).chunks) for i in (0, 1))
        return ids, labels, checked(np.concatenate([np.asarray(c.flatten()) for c in whole.column(2).chunks]).reshape(-1, dims))

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, block - size)
            held.append(part)
            size, at = size + part.num_rows, at + part.num_rows
            if size == block:
                yield joined()
                held, size = [], 0
    if size:
        yield joined()


def stored(blocks: DataFrame, name: str) -> tuple[DataFrame, str]:
    return common.stored(blocks, name, {"parquet.block.size": ROW_GROUP})


def new_centers(blocks: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each group over all blocks; a group without vectors stays. Tasks add up their
    own blocks' sums first; as many rows as the centers have components reach the driver."""
    k, width = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + width), np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), np.int64).reshape(k, 1 + width)
        full = np.flatnonzero(total[:, 0])
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full].tolist(), pa.list_(pa.int64()))], names=["center", "sums"])

    parts = blocks.select("sums").mapInArrow(run, "center int, sums array<long>")
    summed = parts.select("center", F.posexplode("sums").alias("at", "s")).groupBy("center", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, dict[int, int]] = {}
    for r in summed.collect():
        found.setdefault(r["center"], {})[r["at"]] = int(r["s"])
    out = centers.copy()
    for c, sums in found.items():
        out[c] = [sums[i + 1] // sums[0] for i in range(width)]
    return out


def map_blocks(blocks: DataFrame, fn: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
    """fn on each row of a block table, as a dictionary of Arrow scalars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield fn({name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)})

    return blocks.mapInArrow(run, schema)


def numbers(scalar: pa.Scalar, kind, *shape: int) -> np.ndarray:
    """A binary column's array; it can be written to."""
    return np.frombuffer(scalar.as_buffer(), kind).reshape(shape).copy()


def block_row(ids: pa.Array, labels: pa.Array, x: np.ndarray, state: dict[str, bytes]) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    arrays = [one(ids), one(labels), pa.array([x.tobytes()], pa.binary()), *(pa.array([v], pa.binary()) for v in state.values())]
    return pa.RecordBatch.from_arrays(arrays, names=["ids", "labels", "x", *state])


def block_schema(kept: DataFrame, *state: str) -> str:
    of = {f.name: f.dataType.simpleString() for f in kept.schema}
    return ", ".join([f"ids array<{of['_id']}>, labels array<{of['_label']}>, x binary", *(f"{s} binary" for s in state)])


def with_total(rows: DataFrame, key: str, value: str, name: str, share: int = 10_000) -> DataFrame:
    """rows (a stored table) with the sum of ``value`` over equal keys, nulls together. Keys with more than one row in
    ``share`` are fewer than ``share``: their sums are broadcast; the others are joined, and no key of theirs is large."""
    sums = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_rows"))
    sums, path = common.stored(sums, "totals")
    most = max(1, rows.count() // share)
    hot = sums.where(F.col("_rows") > most).drop("_rows").withColumnRenamed(name, "_hot").withColumn("_is_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    rest = sums.where(F.col("_rows") <= most).drop("_rows")
    if rest.isEmpty():
        return marked.withColumn(name, F.col("_hot")).drop("_hot", "_is_hot")
    out = marked.where(F.col("_is_hot")).withColumn(name, F.col("_hot"))
    cold = marked.where(F.col("_is_hot").isNull()).join(rest, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return out.unionByName(cold).drop("_hot", "_is_hot")
