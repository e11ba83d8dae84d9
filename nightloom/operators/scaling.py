"""Scaling statistics by position, and their application."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class Moments:
    """Mergeable state of each position of some arrays: n, mean and the sum of squared deviations."""

    def __init__(self) -> None:
        self.n, self.mean, self.m2 = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, x: np.ndarray, known: np.ndarray | None) -> None:
        """Rows of one length; ``known`` is false where an element is null."""
        n = np.full(x.shape[1], len(x)) if known is None else known.sum(0)
        own = x if known is None else np.where(known, x, 0.0)
        mean = own.sum(0) / np.maximum(n, 1)
        off = x - mean if known is None else np.where(known, x - mean, 0.0)
        self.merge(n, mean, (off * off).sum(0))

    def merge(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        grow = len(n) - len(self.n)
        if grow > 0:
            self.n, self.mean, self.m2 = (np.concatenate([v, np.zeros(grow, v.dtype)]) for v in (self.n, self.mean, self.m2))
        k = len(n)
        total = self.n[:k] + n
        apart, share = mean - self.mean[:k], n / np.maximum(total, 1)
        with np.errstate(invalid="ignore"):
            self.m2[:k] += m2 + apart * apart * self.n[:k] * share
            self.mean[:k] = np.where(n > 0, self.mean[:k] + apart * share, self.mean[:k])
        self.n[:k] = total


#: Positions whose states a task holds; beyond these it hands its states on and starts anew.
HELD_POSITIONS = 1 << 21


def position_states(arrays: DataFrame, samples: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, m2), arrays by position: a row for each key and task, so that no sample becomes a row of its own."""
    kinds = [arrays.schema[c].dataType.simpleString() for c in by]
    names, limit = [*by, "n", "mean", "m2"], HELD_POSITIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        types: list[pa.DataType] = []

        def emptied() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            state = [pa.array([getattr(m, v) for m in held.values()], pa.list_(t)) for v, t in (("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()))]
            out = pa.RecordBatch.from_arrays([*keys, *state], names=names)
            held.clear()
            return out

        for batch in batches:
            types = [batch.column(i).type for i in range(len(by))]
            x = batch.column(len(by))
            ends, values = np.asarray(x.offsets), x.values
            known = None if not values.null_count else np.asarray(values.is_valid())
            flat = np.asarray(values.cast(pa.float64()).fill_null(0.0) if known is not None else values.cast(pa.float64()))
            rows: dict[tuple, list[int]] = {}
            keys = zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True) if by else [()] * batch.num_rows
            for i, (key, fine) in enumerate(zip(keys, x.is_valid().to_pylist(), strict=True)):
                if fine and ends[i + 1] > ends[i]:
                    rows.setdefault((*key, int(ends[i + 1] - ends[i])), []).append(i)
            for (*key, width), own in rows.items():
                at = ends[own][:, None] + np.arange(width)
                held.setdefault(tuple(key), Moments()).add(flat[at], None if known is None else known[at])
            if sum(len(m.n) for m in held.values()) > limit:
                yield emptied()
        if held:
            yield emptied()

    return arrays.select(*by, samples).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in zip(by, kinds, strict=True)), "n array<long>", "mean array<double>", "m2 array<double>"]))


def positional_scaling(arrays: DataFrame, samples: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean and sample deviation of each position of an array column; both are 0 where fewer than two rows have it.

    Tasks hand on a state for each key, which are merged position by position: deviations from the common mean, so nothing
    is lost between large and close values."""
    parts = position_states(arrays, samples, by).select(*by, F.posexplode(F.arrays_zip("n", "mean", "m2")).alias("pos", "p"))
    w = W.partitionBy(*by, "pos")
    common = F.try_divide(F.sum(F.col("p.n") * F.col("p.mean")).over(w), F.sum("p.n").over(w))
    own = parts.select(*by, "pos", "p", F.coalesce(common, F.lit(0.0)).alias("m"))
    off = F.col("p.mean") - F.col("m")
    s = own.groupBy(*by, "pos").agg(F.sum("p.n").alias("n"), F.any_value("m").alias("m"), F.sum(F.col("p.m2") + F.col("p.n") * off * off).alias("m2"))
    few = F.col("n") < 2
    return s.select(*by, "pos", "n", F.when(few, F.lit(0.0)).otherwise(F.col("m")).alias("mean"), F.when(few, F.lit(0.0)).otherwise(F.sqrt(F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("std"))


def packed(scaling: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each ``by``) with arrays mean and std in order of position; as long as an epoch."""
    row = F.array_sort(F.collect_list(F.struct("pos", "mean", "std")))
    return scaling.groupBy(*by).agg(row.alias("r")).select(*by, F.transform("r", lambda x: x["mean"]).alias("mean"), F.transform("r", lambda x: x["std"]).alias("std"))


def standardised(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std position by position; null where the deviation is 0."""
    centred = F.zip_with(x, mean, lambda a, m: a.cast("double") - m)
    return F.zip_with(centred, std, lambda a, s: F.try_divide(a, s))


def restored(z: Column, mean: Column, std: Column) -> Column:
    """z * std + mean position by position."""
    return F.zip_with(F.zip_with(z, std, lambda a, s: a * s), mean, lambda a, m: a + m)


def standardise(arrays: DataFrame, scaling: DataFrame, samples: str, into: str) -> DataFrame:
    """The arrays with their standardised form; the statistics are one row, as long as an epoch."""
    return arrays.crossJoin(F.broadcast(packed(scaling))).withColumn(into, standardised(F.col(samples), F.col("mean"), F.col("std")))


def bad_values(x: Column) -> Column:
    """Whether an array has a NaN or an infinity."""
    return F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def guarded(arrays: DataFrame, samples: str) -> DataFrame:
    """The same rows; the query fails at the first array with a NaN or an infinity."""
    return arrays.where(F.when(bad_values(F.col(samples)), F.raise_error(F.lit("NaN or infinity in samples")).cast("boolean")).otherwise(F.lit(True)))
