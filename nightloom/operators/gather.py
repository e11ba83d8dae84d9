"""Sequences of epochs with their samples, gathered as a stream: each epoch is shuffled once, by its record, whatever the length.

The rows of a record, one for its number of labels, one for each label and one for each channel of each epoch, meet in one
partition, sorted. A task then walks along them and holds no more than the epochs of one sequence. Samples travel as they are
stored; they are standardised on arrival, each epoch once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sequences that a batch for Spark holds.
BATCH_BYTES = 8 << 20


class Walk:
    """The sequences of one record after another, from rows in the order of (record, epoch, channel)."""

    def __init__(self, length: int, n_channels: int, pad: np.ndarray, pad_stage: int):
        self.length, self.n_channels, self.pad, self.pad_stage = length, n_channels, pad, pad_stage
        self.record, self.n, self.next = None, 0, 0
        self.stages: dict[int, int] = {}
        self.epochs: dict[int, dict[int, np.ndarray]] = {}

    def start(self, record: str, n: int) -> None:
        self.record, self.n, self.next = record, n, 0
        self.stages, self.epochs = {}, {}

    @property
    def last(self) -> int:
        """The last sequence's start; none in a record without labels."""
        return max(self.n - self.length, 0) if self.n else -1

    def ready(self, epoch: int | None) -> Iterator[tuple[str, int, list[int], list[np.ndarray]]]:
        """Sequences that end before an epoch (none: all that are left)."""
        while self.next <= self.last and (epoch is None or self.next + self.length <= epoch):
            at = range(self.next, self.next + self.length)
            parts = []
            for e in at:
                own = self.epochs.get(e, {})
                parts.append(np.stack([own[c] for c in range(self.n_channels)]) if len(own) == self.n_channels else self.pad)
            yield self.record, self.next, [self.stages.get(e, self.pad_stage) for e in at], parts
            self.stages.pop(self.next, None)
            self.epochs.pop(self.next, None)
            self.next += 1


def _nested(rows: list, schema_names: Sequence[str]) -> pa.RecordBatch:
    """Sequences as one batch; a sample is null where its deviation was 0."""
    flat = np.concatenate([p.reshape(-1) for r in rows for p in r[3]])
    counts = [len(r[3]) for r in rows]
    channels, width = rows[0][3][0].shape
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    values = pa.array(flat, pa.float64(), mask=np.isneginf(flat))
    inner = pa.ListArray.from_arrays(offsets([width] * (sum(counts) * channels)), values)
    epochs = pa.ListArray.from_arrays(offsets([channels] * sum(counts)), inner)
    x = pa.ListArray.from_arrays(offsets(counts), epochs)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), x], names=list(schema_names))


def standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """(x - mean) / std; minus infinity, which stands for null, where the deviation is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(std == 0, -np.inf, (x.astype(np.float64) - mean) / std)


def samples(labels: DataFrame, signal: DataFrame, stats: list[tuple[np.ndarray, np.ndarray]], pad: np.ndarray, length: int, n_channels: int, pad_stage: int) -> DataFrame:
    """(record, rel_idx, stages, x) of all sequences. labels (record, epoch_idx, stage); signal (record, epoch_idx, channel_idx,
    stat, samples), where stat is the place of the mean and deviation among ``stats``."""
    none = F.lit(None)
    counted = labels.groupBy("record").agg(F.count("*").cast("int").alias("v"))
    head = counted.select("record", F.lit(-1).alias("e"), F.lit(-1).alias("c"), "v", none.cast("array<float>").alias("s"))
    own = labels.select("record", F.col("epoch_idx").cast("int").alias("e"), F.lit(-1).alias("c"), F.col("stage").cast("int").alias("v"), none.cast("array<float>").alias("s"))
    data = signal.select("record", F.col("epoch_idx").cast("int").alias("e"), F.col("channel_idx").cast("int").alias("c"), F.col("stat").cast("int").alias("v"), F.col("samples").cast("array<float>").alias("s"))
    rows = head.unionByName(own).unionByName(data).repartition("record").sortWithinPartitions("record", "e", "c")
    names = ("record", "rel_idx", "stages", "x")
    most = max(1, BATCH_BYTES // max(1, pad.size * 8 * length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held = Walk(length, n_channels, pad, pad_stage), []
        for batch in batches:
            arrays = batch.column(4)
            ends, values = np.asarray(arrays.offsets), np.asarray(arrays.values)
            for i, (record, e, c, v) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)):
                if e == -1 or record != walk.record:
                    held += walk.ready(None)
                    walk.start(record, v if e == -1 else 0)
                    if e == -1:
                        continue
                for one in walk.ready(e):
                    held.append(one)
                    if len(held) >= most:
                        yield _nested(held, names)
                        held = []
                if c == -1:
                    walk.stages[e] = v
                elif e >= walk.next:
                    walk.epochs.setdefault(e, {})[c] = standard(values[ends[i] : ends[i + 1]], *stats[v])
            while len(held) >= most:
                yield _nested(held[:most], names)
                held = held[most:]
        held += walk.ready(None)
        for at in range(0, len(held), most):
            yield _nested(held[at : at + most], names)

    return rows.mapInArrow(run, "record string, rel_idx int, stages array<int>, x array<array<array<double>>>")
