"""Epochs and sequences of live records with state of their own: samples may be late, out of order and sent twice.

For each record the state has the epochs that are open, those that are closed and still needed, the next sequence, and
the running moments of all samples. An epoch closes when it has all of its samples, or is given up when the watermark
has passed its last sample by ``patience``: a timer sees to that, so that silence does not keep a record waiting. A sequence goes out
once, as soon as its epochs are complete; none is made of an epoch that was given up. The state is checkpointed with the
query, and a restart goes on from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "record string, kind string, at long, complete boolean, samples array<array<double>>, n long, mean double, m2 double"


def with_state_store(spark: SparkSession) -> None:
    """State with timers needs the store on disk; for sessions that have not chosen it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Recorder(StatefulProcessor):
    """Rows (record, ts, i, value), i the number of the sample in the record, to epochs of ``width`` samples and sequences of
    ``length`` epochs. Null values and numbers below 0 are left out; of a sample that comes twice the first counts."""

    def __init__(self, width: int, length: int, patience_ms: int = 60_000):
        self.width, self.length, self.patience = width, length, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "epoch long", "values binary, seen binary, due long")
        self.closed = handle.getMapState("closed", "epoch long", "values binary")  # null: given up
        self.head = handle.getValueState("head", "next long, n long, mean double, m2 double")

    def close(self) -> None:
        pass

    def _head(self) -> list:
        return list(self.head.get()) if self.head.exists() else [0, 0, 0.0, 0.0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, out, late = self._head(), [], timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            own = pdf[pdf["value"].notna() & pdf["i"].notna() & (pdf["i"] >= 0)].drop_duplicates("i")
            times = own["ts"].astype("datetime64[ms]").astype("int64")
            for epoch, part in own.groupby(own["i"].astype("int64") // self.width):
                epoch = int(epoch)
                if epoch < head[0] or self.closed.containsKey((epoch,)):
                    continue
                if self.open.containsKey((epoch,)):
                    values, seen, due = self.open.getValue((epoch,))
                    values, seen = np.frombuffer(values).copy(), np.frombuffer(seen, bool).copy()
                else:
                    values, seen, due = np.zeros(self.width), np.zeros(self.width, bool), 0
                at, v = part["i"].to_numpy(np.int64) % self.width, part["value"].to_numpy(float)
                new = ~seen[at]
                values[at[new]], seen[at] = v[new], True
                self._count(head, v[new])
                if seen.all():
                    if self.open.containsKey((epoch,)):
                        self.open.removeKey((epoch,))
                    self.closed.updateValue((epoch,), (values.tobytes(),))
                    out.append(("epoch", epoch, True, [values.tolist()]))
                else:
                    last = max(int(times[part.index].max()), int(late)) + self.patience
                    if last > due:
                        self.handle.registerTimer(last)
                    self.open.updateValue((epoch,), (values.tobytes(), seen.tobytes(), max(due, last)))
        out += self._sequences(head)
        self.head.update(tuple(head))
        yield self._frame(key, out, head)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, head, out = expiredTimerInfo.getExpiryTimeInMs(), self._head(), []
        due = {k[0]: v for k, v in self.open.iterator()}
        over = [e for e, v in due.items() if v[2] <= now]
        if over:
            for epoch in sorted(due):
                if epoch <= max(over):  # what lies before is over as well
                    values, seen = np.frombuffer(due[epoch][0]), np.frombuffer(due[epoch][1], bool)
                    self.open.removeKey((epoch,))
                    self.closed.updateValue((epoch,), (None,))
                    out.append(("epoch", epoch, False, [[float(x) if s else None for x, s in zip(values, seen, strict=True)]]))
            for epoch in range(head[0], max(over)):
                if not self.closed.containsKey((epoch,)):  # of this one nothing has come at all
                    self.closed.updateValue((epoch,), (None,))
            out += self._sequences(head)
            self.head.update(tuple(head))
        yield self._frame(key, out, head)

    @staticmethod
    def _count(head: list, v: np.ndarray) -> None:
        if len(v):
            n, mean, m2 = len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum())
            total, apart = head[1] + n, mean - head[2]
            head[1:] = [total, head[2] + apart * n / total, head[3] + m2 + apart * apart * head[1] * n / total]

    def _sequences(self, head: list) -> list[tuple]:
        """Sequences that are complete now, in order; what no later one needs is forgotten."""
        closed = {k[0]: None if v[0] is None else np.frombuffer(v[0]).tolist() for k, v in self.closed.iterator()}
        out, at = [], head[0]
        while True:
            ready = 0
            while ready < self.length and closed.get(at + ready, None) is not None:
                ready += 1
            if ready == self.length:
                out.append(("sequence", at, True, [closed[e] for e in range(at, at + self.length)]))
                at += 1
            elif at + ready in closed:  # given up
                at += ready + 1
            else:
                break
        for epoch in closed:
            if epoch < at:
                self.closed.removeKey((epoch,))
        head[0] = at
        return out

    def _frame(self, key, out: list[tuple], head: list) -> pd.DataFrame:
        names = ["record", "kind", "at", "complete", "samples", "n", "mean", "m2"]
        return pd.DataFrame([(key[0], *row, *head[1:]) for row in out], columns=names)


def recorded(samples: DataFrame, width: int, length: int, patience_ms: int = 60_000) -> DataFrame:
    """A stream (record string, ts, i, value) with a watermark on ts to OUTPUT: rows of kind ``epoch`` and ``sequence`` with the
    running n, mean and sum of squared deviations of their record."""
    own = samples.selectExpr("record", "ts", "cast(i as long) AS i", "cast(value as double) AS value")
    return own.groupBy("record").transformWithStateInPandas(Recorder(width, length, patience_ms), OUTPUT, "Append", "EventTime")
