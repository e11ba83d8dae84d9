"""Attributions of a model's scores to its inputs, by gradients along straight paths from baselines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightloom.training.loop import columns

#: Baselines go to every task with the model; more are refused.
MOST_BASELINES = 4096


def collected_baselines(baselines: DataFrame, x: str = "x", order: str | None = None) -> np.ndarray:
    """Baselines as a matrix, in an order if one is named; they are a model's parameters, and more than MOST_BASELINES are an error."""
    rows = (baselines if order is None else baselines.orderBy(order)).select(x).limit(MOST_BASELINES + 1).collect()
    if not rows or len(rows) > MOST_BASELINES:
        raise ValueError(f"from 1 to {MOST_BASELINES} baselines")
    return np.array([r[0] for r in rows], dtype=np.float64)


def nodes(points: int) -> tuple[np.ndarray, np.ndarray]:
    """Places between 0 and 1 and their weights, by Gauss and Legendre's rule: exact for polynomials below twice the points."""
    t, w = np.polynomial.legendre.leggauss(points)
    return (t + 1) / 2, w / 2


def attributed(model, params: np.ndarray, x: np.ndarray, target: np.ndarray, baselines: np.ndarray, points: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(attributions, change) of each row: its difference to each baseline times the mean gradient of its target's score along the
    way, and the change of the score, both averaged over the baselines. The attributions add up to the change as far as
    the rule is exact."""
    total, change, at = np.zeros(x.shape), np.zeros(len(x)), np.arange(len(x))
    end = model.scores(params, x)[at, target]
    t, w = nodes(points)
    for b in baselines:
        way = x - b
        mean = sum(wk * model.input_gradient(params, b + tk * way, target) for tk, wk in zip(t, w, strict=True))
        total += way * mean
        change += end - model.scores(params, np.repeat(b[None, :], len(x), 0))[at, target]
    return total / len(baselines), change / len(baselines)


def expected_gradients(rows: DataFrame, model, params: np.ndarray, baselines: np.ndarray, points: int = 32, x: str = "x", target: str | None = None) -> DataFrame:
    """The rows with attributions (array<double>), change and target; the target is the column of that name, or the class of
    the highest score. One baseline gives integrated gradients. Rows must have features; rows are taken a batch at a time."""
    names, own = rows.schema.names, [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("attributions", "change", "target")]
    at = names.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                features, given = columns(batch, at, None if target is None else names.index(target))
                to = model.scores(params, features).argmax(1) if given is None else given.astype(int)
                a, change = attributed(model, params, features, to, baselines, points)
                kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("attributions", "change", "target")]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(list(a), pa.list_(pa.float64())), pa.array(change), pa.array(to, pa.int32())], names=[*(n for n, _ in kept), "attributions", "change", "target"])

    return rows.mapInArrow(run, ", ".join([*own, "attributions array<double>", "change double", "target int"]))
