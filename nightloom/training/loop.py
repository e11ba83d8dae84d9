"""Training of models on tables of examples: data-parallel gradient steps, checkpoints, a log, and resumption.

Examples are rows with an array of features and a label. They are dealt to batches by a hash of their key and written once,
partitioned by batch, so a step reads its batch's files and no others. The driver sends the parameters to the tasks of a
step; each adds the gradients of its rows up, block by block, and only these sums come back, combined by a few tasks first
where there are many. What the driver holds is as large as the model.

A folder of a run has ``log`` (a row for each validation), ``last`` (the state after the newest complete epoch: parameters,
both moments, the scheduler) and ``best`` (the best parameters by the monitored metric, of equals the first). A run that is
started again in its folder goes on behind its last complete epoch, and ends as it would have without the break.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import metrics
from nightloom.sources import store
from nightloom.training.optim import Adam, Plateau

LOG = "epoch int, step long, rate double, train_loss double, val_loss double, val_acc double"
STATE = "epoch int, step long, rate double, params array<double>, first array<double>, second array<double>, plateau_best double, plateau_waited int, best double"
#: Sums of gradients that the driver takes at once; more are added up by as many tasks first.
FAN_IN = 64


@dataclass
class Settings:
    """``batches`` of about ``batch_rows`` rows each, but at most ``max_batches``; ``monitor`` names a column of the log."""

    learning_rate: float = 1e-3
    weight_decay: float = 0.0
    batch_rows: int = 4096
    max_batches: int = 256
    epochs: int = 10
    validations: int = 1
    monitor: str = "val_acc"
    mode: str = "max"
    seed: int = 42


@dataclass
class Fitted:
    """A trained model: the best parameters, the last ones, and the log."""

    model: object
    params: np.ndarray
    last: np.ndarray
    log: DataFrame


def columns(batch: pa.RecordBatch, x: int = 0, y: int | None = 1) -> tuple[np.ndarray, np.ndarray | None]:
    """Features as a matrix, and labels. All rows must have as many features."""
    values = batch.column(x)
    flat = np.asarray(values.flatten(), dtype=np.float64)
    return flat.reshape(len(values), -1), None if y is None else np.asarray(batch.column(y))


def gradient_sums(rows: DataFrame, model, params: np.ndarray, x: str = "x", y: str = "y") -> tuple[int, float, np.ndarray]:
    """(rows, sum of losses, sum of gradients) of all rows with features and a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros(len(params))
        for batch in batches:
            if batch.num_rows:
                own, g = model.gradient(params, *columns(batch))
                n, loss, total = n + batch.num_rows, loss + own, total + g
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([total.tobytes()])], names=["n", "loss", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros(len(params))
        for batch in batches:
            for a, b, c in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                n, loss, total = n + a, loss + b, total + np.frombuffer(c)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([total.tobytes()])], names=["n", "loss", "total"])

    schema = "n long, loss double, total binary"
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    parts = own.mapInArrow(run, schema)
    if own.rdd.getNumPartitions() > FAN_IN:
        parts = parts.repartition(FAN_IN).mapInArrow(add, schema)
    n, loss, total = 0, 0.0, np.zeros(len(params))
    for r in parts.collect():
        n, loss, total = n + r["n"], loss + r["loss"], total + np.frombuffer(bytes(r["total"]))
    return n, loss, total


def predict(rows: DataFrame, model, params: np.ndarray, x: str = "x", into: str = "scores") -> DataFrame:
    """The rows with each one's scores; rows without features have none."""
    schema = rows.schema
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), f"`{into}` array<double>"])
    at = schema.names.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.flatnonzero(np.asarray(batch.column(at).is_valid()))
            out: list = [None] * batch.num_rows
            if len(fine):
                features, _ = columns(batch.take(pa.array(fine)), at, None)
                for i, s in zip(fine, model.scores(params, features), strict=True):
                    out[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, kind)


def best_class(scores: Column) -> Column:
    """The class of the highest score; of equals the lowest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def row_loss(model, scores: Column, y: Column) -> Column:
    """A row's loss from its scores, in the JVM."""
    if model.kind == "cel":
        top = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return F.log(total) + top - F.element_at(scores, y.cast("int") + 1)
    e = y - F.element_at(scores, 1)
    return e * e if model.kind == "mse" else metrics.huber(y, F.element_at(scores, 1))


def validated(rows: DataFrame, model, params: np.ndarray, x: str = "x", y: str = "y") -> tuple[float, float]:
    """(mean loss, accuracy) over all labelled rows; of a regression, the accuracy is null (nan)."""
    own = predict(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), model, params, x)
    hit = (best_class(F.col("scores")) == F.col(y)).cast("double") if model.kind == "cel" else F.lit(None).cast("double")
    r = own.agg(F.avg(row_loss(model, F.col("scores"), F.col(y))).alias("loss"), F.avg(hit).alias("acc")).first()
    return (float("nan") if r["loss"] is None else r["loss"]), (float("nan") if r["acc"] is None else r["acc"])


def dealt(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """Rows with their batch, by a hash of their key."""
    return rows.withColumn("batch", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))


def _saved(spark: SparkSession, folder: str, name: str, row: tuple, schema: str) -> None:
    """Writes one state and then removes the older ones; a state counts once it is whole."""
    before = store.folders(spark, folder)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
    for old in before:
        if old != name:
            store.remove(spark, f"{folder}/{old}")


def _newest(spark: SparkSession, folder: str) -> dict | None:
    for name in reversed(store.folders(spark, folder)):
        if store.exists(spark, f"{folder}/{name}/_SUCCESS"):
            return spark.read.parquet(f"{folder}/{name}").first().asDict()
    return None


def checkpoint(spark: SparkSession, path: str, which: str = "best") -> np.ndarray:
    """The parameters that a run has saved."""
    found = _newest(spark, f"{path}/{which}")
    if found is None:
        raise FileNotFoundError(f"no checkpoint in {path}/{which}")
    return np.array(found["params"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A row for each validation, in the order of steps."""
    if not store.folders(spark, f"{path}/log"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(f"{path}/log/*").orderBy("step")


def fit(examples: DataFrame, valid: DataFrame, model, path: str, settings: Settings | None = None, params: np.ndarray | None = None, resume: bool = True, key: tuple[str, ...] = ("record", "epoch_idx"), x: str = "x", y: str = "y") -> Fitted:
    """Trains on examples (key, x, y) and validates on such rows. ``params``: where it starts, instead of ``model.start()``.

    Rows without features or label teach nothing. Nothing to train on is an error."""
    s, spark = settings or Settings(), examples.sparkSession
    own = examples.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, x, y)
    rows = own.count()
    if not rows:
        raise ValueError("no examples with features and a label")
    n = max(1, min(s.max_batches, -(-rows // s.batch_rows)))
    work = f"{path}/work-{uuid.uuid4().hex}"
    shards = max(1, -(-rows // n // 65_536))
    dealt(own, n, *key).repartition("batch", F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(shards))).write.partitionBy("batch").parquet(work)
    names = store.folders(spark, work)
    parts = [spark.read.parquet(f"{work}/{name}") for name in names]
    optimiser, plateau = Adam(s.learning_rate, s.weight_decay), Plateau()
    now = model.start() if params is None else np.array(params, dtype=np.float64)
    sign, best, done = (1 if s.mode == "max" else -1), -float("inf"), -1
    state = _newest(spark, f"{path}/last") if resume else None
    if not resume:
        for old in ("last", "best", "log"):
            store.remove(spark, f"{path}/{old}")
    if state is not None:
        now, done, best = np.array(state["params"]), state["epoch"], state["best"]
        optimiser.rate, optimiser.steps, optimiser.first, optimiser.second = state["rate"], state["step"], np.array(state["first"]), np.array(state["second"])
        plateau.best, plateau.waited = state["plateau_best"], state["plateau_waited"]
    for epoch in range(done + 1, s.epochs):
        order = np.random.default_rng((s.seed, epoch)).permutation(len(parts))
        stops = {round(len(parts) * (i + 1) / s.validations) for i in range(s.validations)}
        losses, seen, logged, val_loss = 0.0, 0, [], float("nan")
        for i, at in enumerate(order, 1):
            count, loss, total = gradient_sums(parts[at], model, now, x, y)
            now = optimiser.step(now, total / count)
            losses, seen = losses + loss, seen + count
            if i in stops:
                val_loss, val_acc = validated(valid, model, now, x, y)
                row = (epoch, optimiser.steps, optimiser.rate, losses / seen, val_loss, val_acc)
                logged.append(row)
                value = sign * dict(zip(("epoch", "step", "rate", "train_loss", "val_loss", "val_acc"), row, strict=True))[s.monitor]
                if value > best:
                    best = value
                    _saved(spark, f"{path}/best", f"step-{optimiser.steps:09d}", (epoch, optimiser.steps, optimiser.rate, now.tolist(), value * sign), "epoch int, step long, rate double, params array<double>, metric double")
        optimiser.rate = plateau.step(val_loss, optimiser.rate)
        spark.createDataFrame(logged, LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/epoch-{epoch:05d}")
        _saved(spark, f"{path}/last", f"epoch-{epoch:05d}", (epoch, optimiser.steps, optimiser.rate, now.tolist(), optimiser.first.tolist(), optimiser.second.tolist(), plateau.best, plateau.waited, best), STATE)
    store.remove(spark, work)
    found = _newest(spark, f"{path}/best")
    return Fitted(model, now if found is None else np.array(found["params"]), now, read_log(spark, path))


def finetune(examples: DataFrame, valid: DataFrame, model, params: np.ndarray, path: str, learning_rate: float = 1e-7, weight_decay: float | None = None, settings: Settings | None = None, **more) -> Fitted:
    """Goes on from saved parameters with a rate of its own; the decay is the rate unless given. Never resumes."""
    own = Settings(**(asdict(settings or Settings()) | {"learning_rate": learning_rate, "weight_decay": learning_rate if weight_decay is None else weight_decay}))
    return fit(examples, valid, model, path, own, params, resume=False, **more)


def test(rows: DataFrame, model, params: np.ndarray, by: tuple[str, ...] = ("dataset",), record: str = "record", x: str = "x", y: str = "y") -> DataFrame:
    """One row for each data set (``by``; none: one row): records, loss and metrics, each of a record first and then their
    means; a regression has loss, mse, mae and r2."""
    own = predict(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, record, x, y), model, params, x).withColumn("loss", row_loss(model, F.col("scores"), F.col(y)))
    loss = own.groupBy(*by, record).agg(F.avg("loss").alias("loss"))
    if model.kind == "cel":
        each, names = metrics.classification(own.withColumn("p", best_class(F.col("scores"))), [*by, record], y, "p"), metrics.METRICS
    else:
        each, names = metrics.regression(own.withColumn("p", F.element_at("scores", 1)), [*by, record], y, "p"), ("mse", "mae", "r2")
    return each.join(loss, [*by, record]).groupBy(*by).agg(F.count("*").alias("records"), F.avg("loss").alias("loss"), *[F.avg(m).alias(m) for m in names])
