"""Partitioned writes of the normalised tables, with their guards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import scaling

HALF_MAX = 65504.0  # fixed value: the largest number of half precision


def write_table(rows: DataFrame, path: str, *by: str, mode: str = "overwrite", sort: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned, with rows sorted within files so that readers can skip row groups."""
    if by:
        rows = rows.repartition(*[F.col(c) for c in by], *[F.col(c) for c in sort[:1]])
    if sort:
        rows = rows.sortWithinPartitions(*by, *sort)
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_epochs(epochs: DataFrame, path: str) -> None:
    write_table(epochs, path, "dataset", sort=("subject_id", "epoch_idx"))


def write_labels(labels: DataFrame, path: str) -> None:
    write_table(labels.withColumn("stage", F.col("stage").cast("smallint")), path, "dataset", sort=("subject_id", "epoch_idx"))


def halved(samples: str) -> Column:
    """An array of numbers as the bytes of half-precision ones."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else np.asarray(x, dtype="<f2").tobytes())

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(samples)


def restored(half: str) -> Column:
    """The numbers that halved() stored."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f2").astype(np.float32))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(half)


def write_bundle(epochs: DataFrame, folds: DataFrame, path: str, samples: str = "samples", fold: int = 0, half: Sequence[str] = ()) -> None:
    """Epochs by split; fails at a NaN or an infinity. Samples of the data sets named in ``half`` are stored in half precision,
    as bytes, and fail where that makes them infinite."""
    own = folds.where(F.col("fold") == fold).select("dataset", "subject_id", "split")
    rows = scaling.guarded(epochs, samples).join(own, ["dataset", "subject_id"])
    if half:
        short = F.col("dataset").isin(*half)
        largest = F.array_max(F.transform(samples, lambda x: F.abs(x)))
        fits = F.when(short & (largest > HALF_MAX), F.raise_error(F.lit("samples too large for half precision")).cast("boolean")).otherwise(F.lit(True))
        rows = rows.where(fits).withColumn("half", F.when(short, halved(samples))).withColumn(samples, F.when(~short, F.col(samples)))
    write_table(rows, path, "split", sort=("subject_id", "epoch_idx"))


def read_bundle(spark: SparkSession, path: str, split: str, samples: str = "samples") -> DataFrame:
    """A split's epochs, in single precision."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    if "half" not in rows.columns:
        return rows
    return rows.withColumn(samples, F.coalesce(F.col(samples), restored("half"))).drop("half")


def write_report(rows: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
