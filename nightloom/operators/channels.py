"""Channel choice and derivations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_channels(epochs: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Only the named channels, with their place in the caller's order."""
    return epochs.where(F.col("channel").isin(*channels)).withColumn("channel_idx", F.array_position(F.array(*map(F.lit, channels)), F.col("channel")).cast("int") - 1)


def resolve(headers: DataFrame, candidates: DataFrame, record: Sequence[str] = ("record_id",)) -> DataFrame:
    """The first candidate, by priority, whose labels a record has, compared in upper case.

    headers: (record, label); candidates: (modality, priority, a, b), where b is null for a single channel. The candidate
    lists are constants of a few dozen rows. Result: (record, modality, priority, a, b) with the labels as they are written."""
    own = headers.select(*record, F.upper("label").alias("_up"), "label").groupBy(*record, "_up").agg(F.min("label").alias("label"))
    of_a = own.join(F.broadcast(candidates), F.col("_up") == F.upper("a")).select(*record, "modality", "priority", F.col("label").alias("_a"), "b")
    single = of_a.where("b IS NULL").select(*record, "modality", "priority", "_a", F.lit(None).cast("string").alias("_b"))
    b = own.select(*[F.col(r).alias(f"_r_{r}") for r in record], F.col("_up").alias("_ub"), F.col("label").alias("_b"))
    same = F.col("_ub") == F.upper("b")
    for r in record:
        same = same & (F.col(r) == F.col(f"_r_{r}"))
    pairs = of_a.where("b IS NOT NULL").join(b, same).select(*record, "modality", "priority", "_a", "_b")
    best = single.unionByName(pairs).groupBy(*record, "modality").agg(F.min(F.struct("priority", "_a", "_b")).alias("best"))
    return best.select(*record, "modality", "best.priority", F.col("best._a").alias("a"), F.col("best._b").alias("b"))


def bipolar(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def additive(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def derive(epochs: DataFrame, plus: str, minus: str, name: str, record: Sequence[str] = ("subject_id", "epoch_idx"), sign: int = -1, samples: str = "samples") -> DataFrame:
    """A new channel from two others of the same epoch: one grouping by epoch, no self-join."""
    own = epochs.where(F.col("channel").isin(plus, minus)).groupBy(*record)
    both = own.agg(F.min_by(samples, "channel").alias("_x"), F.max_by(samples, "channel").alias("_y"), F.countDistinct("channel").alias("_n")).where("_n = 2")
    first, second = ("_x", "_y") if plus < minus else ("_y", "_x")
    combine = bipolar if sign < 0 else additive
    return both.select(*record, F.lit(name).alias("channel"), combine(F.col(first), F.col(second)).alias(samples))


def cut_epochs(x: Column, width: int) -> Column:
    """An array of samples as an array of whole epochs; a remainder goes."""
    n = F.floor(F.size(x) / F.lit(width)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * width + 1, width))).otherwise(F.array().cast("array<array<float>>"))


def pad_left(x: Column, width: int) -> Column:
    """Zeros in front, up to a multiple of the epoch."""
    return F.concat(F.array_repeat(F.lit(0.0).cast("float"), ((F.lit(width) - F.size(x) % width) % width).cast("int")), x)
