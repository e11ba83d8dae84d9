"""Records as wholes: constants, concatenation, pairing, cropping, validation and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Subject numbers that the constant list leaves out, of 0 to 82.
MISSING_SUBJECTS = (39, 68, 69, 78, 79)


def constant_subjects(spark: SparkSession) -> DataFrame:
    return spark.range(83).select(F.col("id").cast("int").alias("record")).where(~F.col("record").isin(*MISSING_SUBJECTS))


def concatenated(epochs: DataFrame, subject: Sequence[str], recording: str, order: str = "epoch_idx") -> DataFrame:
    """Several recordings of a subject as one: epochs numbered through, in the order of recordings."""
    w = W.partitionBy(*subject).orderBy(recording, order)
    return epochs.withColumn("epoch_idx_all", F.row_number().over(w) - 1)


def crop_wake(labels: DataFrame, epochs: int, record: Sequence[str] = ("subject_id",)) -> DataFrame:
    """From so many epochs before the first that is not wake to as many after the last; all of a record without any."""
    sleep = F.when(F.col("stage") != 0, F.col("epoch_idx"))
    bounds = labels.groupBy(*record).agg((F.min(sleep) - epochs).alias("_lo"), (F.max(sleep) + epochs).alias("_hi"))
    return labels.join(bounds, [*record]).where(F.col("_lo").isNull() | F.col("epoch_idx").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def drop_ends(rows: DataFrame, record: Sequence[str], order: Sequence[str], first: int = 0, last: int = 0) -> DataFrame:
    """Without the first and the last few rows of each record."""
    w = W.partitionBy(*record)
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("_r") > first) & (F.col("_r") <= F.col("_n") - last)).drop("_r", "_n")


def validated(labels: DataFrame, low: int, high: int, stage: str = "stage") -> DataFrame:
    """The same rows; the query fails at the first stage out of range."""
    ok = F.col(stage).between(low, high)
    return labels.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("stage out of range")).cast("boolean")))


def by_hash(*key: str) -> Column:
    """A fixed pseudo-random order of rows: a digest of their key as text, which other engines have too."""
    return F.md5(F.concat_ws("/", *key).cast("binary"))


def first_by_hash(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows in the order of a hash of their key: a sample that is the same everywhere."""
    return rows.orderBy(by_hash(*key), *key).limit(n)


def shuffled_batches(rows: DataFrame, size: int, shards: int, *key: str) -> DataFrame:
    """batch and place of each row, in the order of a hash; numbered within shards, so that no task sorts everything."""
    h = by_hash(*key)
    shard = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(shards))
    ranked = rows.withColumn("shard", shard).withColumn("place", F.row_number().over(W.partitionBy("shard").orderBy(h, *key)) - 1)
    return ranked.withColumn("batch", F.expr(f"place div {size}"))


def resume_epoch(logs: DataFrame) -> DataFrame:
    """The last epoch in the newest version of a training log: versions compare as text."""
    newest = logs.agg(F.max("version").alias("version"))
    return logs.join(F.broadcast(newest), "version").groupBy("version").agg(F.max("epoch").alias("epoch"))


def merged_statistics(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, mean and deviation from partial states (n, mean, m2), merged pair-free: sums of n, n mean and n mean squared."""
    s = parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("_q"))
    mean = F.try_divide(F.col("_s"), F.col("n"))
    few = F.col("n") < 2
    var = (F.col("_q") - F.col("n") * mean * mean) / F.greatest(F.col("n") - 1, F.lit(1))
    return s.select(*by, "n", F.when(few, 0.0).otherwise(mean).alias("mean"), F.when(few, 0.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"))


def with_age(subjects: DataFrame, text: str = "age_text") -> DataFrame:
    """Age from texts such as 34yr; records without one go."""
    age = F.regexp_extract(text, r"^(\d+)yr$", 1)
    return subjects.withColumn("age", F.when(age != "", age.cast("double"))).dropna(subset=["age"])


def parallel(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Two views of the same epochs, such as samples and spectra, side by side."""
    return a.join(b, [*key])


def covering(intervals: DataFrame, start: str, stop: str, step: int = 1) -> DataFrame:
    """One row for each unit that an interval [start, stop) touches: the equi-join form of a range join."""
    return intervals.where(F.col(stop) > F.col(start)).withColumn("unit", F.explode(F.sequence(F.expr(f"{start} div {step}"), F.expr(f"({stop} - 1) div {step}"))))


def within(intervals: DataFrame, units: DataFrame, on: Sequence[str], start: str, stop: str, unit: str, step: int = 64) -> DataFrame:
    """Each unit with each interval [start, stop) that holds it, by a join within bins of ``step`` units. Only intervals, once
    for each bin that they touch, and units are shuffled; their pairs are not."""
    pieces = covering(intervals, start, stop, step).withColumnRenamed("unit", "_bin")
    binned = units.withColumn("_bin", F.expr(f"{unit} div {step}"))
    return pieces.join(binned, [*on, "_bin"]).where((F.col(unit) >= F.col(start)) & (F.col(unit) < F.col(stop))).drop("_bin")


def in_hours(seconds: Column) -> Column:
    return seconds / 3600
