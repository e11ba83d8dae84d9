"""Epochs of live samples: tumbling epochs, sliding sequences, online statistics, sessions and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(samples: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Watermarked; a time without a zone is taken as the session's."""
    return samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(samples: DataFrame, record: str, value: str, epoch: str = "30 seconds", time: str = "ts") -> DataFrame:
    """n, mean and sample deviation of each record's epochs."""
    out = samples.groupBy(record, F.window(time, epoch)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.select(record, F.col("window.start").alias("start"), "n", "mean", F.coalesce("std", F.lit(0.0)).alias("std"))


def sliding(samples: DataFrame, record: str, value: str, length: int = 21, epoch_s: int = 30, time: str = "ts") -> DataFrame:
    """Means over sequences of ``length`` epochs that start at every epoch."""
    out = samples.groupBy(record, F.window(time, f"{length * epoch_s} seconds", f"{epoch_s} seconds")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(record, F.col("window.start").alias("start"), "n", "mean")


def sessions(samples: DataFrame, record: str, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    """Recordings as runs of samples without a gap."""
    out = samples.groupBy(record, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return out.select(record, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique(samples: DataFrame, *key: str) -> DataFrame:
    """Samples that are sent again within the watermark come once."""
    return samples.dropDuplicatesWithinWatermark(list(key))


def running_scaling(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Online mean and deviation of each key, for update mode; both 0 below two samples."""
    few = F.count(value) < 2
    return samples.groupBy(by).agg(F.count(value).alias("n"), F.when(few, 0.0).otherwise(F.avg(value)).alias("mean"), F.when(few, 0.0).otherwise(F.stddev_samp(value)).alias("std"))
