"""Sliding sequences of epochs, whole records, padding and targets.

Sequences carry keys only, (record, rel_idx, off, epoch_idx); samples are joined to them last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nightloom.schema import PAD_STAGE, SEQUENCE_LENGTH


def subject_table(labels: DataFrame, record: str = "subject_id") -> DataFrame:
    """num_windows of each record, and its start and end in the order of records. One row a record, so one task orders them."""
    n = labels.groupBy(record).agg(F.count("*").alias("num_windows"))
    w = W.orderBy(record).rowsBetween(W.unboundedPreceding, W.currentRow)
    return n.withColumn("end_index", F.sum("num_windows").over(w)).withColumn("start_index", F.col("end_index") - F.col("num_windows")).select(record, "num_windows", "start_index", "end_index")


def sequence_counts(labels: DataFrame, length: int = SEQUENCE_LENGTH, record: str = "subject_id") -> DataFrame:
    n = labels.groupBy(record).agg(F.count("*").alias("num_windows"))
    return n.withColumn("sequences", F.greatest(F.col("num_windows") - length, F.lit(0)) + 1)


def sequence_index(labels: DataFrame, length: int = SEQUENCE_LENGTH, record: str = "subject_id") -> DataFrame:
    """(record, rel_idx): every start of a sequence within a record; a short record has one."""
    n = labels.groupBy(record).agg(F.count("*").alias("num_windows"))
    return n.select(record, "num_windows", F.explode(F.sequence(F.lit(0), F.greatest(F.col("num_windows") - length, F.lit(0)).cast("int"))).alias("rel_idx"))


def sequences(labels: DataFrame, length: int = SEQUENCE_LENGTH, record: str = "subject_id", pad: int = PAD_STAGE) -> DataFrame:
    """(record, rel_idx, off, epoch_idx, stage, padded): positions beyond the record have the pad stage."""
    index = sequence_index(labels, length, record).select(record, "rel_idx", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("off")).withColumn("epoch_idx", F.col("rel_idx") + F.col("off"))
    own = labels.select(record, F.col("epoch_idx").cast("int").alias("epoch_idx"), "stage")
    out = index.join(own, [record, "epoch_idx"], "left")
    return out.select(record, "rel_idx", "off", "epoch_idx", F.coalesce("stage", F.lit(pad)).alias("stage"), F.col("stage").isNull().alias("padded"))


def gathered(values: DataFrame, value: str, length: int, record: str = "subject_id") -> DataFrame:
    """(record, rel_idx, the values in order) of whole sequences, by a frame of rows: no join."""
    w = W.partitionBy(record).orderBy("epoch_idx").rowsBetween(0, length - 1)
    out = values.select(record, F.col("epoch_idx").alias("rel_idx"), F.collect_list(value).over(w).alias(value))
    return out.where(F.size(value) == length)


def padded_signal(values: DataFrame, value: str, length: int, record: str = "subject_id") -> DataFrame:
    """As sequences(), for a numeric column that is zero beyond the record."""
    own = values.select(record, F.col("epoch_idx").cast("int").alias("epoch_idx"), value)
    index = sequence_index(values, length, record).select(record, "rel_idx", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("off")).withColumn("epoch_idx", F.col("rel_idx") + F.col("off"))
    return index.join(own, [record, "epoch_idx"], "left").select(record, "rel_idx", "off", F.coalesce(value, F.lit(0.0)).alias(value))


def middle_labels(labels: DataFrame, length: int = SEQUENCE_LENGTH, record: str = "subject_id", pad: int = PAD_STAGE) -> DataFrame:
    """(record, rel_idx, stage at (length - 1) div 2)."""
    at = (length - 1) // 2
    index = sequence_index(labels, length, record).withColumn("epoch_idx", F.col("rel_idx") + at)
    own = labels.select(record, F.col("epoch_idx").cast("int").alias("epoch_idx"), "stage")
    return index.join(own, [record, "epoch_idx"], "left").select(record, "rel_idx", F.coalesce("stage", F.lit(pad)).alias("stage"))


def middle(stages: Column) -> Column:
    """Target transform: the middle of an array of stages."""
    return F.element_at(stages, ((F.size(stages) - 1) / 2).cast("int") + 1)


def whole_records(labels: DataFrame, record: str = "subject_id") -> DataFrame:
    """One row a record: its stages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("epoch_idx", "stage")))
    return labels.groupBy(record).agg(ordered.alias("epochs")).select(record, F.transform("epochs", lambda e: e["stage"]).alias("stages"))


def global_positions(labels: DataFrame, record: str = "subject_id") -> DataFrame:
    """Adds pos, the place in the concatenation of all records: the record's start and the epoch's number; no global sort."""
    starts = subject_table(labels, record).select(record, "start_index")
    return labels.join(starts, record).withColumn("pos", F.col("start_index") + F.col("epoch_idx")).drop("start_index")


def crossing_sequences(labels: DataFrame, length: int = SEQUENCE_LENGTH, record: str = "subject_id") -> DataFrame:
    """(start, off, stage) over the concatenation of records, across their ends; N - length + 1 sequences."""
    at = global_positions(labels, record)
    total = at.agg(F.count("*").alias("total"))
    out = at.crossJoin(F.broadcast(total)).select("stage", "pos", "total", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("off")).withColumn("start", F.col("pos") - F.col("off"))
    return out.where((F.col("start") >= 0) & (F.col("start") <= F.col("total") - length)).select("start", "off", "stage")
