"""The folds of several data sets as versions, of which one counts.

A rewrite puts together what is new and the other data sets' folds, writes that whole as a version of its own, checks it, and
only then lets a small file name it. So a rewrite of several data sets happens at once or not at all; whoever reads
meanwhile, or after a failure, has the folds as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.sources import store

SCHEMA = "subject_id int, fold int, split string, dataset string"
SPLITS = ("train", "valid", "test")


def _named(spark: SparkSession, path: str) -> str | None:
    text = store.get_text(spark, f"{path}/folds.current")
    return None if text is None else text.strip()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id, fold, split, dataset). A folder that no rewrite has touched is read as it is."""
    name = _named(spark, path)
    if name is None:
        return spark.read.parquet(f"{path}/folds")
    return spark.read.schema(SCHEMA).parquet(f"{path}/folds/{name}")


def checked(rows: DataFrame) -> None:
    """Raises unless every (data set, person, fold) is in one split that is known."""
    bad = F.col("dataset").isNull() | F.col("subject_id").isNull() | F.col("fold").isNull() | F.coalesce(~F.col("split").isin(*SPLITS), F.lit(True))
    twice = rows.groupBy("dataset", "subject_id", "fold").agg(F.count("*").alias("n")).where("n > 1")
    if (r := rows.where(bad).first()) is not None:
        raise ValueError(f"no fold: {r}")
    if (r := twice.first()) is not None:
        raise ValueError(f"in several splits: {r}")


def rewrite(spark: SparkSession, path: str, new: DataFrame, keep: int = 2) -> str:
    """Replaces the folds of all data sets that ``new`` (dataset, subject_id, fold, split) names, all at once, and returns the
    version. The last ``keep`` versions stay, so that who reads the one before can end."""
    name, before = f"version={uuid.uuid4().hex}", _named(spark, path)
    own = new.select(F.col("subject_id").cast("int").alias("subject_id"), F.col("fold").cast("int").alias("fold"), "split", "dataset")
    version = f"{path}/folds/{name}"
    try:
        rows = own
        if before is not None or store.exists(spark, f"{path}/folds"):
            rest = current(spark, path).select("subject_id", "fold", "split", "dataset")
            rows = own.unionByName(rest.join(own.select("dataset").distinct(), "dataset", "left_anti"))
        rows.repartition("dataset").write.partitionBy("dataset").parquet(version)
        checked(spark.read.schema(SCHEMA).parquet(version))
    except Exception:
        store.remove(spark, version)
        raise
    store.put_text(spark, f"{path}/folds.current", name)
    history = (store.get_text(spark, f"{path}/folds.history") or "").split() + [name]
    store.put_text(spark, f"{path}/folds.history", "\n".join(history[-keep:]))
    for old in store.folders(spark, f"{path}/folds"):
        if old not in history[-keep:]:
            store.remove(spark, f"{path}/folds/{old}")
    return name
