"""A fixed mapping of the driver's tables to recordings, so that every operator can be held against SQL.

subject = user of an event, epoch = the event's place in the user's order of (ts, event_id), stage = alphabetical code of the
event type (five classes), sample = value, group = user modulo 3; epoch vector = embedding, class = its label, codebook =
embeddings with vec_id < 16; prediction = the next stage where the value in hundredths is divisible by 5, else the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Event types in alphabetical order.
EVENT_STAGES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
CLASSES = 5
CODES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_code() -> Column:
    return F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, epoch_idx, stage, value, ts, event_id, grp."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), stage_code().alias("stage"), "value", "ts", "event_id", (F.col("user_id") % 3).alias("grp"))
    # Renamed first, so that what follows by subject needs no further shuffle.
    at = F.row_number().over(W.partitionBy("subject_id").orderBy("ts", "event_id")) - 1
    return own.select("subject_id", at.alias("epoch_idx"), "stage", "value", "ts", "event_id", "grp")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epochs with y, the stage, and p, the prediction."""
    off = F.round(F.col("value") * 100).cast("long") % 5 == 0
    return epochs(spark, sf_dir).withColumn("y", F.col("stage")).withColumn("p", F.when(off, (F.col("stage") + 1) % 5).otherwise(F.col("stage")))


def logits() -> Column:
    """Five scores of an epoch: 1 for its stage, and a hundredth of (value + class) mod 7 for each class."""
    part = lambda c: (F.col("stage") == c).cast("double") + (F.floor("value") + c) % 7 / 100.0
    return F.array(*[part(c) for c in range(CLASSES)])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("vec_id") < CODES).select(F.col("vec_id").cast("int").alias("code"), F.col("embedding").alias("code_vec"))


#: The same mapping as SQL common table expressions.
EP = """ep AS (SELECT user_id AS subject_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS epoch_idx,
 CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS stage, value, ts, event_id, user_id % 3 AS grp FROM events)"""
PR = EP + """, pr AS (SELECT *, stage AS y, CASE WHEN CAST(round(value * 100) AS BIGINT) % 5 = 0 THEN (stage + 1) % 5 ELSE stage END AS p FROM ep)"""
SUBJ = EP + """, subj AS (SELECT subject_id, count(*) AS num_windows FROM ep GROUP BY 1)"""
