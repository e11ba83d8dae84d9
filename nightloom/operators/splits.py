"""Fold construction and use. Folds are metadata: one row a record and fold."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def random_split(n: int, seed: int = 42, train: float = 0.7, test: float = 0.15) -> list[str]:
    """The split of each of n records by a seeded choice without replacement: train, then test from the rest, then valid.

    Records' numbers are metadata of a few thousand rows, so this runs on the driver, bit for bit reproducible."""
    rng = np.random.RandomState(seed)
    ids = np.arange(n)
    chosen = rng.choice(ids, int(n * train), replace=False)
    rest = np.setdiff1d(ids, chosen)
    tests = rng.choice(rest, int(n * test), replace=False)
    out = np.full(n, "valid", dtype=object)
    out[chosen], out[tests] = "train", "test"
    return out.tolist()


def random_folds(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return spark.createDataFrame([(i, 0, s) for i, s in enumerate(random_split(n, seed))], "subject_id int, fold int, split string")


def rank_folds(subjects: DataFrame, order: Column, train: float = 0.7, test: float = 0.15, record: str = "subject_id") -> DataFrame:
    """train / test / valid by rank in a fixed order; one row a record, so one task ranks them. Shares are taken as decimals:
    0.7 of 90 records are 63, where binary fractions make 62."""
    ranked = subjects.select(record, order.alias("_o")).distinct()
    ranked = ranked.withColumn("rank", F.row_number().over(W.orderBy("_o", record)) - 1).crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n"))))
    a, b = (F.floor(F.col("n") * F.lit(Decimal(str(share)))) for share in (train, test))
    return ranked.select(record, F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "test").otherwise("valid").alias("split"))


def leave_one_out(subjects: DataFrame, record: str = "subject_id") -> DataFrame:
    """(record, valid_fold, test_fold): fold i validates on person i and tests on the next one, so each person validates in one
    fold, tests in one, and trains in all others. As many rows as persons; ``one_fold`` expands a fold where it is read."""
    ranked = subjects.select(record).distinct().withColumn("valid_fold", F.row_number().over(W.orderBy(record)) - 1)
    n = ranked.agg(F.count("*").alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).select(record, "valid_fold", F.pmod(F.col("valid_fold") - 1, F.greatest(F.col("_n"), F.lit(1))).cast("int").alias("test_fold"))


def one_fold(folds: DataFrame, fold: int, record: str = "subject_id") -> DataFrame:
    """(record, fold, split) of one fold of leave_one_out()."""
    split = F.when(F.col("valid_fold") == fold, "valid").when(F.col("test_fold") == fold, "test").otherwise("train")
    return folds.select(record, F.lit(fold).alias("fold"), split.alias("split"))


def stratified(subjects: DataFrame, group: str, k: int, order: Column, record: str = "subject_id") -> DataFrame:
    """Fold of each record by its rank within its group, modulo k."""
    return subjects.withColumn("fold", (F.row_number().over(W.partitionBy(group).orderBy(order, record)) - 1) % k).select(record, group, "fold")


def next_fold_validates(folds: DataFrame, k: int, record: str = "subject_id") -> DataFrame:
    """For each of k folds: records of that fold test, those of the next validate, the rest trains."""
    numbers = folds.sparkSession.range(k).select(F.col("id").cast("int").alias("run"))
    split = F.when(F.col("fold") == F.col("run"), "test").when(F.col("fold") == (F.col("run") + 1) % k, "valid").otherwise("train")
    return folds.crossJoin(F.broadcast(numbers)).select(record, F.col("run").alias("fold"), split.alias("split"))


def strata_split(subjects: DataFrame, stratum: str, order: Column, train: float = 0.7, test: float = 0.15, record: str = "subject_id") -> DataFrame:
    """train / test / valid by rank within each stratum; records of a null stratum get none."""
    w = W.partitionBy(stratum)
    ranked = subjects.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order, record)) - 1)
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * test)
    split = F.when(F.col(stratum).isNull(), "none").when(F.col("_r") < a, "train").when(F.col("_r") < a + b, "test").otherwise("valid")
    return ranked.select(record, stratum, split.alias("split"))


def greedy_by_duration(durations: Sequence[tuple[int, int]], k: int = 4, seed: int = 42, test: float = 0.15, valid: float = 0.15) -> list[tuple[int, int, str]]:
    """(record, fold, split) for k folds by duration. In each fold, records are looked at in a random order and test if they
    still fit into its share of all windows, then the rest likewise validates; a record tests, and validates, at most once
    over all folds. Stateful over a table of one row a record, so it runs on the driver."""
    rng, size = np.random.RandomState(seed), dict(durations)
    total, spent = sum(size.values()), {"test": set(), "valid": set()}
    base = rng.permutation(np.array(list(size))).tolist()
    out = []

    def fill(pool: list[int], kind: str, share: float) -> list[int]:
        """Moves records from the pool to a split, and returns what is left of it."""
        rng.shuffle(pool)
        room, rest = share * total * (1 + 1e-12), []
        for r in pool:
            if r not in spent[kind] and size[r] <= room:
                room -= size[r]
                spent[kind].add(r)
                out.append((r, fold, kind))
            else:
                rest.append(r)
        return rest

    for fold in range(k):
        left = fill(fill(list(base), "test", test), "valid", valid)
        out += [(r, fold, "train") for r in left]
    return out


def stratified_with_validation(subjects: DataFrame, group: str, k: int, order: Column, valid: float = 0.1765, record: str = "subject_id") -> DataFrame:
    """k folds that test on one fold each; of the other records of each group, the first share validates, the rest trains."""
    own = stratified(subjects, group, k, order, record).withColumnRenamed("fold", "_own").join(subjects.select(record, order.alias("_o")).distinct(), record)
    runs = own.crossJoin(F.broadcast(own.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))))
    w = W.partitionBy("fold", group, F.col("_own") == F.col("fold"))
    rank = F.row_number().over(w.orderBy("_o", record))
    split = F.when(F.col("_own") == F.col("fold"), "test").when(rank <= F.ceil(F.count("*").over(w) * valid), "valid").otherwise("train")
    return runs.select(record, group, "fold", split.alias("split"))


def from_ids(subjects: DataFrame, ids: DataFrame, record: str = "subject_id") -> DataFrame:
    """Splits from given (record, fold, split) rows of test and valid; all other records train in each fold."""
    folds = ids.select("fold").distinct()
    every = subjects.select(record).distinct().crossJoin(F.broadcast(folds))
    return every.join(ids, [record, "fold"], "left").select(record, "fold", F.coalesce("split", F.lit("train")).alias("split"))


def training_rest(subjects: DataFrame, held: DataFrame, record: str = "subject_id") -> DataFrame:
    """Records that no other split has."""
    return subjects.select(record).distinct().join(held.select(record), record, "left_anti")


def availability(a: DataFrame, b: DataFrame, record: str = "subject_id") -> DataFrame:
    """both / first / second: in which of two tables each record is."""
    x, y = a.select(record).distinct().withColumn("_a", F.lit(1)), b.select(record).distinct().withColumn("_b", F.lit(1))
    kind = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "first").otherwise("second")
    return x.join(y, record, "full").select(record, kind.alias("availability"))


def shares(folds: DataFrame, subjects: DataFrame, record: str = "subject_id") -> DataFrame:
    """Windows of each split and their share of all."""
    n = folds.join(subjects.select(record, "num_windows"), record).groupBy("split").agg(F.sum("num_windows").alias("windows"))
    return n.withColumn("share", F.try_divide(F.col("windows"), F.sum("windows").over(W.partitionBy())))


def with_split(rows: DataFrame, folds: DataFrame, fold: int = 0, record: str = "subject_id") -> DataFrame:
    """Rows with the split of their record in one fold; unknown split names fail, records without one go."""
    own = folds.where(F.col("fold") == fold).select(record, "split") if "fold" in folds.columns else folds.select(record, "split")
    known = F.col("split").isin("train", "valid", "test", "none")
    return rows.join(own, record).where(F.when(known, F.col("split") != "none").otherwise(F.raise_error(F.lit("unknown split")).cast("boolean")))
