"""Votes of overlapping sequences, and choices of the best class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Of an array; stable, as the largest score is taken off."""
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def vote(preds: DataFrame, classes: int, record: str = "subject_id", scores: str = "logits") -> DataFrame:
    """(record, epoch_idx, coverage, votes): sums of softmax over the sequences that cover an epoch.

    Rows are (record, rel_idx, off, scores). The softmax is spelled out in columns, which compile, and the sums are plain
    ones, which Spark combines map-side; no array is built for each row."""
    z = [F.get(scores, F.lit(c)) for c in range(classes)]
    p = preds.select(record, (F.col("rel_idx") + F.col("off")).alias("epoch_idx"), *[z[c].alias(f"z{c}") for c in range(classes)])
    top = F.greatest(*[f"z{c}" for c in range(classes)]) if classes > 1 else F.col("z0")
    p = p.select(record, "epoch_idx", *[F.exp(F.col(f"z{c}") - top).alias(f"e{c}") for c in range(classes)])
    total = sum((F.col(f"e{c}") for c in range(1, classes)), F.col("e0"))
    sums = p.groupBy(record, "epoch_idx").agg(F.count("*").alias("coverage"), *[F.sum(F.col(f"e{c}") / total).alias(f"v{c}") for c in range(classes)])
    return sums.select(record, "epoch_idx", "coverage", F.array(*[f"v{c}" for c in range(classes)]).alias("votes"))


def normalised(votes: Column, coverage: Column) -> Column:
    return F.transform(votes, lambda v: v / coverage)


def argmax(scores: Column) -> Column:
    """Index of the largest element; of equal ones, the lowest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def merge_sleep(scores: Column) -> Column:
    """Five classes to three: wake, the largest of N1 to N3, REM."""
    return F.array(F.get(scores, F.lit(0)), F.greatest(F.get(scores, F.lit(1)), F.get(scores, F.lit(2)), F.get(scores, F.lit(3))), F.get(scores, F.lit(4)))


def night_choice(codes: DataFrame, key: Sequence[str], code: str = "code") -> DataFrame:
    """Most often chosen code for each key; of equally frequent ones, the least."""
    n = codes.groupBy(*key, code).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(code)).alias("rank")))
    return n.groupBy(*key).agg((-best["rank"]).alias(code), best["n"].alias("n"))
