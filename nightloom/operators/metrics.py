"""Metrics from confusion counts, pooled or for each record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def confusion(preds: DataFrame, classes: int, y: str = "y", p: str = "p") -> DataFrame:
    """(y, p, n, share of the row), all pairs of classes."""
    spark = preds.sparkSession
    grid = spark.range(classes * classes).select(F.expr(f"cast(id div {classes} as int)").alias(y), (F.col("id") % classes).cast("int").alias(p))
    n = preds.groupBy(y, p).agg(F.count("*").alias("n"))
    full = grid.join(n, [y, p], "left").select(y, p, F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(y))), F.lit(0.0)))


def classification(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """acc, macc, f1, mf1, ck, pr, rc of each group, from one pass of counts. Macro means are over classes that occur as
    label or prediction; weighted ones weigh by support."""
    cells = preds.groupBy(*by, y, p).agg(F.count("*").alias("n"))
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col(y).alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(F.lit(0).cast("long")).alias("hit")),
        F.struct(F.col(p).alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
    )))
    each = sides.groupBy(*by, "c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = each.withColumn("recall", ratio(F.col("hit"), F.col("support"))).withColumn("precision", ratio(F.col("hit"), F.col("called"))).withColumn("f", ratio(2 * F.col("hit"), F.col("support") + F.col("called")))
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    out = each.groupBy(*by).agg(
        F.sum("support").alias("n"), ratio(F.sum("hit"), F.sum("support")).alias("acc"), F.avg("recall").alias("macc"), weighted("f").alias("f1"), F.avg("f").alias("mf1"),
        weighted("precision").alias("pr"), weighted("recall").alias("rc"), ratio(F.sum(F.col("support") * F.col("called")), F.sum("support") * F.sum("support")).alias("_pe"),
    )
    return out.withColumn("ck", F.coalesce(F.try_divide(F.col("acc") - F.col("_pe"), 1 - F.col("_pe")), F.lit(0.0))).drop("_pe")


METRICS = ("acc", "macc", "f1", "mf1", "ck", "pr", "rc")


def per_record_mean(preds: DataFrame, record: str = "subject_id", y: str = "y", p: str = "p") -> DataFrame:
    """Each metric by record, then its plain mean over records."""
    return classification(preds, [record], y, p).agg(F.count("*").alias("records"), *[F.avg(m).alias(m) for m in METRICS])


def regression(preds: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """mse, mae and r2 = 1 - SS_res / SS_tot, in one pass."""
    e, v = F.col(y) - F.col(p), F.col(y)
    s = preds.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(v).alias("_var"))
    return s.withColumn("r2", 1 - F.try_divide(F.col("mse"), F.col("_var"))).drop("_var")


def cross_entropy(probabilities: Column, y: Column) -> Column:
    """-log of the probability of the label."""
    return -F.log(F.element_at(probabilities, y + 1))


def huber(y: Column, p: Column, delta: float = 5.0, scale: float = 112.5) -> Column:
    e = F.abs(y - p)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)) / scale


def rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two("n")).alias("both"), F.sum("n").alias("total"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("rows"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("cols"))
    s = both.crossJoin(rows).crossJoin(cols)  # one row each
    expected = F.try_divide(F.col("rows") * F.col("cols"), two("total"))
    return s.select(F.try_divide(F.col("both") - expected, (F.col("rows") + F.col("cols")) / 2 - expected).alias("ari"))


def channel_accuracy(preds: DataFrame, channels: Sequence[str], y: str = "y") -> DataFrame:
    """Share of right labels of each channel's own prediction column, in one pass."""
    cols = [F.avg((F.col(c) == F.col(y)).cast("double")) for c in channels]
    return preds.agg(*[c.alias(n) for c, n in zip(cols, channels, strict=True)])


def coverage_penalty(preds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean x 15 and sample variance of each coverage column."""
    return preds.agg(*[(F.avg(c) * 15).alias(f"{c}_mean15") for c in columns], *[F.var_samp(c).alias(f"{c}_var") for c in columns])
