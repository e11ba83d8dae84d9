"""Plain algebra of model layers on rows: random selection, channel dropout, linear heads, a metric loss, and gradients along
paths. Randomness is a digest of each row's key, so that a draw is the same everywhere and on every retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nightloom.operators import prototypes

EPSILON, MARGIN = 0.1, 0.05  # fixed values: the pair miner's tolerance and the triplets' margin


def uniform(*key: Column) -> Column:
    """A number between 0 and 1, both excluded, from a digest of the key."""
    text = F.concat_ws("/", *[k.cast("string") for k in key]).cast("binary")
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def gumbel_select(rows: DataFrame, by: Sequence[str], score: str, id_col: str, draws: int = 1, seed: int = 0) -> DataFrame:
    """(by, draw, id): for each draw, the element of the group whose score plus Gumbel noise is largest; of equals, the lowest id.
    The hard form of the Gumbel-softmax trick, which no temperature changes."""
    own = rows.select(*by, id_col, score, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    noisy = F.col(score) + gumbel(uniform(*[F.col(c) for c in by], F.col(id_col), F.col("draw"), F.lit(seed)))
    best = F.max(F.struct(noisy.alias("s"), (-F.col(id_col)).alias("i")))
    return own.groupBy(*by, "draw").agg(best.alias("_b")).select(*by, "draw", (-F.col("_b.i")).alias(id_col))


def sampled_channels(rows: DataFrame, accuracies: Sequence[float], share: float = 1.0, row: str = "id", channel: str = "channel", seed: int = 0) -> DataFrame:
    """(row, channel, source): which channel each channel of a row is replaced by. Of a share of the rows, every place draws with
    replacement, the likelier the worse a channel's accuracy; the other rows keep theirs."""
    worse = [1.0 - a for a in accuracies]
    edges, at = [], 0.0
    for w in worse[:-1]:
        at += w / sum(worse)
        edges.append(at)
    u = uniform(F.col(row), F.col(channel), F.lit(seed))
    drawn = sum([(u >= e).cast("int") for e in edges], F.lit(0))
    moved = uniform(F.col(row), F.lit("row"), F.lit(seed)) < share
    return rows.select(row, channel, F.when(moved, drawn).otherwise(F.col(channel).cast("int")).alias("source"))


def channels_dropped(rows: DataFrame, accuracies: Sequence[float], value: str, share: float = 1.0, row: str = "id", channel: str = "channel", seed: int = 0) -> DataFrame:
    """(row, channel, value) with the values of the sampled channels; one join by row and channel."""
    own = sampled_channels(rows, accuracies, share, row, channel, seed)
    return own.join(rows.select(row, F.col(channel).cast("int").alias("source"), value), [row, "source"]).select(row, channel, value)


def linear_head(features: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Scores of each class from an array of features: weights are a model's parameters, one row a class."""
    dot = lambda w: F.aggregate(F.zip_with(features, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[dot([float(v) for v in w]) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)])


def sampled_frame(spectrum: Column, mask: Column) -> Column:
    """The frame of (frames, bins) that a one-hot mask names."""
    return F.get(spectrum, (F.array_position(mask, F.array_max(mask)) - 1).cast("int"))


def scaled_units(x: Column, factor: float = 1e6) -> Column:
    """Samples in another unit, such as volts in microvolts."""
    return F.transform(x, lambda v: v * F.lit(factor))


def triplet_loss(rows: DataFrame, batch: str = "batch", id_col: str = "id", label: str = "label", vector: str = "vector", epsilon: float = EPSILON, margin: float = MARGIN, most: int = 4096) -> DataFrame:
    """(batch, triplets, loss, norm): the mean of the positive triplet losses under cosine similarity, over the pairs that a
    multi-similarity miner keeps, and the mean length of the vectors. Pairs are within a batch; a batch of more than ``most``
    rows is an error.

    A negative pair counts if it is almost as similar as its anchor's least similar positive one, a positive pair if it is
    hardly more similar than the most similar negative one."""
    size = F.count("*").over(W.partitionBy(batch))
    fits = F.when(F.col("_size") <= most, F.lit(True)).otherwise(F.raise_error(F.lit("batch too large for all of its pairs")).cast("boolean"))
    rows = rows.withColumn("_size", size).where(fits).drop("_size")
    a = rows.select(batch, F.col(id_col).alias("a"), F.col(label).alias("_la"), F.col(vector).alias("_va"))
    b = rows.select(batch, F.col(id_col).alias("b"), F.col(label).alias("_lb"), F.col(vector).alias("_vb"))
    pairs = a.join(b, batch).where("a <> b").select(batch, "a", (F.col("_la") == F.col("_lb")).alias("same"), prototypes.cosine(F.col("_va"), F.col("_vb")).alias("s"))
    each = pairs.groupBy(batch, "a").agg(F.collect_list(F.when(F.col("same"), F.col("s"))).alias("p"), F.collect_list(F.when(~F.col("same"), F.col("s"))).alias("n"))
    low, high = F.array_min("p"), F.array_max("n")
    each = each.withColumn("kp", F.filter("p", lambda x: x - epsilon < high)).withColumn("kn", F.filter("n", lambda x: x + epsilon > low))
    parts = F.flatten(F.transform("kp", lambda p: F.transform(F.col("kn"), lambda n: n - p + margin)))
    each = each.withColumn("t", F.filter(parts, lambda x: x > 0))
    total = F.sum(F.aggregate("t", F.lit(0.0), lambda s, x: s + x))
    loss = each.groupBy(batch).agg(F.sum(F.size("t")).alias("triplets"), F.coalesce(F.try_divide(total, F.sum(F.size("t"))), F.lit(0.0)).alias("loss"))
    norm = rows.groupBy(batch).agg(F.avg(F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))
    return loss.join(norm, batch)


def expected_gradients(protos: DataFrame, baselines: DataFrame) -> DataFrame:
    """(proto, steps, integral): the gradient of the negative distance to a prototype, integrated by the trapezoid rule along the
    paths from each baseline, nearest first, to the nearest of all. protos (proto, proto_vec), baselines (base, base_vec), in the
    space of an encoder's output, where the gradient of a distance is its direction."""
    ranked = prototypes.ranked_baselines(protos, baselines).join(baselines, "base").join(F.broadcast(protos), "proto")
    w = W.partitionBy("proto")
    near = ranked.where("rank = 1").select(F.col("proto").alias("_p"), F.col("base_vec").alias("x"))
    # The first baseline is the end of all paths; the second only opens the grid.
    steps = ranked.where("rank > 1").join(F.broadcast(near), F.col("proto") == F.col("_p")).withColumn("i", F.col("rank") - 2).withColumn("points", F.count("*").over(w))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    minus = lambda p, q: F.zip_with(p, q, lambda x, y: x.cast("double") - y.cast("double"))

    def slope(t: Column) -> Column:
        at = F.zip_with("x", "base_vec", lambda x, b: x.cast("double") * t - (F.lit(1.0) - t) * b.cast("double"))
        away = minus(at, F.col("proto_vec"))
        return F.coalesce(F.try_divide(-dot(away, minus(F.col("x"), F.col("base_vec"))), F.sqrt(dot(away, away))), F.lit(0.0))

    grid = lambda i: i.cast("double") / F.greatest(F.col("points") - 1, F.lit(1))
    part = (grid(F.col("i")) - grid(F.col("i") - 1)) * (slope(grid(F.col("i") - 1)) + slope(grid(F.col("i")))) / 2
    return steps.where("i > 0").groupBy("proto").agg(F.count("*").alias("steps"), F.sum(part).alias("integral"))
