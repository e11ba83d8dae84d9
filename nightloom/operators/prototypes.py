"""Prototype assignment, shares, transitions and spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nightloom.operators import scaling


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def assign(vectors: DataFrame, codebook: DataFrame, id_col: str, vec: str = "embedding", code: str = "code", code_vec: str = "code_vec", max_codes: int = 4096) -> DataFrame:
    """Nearest code of each vector, of equally near ones the lowest, and the squared distance.

    A codebook is a model parameter; one with more than max_codes rows is refused, so that its broadcast is bounded."""
    book = codebook.select(F.col(code).alias("_c"), F.col(code_vec).alias("_v")).limit(max_codes + 1)
    whole = book.agg(F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_book"))
    whole = whole.where(F.when(F.size("_book") <= max_codes, F.lit(True)).otherwise(F.raise_error(F.lit("codebook too large")).cast("boolean")))
    near = F.array_min(F.transform("_book", lambda b: F.struct(squared_distance(F.col(vec), b["_v"]).alias("d"), b["_c"].alias("c"))))
    return vectors.crossJoin(F.broadcast(whole)).select(id_col, near.alias("_n")).select(id_col, F.col("_n.c").alias(code), F.col("_n.d").alias("distance"))


def shares_within(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, n, share of the group), for pairs that occur."""
    n = rows.groupBy(group, member).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def specificity(rows: DataFrame, classes: Sequence[int], code: str = "code", stage: str = "stage") -> DataFrame:
    """P(stage | prototype), one column a stage, 0 where there is none."""
    cols = [F.count_if(F.col(stage) == c) for c in classes]
    wide = rows.groupBy(code).agg(F.count("*").alias("n"), *[c.alias(f"_{k}") for c, k in zip(cols, classes, strict=True)])
    return wide.select(code, "n", *[(F.col(f"_{k}") / F.col("n")).alias(f"stage_{k}") for k in classes])


def sensitivity(rows: DataFrame, codes: int, code: str = "code", stage: str = "stage") -> DataFrame:
    """P(prototype | stage); prototypes that no epoch has come once, with null stage and share."""
    own = shares_within(rows, stage, code).select(code, stage, "share")
    every = rows.sparkSession.range(codes).select(F.col("id").cast("int").alias(code))
    unseen = every.join(rows.select(code).distinct(), code, "left_anti").select(code, F.lit(None).cast("int").alias(stage), F.lit(None).cast("double").alias("share"))
    return own.unionByName(unseen)


def percentages(rows: DataFrame, code: str = "code") -> DataFrame:
    n = rows.groupBy(code).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy()))


def transitions(states: DataFrame, classes: int, record: str = "subject_id", state: str = "stage") -> DataFrame:
    """(src, dst, n, p): counts of consecutive states within records and their share of the source; all pairs."""
    w = W.partitionBy(record).orderBy("epoch_idx")
    steps = states.select(F.col(state).alias("src"), F.lead(state).over(w).alias("dst")).where("dst IS NOT NULL")
    n = steps.groupBy("src", "dst").agg(F.count("*").alias("n"))
    grid = states.sparkSession.range(classes * classes).select(F.expr(f"cast(id div {classes} as int)").alias("src"), (F.col("id") % classes).cast("int").alias("dst"))
    full = grid.join(n, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("p", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy("src"))), F.lit(0.0)))


def transition_graph(states: DataFrame, classes: int, least_share: float = 0.03, record: str = "subject_id", state: str = "stage") -> DataFrame:
    """Transitions by their share of all, between states that have more than the least share of epochs."""
    steps = transitions(states, classes, record, state).select("src", "dst", "n")
    steps = steps.withColumn("p", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())), F.lit(0.0)))
    long = percentages(states, state).where(F.col("percent") > 100 * least_share).select(state)
    return steps.join(long.select(F.col(state).alias("src")), "src", "left_semi").join(long.select(F.col(state).alias("dst")), "dst", "left_semi").where("n > 0").select("src", "dst", "n", "p")


def mean_spectrum(rows: DataFrame, by: Sequence[str], spectrum: str) -> DataFrame:
    """Mean and sample deviation of each bin, decibels made linear (10 to the x / 20)."""
    linear = rows.select(*by, F.transform(spectrum, lambda x: F.pow(F.lit(10.0), x.cast("double") / 20)).alias("_x"))
    return scaling.positional_scaling(linear, "_x", by).withColumnRenamed("pos", "bin")


# Frequency bands in hertz.
BANDS = (("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 12.0), ("beta", 12.0, 30.0), ("gamma", 30.0, 50.0))


def band_of(hertz: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in reversed(BANDS):
        out = F.when((hertz >= low) & (hertz < high), F.lit(name)).otherwise(out)
    return out


def band_power(rows: DataFrame, by: Sequence[str], spectrum: str, hertz_per_bin: float) -> DataFrame:
    own = rows.select(*by, F.posexplode(spectrum).alias("bin", "x"))
    own = own.withColumn("band", band_of(F.col("bin") * hertz_per_bin)).where("band IS NOT NULL")
    return own.groupBy(*by, "band").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("power"))


def ranked_baselines(prototypes: DataFrame, baselines: DataFrame, max_prototypes: int = 4096) -> DataFrame:
    """(proto, base, distance, rank): all baselines of each prototype by distance, then by id. Prototypes are a model
    parameter; more than max_prototypes are refused, so that their broadcast is bounded."""
    book = prototypes.limit(max_prototypes + 1).agg(F.collect_list(F.struct("proto", "proto_vec")).alias("_book"))
    book = book.where(F.when(F.size("_book") <= max_prototypes, F.lit(True)).otherwise(F.raise_error(F.lit("too many prototypes")).cast("boolean")))
    each = F.explode(F.transform("_book", lambda p: F.struct(p["proto"].alias("proto"), F.sqrt(squared_distance(p["proto_vec"], F.col("base_vec"))).alias("distance"))))
    pairs = baselines.crossJoin(F.broadcast(book)).select("base", each.alias("_p")).select("_p.proto", "base", "_p.distance")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("proto").orderBy("distance", "base")))


def trapezoid(steps: DataFrame, by: Sequence[str], order: str, t: str, g: str) -> DataFrame:
    """Integral of g over t along each path, by the trapezoid rule on adjacent steps."""
    w = W.partitionBy(*by).orderBy(order)
    part = (F.col(t) - F.lag(t).over(w)) * (F.col(g) + F.lag(g).over(w)) / 2
    return steps.withColumn("_part", part).groupBy(*by).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("integral"))


def balanced(rows: DataFrame, label: str, k: int, order: Column, id_col: str) -> DataFrame:
    """The first k rows of each label in a fixed order."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy(order, id_col))).where(F.col("rank") <= k)


def attention(rows: DataFrame, by: Sequence[str], score: str, value: str) -> DataFrame:
    """Weighted mean of values with softmax weights of the scores within each group, as sums that combine map-side."""
    top = rows.groupBy(*by).agg(F.max(score).alias("_top"))
    e = F.exp(F.col(score) - F.col("_top"))
    s = rows.join(top, [*by]).groupBy(*by).agg(F.sum(e).alias("weight"), F.sum(e * F.col(value)).alias("_ev"))
    return s.select(*by, "weight", (F.col("_ev") / F.col("weight")).alias("pooled"))


def top_n(rows: DataFrame, by: Sequence[str], score: str, n: int, id_col: str) -> DataFrame:
    """The n rows of the highest score in each group; of equal ones, the lowest id first."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), id_col))).where(F.col("rank") <= n)


def odd_windows(length: int, longest: int | None = None) -> list[tuple[int, int]]:
    """(start, width) of all odd-length windows within a frame count."""
    longest = longest or length // 2 + 1
    return [(s, w) for w in range(1, longest + 1, 2) for s in range(length - w + 1)]


def filterbank(n_filters: int, n_bins: int, rate: float, low: float, high: float, n_fft: int | None = None) -> list[tuple[int, int, float]]:
    """(bin, filter, weight) of triangular filters whose corners are evenly spaced in frequency; zero weights left out."""
    n_fft = n_fft or 2 * (n_bins - 1)
    corner = [low + (high - low) * i / (n_filters + 1) for i in range(n_filters + 2)]
    place = [int((n_fft + 1) * f // rate) for f in corner]
    out = []
    for f in range(n_filters):
        a, b, c = place[f : f + 3]
        out += [(i, f, (i - a) / (b - a)) for i in range(a, min(b, n_bins)) if b > a and i > a]
        out += [(i, f, (c - i) / (c - b)) for i in range(b, min(c, n_bins)) if c > b]
    return out


def project(rows: DataFrame, bank: DataFrame, id_col: str, spectrum: str) -> DataFrame:
    """(id, filter, energy): bins joined with the bank's few weights."""
    own = rows.select(id_col, F.posexplode(spectrum).alias("bin", "x"))
    return own.join(F.broadcast(bank), "bin").groupBy(id_col, "filter").agg(F.sum(F.col("x").cast("double") * F.col("weight")).alias("energy"))
