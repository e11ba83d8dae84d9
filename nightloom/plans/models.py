"""Model registry, batches, baselines on pyspark.ml, and small model algebra."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nightloom.operators import metrics, sequences, voting

#: (name, sequence_length, in_channels, loss, checkpoint): published networks that a user may bring, by their shape, and the
#: baselines that this engine fits itself.
REGISTRY = [
    ("chambon2018", 21, 1, "cel", "chambon2018-l21-c1"),
    ("chambon2018", 21, 3, "cel", "chambon2018-l21-c3"),
    ("middle-logistic", 21, 1, "cel", "middle-logistic-l21"),
    ("night-linear", 0, 1, "reg", "night-linear"),
]
REGISTRY_SQL = "WITH registry AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in REGISTRY) + ") t(name, sequence_length, in_channels, loss, checkpoint))"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "name string, sequence_length int, in_channels int, loss string, checkpoint string")


def lookup(models: DataFrame, name: str, sequence_length: int, in_channels: int) -> DataFrame:
    return models.where((F.col("name") == name) & (F.col("sequence_length") == sequence_length) & (F.col("in_channels") == in_channels))


def looked_up(rows: DataFrame, models: DataFrame, name: Column, sequence_length: Column, in_channels: Column) -> DataFrame:
    """Rows with the registered model of their name, length and channels; null where there is none. The registry is a constant
    of a few rows."""
    own = rows.withColumns({"_n": name, "_l": sequence_length, "_c": in_channels})
    same = (F.col("_n") == F.col("name")) & (F.col("_l") == F.col("sequence_length")) & (F.col("_c") == F.col("in_channels"))
    return own.join(F.broadcast(models), same, "left").drop("_n", "_l", "_c")


def best_checkpoint(log: DataFrame, epoch: str, metric: str, largest: bool = True) -> DataFrame:
    """best, the metric there, and the last epoch; of equally good epochs the first."""
    value = F.round(metric, 9) if largest else -F.round(metric, 9)
    best = F.max(F.struct(value.alias("v"), (-F.col(epoch)).alias("e")))
    return log.agg((-best["e"]).alias("best"), (F.max(metric) if largest else F.min(metric)).alias(metric), F.max(epoch).alias("last"))


def batches(rows: DataFrame, shard: Column, order: Sequence[str], size: int) -> DataFrame:
    """Sequential batches within shards: batch_row and batch. Shards keep the numbering from being one task's work."""
    return rows.withColumn("_shard", shard).withColumn("batch_row", F.row_number().over(W.partitionBy("_shard").orderBy(*order)) - 1).withColumn("batch", F.expr(f"batch_row div {size}")).drop("_shard")


def stage_names(labels: DataFrame) -> DataFrame:
    """Names of stages; three present classes are wake, NREM and REM."""
    k = labels.agg(F.countDistinct("stage").alias("_k"))
    five = F.element_at(F.array(*map(F.lit, ("W", "N1", "N2", "N3", "REM"))), F.col("stage") + 1)
    three = F.when(F.col("stage") == 0, "W").when(F.col("stage") == 1, "NREM").otherwise("REM")
    return labels.crossJoin(F.broadcast(k)).withColumn("name", F.when(F.col("_k") == 3, three).otherwise(five)).drop("_k")


def parsed_ids(customers: DataFrame) -> DataFrame:
    """The number at the end of a name, the cohort it starts with, and an age that is null where it is not known."""
    return customers.select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).cast("int").alias("number"), F.lower(F.substring("c_name", 1, 2)).alias("cohort"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("age"))


def stretched(x: Column, times: int) -> Column:
    """Each element of an array so many times in a row."""
    return F.flatten(F.transform(x, lambda v: F.array_repeat(v, times)))


def positional_encoding(spark: SparkSession, length: int, width: int) -> DataFrame:
    """(pos, dim, value): sine in even, cosine in odd dimensions."""
    grid = spark.range(length * width).select(F.expr(f"cast(id div {width} as int)").alias("pos"), (F.col("id") % width).cast("int").alias("dim"))
    angle = F.col("pos") * F.exp(-F.log(F.lit(10000.0)) * (F.col("dim") - F.col("dim") % 2) / width)
    return grid.select("pos", "dim", F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))


# --- models on sequences ---

Model = Callable[[DataFrame], DataFrame]


def evaluate(model: Model, data: DataFrame, labels: DataFrame, classes: int = 5) -> DataFrame:
    """Metrics of a model that turns rows into (subject_id, rel_idx, off, logits): votes, best classes, means over records."""
    voted = voting.vote(model(data), classes).select("subject_id", "epoch_idx", voting.argmax(F.col("votes")).alias("p"))
    own = labels.select("subject_id", F.col("epoch_idx").cast("int").alias("epoch_idx"), F.col("stage").alias("y"))
    return metrics.per_record_mean(voted.join(own, ["subject_id", "epoch_idx"]))


def middle_features(epochs: DataFrame, length: int = 5) -> DataFrame:
    """(subject_id, rel_idx, features, stage in the middle) of whole sequences."""
    own = sequences.gathered(epochs, "value", length)
    labels = epochs.select("subject_id", (F.col("epoch_idx") - (length - 1) // 2).alias("rel_idx"), F.col("stage").cast("double").alias("label"))
    return own.join(labels, ["subject_id", "rel_idx"])


def middle_label_accuracy(epochs: DataFrame, length: int = 5) -> DataFrame:
    """A logistic baseline of the sequence-to-epoch kind; accuracy on every fifth subject, which it has not seen."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = middle_features(epochs, length).select("subject_id", array_to_vector(F.col("value").cast("array<double>")).alias("features"), "label")
    model = LogisticRegression(maxIter=5).fit(rows.where("subject_id % 5 <> 0"))
    return model.transform(rows.where("subject_id % 5 = 0")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("acc"))


def kmeans_rand(vectors: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """Adjusted Rand index of k-means clusters and labels, for each k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    out = None
    for k in ks:
        found = KMeans(k=k, seed=seed).fit(rows).transform(rows)
        one = metrics.rand_index(found, "prediction", "label").select(F.lit(k).alias("k"), F.round("ari", 4).alias("ari"))
        out = one if out is None else out.unionAll(one)
    return out


def pca(vectors: DataFrame, id_col: str, k: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_col, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="projected").fit(rows).transform(rows).select(id_col, vector_to_array("projected").alias("projected"))
