"""Labelled texts to fit on, bounded or all of them, and small calibrated models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: int | None, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _label, _rank, _build, _text): whole texts of at most ``rows_per_class`` labelled ids of each class (None: of all),
    the first by a hash of the id, as a table in the shared folder. Half of them, by another hash, are to build a model (_build), the
    others to calibrate it.

    Ids are chosen from the labels alone, so at most 2 x rows_per_class ids are broadcast to fetch their texts, which stay on
    the executors; all labelled ids meet their texts in a plain join. Defined results: labels that are null or neither 0 nor 1, null ids and labels without a document teach
    nothing; of several labels of one id the largest counts, of several documents of one id the least text, so that
    repeated rows add nothing to the bound; null texts are empty; ``learns`` (on ``_id``) says which ids may teach; empty
    tables give an empty sample; other columns are never read.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    own = own.groupBy("_id").agg(F.max("_label").alias("_label"))
    if learns is not None:
        own = own.where(learns)
    key = F.col("_id").cast("string")
    own = own.select("_id", "_label", F.xxhash64(key).alias("_rank"), (F.pmod(F.xxhash64(key, F.lit("half")), F.lit(2)) == 0).alias("_build"))
    small = common.keyed(docs, id_col, text_col)
    if rows_per_class is None:
        small = small.toDF("_id", "_text")
        met = (small if learns is None else small.where(learns)).join(own, "_id")
        return common.written(met.groupBy("_id", "_label", "_rank", "_build").agg(F.coalesce(F.min("_text"), F.lit("")).alias("_text")), "sample")
    picked = None
    for label in (0, 1):
        some = own.where(F.col("_label") == label).orderBy("_rank", "_id").limit(rows_per_class)
        picked = some if picked is None else picked.unionAll(some)
    met = small.toDF("_doc", "_text").join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    return common.written(met.groupBy("_id", "_label", "_rank", "_build").agg(F.coalesce(F.min("_text"), F.lit("")).alias("_text")), "sample")


#: Words that a task counts before it hands them on.
COUNTED = 300_000


def counted_words(sample: DataFrame, words: Callable[[bytes], set[str]]) -> DataFrame:
    """(word, n0, n1): in how many of the sample's texts of each label a word is, as ``words`` gives them for a text. Null and
    empty texts have the words of the empty text; repeated rows count each; an empty sample gives no rows. Tasks add up
    what they meet, in tables of a bounded size."""

    def told(seen: tuple[Counter[str], Counter[str]]) -> Iterator[pa.RecordBatch]:
        for y, counts in enumerate(seen):
            own = list(counts)
            for i in range(0, len(own), 20_000):
                some = own[i : i + 20_000]
                n, none = pa.array([counts[w] for w in some], pa.int64()), pa.array([0] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *((none, n) if y else (n, none))], names=["word", "n0", "n1"])
            counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for batch in batches:
            for y, data in zip(batch.column(0).to_pylist(), common.texts(batch, "_text"), strict=True):
                seen[y].update(words(data))
                if len(seen[0]) + len(seen[1]) > COUNTED:
                    yield from told(seen)
        yield from told(seen)

    common.bounded_batches(sample.sparkSession)
    return sample.select("_label", "_text").mapInArrow(run, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def features_of(sample: DataFrame, features: Callable[[bytes], tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the sample's texts in the order of their ranks; only these numbers reach the driver. Null
    texts have the features of the empty one, equal texts equal features; an empty sample gives empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[float(v) for v in features(x)] for x in common.texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["_rank", "_label", "x"])

    common.bounded_batches(sample.sparkSession)
    rows = sorted(tuple(r) for r in sample.select("_rank", "_label", "_text").mapInArrow(run, "_rank long, _label int, x array<double>").collect())
    return np.array([r[2] for r in rows], dtype=float), np.array([r[1] for r in rows], dtype=float)


def feature_table(sample: DataFrame, features: Callable[[list[bytes]], Iterable[tuple[float, ...]]]) -> DataFrame:
    """(_label, x) of the sample's texts, as a table in the shared folder, for logistic_of(). ``features`` gets the texts of a
    batch; otherwise defined as features_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[float(v) for v in own] for own in features(common.texts(batch, "_text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["_label", "x"])

    common.bounded_batches(sample.sparkSession)
    return common.written(sample.select("_label", "_text").mapInArrow(run, "_label int, x array<double>"), "features")


def summed(table: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the batches of a feature_table() of ``part`` (features, labels). A task's sum is one row for the driver. An
    empty table gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                got = part(x, batch.column(0).to_numpy(zero_copy_only=False).astype(float))
                own = got if own is None else own + got
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([own.tolist()], pa.list_(pa.float64()))], names=["task", "s"])

    rows = sorted((r.task, r.s) for r in table.select("_label", "x").mapInArrow(run, "task int, s array<double>").collect())
    return np.sum([s for _, s in rows], axis=0)


def logistic_of(table: DataFrame, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """logistic() over a feature_table() of any length: each step adds up gradients and curvatures on the executors. None where
    the table has not both labels."""
    n, ones, *sums = summed(table, lambda x, y: np.array([len(x), y.sum(), *x.sum(0)])) if not table.isEmpty() else (0, 0)
    if not 0 < ones < n:
        return None
    mean = np.array(sums) / n
    scale = np.sqrt(summed(table, lambda x, y: ((x - mean) ** 2).sum(0)) / n) + 1e-9
    k = len(mean) + 1
    c, ridge = np.zeros(k), l2 * n * np.eye(k)
    ridge[-1, -1] = 1e-6
    for _ in range(steps):

        def part(x: np.ndarray, y: np.ndarray, c: np.ndarray = c) -> np.ndarray:
            a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
            return np.concatenate([a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])

        s = summed(table, part)
        step = np.linalg.solve(s[k:].reshape(k, k) + ridge + 1e-9 * np.eye(k), s[:k] + ridge @ c)
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    return c, mean, scale


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method for a small dense logistic model: (coefficients with the constant last, means, scales)."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, c = np.ones(len(x)) if weight is None else weight, np.zeros(a.shape[1])
    ridge = l2 * max(len(x), 1) * np.eye(len(c))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge @ c
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(c)), grad)
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    return c, mean, scale


def probability(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities of the rows; a row's does not depend on the others, to the last bit."""
    c, mean, scale = model
    z = np.ascontiguousarray((x - mean) / scale * c[:-1]).sum(axis=1) + c[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
