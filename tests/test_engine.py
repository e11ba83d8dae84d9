"""Parts of the engine that no query reaches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom import engine
from nightloom.functions import dsp
from nightloom.operators import prototypes, records, sequences
from nightloom.plans import models
from nightloom.sources import sinks


@pytest.fixture(scope="module")
def preds(spark):
    rows = [(d, s, i, (i + s) % 5, (i + s) % 5 if (i * s) % 3 else (i + 1) % 5) for d in ("a", "b") for s in range(4) for i in range(30)]
    return spark.createDataFrame(rows, "dataset string, subject_id int, epoch_idx int, y int, p int").cache()


def test_evaluate_means_over_records(spark, preds, tmp_path):
    got = {r.dataset: r for r in engine.evaluate(preds).collect()}
    rows = preds.collect()
    each = [np.mean([r.y == r.p for r in rows if r.dataset == "a" and r.subject_id == s]) for s in range(4)]
    assert got["a"].records == 4 and np.isclose(got["a"].acc, np.mean(each)) and np.isclose(got["a"].pooled_acc, np.mean([r.y == r.p for r in rows if r.dataset == "a"]))
    assert engine.evaluate(preds, ()).first().records == 4
    preds.write.parquet(str(tmp_path / "p"))
    engine.main(["test", str(tmp_path / "p"), "--results", str(tmp_path / "r")])
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 2


def test_losses_and_report(spark, preds):
    own = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.75, 0.25])], "y int, p array<double>")
    assert np.isclose(engine.mean_loss(own).first().loss, -np.mean(np.log([0.5, 0.25])))
    engine.register_loss("zero", lambda y, p: F.lit(0.0))
    assert engine.mean_loss(own, "zero").first().loss == 0
    report = engine.prototype_report(preds.where("dataset = 'a'").select("subject_id", "epoch_idx", F.col("p").alias("code"), F.col("y").alias("stage")), 6)
    assert set(report) == {"specificity", "sensitivity", "percentages", "transitions", "density"}
    assert report["sensitivity"].where("stage IS NULL").count() == 1
    sums = report["transitions"].groupBy("src").agg(F.sum("p").alias("s")).collect()
    assert all(np.isclose(r.s, 1) or r.s == 0 for r in sums)


def test_model_protocol(spark):
    """A model that reads the stage off the data is perfect after voting."""
    own = spark.createDataFrame([(s, i, (i * (s + 1)) % 5) for s in range(3) for i in range(12)], "subject_id int, epoch_idx int, stage int")

    def perfect(rows):
        index = sequences.sequences(rows, 4)
        return index.select("subject_id", "rel_idx", "off", F.array(*[F.when(F.col("stage") == c, 5.0).otherwise(0.0) for c in range(5)]).alias("logits"))

    assert models.evaluate(perfect, own, own).first().acc == 1.0


def test_bundles_and_guards(spark, tmp_path):
    epochs = spark.createDataFrame([("a", s, 0, "EEG", [float(s)]) for s in range(4)], "dataset string, subject_id int, epoch_idx int, channel string, samples array<float>")
    folds = spark.createDataFrame([("a", s, 0, ("train", "valid", "test")[s % 3]) for s in range(4)], "dataset string, subject_id int, fold int, split string")
    sinks.write_bundle(epochs, folds, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).where("split = 'train'").count() == 2
    with pytest.raises(Exception, match="NaN"):
        sinks.write_bundle(epochs.withColumn("samples", F.array(F.lit(float("nan")).cast("float"))), folds, str(tmp_path / "c"))
    with pytest.raises(Exception, match="out of range"):
        records.validated(spark.createDataFrame([(7,)], "stage int"), 0, 4).collect()


def test_limits_are_refused(spark):
    book = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "code int, code_vec array<double>")
    vectors = spark.createDataFrame([(0, [1.2]), (1, [3.5])], "id int, embedding array<double>")
    assert {r.id: r.code for r in prototypes.assign(vectors, book, "id").collect()} == {0: 1, 1: 3}
    with pytest.raises(Exception, match="codebook too large"):
        prototypes.assign(vectors, book, "id", max_codes=4).collect()


def test_night_filter_is_seamless(spark):
    x = np.sin(np.arange(4000) / 5) + 1
    rows = [(0, "EEG", i, x[i * 400 : (i + 1) * 400].astype(np.float32).tolist()) for i in range(10)]
    own = spark.createDataFrame(rows, "subject_id int, channel string, epoch_idx int, samples array<float>")
    got = dsp.filter_nights(own, lambda s: dsp.fir_bandpass(s, 100.0)).orderBy("epoch_idx").collect()
    whole = dsp.fir_bandpass(x.astype(np.float32).astype(float), 100.0)
    assert np.allclose(np.concatenate([r.samples for r in got]), whole, atol=1e-5)


def test_split_invariants(spark):
    for n in (1, 2, 7, 40):
        got = engine.splits.random_split(n)
        assert len(got) == n and set(got) <= {"train", "valid", "test"}
    folds = engine.splits.stratified_with_validation(spark.createDataFrame([(i, i % 3) for i in range(40)], "subject_id int, grp int"), "grp", 4, F.col("subject_id"))
    tests = folds.where("split = 'test'").groupBy("subject_id").count().collect()
    assert len(tests) == 40 and all(r["count"] == 1 for r in tests)
