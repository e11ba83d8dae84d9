"""Sequences with samples against plain Python, what they shuffle, and training on ingested tables and bundles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom import engine
from nightloom.sources import sinks
from nightloom.training import loop

WIDTH, CHANNELS = 40, ("B", "A")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two data sets with short, whole, gapped and silent records; channel C is in the tables only."""
    path, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(0)
    lengths = {("d", 0): 12, ("d", 1): 3, ("d", 2): 7, ("d", 3): 5, ("e", 0): 9, ("e", 1): 8, ("d", 4): 6, ("d", 5): 6, ("d", 6): 6}
    labels = [(d, s, e, (e + s) % 5) for (d, s), n in lengths.items() for e in range(n)]
    level = {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}
    epochs = [(d, s, e, c, (rng.normal(level[(e + s) % 5], 0.3, WIDTH)).astype(np.float32).tolist()) for d, s, e, _ in labels for c in "ABC" if not (d, s, e) == ("d", 2, 4) or c == "A"]
    epochs = [x for x in epochs if x[:2] != ("d", 3)]  # labels without a signal
    stats = [(d, p, c, "raw", 10, float(i) / 10, 0.0 if p == 3 and c == "A" else 1.5) for d in "de" for i, c in enumerate("ABC") for p in range(WIDTH)]
    folds = [(d, s, 0, "test" if (d, s) in (("d", 5), ("e", 1)) else "valid" if (d, s) == ("d", 6) else "train") for d, s in lengths]
    sinks.write_labels(spark.createDataFrame(labels, "dataset string, subject_id int, epoch_idx int, stage int"), f"{path}/labels")
    sinks.write_epochs(spark.createDataFrame(epochs, "dataset string, subject_id int, epoch_idx int, channel string, samples array<float>"), f"{path}/epochs")
    sinks.write_table(spark.createDataFrame(stats, "dataset string, pos int, channel string, prep string, n long, mean double, std double"), f"{path}/scaling", "dataset")
    sinks.write_table(spark.createDataFrame(folds, "dataset string, subject_id int, fold int, split string"), f"{path}/folds", "dataset")
    return engine.Tables(spark, path), labels, {x[:4]: x[4] for x in epochs}, {(d, c): [m[5:] for m in stats if m[0] == d and m[2] == c] for d in "de" for c in "ABC"}, folds


def expected(tables, datasets, length):
    _, labels, epochs, stats, folds = tables
    scaled = lambda x, own: [None if s == 0 else (np.float64(v) - m) / s for v, (m, s) in zip(x, own, strict=True)]
    pad = [scaled([0.0] * WIDTH, stats[datasets[0], c]) for c in CHANNELS]
    out = {}
    for d, s, _, split in folds:
        if d in datasets and split == "train":
            own = {e: y for a, b, e, y in labels if (a, b) == (d, s)}
            for r in range(max(len(own) - length, 0) + 1):
                at = range(r, r + length)
                x = [[scaled(epochs[d, s, e, c], stats[d, c]) for c in CHANNELS] if all((d, s, e, c) in epochs for c in CHANNELS) else pad for e in at]
                out[f"{d}/{s}", r] = [own.get(e, 5) for e in at], x
    return out


@pytest.mark.parametrize(("datasets", "length"), [(("d", "e"), 5), (("d",), 21)])
def test_samples_by_plain_python(tables, datasets, length, monkeypatch):
    from nightloom.operators import gather

    monkeypatch.setattr(gather, "BATCH_BYTES", 40_000)
    got = engine.EpochDataset(tables[0], datasets, CHANNELS, length, target=lambda y: F.element_at(y, 1)).samples("train").collect()
    want = expected(tables, datasets, length)
    assert {(r.record, r.rel_idx) for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        stages, x = want[r.record, r.rel_idx]
        assert r.stages == stages and r.y == stages[0] and len(r.x) == length
        for a, b in zip(r.x, x, strict=True):
            assert [[v is None for v in c] for c in a] == [[v is None for v in c] for c in b]
            assert np.allclose([v for c in a for v in c if v is not None], [v for c in b for v in c if v is not None])


def shuffled_bytes(spark, action):
    """Bytes that the stages of an action have written for shuffles."""
    context = spark.sparkContext
    context.setJobGroup("shuffled-bytes", "")
    action()
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker, status, total = context.statusTracker(), context._jsc.sc().statusStore(), 0
    for stage in {s for job in tracker.getJobIdsForGroup("shuffled-bytes") for s in tracker.getJobInfo(job).stageIds}:
        try:
            total += status.lastStageAttempt(stage).shuffleWriteBytes()
        except Exception:  # a stage that was skipped
            continue
    return total


def test_epochs_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path)
    keys = spark.createDataFrame([("d", s, e, e % 5) for s in range(4) for e in range(60)], "dataset string, subject_id int, epoch_idx int, stage int")
    sinks.write_labels(keys, f"{path}/labels")
    noise = F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: (F.xxhash64("subject_id", "epoch_idx", "channel", i) % 100003 / 1000).cast("float"))
    sinks.write_epochs(keys.drop("stage").withColumn("channel", F.explode(F.array(F.lit("A"), F.lit("B")))).withColumn("samples", noise), f"{path}/epochs")
    stats = [("d", p, c, "raw", 9, 0.0, 1.0) for c in "AB" for p in range(3000)]
    sinks.write_table(spark.createDataFrame(stats, "dataset string, pos int, channel string, prep string, n long, mean double, std double"), f"{path}/scaling", "dataset")
    sinks.write_table(spark.createDataFrame([("d", s, 0, "train") for s in range(4)], "dataset string, subject_id int, fold int, split string"), f"{path}/folds", "dataset")
    rows = engine.EpochDataset(engine.Tables(spark, path), ["d"], ["A", "B"]).samples("train")
    size = 4 * 60 * 2 * 3000 * 4
    found = shuffled_bytes(spark, lambda: rows.select(F.size("x").alias("n")).write.format("noop").mode("overwrite").save())
    assert 0.3 * size < found < 1.2 * size
    assert rows.count() == 4 * 40


def features(c):
    x = c.cast("array<double>")
    return F.array(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))) / WIDTH)


def test_training_on_tables_and_bundles(spark, tables, tmp_path):
    t = tables[0]
    data = engine.EpochDataset(t, ("d", "e"), CHANNELS)
    own = {(r.record, r.epoch_idx): r for r in data.examples("train", features, 3).collect()}
    assert len(own) == sum(1 for k in tables[2] if k[3] == "A" and (k[0], k[1], k[2]) != ("d", 2, 4) and k[:2] not in (("d", 5), ("e", 1), ("d", 6)))
    first, second = own["d/0", 0].x, own["d/0", 1].x
    assert len(first) == 6 and first[:2] == [0.0, 0.0] and first[2:] == second[:4] and own["d/0", 11].x[4:] == [0.0, 0.0]
    settings = loop.Settings(learning_rate=0.05, epochs=2)
    fitted = engine.train(data, str(tmp_path / "run"), features, "dense:8", settings=settings)
    result = {r.dataset: r for r in engine.test_model([engine.EpochDataset(t, [d], CHANNELS) for d in "de"], fitted, features, results=str(tmp_path / "csv")).collect()}
    assert result.keys() == {"d", "e"} and result["d"].records == 1 and result["d"].loss < 2.5 and 0 <= result["e"].acc <= 1
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    engine.compress(spark, t.path, str(tmp_path / "bundle"), half=())
    packed = engine.EpochDataset(engine.Tables(spark, t.path, str(tmp_path / "bundle")), ("d", "e"), CHANNELS)
    again = engine.train(packed, str(tmp_path / "fast"), features, "dense:8", settings=settings)
    assert np.allclose(again.last, fitted.last, atol=1e-9)
    more = engine.finetune(data, str(tmp_path / "run"), str(tmp_path / "more"), features, 0.0, model="dense:8", settings=loop.Settings(epochs=1))
    assert np.array_equal(more.params, fitted.params)
    with pytest.raises(KeyError, match="no scaling statistics"):
        engine.EpochDataset(t, ["d"], ["Z"]).samples("train")


def test_training_commands(spark, tables, tmp_path):
    common = ["-d", "d", "--channels", "A", "-x", "tests.test_gather:features", "--epochs", "2", "--learning-rate", "0.05"]
    engine.main(["train", tables[0].path, str(tmp_path / "a"), *common, "--results", str(tmp_path / "r")])
    assert loop.read_log(spark, str(tmp_path / "a")).count() == 2 and spark.read.option("header", "true").csv(str(tmp_path / "r")).first().dataset == "d"
    engine.main(["finetune", tables[0].path, str(tmp_path / "b"), *common, "--start", str(tmp_path / "a"), "-m", "linear"])
    assert loop.checkpoint(spark, str(tmp_path / "b")).shape == (10,)
    own = engine.network("tests.test_gather:Own", 3, 5)
    assert own.sizes == (3, 5)
    from nightloom.training import features as small

    x = spark.createDataFrame([([float(np.sin(i)) for i in range(1000)],)], "x array<float>")
    r = x.select(small.log_band_powers(F.col("x")).alias("b"), small.mean_and_spread(F.col("x")).alias("m")).first()
    assert len(r.b) == 5 and int(np.argmax(r.b)) == 3 and np.isclose(r.m[1], 0.5, atol=0.01)  # 1 rad a sample at 100 Hz: 15.9 Hz


class Own:
    def __init__(self, sizes, loss="cel"):
        self.sizes, self.kind = sizes, loss
