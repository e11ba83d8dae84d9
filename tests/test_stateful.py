"""State processors under disorder and restarts, table functions, and rewrites of folds."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import udtfs
from nightloom.operators import sequences
from nightloom.sources import folds
from nightloom.streaming import stateful

WIDTH, LENGTH = 4, 3
BEGIN = datetime.datetime(2024, 1, 1)


def test_epochs_and_sequences_survive_disorder_and_restarts(spark, tmp_path):
    stateful.with_state_store(spark)
    rng = random.Random(0)
    own = [(r, BEGIN + datetime.timedelta(seconds=i), i, float(i * (1 + (r == "b")))) for r in ("a", "b") for i in range(WIDTH * 9 + 2)]
    own = [x for x in own if not (x[0] == "b" and x[2] == 14)]  # of b's fourth epoch one sample never comes
    rng.shuffle(own)
    own += rng.sample(own, 15) + [("a", BEGIN, None, 1.0), ("a", BEGIN, 3, None), ("a", BEGIN, -1, 5.0)]
    late = ("z", BEGIN + datetime.timedelta(hours=1), 0, 1.0)  # lets the watermark pass
    parts = [own[:30], own[30:60], own[60:], [late], [("z", BEGIN + datetime.timedelta(hours=2), 1, 1.0)]]
    schema = "record string, ts timestamp, i long, value double"

    def run(upto, since):
        for k in range(since, upto):
            spark.createDataFrame(parts[k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
            q = stateful.recorded(rows, WIDTH, LENGTH).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None

    run(len(parts), 0)  # a new start of the query for every file
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    value = lambda r, i: float(i * (1 + (r == "b")))
    epochs = {(r.record, r["at"]): r for r in got if r.kind == "epoch" and r.record != "z"}
    assert len(epochs) == len([r for r in got if r.kind == "epoch" and r.record != "z"]) == 20
    for (rec, e), r in epochs.items():
        want = [value(rec, i) if (rec, i) != ("b", 14) and i < WIDTH * 9 + 2 else None for i in range(e * WIDTH, (e + 1) * WIDTH)]
        assert r.samples == [want] and r.complete == (None not in want)
    found = sorted((r.record, r["at"]) for r in got if r.kind == "sequence")
    assert found == [("a", k) for k in range(7)] + [("b", 0)] + [("b", k) for k in range(4, 7)]
    one = next(r for r in got if r.kind == "sequence" and r.record == "a" and r["at"] == 2)
    assert one.samples == [[value("a", i) for i in range(e * WIDTH, (e + 1) * WIDTH)] for e in (2, 3, 4)]
    last = max((r for r in got if r.record == "a"), key=lambda r: r.n)
    x = np.arange(WIDTH * 9 + 2)
    assert last.n == len(x) and np.isclose(last["mean"], x.mean()) and np.isclose(last.m2, ((x - x.mean()) ** 2).sum())


def test_sequences_from_sql(spark):
    labels = spark.createDataFrame([(s, e, (e + s) % 5) for s, n in ((1, 7), (2, 2), (3, 4)) for e in range(n)], "subject_id int, epoch_idx int, stage int")
    udtfs.register(spark)
    labels.createOrReplaceTempView("udtf_labels")
    got = spark.sql("SELECT * FROM record_sequences(TABLE(udtf_labels) PARTITION BY (subject_id), 4)").collect()
    want = sequences.sequences(labels, 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6 * 4


def test_folds_change_all_at_once(spark, tmp_path):
    rows = lambda d, s, n=6: spark.createDataFrame([(d, i, 0, s) for i in range(n)], "dataset string, subject_id int, fold int, split string")
    path = str(tmp_path)
    seen = lambda: {(r.dataset, r.split): r["count"] for r in folds.current(spark, path).groupBy("dataset", "split").count().collect()}
    folds.rewrite(spark, path, rows("a", "train").union(rows("b", "test")).union(rows("c", "valid")))
    folds.rewrite(spark, path, rows("a", "test", 3).union(rows("b", "train")))
    after = {("a", "test"): 3, ("b", "train"): 6, ("c", "valid"): 6}
    assert seen() == after
    held = folds.current(spark, path)
    with pytest.raises(ValueError, match="several splits"):
        folds.rewrite(spark, path, rows("a", "train").union(rows("b", "train")).union(rows("b", "test")))
    with pytest.raises(ValueError, match="no fold"):
        folds.rewrite(spark, path, rows("a", "elsewhere"))
    broken = rows("a", "train").withColumn("fold", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        folds.rewrite(spark, path, rows("b", "valid").union(broken))
    assert seen() == after and held.count() == 15
    folds.rewrite(spark, path, rows("c", "test"))
    assert held.count() == 15 and seen() == {("a", "test"): 3, ("b", "train"): 6, ("c", "test"): 6}
    assert len([p for p in (tmp_path / "folds").iterdir() if p.is_dir()]) == 2
