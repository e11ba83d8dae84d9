"""Micro fixtures with answers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import channels, hypnogram, metrics, prototypes, records, scaling, sequences, splits, voting


def stages(spark, *records):
    rows = [(s, i, x) for s, r in enumerate(records) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, "subject_id int, epoch_idx int, stage int")


def test_recode(spark):
    got = stages(spark, [0, 1, 2, 3, 4, 5]).orderBy("epoch_idx").select(hypnogram.recode(F.col("stage"), hypnogram.RK_TO_FIVE)).collect()
    assert [r[0] for r in got] == [0, 1, 2, 3, 3, 4]


def test_drop_invalid_renumbers(spark):
    got = hypnogram.drop_invalid(stages(spark, [-1, 0, 2, 6, 5]), 0, 5).orderBy("epoch_idx").collect()
    assert [(r.stage, r.epoch_idx) for r in got] == [(0, 0), (2, 1), (5, 2)]


@pytest.mark.parametrize(
    ("record", "lo", "hi"),
    [([0] * 5 + [2] * 3 + [0] * 4, 5, 10), ([0] * 10 + [2] * 4, 10, 13), ([0, 2, 2, 0], 0, 4), ([2] + [0] * 6 + [3], 0, 7), ([0, 0, 0], 0, 3)],
)
def test_wake_bounds(spark, record, lo, hi):
    got = hypnogram.wake_bounds(stages(spark, record)).first()
    assert (got.lo, got.hi) == (lo, hi)


def test_wake_bounds_against_arrays(spark):
    rng = np.random.default_rng(0)
    records = [rng.choice(5, rng.integers(3, 60), p=[0.6, 0.1, 0.1, 0.1, 0.1]) for _ in range(60)]

    def by_array(s):
        n, count = len(s), np.bincount(s, minlength=5)
        change = np.flatnonzero(np.diff(s == 0)) + 1
        if count[0] <= count[1:].max() or not len(change):
            return 0, n
        eve, morn = (change[0] if s[0] == 0 else 0), n - change[-1] + 1
        rest = eve + morn - count[1:].max()
        if rest <= 0:
            return 0, n
        return (rest, n) if eve > rest else (eve, n - (rest - eve))

    got = {r.subject_id: (r.lo, r.hi) for r in hypnogram.wake_bounds(stages(spark, *[r.tolist() for r in records])).collect()}
    assert got == {i: tuple(map(int, by_array(r))) for i, r in enumerate(records)}


def test_modal_and_unanimous(spark):
    fine = spark.createDataFrame([(0, 2)] * 15 + [(0, 1)] * 15 + [(1, 2)] * 30, "epoch_idx int, stage int")
    assert {r.epoch_idx: r.stage for r in hypnogram.modal_label(fine, ["epoch_idx"]).collect()} == {0: 1, 1: 2}
    assert {r.epoch_idx: r.stage for r in hypnogram.unanimous_label(fine, ["epoch_idx"]).collect()} == {0: -1, 1: 2}


def test_gaps_and_overlaps(spark):
    own = spark.createDataFrame([(1, 0.0, 60.0, 0), (1, 90.0, 30.0, 2), (2, 0.0, 90.0, 1), (2, 60.0, 30.0, 4)], "r int, onset_s double, duration_s double, stage int")
    got = {}
    for r in hypnogram.fill_gaps(own, ["r"]).orderBy("r", "epoch_idx").collect():
        got.setdefault(r.r, []).append(r.stage)
    assert got == {1: [0, 0, -1, 2], 2: [1, 1, 4]}


def test_sequences(spark):
    own = stages(spark, range(30), range(21), range(5))
    assert sorted(r.sequences for r in sequences.sequence_counts(own).collect()) == [1, 1, 10]
    short = sequences.sequences(stages(spark, [0, 1, 2]), 5).orderBy("off").collect()
    assert [r.stage for r in short] == [0, 1, 2, 5, 5] and [r.padded for r in short] == [False] * 3 + [True] * 2
    two = stages(spark, [0, 1, 2], [3, 4])
    assert sequences.crossing_sequences(two, 2).select("start").distinct().count() == 4
    middle = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2, 3, 4],)], "s array<int>").select(sequences.middle(F.col("s"))).collect()
    assert [r[0] for r in middle] == [3, 2]


def test_scaling(spark):
    own = spark.createDataFrame([([float(x)],) for x in (1, 2, 3, 4)], "x array<float>")
    r = scaling.positional_scaling(own, "x").first()
    assert r["mean"] == 2.5 and math.isclose(r["std"], 1.2909944487, rel_tol=1e-9)
    one = scaling.positional_scaling(own.limit(1), "x").first()
    assert (one["mean"], one["std"]) == (0.0, 0.0)
    z = scaling.standardise(own, scaling.positional_scaling(own, "x"), "x", "z")
    back = [r[0][0] for r in z.select(scaling.restored(F.col("z"), F.col("mean"), F.col("std"))).collect()]
    assert np.allclose(sorted(back), [1, 2, 3, 4])
    with pytest.raises(Exception, match="NaN"):
        scaling.guarded(spark.createDataFrame([([float("nan")],)], "x array<float>"), "x").collect()


def test_range_join_shuffles_no_pairs(spark):
    units = spark.range(300).select((F.col("id") % 3).cast("int").alias("s"), F.expr("cast(id div 3 as int)").alias("at"))
    spans = spark.createDataFrame([(i, i % 3, a, b) for i, (a, b) in enumerate([(0, 100), (63, 65), (64, 64), (9, 3), (-70, 1), (90, 500), (70, 71), (-5, 0)])], "i int, s int, a int, b int")
    got = records.within(spans, units, ["s"], "a", "b", "at")
    by = {r["i"]: sorted(x["at"] for x in got.where(F.col("i") == r["i"]).collect()) for r in spans.collect()}
    assert by == {0: [*range(100)], 1: [63, 64], 2: [], 3: [], 4: [0], 5: [*range(90, 100)], 6: [70], 7: []}
    many = spans.crossJoin(spark.range(100)).where("a = 0")
    pieces = records.covering(many, "a", "b", 64)
    assert pieces.count() == 200  # 10,000 units, of which one row each was shuffled before


def test_rank_folds_take_exact_shares(spark):
    for n, sizes in {90: {"train": 63, "test": 13, "valid": 14}, 180: {"train": 126, "test": 27, "valid": 27}, 10: {"train": 7, "test": 1, "valid": 2}}.items():
        folds = splits.rank_folds(spark.range(n).withColumnRenamed("id", "subject_id"), F.col("subject_id"))
        assert {r["split"]: r["count"] for r in folds.groupBy("split").count().collect()} == sizes


def test_splits(spark):
    assert [splits.random_split(20).count(s) for s in ("train", "test", "valid")] == [14, 3, 3]
    assert [splits.random_split(10).count(s) for s in ("train", "test", "valid")] == [7, 1, 2]
    people = spark.createDataFrame([("A",), ("B",), ("C",)], "subject_id string")
    table = splits.leave_one_out(people)
    got = {(r.fold, r.subject_id): r.split for k in range(3) for r in splits.one_fold(table, k).collect()}
    assert table.count() == 3
    assert got[0, "A"] == "valid" and got[0, "B"] == "test" and got[0, "C"] == "train" and got[2, "C"] == "valid" and got[2, "A"] == "test"
    folds = splits.greedy_by_duration([(i, 100) for i in range(20)], 4)
    for kind in ("test", "valid"):
        ids = [r for r, _, s in folds if s == kind]
        assert len(ids) == len(set(ids))
        assert all(sum(100 for r, f, s in folds if f == fold and s == kind) == 300 for fold in range(4))
    assert len(folds) == 80


def test_votes(spark):
    preds = spark.createDataFrame([(0, r, o, [0.4, 0.4, 0.2]) for r in range(3) for o in range(3)], "subject_id int, rel_idx int, off int, logits array<double>")
    got = voting.vote(preds, 3).orderBy("epoch_idx").collect()
    assert [r.coverage for r in got] == [1, 2, 3, 2, 1]
    assert preds.select(voting.argmax(F.col("logits"))).first()[0] == 0
    merged = spark.createDataFrame([([0.1, 0.3, 0.2, 0.5, 0.4],)], "s array<double>").select(voting.merge_sleep(F.col("s"))).first()[0]
    assert merged == [0.1, 0.5, 0.4]


def test_metrics(spark):
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    m = metrics.classification(preds).first()
    want = {"acc": 0.75, "macc": 0.75, "ck": 0.5, "pr": 5 / 6, "f1": 11 / 15, "mf1": 11 / 15, "rc": 0.75}
    assert all(math.isclose(m[k], v) for k, v in want.items())
    r = metrics.regression(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "y double, p double")).first()
    assert math.isclose(r.mse, 4 / 3) and math.isclose(r.mae, 2 / 3) and math.isclose(r.r2, -1)


def test_transitions(spark):
    got = {(r.src, r.dst): r.p for r in prototypes.transitions(stages(spark, [0, 0, 1, 0]), 2).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 1.0, (1, 1): 0.0}


def test_channel_priority(spark):
    headers = spark.createDataFrame([("r", x) for x in ("eog(l)", "EOG(R)", "E1", "E2")], "record_id string, label string")
    wanted = spark.createDataFrame([("EOG", 0, "EOG(L)", "EOG(R)"), ("EOG", 1, "E1", "E2")], "modality string, priority int, a string, b string")
    got = channels.resolve(headers, wanted).first()
    assert (got.a, got.b) == ("eog(l)", "EOG(R)")


def test_filterbank_is_triangular():
    bank = prototypes.filterbank(4, 33, 64.0, 0.0, 32.0)
    assert all(0 < w <= 1 for _, _, w in bank) and {f for _, f, _ in bank} == {0, 1, 2, 3}


def test_states_by_position(spark):
    """Merged states against numpy: ragged arrays, nulls, large and close values, many keys, states handed on early."""
    import numpy as np

    from nightloom.operators import scaling

    rng = np.random.default_rng(2)
    rows = [(int(k), None if k % 17 == 3 else f"g{k % 3}", [None if rng.random() < 0.1 else float(1e6 + rng.normal()) for _ in range(int(rng.integers(0, 6)))]) for k in range(300)] + [(1, "g1", None), (2, "only", [5.0])]
    own = spark.createDataFrame(rows, "k int, g string, x array<double>").repartition(5)
    before, scaling.HELD_POSITIONS = scaling.HELD_POSITIONS, 10
    try:
        got = {(r.g, r.pos): r for r in scaling.positional_scaling(own, "x", ["g"]).collect()}
        assert scaling.position_states(own, "x").count() >= 5
    finally:
        scaling.HELD_POSITIONS = before
    want = {}
    for _, g, x in rows:
        for p, v in enumerate(x or ()):
            want.setdefault((g, p), []).extend([] if v is None else [v])
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key].n == len(v) and np.isclose(got[key].mean, np.mean(v) if len(v) > 1 else 0, rtol=1e-12) and np.isclose(got[key].std, np.std(v, ddof=1) if len(v) > 1 else 0, rtol=1e-6)
