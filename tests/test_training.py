"""Training, fine-tuning, testing and attributions against plain numpy on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.training import explain, loop, nets
from nightloom.training.optim import Adam, Plateau


def rows_of(n=400, d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=(d, k)) + rng.normal(0, 0.3, (n, k))).argmax(1)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(f"r{i % 7}", i, x[i].tolist(), int(y[i]) if np.issubdtype(type(y[i]), np.integer) else float(y[i])) for i in range(len(x))]
    kind = "int" if np.issubdtype(np.asarray(y).dtype, np.integer) else "double"
    return spark.createDataFrame(rows, f"record string, epoch_idx int, x array<double>, y {kind}").repartition(parts)


@pytest.mark.parametrize(("loss", "activation"), [("cel", "tanh"), ("cel", "relu"), ("mse", "tanh"), ("reg", "tanh")])
def test_gradients_by_differences(loss, activation):
    x, y = rows_of(20)
    net = nets.Dense((5, 4, 3 if loss == "cel" else 1), activation, loss)
    y = y if loss == "cel" else y * 20.0
    p = net.start()
    total, g = net.gradient(p, x, y)
    assert np.isclose(total, net.loss(p, x, y).sum())
    for i in range(0, len(p), 3):
        step = np.zeros_like(p)
        step[i] = 1e-6
        assert np.isclose(g[i], (net.loss(p + step, x, y).sum() - net.loss(p - step, x, y).sum()) / 2e-6, rtol=1e-4, atol=1e-6)
    own = net.input_gradient(p, x, np.zeros(20, int))
    step = np.zeros(5)
    step[2] = 1e-6
    assert np.allclose(own[:, 2], (net.scores(p, x + step)[:, 0] - net.scores(p, x - step)[:, 0]) / 2e-6, rtol=1e-4, atol=1e-6)


def one_machine(x, y, batch, net, s, epochs, params=None):
    """The same training without Spark: (parameters after each epoch, losses)."""
    now, adam, plateau, out = net.start() if params is None else params, Adam(s.learning_rate, s.weight_decay), Plateau(), []
    names = sorted(set(batch), key=lambda b: f"batch={b}")
    for epoch in range(epochs):
        for at in np.random.default_rng((s.seed, epoch)).permutation(len(names)):
            own = batch == names[at]
            now = adam.step(now, net.gradient(now, x[own], y[own])[1] / own.sum())
        loss = net.loss(now, x, y).mean()
        out.append((now, loss, (net.scores(now, x).argmax(1) == y).mean(), adam.rate))
        adam.rate = plateau.step(loss, adam.rate)
    return out


def test_training_equals_one_machine_and_resumes(spark, tmp_path):
    x, y = rows_of()
    net, s = nets.Dense((5, 6, 3)), loop.Settings(learning_rate=0.02, weight_decay=1e-3, batch_rows=140, epochs=4)
    data = frame(spark, x, y)
    batch = np.zeros(len(x), int)
    for r in loop.dealt(data, 3, "record", "epoch_idx").collect():
        batch[r.epoch_idx] = r.batch
    want = one_machine(x, y, batch, net, s, 4)
    nulls = spark.createDataFrame([("z", 1, None, 1), ("z", 2, [0.0] * 5, None), (None, None, None, None)], data.schema)
    got = loop.fit(data.unionByName(nulls), data, net, str(tmp_path / "a"), s)
    assert np.allclose(got.last, want[-1][0], atol=1e-6)
    log = got.log.collect()
    assert [r.epoch for r in log] == list(range(4)) and np.allclose([(r.val_loss, r.val_acc, r.rate) for r in log], [w[1:] for w in want], atol=1e-6)
    best = max(range(4), key=lambda e: (want[e][2], -e))
    assert np.allclose(got.params, want[best][0], atol=1e-6) and np.allclose(loop.checkpoint(spark, str(tmp_path / "a")), want[best][0], atol=1e-6)
    assert len(list((tmp_path / "a" / "last").iterdir())) == len(list((tmp_path / "a" / "best").iterdir())) == 1
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("work")]

    loop.fit(data, data, net, str(tmp_path / "b"), loop.Settings(**(s.__dict__ | {"epochs": 2})))
    again = loop.fit(data, data, net, str(tmp_path / "b"), s)
    assert np.allclose(again.last, got.last, atol=1e-9) and [r.epoch for r in again.log.collect()] == list(range(4))
    done = loop.fit(data, data, net, str(tmp_path / "b"), s)
    assert np.allclose(done.last, got.last, atol=1e-9)


def test_an_unfinished_state_does_not_count(spark, tmp_path):
    x, y = rows_of(60)
    data, net, s = frame(spark, x, y), nets.Dense((5, 3)), loop.Settings(learning_rate=0.02, epochs=2)
    loop.fit(data, data, net, str(tmp_path), s)
    broken = tmp_path / "last" / "epoch-00009"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"")
    three = loop.fit(data, data, net, str(tmp_path), loop.Settings(learning_rate=0.02, epochs=3))
    assert [r.epoch for r in three.log.collect()] == [0, 1, 2]


def test_validations_within_an_epoch_and_lower_rates(spark, tmp_path):
    x, y = rows_of(200)
    data, net = frame(spark, x, y), nets.Dense((5, 3))
    got = loop.fit(data, data, net, str(tmp_path), loop.Settings(learning_rate=0.5, batch_rows=50, epochs=2, validations=2, monitor="val_loss", mode="min"))
    log = got.log.collect()
    assert [(r.epoch, r.step) for r in log] == [(0, 2), (0, 4), (1, 6), (1, 8)]
    assert np.isclose(net.loss(got.params, x, y).mean(), min(r.val_loss for r in log))
    with pytest.raises(ValueError, match="no examples"):
        loop.fit(data.limit(0), data, net, str(tmp_path / "c"))


def test_plateau_lowers_after_patience():
    p, rate, rates = Plateau(), 1.0, []
    for loss in (1.0, 0.9, 0.9, 0.9, 0.9, 0.8, 0.9, 0.9):
        rate = p.step(loss, rate)
        rates.append(rate)
    assert rates == [1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0.25]


def test_fine_tuning(spark, tmp_path):
    x, y = rows_of(150)
    data, net = frame(spark, x, y), nets.Dense((5, 4, 3))
    start = net.start() + 0.1
    still = loop.finetune(data, data, net, start, str(tmp_path / "a"), learning_rate=0.0, settings=loop.Settings(epochs=2))
    before, after = (sorted((r.epoch_idx, *r.scores) for r in loop.predict(data, net, p).collect()) for p in (start, still.params))
    assert np.allclose(before, after, atol=0)
    s = loop.Settings(learning_rate=1e-3, weight_decay=1e-3, epochs=2)
    got = loop.finetune(data, data, net, start, str(tmp_path / "b"), learning_rate=1e-3, settings=loop.Settings(epochs=2))
    assert np.allclose(got.last, one_machine(x, y, np.zeros(150, int), net, s, 2, start)[-1][0], atol=1e-6)
    assert not np.allclose(got.last, start)


@pytest.mark.parametrize("kind", ["cel", "reg", "mse"])
def test_loss_by_data_set(spark, kind):
    x, y = rows_of(90)
    y = y if kind == "cel" else y * 9.0
    net = nets.Dense((5, 3 if kind == "cel" else 1), loss=kind)
    data = frame(spark, x, y).withColumn("dataset", F.when(F.col("record") < "r3", "a").otherwise("b"))
    got = {r.dataset: r for r in loop.test(data, net, net.start()).collect()}
    own = net.loss(net.start(), x, y)
    for name, records in (("a", range(3)), ("b", range(3, 7))):
        assert got[name].records == len(records) and np.isclose(got[name].loss, np.mean([own[[i for i in range(90) if i % 7 == r]].mean() for r in records]))
    assert loop.test(data, net, net.start(), by=()).first().records == 7
    assert loop.test(data.limit(0), net, net.start()).collect() == []


def test_attributions_are_complete(spark):
    x, y = rows_of(60)
    net = nets.Dense((5, 8, 3))
    p = net.start() * 2
    data = frame(spark, x, y)
    base = explain.collected_baselines(data.where("epoch_idx < 4"), order="epoch_idx")
    got = explain.expected_gradients(data, net, p, base).collect()
    assert len(got) == 60 and all(np.isclose(sum(r.attributions), r.change, atol=1e-6) for r in got)
    r = next(r for r in got if r.epoch_idx == 17)
    scores = net.scores(p, x)
    assert r.target == scores[17].argmax() and np.isclose(r.change, scores[17][r.target] - net.scores(p, base)[:, r.target].mean())
    named = explain.expected_gradients(data, net, p, base[:1], target="y").collect()
    assert all(r.target == r.y and np.isclose(sum(r.attributions), r.change, atol=1e-6) for r in named)
    with pytest.raises(ValueError, match="baselines"):
        explain.collected_baselines(data.limit(0))


def test_codebooks_learn(spark):
    from nightloom.training import codebooks

    x, _ = rows_of(300, 4)
    data = frame(spark, x, np.zeros(300, int)).withColumnRenamed("epoch_idx", "id").cache()
    book, losses = codebooks.fit(data, codebooks.Book(x[:8]), epochs=6, decay=0.3)
    assert all(b < a for a, b in zip(losses, losses[1:]))
    own, far = codebooks.nearest(x, x[:8])
    assert np.isclose(losses[0], 0.25 * far.mean())
    want = np.stack([(0.3 * x[c] + 0.7 * x[own == c].sum(0)) / (0.3 + 0.7 * (own == c).sum()) for c in range(8)])
    assert np.allclose(codebooks.step(data, codebooks.Book(x[:8]), 0.3)[0].codes, want)
    far_code = np.vstack([x[:7], np.full((1, 4), 1e3)])
    still, _ = codebooks.fit(data, codebooks.Book(far_code), epochs=4, decay=0.3)
    assert np.allclose(still.codes[7], 1e3)
    alive, _ = codebooks.fit(data, codebooks.Book(far_code), epochs=4, batches=2, decay=0.3, revive_below=0.5)
    assert np.abs(alive.codes).max() < 10
    empty, loss = codebooks.step(data.limit(0), codebooks.Book(x[:8]))
    assert loss == 0 and np.allclose(empty.codes, x[:8])


def test_codebook_loss_falls_on_the_tables(spark):
    import os

    from nightloom.training import codebooks

    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    rows = spark.read.parquet(path).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")).cache()
    start = np.array([r.x for r in rows.orderBy("id").limit(16).collect()])
    _, losses = codebooks.fit(rows, codebooks.Book(start), epochs=6, batches=3, decay=0.5, revive_below=0.1)
    assert all(b < a for a, b in zip(losses, losses[1:]))
