"""Files read by ranges: the same rows as whole files, fewer bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.sources import edf, edf_files

RATES = (("EEG", 100), ("EOG", 50), ("EMG", 200), ("SaO2", 1))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("edf"), np.random.default_rng(0)
    for i, (seconds, record_s) in enumerate(((600, 1.0), (95, 2.0), (20, 1.0), (300, 7.0))):
        signals = [(n, r, np.sin(np.arange(seconds * r) / (3 + k)) * 50 + rng.normal(0, 1, seconds * r)) for k, (n, r) in enumerate(RATES)]
        edf.write(str(out / f"r{i}.edf"), signals, [(30 * e, 30, f"stage {e % 5}") for e in range(seconds // 30)] + [(31, 0, "noise"), (31, 2, "noise")], record_s)
    (out / "other.txt").write_text("no recording")
    (out / "more").mkdir()
    edf.write(str(out / "more" / "r9.edf"), [("EEG", 100, rng.normal(0, 1, 9000))])
    return out


def whole(path, seconds):
    """Epochs of a file from all of its bytes."""
    data = path.read_bytes()
    h = edf.header(data)
    for k, s in enumerate(h["signals"]):
        if s["label"] != edf.ANNOTATIONS:
            width = int(round(seconds * s["rate"]))
            x = edf.samples(data, h, k).astype(np.float32)
            for e in range(len(x) // width):
                yield (path.name, s["label"], e), x[e * width : (e + 1) * width]


@pytest.mark.parametrize(("seconds", "split"), [(30.0, 1 << 26), (30.0, 7_000), (4.0, 50_000), (2.5, 999)])
def test_epochs_of_split_files(spark, folder, seconds, split):
    rows = edf_files.load(spark, "edf", str(folder), epochSeconds=seconds, splitBytes=split)
    got = {(r.path.rsplit("/", 1)[1], r.label, r.epoch_idx): r for r in rows.collect()}
    want = {k: v for p in folder.rglob("*.edf") for k, v in whole(p, seconds)}
    assert got.keys() == want.keys() and len(got) == rows.count()
    assert all(np.allclose(got[k].samples, want[k]) and got[k].start_s == k[2] * seconds for k in want)
    assert (rows.rdd.getNumPartitions() > 10) == (split < 1 << 26)


def test_filters_are_pushed_and_exact(spark, folder):
    rows = edf_files.load(spark, "edf", str(folder), splitBytes=20_000)
    for keep in (F.col("label") == "EOG", F.col("label").isin("EEG", "SaO2", "none"), (F.col("start_s") >= 60) & (F.col("start_s") < 150), (F.col("start_s") > 60) & (F.col("label") == "EMG") & (F.col("start_s") <= 150) & (F.col("start_s") > 30), (F.col("rate") > 60) & (F.col("label") == "EEG"), F.lower("label") == "eeg"):
        got = {(r.path, r.label, r.epoch_idx) for r in rows.where(keep).collect()}
        assert got == {(r.path, r.label, r.epoch_idx) for r in rows.cache().where(keep).collect()} and got
        rows.unpersist()
    plan = rows.where("label = 'EOG' AND start_s >= 60")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_only_the_bytes_of_the_channel_are_read(folder):
    path = str(folder / "r0.edf")
    size = (folder / "r0.edf").stat().st_size
    reader = edf_files._Epochs({"path": str(folder)})
    opened = []
    whole = edf_files.EdfFile.bytes
    try:
        edf_files.EdfFile.bytes = lambda self, at, n: (opened.append((at, n)), whole(self, at, n))[1]
        list(reader.pushFilters([edf_files.EqualTo(("label",), "EOG"), edf_files.GreaterThanOrEqual(("start_s",), 60.0), edf_files.LessThan(("start_s",), 120.0)]))
        batches = list(reader.read(edf_files.Piece([(path, 0, 1 << 62)])))
    finally:
        edf_files.EdfFile.bytes = whole
    header = 256 * (len(RATES) + 2)
    data = sum(n for at, n in opened if at >= header)
    assert sum(b.num_rows for b in batches) == 2 and data == 60 * 50 * 2 < size / 50
    assert sum(n for at, n in opened if at < header) == 2 * header
    one = edf_files.EdfFile.open(path)
    x = one.samples(1, 12.5, 40.0)
    data = (folder / "r0.edf").read_bytes()
    assert np.allclose(x, edf.samples(data, edf.header(data), 1, 12.5, 40.0)) and one.read < header + 2 * 50 * 29
    near = edf_files.EdfFile.open(path, gap=1 << 20)
    assert np.allclose(near.samples(1, 12.5, 40.0), x)


def test_headers_and_annotations_of_split_files(spark, folder):
    heads = edf_files.load(spark, "edf_headers", str(folder))
    assert heads.count() == 4 * 5 + 2 and {r.rate for r in heads.where("label = 'EMG'").collect()} == {200.0}
    for split in (1 << 26, 3_000):
        rows = edf_files.load(spark, "edf_annotations", str(folder), splitBytes=split)
        for p in sorted(folder.rglob("*.edf")):
            data = p.read_bytes()
            own = rows.where(F.col("path").endswith("/" + p.name)).orderBy("signal", "record", "item").collect()
            assert [(r.onset_s, r.duration_s, r.code) for r in own] == edf.annotations(data, edf.header(data))


def test_stores_without_ranges_are_named(spark):
    assert edf_files.readable("/a") and edf_files.readable("file:/a") and edf_files.readable("s3a://b/a") and not edf_files.readable("viewfs://a/b") and not edf_files.readable("hdfs://a/b")
    with pytest.raises(Exception, match="cannot be read by ranges"):
        edf_files.load(spark, "edf", "hdfs://a/b").count()


def test_files_without_records_or_end(spark, tmp_path):
    edf.write(str(tmp_path / "a.edf"), [("EEG", 10, np.arange(100.0))])
    data = bytearray((tmp_path / "a.edf").read_bytes())
    data[236:244] = b"-1      "  # the number of records is not known
    (tmp_path / "b.edf").write_bytes(bytes(data[:-7]))  # and the last one is cut off
    (tmp_path / "c.edf").write_bytes(bytes(data[: 256 * 3]))
    rows = edf_files.load(spark, "edf", str(tmp_path), epochSeconds=1)
    assert {r.path[-5]: r["count"] for r in rows.groupBy("path").count().collect()} == {"a": 10, "b": 9}
