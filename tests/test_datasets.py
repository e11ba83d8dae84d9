"""Data sets from generated recordings and scorings, through ingestion to training sequences, bundles and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom import engine
from nightloom.functions import dsp
from nightloom.sources import datasets, edf, sinks


def wave(seconds, rate, k=0):
    rng = np.random.default_rng(k)
    return 40 * np.sin(np.arange(int(seconds * rate)) * (0.3 + 0.1 * k)) + rng.normal(0, 5, int(seconds * rate))


def events(stages, epoch_s=30):
    rows, at = [], 0
    for s in stages:
        rows.append(f"<ScoredEvent><EventType>Stages|Stages</EventType><EventConcept>Stage {s}|{s}</EventConcept><Start>{at}.0</Start><Duration>{epoch_s}.0</Duration></ScoredEvent>")
        at += epoch_s
    return "<PSGAnnotation><ScoredEvents>" + "".join(rows) + "</ScoredEvents></PSGAnnotation>"


def ingested(spark, source, path, **kw):
    t = engine.ingest(spark, source, str(path), **kw)
    labels = {}
    for r in t.labels.where(F.col("dataset") == source.name).orderBy("subject_id", "epoch_idx").collect():
        labels.setdefault(r.subject_id, []).append(r.stage)
    epochs = {(r.subject_id, r.epoch_idx, r.channel): np.array(r.samples) for r in t.epochs.where(F.col("dataset") == source.name).collect()}
    return t, labels, epochs


def test_nsrr_recordings(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "edfs").mkdir(parents=True)
    (raw / "xml").mkdir()
    stages = [0, 1, 2, 2, 3, 4, 5, 9, 5, 2, 1, 2]
    for i in (7, 9):
        x = [wave(30 * 13, 125, i), wave(30 * 13, 50, i + 1), wave(30 * 13, 50, i + 2), wave(30 * 13, 125, i + 3)]
        edf.write(str(raw / "edfs" / f"shhs1-20000{i}.edf"), [("EEG(sec)", 125, x[0]), ("EOG(L)", 50, x[1]), ("EOG(R)", 50, x[2]), ("EMG", 125, x[3])], record_s=2.0)
        (raw / "xml" / f"shhs1-20000{i}-nsrr.xml").write_text(events(stages))
    edf.write(str(raw / "edfs" / "shhs1-200010.edf"), [("other", 100, wave(60, 100))])  # no channels: keeps its number, leaves no epochs
    (raw / "xml" / "shhs1-200010-nsrr.xml").write_text(events([0, 1]))
    (raw / "subjects.csv").write_text("nsrrid,age,sex\n200007,50,1\n200009,60,2\n")
    t, labels, epochs = ingested(spark, datasets.Shhs(str(raw), clinical=str(raw / "subjects.csv")), tmp_path / "out", preprocessors=["xsleepnet"])
    want = [0, 1, 2, 2, 3, 3, 4, 4, 2, 1, 2]  # an unscored epoch goes, and stages of the older rules become five
    assert labels == {0: want, 1: want}
    x = dsp.resample_rate(dsp.fir_bandpass(edf.samples(*both(raw / "edfs" / "shhs1-200007.edf", 0)), 125), 125, 100)
    assert np.allclose(epochs[0, 8, "EEG"], x[9 * 3000 : 10 * 3000], atol=1e-3) and epochs[1, 10, "EMG"].shape == (3000,)
    y = edf.samples(*both(raw / "edfs" / "shhs1-200007.edf", 1)) - edf.samples(*both(raw / "edfs" / "shhs1-200007.edf", 2))
    assert np.allclose(epochs[0, 0, "EOG"], dsp.resample_rate(dsp.fir_bandpass(y, 125), 50, 100)[:3000], atol=1e-3)
    table = {r.subject_id: r for r in t.subjects.collect()}
    assert table[0].age == "50" and table[1].num_windows == 11 and 2 not in table
    assert t.spectra_xsleepnet.select(F.size("spec")).first()[0] == 29


def both(path, k):
    data = path.read_bytes()
    return data, edf.header(data), k


def test_events_must_end_with_the_epochs(spark, tmp_path):
    (tmp_path / "a.xml").write_text(events([0, 1]).replace("<Start>30.0</Start>", "<Start>60.0</Start>"))
    from nightloom.sources import annotations

    with pytest.raises(Exception, match="do not end with the last event"):
        annotations.nsrr_xml(spark, str(tmp_path / "a.xml")).collect()


def test_hmc_recordings(spark, tmp_path):
    names = ("EEG C3-M2", "EOG E1-M2", "EOG E2-M2", "EMG chin", "ECG")
    edf.write(str(tmp_path / "SN001.edf"), [(n, 256, wave(120, 256, k)) for k, n in enumerate(names)])
    edf.write(str(tmp_path / "SN001_sleepscoring.edf"), [("x", 1, np.arange(120.0))], [(0, 30, "Sleep stage W"), (0, 0, "Lights off"), (30, 30, "Sleep stage N1"), (60, 30, "Sleep stage R")])
    _, labels, epochs = ingested(spark, datasets.Hmc(str(tmp_path)), tmp_path / "out")
    assert labels == {0: [0, 1, 4]} and {k[2] for k in epochs} == {"EEG", "EOG", "EMG", "ECG"}
    path = tmp_path / "SN001.edf"
    x = (edf.samples(*both(path, 1)) + edf.samples(*both(path, 2)))[7680:15360]
    assert np.allclose(epochs[0, 1, "EOG"], dsp.bandpass(dsp.resample(x, 3000), 0.3, 40, 100), atol=1e-3)


def test_dcsm_recordings(spark, tmp_path):
    d = tmp_path / "tp1"
    d.mkdir()
    edf.write(str(d / "psg.edf"), [(n, 256, wave(95, 256, k)) for k, n in enumerate(("C4-M1", "E1-M2", "E2-M2", "CHIN", "ECG-II"))])
    (d / "hypnogram.ids").write_text("0,20,W\n20,40,N2\n60,30,REM\n")
    _, labels, epochs = ingested(spark, datasets.Dcsm(str(tmp_path)), tmp_path / "out")
    assert labels == {0: [0, 2, 4]} and len(epochs) == 12
    x = edf.samples(*both(d / "psg.edf", 0))[:7680]
    assert np.allclose(epochs[0, 0, "EEG"], dsp.resample(dsp.bandpass(x, 0.3, 40, 100), 3000), atol=1e-3)


def test_sleep_edf_recordings(spark, tmp_path):
    for night, wake in ((1, 3), (2, 1)):
        n = wake + 4
        edf.write(str(tmp_path / f"SC400{night}E0-PSG.edf".replace("SC400", "SC400")), [(c, 100, wave(30 * n, 100, k) / 1e6) for k, c in enumerate(("EEG Fpz-Cz", "EOG horizontal", "EMG submental"))])
        edf.write(str(tmp_path / f"SC400{night}EC-Hypnogram.edf"), [("x", 1, np.arange(30.0 * n))], [(0, 30 * wake, "Sleep stage W"), (30 * wake, 30, "Sleep stage 1"), (30 * wake + 30, 60, "Sleep stage 4"), (30 * wake + 90, 30, "Sleep stage ?")])
    _, labels, epochs = ingested(spark, datasets.SleepEdf(str(tmp_path), crop_min=1), tmp_path / "out")
    assert labels == {0: [0, 0, 1, 3, 3, 0, 1, 3, 3]}  # both nights are one record; wake is cropped to a minute
    assert len({k[1] for k in epochs}) == 9 and 10 < np.abs(epochs[0, 0, "EEG"]).max() < 100


def test_wsc_recordings(spark, tmp_path):
    for i, seconds in ((1, 130), (2, 130), (3, 130)):
        edf.write(str(tmp_path / f"wsc-visit1-{i}-nsrr.edf"), [(c, 100, wave(seconds, 100, k)) for k, c in enumerate(("C3_M2", "E1", "E2", "chin"))])
    (tmp_path / "wsc-visit1-1-nsrr.stg.txt").write_text("Epoch\tStage\n" + "".join(f"{i}\t{s}\n" for i, s in enumerate((0, 1, 7, 5, 2), 1)))
    (tmp_path / "wsc-visit1-2-nsrr.stg.txt").write_text("1\t0\n2\t1\n")  # too short: left out
    (tmp_path / "wsc-visit1-3-nsrr.allscore.txt").write_text("22:00:00.00\tSTART RECORDING\n22:00:00.00\tSTAGE - W\n22:01:00.00\tSTAGE - N2\n22:02:00.00\tend\n", encoding="latin-1")
    _, labels, epochs = ingested(spark, datasets.Wsc(str(tmp_path)), tmp_path / "out")
    assert labels == {0: [0, 1, 4], 2: [0, 0, 2, 2]}  # four whole epochs behind the padded one; the unscored third goes
    x = dsp.fir_bandpass(edf.samples(*both(tmp_path / "wsc-visit1-1-nsrr.edf", 0)), 100)
    assert np.allclose(epochs[0, 2, "EEG"], np.r_[np.zeros(2000), x].reshape(-1, 3000)[4], atol=1e-3)


def test_interval_recordings(spark, tmp_path):
    """Signals are cropped to where their scorings start, which is neither the recording's nor the file's beginning."""
    for kind, names, lines in (("pd", ("EEG C4-REF", "EOG LEFT", "EOG RIGHT", "EMG1"), "0\t30\tWake\n60\t60\tLIGHTS_OFF\n60\t90\tWake\n90\t120\tS2\n120\t150\tmovement\n150\t180\tREM\n180\t190\tWake\n"), ("ad", ("EEG C4-A1", "EEG C3-REF", "EOG LEFT", "EOG RIGHT", "EEG EOG1-REF", "EEG EOG2-REF", "EMG1"), "h\n" * 8 + "30\t60\tS1\n60\t90\tS3\n")):
        for record in ("r1", "r1_nap"):
            d = tmp_path / kind / record
            d.mkdir(parents=True)
            edf.write(str(d / "x.edf"), [(n, 200, wave(200, 200, k)) for k, n in enumerate(names)])
            (d / "x.tsv").write_text(lines)
    _, labels, epochs = ingested(spark, datasets.Parkinsons(str(tmp_path / "pd")), tmp_path / "out")
    assert labels == {0: [0, 2, 4]}
    x = edf.samples(*both(tmp_path / "pd" / "r1" / "x.edf", 0), 60, 180)
    assert np.allclose(epochs[0, 2, "EEG"], dsp.resample_rate(dsp.fir_bandpass(x, 200, taps=501), 200, 100)[9000:], atol=1e-3)
    _, labels, epochs = ingested(spark, datasets.Alzheimers(str(tmp_path / "ad")), tmp_path / "out2")
    assert labels == {0: [1, 3], 1: [1, 3]}
    x = edf.samples(*both(tmp_path / "ad" / "r1" / "x.edf", 1), 30, 90)  # not C4-A1, which this data set's list lacks
    assert np.allclose(epochs[0, 0, "EEG"], dsp.resample_rate(dsp.fir_bandpass(x, 200, taps=501), 200, 100)[:3000], atol=1e-3)
    d = tmp_path / "ic" / "Subj001" / "Night001"
    d.mkdir(parents=True)
    edf.write(str(d / "a.edf"), [(n, 100, wave(400, 100, k)) for k, n in enumerate(("EEG C4", "EEG A1", "EOG LIO", "EOG RSO", "EMG EMG CHIN"))])
    rows = [(100, 30, "N1"), (110, 5, "Arousal"), (130, 60, "N2"), (220, 60, "REM"), (280, 30, "N2")]  # a gap of an epoch before REM
    (d / "a.csv").write_text("Start time relative (total µs);Duration (total µs);Subtype\n" + "".join(f"{a * 10**6};{b * 10**6};{c}\n" for a, b, c in rows), encoding="utf-8")
    _, labels, epochs = ingested(spark, datasets.Intracranial(str(tmp_path / "ic")), tmp_path / "out3")
    assert labels == {0: [1, 2, 2, 4, 4, 2]} and len({k[1] for k in epochs}) == 6


def test_rodent_recordings(spark, tmp_path):
    for name, n in (("m1-EDF", 3), ("m1-EDFb", 2), ("m2-EDF", 4)):
        edf.write(str(tmp_path / f"{name}.edf"), [(c, 100, wave(4 * n, 100, k)) for k, c in enumerate(("EEG1", "EEG2", "EMG"))])
        (tmp_path / f"{name}.tsv").write_text("".join(f"p{i}\n" for i in range(9)) + "a\tb\tc\td\tstage\n" + "".join(f"x\tx\tx\tx\t{1 + i % 4}\n" for i in range(n)))
    _, labels, epochs = ingested(spark, datasets.Kornum(str(tmp_path)), tmp_path / "out")
    assert labels == {0: [0, 1, 2, 0, 1], 1: [0, 1, 2]} and epochs[0, 4, "EEG2"].shape == (400,)
    rat = tmp_path / "rat"
    rat.mkdir()
    edf.write(str(rat / "A1.edf"), [(c, 64, wave(16, 64, k)) for k, c in enumerate(("EEG EEG1A-B", "EEG EEG2A-B", "EMG EMG"))])
    (rat / "A1.csv").write_text("0,w,n\n1,n,n\n2,1,r\n3,r,r\n")
    for cohort in "BD":
        (rat / f"Cohort{cohort}").mkdir()
        (rat / f"Cohort{cohort}" / f"{cohort}1.edf").write_bytes((rat / "A1.edf").read_bytes())
    assert datasets.SleepyRat(str(rat)).extra == {"scorer": 2, "cohorts": ["A", "D"]}
    assert [r.record_id for r in datasets.SleepyRat(str(rat)).records(spark).orderBy("subject_id").collect()] == ["A1", "D1"]
    assert datasets.SleepyRat(str(rat), cohorts=["b"]).records(spark).where("record_id = 'B1'").count() == 1
    t, labels, epochs = ingested(spark, datasets.SleepyRat(str(rat), scorer=2, cohorts=()), tmp_path / "rat-out")
    assert labels == {0: [1, 1, 2, 2]} and epochs[0, 0, "EMG"].shape == (512,) and t.folds.first().split == "test"


def test_training_sequences_and_commands(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(10):
        edf.write(str(raw / f"r{i}.edf"), [(c, 100, wave(30 * (4 + i % 3), 100, i + k)) for k, c in enumerate(("EEG", "EOG(L)", "EOG(R)", "EMG"))])
        (raw / f"r{i}.xml").write_text(events([0, 1, 2, 5, 2, 1][: 4 + i % 3]))
    (tmp_path / "c.yaml").write_text(f"dataset: mesa\ndata_folder: {raw}\noutput: {tmp_path}/out\npreprocessors: [xsleepnet, 'tests.test_datasets:doubled']\nsource_kwargs: {{name: own}}\n")
    engine.main(["preprocess", "-c", str(tmp_path / "c.yaml")])
    t = engine.Tables(spark, f"{tmp_path}/out")
    data = engine.EpochDataset(t, ["own"], ["EEG", "EMG"], sequence_length=5)
    loaders = data.loaders()
    rows = loaders["train"].collect()
    assert len(rows) == sum(max(n - 5, 0) + 1 for n in (r.num_windows for r in t.subjects.join(t.folds.where("split = 'train'"), ["dataset", "subject_id"]).collect()))
    short = next(r for r in rows if r.stages[-1] == 5)
    assert len(short.x) == 5 and len(short.x[0]) == 2 and len(short.x[0][0]) == 3000
    stats = t.scaling.where("prep = 'raw' AND channel = 'EMG' AND pos = 7").first()
    assert np.isclose(short.x[-1][1][7], -stats["mean"] / stats["std"], atol=1e-6)
    assert all(len(r.stages) == len(r.x) for r in loaders["test"].collect()) and loaders["valid"].count() + loaders["test"].count() == 3
    two = engine.zipped("train", raw=data, spectra=engine.EpochDataset(t, ["own"], ["EEG", "EMG"], 5, "xsleepnet")).first()
    assert len(two.raw[0][0]) == 3000 and len(two.spectra[0][0]) == 29 * 129
    assert t.spectra_doubled.count() == t.epochs.count()
    engine.main(["compress", f"{tmp_path}/out", f"{tmp_path}/half", "--half", "own"])
    a = {(r.subject_id, r.epoch_idx, r.channel): r.samples for r in sinks.read_bundle(spark, f"{tmp_path}/half", "test").collect()}
    b = {(r.subject_id, r.epoch_idx, r.channel): r.samples for r in t.epochs.collect()}
    assert a and all(np.allclose(v, b[k], rtol=1e-3, atol=1e-2) for k, v in a.items())
    engine.compress(spark, f"{tmp_path}/out", f"{tmp_path}/whole", half=())
    assert sinks.read_bundle(spark, f"{tmp_path}/whole", "test").where("samples IS NULL").count() == 0
    with pytest.raises(KeyError):
        engine.main(["preprocess", "-d", "none"])


def doubled(c):
    return F.array(F.transform(c, lambda x: x * 2))
