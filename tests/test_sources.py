import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom import engine
from nightloom.sources import annotations as an
from nightloom.sources import edf
from nightloom.streaming import epochs as live


def by_path(df):
    return [r.stage for r in df.orderBy("epoch_idx").collect()]


def test_edf(spark, tmp_path):
    x = np.sin(np.arange(12000) / 7) * 50
    edf.write(str(tmp_path / "a.edf"), [("EEG", 100.0, x), ("EMG", 50.0, x[:6000])], [(0, 30, "Sleep stage W"), (30, 30, "Sleep stage N1"), (60, 30, "other")])
    heads = edf.read_headers(spark, str(tmp_path)).orderBy("signal").collect()
    assert [h.label for h in heads] == ["EEG", "EMG", edf.ANNOTATIONS] and heads[1].rate == 50
    got = edf.read_epochs(spark, str(tmp_path), ["EEG"]).orderBy("epoch_idx").collect()
    assert len(got) == 4 and np.abs(np.concatenate([r.samples for r in got]) - x).max() < 0.01
    notes = edf.read_annotations(spark, str(tmp_path))
    assert by_path(edf.epoch_stages(notes, {"Sleep stage W": 0, "Sleep stage N1": 1})) == [0, 1]
    data = (tmp_path / "a.edf").read_bytes()
    assert len(edf.samples(data, edf.header(data), 0, 10, 20)) == 1000


def test_scoring_files(spark, tmp_path):
    def put(name, text):
        d = tmp_path / name
        d.mkdir()
        (d / "r1.txt").write_text(text)
        return str(d)

    xml = "<A><ScoredEvents>" + "".join(f"<ScoredEvent><EventType>Stages|Stages</EventType><EventConcept>x|{s}</EventConcept><Start>{a}</Start><Duration>{n}</Duration></ScoredEvent>" for s, a, n in ((0, 0, 60), (2, 60, 30))) + "<ScoredEvent><EventType>Other</EventType></ScoredEvent></ScoredEvents></A>"
    assert by_path(an.nsrr_xml(spark, put("xml", xml))) == [0, 0, 2]
    assert by_path(an.rodent_tsv(spark, put("tsv", "h\n" * 10 + "a\tb\tc\td\t1\na\tb\tc\td\t3\na\tb\tc\td\t9\n"))) == [0, 2, 3]
    assert by_path(an.run_length_csv(spark, put("csv", "0,40,W\n40,20,N2\n60,10,REM\n"))) == [0, 2, 0]
    assert by_path(an.stage_txt(spark, put("stg", "Epoch\tUser-Defined Stage\n5\t0\n6\t5\n7\t7\n"))) == [0, 4, -1]
    log = "22:00:00.00\tSTART RECORDING\n22:01:00.00\tSTAGE - N1\n22:01:30.00\tSTAGE - W\n22:02:00.00\tend\n"
    assert by_path(an.event_log(spark, put("log", log))) == [-1, -1, 1, 0]
    assert by_path(an.rat_csv(spark, put("rat", "x,w,n\nx,r,w\nx,?,w\n"))) == [0, 2, 3]
    lines = put("iv", "0\t30\tWake\n30\t60\tLIGHTS_OFF\n60\t120\tS1\n120\t150\tREM\n150\t180\tWake\n")
    assert by_path(an.interval_tsv(spark, lines)) == [1, 4] and by_path(an.interval_tsv(spark, lines, epoch_s=30)) == [1, 1, 4]
    with pytest.raises(Exception, match="unknown stage"):
        an.interval_tsv(spark, lines, lights=False, strict=True).collect()
    us = "Subtype;Start time relative (total µs);Duration (total µs)\nW;0;60000000\nN2;90000000;30000000\n"
    assert by_path(an.interval_csv_us(spark, put("us", us), {"W": 0, "N2": 2})) == [0, 0, -1, 2]
    assert an.discover(spark, str(tmp_path), "*.txt").count() == 8


def test_run_length_counts_seconds_without_rows_for_them(spark):
    def plain(rows):
        """Second by second."""
        seen = {}
        for path, start, length, stage in rows:
            for second in range(start, start + length):
                seen.setdefault((path, int(second / 30)), []).append(stage)
        return {k: max(range(5), key=lambda c: (v.count(c) + max(30 - len(v), 0) * (c == 0), -c)) for k, v in seen.items()}

    rows = [("a", 0, 40, 0), ("a", 40, 20, 2), ("a", 60, 10, 4), ("a", 95, 300, 3), ("a", 100, 0, 1), ("b", -75, 50, 1), ("b", -40, 60, 2), ("b", 5, 14, 3), ("b", 90, 15, 2), ("b", 105, 15, 1), ("c", 0, 10, 4), ("c", 0, 30, 1), ("c", 0, 20, 4)]
    letters = ["W", "N1", "N2", "N3", "REM"]
    own = spark.createDataFrame([(p, i, f"{a}, {n},{letters[c]} ") for i, (p, a, n, c) in enumerate(rows)] + [("d", 0, "x,y,W"), ("d", 1, "0,30,?")], "path string, n int, line string")
    got = an.parse_run_length(own)
    assert {(r.path, r.epoch_idx): r.stage for r in got.collect()} == plain(rows) | {("d", 0): 0}
    assert "epoch_idx" in got.columns and got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    long = spark.createDataFrame([("e", 0, "0,2000000000,N2")], "path string, n int, line string")
    assert an.parse_run_length(long, 100_000_000).count() == 20


class Night(engine.DatasetSource):
    name = "made"

    def records(self, spark):
        return spark.createDataFrame([(i, f"r{i}") for i in range(10)], "subject_id int, record_id string")

    def read(self, spark, records):
        grid = records.select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("epoch_idx"))
        samples = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.sin(i * (F.col("epoch_idx") + 1) / 50).cast("float"))
        return grid.select("subject_id", "epoch_idx", F.lit("EEG").alias("channel"), samples.alias("samples")), grid.select("subject_id", "epoch_idx", (F.col("epoch_idx") % 5).alias("stage"))


def test_engine(spark, tmp_path):
    t = engine.ingest(spark, Night(), str(tmp_path / "t"), ["xsleepnet_mouse"])
    assert t.spectra_xsleepnet_mouse.select(F.size("spec"), F.size(F.get("spec", F.lit(0)))).first() == (17, 129)
    data = engine.EpochDataset(t, ["made"])
    assert data.folds() == 1
    n = {s: data.sequences(s).count() for s in ("train", "valid", "test")}
    assert n == {"train": 7 * 5, "test": 5, "valid": 10}
    assert data.nights("test").first().stages == [i % 5 for i in range(25)]
    z = data.signal("train").select(F.explode("samples").alias("z")).agg(F.count("z")).first()[0]
    assert z > 0
    assert engine.load_model(spark, "chambon2018", 21, 3) == "chambon2018-l21-c3"
    with pytest.raises(KeyError):
        engine.load_model(spark, "none", 21, 3)


def test_streaming(spark, tmp_path):
    rows = spark.sql("SELECT cast(1 AS int) AS subject_id, timestamp_seconds(id * 10) AS ts, cast(id AS double) AS value FROM range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.tumbling(live.timed(stream), "subject_id", "value").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("tumbled").orderBy("start").collect()
    assert [(r.n, r["mean"]) for r in got] == [(3, 1.0), (3, 4.0), (3, 7.0), (3, 10.0)]
    assert live.sessions(rows, "subject_id", "15 seconds").first().n == 12
