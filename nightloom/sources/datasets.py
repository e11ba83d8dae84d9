"""Data sets that can be ingested: where their recordings and scorings lie, which channels they have, how a night's signals are
filtered and cut, and how its labels are cleaned. Each file is one task's work; everything between files is DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nightloom.engine import DatasetSource
from nightloom.functions import dsp
from nightloom.operators import hypnogram, records
from nightloom.sources import annotations, edf, edf_files

Candidate = str | tuple[str, str]

# The names that sleep laboratories give their channels, in order of preference; a pair is a difference.
EEG: tuple[Candidate, ...] = ("EEG(sec)", "EEG", "EEG1", ("C4", "M1"), ("C4", "A1"), "C4-M1", "C4-A1", "C4M1", "C4A1")
EOG: tuple[Candidate, ...] = (("EOG(L)", "EOG(R)"), ("EOGL", "EOGR"), ("EOG-L", "EOG-R"), ("E1", "E2"), ("E1-M2", "E2-M1"), ("LOC", "ROC"), ("E-1", "E-2"), ("L-EOG", "R-EOG"), "E1-E2", ("E2-M1", "E2-M1"))
EMG: tuple[Candidate, ...] = (
    "EMG", ("LCHIN", "CCHIN"), ("LCHIN", "RCHIN"), ("L CHIN", "R CHIN"), ("L CHIN", "C CHIN"), ("CHIN1", "CHIN2"), "CHIN", "CHIN EMG", "EMG CHIN", "CHIN1-CHIN2", "LCHIN-CCHIN",
    ("EMG3", "EMG1"), ("EMG3", "EMG2"), "EMG3-EMG1", "EMG3-EMG2", "EMG1-EMG3", ("L-LEGS", "R-LEGS"),
)
RODENT_EEG1, RODENT_EEG2, RODENT_EMG = ("EEG", "EEG1", "EEG EEG1A-B"), ("EEG2", "EEG EEG2A-B"), ("EMG", "EMG EMG")
INTERVAL_EEG = ("EEG C4-A1", "EEG C4-REF", "EEG C3-A2", "EEG C3-REF")
INTERVAL_EOG = (("EOG LEFT", "EOG RIGHT"), ("EOG2", "EOG1"), ("EEG EOG1-REF", "EEG EOG2-REF"))
INTERVAL_EMG = ("EMG CHIN", "EMG1", "EMG2", "EMG3", "EMG4", "EMG5")
INTERVAL_EEG_REF, INTERVAL_EOG_REF = ("EEG C4-REF", "EEG C3-REF"), (("EEG EOG1-REF", "EEG EOG2-REF"),)
DEPTH_EEG = (("EEG C4", "EEG A1"), ("EEG C4", "EEG A2"), ("EEG OPPEEG-C4", "EEG OPPEEG-A1"))
DEPTH_EOG = (("EOG LIO", "EOG RSO"), ("EOG OPPEEG-LIO", "EOG OPPEEG-RSO"))
DEPTH_EMG = ("EMG EMG CHIN", "EMG OPPEEG-EMG C")
SUBTYPES = {"Wake": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 4}
HMC_STAGES = {"Sleep stage W": 0, "Sleep stage N1": 1, "Sleep stage N2": 2, "Sleep stage N3": 3, "Sleep stage R": 4}
EDF_STAGES = {"Sleep stage W": 0, "Sleep stage 1": 1, "Sleep stage 2": 2, "Sleep stage 3": 3, "Sleep stage 4": 3, "Sleep stage R": 4}


@dataclass(frozen=True)
class Channel:
    """A channel of the result: the first candidate that a file has. ``sign`` is that of a pair's second signal; ``low`` starts
    the pass band, ``high`` ends it (none: a high-pass)."""

    name: str
    candidates: tuple[Candidate, ...]
    low: float = 0.3
    high: float | None = 40.0
    sign: int = -1
    any_case: bool = True

    def read(self, file: edf_files.EdfFile, start_s: float = 0.0, stop_s: float | None = None) -> tuple[np.ndarray, float] | None:
        """The signal, from start to stop, and its rate; none where the file has no candidate. No other channel is read."""
        labels = [s["label"] for s in file.head["signals"]]
        known = [x.upper() for x in labels] if self.any_case else labels
        for candidate in self.candidates:
            names = [candidate] if isinstance(candidate, str) else [*candidate]
            names = [x.upper() for x in names] if self.any_case else names
            if all(x in known for x in names):
                at = [known.index(x) for x in names]
                parts = [file.samples(k, start_s, stop_s) for k in at]
                return (parts[0] if len(parts) == 1 else parts[0] + self.sign * parts[1]), file.head["signals"][at[0]]["rate"]
        return None


@dataclass
class Recordings(DatasetSource):
    """EDF files below a folder with scorings of their own. Subclasses say what differs."""

    folder: str
    name: str = "recordings"
    channels: tuple[Channel, ...] = (Channel("EEG", EEG), Channel("EOG", EOG), Channel("EMG", EMG, 10.0, None))
    epoch_s: int = 30
    rate: int = 100
    taps: int = 101
    glob: str = "*.edf"
    contains: str = ""
    clinical: str | None = None
    clinical_key: str = "nsrrid"
    scorings_glob: str = "*.xml"
    extra: dict = field(default_factory=dict)

    def records(self, spark: SparkSession) -> DataFrame:
        """subject_id, record_id and path, in the order of the paths. One row a record."""
        own = annotations.discover(spark, self.folder, self.glob, self.contains).where(self.wanted())
        own = own.select("path", self.key("path").alias("record_id"))
        ids = own.groupBy("record_id").agg(F.min("path").alias("_first"))
        return annotations.numbered(ids, "_first", "record_id").join(own, "record_id").select("subject_id", "record_id", "path")

    def wanted(self):
        return F.lit(True)

    def key(self, path: str):
        """What a recording and its scoring share: the file's name without endings."""
        return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(-nsrr)?(\.\w+)+$", "")

    def scorings(self, spark: SparkSession) -> DataFrame:
        """(path, epoch_idx, stage)."""
        return annotations.nsrr_xml(spark, annotations.Files(self.folder, self.scorings_glob))

    def spans(self, spark: SparkSession) -> DataFrame | None:
        """(path, start_s, end_s) of the scored part, where scorings do not start with the recording."""
        return None

    def clean(self, labels: DataFrame) -> DataFrame:
        """Labels (subject_id, epoch_idx, stage, source) to those that stay, numbered anew; source is the epoch of the signal."""
        return labels

    def cut(self, signals: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
        """Epochs (n, width) of each channel from its whole signal: filtered, at the common rate, cut from the start. The
        filters of all bands are those of the first channel's rate."""
        width, out = self.epoch_s * self.rate, []
        for c, (x, own) in zip(self.channels, signals, strict=True):
            x = dsp.fir_highpass(x, own, c.low, self.taps) if c.high is None else dsp.fir_bandpass(x, signals[0][1], c.low, c.high, self.taps)
            x = x if own == self.rate else dsp.resample_rate(x, own, self.rate)
            out.append(x[: len(x) // width * width].reshape(-1, width))
        return out

    def signals(self, spark: SparkSession, found: DataFrame) -> DataFrame:
        """(subject_id, path, epoch_idx, channel, samples). A file without all channels leaves no rows."""
        me, names, ranged = self, [c.name for c in self.channels], edf_files.readable(self.folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for subject, path, data, start, stop in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                    file = edf_files.EdfFile.of(data) if data is not None else edf_files.EdfFile.open(path)
                    signals = [c.read(file, start or 0.0, stop) for c in me.channels]
                    if any(s is None for s in signals):
                        continue
                    parts = me.cut(signals)
                    n = min(len(p) for p in parts)
                    for channel, p in zip(names, parts, strict=True):
                        p = np.ascontiguousarray(p[:n], dtype=np.float32)
                        arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.shape[1], pa.int32()), pa.array(p.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array([subject] * n, pa.int32()), pa.array([path] * n), pa.array(np.arange(n), pa.int32()), pa.array([channel] * n), arrays], names=["subject_id", "path", "epoch_idx", "channel", "samples"])

        few = found.select("subject_id", F.col("path").alias("_p"), self.key("path").alias("_k"))  # one row a file
        if (spans := self.spans(spark)) is not None:
            few = few.join(spans.select(self.key("path").alias("_k"), "start_s", "end_s"), "_k")
        else:
            few = few.withColumns({"start_s": F.lit(0.0), "end_s": F.lit(None).cast("double")})
        if ranged:  # a task opens its files itself and reads the channels' bytes; as many tasks as files, but at most some thousands
            own = few.withColumn("content", F.lit(None).cast("binary")).withColumnRenamed("_p", "path").repartition(max(1, min(found.count(), 4096)), "path")
        else:
            own = edf.files(spark, self.folder, self.glob).join(few, F.col("path") == F.col("_p"))
        own = own.select(F.col("subject_id").cast("int").alias("subject_id"), "path", "content", "start_s", "end_s")
        return own.mapInArrow(run, "subject_id int, path string, epoch_idx int, channel string, samples array<float>")

    def read(self, spark: SparkSession, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        epochs = self.staged(self.signals(spark, found))
        own = self.scorings(spark).withColumn("record_id", self.key("path")).drop("path")
        labels = own.join(found.select("record_id", F.col("subject_id").cast("int").alias("subject_id")), "record_id").select("subject_id", F.col("epoch_idx").cast("int").alias("epoch_idx"), "stage")
        labels = self.matched(labels, epochs).withColumn("source", F.col("epoch_idx"))
        kept = self.clean(labels)
        moved = epochs.drop("path").join(kept.select("subject_id", F.col("source").alias("epoch_idx"), F.col("epoch_idx").alias("_to")), ["subject_id", "epoch_idx"])
        return moved.select("subject_id", F.col("_to").cast("int").alias("epoch_idx"), "channel", "samples"), kept.select("subject_id", F.col("epoch_idx").cast("int").alias("epoch_idx"), "stage")

    def matched(self, labels: DataFrame, epochs: DataFrame) -> DataFrame:
        """Labels whose epoch the signal has: both are cut to the shorter one."""
        return labels.join(epochs.select("subject_id", "epoch_idx").distinct(), ["subject_id", "epoch_idx"], "left_semi")

    def customise(self, subjects: DataFrame) -> DataFrame:
        """Joins the clinical table, where one is given, by the digits or name that end the record's id."""
        if self.clinical is None:
            return subjects
        own = annotations.clinical(subjects.sparkSession, self.clinical)
        key = F.lower(F.element_at(F.split("record_id", "-"), -1))
        own = own.withColumn("_key", F.lower(F.col(self.clinical_key).cast("string"))).drop(*[c for c in subjects.columns if c in own.columns])
        return subjects.join(own.dropDuplicates(["_key"]), key == F.col("_key"), "left").drop("_key")


def _plain(kept: DataFrame) -> DataFrame:
    return kept.select("subject_id", "epoch_idx", "stage", "source")


class Nsrr(Recordings):
    """Recordings with XML events: invalid epochs go, surplus wake is trimmed, and stages of the older rules become five."""

    def clean(self, labels: DataFrame) -> DataFrame:
        own = _plain(hypnogram.drop_invalid(labels, 0, 5))
        own = _plain(hypnogram.trim_wake(own, classes=6))
        return own.withColumn("stage", hypnogram.recode(F.col("stage"), hypnogram.RK_TO_FIVE))


class Shhs(Nsrr):
    """Visit one, below polysomnography/edfs and annotations-events-nsrr."""

    def __init__(self, folder: str, **kw):
        super().__init__(folder, **{"name": "shhs", "contains": "shhs1-"} | kw)


class Mros(Nsrr):
    def __init__(self, folder: str, **kw):
        super().__init__(folder, **{"name": "mros", "contains": "mros-visit1-"} | kw)


class Mesa(Nsrr):
    def __init__(self, folder: str, **kw):
        super().__init__(folder, **{"name": "mesa"} | kw)


class Hmc(Recordings):
    """Scorings are EDF+ files beside the recordings; each epoch is resampled, then filtered for itself."""

    def __init__(self, folder: str, **kw):
        exact = lambda name, *c, sign=-1: Channel(name, c, any_case=False, sign=sign)
        channels = (exact("EEG", "EEG C3-M2"), exact("EOG", ("EOG E1-M2", "EOG E2-M2"), sign=1), exact("EMG", "EMG chin"), exact("ECG", "ECG"))
        super().__init__(folder, **{"name": "hmc", "channels": channels} | kw)

    def wanted(self):
        return ~F.col("path").endswith("_sleepscoring.edf")

    def key(self, path: str):
        return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(_sleepscoring)?\.edf$", "")

    def scorings(self, spark: SparkSession) -> DataFrame:
        return edf.epoch_stages(edf.read_annotations(spark, self.folder, "*_sleepscoring.edf"), HMC_STAGES)

    def cut(self, signals: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
        out = []
        for c, (x, own) in zip(self.channels, signals, strict=True):
            width = int(self.epoch_s * own)
            whole = x[: len(x) // width * width].reshape(-1, width)
            out.append(dsp.bandpass(dsp.resample(whole, self.epoch_s * self.rate), c.low, c.high, self.rate))
        return out


class Dcsm(Recordings):
    """A folder for each record with psg.edf and hypnogram.ids; epochs are filtered at the nominal rate before they are resampled."""

    def __init__(self, folder: str, **kw):
        exact = lambda name, *c, sign=-1: Channel(name, c, any_case=False, sign=sign)
        channels = (exact("EEG", "C3-M2", "C4-M1"), exact("EOG", ("E1-M2", "E2-M2"), sign=1), exact("EMG", "CHIN"), exact("ECG", "ECG-II"))
        super().__init__(folder, **{"name": "dcsm", "channels": channels, "glob": "psg.edf"} | kw)

    def key(self, path: str):
        return F.element_at(F.split(path, "/"), -2)

    def scorings(self, spark: SparkSession) -> DataFrame:
        return annotations.run_length_csv(spark, annotations.Files(self.folder, "hypnogram.ids"), self.epoch_s)

    def cut(self, signals: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
        out = []
        for c, (x, own) in zip(self.channels, signals, strict=True):
            width = int(self.epoch_s * own)
            whole = x[: len(x) // width * width].reshape(-1, width)
            out.append(dsp.resample(dsp.bandpass(whole, c.low, c.high, self.rate), self.epoch_s * self.rate))
        return out


class SleepEdf(Recordings):
    """Recordings (-PSG) and annotations (-Hypnogram) of cassettes; both nights of a person are one record. Wake is cropped to
    thirty minutes before the first and after the last sleep; amplitudes are in millionths."""

    def __init__(self, folder: str, crop_min: int = 30, **kw):
        exact = lambda name, *c: Channel(name, c, any_case=False)
        channels = (exact("EEG", "EEG Fpz-Cz", "Fpz-Cz"), exact("EOG", "EOG horizontal"), exact("EMG", "EMG submental"))
        super().__init__(folder, **{"name": "sleepedf", "channels": channels, "glob": "*-PSG.edf", "extra": {"crop_min": crop_min}} | kw)

    def key(self, path: str):
        """Cassette and person; the next digit is the night."""
        return F.substring(F.element_at(F.split(path, "/"), -1), 1, 5)

    def _night(self, path: str):
        return F.substring(F.element_at(F.split(path, "/"), -1), 1, 6)

    def read(self, spark: SparkSession, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        epochs = self.signals(spark, found).withColumn("night", self._night("path"))
        notes = edf.read_annotations(spark, self.folder, "*-Hypnogram.edf").withColumn("night", self._night("path"))
        own = notes.withColumn("stage", hypnogram.recode(F.col("code"), EDF_STAGES)).where("stage IS NOT NULL")
        own = own.select("night", "stage", F.round(F.col("onset_s") / self.epoch_s).cast("int").alias("first"), F.round(F.col("duration_s") / self.epoch_s).cast("int").alias("len"))
        labels = hypnogram.expand_intervals(own, "first", "len").select("night", "epoch_idx", "stage")
        labels = labels.join(epochs.select("night", "epoch_idx", "subject_id").distinct(), ["night", "epoch_idx"])
        kept = records.crop_wake(labels, int(self.extra["crop_min"] * 60 // self.epoch_s), ["night"])
        kept = records.concatenated(kept, ["subject_id"], "night", F.col("epoch_idx")).select("subject_id", "night", "epoch_idx", F.col("epoch_idx_all").cast("int").alias("_to"), "stage")
        moved = epochs.join(kept.select("night", "epoch_idx", "_to"), ["night", "epoch_idx"])
        return moved.select("subject_id", F.col("_to").alias("epoch_idx"), "channel", F.transform("samples", lambda x: (x * 1e6).cast("float")).alias("samples")), kept.select("subject_id", F.col("_to").alias("epoch_idx"), "stage")


class Wsc(Recordings):
    """Scorings are event logs or, for records without one, stage lists. Signals are padded in front to whole epochs, of which the
    first goes. A record whose labels are not as many as its epochs, or one more, is left out; so are unscored epochs."""

    def __init__(self, folder: str, visit: int = 1, **kw):
        channels = (
            Channel("EEG", ("C3_M2", "C3_M1", "C4_M1", "Fz_AVG", "C3_AVG"), any_case=False), Channel("EOG", (("E1", "E2"),), any_case=False),
            Channel("EMG", ("chin", "cchin_l", "cchin_r", "rchin_l"), 10.0, None, any_case=False),
        )
        super().__init__(folder, **{"name": "wsc", "channels": channels, "contains": f"visit{visit}"} | kw)

    def key(self, path: str):
        return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(edf|stg\.txt|allscore\.txt)$", "")

    def scorings(self, spark: SparkSession) -> DataFrame:
        logs = annotations.event_log(spark, annotations.Files(self.folder, "*.allscore.txt"), self.epoch_s)
        lists = annotations.stage_txt(spark, annotations.Files(self.folder, "*.stg.txt"))
        named = logs.select(self.key("path").alias("_key")).distinct()
        return logs.unionByName(lists.withColumn("_key", self.key("path")).join(named, "_key", "left_anti").select(*logs.columns))

    def cut(self, signals: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
        width, out = self.epoch_s * self.rate, []
        for c, (x, own) in zip(self.channels, signals, strict=True):
            x = dsp.fir_highpass(x, own, c.low, self.taps) if c.high is None else dsp.fir_bandpass(x, signals[0][1], c.low, c.high, self.taps)
            x = x if own == self.rate else dsp.resample_rate(x, own, self.rate)
            out.append(np.r_[np.zeros(-len(x) % width), x].reshape(-1, width)[1:])
        return out

    def matched(self, labels: DataFrame, epochs: DataFrame) -> DataFrame:
        return hypnogram.tolerate_one_extra(epochs, labels)

    def clean(self, labels: DataFrame) -> DataFrame:
        return _plain(hypnogram.drop_invalid(labels, 0, 4))


class Kornum(Recordings):
    """Mice: epochs of four seconds, a scoring table for each recording; all recordings of an animal are one record. Artefacts go."""

    def __init__(self, folder: str, **kw):
        channels = (Channel("EEG1", RODENT_EEG1), Channel("EEG2", RODENT_EEG2), Channel("EMG", RODENT_EMG, 10.0, None))
        super().__init__(folder, **{"name": "kornum", "channels": channels, "epoch_s": 4} | kw)

    def key(self, path: str):
        return F.upper(F.element_at(F.split(F.element_at(F.split(path, "/"), -1), "-"), 1))

    def _file(self, path: str):
        return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.\w+$", "")

    def read(self, spark: SparkSession, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        epochs = self.signals(spark, found).withColumn("file", self._file("path"))
        labels = annotations.rodent_tsv(spark, annotations.Files(self.folder, "*.tsv")).withColumn("file", self._file("path")).select("file", "epoch_idx", "stage")
        labels = labels.join(epochs.select("file", "epoch_idx", "subject_id").distinct(), ["file", "epoch_idx"]).where(F.col("stage").between(0, 2))
        kept = records.concatenated(labels, ["subject_id"], "file", F.col("epoch_idx")).select("subject_id", "file", "epoch_idx", F.col("epoch_idx_all").cast("int").alias("_to"), "stage")
        moved = epochs.join(kept.select("file", "epoch_idx", "_to"), ["file", "epoch_idx"])
        return moved.select("subject_id", F.col("_to").alias("epoch_idx"), "channel", "samples"), kept.select("subject_id", F.col("_to").alias("epoch_idx"), "stage")


class SleepyRat(Recordings):
    """Rats: epochs of four seconds at 128 Hz, a table of two scorers' letters for each recording; all records test. Recordings lie
    below folders Cohort<letter>; by default only the healthy cohorts are taken. Those below no such folder are."""

    def __init__(self, folder: str, scorer: int = 2, cohorts: Sequence[str] = ("A", "D"), **kw):
        channels = (Channel("EEG1", RODENT_EEG1), Channel("EEG2", RODENT_EEG2), Channel("EMG", RODENT_EMG, 10.0, None))
        super().__init__(folder, **{"name": "sleepyrat", "channels": channels, "epoch_s": 4, "rate": 128, "extra": {"scorer": scorer, "cohorts": [c.upper() for c in cohorts]}} | kw)

    def wanted(self):
        cohort = F.regexp_extract("path", r"/Cohort([^/]+)/", 1)
        return (cohort == "") | F.upper(cohort).isin(self.extra["cohorts"])

    def scorings(self, spark: SparkSession) -> DataFrame:
        return annotations.rat_csv(spark, annotations.Files(self.folder, "*.csv"), self.extra["scorer"])

    def clean(self, labels: DataFrame) -> DataFrame:
        return _plain(hypnogram.drop_invalid(labels, 0, 2))

    def folds(self, subjects: DataFrame) -> DataFrame:
        return subjects.select("subject_id", F.lit(0).alias("fold"), F.lit("test").alias("split"))


class Parkinsons(Recordings):
    """A folder for each record, with intervals that start behind lights-off; the signal is cropped to them. Unscored epochs go."""

    def __init__(self, folder: str, **kw):
        channels = (Channel("EEG", INTERVAL_EEG), Channel("EOG", INTERVAL_EOG), Channel("EMG", INTERVAL_EMG, 10.0, None))
        super().__init__(folder, **{"name": "parkinsons", "channels": channels, "taps": 501, "scorings_glob": "*.tsv"} | kw)

    def key(self, path: str):
        return F.element_at(F.split(path, "/"), -2)

    def wanted(self):
        return ~self.key("path").endswith("_nap")

    def _lines(self, spark: SparkSession) -> DataFrame:
        return annotations.lines(annotations.texts(spark, annotations.Files(self.folder, self.scorings_glob)))

    def scorings(self, spark: SparkSession) -> DataFrame:
        return annotations.parse_intervals(self._lines(spark))

    def spans(self, spark: SparkSession) -> DataFrame:
        return annotations.scored_span(self._lines(spark))

    def clean(self, labels: DataFrame) -> DataFrame:
        return _plain(hypnogram.drop_invalid(labels, 0, 5))


class Alzheimers(Parkinsons):
    """The same with eight lines before the intervals, no lights-off, and no unknown labels."""

    def __init__(self, folder: str, **kw):
        channels = (Channel("EEG", INTERVAL_EEG_REF), Channel("EOG", INTERVAL_EOG_REF), Channel("EMG", INTERVAL_EMG, 10.0, None))
        super().__init__(folder, **{"name": "alzheimers", "channels": channels} | kw)

    def wanted(self):
        return F.lit(True)

    def scorings(self, spark: SparkSession) -> DataFrame:
        return annotations.parse_intervals(self._lines(spark), 8, False, True)

    def spans(self, spark: SparkSession) -> DataFrame:
        return annotations.scored_span(self._lines(spark), 8, False)

    def clean(self, labels: DataFrame) -> DataFrame:
        return labels


class Intracranial(Recordings):
    """A folder for each person and night, with intervals in millionths of a second; invalid epochs go and surplus wake is trimmed."""

    def __init__(self, folder: str, **kw):
        channels = (Channel("EEG", DEPTH_EEG), Channel("EOG", DEPTH_EOG), Channel("EMG", DEPTH_EMG, 10.0, None))
        super().__init__(folder, **{"name": "intracranial", "channels": channels, "taps": 501, "scorings_glob": "*.csv"} | kw)

    def key(self, path: str):
        parts = F.split(path, "/")
        return F.concat_ws("_", F.element_at(parts, -3), F.element_at(parts, -2))

    def scorings(self, spark: SparkSession) -> DataFrame:
        own = annotations.intervals_us(spark, annotations.Files(self.folder, self.scorings_glob), SUBTYPES)
        own = own.withColumn("onset_s", F.col("onset_s") - F.min("onset_s").over(W.partitionBy("path")))  # the signal is cropped likewise
        return hypnogram.fill_gaps(own, ["path"], self.epoch_s)

    def spans(self, spark: SparkSession) -> DataFrame:
        own = annotations.intervals_us(spark, annotations.Files(self.folder, self.scorings_glob), SUBTYPES)
        return own.groupBy("path").agg(F.min("onset_s").alias("start_s"), F.max_by(F.col("onset_s") + F.col("duration_s"), "onset_s").alias("end_s"))

    def clean(self, labels: DataFrame) -> DataFrame:
        return _plain(hypnogram.trim_wake(_plain(hypnogram.drop_invalid(labels, 0, 4)), classes=5))


#: The sources that the preprocess command knows by name.
SOURCES: dict[str, type[DatasetSource]] = {"shhs": Shhs, "mros": Mros, "mesa": Mesa, "hmc": Hmc, "dcsm": Dcsm, "sleepedf": SleepEdf, "wsc": Wsc, "kornum": Kornum, "sleepyrat": SleepyRat, "parkinsons": Parkinsons, "alzheimers": Alzheimers, "intracranial": Intracranial}
