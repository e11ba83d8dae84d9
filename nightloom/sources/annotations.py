"""Readers of scoring files, each to (path, epoch_idx, stage) or to intervals. Plain Spark readers and expressions.

A reader is a file scan and a parser of its own (``parse_...``): of whole texts (path, text), of lines, or of events. Where a
path is asked for, ``Files`` names the files below a folder that match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nightloom.operators import hypnogram

# Codes of the formats.
TXT_STAGES = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: -1, 7: -1}
LOG_STAGES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "R": 4, "NO STAGE": -1, "MVT": -1}
INTERVAL_STAGES = {"Wake": 0, "S1": 1, "S2": 2, "S3": 3, "REM": 4}


@dataclass(frozen=True)
class Files:
    """Files below a folder whose names match."""

    folder: str
    glob: str


def _load(reader, where: str | Files) -> DataFrame:
    if isinstance(where, Files):
        reader, where = reader.option("pathGlobFilter", where.glob), where.folder
    return reader.option("recursiveFileLookup", "true").load(where)


def _path() -> Column:
    return F.col("_metadata.file_path")


def texts(spark: SparkSession, where: str | Files, encoding: str = "UTF-8") -> DataFrame:
    """(path, text): whole files. A scoring file is one row, cut up afterwards."""
    return _load(spark.read.format("binaryFile"), where).select("path", F.decode("content", encoding).alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(path, n, line): lines of each text that are not empty, numbered from 0 with those that are."""
    text = F.regexp_replace("text", "\r\n", "\n")
    return files.select("path", F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.length("line") > 0)


def nsrr_xml(spark: SparkSession, path: str | Files, epoch_s: int = 30) -> DataFrame:
    """Stages of ScoredEvent elements of type "Stages|Stages": the number behind the last bar, once for each epoch."""
    own = _load(spark.read.format("xml").option("rowTag", "ScoredEvent").schema("EventType string, EventConcept string, Start double, Duration double"), path)
    return parse_events(own.select(_path().alias("path"), "EventType", "EventConcept", "Start", "Duration"), epoch_s)


def parse_events(events: DataFrame, epoch_s: int = 30) -> DataFrame:
    """Fails where a stage does not last whole epochs, or where the end of the last stage is not that of the last epoch."""
    own = events.where(F.col("EventType") == "Stages|Stages").withColumn("stage", F.element_at(F.split("EventConcept", r"\|"), -1).cast("int"))
    w = W.partitionBy("path")
    whole = F.col("Duration") % epoch_s == 0
    ends = F.max(F.col("Start") + F.col("Duration")).over(w) == F.sum("Duration").over(w)
    first = F.when(~whole, F.raise_error(F.lit("a stage does not last whole epochs")).cast("int")).when(~ends, F.raise_error(F.lit("the epochs do not end with the last event")).cast("int")).otherwise((F.col("Start") / epoch_s).cast("int"))
    own = own.select("path", "stage", first.alias("first"), (F.col("Duration") / epoch_s).cast("int").alias("n"))
    return hypnogram.expand_intervals(own, "first", "n").select("path", "epoch_idx", "stage")


def rodent_tsv(spark: SparkSession, path: str | Files, skip: int = 10, column: int = 4) -> DataFrame:
    """Stage codes in a column of a tab-separated file behind a preamble of nine lines and a header; unknown codes are 3."""
    return parse_rodent(lines(texts(spark, path)), skip, column)


def parse_rodent(own: DataFrame, skip: int = 10, column: int = 4) -> DataFrame:
    code = F.try_element_at(F.split("line", "\t"), F.lit(column + 1)).try_cast("int")
    stage = hypnogram.recode(code, hypnogram.RODENT_CODES, 3)
    return own.where(F.col("n") >= skip).select("path", (F.row_number().over(W.partitionBy("path").orderBy("n")) - 1).alias("epoch_idx"), stage.alias("stage"))


def run_length_csv(spark: SparkSession, path: str | Files, epoch_s: int = 30) -> DataFrame:
    """start, length, stage in seconds without a header: the most frequent stage of each epoch, wake where none is given."""
    return parse_run_length(lines(texts(spark, path)), epoch_s)


def parse_run_length(own: DataFrame, epoch_s: int = 30) -> DataFrame:
    cells = F.split("line", ",")
    own = own.select("path", F.trim(F.get(cells, F.lit(0))).try_cast("int").alias("start"), F.trim(F.get(cells, F.lit(1))).try_cast("int").alias("length"), hypnogram.recode(F.trim(F.get(cells, F.lit(2))), hypnogram.LETTERS, 0).alias("stage"))
    # An interval's seconds in an epoch are counted, not expanded. ``div`` cuts towards 0, so epoch 0 begins behind -epoch_s.
    last = F.col("start") + F.col("length") - 1
    touched = own.where(F.col("length") > 0).withColumn("_last", last)
    touched = touched.withColumn("epoch_idx", F.explode(F.sequence(F.expr(f"start div {epoch_s}"), F.expr(f"_last div {epoch_s}"))))
    low = F.col("epoch_idx") * epoch_s - F.when(F.col("epoch_idx") > 0, 0).otherwise(epoch_s - 1)
    high = F.col("epoch_idx") * epoch_s + F.when(F.col("epoch_idx") < 0, 0).otherwise(epoch_s - 1)
    n = F.least("_last", high) - F.greatest("start", low) + 1
    stages = sorted({0, *hypnogram.LETTERS.values()})
    counts = touched.groupBy("path", "epoch_idx").agg(*[F.coalesce(F.sum(F.when(F.col("stage") == c, n)), F.lit(0)).alias(f"_{c}") for c in stages])
    missing = F.greatest(F.lit(epoch_s) - sum((F.col(f"_{c}") for c in stages[1:]), F.col("_0")), F.lit(0))
    best = F.greatest(*[F.struct((F.col(f"_{c}") + (missing if c == 0 else 0)).alias("n"), F.lit(-c).alias("rank")) for c in stages])
    return counts.select("path", "epoch_idx", (-best["rank"]).cast("int").alias("stage"))


def stage_txt(spark: SparkSession, path: str | Files) -> DataFrame:
    """epoch, stage code lines, perhaps under a header; epochs are counted from the first."""
    return parse_stages(lines(texts(spark, path)))


def parse_stages(own: DataFrame) -> DataFrame:
    own = own.withColumn("cells", F.split("line", r"\t"))
    own = own.select("path", F.get("cells", F.lit(0)).try_cast("int").alias("epoch"), F.get("cells", F.lit(1)).try_cast("int").alias("code")).where("epoch IS NOT NULL")
    first = F.min("epoch").over(W.partitionBy("path"))
    return own.select("path", (F.col("epoch") - first).alias("epoch_idx"), hypnogram.recode(F.col("code"), TXT_STAGES, -1).alias("stage"))


def _seconds(text: Column) -> Column:
    part = lambda i: F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def event_log(spark: SparkSession, path: str | Files, epoch_s: float = 30.0, encoding: str = "ISO-8859-1") -> DataFrame:
    """Stages from the change points of an event log, from START RECORDING to its last line; times up to noon are of the
    next day. Epochs before the first stage are unscored (-1)."""
    return parse_log(lines(texts(spark, path, encoding)), epoch_s)


def parse_log(own: DataFrame, epoch_s: float = 30.0) -> DataFrame:
    own = own.select("path", "n", F.split("line", "\t").alias("c"))
    own = own.select("path", "n", _seconds(F.trim(F.get("c", F.lit(0)))).alias("s"), F.trim(F.get("c", F.lit(1))).alias("text")).where("s IS NOT NULL")
    own = own.withColumn("s", F.when(F.col("s") < 13 * 3600, F.col("s") + 86400).otherwise(F.col("s")))
    w = W.partitionBy("path")
    start = F.min(F.when(F.col("text").contains("START RECORDING"), F.col("s"))).over(w)
    own = own.withColumn("start", start).withColumn("end", F.max("s").over(w)).where("s >= start")
    marks = own.where(F.col("text").contains("START RECORDING") | F.col("text").startswith("STAGE - "))
    code = F.trim(F.regexp_replace("text", "^STAGE - ", ""))
    marks = marks.withColumn("stage", hypnogram.recode(code, LOG_STAGES, -1)).withColumn("next", F.lead("s").over(w.orderBy("s", "n")))
    marks = marks.select("path", "s", "n", "stage", F.floor((F.coalesce("next", "end") - F.col("s")) / epoch_s).cast("int").alias("len"))
    before = F.coalesce(F.sum("len").over(w.orderBy("s", "n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return hypnogram.expand_intervals(marks.withColumn("first", before), "first", "len").select("path", "epoch_idx", "stage")


def rat_csv(spark: SparkSession, path: str | Files, scorer: int = 1) -> DataFrame:
    """Letters of one of two scorers, one epoch a line; others are 3."""
    return parse_letters(lines(texts(spark, path)), scorer)


def parse_letters(own: DataFrame, scorer: int = 1) -> DataFrame:
    letter = F.trim(F.get(F.split("line", ","), F.lit(scorer)))
    return own.select("path", F.col("n").alias("epoch_idx"), hypnogram.recode(letter, hypnogram.RAT_LETTERS, 3).alias("stage"))


def interval_tsv(spark: SparkSession, path: str | Files, skip: int = 0, lights: bool = True, strict: bool = False, epoch_s: int | None = None) -> DataFrame:
    """start, end, label lines, one epoch each (or, with ``epoch_s``, as many as the line lasts). With ``lights``, from behind
    lights-off and without the last line. Unknown labels are -1; with ``strict`` they fail."""
    return parse_intervals(lines(texts(spark, path)), skip, lights, strict, epoch_s)


def scored_intervals(own: DataFrame, skip: int = 0, lights: bool = True) -> DataFrame:
    """(path, n, start, end, label) of the lines that are scored."""
    own = own.where(F.col("n") >= skip).withColumn("c", F.split("line", "\t"))
    own = own.select("path", "n", F.get("c", F.lit(0)).try_cast("double").alias("start"), F.get("c", F.lit(1)).try_cast("double").alias("end"), F.trim(F.get("c", F.lit(2))).alias("label"))
    return hypnogram.after_lights_off(own, ["path"], "n") if lights else own


def scored_span(own: DataFrame, skip: int = 0, lights: bool = True) -> DataFrame:
    """(path, start_s, end_s): the part of the recording that is scored, to which ``edf.samples`` and ``read_epochs`` crop it."""
    return scored_intervals(own, skip, lights).groupBy("path").agg(F.min_by("start", "n").alias("start_s"), F.max_by("end", "n").alias("end_s"))


def parse_intervals(own: DataFrame, skip: int = 0, lights: bool = True, strict: bool = False, epoch_s: int | None = None) -> DataFrame:
    own = scored_intervals(own, skip, lights)
    stage = hypnogram.recode(F.col("label"), INTERVAL_STAGES, None if strict else -1)
    if strict:
        stage = F.coalesce(stage, F.raise_error(F.concat(F.lit("unknown stage "), F.col("label"))).cast("int"))
    length = F.lit(1) if epoch_s is None else F.round((F.col("end") - F.col("start")) / epoch_s).cast("int")
    own = own.select("path", "n", length.alias("len"), stage.alias("stage"))
    first = F.coalesce(F.sum("len").over(W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return hypnogram.expand_intervals(own.withColumn("first", first), "first", "len").select("path", "epoch_idx", "stage")


def intervals_us(spark: SparkSession, path: str | Files, mapping: dict[str, int]) -> DataFrame:
    """(path, onset_s, duration_s, stage) of the rows whose subtype is a stage."""
    names = "`Start time relative (total µs)`", "`Duration (total µs)`"
    own = _load(spark.read.format("csv").option("header", "true").option("sep", ";"), path)
    own = own.select(_path().alias("path"), (F.col(names[0]).cast("double") / 1e6).alias("onset_s"), (F.col(names[1]).cast("double") / 1e6).alias("duration_s"), hypnogram.recode(F.col("Subtype"), mapping).alias("stage"))
    return own.where("stage IS NOT NULL")


def interval_csv_us(spark: SparkSession, path: str | Files, mapping: dict[str, int], epoch_s: int = 30) -> DataFrame:
    """Semicolon-separated start and duration in microseconds with a subtype; gaps are -1, later starts win, other subtypes are
    left out."""
    return hypnogram.fill_gaps(intervals_us(spark, path, mapping), ["path"], epoch_s)


def paired(recordings: DataFrame, scorings: DataFrame, strip: str = r"(-nsrr)?(\.\w+)+$") -> DataFrame:
    """Recordings and scorings whose file names agree without the endings."""
    base = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), strip, "")
    return recordings.select(F.col("path").alias("recording"), base("path").alias("record_id")).join(scorings.select(F.col("path").alias("scoring"), base("path").alias("_id")), F.col("record_id") == F.col("_id")).drop("_id")


def discover(spark: SparkSession, path: str, glob: str, contains: str = "") -> DataFrame:
    """Paths below a folder that match; sorted numbers make record ids the same everywhere."""
    own = _load(spark.read.format("binaryFile"), Files(path, glob)).select("path").where(F.col("path").contains(contains))
    return numbered(own, "path")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Dense numbers in an order; one row a record, so one task numbers them."""
    return rows.withColumn("subject_id", F.row_number().over(W.orderBy(*order)) - 1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def clinical(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", "true").option("sep", sep).csv(path)
