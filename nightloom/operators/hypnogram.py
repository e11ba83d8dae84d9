"""Stage labels: recoding, cleaning, expansion of intervals, and trimming of wake."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Stages of the older rules (S3 and S4 are one, REM follows) and of other sources.
RK_TO_FIVE = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4}
LETTERS = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "R": 4, "REM": 4}
RODENT_CODES = {1: 0, 2: 1, 3: 2}
RAT_LETTERS = {"w": 0, "n": 1, "r": 2}


def recode(col: Column, mapping: Mapping, default: object = None) -> Column:
    """Lookup of a code; unknown codes give the default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def histogram(labels: DataFrame, classes: int, by: Sequence[str] = (), stage: str = "stage") -> DataFrame:
    """Counts of all classes, with zeros where there is none."""
    grid = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias(stage))
    if by:
        grid = labels.select(*by).distinct().crossJoin(F.broadcast(grid))  # a fixed number of classes
    counts = labels.groupBy(*by, stage).agg(F.count("*").alias("n"))
    return grid.join(counts, [*by, stage], "left").select(*by, stage, F.coalesce("n", F.lit(0)).alias("n"))


def reindexed(labels: DataFrame, record: Sequence[str] = ("subject_id",), order: str = "epoch_idx") -> DataFrame:
    """Epoch numbers made dense again, from 0, after rows were dropped; the former number stays as ``source_idx``."""
    return labels.withColumnRenamed(order, "source_idx").withColumn(order, F.row_number().over(W.partitionBy(*record).orderBy("source_idx")) - 1)


def drop_invalid(labels: DataFrame, low: int = 0, high: int = 4, record: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Epochs whose stage is in range, numbered anew. Records without any leave no rows."""
    return reindexed(labels.where(F.col("stage").between(low, high)), record)


def _changes(labels: DataFrame, record: Sequence[str]) -> DataFrame:
    """Adds _wake, and _change: the epoch's number where it is wake and the one before is not, or the other way round."""
    w = W.partitionBy(*record).orderBy("epoch_idx")
    marked = labels.withColumn("_wake", F.col("stage") == 0).withColumn("_before", F.lag("_wake").over(w))
    return marked.withColumn("_change", F.when(F.col("_before").isNotNull() & (F.col("_wake") != F.col("_before")), F.col("epoch_idx"))).drop("_before")


def _wake_aggregates(classes: int) -> dict[str, Column]:
    second = F.greatest(*[F.count_if(F.col("stage") == c) for c in range(1, classes)]) if classes > 2 else F.count_if(F.col("stage") == 1)
    return {
        "n": F.count("*"), "wakes": F.count_if("_wake"), "second": second,
        "first_change": F.min("_change"), "last_change": F.max("_change"), "starts_awake": F.min_by("_wake", "epoch_idx"),
    }


def _wake_range() -> tuple[Column, Column]:
    """lo and hi from the aggregates' columns."""
    eve = F.when(F.col("starts_awake"), F.col("first_change")).otherwise(F.lit(0))
    surplus = eve + F.col("n") - F.col("last_change") + 1 - F.col("second")
    trim = (F.col("wakes") > F.col("second")) & F.col("first_change").isNotNull() & (surplus > 0)
    lo = F.when(trim, F.when(eve > surplus, surplus).otherwise(eve)).otherwise(F.lit(0))
    hi = F.when(trim & ~(eve > surplus), F.col("n") - (surplus - eve)).otherwise(F.col("n"))
    return lo.cast("long"), hi.cast("long")


def wake_bounds(labels: DataFrame, record: Sequence[str] = ("subject_id",), classes: int = 5) -> DataFrame:
    """lo and hi of the epochs to keep for each record: where wake outnumbers every other stage, surplus wake goes, first
    from the evening, then from the morning. Morning wake is counted from the last change of state on, and one more."""
    lo, hi = _wake_range()
    s = _changes(labels, record).groupBy(*record).agg(*[c.alias(k) for k, c in _wake_aggregates(classes).items()])
    return s.select(*record, "n", lo.alias("lo"), hi.alias("hi"))


def trim_wake(labels: DataFrame, record: Sequence[str] = ("subject_id",), classes: int = 5) -> DataFrame:
    """Epochs within wake_bounds(), numbered anew. Windows by record all the way: one shuffle and no self-join."""
    w = W.partitionBy(*record)
    counted = _changes(labels, record)
    plain = _wake_aggregates(classes)
    stages = [F.count_if(F.col("stage") == c).over(w) for c in range(1, classes)]
    plain["second"] = F.greatest(*stages) if len(stages) > 1 else stages[0]
    wide = counted.select("*", *[(c if k == "second" else c.over(w)).alias(k) for k, c in plain.items()])
    lo, hi = _wake_range()
    kept = wide.where((F.col("epoch_idx") >= lo) & (F.col("epoch_idx") < hi)).select(*[F.col(f"`{c}`") for c in labels.columns])
    return reindexed(kept, record)


def onset(labels: DataFrame, record: Sequence[str] = ("subject_id",)) -> DataFrame:
    """First epoch that is not wake; null where all are."""
    return labels.groupBy(*record).agg(F.min(F.when(F.col("stage") != 0, F.col("epoch_idx"))).alias("onset"))


def nap_end(labels: DataFrame, after: float = 15, without: float = 20, epoch_s: int = 30, record: Sequence[str] = ("subject_id",)) -> DataFrame:
    """(record, last): a nap test ends ``without`` minutes after its start if there is no sleep by then, else ``after`` minutes
    after sleep onset. In epochs."""
    limit, more = int(without * 60 // epoch_s), int(after * 60 // epoch_s)
    late = F.col("onset").isNull() | (F.col("onset") >= limit)
    return onset(labels, record).select(*record, F.when(late, F.lit(limit)).otherwise(F.col("onset") + more).alias("last"))


def within_nap(labels: DataFrame, after: float = 15, without: float = 20, epoch_s: int = 30, record: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Epochs up to the end of the nap test."""
    return labels.join(nap_end(labels, after, without, epoch_s, record), [*record]).where(F.col("epoch_idx") < F.col("last")).drop("last")


def modal_label(fine: DataFrame, key: Sequence[str], stage: str = "stage") -> DataFrame:
    """Most frequent stage within each key; of equally frequent ones, the least."""
    counts = fine.groupBy(*key, stage).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(stage)).alias("rank")))
    return counts.groupBy(*key).agg((-best["rank"]).cast("int").alias(stage))


def unanimous_label(fine: DataFrame, key: Sequence[str], stage: str = "stage") -> DataFrame:
    """The stage that all have, else -1."""
    return fine.groupBy(*key).agg(F.when(F.min(stage) == F.max(stage), F.min(stage)).otherwise(F.lit(-1)).alias(stage))


def expand_intervals(intervals: DataFrame, start: str, length: str, into: str = "epoch_idx") -> DataFrame:
    """One row for each unit that an interval [start, start + length) covers; none where it is empty."""
    return intervals.where(F.col(length) > 0).withColumn(into, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)))


def fill_gaps(intervals: DataFrame, record: Sequence[str], unit_s: float = 30.0) -> DataFrame:
    """(record, epoch_idx, stage) from (onset_s, duration_s, stage). Later starts cut earlier intervals short; gaps are -1."""
    w = W.partitionBy(*record).orderBy("onset_s", "duration_s")
    at = intervals.withColumn("next", F.lead("onset_s").over(w)).withColumn("stop", F.least(F.col("onset_s") + F.col("duration_s"), F.coalesce("next", F.col("onset_s") + F.col("duration_s"))))
    gap = F.col("next") > F.col("stop")
    spans = F.array(F.struct(F.col("onset_s").alias("a"), F.col("stop").alias("b"), F.col("stage").alias("stage")), F.struct(F.col("stop").alias("a"), F.when(gap, F.col("next")).otherwise(F.col("stop")).alias("b"), F.lit(-1).alias("stage")))
    every = at.select(*record, F.inline(spans)).select(*record, "stage", (F.col("a") / unit_s).cast("int").alias("first"), ((F.col("b") - F.col("a")) / unit_s).cast("int").alias("n"))
    return expand_intervals(every, "first", "n").select(*record, "epoch_idx", "stage")


def change_points(events: DataFrame, record: Sequence[str], time: str = "ts", unit_us: int = 30_000_000) -> DataFrame:
    """Micro-seconds and whole units from each event to the record's next."""
    w = W.partitionBy(*record).orderBy(time, *[c for c in ("event_id",) if c in events.columns])
    gap = F.unix_micros(F.lead(F.col(time).cast("timestamp")).over(w)) - F.unix_micros(F.col(time).cast("timestamp"))
    return events.withColumn("gap_us", gap).withColumn("units", F.expr(f"gap_us div {unit_us}"))


def reconcile(signal: DataFrame, labels: DataFrame, record: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Epochs that have a signal and a label: both are cut to the shorter of the two."""
    return signal.join(labels, [*record, "epoch_idx"])


def tolerate_one_extra(signal: DataFrame, labels: DataFrame, record: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Labels of records that have as many labels as epochs, or one more; the extra one goes and other records do."""
    a = signal.groupBy(*record).agg(F.countDistinct("epoch_idx").alias("_signals"))
    b = labels.groupBy(*record).agg(F.count("*").alias("_labels"))
    fit = a.join(b, [*record]).where((F.col("_labels") - F.col("_signals")).isin(0, 1)).drop("_labels")
    return labels.join(fit, [*record]).where(F.col("epoch_idx") < F.col("_signals")).drop("_signals")


def after_lights_off(scores: DataFrame, record: Sequence[str], order: str, label: str = "label") -> DataFrame:
    """Rows behind the first lights-off mark, without the record's last row."""
    w = W.partitionBy(*record)
    lights = F.min(F.when(F.col(label).isin("LIGHTS_OFF", "LIGHT_OFF"), F.col(order))).over(w)
    last = F.max(order).over(w)
    return scores.withColumn("_off", lights).withColumn("_last", last).where((F.col("_off").isNull() | (F.col(order) > F.col("_off"))) & (F.col(order) < F.col("_last"))).drop("_off", "_last")
