"""Queries of the catalogue: one for each operator that tables can exercise, with the same logic in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightloom.functions import dsp
from nightloom.operators import channels, hypnogram, metrics, prototypes, scaling, sequences, splits, voting
from nightloom.plans import models
from nightloom.plans.surrogate import CLASSES, CODES, EP, PR, SUBJ, codebook, epochs, logits, predictions, table, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    from nightloom.plans import catalogue_layers, catalogue_records, catalogue_training, signals  # noqa: F401  they add their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from nightloom.plans import catalogue_layers, catalogue_records, catalogue_training, signals  # noqa: F401

    return dict(SQL)


def r6(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


# --- labels ---


@query(f"WITH {EP} SELECT CASE stage WHEN 4 THEN 3 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS stage, count(*) AS n FROM ep GROUP BY 1")
def stage_recode(spark, d):
    return epochs(spark, d).select(hypnogram.recode(F.col("stage"), hypnogram.RK_TO_FIVE, -1).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query(f"""WITH {EP}, c AS (SELECT subject_id, stage, count(*) AS n FROM ep GROUP BY 1, 2)
SELECT s.subject_id, g.stage, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT subject_id FROM ep) s CROSS JOIN (SELECT unnest(range(6)) AS stage) g LEFT JOIN c ON c.subject_id = s.subject_id AND c.stage = g.stage""")
def stage_histogram_dense(spark, d):
    return hypnogram.histogram(epochs(spark, d), 6, ["subject_id"])


@query(f"""WITH {EP}, k AS (SELECT subject_id, epoch_idx AS source_idx, stage - 1 AS stage FROM ep WHERE stage - 1 BETWEEN 0 AND 3)
SELECT subject_id, source_idx, stage, row_number() OVER (PARTITION BY subject_id ORDER BY source_idx) - 1 AS epoch_idx FROM k""")
def invalid_epoch_drop_reindex(spark, d):
    return hypnogram.drop_invalid(epochs(spark, d).select("subject_id", "epoch_idx", (F.col("stage") - 1).alias("stage")), 0, 3)


TRIM = f"""WITH {EP}, h AS (SELECT subject_id, epoch_idx, CASE WHEN stage >= 3 THEN 0 ELSE stage END AS stage FROM ep),
m AS (SELECT *, stage = 0 AS wake, lag(stage = 0) OVER (PARTITION BY subject_id ORDER BY epoch_idx) AS before FROM h),
s AS (SELECT subject_id, count(*) AS n, count_if(wake) AS w, greatest(count_if(stage = 1), count_if(stage = 2), count_if(stage = 3), count_if(stage = 4)) AS sec,
 min(CASE WHEN before IS NOT NULL AND before <> wake THEN epoch_idx END) AS f, max(CASE WHEN before IS NOT NULL AND before <> wake THEN epoch_idx END) AS l, arg_min(wake, epoch_idx) AS st FROM m GROUP BY 1),
e AS (SELECT *, CASE WHEN st THEN f ELSE 0 END AS ev, n - l + 1 AS mo FROM s),
b AS (SELECT subject_id, n, CASE WHEN w > sec AND f IS NOT NULL AND ev + mo > sec THEN CASE WHEN ev > ev + mo - sec THEN ev + mo - sec ELSE ev END ELSE 0 END AS lo,
 CASE WHEN w > sec AND f IS NOT NULL AND ev + mo > sec AND NOT ev > ev + mo - sec THEN n - (mo - sec) ELSE n END AS hi FROM e)"""


@query(TRIM + " SELECT h.subject_id, h.epoch_idx AS source_idx, h.stage, row_number() OVER (PARTITION BY h.subject_id ORDER BY h.epoch_idx) - 1 AS epoch_idx FROM h JOIN b USING (subject_id) WHERE h.epoch_idx >= lo AND h.epoch_idx < hi")
def wake_trim(spark, d):
    own = epochs(spark, d).select("subject_id", "epoch_idx", F.when(F.col("stage") >= 3, 0).otherwise(F.col("stage")).alias("stage"))
    return hypnogram.trim_wake(own)


@query(TRIM + " SELECT subject_id, n, lo, hi FROM b")
def wake_trim_bounds(spark, d):
    return hypnogram.wake_bounds(epochs(spark, d).select("subject_id", "epoch_idx", F.when(F.col("stage") >= 3, 0).otherwise(F.col("stage")).alias("stage")))


@query(f"WITH {EP} SELECT subject_id, min(CASE WHEN stage <> 0 THEN epoch_idx END) AS onset FROM ep GROUP BY 1")
def sleep_onset(spark, d):
    return hypnogram.onset(epochs(spark, d))


@query(f"""WITH {EP}, h AS (SELECT subject_id, epoch_idx, CASE WHEN value < 40 THEN 0 ELSE stage END AS stage FROM ep), o AS (SELECT subject_id, min(CASE WHEN stage <> 0 THEN epoch_idx END) AS o FROM h GROUP BY 1),
e AS (SELECT subject_id, CASE WHEN o IS NULL OR o >= 40 THEN 40 ELSE o + 30 END AS last FROM o) SELECT subject_id, last, count(*) AS n, sum(stage)::BIGINT AS stages FROM h JOIN e USING (subject_id) WHERE epoch_idx < last GROUP BY 1, 2""")
def nap_after_onset(spark, d):
    own = epochs(spark, d).select("subject_id", "epoch_idx", F.when(F.col("value") < 40, 0).otherwise(F.col("stage")).alias("stage"))
    return hypnogram.within_nap(own).join(hypnogram.nap_end(own), "subject_id").groupBy("subject_id", "last").agg(F.count("*").alias("n"), F.sum("stage").alias("stages"))


@query(f"""WITH {EP}, c AS (SELECT subject_id, CAST(ts AS DATE) AS day, stage, count(*) AS n FROM ep GROUP BY 1, 2, 3)
SELECT subject_id, day, stage FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, day ORDER BY n DESC, stage) AS r FROM c) WHERE r = 1""")
def modal_epoch_label(spark, d):
    return hypnogram.modal_label(epochs(spark, d).withColumn("day", F.to_date("ts")), ["subject_id", "day"])


@query(f"WITH {EP} SELECT subject_id, CAST(ts AS DATE) AS day, CASE WHEN count(DISTINCT stage) = 1 THEN min(stage) ELSE -1 END AS stage FROM ep GROUP BY 1, 2")
def unanimous_epoch_label(spark, d):
    return hypnogram.unanimous_label(epochs(spark, d).withColumn("day", F.to_date("ts")), ["subject_id", "day"])


@query("SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) % 4 + 1)) AS epoch_idx FROM lineitem")
def interval_to_epochs(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 4 + 1).alias("len"))
    return hypnogram.expand_intervals(own, "l_linenumber", "len").select("l_orderkey", "l_linenumber", "epoch_idx")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber * 60.0 AS onset_s, (CAST(l_quantity AS INTEGER) % 4) * 30.0 AS duration_s, CAST(l_quantity AS INTEGER) % 5 AS stage FROM lineitem),
u AS (SELECT l_orderkey, onset_s, max(duration_s) AS duration_s, min(stage) AS stage FROM i GROUP BY 1, 2),
n AS (SELECT *, lead(onset_s) OVER (PARTITION BY l_orderkey ORDER BY onset_s) AS nxt FROM u),
a AS (SELECT *, least(onset_s + duration_s, coalesce(nxt, onset_s + duration_s)) AS stop FROM n),
e AS (SELECT l_orderkey, stage, onset_s AS b, stop FROM a UNION ALL SELECT l_orderkey, -1, stop, nxt FROM a WHERE nxt > stop),
x AS (SELECT l_orderkey, stage, unnest(range(CAST(b / 30 AS INTEGER), CAST(b / 30 AS INTEGER) + CAST((stop - b) / 30 AS INTEGER))) AS epoch_idx FROM e)
SELECT l_orderkey, epoch_idx, stage FROM x""")
def interval_gap_fill(spark, d):
    q = F.col("l_quantity").cast("int")
    own = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 60.0).alias("onset_s"), ((q % 4) * 30.0).alias("duration_s"), (q % 5).alias("stage"))
    own = own.groupBy("l_orderkey", "onset_s").agg(F.max("duration_s").alias("duration_s"), F.min("stage").alias("stage"))
    return hypnogram.fill_gaps(own, ["l_orderkey"])


@query(f"""WITH {EP} SELECT event_id, g AS gap_us, CAST(trunc(g / 30000000.0) AS BIGINT) AS units FROM
(SELECT event_id, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY subject_id ORDER BY ts, event_id)) AS g FROM ep)""")
def event_gaps(spark, d):
    return hypnogram.change_points(epochs(spark, d), ["subject_id"]).select("event_id", "gap_us", "units")


@query(f"""WITH {EP}, b AS (SELECT o_custkey AS subject_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS epoch_idx, o_orderkey % 5 AS stage FROM orders)
SELECT subject_id, count(*) AS n, round(sum(value), 4) AS signal, sum(b.stage)::BIGINT AS stages FROM ep JOIN b USING (subject_id, epoch_idx) GROUP BY 1""")
def signal_label_join(spark, d):
    """Events as the signal's epochs, orders as labels: both are cut to the shorter record."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    labels = table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), at.alias("epoch_idx"), (F.col("o_orderkey") % 5).alias("stage"))
    both = hypnogram.reconcile(epochs(spark, d).select("subject_id", "epoch_idx", "value"), labels)
    return both.groupBy("subject_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("signal"), F.sum("stage").alias("stages"))


@query(f"""WITH {EP}, sg AS (SELECT subject_id, count(*) - subject_id % 3 AS s, count(*) AS n FROM ep GROUP BY subject_id)
SELECT subject_id, epoch_idx, stage FROM ep JOIN sg USING (subject_id) WHERE n - s IN (0, 1) AND epoch_idx < s""")
def one_extra_label(spark, d):
    e = epochs(spark, d)
    n = e.groupBy("subject_id").agg(F.count("*").alias("n"))
    signal = e.join(n, "subject_id").where(F.col("epoch_idx") < F.col("n") - F.col("subject_id") % 3).select("subject_id", "epoch_idx")
    return hypnogram.tolerate_one_extra(signal, e.select("subject_id", "epoch_idx", "stage"))


# --- tables and sequences ---


@query(f"WITH {SUBJ} SELECT subject_id, num_windows, sum(num_windows) OVER w::BIGINT - num_windows AS start_index, (sum(num_windows) OVER w)::BIGINT AS end_index FROM subj WINDOW w AS (ORDER BY subject_id)".replace("sum(num_windows) OVER w::BIGINT", "(sum(num_windows) OVER w)::BIGINT"))
def subject_table_offsets(spark, d):
    return sequences.subject_table(epochs(spark, d))


@query(f"WITH {SUBJ} SELECT sum(greatest(num_windows - 21, 0) + 1)::BIGINT AS sequences, count(*) AS subjects FROM subj")
def sequence_count(spark, d):
    return sequences.sequence_counts(epochs(spark, d)).agg(F.sum("sequences").alias("sequences"), F.count("*").alias("subjects"))


def _index(length: int) -> str:
    return f"""WITH {SUBJ}, ix AS (SELECT subject_id, unnest(range(greatest(num_windows - {length}, 0) + 1)) AS rel_idx FROM subj),
 sq AS (SELECT subject_id, rel_idx, unnest(range({length})) AS off FROM ix)"""


@query(_index(21) + " SELECT sq.subject_id, rel_idx, sum((off + 1) * stage)::BIGINT AS checksum, count(*) AS n FROM sq JOIN ep ON ep.subject_id = sq.subject_id AND ep.epoch_idx = rel_idx + off GROUP BY 1, 2")
def sequence_index(spark, d):
    own = sequences.sequences(epochs(spark, d), 21).where("NOT padded")
    return own.groupBy("subject_id", "rel_idx").agg(F.sum((F.col("off") + 1) * F.col("stage")).alias("checksum"), F.count("*").alias("n"))


@query(_index(64) + " SELECT sq.subject_id, rel_idx, off, coalesce(stage, 5) AS stage FROM sq LEFT JOIN ep ON ep.subject_id = sq.subject_id AND ep.epoch_idx = rel_idx + off")
def sequence_padded_labels(spark, d):
    return sequences.sequences(epochs(spark, d), 64).select("subject_id", "rel_idx", "off", "stage")


@query(_index(64) + """, m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM ep)
 SELECT sq.subject_id, rel_idx, round(sum((coalesce(value, 0) - a) / s), 4) AS total FROM sq LEFT JOIN ep ON ep.subject_id = sq.subject_id AND ep.epoch_idx = rel_idx + off CROSS JOIN m GROUP BY 1, 2""")
def sequence_padded_signal(spark, d):
    e = epochs(spark, d)
    m = e.agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s"))
    own = sequences.padded_signal(e, "value", 64).crossJoin(F.broadcast(m))
    return own.groupBy("subject_id", "rel_idx").agg(F.round(F.sum((F.col("value") - F.col("a")) / F.col("s")), 4).alias("total"))


@query(_index(21).rsplit(", sq AS", 1)[0].replace(",\n ", ", ").rstrip(",\n ") + " SELECT ix.subject_id, rel_idx, coalesce(stage, 5) AS stage FROM ix LEFT JOIN ep ON ep.subject_id = ix.subject_id AND ep.epoch_idx = rel_idx + 10")
def mid_label(spark, d):
    return sequences.middle_labels(epochs(spark, d), 21)


@query(f"WITH {EP} SELECT subject_id, count(*) AS n, sum((epoch_idx + 1) * stage)::BIGINT AS checksum, arg_max(stage, epoch_idx) AS last_stage FROM ep GROUP BY 1")
def whole_night_profile(spark, d):
    own = sequences.whole_records(epochs(spark, d))
    total = F.aggregate(F.transform("stages", lambda s, i: (i + 1) * s), F.lit(0), lambda a, x: a + x)
    return own.select("subject_id", F.size("stages").alias("n"), total.alias("checksum"), F.element_at("stages", -1).alias("last_stage"))


@query(f"""WITH {EP}, g AS (SELECT stage, row_number() OVER (ORDER BY subject_id, epoch_idx) - 1 AS pos FROM ep), t AS (SELECT count(*) AS total FROM ep),
o AS (SELECT stage, pos, unnest(range(5)) AS off FROM g)
SELECT pos - off AS start, sum((off + 1) * stage)::BIGINT AS checksum FROM o, t WHERE pos - off >= 0 AND pos - off <= total - 5 GROUP BY 1""")
def cross_subject_sequences(spark, d):
    return sequences.crossing_sequences(epochs(spark, d), 5).groupBy("start").agg(F.sum((F.col("off") + 1) * F.col("stage")).alias("checksum"))


@query(f"""WITH {EP} SELECT subject_id, epoch_idx AS rel_idx, round(v, 4) AS total FROM (SELECT subject_id, epoch_idx, sum(value) OVER w AS v, count(*) OVER w AS n FROM ep
WINDOW w AS (PARTITION BY subject_id ORDER BY epoch_idx ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING)) WHERE n = 21""")
def sliding_gather(spark, d):
    own = sequences.gathered(epochs(spark, d), "value", 21)
    return own.select("subject_id", "rel_idx", F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# --- scaling ---

UN = "u AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"
SC = UN + ", sc AS (SELECT pos, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std FROM u GROUP BY 1)"


@query(f"WITH {SC} SELECT pos, n, round(mean, 6) AS mean, round(std, 6) AS std FROM sc")
def positional_scaling(spark, d):
    return scaling.positional_scaling(vectors(spark, d), "embedding").select("pos", "n", r6("mean"), r6("std"))


@query(f"WITH {SC} SELECT vec_id, round(sum((x - mean) / std), 4) AS total, round(max((x - mean) / std), 4) AS top FROM u JOIN sc USING (pos) GROUP BY 1")
def standardize(spark, d):
    v = vectors(spark, d)
    z = scaling.standardise(v, scaling.positional_scaling(v, "embedding"), "embedding", "z")
    return z.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("z"), 4).alias("top"))


@query(f"WITH {UN} SELECT vec_id, round(sum(x), 4) AS total FROM u GROUP BY 1")
def destandardize(spark, d):
    v = vectors(spark, d)
    z = scaling.standardise(v, scaling.positional_scaling(v, "embedding"), "embedding", "z").withColumn("x", scaling.restored(F.col("z"), F.col("mean"), F.col("std")))
    return z.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT count(*) AS vectors, count_if(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS bad FROM embeddings")
def nan_inf_guard(spark, d):
    own = scaling.guarded(vectors(spark, d), "embedding")
    return own.agg(F.count("*").alias("vectors"), F.count_if(scaling.bad_values(F.col("embedding"))).alias("bad"))


# --- splits ---

FOLD = f"""{SUBJ}, rk AS (SELECT subject_id, row_number() OVER (ORDER BY (subject_id * 7919) % 10007, subject_id) - 1 AS r, count(*) OVER () AS n FROM subj),
fd AS (SELECT subject_id, CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.7) + floor(n * 0.15) THEN 'test' ELSE 'valid' END AS split FROM rk)"""


def _folds(spark, d):
    return splits.rank_folds(epochs(spark, d), (F.col("subject_id") * 7919) % 10007)


@query(f"WITH {FOLD} SELECT subject_id, split FROM fd")
def fold_assignment(spark, d):
    return _folds(spark, d)


@query(f"""WITH {SUBJ}, p AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS i, count(*) OVER () AS n FROM subj)
SELECT subject_id, i AS valid_fold, (i - 1 + n) % n AS test_fold FROM p""")
def loso_folds(spark, d):
    return splits.leave_one_out(epochs(spark, d))


@query(f"WITH {SUBJ} SELECT subject_id, subject_id % 3 AS grp, (row_number() OVER (PARTITION BY subject_id % 3 ORDER BY (subject_id * 7919) % 10007, subject_id) - 1) % 4 AS fold FROM subj")
def stratified_kfold(spark, d):
    own = epochs(spark, d).select("subject_id", "grp").distinct()
    return splits.stratified(own, "grp", 4, (F.col("subject_id") * 7919) % 10007)


@query(f"""WITH {SUBJ}, f AS (SELECT subject_id, (row_number() OVER (PARTITION BY subject_id % 3 ORDER BY (subject_id * 7919) % 10007, subject_id) - 1) % 4 AS fold FROM subj)
SELECT subject_id, k AS fold, CASE WHEN fold = k THEN 'test' WHEN fold = (k + 1) % 4 THEN 'valid' ELSE 'train' END AS split FROM f CROSS JOIN (SELECT unnest(range(4)) AS k)""")
def stratified_next_fold(spark, d):
    own = epochs(spark, d).select("subject_id", "grp").distinct()
    return splits.next_fold_validates(splits.stratified(own, "grp", 4, (F.col("subject_id") * 7919) % 10007), 4)


@query(f"""WITH {SUBJ}, f AS (SELECT subject_id, subject_id % 3 AS grp, (subject_id * 7919) % 10007 AS o, (row_number() OVER (PARTITION BY subject_id % 3 ORDER BY (subject_id * 7919) % 10007, subject_id) - 1) % 4 AS own FROM subj),
r AS (SELECT *, row_number() OVER (PARTITION BY k, grp, own = k ORDER BY o, subject_id) AS r, count(*) OVER (PARTITION BY k, grp, own = k) AS n FROM f CROSS JOIN (SELECT unnest(range(4)) AS k))
SELECT subject_id, grp, k AS fold, CASE WHEN own = k THEN 'test' WHEN r <= ceil(n * 0.1765) THEN 'valid' ELSE 'train' END AS split FROM r""")
def stratified_validation(spark, d):
    own = epochs(spark, d).select("subject_id", "grp").distinct()
    return splits.stratified_with_validation(own, "grp", 4, (F.col("subject_id") * 7919) % 10007)


AV = """a AS (SELECT DISTINCT user_id AS subject_id FROM events), b AS (SELECT DISTINCT o_custkey AS subject_id FROM orders),
av AS (SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, CASE WHEN a.subject_id IS NOT NULL AND b.subject_id IS NOT NULL THEN 'both' WHEN a.subject_id IS NOT NULL THEN 'first' ELSE 'second' END AS availability FROM a FULL JOIN b ON a.subject_id = b.subject_id)"""


def _sessions(spark, d):
    """Who has events, and who has orders, as two sessions."""
    return table(spark, d, "events").select(F.col("user_id").alias("subject_id")), table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"))


def _availability(spark, d):
    return splits.availability(*_sessions(spark, d))


@query(f"WITH {AV} SELECT subject_id, availability FROM av")
def availability_strata(spark, d):
    return _availability(spark, d)


@query(f"""WITH {AV}, r AS (SELECT *, count(*) OVER (PARTITION BY availability) AS n, row_number() OVER (PARTITION BY availability ORDER BY (subject_id * 7919) % 10007, subject_id) - 1 AS r FROM av)
SELECT subject_id, availability, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train' WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'test' ELSE 'valid' END AS split FROM r""")
def strata_split(spark, d):
    return splits.strata_split(_availability(spark, d), "availability", (F.col("subject_id") * 7919) % 10007)


@query(f"WITH {AV} SELECT 'both' AS kind, count(*) AS n FROM (SELECT subject_id FROM a INTERSECT SELECT subject_id FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT subject_id FROM a EXCEPT SELECT subject_id FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT subject_id FROM a UNION SELECT subject_id FROM b)")
def session_sets(spark, d):
    a, b = _sessions(spark, d)
    count = lambda name, df: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return count("both", a.intersect(b)).unionAll(count("first", a.distinct().subtract(b))).unionAll(count("any", a.union(b).distinct()))


@query(f"WITH {FOLD} SELECT split, sum(num_windows)::BIGINT AS windows, round(sum(num_windows) / sum(sum(num_windows)) OVER (), 6) AS share FROM fd JOIN subj USING (subject_id) GROUP BY 1")
def split_shares(spark, d):
    e = epochs(spark, d)
    return splits.shares(_folds(spark, d), e.groupBy("subject_id").agg(F.count("*").alias("num_windows"))).select("split", "windows", r6("share"))


@query(f"WITH {FOLD} SELECT subject_id FROM subj WHERE subject_id NOT IN (SELECT subject_id FROM fd WHERE split IN ('valid', 'test'))")
def train_residual(spark, d):
    return splits.training_rest(epochs(spark, d), _folds(spark, d).where("split <> 'train'"))


@query(f"WITH {FOLD} SELECT split, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM ep JOIN fd USING (subject_id) GROUP BY 1")
def split_windows(spark, d):
    return splits.with_split(epochs(spark, d), _folds(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("subjects"))


@query(f"WITH {SUBJ} SELECT subject_id, k AS fold, CASE WHEN subject_id % 5 = k THEN 'test' ELSE 'train' END AS split FROM subj CROSS JOIN (SELECT unnest(range(3)) AS k)")
def file_split(spark, d):
    e = epochs(spark, d)
    ids = e.select("subject_id", (F.col("subject_id") % 5).cast("int").alias("fold"), F.lit("test").alias("split")).where("fold < 3").distinct()
    return splits.from_ids(e, ids)


@query(f"WITH {SUBJ} SELECT subject_id, num_windows, 'test' AS split FROM subj")
def all_test(spark, d):
    return epochs(spark, d).groupBy("subject_id").agg(F.count("*").alias("num_windows")).withColumn("split", F.lit("test"))


# --- joins and channels ---


@query("""SELECT c_custkey, coalesce(n_name, 'Unique group') AS grp, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def clinical_left_join(spark, d):
    n, r = table(spark, d, "nation").where("n_nationkey % 2 = 0"), table(spark, d, "region")
    own = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return own.select("c_custkey", F.coalesce("n_name", F.lit("Unique group")).alias("grp"), F.coalesce("r_name", F.lit("none")).alias("region"))


CANDIDATES = [("m1", 0, "large", "promo"), ("m1", 1, "Standard", None), ("m1", 2, "SMALL", "medium"), ("m1", 3, "economy", None), ("m2", 0, "PROMO", None), ("m2", 1, "economy", "small")]
CAND = "cand AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {p}, '{a}', {'NULL' if b is None else repr(b)})" for m, p, a, b in CANDIDATES) + ") t(modality, priority, a, b))"


@query(f"""WITH {CAND}, hd AS (SELECT p_brand || '-' || p_size % 7 AS record_id, upper(p_type) AS up, min(p_type) AS label FROM part GROUP BY 1, 2),
ok AS (SELECT x.record_id, modality, priority, x.label AS a, y.label AS b FROM hd x JOIN cand ON x.up = upper(cand.a) LEFT JOIN hd y ON y.record_id = x.record_id AND y.up = upper(cand.b) WHERE cand.b IS NULL OR y.label IS NOT NULL)
SELECT record_id, modality, priority, a, b FROM (SELECT *, row_number() OVER (PARTITION BY record_id, modality ORDER BY priority) AS r FROM ok) WHERE r = 1""")
def channel_resolution(spark, d):
    headers = table(spark, d, "part").select(F.concat_ws("-", "p_brand", F.col("p_size") % 7).alias("record_id"), F.col("p_type").alias("label"))
    return channels.resolve(headers, spark.createDataFrame(CANDIDATES, "modality string, priority int, a string, b string"))


@query("""WITH p AS (SELECT a.vec_id AS subject_id, unnest(range(64)) AS pos, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT subject_id, round(sum((x - y) * (pos + 1)), 3) AS minus, round(sum((x + y) * (pos + 1)), 3) AS plus FROM p GROUP BY 1""")
def bipolar_derivation(spark, d):
    own = vectors(spark, d).select((F.col("vec_id") - F.col("vec_id") % 2).alias("subject_id"), F.lit(0).alias("epoch_idx"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("channel"), F.col("embedding").cast("array<double>").alias("samples"))
    weigh = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3)
    minus, plus = channels.derive(own, "A", "B", "A-B"), channels.derive(own, "A", "B", "A+B", sign=1)
    return minus.select("subject_id", weigh("samples").alias("minus")).join(plus.select("subject_id", weigh("samples").alias("plus")), "subject_id")


@query("SELECT vec_id, e AS epoch_idx, round(list_sum(list_slice(embedding, e * 20 + 1, e * 20 + 20)::DOUBLE[]), 4) AS total FROM embeddings CROSS JOIN (SELECT unnest(range(3)) AS e)")
def tumbling_epochs(spark, d):
    own = vectors(spark, d).select("vec_id", F.posexplode(channels.cut_epochs(F.col("embedding"), 20)).alias("epoch_idx", "x"))
    return own.select("vec_id", "epoch_idx", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


@query("SELECT vec_id, pos::INTEGER AS pos, CASE WHEN pos < 16 THEN 0.0 ELSE round(embedding[pos - 15]::DOUBLE, 6) + 0.0 END AS y FROM embeddings, range(80) t(pos)")
def left_zero_pad(spark, d):
    own = vectors(spark, d).select("vec_id", F.posexplode(channels.pad_left(F.col("embedding"), 20)).alias("pos", "v"))
    return own.select("vec_id", "pos", (F.round(F.col("v").cast("double"), 6) + 0.0).alias("y"))


# --- votes and metrics ---

LG = EP + ", lg AS (SELECT subject_id, epoch_idx, stage, c, (stage = c)::INTEGER::DOUBLE + (floor(value)::BIGINT + c) % 7 / 100.0 AS z FROM ep CROSS JOIN (SELECT unnest(range(5)) AS c))"
SM = LG + ", sm AS (SELECT subject_id, epoch_idx, stage, c, z, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS q FROM lg WINDOW w AS (PARTITION BY subject_id, epoch_idx))"


@query(f"WITH {SM} SELECT c, round(sum(q), 4) AS total FROM sm GROUP BY 1")
def softmax_scores(spark, d):
    own = epochs(spark, d).select(F.posexplode(voting.softmax(logits())).alias("c", "q"))
    return own.groupBy("c").agg(F.round(F.sum("q"), 4).alias("total"))


VOTE = _index(5) + """, lg AS (SELECT sq.subject_id, rel_idx + off AS epoch_idx, rel_idx, off, c, (stage = c)::INTEGER::DOUBLE + (floor(value)::BIGINT + c + off) % 7 / 100.0 AS z
 FROM sq JOIN ep ON ep.subject_id = sq.subject_id AND ep.epoch_idx = rel_idx + off CROSS JOIN (SELECT unnest(range(5)) AS c)),
 sm AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY subject_id, rel_idx, off) AS q FROM lg)"""


def _sequence_preds(spark, d):
    e = epochs(spark, d)
    index = sequences.sequence_index(e, 5).select("subject_id", "rel_idx", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("off")).withColumn("epoch_idx", F.col("rel_idx") + F.col("off"))
    part = lambda c: (F.col("stage") == c).cast("double") + (F.floor("value") + c + F.col("off")) % 7 / 100.0
    return index.join(e.select("subject_id", "epoch_idx", "stage", "value"), ["subject_id", "epoch_idx"]).select("subject_id", "rel_idx", "off", "stage", F.array(*[part(c) for c in range(5)]).alias("logits"))


@query(VOTE + " SELECT subject_id, epoch_idx, c, round(sum(q), 6) AS votes, count(*) AS coverage, round(avg(q), 6) AS mean FROM sm GROUP BY 1, 2, 3")
def vote_aggregate(spark, d):
    v = voting.vote(_sequence_preds(spark, d), CLASSES).withColumn("m", voting.normalised(F.col("votes"), F.col("coverage")))
    return v.select("subject_id", "epoch_idx", "coverage", F.posexplode(F.arrays_zip("votes", "m")).alias("c", "z")).select("subject_id", "epoch_idx", "c", F.round("z.votes", 6).alias("votes"), "coverage", F.round("z.m", 6).alias("mean"))


@query(VOTE + ", v AS (SELECT subject_id, epoch_idx, c, round(sum(q), 9) AS v FROM sm GROUP BY 1, 2, 3) SELECT subject_id, epoch_idx, c AS stage FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, epoch_idx ORDER BY v DESC, c) AS r FROM v) WHERE r = 1")
def predicted_stage(spark, d):
    v = voting.vote(_sequence_preds(spark, d), CLASSES)
    return v.select("subject_id", "epoch_idx", voting.argmax(F.transform("votes", lambda x: F.round(x, 9))).alias("stage"))


@query(f"WITH {PR}, c AS (SELECT y, p, count(*) AS n FROM pr GROUP BY 1, 2), g AS (SELECT a.x AS y, b.x AS p FROM (SELECT unnest(range(5)) AS x) a CROSS JOIN (SELECT unnest(range(5)) AS x) b) SELECT g.y, g.p, coalesce(n, 0) AS n, round(coalesce(n / sum(n) OVER (PARTITION BY g.y), 0), 6) AS share FROM g LEFT JOIN c ON c.y = g.y AND c.p = g.p")
def confusion_matrix(spark, d):
    return metrics.confusion(predictions(spark, d), CLASSES).select("y", "p", "n", r6("share"))


def _metrics(by: str) -> str:
    on, comma = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""{PR}, sides AS (SELECT {comma}y AS c, 1 AS s, 0 AS k, (y = p)::INTEGER AS h FROM pr UNION ALL SELECT {comma}p, 0, 1, 0 FROM pr),
 e AS (SELECT {comma}c, sum(s)::DOUBLE AS s, sum(k)::DOUBLE AS k, sum(h)::DOUBLE AS h FROM sides GROUP BY {comma}c),
 x AS (SELECT *, CASE WHEN s > 0 THEN h / s ELSE 0 END AS rec, CASE WHEN k > 0 THEN h / k ELSE 0 END AS prec, 2 * h / (s + k) AS f FROM e),
 t AS (SELECT {comma}sum(s)::BIGINT AS n, sum(h) / sum(s) AS acc, avg(rec) AS macc, sum(f * s) / sum(s) AS f1, avg(f) AS mf1, sum(prec * s) / sum(s) AS pr, sum(rec * s) / sum(s) AS rc, sum(s * k) / (sum(s) * sum(s)) AS pe FROM x {"GROUP BY " + by if by else ""}),
 mt AS (SELECT *, CASE WHEN pe < 1 THEN (acc - pe) / (1 - pe) ELSE 0 END AS ck FROM t)"""


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)


@query(f"WITH {_metrics('')} SELECT n, {ROUNDED} FROM mt")
def classification_metrics(spark, d):
    return metrics.classification(predictions(spark, d)).select("n", *[r6(m) for m in metrics.METRICS])


@query(f"WITH {_metrics('subject_id')} SELECT count(*) AS records, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS) + " FROM mt")
def metrics_per_night_mean(spark, d):
    return metrics.per_record_mean(predictions(spark, d)).select("records", *[r6(m) for m in metrics.METRICS])


@query(f"WITH {PR}, g AS (SELECT value AS y, value + (stage - 2) AS p FROM ep), m AS (SELECT avg(y) AS a FROM g) SELECT count(*) AS n, round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) * (y - p)) / sum((y - a) * (y - a)), 6) AS r2 FROM g, m".replace(PR, EP))
def regression_metrics(spark, d):
    own = epochs(spark, d).select(F.col("value").alias("y"), (F.col("value") + (F.col("stage") - 2)).alias("p"))
    return metrics.regression(own).select("n", r6("mse"), r6("mae"), r6("r2"))


@query(f"WITH {SM} SELECT round(avg(-ln(q)), 6) AS loss FROM sm WHERE c = stage")
def cross_entropy_loss(spark, d):
    return epochs(spark, d).agg(F.round(F.avg(metrics.cross_entropy(voting.softmax(logits()), F.col("stage"))), 6).alias("loss"))


@query(f"WITH {EP} SELECT round(avg(CASE WHEN abs(value - stage) <= 5 THEN 0.5 * (value - stage) * (value - stage) ELSE 5 * (abs(value - stage) - 2.5) END / 112.5), 6) AS loss FROM ep")
def huber_loss(spark, d):
    return epochs(spark, d).agg(F.round(F.avg(metrics.huber(F.col("value"), F.col("stage"))), 6).alias("loss"))


@query(f"WITH {PR} SELECT round(avg((y = p)::INTEGER::DOUBLE), 6) AS c1, round(avg((y = (p + 1) % 5)::INTEGER::DOUBLE), 6) AS c2 FROM pr")
def channel_accuracy(spark, d):
    own = predictions(spark, d).select("y", F.col("p").alias("c1"), ((F.col("p") + 1) % 5).alias("c2"))
    return metrics.channel_accuracy(own, ["c1", "c2"]).select(r6("c1"), r6("c2"))


@query(f"WITH {EP} SELECT round(avg(value) * 15, 4) AS value_mean15, round(var_samp(value), 4) AS value_var FROM ep")
def coverage_penalty(spark, d):
    own = metrics.coverage_penalty(epochs(spark, d), ["value"])
    return own.select(*[F.round(c, 4).alias(c) for c in own.columns])


# --- transitions and prototypes ---

TRANS = f"""{EP}, st AS (SELECT stage AS src, lead(stage) OVER (PARTITION BY subject_id ORDER BY epoch_idx) AS dst FROM ep), c AS (SELECT src, dst, count(*) AS n FROM st WHERE dst IS NOT NULL GROUP BY 1, 2),
g AS (SELECT a.x AS src, b.x AS dst FROM (SELECT unnest(range(5)) AS x) a CROSS JOIN (SELECT unnest(range(5)) AS x) b), tm AS (SELECT g.src, g.dst, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.src = g.src AND c.dst = g.dst)"""


@query(f"WITH {TRANS} SELECT src, dst, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY src), 0), 0), 6) AS p FROM tm")
def transition_matrix(spark, d):
    return prototypes.transitions(epochs(spark, d), CLASSES).select("src", "dst", "n", r6("p"))


@query(f"""WITH {TRANS}, k AS (SELECT stage FROM (SELECT stage, count(*) / sum(count(*)) OVER () AS sh FROM ep GROUP BY 1) WHERE sh > 0.2), q AS (SELECT *, n / sum(n) OVER () AS p FROM tm)
SELECT src, dst, n, round(p, 6) AS p FROM q WHERE n > 0 AND src IN (SELECT stage FROM k) AND dst IN (SELECT stage FROM k)""")
def transition_graph_filtered(spark, d):
    return prototypes.transition_graph(epochs(spark, d), CLASSES, 0.2).select("src", "dst", "n", r6("p"))


CODE = EP + f", cd AS (SELECT subject_id, epoch_idx, stage, grp, floor(value)::INTEGER % {CODES} AS code FROM ep)"


def _coded(spark, d):
    return epochs(spark, d).select("subject_id", "epoch_idx", "stage", "grp", (F.floor("value") % CODES).cast("int").alias("code"))


@query(f"WITH {CODE} SELECT code, count(*) AS n, " + ", ".join(f"round(count_if(stage = {k}) / count(*), 6) AS stage_{k}" for k in range(5)) + " FROM cd GROUP BY 1")
def prototype_specificity(spark, d):
    return prototypes.specificity(_coded(spark, d), range(5)).select("code", "n", *[r6(f"stage_{k}") for k in range(5)])


@query(f"""WITH {CODE}, s AS (SELECT code, stage, count(*) / sum(count(*)) OVER (PARTITION BY stage) AS share FROM cd GROUP BY code, stage)
SELECT code, stage, round(share, 6) AS share FROM s UNION ALL SELECT x, NULL, NULL FROM (SELECT unnest(range(20)) AS x) WHERE x NOT IN (SELECT code FROM cd)""")
def prototype_sensitivity(spark, d):
    return prototypes.sensitivity(_coded(spark, d), 20).select("code", "stage", r6("share"))


@query(f"WITH {CODE} SELECT code, grp, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY code), 6) AS share FROM cd GROUP BY code, grp")
def attribute_density(spark, d):
    return prototypes.shares_within(_coded(spark, d), "code", "grp").select("code", "grp", "n", r6("share"))


@query(f"WITH {CODE} SELECT code, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM cd GROUP BY code")
def prototype_percentages(spark, d):
    return prototypes.percentages(_coded(spark, d)).select("code", "n", r6("percent"))


@query(f"WITH {CODE}, c AS (SELECT subject_id, code, count(*) AS n FROM cd GROUP BY 1, 2) SELECT subject_id, code, n FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, code) AS r FROM c) WHERE r = 1")
def night_prototype(spark, d):
    return voting.night_choice(_coded(spark, d), ["subject_id"])


VQ = f"""cb AS (SELECT vec_id AS code, embedding AS v FROM embeddings WHERE vec_id < {CODES}),
dist AS (SELECT e.vec_id, cb.code, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - cb.v[i]) * (e.embedding[i]::DOUBLE - cb.v[i]))) AS dd FROM embeddings e CROSS JOIN cb),
vq AS (SELECT vec_id, code, dd FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, code) AS r FROM dist) WHERE r = 1)"""


def _vq(spark, d):
    return prototypes.assign(vectors(spark, d), codebook(spark, d), "vec_id")


@query(f"WITH {VQ} SELECT vec_id, code, round(dd, 5) AS distance FROM vq")
def vq_assignment(spark, d):
    return _vq(spark, d).select("vec_id", "code", F.round("distance", 5).alias("distance"))


@query(f"WITH {VQ}, {UN}, s AS (SELECT code, pos AS bin, count(*) AS n, avg(pow(10, x / 20)) AS m, stddev_samp(pow(10, x / 20)) AS sd FROM u JOIN vq USING (vec_id) GROUP BY 1, 2) SELECT code, bin, n, round(CASE WHEN n < 2 THEN 0 ELSE m END, 6) AS mean, round(CASE WHEN n < 2 THEN 0 ELSE sd END, 6) AS std FROM s")
def prototype_mean_spectrum(spark, d):
    own = vectors(spark, d).join(_vq(spark, d), "vec_id")
    return prototypes.mean_spectrum(own, ["code"], "embedding").select("code", "bin", "n", r6("mean"), r6("std"))


BAND = "CASE " + " ".join(f"WHEN pos * 0.78125 >= {low} AND pos * 0.78125 < {high} THEN '{name}'" for name, low, high in prototypes.BANDS) + " END"


@query(f"WITH {UN} SELECT label, {BAND} AS band, count(*) AS n, round(avg(x), 6) AS power FROM u WHERE {BAND} IS NOT NULL GROUP BY 1, 2")
def band_power(spark, d):
    return prototypes.band_power(vectors(spark, d), ["label"], "embedding", 0.78125).select("label", "band", "n", r6("power"))


@query(f"WITH {LG}, w AS (SELECT subject_id, epoch_idx, max(z) FILTER (c = 0) AS a, max(z) FILTER (c BETWEEN 1 AND 3) AS b, max(z) FILTER (c = 4) AS g FROM lg GROUP BY 1, 2) SELECT round(sum(a), 4) AS wake, round(sum(b), 4) AS sleep, round(sum(g), 4) AS rem FROM w")
def class_merge(spark, d):
    m = epochs(spark, d).select(voting.merge_sleep(logits()).alias("m"))
    return m.agg(*[F.round(F.sum(F.get("m", F.lit(i))), 4).alias(n) for i, n in enumerate(("wake", "sleep", "rem"))])


@query(f"WITH {EP}, m AS (SELECT subject_id, max(stage / 4.0) AS t FROM ep GROUP BY 1) SELECT subject_id, round(sum(exp(stage / 4.0 - t)), 6) AS weight, round(sum(exp(stage / 4.0 - t) * value) / sum(exp(stage / 4.0 - t)), 6) AS pooled FROM ep JOIN m USING (subject_id) GROUP BY 1")
def attention_pooling(spark, d):
    own = epochs(spark, d).withColumn("score", F.col("stage") / 4.0)
    return prototypes.attention(own, ["subject_id"], "score", "value").select("subject_id", r6("weight"), r6("pooled"))


@query(f"WITH {EP} SELECT subject_id, epoch_idx, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY value DESC, epoch_idx) AS r FROM ep) WHERE r <= 3")
def hard_attention_topn(spark, d):
    return prototypes.top_n(epochs(spark, d), ["subject_id"], "value", 3, "epoch_idx").select("subject_id", "epoch_idx", "rank")


@query(f"""WITH w AS (SELECT s AS start, k AS width FROM (SELECT unnest(range(29)) AS s) CROSS JOIN (SELECT unnest(range(1, 16, 2)) AS k) WHERE s + k <= 29), {UN}
SELECT label, start, width, round(avg(x), 6) AS mean FROM u JOIN w ON pos >= start AND pos < start + width GROUP BY 1, 2, 3""")
def time_mask_windows(spark, d):
    masks = spark.createDataFrame(prototypes.odd_windows(29), "start int, width int")
    own = vectors(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    cells = masks.select("start", "width", F.explode(F.expr("sequence(start, start + width - 1)")).alias("pos"))
    return own.join(F.broadcast(cells), "pos").groupBy("label", "start", "width").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


BANK = prototypes.filterbank(8, 64, 100.0, 0.5, 50.0)


@query("WITH bank AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, {f}, {w!r}::DOUBLE)" for b, f, w in BANK) + f") t(bin, filter, weight)), {UN} SELECT vec_id, filter, round(sum(x * weight), 5) AS energy FROM u JOIN bank ON bin = pos GROUP BY 1, 2")
def filterbank_projection(spark, d):
    bank = spark.createDataFrame(BANK, "bin int, filter int, weight double")
    return prototypes.project(vectors(spark, d), bank, "vec_id", "embedding").select("vec_id", "filter", F.round("energy", 5).alias("energy"))


@query("SELECT vec_id, p::INTEGER AS pos, i::INTEGER AS dim, round(embedding[p * 16 + i + 1]::DOUBLE + CASE WHEN i % 2 = 0 THEN sin(p * exp(-ln(10000.0) * (i - i % 2) / 16)) ELSE cos(p * exp(-ln(10000.0) * (i - i % 2) / 16)) END, 6) + 0.0 AS value FROM embeddings, range(4) a(p), range(16) b(i)")
def positional_encoding(spark, d):
    """Vectors as four steps of sixteen dimensions with their place encoded; the encoding is as large as one vector."""
    own = vectors(spark, d).select("vec_id", F.posexplode("embedding").alias("at", "x"))
    at = F.broadcast(models.positional_encoding(spark, 4, 16).withColumn("at", F.col("pos") * 16 + F.col("dim")))
    return own.join(at, "at").select("vec_id", "pos", "dim", (F.round(F.col("x").cast("double") + F.col("value"), 6) + 0.0).alias("value"))


@query(f"""WITH dist AS (SELECT a.vec_id AS proto, b.vec_id AS base, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]) * (a.embedding[i]::DOUBLE - b.embedding[i])))) AS distance FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id < {CODES} AND b.vec_id >= {CODES}),
r AS (SELECT *, row_number() OVER (PARTITION BY proto ORDER BY distance, base) AS rank FROM dist), s AS (SELECT *, (distance - lag(distance) OVER w) * (rank + lag(rank) OVER w) / 2 AS part FROM r WINDOW w AS (PARTITION BY proto ORDER BY rank))
SELECT proto, round(coalesce(sum(part), 0), 4) AS integral FROM s GROUP BY 1""")
def expected_gradient_path(spark, d):
    v = vectors(spark, d)
    protos = v.where(F.col("vec_id") < CODES).select(F.col("vec_id").alias("proto"), F.col("embedding").alias("proto_vec"))
    bases = v.where(F.col("vec_id") >= CODES).select(F.col("vec_id").alias("base"), F.col("embedding").alias("base_vec"))
    ranked = prototypes.ranked_baselines(protos, bases)
    return prototypes.trapezoid(ranked, ["proto"], "rank", "distance", "rank").select("proto", F.round("integral", 4).alias("integral"))


@query(f"WITH {VQ}, j AS (SELECT code, label, count(*) AS n FROM vq JOIN embeddings USING (vec_id) GROUP BY 1, 2), a AS (SELECT sum(n * (n - 1) / 2) AS b, sum(n) AS t FROM j), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM j GROUP BY code)), k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM j GROUP BY label)) SELECT round((b - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) AS ari FROM a, r, k")
def rand_index(spark, d):
    own = vectors(spark, d).join(_vq(spark, d), "vec_id")
    return metrics.rand_index(own, "code", "label").select(r6("ari"))


@query(models.REGISTRY_SQL + f""", {EP}, w AS (SELECT subject_id, count(*) AS n, CASE WHEN count(*) >= 21 THEN 21 ELSE 0 END AS length, CASE WHEN subject_id % 2 = 0 THEN 3 ELSE 1 END AS channels FROM ep GROUP BY 1)
SELECT subject_id, n, name, checkpoint FROM w LEFT JOIN registry ON name = 'chambon2018' AND sequence_length = length AND in_channels = channels""")
def registry_lookup(spark, d):
    """For each record the model that its length and channels ask for; none for short ones."""
    own = epochs(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"))
    return models.looked_up(own, models.registry(spark), F.lit("chambon2018"), F.when(F.col("n") >= 21, 21).otherwise(0), F.when(F.col("subject_id") % 2 == 0, 3).otherwise(1)).select("subject_id", "n", "name", "checkpoint")


@query(f"WITH {PR}, a AS (SELECT subject_id AS epoch, avg((y = p)::INTEGER::DOUBLE) AS acc FROM pr GROUP BY 1) SELECT arg_max(epoch, (round(acc, 9), -epoch)) AS best, round(max(acc), 6) AS acc, max(epoch) AS last FROM a".replace("arg_max(epoch, (round(acc, 9), -epoch))", "(SELECT epoch FROM a ORDER BY round(acc, 9) DESC, epoch LIMIT 1)"))
def topk_checkpoint(spark, d):
    log = predictions(spark, d).groupBy(F.col("subject_id").alias("epoch")).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("acc"))
    return models.best_checkpoint(log, "epoch", "acc").select("best", r6("acc"), "last")


@query(f"WITH {PR} SELECT p, event_id FROM (SELECT p, event_id, row_number() OVER (PARTITION BY p ORDER BY (event_id * 7919) % 10007, event_id) AS r FROM pr WHERE y IN (0, 3) AND p IN (0, 3)) WHERE r <= 50")
def balanced_sample(spark, d):
    own = predictions(spark, d).where(F.col("y").isin(0, 3) & F.col("p").isin(0, 3))
    return prototypes.balanced(own, "p", 50, (F.col("event_id") * 7919) % 10007, "event_id").select("p", "event_id")


@query(f"WITH {PR} SELECT subject_id, count(*) AS n FROM pr WHERE y = p GROUP BY 1")
def correct_predictions(spark, d):
    return predictions(spark, d).where("y = p").groupBy("subject_id").agg(F.count("*").alias("n"))


@query(f"WITH {EP}, k AS (SELECT count(DISTINCT stage) AS k FROM ep) SELECT CASE WHEN k = 3 THEN (CASE stage WHEN 0 THEN 'W' WHEN 1 THEN 'NREM' ELSE 'REM' END) ELSE (CASE stage WHEN 0 THEN 'W' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN 'N3' ELSE 'REM' END) END AS name, count(*) AS n FROM ep, k GROUP BY 1")
def stage_names(spark, d):
    return models.stage_names(epochs(spark, d)).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, rn AS batch_row, rn // 32 AS batch FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS rn FROM lineitem)")
def sequential_batches(spark, d):
    return models.batches(table(spark, d, "lineitem"), F.col("l_orderkey") % 16, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 32).select("l_orderkey", "l_linenumber", "batch_row", "batch")


@query("SELECT count(*) AS n, count(DISTINCT dataset) AS datasets, sum(num_windows)::BIGINT AS windows FROM (SELECT 'events' AS dataset, user_id AS subject_id, count(*) AS num_windows FROM events GROUP BY 2 UNION ALL SELECT 'orders', o_custkey, count(*) FROM orders GROUP BY 2)")
def dataset_union(spark, d):
    a = table(spark, d, "events").groupBy(F.col("user_id").alias("subject_id")).agg(F.count("*").alias("num_windows")).withColumn("dataset", F.lit("events"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count("*").alias("num_windows")).withColumn("dataset", F.lit("orders"))
    return a.unionByName(b).agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("datasets"), F.sum("num_windows").alias("windows"))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INTEGER) AS number, lower(substr(c_name, 1, 2)) AS cohort, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS age FROM customer WHERE c_acctbal >= 0")
def parsed_subject_ids(spark, d):
    return models.parsed_ids(table(spark, d, "customer")).where("age IS NOT NULL")


@query(f"WITH {EP}, p AS (SELECT subject_id, avg(value) AS m, count(*) AS n FROM ep GROUP BY 1) SELECT subject_id, n < 60 AS short, round(m, 6) AS mean FROM p")
def short_record_warning(spark, d):
    own = epochs(spark, d).groupBy("subject_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return own.select("subject_id", (F.col("n") < 60).alias("short"), r6("mean"))


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]) / 64, 6) + 0.0 AS pooled, pos::INTEGER AS pos, round(embedding[pos // 2 + 1]::DOUBLE, 6) + 0.0 AS stretched FROM embeddings, range(128) t(pos)")
def pooled_and_stretched(spark, d):
    x = F.col("embedding").cast("array<double>")
    pooled = F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / 64, 6) + 0.0
    own = vectors(spark, d).select("vec_id", "label", pooled.alias("pooled"), F.posexplode(models.stretched(x, 2)).alias("pos", "v"))
    return own.select("vec_id", "label", "pooled", "pos", (F.round("v", 6) + 0.0).alias("stretched"))


# --- iterative models: no SQL ---


@query()
def mid_label_baseline(spark, d):
    return models.middle_label_accuracy(epochs(spark, d))


@query()
def kmeans_rand_index(spark, d):
    return models.kmeans_rand(vectors(spark, d), range(2, 10))


@query()
def pca_projection(spark, d):
    return models.pca(vectors(spark, d), "vec_id", 2)
