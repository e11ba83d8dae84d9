"""More of the catalogue: records, pairing, sampling, logs, and use of folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.operators import hypnogram, metrics, prototypes, records, splits, voting
from nightloom.plans.catalogue import FOLD, UN, query, r6
from nightloom.plans.surrogate import CODES, EP, PR, SUBJ, epochs, predictions, table, vectors


@query("WITH c AS (SELECT x AS record FROM (SELECT unnest(range(83)) AS x) WHERE x NOT IN (39, 68, 69, 78, 79)) SELECT record::INTEGER AS record, count(event_id) AS epochs FROM c LEFT JOIN events ON user_id = record GROUP BY 1")
def constant_subjects(spark, d):
    """The epochs that each subject of the constant list has; a subject may have none."""
    n = epochs(spark, d).groupBy("subject_id").agg(F.count("*").alias("epochs"))
    return records.constant_subjects(spark).join(n, F.col("record") == F.col("subject_id"), "left").select("record", F.coalesce("epochs", F.lit(0)).alias("epochs"))


@query("SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS epoch_idx_all FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def concat_recordings(spark, d):
    own = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = own.withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return records.concatenated(own, ["o_custkey"], "o_orderkey", "at").select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "epoch_idx_all")


@query(f"WITH {EP}, h AS (SELECT subject_id, epoch_idx, CASE WHEN value < 40 THEN 0 ELSE stage END AS stage FROM ep), b AS (SELECT subject_id, min(CASE WHEN stage <> 0 THEN epoch_idx END) - 3 AS lo, max(CASE WHEN stage <> 0 THEN epoch_idx END) + 3 AS hi FROM h GROUP BY 1) SELECT h.* FROM h JOIN b USING (subject_id) WHERE lo IS NULL OR epoch_idx BETWEEN lo AND hi")
def wake_crop(spark, d):
    own = epochs(spark, d).select("subject_id", "epoch_idx", F.when(F.col("value") < 40, 0).otherwise(F.col("stage")).alias("stage"))
    return records.crop_wake(own, 3)


@query(f"WITH {EP}, r AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM ep) SELECT subject_id, epoch_idx, stage FROM r WHERE epoch_idx >= 2 AND epoch_idx < n - 3")
def drop_record_ends(spark, d):
    return records.drop_ends(epochs(spark, d), ["subject_id"], ["epoch_idx"], 2, 3).select("subject_id", "epoch_idx", "stage")


@query(f"WITH {EP} SELECT min(stage) AS low, max(stage) AS high, count(DISTINCT subject_id) AS subjects FROM ep")
def label_range_check(spark, d):
    return records.validated(epochs(spark, d), 0, 4).agg(F.min("stage").alias("low"), F.max("stage").alias("high"), F.countDistinct("subject_id").alias("subjects"))


@query(f"WITH {EP} SELECT subject_id, epoch_idx, stage FROM ep ORDER BY md5(subject_id || '/' || epoch_idx), subject_id, epoch_idx LIMIT 4000")
def visual_sample(spark, d):
    return records.first_by_hash(epochs(spark, d), 4000, "subject_id", "epoch_idx").select("subject_id", "epoch_idx", "stage")


@query(f"""WITH {EP}, h AS (SELECT subject_id, epoch_idx, md5(subject_id || '/' || epoch_idx) AS h FROM ep), s AS (SELECT *, ('0x' || substring(h, 1, 8))::BIGINT % 8 AS shard FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY h, subject_id, epoch_idx) - 1 AS place FROM s) SELECT subject_id, epoch_idx, shard, place // 32 AS batch, place FROM r""")
def shuffled_batches(spark, d):
    return records.shuffled_batches(epochs(spark, d), 32, 8, "subject_id", "epoch_idx").select("subject_id", "epoch_idx", "shard", "batch", "place")


@query("WITH lg AS (SELECT 'version_' || user_id % 12 AS version, event_id % 50 AS epoch FROM events) SELECT version, max(epoch) AS epoch FROM lg WHERE version = (SELECT max(version) FROM lg) GROUP BY 1")
def resume_epoch(spark, d):
    return records.resume_epoch(table(spark, d, "events").select(F.concat(F.lit("version_"), F.col("user_id") % 12).alias("version"), (F.col("event_id") % 50).alias("epoch")))


@query(f"WITH {EP} SELECT grp, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM ep GROUP BY 1")
def online_variance_merge(spark, d):
    v = F.col("value")
    parts = epochs(spark, d).groupBy("grp", "subject_id").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count("*")).alias("m2"))
    return records.merged_statistics(parts, ["grp"]).select("grp", "n", r6("mean"), r6("std"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 90)::DOUBLE END AS age FROM customer WHERE c_custkey % 3 <> 0")
def age_from_text(spark, d):
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("unknown")).otherwise(F.concat((F.col("c_custkey") % 90).cast("string"), F.lit("yr")))
    return records.with_age(table(spark, d, "customer").withColumn("age_text", text)).select("c_custkey", "age")


@query(f"WITH {EP}, {UN}, sp AS (SELECT vec_id, sum(x) AS total FROM u GROUP BY 1) SELECT subject_id, epoch_idx, stage, round(total, 4) AS total FROM ep JOIN sp ON vec_id = event_id")
def parallel_views(spark, d):
    spectra = vectors(spark, d).select(F.col("vec_id").alias("event_id"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
    return records.parallel(epochs(spark, d), spectra, ["event_id"]).select("subject_id", "epoch_idx", "stage", "total")


@query(f"WITH {EP}, iv AS (SELECT l_orderkey, l_orderkey % 150 AS subject_id, l_linenumber * 7 AS a, l_linenumber * 7 + CAST(l_quantity AS INTEGER) AS b FROM lineitem) SELECT l_orderkey, count(*) AS n, sum(stage)::BIGINT AS stages FROM iv JOIN ep ON iv.subject_id = ep.subject_id AND epoch_idx >= a AND epoch_idx < b GROUP BY 1")
def interval_range_join(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 150).alias("subject_id"), (F.col("l_linenumber") * 7).alias("a"), (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")).alias("b"))
    met = records.within(own, epochs(spark, d).select("subject_id", "epoch_idx", "stage"), ["subject_id"], "a", "b", "epoch_idx")
    return met.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("stage").alias("stages"))


@query("WITH rec AS (SELECT p_partkey, 'a/' || p_brand || '_' || p_partkey || '.edf' AS path FROM part), sco AS (SELECT 'b/' || p_brand || '_' || p_partkey || '-nsrr.xml' AS path FROM part WHERE p_partkey % 2 = 0) SELECT rec.path AS recording, sco.path AS scoring, p_brand || '_' || rec.p_partkey AS record_id FROM rec JOIN part USING (p_partkey) JOIN sco ON sco.path = 'b/' || p_brand || '_' || rec.p_partkey || '-nsrr.xml'")
def recording_pairs(spark, d):
    from nightloom.sources import annotations

    p = table(spark, d, "part")
    name = F.concat_ws("_", "p_brand", "p_partkey")
    return annotations.paired(p.select(F.concat(F.lit("a/"), name, F.lit(".edf")).alias("path")), p.where("p_partkey % 2 = 0").select(F.concat(F.lit("b/"), name, F.lit("-nsrr.xml")).alias("path")))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_visit FROM orders WHERE o_orderpriority LIKE '%1%' AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def visit_and_group_filter(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").contains("1") & F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_visit"))


@query("SELECT vec_id, round(embedding[20]::DOUBLE, 6) AS centre, 63 AS bins, round(list_sum(embedding[1:63]::DOUBLE[]), 4) AS total FROM embeddings")
def centre_and_crop(spark, d):
    x = F.slice("embedding", 1, 63)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return vectors(spark, d).select("vec_id", F.round(F.element_at("embedding", 39 // 2 + 1).cast("double"), 6).alias("centre"), F.size(x).alias("bins"), F.round(total, 4).alias("total"))


@query(f"WITH {FOLD}, pr AS (SELECT *, stage AS y, CASE WHEN CAST(round(value * 100) AS BIGINT) % 5 = 0 THEN (stage + 1) % 5 ELSE stage END AS p FROM ep) SELECT split, count(*) AS n, round(avg((y = p)::INTEGER::DOUBLE), 6) AS acc FROM pr JOIN fd USING (subject_id) GROUP BY 1")
def metrics_by_split(spark, d):
    folds = splits.rank_folds(epochs(spark, d), (F.col("subject_id") * 7919) % 10007)
    return metrics.classification(splits.with_split(predictions(spark, d), folds), ["split"]).select("split", "n", r6("acc"))


@query("SELECT least(min(n), 100) AS folds FROM (SELECT user_id % 3 AS dataset, count(DISTINCT user_id % 7) AS n FROM events GROUP BY 1)")
def shared_folds(spark, d):
    n = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("dataset")).agg(F.countDistinct(F.col("user_id") % 7).alias("n"))
    return n.agg(F.least(F.min("n"), F.lit(100)).alias("folds"))


@query(f"WITH {EP}, c AS (SELECT subject_id, floor(value)::INTEGER % {CODES} AS code, count(*) AS n FROM ep GROUP BY 1, 2) SELECT subject_id, code, n, round(n / sum(n) OVER (PARTITION BY subject_id), 6) AS share FROM c")
def night_probabilities(spark, d):
    own = epochs(spark, d).select("subject_id", (F.floor("value") % CODES).cast("int").alias("code"))
    return prototypes.shares_within(own, "subject_id", "code").select("subject_id", "code", "n", r6("share"))


@query(f"WITH {PR} SELECT y, p, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM pr GROUP BY 1, 2")
def row_normalised_confusion(spark, d):
    return prototypes.shares_within(predictions(spark, d), "y", "p").select("y", "p", "n", r6("share"))


@query(f"WITH {SUBJ}, m AS (SELECT subject_id, epoch_idx, stage, CASE WHEN stage = 4 THEN 2 WHEN stage = 0 THEN 0 ELSE 1 END AS three FROM ep) SELECT three AS stage, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM m GROUP BY 1")
def rodent_stages(spark, d):
    own = epochs(spark, d).withColumn("three", hypnogram.recode(F.col("stage"), {0: 0, 4: 2}, 1))
    return own.groupBy(F.col("three").alias("stage")).agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("subjects"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_of_neighbours(spark, d):
    v = vectors(spark, d)
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("_x")), v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("_y"))
    return a.join(b, "a").select("a", "b", F.round(prototypes.cosine(F.col("_x"), F.col("_y")), 6).alias("cosine"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS top FROM embeddings")
def argmax_class(spark, d):
    return vectors(spark, d).select("vec_id", voting.argmax(F.col("embedding")).alias("top"))


@query("SELECT c_nationkey AS dataset, c_custkey AS subject_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) - 1 AS record FROM customer")
def dense_ids(spark, d):
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_name", "c_custkey")) - 1
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_custkey").alias("subject_id"), at.alias("record"))
