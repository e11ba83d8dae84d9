"""Queries of model algebra, readers on rendered texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightloom.operators import hypnogram, layers
from nightloom.plans.catalogue import query
from nightloom.plans.surrogate import CODES, EP, epochs, vectors
from nightloom.sources import annotations

_UNIFORM = "((('0x' || substring(md5({}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("SELECT vec_id, pos::INTEGER AS pos, round(embedding[pos + 1]::DOUBLE * 1e6, 3) + 0.0 AS y FROM (SELECT vec_id, embedding, unnest(range(64)) AS pos FROM embeddings)")
def unit_scaling(spark, d):
    own = vectors(spark, d).select("vec_id", F.posexplode(layers.scaled_units(F.col("embedding").cast("array<double>"))).alias("pos", "v"))
    return own.select("vec_id", "pos", (F.round("v", 3) + 0.0).alias("y"))


@query("SELECT vec_id, bin::INTEGER AS bin, round(embedding[(vec_id % 8) * 8 + bin + 1]::DOUBLE, 6) + 0.0 AS y FROM (SELECT vec_id, embedding, unnest(range(8)) AS bin FROM embeddings)")
def sampled_frame_spectrum(spark, d):
    x = F.col("embedding").cast("array<double>")
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i == F.col("vec_id") % 8).cast("double"))
    own = vectors(spark, d).select("vec_id", F.posexplode(layers.sampled_frame(frames, mask)).alias("bin", "v"))
    return own.select("vec_id", "bin", (F.round("v", 6) + 0.0).alias("y"))


@query(f"""WITH {EP}, g AS (SELECT subject_id, epoch_idx, draw, value / 100 - ln(-ln({_UNIFORM.format("subject_id || '/' || epoch_idx || '/' || draw || '/0'")})) AS s FROM (SELECT *, unnest(range(3)) AS draw FROM ep))
SELECT subject_id, draw::INTEGER AS draw, arg_max(epoch_idx, s) AS epoch_idx FROM g GROUP BY 1, 2""")
def gumbel_selection(spark, d):
    own = epochs(spark, d).withColumn("score", F.col("value") / 100)
    return layers.gumbel_select(own, ["subject_id"], "score", "epoch_idx", 3)


_ACC = (0.9, 0.6, 0.75, 0.8)
_EDGES = [sum(1 - a for a in _ACC[: k + 1]) / sum(1 - a for a in _ACC) for k in range(3)]


@query(f"""WITH r AS (SELECT vec_id, channel, list_sum(embedding[channel * 16 + 1:channel * 16 + 16]::DOUBLE[]) AS v FROM (SELECT vec_id, embedding, unnest(range(4)) AS channel FROM embeddings)),
s AS (SELECT vec_id, channel, CASE WHEN {_UNIFORM.format("vec_id || '/row/0'")} < 0.5 THEN {" + ".join(f"({_UNIFORM.format("vec_id || '/' || channel || '/0'")} >= {e})::INTEGER" for e in _EDGES)} ELSE channel END AS source FROM r)
SELECT s.vec_id, s.channel::INTEGER AS channel, round(r.v, 6) + 0.0 AS v FROM s JOIN r ON r.vec_id = s.vec_id AND r.channel = s.source""")
def channels_dropout(spark, d):
    x = F.col("embedding").cast("array<double>")
    total = lambda c: F.aggregate(F.slice(x, 16 * c + 1, 16), F.lit(0.0), lambda a, v: a + v)
    rows = vectors(spark, d).select("vec_id", F.posexplode(F.array(*[total(c) for c in range(4)])).alias("channel", "v"))
    return layers.channels_dropped(rows, _ACC, "v", 0.5, "vec_id").select("vec_id", "channel", (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH {EP}, g AS (SELECT subject_id, epoch_idx AS rel_idx, list(value) OVER (PARTITION BY subject_id ORDER BY epoch_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS v FROM ep)
SELECT subject_id, rel_idx, c::INTEGER AS class, round((SELECT sum(v[i + 1] * ((i * 3 + c) % 5 - 2)) FROM (SELECT unnest(range(5)) AS i)) + c, 4) + 0.0 AS score FROM (SELECT *, unnest(range(3)) AS c FROM g WHERE len(v) = 5)""")
def sequence_head(spark, d):
    from nightloom.operators import sequences

    own = sequences.gathered(epochs(spark, d), "value", 5)
    scores = layers.linear_head(F.col("value"), [[(i * 3 + c) % 5 - 2 for i in range(5)] for c in range(3)], range(3))
    return own.select("subject_id", "rel_idx", F.posexplode(scores).alias("class", "s")).select("subject_id", "rel_idx", "class", (F.round("s", 4) + 0.0).alias("score"))


@query(f"""WITH v AS (SELECT vec_id // 16 AS batch, vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.batch, a.id AS a, a.label = b.label AS same, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.batch = b.batch AND a.id <> b.id),
m AS (SELECT batch, a, min(s) FILTER (same) AS low, max(s) FILTER (NOT same) AS high FROM p GROUP BY ALL),
k AS (SELECT p.* FROM p JOIN m USING (batch, a) WHERE CASE WHEN same THEN s - {layers.EPSILON} < high ELSE s + {layers.EPSILON} > low END),
t AS (SELECT x.batch, y.s - x.s + {layers.MARGIN} AS l FROM k x JOIN k y ON x.batch = y.batch AND x.a = y.a AND x.same AND NOT y.same),
n AS (SELECT batch, avg(sqrt(list_sum(list_transform(e, lambda z: z * z)))) AS norm FROM v GROUP BY 1), l AS (SELECT batch, count(*) AS triplets, avg(l) AS loss FROM t WHERE l > 0 GROUP BY 1)
SELECT n.batch, coalesce(triplets, 0) AS triplets, round(coalesce(loss, 0), 6) AS loss, round(norm, 6) AS norm FROM n LEFT JOIN l ON l.batch = n.batch""")
def triplet_loss(spark, d):
    own = vectors(spark, d).select(F.expr("vec_id div 16").alias("batch"), F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return layers.triplet_loss(own).select("batch", "triplets", F.round("loss", 6).alias("loss"), F.round("norm", 6).alias("norm"))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT p.vec_id AS proto, b.vec_id AS base, p.e AS pe, b.e AS be, list_distance(p.e, b.e) AS dist FROM v p JOIN v b ON p.vec_id < {CODES} AND b.vec_id >= {CODES}),
r AS (SELECT *, row_number() OVER (PARTITION BY proto ORDER BY dist, base) AS rank, first_value(be) OVER (PARTITION BY proto ORDER BY dist, base) AS x, count(*) OVER (PARTITION BY proto) - 1 AS points FROM d),
g AS (SELECT proto, rank, k, list_transform(range(1, 65), lambda i: x[i] * ((rank - 2 - k) / (points - 1)) - (1 - (rank - 2 - k) / (points - 1)) * be[i] - pe[i]) AS away, list_transform(range(1, 65), lambda i: x[i] - be[i]) AS j, 1.0 / (points - 1) AS dt FROM (SELECT *, unnest([0, 1]) AS k FROM r WHERE rank > 2))
SELECT proto, (count(*) // 2)::BIGINT AS steps, round(sum(-list_dot_product(away, j) / sqrt(list_dot_product(away, away)) * dt / 2), 4) + 0.0 AS integral FROM g GROUP BY 1""")
def expected_gradients(spark, d):
    v = vectors(spark, d)
    protos = v.where(F.col("vec_id") < CODES).select(F.col("vec_id").alias("proto"), F.col("embedding").alias("proto_vec"))
    bases = v.where(F.col("vec_id") >= CODES).select(F.col("vec_id").alias("base"), F.col("embedding").alias("base_vec"))
    return layers.expected_gradients(protos, bases).select("proto", "steps", (F.round("integral", 4) + 0.0).alias("integral"))


# --- readers: texts are rendered from the tables, and parsed again ---


def _rendered(rows, line, head: str = "", last: str = ""):
    """(path, n, line) of a file for each subject, from its epochs in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("epoch_idx", line.alias("line")))), lambda s: s["line"]), "\n")
    files = rows.groupBy(F.concat(F.lit("s/"), F.col("subject_id").cast("string")).alias("path")).agg(F.concat(F.lit(head), text, F.lit(last)).alias("text"))
    return annotations.lines(files)


_PATH = "'s/' || subject_id AS path"


@query(f"WITH {EP} SELECT {_PATH}, epoch_idx, CASE stage WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS stage FROM ep")
def rodent_table(spark, d):
    own = epochs(spark, d)
    return annotations.parse_rodent(_rendered(own, F.concat_ws("\t", "epoch_idx", F.lit("a"), F.lit("b"), F.lit("c"), F.col("stage") + 1), "".join(f"preamble {i}\n" for i in range(9)) + "No\ta\tb\tc\tstage\n"))


@query(f"WITH {EP} SELECT {_PATH}, epoch_idx, CASE WHEN stage = 4 THEN 3 ELSE stage END AS stage FROM ep")
def stage_list(spark, d):
    return annotations.parse_stages(_rendered(epochs(spark, d), F.concat_ws("\t", F.col("epoch_idx") + 17, "stage"), "Epoch\tStage\n"))


@query(f"WITH {EP} SELECT {_PATH}, epoch_idx, stage FROM ep")
def run_length_hypnogram(spark, d):
    letter = F.element_at(F.array(*map(F.lit, ("W", "N1", "N2", "N3", "REM"))), F.col("stage") + 1)
    return annotations.parse_run_length(_rendered(epochs(spark, d), F.concat_ws(",", F.col("epoch_idx") * 30, F.lit(30), letter)))


@query(f"WITH {EP} SELECT {_PATH}, epoch_idx, CASE WHEN stage > 2 THEN 3 ELSE stage END AS stage FROM ep")
def scorer_letters(spark, d):
    letter = F.element_at(F.array(*map(F.lit, ("w", "n", "r", "1", "3"))), F.col("stage") + 1)
    return annotations.parse_letters(_rendered(epochs(spark, d), F.concat_ws(",", "epoch_idx", F.lit("w"), letter)), 2)


@query(f"""WITH {EP}, m AS (SELECT *, min(CASE WHEN value < 20 THEN epoch_idx END) OVER (PARTITION BY subject_id) AS off, max(epoch_idx) OVER (PARTITION BY subject_id) AS last FROM ep),
k AS (SELECT * FROM m WHERE (off IS NULL OR epoch_idx > off) AND epoch_idx < last)
SELECT {_PATH}, row_number() OVER (PARTITION BY subject_id ORDER BY epoch_idx) - 1 AS epoch_idx, CASE WHEN value < 20 THEN -1 ELSE stage END AS stage, min(epoch_idx * 30.0) OVER (PARTITION BY subject_id) AS start_s, max(epoch_idx * 30.0 + 30) OVER (PARTITION BY subject_id) AS end_s FROM k""")
def interval_scores(spark, d):
    label = F.when(F.col("value") < 20, "LIGHTS_OFF").otherwise(F.element_at(F.array(*map(F.lit, ("Wake", "S1", "S2", "S3", "REM"))), F.col("stage") + 1))
    own = _rendered(epochs(spark, d), F.concat_ws("\t", F.col("epoch_idx") * 30, F.col("epoch_idx") * 30 + 30, label))
    return annotations.parse_intervals(own).join(annotations.scored_span(own), "path")


@query(f"WITH {EP} SELECT {_PATH}, epoch_idx, CASE stage WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE stage END AS stage FROM ep")
def scored_events(spark, d):
    own = epochs(spark, d).select(F.concat(F.lit("s/"), F.col("subject_id").cast("string")).alias("path"), F.lit("Stages|Stages").alias("EventType"), F.concat(F.lit("Stage "), F.col("stage").cast("string"), F.lit("|"), F.col("stage").cast("string")).alias("EventConcept"), (F.col("epoch_idx") * 30.0).alias("Start"), F.lit(30.0).alias("Duration"))
    noise = own.withColumn("EventType", F.lit("Arousals|Arousals"))
    return annotations.parse_events(own.unionByName(noise)).withColumn("stage", hypnogram.recode(F.col("stage"), hypnogram.RK_TO_FIVE | {4: 3}))


@query(f"WITH {EP} SELECT {_PATH}, epoch_idx, stage FROM ep")
def change_point_log(spark, d):
    """An event log that starts at eight in the evening; each change of stage is a line, and a last line ends the night."""
    from pyspark.sql import Window as W

    own = epochs(spark, d)
    w = W.partitionBy("subject_id").orderBy("epoch_idx")
    first = F.col("epoch_idx") == 0
    changed = own.withColumn("_l", F.lag("stage").over(w)).withColumn("_end", F.max("epoch_idx").over(W.partitionBy("subject_id")) + 1)
    clock = lambda s: F.concat_ws(":", F.lpad(F.expr(f"cast(({s} div 3600 + 20) % 24 as string)"), 2, "0"), F.lpad(F.expr(f"cast({s} div 60 % 60 as string)"), 2, "0"), F.lpad(F.expr(f"cast({s} % 60 as string)"), 2, "0"))
    name = F.element_at(F.array(*map(F.lit, ("W", "N1", "N2", "N3", "R"))), F.col("stage") + 1)
    at = "(epoch_idx * 30)"
    mark = F.concat(clock(at), F.lit("\tSTAGE - "), name)
    start = F.when(first, F.concat(clock(at), F.lit("\tSTART RECORDING\n"))).otherwise(F.lit(""))
    end = F.when(F.col("epoch_idx") == F.col("_end") - 1, F.concat(F.lit("\n"), clock("(epoch_idx * 30 + 30)"), F.lit("\tend"))).otherwise(F.lit(""))
    rows = changed.where(first | (F.col("stage") != F.col("_l")) | (F.col("epoch_idx") == F.col("_end") - 1)).withColumn("line", F.concat(start, mark, end))
    return annotations.parse_log(_rendered(rows, F.col("line")))
