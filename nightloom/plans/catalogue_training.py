"""Queries of training: optimiser steps, losses, attributions and codebook steps of stated models, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nightloom.functions import udtfs
from nightloom.plans.catalogue import query
from nightloom.plans.surrogate import CODES, EP, codebook, epochs, vectors
from nightloom.training import codebooks, explain, loop, nets
from nightloom.training.optim import Adam

_STEPS, _RATE, _DECAY = 3, 0.05, 0.01
_E = "e AS (SELECT row_number() OVER () AS rk, vec_id, label AS y, list_append(embedding::DOUBLE[], 1.0) AS x FROM embeddings)"
_WEIGHT = "((c * 7 + i * 3) % 11 - 5) / 50.0"


def _linear() -> tuple[nets.Dense, np.ndarray]:
    """Ten scores from 64 components; the bias counts as component 64."""
    w = np.array([[((c * 7 + i * 3) % 11 - 5) / 50.0 for i in range(65)] for c in range(10)])
    return nets.Dense((64, 10)), np.concatenate([w[:, :64].ravel(), w[:, 64]])


def _examples(spark, d):
    return vectors(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


def _adam_sql(t: int) -> str:
    g = f"(g.g + {_DECAY} * w)"
    m, v = f"(0.9 * m + 0.1 * {g})", f"(0.999 * v + 0.001 * {g} * {g})"
    return f"""z{t} AS MATERIALIZED (SELECT rk, y, c, sum(x[i + 1] * w) AS z FROM e, w{t} GROUP BY ALL),
q{t} AS (SELECT rk, y, c, exp(z - max(z) OVER (PARTITION BY rk)) AS q FROM z{t}),
d{t} AS MATERIALIZED (SELECT rk, c, q / sum(q) OVER (PARTITION BY rk) - (c = y)::INTEGER AS d FROM q{t}),
g{t} AS (SELECT c, i, sum(d * x[i + 1]) / (SELECT count(*) FROM e) AS g FROM d{t} JOIN e USING (rk), range(65) r(i) GROUP BY c, i),
w{t + 1} AS MATERIALIZED (SELECT c, i, {m} AS m, {v} AS v, w - {_RATE} * ({m} / {1 - 0.9 ** (t + 1)!r}) / (sqrt({v} / {1 - 0.999 ** (t + 1)!r}) + 1e-8) AS w FROM w{t} JOIN g{t} g USING (c, i))"""


@query(f"""WITH {_E}, w0 AS (SELECT c, i, {_WEIGHT} AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM range(10) a(c), range(65) b(i)),
{", ".join(_adam_sql(t) for t in range(_STEPS))}
SELECT c::INTEGER AS class, i::INTEGER AS feature, round(w, 6) + 0.0 AS weight FROM w{_STEPS}""")
def train_steps(spark, d):
    """Weights of a softmax head after three steps of Adam over all vectors."""
    rows, (net, params), adam = _examples(spark, d), _linear(), Adam(_RATE, _DECAY)
    for _ in range(_STEPS):
        n, _, total = loop.gradient_sums(rows, net, params)
        params = adam.step(params, total / max(n, 1))
    (w, b) = net.layers(params)[0]
    out = [(c, i, float(v)) for c in range(10) for i, v in enumerate([*w[c], b[c]])]
    return spark.createDataFrame(out, "class int, feature int, weight double").select("class", "feature", (F.round("weight", 6) + 0.0).alias("weight"))


@query(f"""WITH {_E}, w AS (SELECT c, i, {_WEIGHT} AS w FROM range(10) a(c), range(65) b(i)),
z AS (SELECT rk, vec_id, y, c, sum(x[i + 1] * w) AS z FROM e, w GROUP BY ALL),
r AS (SELECT vec_id % 2 AS dataset, vec_id % 7 AS record, max(z) + ln(sum(exp(z - (SELECT max(z) FROM z)))) + (SELECT max(z) FROM z) - max(z) - max(CASE WHEN c = y THEN z END) AS loss, (arg_max(c, (round(z, 12), -c)) = any_value(y))::INTEGER AS hit FROM z GROUP BY rk, vec_id),
s AS (SELECT dataset, record, avg(loss) AS loss, avg(hit) AS acc FROM r GROUP BY 1, 2)
SELECT dataset, count(*) AS records, round(avg(loss), 6) AS loss, round(avg(acc), 6) AS acc FROM s GROUP BY 1""")
def loss_by_dataset(spark, d):
    net, params = _linear()
    rows = _examples(spark, d).withColumn("dataset", F.col("vec_id") % 2).withColumn("record", F.col("vec_id") % 7)
    return loop.test(rows, net, params).select("dataset", "records", F.round("loss", 6).alias("loss"), F.round("acc", 6).alias("acc"))


_POINTS, _BASES, _HIDDEN = 8, 4, 3
_NODES = ", ".join(f"({t!r}::DOUBLE, {w!r}::DOUBLE)" for t, w in zip(*(a.tolist() for a in explain.nodes(_POINTS)), strict=True))
_W1, _W2 = "((h * 5 + i * 3) % 7 - 3) / 4.0", "((c * 3 + h) % 5 - 2) / 2.0"


@query(f"""WITH {_E}, t(t, k) AS (VALUES {_NODES}), h AS (SELECT h FROM range({_HIDDEN}) r(h)), w1 AS MATERIALIZED (SELECT h, i, {_W1} AS w FROM h, range(64) r(i)),
a AS MATERIALIZED (SELECT rk, vec_id, y, h, sum(x[i + 1] * w) AS a FROM e, w1 GROUP BY ALL),
g AS MATERIALIZED (SELECT p.rk, b.rk AS base, p.h, sum(k * (1 - tanh((1 - t) * b.a + t * p.a + p.h / 4.0) ** 2)) * any_value(((p.y * 3 + p.h) % 5 - 2) / 2.0) AS g FROM a p JOIN a b ON b.h = p.h AND b.vec_id < {_BASES}, t GROUP BY ALL),
s AS (SELECT rk, base, i, sum(g * w) AS s FROM g JOIN w1 USING (h) GROUP BY ALL)
SELECT e.vec_id, i::INTEGER AS pos, round(avg((e.x[i + 1] - b.x[i + 1]) * s), 6) + 0.0 AS attribution FROM s JOIN e USING (rk) JOIN e b ON b.rk = base GROUP BY e.rk, e.vec_id, i""")
def path_attributions(spark, d):
    """Expected gradients of the label's score of a net with a hidden layer, from four baselines."""
    net = nets.Dense((64, _HIDDEN, 10))
    w1 = [[((h * 5 + i * 3) % 7 - 3) / 4.0 for i in range(64)] for h in range(_HIDDEN)]
    w2 = [[((c * 3 + h) % 5 - 2) / 2.0 for h in range(_HIDDEN)] for c in range(10)]
    params = np.concatenate([np.ravel(w1), [h / 4.0 for h in range(_HIDDEN)], np.ravel(w2), np.zeros(10)])
    rows = _examples(spark, d)
    base = explain.collected_baselines(rows.where(F.col("vec_id") < _BASES), order="vec_id")
    own = explain.expected_gradients(rows, net, params, base, _POINTS, target="y")
    return own.select("vec_id", F.posexplode("attributions").alias("pos", "a")).select("vec_id", "pos", (F.round("a", 6) + 0.0).alias("attribution"))


@query(f"""WITH b AS (SELECT vec_id::INTEGER AS code, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < {CODES}), x AS (SELECT row_number() OVER () AS rk, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT rk, code, round(list_sum(list_transform(range(1, 65), lambda i: (x[i] - v[i]) ** 2)), 12) AS d FROM x, b),
n AS MATERIALIZED (SELECT rk, arg_min(code, (d, code)) AS code, min(d) AS d FROM d GROUP BY 1),
c AS (SELECT code, count(*) AS n FROM n GROUP BY 1), s AS (SELECT code, i, sum(x[i]) AS s FROM n JOIN x USING (rk), range(1, 65) r(i) GROUP BY ALL),
l AS (SELECT 0.25 * avg(d) AS loss FROM n)
SELECT b.code, (r.i - 1)::INTEGER AS pos, round((0.8 + 0.2 * coalesce(n, 0))::DOUBLE, 6) AS number, round((0.8 * v[r.i] + 0.2 * coalesce(s, 0)) / (0.8 + 0.2 * coalesce(n, 0)), 6) + 0.0 AS value, round(loss, 6) AS loss
FROM b CROSS JOIN range(1, 65) r(i) LEFT JOIN c ON c.code = b.code LEFT JOIN s ON s.code = b.code AND s.i = r.i CROSS JOIN l""")
def codebook_step(spark, d):
    """A codebook after one step over all vectors, and the commitment loss before it."""
    start = [list(r["code_vec"]) for r in codebook(spark, d).orderBy("code").collect()]  # as many as the model has codes
    book, loss = codebooks.step(_examples(spark, d), codebooks.Book(np.array(start)))
    out = [(c, i, float(book.number[c]), float(v), loss) for c in range(len(start)) for i, v in enumerate(book.codes[c])]
    own = spark.createDataFrame(out, "code int, pos int, number double, value double, loss double")
    return own.select("code", "pos", F.round("number", 6).alias("number"), (F.round("value", 6) + 0.0).alias("value"), F.round("loss", 6).alias("loss"))


@query(f"""WITH {EP}, n AS (SELECT subject_id, count(*) AS n FROM ep GROUP BY 1), r AS (SELECT subject_id, unnest(range(greatest(n - 5, 0) + 1)) AS rel_idx FROM n), o AS (SELECT *, unnest(range(5)) AS off FROM r)
SELECT o.subject_id AS record, rel_idx::INTEGER AS rel_idx, off::INTEGER AS off, (rel_idx + off)::INTEGER AS epoch_idx, coalesce(stage, 5) AS stage, stage IS NULL AS padded FROM o LEFT JOIN ep ON ep.subject_id = o.subject_id AND ep.epoch_idx = rel_idx + off""")
def sequences_from_sql(spark, d):
    """Sequences by the table function, called from SQL."""
    own = epochs(spark, d).select("subject_id", "epoch_idx", "stage")
    udtfs.register(spark, own.schema["subject_id"].dataType.simpleString())
    own.createOrReplaceTempView("record_sequences_input")
    return spark.sql("SELECT * FROM record_sequences(TABLE(record_sequences_input) PARTITION BY (subject_id), 5)")
