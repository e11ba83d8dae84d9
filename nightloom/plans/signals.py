"""Queries of the signal kernels, and the same results from the textbook sums in SQL: direct transforms and convolutions over
rows (vec_id, pos, x) and small tables of weights, nothing taken from the kernels but their parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.functions import dsp
from nightloom.plans.catalogue import query
from nightloom.plans.surrogate import vectors

RATE, N = 64.0, 64  # an embedding is a signal of one second
PI = "pi()"


def _signals(spark, d) -> DataFrame:
    return vectors(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def _long(rows: DataFrame, digits: int) -> DataFrame:
    """One row for each value of an array column y."""
    return rows.select("vec_id", F.posexplode("y").alias("pos", "v")).select("vec_id", "pos", (F.round("v", digits) + 0.0).alias("y"))


#: Rows of the signals.
_U = f"u AS (SELECT vec_id, pos, embedding[pos + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range({N})) AS pos FROM embeddings))"


def _weighted(kernel: str, digits: int) -> str:
    """Signals times a table k (t, pos, w): y at t is the sum of x at pos times w."""
    return f"WITH {_U}, {kernel} SELECT vec_id, t::INTEGER AS pos, round(sum(x * w), {digits}) + 0.0 AS y FROM u JOIN k USING (pos) GROUP BY vec_id, t"


# The signal's spectrum up to its middle, read at other times; the middle itself counts half on each side.
_RESAMPLE = f"""k AS (SELECT t, pos, (1 + cos({PI} * (t * {N} / 100.0 - pos)) + 2 * (SELECT sum(cos(2 * {PI} * f * (t / 100.0 - pos / {N}.0))) FROM (SELECT unnest(range(1, {N // 2})) AS f))) / {N} AS w
 FROM (SELECT unnest(range(100)) AS t), (SELECT unnest(range({N})) AS pos))"""


@query(_weighted(_RESAMPLE, 6))
def fft_resample(spark, d):
    return _long(_signals(spark, d).select("vec_id", dsp.resample_column("x", RATE, 100.0).alias("y")), 6)


# A sinc of the wider rate under a Kaiser window of 5 (Bessel's series), 10 zero crossings to each side, of sum 25.
_BESSEL = "(SELECT sum(pow(({}) * ({}) / 4, i) / pow(gamma(i + 1), 2)) FROM (SELECT unnest(range(30)) AS i))"
_KAISER = _BESSEL.replace("{}", "5 * sqrt(1 - (m / 250.0) * (m / 250.0))")
_POLYPHASE = f"""h AS (SELECT m, (CASE WHEN m = 0 THEN 1 ELSE sin({PI} * m / 25.0) / ({PI} * m / 25.0) END) * {_KAISER} AS h FROM (SELECT unnest(range(-250, 251)) AS m)),
k AS (SELECT t, pos, h * 25 / (SELECT sum(h) FROM h) AS w FROM (SELECT unnest(range(100)) AS t), (SELECT unnest(range({N})) AS pos) JOIN h ON m = t * 16 - pos * 25)"""


@query(_weighted(_POLYPHASE.replace("FROM (SELECT unnest(range(100)) AS t), (SELECT unnest(range(64)) AS pos) JOIN h ON", "FROM (SELECT unnest(range(100)) AS t) CROSS JOIN (SELECT unnest(range(64)) AS pos) JOIN h ON"), 6))
def polyphase_resample(spark, d):
    return _long(_signals(spark, d).select("vec_id", dsp.polyphase_column("x", 25, 16).alias("y")), 6)


def _fir_sql(taps: int, low: float, high: float, digits: int) -> str:
    """Windowed sinc with gain 1 in the middle of its band; forward and backward over an oddly extended signal, each pass as
    if its first value had always been."""
    a, b, half, n = 2 * low / RATE, 2 * high / RATE, (taps - 1) // 2, min(3 * taps, N - 1)
    sinc = lambda e: f"(CASE WHEN m = 0 THEN {e} ELSE sin({PI} * {e} * m) / ({PI} * m) END)"
    once = lambda source, name: f"{name} AS (SELECT vec_id, i.ix, sum(h * s.x) AS x FROM (SELECT unnest(range({N + 2 * n})) AS ix) i, h JOIN {source} s ON s.ix = greatest(i.ix - m - {half}, 0) GROUP BY ALL)".replace(
        " i, h JOIN", " i CROSS JOIN h JOIN"
    )
    return f"""WITH {_U},
g AS (SELECT m, ({sinc(b)} - {sinc(a)}) * (0.54 - 0.46 * cos(2 * {PI} * (m + {half}) / {taps - 1})) AS h FROM (SELECT unnest(range({-half}, {half + 1})) AS m)),
h AS (SELECT m, h / (SELECT sum(h * cos({PI} * m * {(a + b) / 2})) FROM g) AS h FROM g),
e AS (SELECT vec_id, i.ix, CASE WHEN i.ix < {n} THEN 2 * f.x - u.x WHEN i.ix >= {N + n} THEN 2 * l.x - u.x ELSE u.x END AS x FROM (SELECT unnest(range({N + 2 * n})) AS ix) i
 JOIN u ON pos = CASE WHEN i.ix < {n} THEN {n} - i.ix WHEN i.ix >= {N + n} THEN {2 * N + n - 2} - i.ix ELSE i.ix - {n} END JOIN (SELECT vec_id, x FROM u WHERE pos = 0) f USING (vec_id) JOIN (SELECT vec_id, x FROM u WHERE pos = {N - 1}) l USING (vec_id)),
{once("e", "p")}, r AS (SELECT vec_id, {N + 2 * n - 1} - ix AS ix, x FROM p), {once("r", "q")}
SELECT vec_id, ({N + 2 * n - 1} - ix - {n})::INTEGER AS pos, round(x, {digits}) + 0.0 AS y FROM q WHERE ix >= {n} AND ix < {N + n}"""


@query(_fir_sql(15, 0.3, 20.0, 6))
def fir_bandpass(spark, d):
    return _long(_signals(spark, d).select("vec_id", dsp.fir_bandpass_column("x", RATE, 0.3, 20.0, 15).alias("y")), 6)


def _periodogram(width: int, overlap: int, n_fft: int) -> str:
    """pg (vec_id, frame, bin, power): frames less their mean under a periodic Hamming window, by the sum of the transform."""
    hop = width - overlap
    count = (N - overlap) // hop
    return f"""{_U}, fr AS (SELECT vec_id, f.frame, pos - f.frame * {hop} AS ix, x FROM (SELECT unnest(range({count})) AS frame) f JOIN u ON pos >= f.frame * {hop} AND pos < f.frame * {hop} + {width}),
wd AS (SELECT vec_id, frame, ix, (x - avg(x) OVER (PARTITION BY vec_id, frame)) * (0.54 - 0.46 * cos(2 * {PI} * ix / {width})) AS x FROM fr),
tr AS (SELECT bin, ix, cos(2 * {PI} * bin * ix / {n_fft}) AS c, sin(2 * {PI} * bin * ix / {n_fft}) AS s FROM (SELECT unnest(range({n_fft // 2 + 1})) AS bin), (SELECT unnest(range({width})) AS ix)),
pg AS (SELECT vec_id, frame, bin, (CASE WHEN bin IN (0, {n_fft // 2}) THEN 1 ELSE 2 END) * (pow(sum(x * c), 2) + pow(sum(x * s), 2)) / ({RATE} * (SELECT sum(pow(0.54 - 0.46 * cos(2 * {PI} * i / {width}), 2)) FROM (SELECT unnest(range({width})) AS i))) AS power FROM wd JOIN tr USING (ix) GROUP BY vec_id, frame, bin)"""


@query(f"WITH {_periodogram(32, 16, 32)} SELECT vec_id, bin::INTEGER AS pos, round(avg(power), 6) + 0.0 AS y FROM pg GROUP BY vec_id, bin")
def welch_psd(spark, d):
    return _long(_signals(spark, d).select("vec_id", dsp.welch_column("x", RATE, 32).alias("y")), 6)


@query(f"WITH {_periodogram(32, 16, 64)} SELECT vec_id, frame::INTEGER AS frame, bin::INTEGER AS bin, round((20 * log10(power + 2.220446049250313e-16))::FLOAT::DOUBLE, 3) + 0.0 AS s FROM pg")
def log_spectrogram(spark, d):
    own = _signals(spark, d).select("vec_id", dsp.log_spectrogram_column("x", RATE, 32, 16, 64).alias("s"))
    own = own.select("vec_id", F.posexplode("s").alias("frame", "bins")).select("vec_id", "frame", F.posexplode("bins").alias("bin", "v"))
    return own.select("vec_id", "frame", "bin", (F.round(F.col("v").cast("double"), 3) + 0.0).alias("s"))


def _butter_sql(low: float, high: float, digits: int) -> str:
    """The sections' difference equation, sample after sample, forward and backward; their coefficients are the kernel's, which
    a test holds against the filter's response."""
    sections, n = dsp.butter_bandpass(5, low, high, RATE), min(3 * 11, N - 1)
    length, steps, source = N + 2 * n, [], "e"
    for k in range(2 * len(sections)):
        b, a = ([float(v) for v in own] for own in sections[k % len(sections)])
        if k == len(sections):
            steps.append(f"r AS (SELECT vec_id, {length - 1} - ix AS ix, x FROM {source})")
            source = "r"
        # A section starts in the steady state of its first value v: its output is then v times the gain at 0, here 0.
        z1, z2 = -b[0], b[2]
        name = f"s{k}"
        steps.append(f"""{name}z AS (SELECT vec_id, 0 AS ix, {b[0]!r} * x + ({z1!r}) * x AS x, ({b[1]!r}) * x - ({a[1]!r}) * ({b[0]!r} * x + ({z1!r}) * x) + ({z2!r}) * x AS z1, ({b[2]!r}) * x - ({a[2]!r}) * ({b[0]!r} * x + ({z1!r}) * x) AS z2 FROM {source} WHERE ix = 0
 UNION ALL SELECT z.vec_id, z.ix + 1, {b[0]!r} * s.x + z.z1, ({b[1]!r}) * s.x - ({a[1]!r}) * ({b[0]!r} * s.x + z.z1) + z.z2, ({b[2]!r}) * s.x - ({a[2]!r}) * ({b[0]!r} * s.x + z.z1) FROM {name}z z JOIN {source} s ON s.vec_id = z.vec_id AND s.ix = z.ix + 1), {name} AS MATERIALIZED (SELECT vec_id, ix, x FROM {name}z)""")
        source = name
    return f"""WITH RECURSIVE {_U}, e AS MATERIALIZED (SELECT vec_id, i.ix::INTEGER AS ix, CASE WHEN i.ix < {n} THEN 2 * f.x - u.x WHEN i.ix >= {N + n} THEN 2 * l.x - u.x ELSE u.x END AS x FROM (SELECT unnest(range({length})) AS ix) i
 JOIN u ON pos = CASE WHEN i.ix < {n} THEN {n} - i.ix WHEN i.ix >= {N + n} THEN {2 * N + n - 2} - i.ix ELSE i.ix - {n} END JOIN (SELECT vec_id, x FROM u WHERE pos = 0) f USING (vec_id) JOIN (SELECT vec_id, x FROM u WHERE pos = {N - 1}) l USING (vec_id)),
{", ".join(steps)} SELECT vec_id, ({length - 1} - ix - {n})::INTEGER AS pos, round(x, {digits}) + 0.0 AS y FROM {source} WHERE ix >= {n} AND ix < {N + n}"""


@query(_butter_sql(0.5, 20.0, 5))
def butter_bandpass(spark, d):
    return _long(_signals(spark, d).select("vec_id", dsp.bandpass_column("x", 0.5, 20.0, RATE).alias("y")), 5)
