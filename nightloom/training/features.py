"""Small features of an epoch's samples, for models that do without a network of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightloom.functions import dsp
from nightloom.operators.prototypes import BANDS


def log_band_powers(samples: Column, rate: float = 100.0, width: int = 256) -> Column:
    """The logarithm of the mean spectral density in each band, from delta to gamma."""
    spectrum = dsp.welch_column(samples, rate, width)

    def band(low: float, high: float) -> Column:
        bins = [i for i in range(width // 2 + 1) if low <= i * rate / width < high]
        own = F.slice(spectrum, bins[0] + 1, len(bins))
        return F.log(F.aggregate(own, F.lit(0.0), lambda s, v: s + v) / len(bins) + 1e-12)

    return F.array(*[band(low, high) for _, low, high in BANDS])


def mean_and_spread(samples: Column) -> Column:
    """Mean, mean square and mean step of the samples, in the JVM alone."""
    x = samples.cast("array<double>")
    n = F.greatest(F.size(x), F.lit(1))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    steps = F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.array(total(x) / n, total(F.transform(x, lambda v: v * v)) / n, total(steps) / n)
