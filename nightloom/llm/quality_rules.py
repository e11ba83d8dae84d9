"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic exceeds a cutoff. Cutoffs are not set by hand. In every stratum (language), a
quarter of the labelled good documents (by a hash of the id) gives a sequence of candidates, each a cutoff for every rule,
from lenient to strict (``FAMILY``). The others, the holdout, certify them: the hypothesis "these rules together reject
more than ``risk`` of the good documents of the stratum" is tested with the exact binomial tail P(Bin(n, risk) <= rejected),
where a document that any of the rules rejects counts. The sequence does not depend on the holdout, is walked in its
order and stops at the first candidate that is not certified, so a walk spends its error level once; the level ``delta``
is divided over the strata (Bonferroni). Hence, with probability 1 - delta over the labels, the selected rules together
reject at most ``risk`` of the good documents of each stratum. A stratum with too few labels to certify anything (459 in
the holdout, at the default levels) gets no cutoffs, and its documents pass. The base rule is not learned and
not part of this bound.

Defined results: null text has no words and fails the base rule; null or unlisted languages share the stratum "other";
documents without a label, or with a null one, are judged but teach nothing, and so do labels of null ids; repeated rows
each count and each return; very long texts are read whole; a statistic equal to its cutoff passes; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STRATA = ("de", "en", "es", "fr")
#: rule: (numerator, denominator, cutoffs from lenient to strict)
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (4.0, 2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "capitals": ("n_capitals", "word_chars", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "shouts": ("n_shouts", "n_words", (4.0, 2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "repeats": ("n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_shouts", "n_lines")
_SYMBOLS, _CAPITALS, _SPACES = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\n\r\x0b\x0c"
_NOT = {k: bytes(set(range(256)) - set(v)) for k, v in (("s", _SYMBOLS), ("c", _CAPITALS))}


def text_stats(data: bytes) -> tuple[int, ...]:
    """STATS of one text."""
    words = data.split()
    n = len(words)
    if not n:
        return (0, 0, len(data.translate(None, _NOT["s"])), 0, 0, 0, data.count(b"!"), 0)
    packed = data.translate(None, _SPACES)
    chars = len(packed.decode("utf-8", "replace"))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
        if len(seen) < n:
            v = len(seen)
            pair = ids[:-1] * v + ids[1:]
            if v < 2_000_000:
                keys = pair[:-1] * v + ids[2:]
            else:
                keys = np.unique(pair, return_inverse=True)[1][:-1].astype(np.int64) * v + ids[2:]
            order = np.argsort(keys, kind="stable")
            same = keys[order[1:]] == keys[order[:-1]]
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            covered[:-2] |= twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeat = int(covered.sum())
    return (n, chars, len(data.translate(None, _NOT["s"])), len(lines) - len(set(lines)), repeat, len(data.translate(None, _NOT["c"])), data.count(b"!"), len(lines))


def add_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: id, stratum and STATS."""
    key = docs.schema[id_col].dataType.simpleString() if id_col in docs.columns else "string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_stats(x) for x in common.texts(batch, "_text")], dtype=np.int64).reshape(-1, len(STATS))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in rows.T]], names=["_id", "stratum", *STATS])

    small = common.keyed(docs, id_col, stratum_col, text_col).toDF("_id", "_stratum", "_text")
    stratum = F.when(F.col("_stratum").isin(*STRATA), F.col("_stratum")).otherwise(F.lit("other"))
    return common.map_batches(small.select("_id", stratum.alias("stratum"), "_text"), run, f"_id {key}, stratum string, " + ", ".join(f"{s} long" for s in STATS)).withColumnRenamed("_id", id_col)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def _ratio(rule: str) -> Column:
    above, below, _ = RULES[rule]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


@dataclass(frozen=True)
class Cutoff:
    """A rule's cutoff; good and rejected: the stratum's holdout, and how many of it the stratum's rules together reject."""

    stratum: str
    rule: str
    cutoff: float
    good: int
    rejected: int
    p_value: float


#: Candidates from lenient to strict: (scale, back). A rule's cutoff is the strictest that rejects at most scale x risk / rules
#: of the documents that it learns from, and then so many steps more lenient.
FAMILY = ((1, 4), (1, 3), (1, 2), (1, 1), (1, 0), (2, 0), (4, 0))


def learns(id_col: str) -> Column:
    """Whether a good document shapes the candidates; else it belongs to the holdout."""
    return F.substring(F.md5(F.col(f"`{id_col}`").cast("string").cast("binary")), 32, 1).isin("0", "4", "8", "c")


def candidates(rows: list[tuple[tuple[int, ...], int]], risk: float) -> list[tuple[int, ...]]:
    """For each member of FAMILY, each rule's index in its grid, negative for no cutoff. rows: (numbers of cutoffs that a
    document exceeds, documents)."""
    n = sum(c for _, c in rows)
    out = []
    for scale, back in FAMILY:
        own = []
        for r, (_, _, grid) in enumerate(RULES.values()):
            rejected = [sum(c for s, c in rows if s[r] >= len(grid) - g) for g in range(len(grid))]
            fine = [g for g, k in enumerate(rejected) if k * len(RULES) <= scale * risk * n + 1e-9]
            own.append(max(fine, default=-1) - back)
        out.append(tuple(own))
    return out


def rejected_by(candidate: tuple[int, ...], rows: list[tuple[tuple[int, ...], int]]) -> int:
    """Documents that any rule rejects."""
    sizes = [len(grid) for _, _, grid in RULES.values()]
    return sum(c for s, c in rows if any(g >= 0 and x >= m - g for x, m, g in zip(s, sizes, candidate, strict=True)))


def select_cutoffs(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", risk: float = 0.01, delta: float = 0.05) -> list[Cutoff]:
    """The strictest certified candidate of each stratum. Only counts by stratum and numbers of exceeded cutoffs reach the
    driver: at most as many rows as the grids have combinations, whatever the input."""
    good = labels.where(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias("_good")).distinct()
    held = stats.join(good, F.col(id_col) == F.col("_good"), "left_semi")
    steps = [sum((_ratio(r) > c).cast("int") for c in grid).alias(f"_{r}") for r, (_, _, grid) in RULES.items()]
    counts = held.select("stratum", learns(id_col).alias("_learns"), *steps).groupBy("stratum", "_learns", *[f"_{r}" for r in RULES]).count().collect()
    by: dict[str, dict[bool, list]] = {}
    for row in counts:
        by.setdefault(row[0], {True: [], False: []})[row[1]].append((tuple(row[2:-1]), row[-1]))
    out = []
    for stratum, own in sorted(by.items()):
        n, best = sum(c for _, c in own[False]), None
        for candidate in candidates(own[True], risk) if own[True] else []:
            k = rejected_by(candidate, own[False])
            if (p := binomial_tail(k, n, risk)) > delta / (len(STRATA) + 1):
                break
            best = candidate, k, p
        if best:
            out += [Cutoff(stratum, rule, RULES[rule][2][g], n, best[1], best[2]) for rule, g in sorted(zip(RULES, best[0], strict=True)) if g >= 0]
    return out


def apply_rules(stats: DataFrame, cutoffs: list[Cutoff], min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """base_failed, the rules that reject (``failed_rules``) and ``kept``. The cutoffs are at most strata x rules literals."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    hits = [F.when((F.col("stratum") == c.stratum) & (_ratio(c.rule) > c.cutoff), F.lit(c.rule)) for c in cutoffs]
    failed = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return stats.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    stats = common.cut(add_stats(docs))
    return apply_rules(stats, select_cutoffs(stats, labels, risk=risk, delta=delta))
