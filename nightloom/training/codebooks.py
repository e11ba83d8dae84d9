"""Learning a codebook of vectors: mini-batches, running sums of each code, commitment loss, revival of unused codes.

A step assigns a batch's vectors to their nearest codes (ties to the lower one) and takes, for each code, the number of its
vectors and their sum. Both enter running totals that fade by ``decay``, and a code is its total sum over its total
number. A code whose number has faded below ``revive_below`` starts again at a vector of the batch. Only sums of codes reach
the driver, as many numbers as the book has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.training.loop import columns


@dataclass
class Book:
    """Codes, and the totals that they come from."""

    codes: np.ndarray
    number: np.ndarray = field(default=None)
    total: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.codes = np.asarray(self.codes, dtype=np.float64)
        if self.number is None:
            self.number, self.total = np.ones(len(self.codes)), self.codes.copy()


def nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of each row."""
    d = (x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1)[None, :]
    own = d.argmin(1)
    return own, ((x - codes[own]) ** 2).sum(1)


def sums(rows: DataFrame, codes: np.ndarray, x: str = "x") -> tuple[np.ndarray, np.ndarray, float, int]:
    """(number, sum of vectors) of each code, the sum of squared distances, and the number of vectors."""
    k, d = codes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 2))
        for batch in batches:
            if batch.num_rows:
                own, _ = columns(batch, 0, None)
                code, far = nearest(own, codes)
                np.add.at(total, code, np.column_stack([np.ones(len(own)), far, own]))
        full = np.flatnonzero(total[:, 0])
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(list(total[full]), pa.list_(pa.float64()))], names=["code", "s"])

    parts = rows.where(F.col(x).isNotNull()).select(x).mapInArrow(run, "code int, s array<double>")
    out = np.zeros((k, d + 2))
    for r in parts.select("code", F.posexplode("s").alias("at", "v")).groupBy("code", "at").agg(F.sum("v").alias("v")).collect():
        out[r["code"], r["at"]] = r["v"]
    return out[:, 0], out[:, 2:], float(out[:, 1].sum()), int(out[:, 0].sum())


def step(rows: DataFrame, book: Book, decay: float = 0.8, commitment: float = 0.25, revive_below: float = 0.0, key: str | None = None, x: str = "x", seed: int = 0) -> tuple[Book, float]:
    """The book after one batch, and the commitment loss before it: the weighted mean squared distance. Codes are revived with
    the batch's vectors of the least hash of their key; at most as many as there are codes are fetched."""
    number, total, far, n = sums(rows, book.codes, x)
    loss = commitment * far / n if n else 0.0
    new_number, new_total = decay * book.number + (1 - decay) * number, decay * book.total + (1 - decay) * total
    live = new_number > 0
    codes = np.where(live[:, None], new_total / np.where(live, new_number, 1)[:, None], book.codes)
    dead = np.flatnonzero(new_number < revive_below)
    if len(dead) and key is not None:
        fresh = rows.where(F.col(x).isNotNull()).select(key, x).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(len(dead)).collect()
        for code, r in zip(dead, fresh):
            codes[code] = new_total[code] = np.array(r[x], dtype=np.float64)
            new_number[code] = 1.0
    return Book(codes, new_number, new_total), loss


def fit(rows: DataFrame, book: Book, epochs: int = 10, batches: int = 1, decay: float = 0.8, commitment: float = 0.25, revive_below: float = 0.0, key: str = "id", x: str = "x") -> tuple[Book, list[float]]:
    """The book after some epochs over batches that are dealt by a hash of the key, and each epoch's mean loss. The caller
    stores or caches rows that are dear to compute: each batch reads them once."""
    losses = []
    for epoch in range(epochs):
        each = []
        for b in range(batches):
            part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
            book, loss = step(part, book, decay, commitment, revive_below, key, x, epoch * batches + b)
            each.append(loss)
        losses.append(float(np.mean(each)))
    return book, losses
