"""Compression classifier for text quality.

Two zstandard dictionaries are built from good and from bad labelled texts, once over the text as it is and once over its
shape (letter case, digits, punctuation and word lengths, with letters made alike), which carries over to words that
the dictionaries have not seen. A text is compressed in blocks against each dictionary, in two sizes of block: the smaller
they are, the more the dictionary counts beside what a block repeats itself. What the score sees is the difference of the
two compressed sizes, bad less good, and nothing else: normalised by their sum, and by the size of the text. A logistic
model of second degree on these differences, fitted on labelled texts that built no dictionary, gives the probability
that the label is 1.

The fitting sample is bounded: at most ``rows_per_class`` labelled ids of each class, half of which build the dictionaries.
Of these, whole texts are taken in order until ``dict_bytes`` x 100 bytes of a label are reached, and only they are sent to
the driver. The other half is compressed on the executors. Scoring covers all blocks of every text.

Defined results: null and empty texts, which compress to nothing, get the score of an all-zero difference; without
labelled rows of both kinds in both halves every score is 0.5; repeated rows each return (and teach once); ties do not
arise; a very long text is compressed block by block; an empty table gives no rows; columns other than id and text are
never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, fitting

BLOCKS = (1024, 256)
FEATURES = 8
_SHAPE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(128, 256)),
    b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128,
)


def shape(data: bytes) -> bytes:
    return data.translate(_SHAPE)


def blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes, bytes, bytes]  # raw good, raw bad, shape good, shape bad
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    level: int = 3

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            made = []
            for d in self.dictionaries:
                x = zstandard.ZstdCompressionDict(d) if d[:4] == b"\x37\xa4\x30\xec" else zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                x.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=x, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._made = made
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, data: bytes) -> tuple[float, ...]:
        """The normalised differences over the text and over its shape, for each size of block."""
        if not data:
            return (0.0,) * FEATURES
        good, bad, sgood, sbad = (x.compress for x in self.compressors())
        out: list[float] = []
        for size in BLOCKS:
            a = b = c = d = 0
            for x in blocks(data, size):
                a, b = a + len(good(x)), b + len(bad(x))
                x = shape(x)
                c, d = c + len(sgood(x)), d + len(sbad(x))
            out += [(b - a) / (a + b), (d - c) / (c + d), (b - a) / len(data), (d - c) / len(data)]
        return tuple(out)

    def scores(self, data: list[bytes]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(data), 0.5)
        return fitting.probability(curved(np.array([self.features(x) for x in data], dtype=float).reshape(-1, FEATURES)), self.calibration)


def curved(x: np.ndarray) -> np.ndarray:
    """The features, their squares and products."""
    return np.hstack([x, *[x[:, i : i + 1] * x[:, i:] for i in range(x.shape[1])]])


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where zstandard finds too little to train on, the samples' own bytes."""
    cut = [b for x in samples for b in blocks(x, 512)]
    try:
        return zstandard.train_dictionary(size, cut).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(cut) or b"\n" * 8)[-size:]


def dictionaries(build: list[tuple[bytes, int]], dict_bytes: int) -> tuple[bytes, ...]:
    """Good and bad over the texts, good and bad over their shapes."""
    return tuple(dictionary([view(x) for x, y in build if y == label and x], dict_bytes) for view in (bytes, shape) for label in (1, 0))


def within(sizes: list[tuple[int, int, int]], room: int) -> list[int]:
    """Of (key, label, bytes) in order, the keys of whole texts until each label's room is used up."""
    left, out = {0: room, 1: room}, []
    for key, label, size in sizes:
        if left[label] > 0:
            left[label] -= size
            out.append(key)
    return out


def score(docs: DataFrame, model: Model, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of a good text) and predicted (1 from ``cut`` on)."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.scores(common.texts(batch, "_text"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= cut).astype("int32"))], names=[id_col, "score", "predicted"])

    return common.map_batches(common.keyed(docs, id_col, text_col).toDF(id_col, "_text"), run, f"{id_col} {key}, score double, predicted int")


def quality_model(docs: DataFrame, labels: DataFrame, learns: Column | None = None, rows_per_class: int = 3000, dict_bytes: int = 112_640) -> Model:
    sample = fitting.labelled_sample(docs, labels, "quality", rows_per_class, learns)
    build = sample.where("_build")
    sizes = sorted(tuple(r) for r in build.select("_rank", "_label", F.octet_length("_text")).collect())
    chosen = within(sizes, dict_bytes * 100)
    rows = build.where(F.col("_rank").isin(chosen)).select("_rank", "_label", F.col("_text").cast("binary")).toLocalIterator() if chosen else ()
    texts = sorted((rank, y, bytes(t)) for rank, y, t in rows)
    model = Model(dictionaries([(t, y) for _, y, t in texts], dict_bytes), None)
    both = len({y for _, y, _ in texts}) == 2
    del texts
    if both:
        x, y = fitting.features_of(sample.where("NOT _build"), model.features)
        if 0 < y.sum() < len(y):
            model.calibration = fitting.logistic(curved(x), y)
    return model
