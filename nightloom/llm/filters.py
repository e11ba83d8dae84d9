"""Row filters that operators' verdicts give: same columns, whole rows, nothing else changed.

Defined results: a null text is judged as the empty one; repeated rows are judged alike; columns of any name pass through;
very long texts are judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, compression_quality, jaccard_join, toxicity


def keep_where(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Rows for whose text the function that ``make`` gives (once a task) is true. A null text is judged as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(common.texts(batch, text_col)), pa.bool_()))

    common.bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def not_toxic(docs: DataFrame, model: toxicity.Model, cut: float = 0.5) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table of odds

    def make() -> Callable[[list[bytes]], np.ndarray]:
        cache: dict[bytes, float] = {}
        return lambda data: shared.value.scores(data, cache) < cut

    return keep_where(docs, make)


def good(docs: DataFrame, model: compression_quality.Model, cut: float = 0.3) -> DataFrame:
    return keep_where(docs, lambda: lambda data: model.scores(data) >= cut)


def first_of_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: jaccard_join.Rule = jaccard_join.RULE) -> DataFrame:
    """One row of each component: that of the least id.

    Rows of one id and text are one document, of which the row with the least hash stays (of equal hashes, any; maps and
    variants are not hashed). Rows without an id stay, and so does each document without words. Only rows of an id that
    stands on several are aggregated, map-side first; all others are joined to their key and no more."""
    key, n, h, by, row = common.unused(docs.columns, "_id", "_n", "_h", "_by", "_row")
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    found = jaccard_join.similar_components(docs, id_col, text_col, rule)
    first = found.where(name.isNotNull()).groupBy(name.alias(key)).agg(F.count("*").alias(n), F.min("component_id").alias(h)).where(F.col(key) == F.col(h)).select(key, n)
    met = docs.join(first, name == F.col(key))
    every = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    rows = met.where(F.col(n) > 1).select(key, F.xxhash64(text).alias(h), F.xxhash64(*plain).alias(by), F.struct(*every).alias(row))
    one = rows.groupBy(key, h).agg(F.min_by(row, by).alias(row)).select(f"{row}.*")
    return met.where(F.col(n) == 1).select(*every).unionByName(one).unionByName(docs.where(name.isNull()))
