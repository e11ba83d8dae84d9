"""A cleaning pipeline over documents; part of the training-data subpackage.

Each stage takes the documents that its predecessor kept and returns the columns of documents, but for the last, which
returns the packed pieces. Each is written as Parquet and read again before the next.

1. toxicity: documents that the classifier calls toxic go. It learns from four fifths of the labels.
2. quality: documents that the compression classifier calls bad go.
3. near_duplicates: of each component of near duplicates (NEAR), the document with the least id stays. Documents with a
   null id stay.
4. secrets: base-kind secrets and long tokens that look live are replaced by a mark; all documents stay.
5. packing: the documents are packed, by their BPE tokens and an end mark, into sequences of the permitted lengths.

Defined results: null and empty texts are judged as empty ones, and packed as an end mark if they are kept; repeated rows
share the verdicts of the first two stages, and of rows of one id and text one stays behind the third (all, where the id
is null); equal texts under different ids leave the least id; very long texts go through whole; empty tables go
through all stages; further columns are handed on up to the last stage, whatever their names. n_chars follows the text
where a stage changes it. Folders of the stages are removed as soon as the next one is written, the last one with the
application.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.llm import common, compression_quality, filters, jaccard_join, packing, queries, secrets, toxicity

#: Near duplicates share 0.8 of their five-word shingles or more; op3's own contract (four words, 0.85) binds only its query.
NEAR = jaccard_join.Rule(5, 80, 100)

def learns() -> Column:
    """Rows whose labels may teach."""
    return common.fold(F.col("_id"), 5) != 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.toxicity_model(docs, common.table(spark, sf_dir, "labels"), learns())
    return filters.not_toxic(docs, model)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = compression_quality.quality_model(docs, common.table(spark, sf_dir, "labels"), learns())
    return filters.good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.first_of_near_duplicates(docs, rule=NEAR)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs, secrets.secret_spans(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The workers have held the other stages' models before.
    return packing.best_fit(packing.bpe_counts(docs, queries.TOKENIZER, remember=16 << 20))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: SQL cannot express the trained stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.removed(spark, before)
        before = path
    return docs
