"""Helpers that the training-data operators share.

Words are runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is what ``bytes.split()`` gives on
UTF-8. Null texts have no words.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k. A null id counts as the empty text, so its remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. In local mode, where all tasks share one disk, a temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and hasattr(context, "getCheckpointDir"):
        found = context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"nightloom-checkpoints-{os.getpid()}")
    return found


_CLEANED: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: later steps neither recompute nor lose it. The application's
    own folder of checkpoints, which nothing can read after it, goes with it."""
    spark = df.sparkSession
    context = spark.sparkContext
    where = checkpoint_dir(spark)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    out = df.checkpoint(eager=True)
    own = context._jsc.sc().getCheckpointDir().get()
    if own not in _CLEANED:
        path, store = _path(spark, own)
        store.deleteOnExit(path)
        _CLEANED.add(own)
    return out


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. It goes with the application, or with removed()."""
    path = f"{checkpoint_dir(spark)}/nightloom-{name}-{uuid.uuid4().hex}"
    where, store = _path(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str, options: dict | None = None) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path. It goes with the application, or with removed()."""
    path = f"{checkpoint_dir(df.sparkSession)}/nightloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    where, store = _path(df.sparkSession, path)
    store.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), as a Parquet table: columnar and compressed, for wide intermediate rows."""
    return stored(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Removes what stored() has written, once nothing reads it any more."""
    where, store = _path(spark, path)
    store.delete(where, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def word_hashes(data: bytes, hash64=xxhash.xxh3_64_intdigest) -> np.ndarray:
    words = data.split()
    return np.fromiter(map(hash64, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a batch that goes to Python, where the session sets none: whole texts are long, and the executor's buffers and
#: the Python worker's objects follow the batch. A longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Gives a session that says nothing about the bytes of Arrow batches a bound for rows that hold whole texts. A value that
    the user or the cluster has set stays; the number of rows in a batch is never touched."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns (whatever their case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; one that is missing is null. Extra columns of the input cannot clash with computed ones."""
    bounded_batches(docs.sparkSession)
    have = set(docs.columns)
    return docs.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns])
