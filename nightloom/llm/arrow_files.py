"""Token ids as Arrow stream files of equal-length sequences and masks.

Documents are dealt to files by ranges of ascending id and encoded there; their ids, with an end id behind each document, run
on through sequences of ``length`` places. A file is an Arrow stream of batches with two fixed-size-list columns: ``ids``, of
the smallest unsigned type that holds the vocabulary, and ``mask``, one bit a place, false only behind the last id of the
file. Every batch but the last has the same number of sequences and so the same number of bytes: ``SequenceFile`` finds
sequence i by arithmetic and returns views of the mapped file, copying nothing. Beside each file lies its index, a
stream of ids, starts in the file and numbers of tokens of its documents.

Tasks name their files uniquely and report them in rows that are written as a table, so files of failed or repeated attempts
are never read. Only the texts are shuffled, once. A file is written and read back batch by batch, however long it is.

Defined results: null and empty texts have the end id alone; null document ids come first; rows of one id are ordered by
their texts' hash, and equal rows are written each; a very long text runs through as many sequences as it needs; an
empty table gives no files and no rows; columns other than id and text are never read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Places of a sequence, sequences of a batch, bytes of text that a file is meant for.
LENGTH, BATCH, FILE_BYTES = 2048, 256, 64 << 20


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it; a shared folder may be named as a URI or as a path."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pa.fs.LocalFileSystem(), uri


def opened(uri: str) -> pa.NativeFile:
    """A file to read: mapped into memory where it lies on a mounted disk."""
    store, path = place(uri)
    return pa.memory_map(path) if isinstance(store, pa.fs.LocalFileSystem) else store.open_input_file(path)


def sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Takes ids in any portions and writes them as sequences, whole batches at a time."""

    def __init__(self, sink: pa.NativeFile, kind: np.dtype, length: int, batch: int):
        self.kind, self.length, self.places = np.dtype(kind), length, length * batch
        self.schema = sequence_schema(self.kind, length)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.places:
            flat = np.concatenate(self.held)
            whole = self.size - self.size % self.places
            for at in range(0, whole, self.places):
                self.put(flat[at : at + self.places], self.places)
            self.held, self.size = [flat[whole:]], self.size - whole

    def put(self, ids: np.ndarray, places: int) -> None:
        values, mask = np.zeros(places, self.kind), np.arange(places) < len(ids)
        values[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.written += places // self.length

    def close(self) -> None:
        if self.size:
            self.put(np.concatenate(self.held), -(-self.size // self.length) * self.length)
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one file: views of ids and masks, without copies where the file is mapped."""

    def __init__(self, uri: str):
        self.file = opened(uri)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.file))
        self.first = self.file.tell()
        self.length = self.schema.field("ids").type.list_size
        head = self.batch_at(self.first)
        self.per_batch, self.bytes = (head.num_rows, self.file.tell() - self.first) if head else (0, 0)

    def batch_at(self, offset: int) -> pa.RecordBatch | None:
        if offset >= self.file.size():
            return None
        self.file.seek(offset)
        try:
            message = pa.ipc.read_message(self.file)
        except EOFError:  # the mark of the stream's end
            return None
        return pa.ipc.read_record_batch(message, self.schema)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        batch = self.batch_at(self.first + i // self.per_batch * self.bytes) if self.per_batch and i >= 0 else None
        row = i % self.per_batch if batch else 0
        if batch is None or row >= batch.num_rows:
            raise IndexError(i)
        ids, mask = (batch.column(c).values.slice((batch.column(c).offset + row) * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def batches(self) -> Iterator[pa.RecordBatch]:
        at = self.first
        while (batch := self.batch_at(at)) is not None:
            yield batch
            at = self.file.tell()


def tokens_of(uri: str) -> Iterator[np.ndarray]:
    """All ids of a file in order, in views of its batches; what the mask calls empty is left out."""
    for batch in SequenceFile(uri).batches():
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
        yield ids[: batch.column(1).flatten().true_count]


@dataclass
class Document:
    start: int
    n_tokens: int
    parts: Iterator[np.ndarray]


def documents_of(file: str, index: str) -> Iterator[tuple[pa.Array, Iterator[Document]]]:
    """For each batch of a file's index its id column and its documents; the parts of one must be taken before the next."""
    chunks = tokens_of(file)
    held = np.zeros(0, np.uint32)

    def parts(n: int) -> Iterator[np.ndarray]:
        nonlocal held
        while n:
            if not len(held):
                held = next(chunks)
            some, held = held[:n], held[n:]
            n -= len(some)
            yield some

    with pa.ipc.open_stream(opened(index)) as batches:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield batch.column(0), (Document(start, n, parts(n)) for start, n in rows)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, length: int = LENGTH, batch: int = BATCH, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns a stored row for each, in the order of their documents: file, index, n_docs, n_tokens,
    n_sequences and start, the number of ids in all files before it."""
    spark = docs.sparkSession
    small = common.keyed(docs, id_col, text_col).toDF("_id", "_text")
    size = small.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    order = F.col("_id"), F.xxhash64(F.coalesce("_text", F.lit("")))
    dealt = small.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    folder = common.folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(vocabulary, REMEMBER)
        kind = np.dtype(np.uint16 if len(codec.bytes) <= 1 << 16 else np.uint32)
        end = np.array([end_id], kind).tobytes()
        writer, n_docs, n_tokens = None, 0, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            if writer is None:
                part = TaskContext.get().partitionId()
                name = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}"
                sinks = [store.open_output_stream(path) for store, path in map(place, (f"{name}.arrow", f"{name}.index.arrow"))]
                writer = SequenceWriter(sinks[0], kind, length, batch)
                schema = pa.schema([("id", rows.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_stream(sinks[1], schema)
            counts = []
            for some in bpe.slices([t or "" for t in rows.column(1).to_pylist()]):
                for raw in codec.packed(some, kind):
                    ids = np.frombuffer(raw + end, kind)
                    writer.add(ids)
                    counts.append(len(ids))
            ends = np.cumsum(counts) + n_tokens
            index.write_batch(pa.RecordBatch.from_arrays([rows.column(0), pa.array(ends - counts), pa.array(counts, pa.int64())], schema=schema))
            n_docs, n_tokens = n_docs + len(counts), int(ends[-1])
        if writer is not None:
            for x in (writer, index, *sinks):
                x.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{name}.arrow", "index": f"{name}.index.arrow", "n_docs": n_docs, "n_tokens": n_tokens, "n_sequences": writer.written}])

    made, _ = common.stored(dealt.mapInArrow(run, "part long, file string, index string, n_docs long, n_tokens long, n_sequences long"), "token-files")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    return made.select("file", "index", "n_docs", "n_tokens", "n_sequences", before.alias("start"))


#: Bytes of known words that a worker keeps while it writes.
REMEMBER = 96 << 20


def _read(files: DataFrame, fn, schema: str) -> DataFrame:
    """fn(file, index, start) for each row of token_files(), a file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                yield from fn(r["file"], r["index"], r["start"])

    return files.select("file", "index", "start").repartition(max(1, files.count())).mapInArrow(run, schema)


def digests(files: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of each document, from the files."""

    def fn(file: str, index: str, start: int) -> Iterator[pa.RecordBatch]:
        for ids, docs in documents_of(file, index):
            out = []
            for doc in docs:
                crc = 0
                for part in doc.parts:
                    crc = zlib.crc32(part.astype("<u4"), crc)
                out.append((start + doc.start, doc.n_tokens, crc))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return _read(files, fn, f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long")


def read_ids(files: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """id, start and ids (array<long>) of each document, from the files."""

    def fn(file: str, index: str, start: int) -> Iterator[pa.RecordBatch]:
        for own, docs in documents_of(file, index):
            for i, doc in enumerate(docs):
                ids = np.concatenate([*doc.parts]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own.slice(i, 1), pa.array([start + doc.start]), pa.array([ids], pa.list_(pa.int64()))], names=[id_col, "start", "ids"])

    return _read(files, fn, f"{id_col} {id_type}, start long, ids array<long>")
