"""Product codes of vectors: codebooks by Lloyd rounds with a heap of parts for each entry.

A vector is cut into equal parts, and each part position has a codebook of its own. A partition keeps its vectors in
blocks, and a block keeps, for each entry of each codebook, a heap of the parts that are assigned to it. The key of a part
is its slack, the lower bound of its distance to any other entry less the upper bound of that to its own, plus the drift
that the entry had accumulated when it came in: each round adds to an entry's drift how far it moved and how far any other
of its codebook moved at most. So a round pops only parts whose key the drift has reached; these are compared with all
entries exactly, in integers, and pushed with a new key. All other parts keep their entry without being looked at, and heaps
that lose and gain nothing are not even unpacked.

Defined results: vectors that are null, hold null or non-finite components or have not ``dims`` components are dropped; null
ids are coded but never start a codebook (without any id, it is one entry of zeros at first); ties between entries go to the lower index, and between starting vectors of one
id by their components; repeated rows are coded each; where there are fewer vectors than entries, the codebook is as small;
an empty table gives no rows; null labels count as one label; further columns are ignored, whatever their names; a
component beyond 131,072 is an error, as its distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import vector_blocks as vb

PARTS, ENTRIES, ROUNDS = 16, 64, 2
STATE = ("codes", "heap_size", "heap_key", "heap_row", "sums")


class Heaps:
    """For each (part position, entry) of a block, a heap of (key, row), packed in arrays until it is touched."""

    def __init__(self, cells: int, size: np.ndarray | None = None, key: np.ndarray | None = None, row: np.ndarray | None = None):
        self.size = np.zeros(cells, np.int32) if size is None else size
        self.key, self.row = (np.zeros(0), np.zeros(0, np.int32)) if key is None else (key, row)
        self.ends = np.cumsum(self.size)
        self.open: dict[int, list[tuple[float, int]]] = {}

    def heap(self, cell: int) -> list[tuple[float, int]]:
        if cell not in self.open:
            own = slice(int(self.ends[cell] - self.size[cell]), int(self.ends[cell]))
            self.open[cell] = list(zip(self.key[own].tolist(), self.row[own].tolist(), strict=True))  # packed in heap order
        return self.open[cell]

    def violated(self, cell: int, limit: float) -> list[int]:
        """Rows whose key the limit has reached; they leave the heap."""
        if not self.size[cell] or self.key[self.ends[cell] - self.size[cell]] > limit:
            return []
        own, out = self.heap(cell), []
        while own and own[0][0] <= limit:
            out.append(heappop(own)[1])
        return out

    def push(self, cells: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(cells, kind="stable")
        cells, items = cells[order], list(zip(keys[order].tolist(), rows[order].tolist(), strict=True))
        at = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
        for a, b in zip(at, [*at[1:], len(cells)], strict=True) if len(cells) else ():
            own = self.heap(int(cells[a]))
            if own:
                for item in items[a:b]:
                    heappush(own, item)
            else:
                own += items[a:b]
                heapify(own)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows, size = [], [], self.size.copy()
        for cell in range(len(size)):
            if cell in self.open:
                own = self.open[cell]
                size[cell] = len(own)
                keys.append(np.array([k for k, _ in own]))
                rows.append(np.array([r for _, r in own], np.int32))
            else:
                own = slice(int(self.ends[cell] - self.size[cell]), int(self.ends[cell]))
                keys.append(self.key[own])
                rows.append(self.row[own])
        return size, np.concatenate(keys), np.concatenate(rows)


def rescan(x: np.ndarray, rows: np.ndarray, part: int, books: np.ndarray, gone: np.ndarray, codes: np.ndarray, heaps: Heaps) -> None:
    """Exact nearest entries of some rows' parts at one position, and their keys."""
    _, k, width = books.shape
    d = vb.squared(x[rows, part * width : (part + 1) * width], books[part])
    best = d.argmin(1)
    codes[rows, part] = best
    near = np.sqrt(d[np.arange(len(rows)), best].astype(np.float64))
    if k > 1:
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        far = np.sqrt(d.min(1).astype(np.float64))
        own = gone[part][best]
        keys = far - near + own - vb.EPS * (far + near + own + 1)
    else:
        keys = np.full(len(rows), np.inf)
    heaps.push(part * k + best, keys, rows)


def state_of(x: np.ndarray, codes: np.ndarray, heaps: Heaps, books: np.ndarray) -> dict[str, bytes]:
    parts, k, width = books.shape
    size, key, row = heaps.packed()
    sums = np.concatenate([vb.group_sums(x[:, p * width : (p + 1) * width], codes[:, p], k) for p in range(parts)])
    return dict(zip(STATE, (a.tobytes() for a in (codes.astype(np.int16), size, key, row, sums)), strict=True))


def first_blocks(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks whose parts have all been compared with all entries."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x in vb.batches_of_blocks(batches, parts * width):
            codes, heaps, rows = np.zeros((len(x), parts), np.int64), Heaps(parts * k), np.arange(len(x))
            for p in range(parts):
                rescan(x, rows, p, books, np.zeros((parts, k)), codes, heaps)
            yield vb.block_row(ids, labels, x, state_of(x, codes, heaps, books))

    return kept.mapInArrow(run, vb.block_schema(kept, *STATE))


def settled(block: dict, books: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, Heaps]:
    """A block's components, codes under the new books and heaps: violated parts are scanned again."""
    parts, k, width = books.shape
    x = vb.numbers(block["x"], np.int32, -1, parts * width)
    codes = vb.numbers(block["codes"], np.int16, len(x), parts).astype(np.int64)
    heaps = Heaps(parts * k, vb.numbers(block["heap_size"], np.int32, -1), vb.numbers(block["heap_key"], np.float64, -1), vb.numbers(block["heap_row"], np.int32, -1))
    for p in range(parts):
        todo = [r for e in range(k) for r in heaps.violated(p * k + e, float(gone[p][e]))]
        if todo:
            rescan(x, np.array(todo), p, books, gone, codes, heaps)
    return x, codes, heaps


def moved(gone: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Accumulated drift of each entry: its own way and the longest way of any other entry of its codebook."""
    way = vb.drift(old, new)
    most = np.sort(way, axis=1)
    second = most[:, -2:-1] if way.shape[1] > 1 else 0.0
    others = np.where(way == most[:, -1:], second, most[:, -1:])
    return (gone + way + others) * (1 + vb.EPS)


def product_codes(vectors: DataFrame, dims: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes array<int>, error) of each kept vector as a stored table, and the codebooks (part, entry, component)."""
    if dims % parts:
        raise ValueError("parts must divide the components")
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    kept = vb.scaled(vectors, dims, id_col, vector_col, label_col)
    start = vb.first_vectors(kept.where(F.col("_id").isNotNull()), entries, F.col("_id"))
    if not len(start):  # all ids are null, or there are no vectors
        start = np.zeros((1, dims), np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    gone = np.zeros(books.shape[:2])
    blocks, path = vb.stored(first_blocks(kept, books), "codes-0")
    flat = lambda b: b.reshape(-1, b.shape[2])
    for r in range(1, rounds + 1):
        new = vb.new_centers(blocks, flat(books)).reshape(books.shape)
        gone, books = moved(gone, books, new), new
        if r == rounds:
            break
        def again(block: dict, books=books, gone=gone) -> pa.RecordBatch:
            x, codes, heaps = settled(block, books, gone)
            return vb.block_row(block["ids"].values, block["labels"].values, x, state_of(x, codes, heaps, books))

        after, next_path = vb.stored(vb.map_blocks(blocks, again, vb.block_schema(kept, *STATE)), f"codes-{r}")
        common.removed(spark, path)
        blocks, path = after, next_path

    def coded(block: dict) -> pa.RecordBatch:
        x, codes, _ = settled(block, books, gone)
        width = books.shape[2]
        error = sum(vb.own_squared(x[:, p * width : (p + 1) * width], books[p][codes[:, p]]) for p in range(parts))
        return pa.RecordBatch.from_arrays([block["ids"].values, block["labels"].values, pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(error, pa.int64())], names=["id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    out, _ = common.stored(vb.map_blocks(blocks, coded, f"id {kinds['_id']}, label {kinds['_label']}, codes array<int>, error long"), "codes")
    common.removed(spark, path)
    return out, books


def books_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digests(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """id, code (two hex digits a part), error, label_error and codebooks_sha256 of each kept vector."""
    rows, books = product_codes(vectors, id_col=id_col, **options)
    pair = lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))
    digest = rows.select("id", "label", F.array_join(F.transform("codes", pair), "").alias("code"), "error")
    return vb.with_total(digest, "label", "error", "label_error").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))
