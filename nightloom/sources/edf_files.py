"""EDF and EDF+ files read by ranges of bytes, and as data sources: ``edf`` (epochs of channels), ``edf_headers`` and
``edf_annotations``.

A file is split at ranges of its bytes, so a large one is many tasks' work; each task reads the header, takes the epochs
(or data records) that start in its range, and of these only the bytes of the channels that are asked for. Filters on
``label`` and ``start_s`` are pushed down to that. Listing the files is all that the driver does. Stores that pyarrow opens
can be read so: mounted disks, S3, Google's and Azure's; for others there is ``edf.read_epochs`` on Spark's own reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from nightloom.sources import edf

SCHEMES = ("", "file", "s3", "s3a", "s3n", "gs", "abfs", "abfss")
SPLIT_BYTES = 64 << 20
#: Bytes that may lie between two pieces for them to be read as one; a store with slow requests wants more.
GAP = 0


def scheme(path: str) -> str:
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", path)
    return found[1].lower() if found else ""


def readable(path: str) -> bool:
    """Whether ranges of this path's files can be read."""
    return scheme(path) in SCHEMES


def located(path: str) -> tuple:
    from pyarrow import fs

    if scheme(path) in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


class EdfFile:
    """A header, and physical samples of one channel at a time, each by the bytes that it needs; ``read`` counts them."""

    def __init__(self, source, gap: int = GAP):
        self.source, self.gap, self.read = source, gap, 0
        start = self.bytes(0, 256)
        n = int(start[252:256].decode("latin-1"))
        self.head = edf.header(start + self.bytes(256, 256 * n))
        self.size = source.size()
        self.width = 2 * sum(s["samples"] for s in self.head["signals"])
        whole = max(self.size - self.head["bytes"], 0) // self.width if self.width else 0
        self.records = whole if self.head["records"] < 0 else min(self.head["records"], whole)

    @classmethod
    def open(cls, path: str, gap: int = GAP) -> EdfFile:
        store, name = located(path)
        return cls(store.open_input_file(name), gap)

    @classmethod
    def of(cls, data: bytes) -> EdfFile:
        return cls(pa.BufferReader(data))

    def bytes(self, at: int, n: int) -> bytes:
        self.read += n
        return self.source.read_at(n, at)

    def raw(self, k: int, first: int, last: int) -> np.ndarray:
        """Data records [first, last) of signal k, as stored; (records, samples)."""
        first, last = max(first, 0), min(last, self.records)
        per = self.head["signals"][k]["samples"]
        if last <= first or not per:
            return np.zeros((0, per), "<i2")
        at = self.head["bytes"] + 2 * sum(s["samples"] for s in self.head["signals"][:k])
        if self.width - 2 * per <= self.gap:
            whole = self.bytes(at + first * self.width, (last - first - 1) * self.width + 2 * per)
            return np.ndarray((last - first, per), "<i2", whole, strides=(self.width, 2)).copy()
        return np.frombuffer(b"".join([self.bytes(at + r * self.width, 2 * per) for r in range(first, last)]), "<i2").reshape(-1, per)

    def physical(self, k: int, raw: np.ndarray) -> np.ndarray:
        low, high, dlow, dhigh = (float(self.head["signals"][k][x]) for x in ("physical_min", "physical_max", "digital_min", "digital_max"))
        return (raw.astype(np.float64) - dlow) * ((high - low) / (dhigh - dlow)) + low

    def samples(self, k: int, start_s: float = 0.0, stop_s: float | None = None) -> np.ndarray:
        """Physical samples of signal k from start to stop in seconds."""
        s = self.head["signals"][k]
        start, stop = int(start_s * s["rate"]), None if stop_s is None else int(stop_s * s["rate"])
        return self.between(k, start, self.records * s["samples"] if stop is None else stop)

    def between(self, k: int, start: int, stop: int) -> np.ndarray:
        """Physical samples [start, stop) of signal k; fewer at the end of the file."""
        per = self.head["signals"][k]["samples"]
        if not per or stop <= start:
            return np.zeros(0)
        first = start // per
        own = self.raw(k, first, -(-stop // per)).reshape(-1)
        return self.physical(k, own[start - first * per : stop - first * per])


@dataclass
class Piece(InputPartition):
    """Ranges of bytes of some files: what starts in them."""

    files: list[tuple[str, int, int]]

    def __init__(self, files):
        super().__init__(files)
        self.files = files


@dataclass
class Wanted:
    """What filters ask for: labels (none: all), and the seconds at which an epoch may start."""

    labels: set[str] | None = None
    above: float = -float("inf")
    below: float = float("inf")
    above_too: bool = True
    below_too: bool = True
    pushed: list[Filter] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Takes a filter if it can be followed to the letter."""
        name = f.attribute[0] if getattr(f, "attribute", ()) else None
        if isinstance(f, IsNotNull):
            pass  # no column is ever null
        elif name == "label" and isinstance(f, EqualTo | In):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.labels = own if self.labels is None else self.labels & own
        elif name == "start_s" and isinstance(f, GreaterThan | GreaterThanOrEqual):
            bound = (float(f.value), not isinstance(f, GreaterThanOrEqual))
            if bound > (self.above, not self.above_too):
                self.above, self.above_too = bound[0], not bound[1]
        elif name == "start_s" and isinstance(f, LessThan | LessThanOrEqual):
            bound = (float(f.value), isinstance(f, LessThanOrEqual))
            if bound < (self.below, self.below_too):
                self.below, self.below_too = bound
        else:
            return False
        self.pushed.append(f)
        return True

    def at(self, second: float) -> bool:
        return (second > self.above or (self.above_too and second == self.above)) and (second < self.below or (self.below_too and second == self.below))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*.edf"))
        self.split, self.gap = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES))), int(options.get("gap", GAP))
        if not readable(self.path):
            raise ValueError(f"{self.path} cannot be read by ranges")

    def listed(self) -> list[tuple[str, int]]:
        """(path, size) of the files, in order."""
        from pyarrow import fs

        store, at = located(self.path)
        prefix = "file:" if scheme(self.path) in ("", "file") else scheme(self.path) + "://"
        one = store.get_file_info(at)
        found = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob))

    def partitions(self) -> list[Piece]:
        """Ranges of about ``split`` bytes; small files share a task."""
        out, held, size = [], [], 0
        for path, n in self.listed():
            for a in range(0, max(n, 1), self.split):
                b = min(a + self.split, n) if a + self.split < n else 1 << 62
                take = min(self.split, n - a)
                if held and size + take > self.split:
                    out.append(Piece(held))
                    held, size = [], 0
                held.append((path, a, b))
                size += take
        return [*out, Piece(held)] if held else out

    def pieces(self, partition: Piece) -> Iterator[tuple[str, EdfFile, int, int]]:
        for path, a, b in partition.files:
            with EdfFile.open(path, self.gap).source as source:
                yield path, EdfFile(source, self.gap), a, b


class _Epochs(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.seconds, self.wanted = float(options.get("epochseconds", options.get("epochSeconds", 30.0))), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for path, f, a, b in self.pieces(partition):
            for k, s in enumerate(f.head["signals"]):
                if s["label"] == edf.ANNOTATIONS or (self.wanted.labels is not None and s["label"] not in self.wanted.labels):
                    continue
                width = int(round(self.seconds * s["rate"]))
                if not width:
                    continue
                total = f.records * s["samples"] // width
                begin = lambda e: f.head["bytes"] + e * width // s["samples"] * f.width  # noqa: B023, E731  of the record with the epoch's first sample
                own = [e for e in range(total) if a <= begin(e) < b and self.wanted.at(e * self.seconds)]
                for some in _runs(own, max(1, (4 << 20) // (4 * width))):
                    x = f.between(k, some[0] * width, (some[-1] + 1) * width).astype(np.float32)
                    n = len(some)
                    arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x))
                    e = np.array(some, np.int32)
                    columns = [pa.array([path] * n), pa.array([s["label"]] * n), pa.array([s["rate"]] * n), pa.array(e), pa.array(e * self.seconds), arrays]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "label", "rate", "epoch_idx", "start_s", "samples"])


def _runs(numbers: Sequence[int], most: int) -> Iterator[list[int]]:
    """Runs of following numbers, of at most so many each."""
    own: list[int] = []
    for i in numbers:
        if own and (i != own[-1] + 1 or len(own) == most):
            yield own
            own = []
        own.append(i)
    if own:
        yield own


class EdfEpochs(DataSource):
    """(path, label, rate, epoch_idx, start_s, samples): whole epochs of all channels but annotations. Options: path,
    pathGlobFilter, epochSeconds (30), splitBytes, gap."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return "path string, label string, rate double, epoch_idx int, start_s double, samples array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Epochs(dict(self.options))


class _Headers(_Reader):
    def partitions(self) -> list[Piece]:
        paths = [(path, 0, 0) for path, _ in self.listed()]
        return [Piece(paths[i : i + 64]) for i in range(0, len(paths), 64)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        for path, f, _, _ in self.pieces(partition):
            for i, s in enumerate(f.head["signals"]):
                yield path, i, s["label"], s["rate"], s["unit"], f.head["records"], f.head["duration"]


class EdfHeaders(DataSource):
    """A row for each file and signal, from the headers alone: 256 bytes and as many for each signal."""

    @classmethod
    def name(cls) -> str:
        return "edf_headers"

    def schema(self) -> str:
        return "path string, signal int, label string, rate double, unit string, records long, record_s double"

    def reader(self, schema) -> DataSourceReader:
        return _Headers(dict(self.options))


class _Annotations(_Reader):
    def read(self, partition: Piece) -> Iterator[tuple]:
        for path, f, a, b in self.pieces(partition):
            first, last = (min(max(-(-(x - f.head["bytes"]) // f.width), 0), f.records) if f.width else 0 for x in (a, b))
            for k, s in enumerate(f.head["signals"]):
                if s["label"] == edf.ANNOTATIONS:
                    for r, raw in enumerate(f.raw(k, first, last), first):
                        for item, (onset, length, text) in enumerate(edf.record_annotations(raw.tobytes())):
                            yield path, k, r, item, onset, length, text


class EdfAnnotations(DataSource):
    """(path, signal, record, item, onset_s, duration_s, code): what the annotation channels say, record by record."""

    @classmethod
    def name(cls) -> str:
        return "edf_annotations"

    def schema(self) -> str:
        return "path string, signal int, record long, item int, onset_s double, duration_s double, code string"

    def reader(self, schema) -> DataSourceReader:
        return _Annotations(dict(self.options))


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """One of the three sources. Spark passes filters on to Python sources only where the session says so, which this sets."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EdfEpochs, EdfHeaders, EdfAnnotations):
        spark.dataSource.register(source)
    return spark.read.format(kind).options(**options).load(path)
