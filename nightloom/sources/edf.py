"""EDF and EDF+ files: headers, physical samples of channels, and annotations.

Where ranges of files can be read, the data sources of ``edf_files`` read headers, channels and annotations without the rest.
From other stores files come whole through Spark's ``binaryFile`` reader, one task each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Widths of the header's fields of each signal, in order.
FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
ANNOTATIONS = "EDF Annotations"


def header(data: bytes) -> dict:
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    n = int(text(252, 4))
    out = {"records": int(text(236, 8)), "duration": float(text(244, 8)), "bytes": int(text(184, 8)), "start_date": text(168, 8), "start_time": text(176, 8), "signals": [{} for _ in range(n)]}
    at = 256
    for name, width in FIELDS:
        for s in out["signals"]:
            s[name] = text(at, width)
            at += width
    for s in out["signals"]:
        s["samples"] = int(s["samples"])
        s["rate"] = s["samples"] / out["duration"] if out["duration"] else 0.0
    return out


def _records(data: bytes, h: dict) -> np.ndarray:
    width = sum(s["samples"] for s in h["signals"])
    own = np.frombuffer(data, "<i2", offset=h["bytes"])
    n = len(own) // width if h["records"] < 0 else min(h["records"], len(own) // width)
    return own[: n * width].reshape(n, width)


def samples(data: bytes, h: dict, k: int, start_s: float = 0.0, stop_s: float | None = None) -> np.ndarray:
    """Physical samples of signal k, from start to stop in seconds."""
    s = h["signals"][k]
    at = sum(x["samples"] for x in h["signals"][:k])
    raw = _records(data, h)[:, at : at + s["samples"]].reshape(-1)
    low, high, dlow, dhigh = (float(s[x]) for x in ("physical_min", "physical_max", "digital_min", "digital_max"))
    stop = len(raw) if stop_s is None else int(stop_s * s["rate"])
    return (raw[int(start_s * s["rate"]) : stop].astype(np.float64) - dlow) * ((high - low) / (dhigh - dlow)) + low


def annotations(data: bytes, h: dict) -> list[tuple[float, float, str]]:
    """(onset, duration, text) of an EDF+ file's annotation signals; those without text mark time only and are left out."""
    out = []
    for k, s in enumerate(h["signals"]):
        if s["label"] != ANNOTATIONS:
            continue
        at = sum(x["samples"] for x in h["signals"][:k])
        for record in _records(data, h)[:, at : at + s["samples"]]:
            out += record_annotations(record.tobytes())
    return out


def record_annotations(record: bytes) -> list[tuple[float, float, str]]:
    """(onset, duration, text) of one data record's annotations."""
    out = []
    for item in record.split(b"\0"):
        if item:
            time, *texts = item.split(b"\x14")
            onset, _, length = time.partition(b"\x15")
            out += [(float(onset), float(length or 0), t.decode("utf-8", "replace")) for t in texts if t]
    return out


def files(spark: SparkSession, path: str, glob: str = "*.edf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _mapped(found: DataFrame, fn, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := fn(path, data):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return found.mapInArrow(run, schema)


def read_headers(spark: SparkSession, path: str, glob: str = "*.edf") -> DataFrame:
    """One row per file and signal. Only the start of each file goes to Python: a header is 256 bytes, and as many for each signal."""
    from nightloom.sources import edf_files

    if edf_files.readable(path):
        return edf_files.load(spark, "edf_headers", path, pathGlobFilter=glob)

    def fn(name: str, data: bytes) -> list[tuple]:
        h = header(data)
        return [(name, i, s["label"], s["rate"], s["unit"], h["records"], h["duration"]) for i, s in enumerate(h["signals"])]

    size = F.coalesce(F.trim(F.decode(F.substring("content", 253, 4), "US-ASCII")).try_cast("int"), F.lit(0)) * 256 + 256
    return _mapped(files(spark, path, glob).select("path", F.substring(F.col("content"), F.lit(1), size).alias("content")), fn, "path string, signal int, label string, rate double, unit string, records long, record_s double", [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.float64()])


def read_epochs(spark: SparkSession, path: str, channels: Sequence[str], epoch_s: float = 30.0, glob: str = "*.edf", spans: DataFrame | None = None) -> DataFrame:
    """(path, label, rate, epoch_idx, samples) of the channels whose label is named; whole epochs only, a batch for each
    channel. ``spans`` (path, start_s, end_s): the part of each file that is read; other files are left out."""
    from nightloom.sources import edf_files

    if spans is None and edf_files.readable(path):
        found = edf_files.load(spark, "edf", path, pathGlobFilter=glob, epochSeconds=str(epoch_s))
        return found.where(F.col("label").isin(*channels)).select("path", "label", "rate", "epoch_idx", "samples")
    wanted, kinds = set(channels), "path string, label string, rate double, epoch_idx int, samples array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, start, stop in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                h = header(data)
                for k, s in enumerate(h["signals"]):
                    if s["label"] not in wanted:
                        continue
                    x, width = samples(data, h, k, start or 0.0, stop).astype(np.float32), int(round(epoch_s * s["rate"]))
                    n = len(x) // width
                    arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x[: n * width]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([s["label"]] * n, pa.string()), pa.array([s["rate"]] * n, pa.float64()), pa.array(np.arange(n), pa.int32()), arrays], names=["path", "label", "rate", "epoch_idx", "samples"])

    found = files(spark, path, glob)
    if spans is None:
        own = found.select("path", "content", F.lit(0.0).alias("start_s"), F.lit(None).cast("double").alias("end_s"))
    else:
        key = lambda c: F.element_at(F.split(c, "/"), -1)
        own = found.join(spans.select(key("path").alias("_f"), "start_s", "end_s"), key("path") == F.col("_f")).select("path", "content", "start_s", "end_s")
    return own.mapInArrow(run, kinds)


def read_annotations(spark: SparkSession, path: str, glob: str = "*.edf") -> DataFrame:
    """(path, n, onset_s, duration_s, code), n in the order of the file: by signal, record and place. It is a number to order by,
    and dense only where files are read whole."""
    from nightloom.sources import edf_files

    if edf_files.readable(path):
        n = (F.col("signal").cast("long") * (1 << 22) + F.col("record")) * 4096 + F.col("item")
        return edf_files.load(spark, "edf_annotations", path, pathGlobFilter=glob).select("path", n.alias("n"), "onset_s", "duration_s", "code")

    def fn(name: str, data: bytes) -> list[tuple]:
        return [(name, i, *a) for i, a in enumerate(annotations(data, header(data)))]

    return _mapped(files(spark, path, glob), fn, "path string, n long, onset_s double, duration_s double, code string", [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string()])


def epoch_stages(annots: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """(path, epoch_idx, stage): annotations whose text is a stage, one epoch each, in order."""
    from pyspark.sql import Window as W

    from nightloom.operators.hypnogram import recode

    own = annots.withColumn("stage", recode(F.col("code"), mapping)).where("stage IS NOT NULL")
    return own.select("path", (F.row_number().over(W.partitionBy("path").orderBy("n")) - 1).alias("epoch_idx"), "stage")


def write(path: str, signals: list[tuple[str, float, np.ndarray]], notes: list[tuple[float, float, str]] = (), record_s: float = 1.0) -> None:
    """A small EDF+ file for tests and exports: (label, rate, samples) and annotations."""
    own = [(label, int(rate * record_s), np.asarray(x, float)) for label, rate, x in signals]
    n = min(len(x) // w for _, w, x in own)
    blocks = [[b"+%d\x14\x14\0" % i] for i in range(n)]
    for onset, length, text in notes:
        blocks[min(int(onset / record_s), n - 1)].append(b"+%g\x15%g\x14%s\x14\0" % (onset, length, text.encode()))
    notes_width = max(len(b"".join(b)) for b in blocks) // 2 + 1
    heads = [(label, w, x.min(), x.max()) for label, w, x in own] + [(ANNOTATIONS, notes_width, -1, 1)]
    number = lambda v: f"{v:.6g}" if len(f"{v:.6g}") <= 8 else f"{v:.8f}"[:8]
    pad = lambda v, k: str(v)[:k].ljust(k).encode("latin-1")
    head = pad(0, 8) + pad("X", 80) + pad("X", 80) + pad("01.01.01", 8) + pad("00.00.00", 8) + pad(256 * (len(heads) + 1), 8) + pad("EDF+C", 44) + pad(n, 8) + pad(record_s, 8) + pad(len(heads), 4)
    columns = {
        "label": [h[0] for h in heads], "transducer": [""] * len(heads), "unit": ["uV"] * len(heads), "physical_min": [number(h[2]) for h in heads], "physical_max": [number(h[3] if h[3] > h[2] else h[2] + 1) for h in heads],
        "digital_min": [-32768] * len(heads), "digital_max": [32767] * len(heads), "filter": [""] * len(heads), "samples": [h[1] for h in heads], "reserved": [""] * len(heads),
    }
    head += b"".join(pad(v, width) for name, width in FIELDS for v in columns[name])
    with open(path, "wb") as f:
        f.write(head)
        for i in range(n):
            for (_, w, x), low, high in zip(own, columns["physical_min"], columns["physical_max"], strict=False):
                a, b = float(low), float(high)
                d = (x[i * w : (i + 1) * w] - a) / (b - a) * 65535 - 32768
                f.write(np.clip(np.rint(d), -32768, 32767).astype("<i2").tobytes())
            f.write(b"".join(blocks[i]).ljust(notes_width * 2, b"\0"))
