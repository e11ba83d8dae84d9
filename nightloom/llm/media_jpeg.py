"""Media columns of progressive JPEG, coded and decoded in numpy.

The decoder accumulates the scans of a file into coefficient arrays: first passes of spectral bands, then refinements by
successive approximation. The coefficients are dequantised and transformed back with an integer-valued matrix (exact in
double precision, so that results do not depend on the order of sums), chroma is upsampled to full resolution, and
the RGB tensor is stored. Scans are decoded in lockstep: one step decodes the next symbol of every restart interval of
every file of a batch that has the same scan script, so that numpy works on wide arrays. Files without restart intervals
are decoded by the same code, an interval wide.

``encode`` stores bytes losslessly as the format's own unit, the quantised coefficient: byte b is coefficient b - 128, all
quantisers are 1, chroma is subsampled 2 x 2, and each block (in DC scans each MCU) is a restart interval. The payload's
length is in a comment segment.

Defined results: a null or empty text is stored as one unit of padding; equal texts give equal files; ties do not arise;
very long texts are coded in runs of blocks, so memory follows the text; repeated rows each return; an empty table gives no
rows; columns other than id and text are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

UNIT = 576
RUN = 1 << 14  # blocks that are coded at a time
SLICE = 1 << 20  # payload bytes of the files that are coded at a time
# (components, first and last coefficient, bit position before, bit position after)
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((1,), 1, 63, 0, 1),
    ((2,), 1, 63, 0, 1),
    ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((1,), 1, 63, 1, 0),
    ((2,), 1, 63, 1, 0),
    ((0,), 1, 63, 1, 0),
)
SAMPLING = ((2, 2), (1, 1), (1, 1))


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order of the file: along anti-diagonals, by turns up and down."""
    cells = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else -c[0]))
    return np.array([8 * x + y for x, y in cells])


ZIGZAG = zigzag()


# --- Huffman tables: (number of codes of each length, symbols) ---


def _table(groups: dict[int, list[int]]) -> tuple[list[int], list[int]]:
    return [len(groups.get(n, [])) for n in range(1, 17)], [s for n in sorted(groups) for s in groups[n]]


DC_TABLE = _table({4: list(range(12))})
_LONG = [r << 4 | s for r in range(1, 16) for s in range(1, 8)] + [0xF0] + [r << 4 for r in range(1, 15)]
FIRST_TABLE = _table({4: [0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x00], 8: _LONG})
REFINE_TABLE = _table({1: [0x00], 7: [r << 4 | 1 for r in range(16)] + [0xF0] + [r << 4 for r in range(1, 15)]})


def codes(table: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol; length 0: none."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at, c = 0, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            code[table[1][at]], length[table[1][at]] = c, n
            at, c = at + 1, c + 1
        c <<= 1
    return code, length


def lookup(table: tuple[list[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each of the 65,536 next 16 bits; length 17: no code."""
    symbol, size = np.zeros(1 << 16, np.int32), np.full(1 << 16, 17, np.int32)
    code, length = codes(table)
    for s in np.flatnonzero(length):
        a, n = int(code[s]) << (16 - int(length[s])), 1 << (16 - int(length[s]))
        symbol[a : a + n], size[a : a + n] = s, length[s]
    return symbol, size


# --- encoder ---


def _close(words: np.ndarray, sizes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of n rows, each filled up with ones, from tokens (value, bits, row) in order; and each row's length in bytes."""
    bits = np.bincount(rows, weights=sizes, minlength=n).astype(np.int64)
    length = (bits + 7) >> 3
    begin = np.r_[0, np.cumsum(length)]
    fill = length * 8 - bits
    before = np.cumsum(sizes) - sizes
    first = np.r_[0, np.cumsum(np.bincount(rows, minlength=n))]
    at = begin[rows] * 8 + before - np.r_[before, 0][first[rows]]
    some = np.flatnonzero(fill)
    at = np.r_[at, begin[some] * 8 + bits[some]]
    words, sizes = np.r_[words, (1 << fill[some]) - 1].astype(np.uint64), np.r_[sizes, fill[some]].astype(np.uint64)
    wide = words << (np.uint64(64) - (at & 31).astype(np.uint64) - sizes)
    w = at >> 5
    total = int(begin[-1])
    high = np.bincount(w, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=(total >> 2) + 3)
    low = np.bincount(w + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=(total >> 2) + 3)
    n_words = max(len(high), len(low))
    both = np.zeros(n_words)
    both[: len(high)] += high
    both[: len(low)] += low
    return both.astype(np.uint32).astype(">u4").view(np.uint8)[:total], length


def _size_of(x: np.ndarray) -> np.ndarray:
    """Bits of |x|."""
    return np.frexp(np.abs(x).astype(np.float32))[1].astype(np.int64)


def _dc_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c: DC of the six blocks of each MCU."""
    v = (c >> 1).astype(np.int64)
    d = v.copy()
    d[:, 1:4] -= v[:, 0:3]
    s = _size_of(d)
    code, length = codes(DC_TABLE)
    amp = np.where(d < 0, d + (1 << s) - 1, d)
    rows = np.repeat(np.arange(len(c)), 6)
    return _close(((code[s] << s) | amp).ravel(), (length[s] + s).ravel(), rows, len(c))


def _dc_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(c)), 6)
    return _close((c & 1).astype(np.int64).ravel(), np.ones(c.size, np.int64), rows, len(c))


def _ac_first(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c: the band of each block, towards zero by one bit."""
    n, width = c.shape
    x = (np.abs(c) >> 1).astype(np.int32) * np.sign(c)
    rows, cols = np.nonzero(x)
    x = x[rows, cols].astype(np.int64)
    new = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    run = np.where(new, cols, cols - np.r_[0, cols[:-1]] - 1)
    s = _size_of(x)
    code, length = codes(FIRST_TABLE)
    symbol = (run & 15) << 4 | s
    words, sizes = (code[symbol] << s) | np.where(x < 0, x + (1 << s) - 1, x), length[symbol] + s
    last = np.full(n, -1)
    last[rows] = cols  # the last write of a row stays
    over = np.flatnonzero(last < width - 1)
    order = rows.astype(np.int64) * 256 + cols * 2 + 1
    more = [(np.full(len(over), code[0]), np.full(len(over), length[0]), over * 256 + 255)]
    if (run > 15).any():
        far = np.repeat(np.flatnonzero(run > 15), run[run > 15] >> 4)
        more.append((np.full(len(far), code[0xF0]), np.full(len(far), length[0xF0]), order[far] - 1))
    words, sizes, order = (np.concatenate([a, *b]) for a, b in zip((words, sizes, order), zip(*more, strict=True), strict=True))
    if len(over) or len(more) > 1:
        by = np.argsort(order, kind="stable")
        words, sizes, order = words[by], sizes[by], order[by]
    return _close(words, sizes, order >> 8, n)


def _refine_bits(c: list[int]) -> list[int]:
    """Bits of one block's refinement, for blocks where a coefficient becomes significant."""
    code, length = codes(REFINE_TABLE)
    put = lambda s: [int(code[s]) >> (int(length[s]) - 1 - i) & 1 for i in range(int(length[s]))]
    last = max(i for i, v in enumerate(c) if abs(v) == 1)
    out, held, run = [], [], 0
    for i, v in enumerate(c):
        if v == 0:
            run += 1
            continue
        while run > 15 and i <= last:
            out += put(0xF0) + held
            held, run = [], run - 16
        if abs(v) > 1:
            held.append(abs(v) & 1)
        else:
            out += put(run << 4 | 1) + [int(v > 0)] + held
            held, run = [], 0
    return out + put(0) + held if run or held else out


def _refine_tokens(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of the refinements of blocks where coefficients become significant, none behind more than 15 zeros. A
    symbol stands behind the coefficient before it that becomes significant; the corrections up to its own follow it."""
    code, length = codes(REFINE_TABLE)
    n, width = c.shape
    a = np.abs(c)
    rows, cols = np.nonzero(a == 1)
    first = np.r_[True, rows[1:] != rows[:-1]]
    before = np.where(first, -1, np.r_[-1, cols[:-1]])
    zeros = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(a == 0, axis=1)], axis=1)
    run = zeros[rows, cols] - zeros[rows, before + 1]
    symbol = run << 4 | 1
    words, sizes, order = code[symbol] << 1 | (c[rows, cols] > 0), length[symbol] + 1, (rows * (width + 1) + before + 1) * 2 + 1
    last = np.full(n, -1)
    last[rows] = cols  # the last write of a row stays
    over = np.flatnonzero(last < width - 1)
    r, k = np.nonzero(a > 1)
    words = np.r_[words, np.full(len(over), code[0]), a[r, k] & 1]
    sizes = np.r_[sizes, np.full(len(over), length[0]), np.ones(len(r), np.int64)]
    order = np.r_[order, (over * (width + 1) + last[over] + 1) * 2 + 1, (r * (width + 1) + k + 1) * 2]
    by = np.argsort(order, kind="stable")
    return _close(words[by], sizes[by], order[by] // (2 * (width + 1)), n)


def _ac_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.abs(c)
    old = a > 1
    bits = 1 + old.sum(1)
    slow = np.flatnonzero((a == 1).any(1))
    length = (bits + 7) >> 3
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, bytes, lengths
    if len(slow):
        zeros = np.cumsum(a[slow] == 0, axis=1)
        far = zeros[:, -1] > 15  # a symbol may have to stand for 16 zeros
        near = slow[~far]
        if len(near):
            parts.append((near, *_refine_tokens(c[near])))
        if far.any():
            own = [np.packbits(np.array(x + [1] * (-len(x) % 8), dtype=np.uint8)) for x in (_refine_bits(c[i].tolist()) for i in slow[far])]
            parts.append((slow[far], np.concatenate(own), np.array([len(x) for x in own])))
        for rows, _, lens in parts:
            length[rows] = lens
    begin = np.r_[0, np.cumsum(length)]
    out = np.ones(int(begin[-1]) * 8, np.uint8)
    plain = np.ones(len(c), bool)
    plain[slow] = False
    out[begin[:-1][plain] * 8] = 0  # the code of a block's end
    where = old & plain[:, None]
    at = begin[:-1, None] * 8 + np.cumsum(old, axis=1)
    out[at[where]] = (a[where] & 1).astype(np.uint8)
    data = np.packbits(out)
    for rows, own, lens in parts:
        data[np.repeat(begin[rows] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(len(own))] = own
    return data, length


def _marked(data: np.ndarray, length: np.ndarray, mark: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Rows with a zero after each 255 and, where mark is not 0, a restart marker after the row; and the rows' new lengths."""
    ff = data == 255
    row = np.repeat(np.arange(len(length)), length)
    extra = np.bincount(row, weights=ff, minlength=len(length)).astype(np.int64)
    new = length + extra + 2 * (mark > 0)
    gap = np.r_[0, np.cumsum(2 * (mark > 0))[:-1]]
    at = np.arange(len(data)) + np.cumsum(ff) - ff + gap[row]
    out = np.zeros(int(new.sum()), np.uint8)
    out[at] = data
    end = np.cumsum(new)[mark > 0]
    out[end - 2] = 255
    out[end - 1] = mark[mark > 0]
    return out.tobytes(), new


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _sizes(payload: int) -> tuple[int, int]:
    """MCUs across and down for a payload."""
    n = -(-payload // 384)
    w = int(np.ceil(np.sqrt(n)))
    return w, -(-n // w)


def _mcu_order(w: int, h: int) -> np.ndarray:
    """Raster places of the four luma blocks of each MCU."""
    y, x = np.divmod(np.arange(w * h), w)
    return ((2 * y)[:, None] + np.array([0, 0, 1, 1])) * (2 * w) + (2 * x)[:, None] + np.array([0, 1, 0, 1])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload."""
    if not payloads:
        return []
    dims = [_sizes(len(p)) for p in payloads]
    mcus = np.array([w * h for w, h in dims])
    planes = [np.zeros((int(mcus.sum()) * k, 64), np.int16) for k in (4, 1, 1)]
    at = np.r_[0, np.cumsum(mcus)]
    order = []
    for i, (p, (w, h)) in enumerate(zip(payloads, dims, strict=True)):
        flat = np.zeros(w * h * 384, np.int16)
        flat[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
        m, b = w * h, at[i]
        planes[0][4 * b : 4 * (b + m)] = flat[: m * 256].reshape(-1, 64)
        planes[1][b : b + m] = flat[m * 256 : m * 320].reshape(-1, 64)
        planes[2][b : b + m] = flat[m * 320 :].reshape(-1, 64)
        order.append(_mcu_order(w, h) + 4 * b)
    dc = np.column_stack([planes[0][:, 0][np.concatenate(order)], planes[1][:, 0], planes[2][:, 0]])
    scans: list[list[bytes]] = [[] for _ in payloads]
    for parts, first, last, high, _ in SCRIPT:
        source = dc if len(parts) > 1 else planes[parts[0]][:, first : last + 1]
        each = mcus * (4 if parts == (0,) else 1)
        fn = (_dc_refine if high else _dc_first) if len(parts) > 1 else (_ac_refine if high else _ac_first)
        starts = np.r_[0, np.cumsum(each)]
        place = np.arange(len(source)) - np.repeat(starts[:-1], each)
        mark = 0xD0 + place % 8
        mark[starts[1:] - 1] = 0
        data, lengths = [], []
        for a in range(0, len(source), RUN):
            d, n = _marked(*fn(source[a : a + RUN]), mark[a : a + RUN])
            data.append(d)
            lengths.append(n)
        whole, ends = b"".join(data), np.r_[0, np.cumsum(np.concatenate(lengths))][starts]
        for i in range(len(payloads)):
            scans[i].append(whole[ends[i] : ends[i + 1]])
    huff = b"".join(bytes([k]) + bytes(t[0]) + bytes(t[1]) for k, t in ((0x00, DC_TABLE), (0x10, FIRST_TABLE), (0x11, REFINE_TABLE)))
    tables = _segment(0xDB, b"\0" + b"\1" * 64)
    heads = []
    for parts, first, last, high, low in SCRIPT:
        use = 0x01 if high and first else 0x00
        heads.append(_segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p + 1, use]) for p in parts) + bytes([first, last, high << 4 | low])))
    out = []
    for p, (w, h), own in zip(payloads, dims, scans, strict=True):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(SAMPLING))
        start = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + tables + _segment(0xC2, frame) + _segment(0xC4, huff) + _segment(0xDD, struct.pack(">H", 1))
        out.append(start + b"".join(a + b for a, b in zip(heads, own, strict=True)) + b"\xff\xd9")
    return out


# --- decoder ---


@dataclass
class Scan:
    parts: tuple[int, ...]
    dc: tuple[int, ...]
    ac: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    restart: int
    tables: dict[int, tuple[list[int], list[int]]]
    data: tuple[int, int] = (0, 0)

    def key(self) -> tuple:
        return (self.parts, self.dc, self.ac, self.first, self.last, self.high, self.low, tuple((k, tuple(t[0]), tuple(t[1])) for k, t in sorted(self.tables.items())))


@dataclass
class File:
    data: bytes
    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant_of: list[int] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    def mcus(self) -> tuple[int, int]:
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def grid(self, c: int) -> tuple[int, int]:
        """Blocks across and down that are stored for a component (whole MCUs)."""
        w, h = self.mcus()
        return w * self.sampling[c][0], h * self.sampling[c][1]

    def scanned(self, c: int) -> tuple[int, int]:
        """Blocks across and down in a scan of the component alone."""
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-(-(-self.width * self.sampling[c][0] // h)) // 8), -(-(-(-self.height * self.sampling[c][1] // v)) // 8)


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes) -> File:
    f, at, ids, tables, restart = File(data), 2, [], {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at < len(data):
        if data[at] != 255:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 255:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            f.comment = body
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                f.quant[body[i] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.float64)
                i += 65 + 64 * (wide > 0)
        elif marker == 0xC2:
            _, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            for i in range(n):
                k, s, q = body[6 + 3 * i : 9 + 3 * i]
                ids.append(k)
                f.sampling.append((s >> 4, s & 15))
                f.quant_of.append(q)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman-coded files are read")
        elif marker == 0xC4:
            tables, i = dict(tables), 0
            while i < len(body):
                counts = list(body[i + 1 : i + 17])
                tables[body[i]] = (counts, list(body[i + 17 : i + 17 + sum(counts)]))
                i += 17 + sum(counts)
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            parts = tuple(ids.index(body[1 + 2 * i]) for i in range(n))
            use = [body[2 + 2 * i] for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            f.scans.append(Scan(parts, tuple(u >> 4 for u in use), tuple(u & 15 for u in use), first, last, approx >> 4, approx & 15, restart, tables, (at, stop)))
            at = stop
    return f


class Bits:
    """Entropy-coded data of some files' scans in a row, without stuffing and markers; reads at many places at once."""

    def __init__(self, parts: list[bytes]):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        lens = np.array([len(p) for p in parts])
        begin = np.r_[0, np.cumsum(lens)]
        before = np.r_[np.uint8(0), raw[:-1]]
        after_ff = before == 255
        after_ff[begin[:-1][lens > 0]] = False
        mark = after_ff & (raw >= 0xD0) & (raw <= 0xD7)
        drop = after_ff & (raw == 0) | mark
        drop[:-1] |= mark[1:]
        kept = np.r_[0, np.cumsum(~drop)]
        self.start = np.sort(np.r_[kept[begin[:-1]], kept[np.flatnonzero(mark) + 1]])
        self.per_file = 1 + np.r_[0, np.cumsum(mark)][begin[1:]] - np.r_[0, np.cumsum(mark)][begin[:-1]]
        data = np.r_[raw[~drop], np.full(8, 255, np.uint8)].astype(np.uint32)
        self.window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        self.bytes = data.astype(np.uint8)

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """The next n bits (up to 16; an array or a number) at bit places."""
        w = self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint32)
        return (w >> (np.uint32(32) - np.asarray(n).astype(np.uint32))).astype(np.int64)

    def single(self, at: np.ndarray) -> np.ndarray:
        return self.bytes[np.minimum(at >> 3, len(self.bytes) - 1)] >> (7 - (at & 7)).astype(np.uint8) & 1


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v) * (s > 0)


def _read_dc(bits: Bits, at: np.ndarray, scan: Scan, out: list[np.ndarray], blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """One MCU of each interval. blocks: (place in the scan, rows of the plane, predictions) of each of its blocks."""
    for k, rows, pred in blocks:
        plane = out[scan.parts[k]]
        if scan.high:
            plane[rows, 0] |= bits.single(at).astype(plane.dtype) << scan.low
            at = at + 1
            continue
        symbol, size = lookup_of(scan.tables, scan.dc[k])
        c = bits.peek(at, 16)
        s, at = symbol[c].astype(np.int64), at + size[c]
        v = np.where(s > 0, bits.peek(at, np.maximum(s, 1)), 0)
        at = at + s
        pred += _extend(v, s)
        plane[rows, 0] = pred << scan.low
    return at


def lookup_of(tables: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    t = tables[k]
    key = (tuple(t[0]), tuple(t[1]))
    if key not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[key] = lookup(t)
    return _LOOKUPS[key]


_LOOKUPS: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _read_first(bits: Bits, at: np.ndarray, end_run: np.ndarray, scan: Scan, plane: np.ndarray, rows: np.ndarray) -> None:
    """A band of one block of each interval; changes at and end_run."""
    symbol, size = lookup_of(scan.tables, 0x10 | scan.ac[0])
    go = np.flatnonzero(end_run == 0)
    end_run[end_run > 0] -= 1
    p, k, row = at[go], np.full(len(go), scan.first), rows[go]
    while len(go):
        c = bits.peek(p, 16)
        both = symbol[c]
        p += size[c]
        r, s = both >> 4, both & 15
        some = s > 0
        v = bits.peek(p, np.maximum(s, 1))
        if some.all():
            k += r
            plane[row, np.minimum(k, 63)] = _extend(v, s) << scan.low
            p += s
            k += 1
            stop = k > scan.last
        else:
            zrl = ~some & (r == 15)
            ends = ~some & ~zrl
            k += np.where(ends, 0, r)
            i = np.flatnonzero(some)
            plane[row[i], np.minimum(k[i], 63)] = _extend(v[i], s[i]) << scan.low
            p += np.where(some, s, 0)
            i = np.flatnonzero(ends)
            extra = np.where(r[i] > 0, bits.peek(p[i], np.maximum(r[i], 1)), 0)
            end_run[go[i]] = (1 << r[i]) - 1 + extra
            p[i] += r[i]
            k += 1
            stop = ends | (k > scan.last)
        if stop.any():
            at[go[stop]] = p[stop]
            stay = ~stop
            go, p, k, row = go[stay], p[stay], k[stay], row[stay]


def _read_symbols(bits: Bits, at: np.ndarray, end_run: np.ndarray, scan: Scan, band: np.ndarray) -> None:
    """Refinements that have symbols of their own, one of each block a step; changes at, end_run and band.

    A symbol's run counts the coefficients that are still zero, so the place of the next new one follows from the places of
    the zeros; the corrections that are passed on the way stand in a row, and are made together at the end."""
    symbol, size = lookup_of(scan.tables, 0x10 | scan.ac[0])
    n, width = band.shape
    old = band != 0
    passed = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(old, axis=1)], axis=1)  # significant ones before a place
    zeros, olds = np.argsort(old, axis=1, kind="stable"), np.argsort(~old, axis=1, kind="stable")
    free = width - passed[:, width]
    go, k = np.arange(n), np.zeros(n, np.int64)
    rows, cols, places = [], [], []
    new = np.zeros_like(band)
    while len(go):
        p = at[go]
        c = bits.peek(p, 16)
        both = symbol[c].astype(np.int64)
        p = p + size[c]
        r, value = both >> 4, (both & 15) > 0
        sign = np.where(value, bits.single(p).astype(np.int64), 0)
        p += value
        ends = ~value & (r < 15)
        if ends.any():
            i = np.flatnonzero(ends)
            extra = np.where(r[i] > 0, bits.peek(p[i], np.maximum(r[i], 1)), 0)
            end_run[go[i]] = (1 << r[i]) - 1 + extra
            p[i] += r[i]
        here = k[go]
        nth = here - passed[go, here] + r
        found = ~ends & (nth < free[go])
        stop = np.where(found, zeros[go, np.minimum(nth, width - 1)], width)
        some = passed[go, stop] - passed[go, here]
        if some.any():
            each = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            rows.append(np.repeat(go, some))
            cols.append(olds[rows[-1], np.repeat(passed[go, here], some) + each])
            places.append(np.repeat(p, some) + each)
            p += some
        i = np.flatnonzero(found & value)
        new[go[i], stop[i]] = np.where(sign[i] > 0, 1 << scan.low, -(1 << scan.low))
        at[go], k[go] = p, stop + 1
        go = go[~ends & (stop + 1 < width)]
    if rows:
        r, c = np.concatenate(rows), np.concatenate(cols)
        v = band[r, c]
        band[r, c] = v + np.sign(v) * (bits.single(np.concatenate(places)).astype(band.dtype) & ~(np.abs(v) >> scan.low) & 1) * (1 << scan.low)
    band += new


def _read_refine(bits: Bits, at: np.ndarray, end_run: np.ndarray, scan: Scan, plane: np.ndarray, rows: np.ndarray) -> None:
    """A refinement of one block of each interval; blocks that only have correction bits are read all at once, the others symbol
    by symbol, side by side."""
    symbol, size = lookup_of(scan.tables, 0x10 | scan.ac[0])
    c = bits.peek(at, 16)
    over = end_run > 0  # within a run of ended blocks
    plain = ~over & (symbol[c] == 0)
    slow = np.flatnonzero(~over & ~plain)
    i = np.flatnonzero(plain | over)
    if len(i):
        p = at[i] + np.where(plain[i], size[c[i]], 0)
        band = plane[rows[i], scan.first : scan.last + 1]
        old = band != 0
        places = p[:, None] + np.cumsum(old, axis=1) - 1
        r, k = np.nonzero(old)
        bit = bits.single(places[r, k]).astype(plane.dtype)
        v = band[r, k]
        band[r, k] = v + np.sign(v) * (bit & ~(np.abs(v) >> scan.low) & 1) * (1 << scan.low)
        plane[rows[i], scan.first : scan.last + 1] = band
        at[i] = p + old.sum(1)
        end_run[i] = np.maximum(end_run[i] - 1, 0)
    if len(slow):
        band = plane[rows[slow], scan.first : scan.last + 1]
        p, e = at[slow], end_run[slow]
        _read_symbols(bits, p, e, scan, band)
        plane[rows[slow], scan.first : scan.last + 1], at[slow], end_run[slow] = band, p, e


def coefficients(files: list[File]) -> list[list[np.ndarray]]:
    """Each file's coefficient arrays, one per component: (blocks in raster order, 64 in the file's order)."""
    n_parts = len(files[0].sampling)
    sizes = [[f.grid(c)[0] * f.grid(c)[1] for c in range(n_parts)] for f in files]
    base = np.r_[np.zeros((1, n_parts), np.int64), np.cumsum(sizes, axis=0)]
    planes = [np.zeros((int(base[-1, c]), 64), np.int32) for c in range(n_parts)]
    for k, scan in enumerate(files[0].scans):
        bits = Bits([f.data[f.scans[k].data[0] : f.scans[k].data[1]] for f in files])
        rows = []  # for each file and unit of the scan, the rows of its blocks
        for i, f in enumerate(files):
            if len(scan.parts) == 1:
                c = scan.parts[0]
                (w, h), across = f.scanned(c), f.grid(c)[0]
                rows.append((np.arange(h)[:, None] * across + np.arange(w)).reshape(-1, 1) + base[i, c])
            else:
                w, h = f.mcus()
                y, x = np.divmod(np.arange(w * h), w)
                own = []
                for c in scan.parts:
                    sh, sv = f.sampling[c]
                    own += [(y * sv + b) * (w * sh) + x * sh + a + base[i, c] for b in range(sv) for a in range(sh)]
                rows.append(np.column_stack(own))
        units = np.array([len(r) for r in rows])
        rows = np.concatenate(rows)
        # The first unit and the number of units of each interval.
        gap = np.array([f.scans[k].restart or n for f, n in zip(files, units, strict=True)])
        want = -(-units // gap)
        if not np.array_equal(want, bits.per_file):
            raise ValueError("a scan has another number of restart intervals than its frame")
        owner = np.repeat(np.arange(len(files)), want)
        nth = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(want)[:-1]], want)
        begin = np.r_[0, np.cumsum(units)[:-1]][owner] + nth * gap[owner]
        count = np.minimum(gap[owner], units[owner] - nth * gap[owner])
        blocks_of = [j for j, c in enumerate(scan.parts) for _ in range(files[0].sampling[c][0] * files[0].sampling[c][1])] if len(scan.parts) > 1 else [0]
        for a in range(0, len(begin), RUN):
            b = slice(a, a + RUN)
            at, first, number = bits.start[b] * 8, begin[b], count[b]
            end_run, preds = np.zeros(len(at), np.int64), [np.zeros(len(at), np.int64) for _ in scan.parts]
            for j in range(int(number.max())):
                go = number > j
                every = bool(go.all())
                here = np.flatnonzero(go)
                unit = rows[first[here] + j]
                p, e = (at, end_run) if every else (at[here], end_run[here])
                if scan.first == 0:
                    own = [x if every else x[here] for x in preds]
                    p = _read_dc(bits, p, scan, planes, [(q, unit[:, m], own[q]) for m, q in enumerate(blocks_of)])
                    for x, y in zip(preds, own, strict=True):
                        x[here] = y
                else:
                    (_read_refine if scan.high else _read_first)(bits, p, e, scan, planes[scan.parts[0]], unit[:, 0])
                at[here], end_run[here] = p, e
    return [[planes[c][base[i, c] : base[i + 1, c]] for c in range(n_parts)] for i in range(len(files))]


_BASIS = np.rint(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * 8192)
#: (coefficient in the file's order, pixel): whole numbers, so that sums in double precision are exact.
INVERSE = np.einsum("ux,vy->uvxy", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG]


def pixels(c: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks of samples, 0 to 255."""
    out = np.empty((len(c), 64), np.uint8)
    for a in range(0, len(c), RUN):
        out[a : a + RUN] = np.clip(np.floor((c[a : a + RUN] * quant) @ INVERSE / (1 << 26) + 128.5), 0, 255)
    return out


def tensor(f: File, planes: list[np.ndarray]) -> np.ndarray:
    """The full-resolution image: (height, width, 3) of bytes; one component is repeated."""
    top = max(s[0] for s in f.sampling), max(s[1] for s in f.sampling)
    full = []
    for c, blocks in enumerate(planes):
        w, h = f.grid(c)
        plane = pixels(blocks, f.quant[f.quant_of[c]]).reshape(h, w, 8, 8).swapaxes(1, 2).reshape(h * 8, w * 8)
        plane = plane.repeat(top[1] // f.sampling[c][1], axis=0).repeat(top[0] // f.sampling[c][0], axis=1)
        full.append(plane[: f.height, : f.width].astype(np.int32))
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = full[0] * 65536 + 32768, full[1] - 128, full[2] - 128
    # The format's colour matrix, in 65,536ths.
    rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2) >> 16
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decode(media: list[bytes]) -> list[tuple[File, list[np.ndarray]]]:
    """Header and coefficient arrays of each file. Files of one scan script are decoded together."""
    files = [parse(m) for m in media]
    by: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        by.setdefault((tuple(f.sampling), tuple(s.key() for s in f.scans)), []).append(i)
    out: list = [None] * len(files)
    for some in by.values():
        for i, planes in zip(some, coefficients([files[i] for i in some]), strict=True):
            out[i] = (files[i], planes)
    return out


def payload(f: File, planes: list[np.ndarray]) -> bytes:
    """The bytes that encode() stored."""
    n = int(f.comment.removeprefix(b"payload "))
    return (np.concatenate([p.reshape(-1) for p in planes]) + 128)[:n].astype(np.uint8).tobytes()


def padded(data: bytes) -> bytes:
    n = max(1, -(-len(data) // UNIT)) * UNIT
    return data + b"\xff" * (n - len(data))


def feature(f: File, image: np.ndarray) -> str:
    """Size, mean of each colour in thousandths, and a checksum of the tensor."""
    means = image.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (image.shape[0] * image.shape[1])
    return f"{f.width}x{f.height}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(image.tobytes()):08x}"


# --- columns ---


def _slices(data: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for x in data:
        if own and size + len(x) > SLICE:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x)
    if own:
        yield own


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: the text's bytes as a JPEG file."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for some in _slices(common.texts(batch, "_text")):
                media = encode([padded(x) for x in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(some)), pa.array([len(x) for x in some], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])
                done += len(some)

    return common.keyed(docs, id_col, text_col).toDF(id_col, "_text").mapInArrow(run, f"{id_col} {key}, n_bytes long, media binary")


def _read(media: DataFrame, id_col: str, fields: str, values) -> DataFrame:
    key = media.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for some in _slices([x or b"" for x in batch.column(2).to_pylist()]):
                rows = [values(m, f, planes) for m, (f, planes) in zip(some, decode(some), strict=True)]
                own = batch.slice(done, len(some))
                done += len(some)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array(c) for c in zip(*rows, strict=True)]], names=[id_col, "n_bytes", *names])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"{id_col} {key}, n_bytes long, {fields}")


def tensor_column(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, height, width and the RGB tensor's bytes in rows."""

    def values(m: bytes, f: File, planes: list[np.ndarray]) -> tuple:
        return f.height, f.width, tensor(f, planes).tobytes()

    return _read(media, id_col, "height long, width long, rgb binary", values)


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored files give back: sizes and hashes of payload and file, and the tensor's features."""

    def values(m: bytes, f: File, planes: list[np.ndarray]) -> tuple:
        data = payload(f, planes)
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(f, tensor(f, planes))

    return _read(media, id_col, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", values)
