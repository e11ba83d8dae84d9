"""Language-model scores by deleted interpolation.

The model's probability of a token is a mixture of maximum-likelihood estimates: of the bigram, of the word, and a uniform
share; and for an order above two, of each longer n-gram and the mixture below it. The mixture's weights depend on how
often the context was seen, in buckets of powers of two, and are learned by expectation-maximisation on held-out counts: a
ninth of the training texts is kept back, its tokens are seen with counts of the rest only, and the weights are those that
make it most likely. The final estimates use all training texts.

Neither the counts nor the texts fit one machine, and shipping each token to its count and back would move the corpus
several times. So texts are read into blocks of a few million tokens. A block asks for each of its distinct words and
n-grams once: the sorted hashes go to the counting task that owns them, as one compressed array for each pair of block and
task that has any. The answer is an array of counts in the order of the question. The texts are read and hashed once: a block
is written as the numbers of its words in its own vocabulary, which questions, weights and scores are made from; it is
joined to its answers by its number. Contexts are counted as the n-grams that they are, and n-grams are spread by the hash of all their words, so a
very frequent word is no hot task. Nothing is dropped, capped or sampled. Only histograms of held-out estimates on a
fixed grid reach the driver.

Memory follows ``BLOCK_TOKENS`` and ``TASK_BYTES``, not the corpus. The number of questions is at most that of the
distinct n-grams of all blocks; each costs some 100 bytes besides its keys, which count where a block has less than about
50 keys for a task, at corpora of more than about 100 GB.

Defined results: null and empty texts are one end token; a null id counts as the empty text in the fold and is not
learned from; repeated rows each teach and return; without training texts all counts are 0 and the score is the uniform
share's; a very long text is a block of its own; an empty table gives no rows; columns other than id and text are never
read. Words are told apart by 64-bit hashes, longer n-grams by 60 bits of theirs: of the 10^13 of some hundred terabytes one in
100,000 shares its number with another. The rows may come in any order, and in another one each time they
are read: the table is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\x00begin"))
ORDER = 3
BUCKETS, OCTAVE, LEVELS = 24, 4, 160
BLOCK_TOKENS = 1_500_000
#: Bytes of a row group of blocks, so that a task that reads them holds a few.
ROW_GROUP = 16 << 20
#: Bytes of text for each counting task; a task's memory follows this, not the corpus.
TASK_BYTES = 4 << 20


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    wide = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(wide.T.tobytes())


def unpack_ints(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1) if len(raw) else np.zeros(0, kind)


def pack_keys(x: np.ndarray) -> bytes:
    """64-bit keys by their differences, modulo 2^64; small where keys are sorted, as words of one frequency are."""
    return pack_ints(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data, np.uint64), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2^28, small ones in fewer bytes: seven bits a byte, of which the last one has its highest bit set. Bytes of a
    number stay together, so phrases that come again are compressed."""
    x = x.astype(np.int64)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(4):
        some = size > k
        out[ends[some] - 1 - k] = (x[some] >> (7 * k)) & 127
    out[ends - 1] |= 128
    return zstandard.ZstdCompressor(level=6).compress(out.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    ends = np.flatnonzero(raw & 128)
    size = np.diff(ends, prepend=-1)
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        some = size > k
        out[some] |= (raw[ends[some] - k].astype(np.int64) & 127) << (7 * k)
    return out


def joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of contexts with the word behind each."""
    with np.errstate(over="ignore"):
        x = common.mix(word)
        x += before * np.uint64(0x9E3779B97F4A7C15)
        return common.mix(x)


def owner(keys: np.ndarray, parts: int) -> np.ndarray:
    """The counting task of a key, by its highest 32 bits; ascending where keys are."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def starts_of(lens: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)


#: Lowest bits of the hashes of n-grams above the first order that are left out, and so need no place in questions.
SPARED = np.uint64(4)


def grams(words: np.ndarray, lens: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The hash of the n-gram that ends at each token, for n from 1 to order; texts begin behind as many begin marks."""
    own, first = words, starts_of(lens)
    yield own
    begin = np.array([BEGIN])
    for _ in range(order - 1):
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = begin
        own = joined(before, words)
        yield own >> SPARED << SPARED
        begin = joined(begin, np.array([BEGIN]))


def number_of(words: np.ndarray, lens: np.ndarray, ids: list, place: tuple) -> int:
    """A block's number: of its contents and its place, which tells blocks of equal contents apart."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(repr((place, ids)).encode() + words.tobytes() + lens.tobytes())).astype(np.int64))


_BINARIES = pa.list_(pa.binary())


def questions(texts: DataFrame, parts: int, order: int) -> DataFrame:
    """dest (the counting task), block, kept, and for each n the block's distinct n-grams there and how often training texts
    of the block have them."""
    names = ["dest", "block", "kept", "keys", "counts"]

    def asked(block: int, kept: bool, folds: np.ndarray, words: np.ndarray, lens: np.ndarray) -> Iterator[pa.RecordBatch]:
        train = np.repeat((folds != 0).astype(np.float64), lens)
        rows: dict[int, tuple[list, list]] = {}
        for k, own in enumerate(grams(words, lens, order)):
            keys, at = np.unique(own, return_inverse=True)
            some = np.bincount(at, weights=train, minlength=len(keys)).astype(np.uint32)
            del at
            of = owner(keys, parts)
            begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for p, i, j in zip(of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
                row = rows.setdefault(p, ([b""] * order, [b""] * order))
                row[0][k], row[1][k] = pack_keys(keys[i:j] >> SPARED if k else keys[i:j]), pack_ints(some[i:j])
        at = sorted(rows)
        for a in range(0, len(at), 256):
            some = at[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([kept] * len(some)), *[pa.array([rows[p][i] for p in some], _BINARIES) for i in (0, 1)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, kept, folds, lens, numbers, vocabulary = (batch.column(k)[i] for k in range(6))
                lens, words = np.asarray(lens.values).astype(np.int64), unpack_keys(vocabulary.as_py())[unpack_numbers(numbers.as_py())]
                yield from asked(block.as_py(), kept.as_py(), np.asarray(folds.values), words, lens)

    return texts.select("block", "kept", "folds", "lens", "numbers", "vocabulary").mapInArrow(run, "dest int, block long, kept boolean, keys array<binary>, counts array<binary>")


def counted(asked: DataFrame, order: int) -> DataFrame:
    """block, part, kept, full and rest: the answers in the order of the questions, with all training texts and (for blocks that
    are kept back) without those kept back; and a row without a block, each task's totals."""

    def fn(table: pa.Table) -> pa.Table:
        dest, block, kept = (table.column(c).to_pylist() for c in ("dest", "block", "kept"))
        asked_keys, asked_counts = table.column("keys"), table.column("counts")
        full, rest = [[] for _ in block], [[] for _ in block]
        totals = [0] * 6
        for k in range(order):
            keys = [unpack_keys(x) << (SPARED if k else np.uint64(0)) if (x := asked_keys[i][k].as_py()) else np.zeros(0, np.uint64) for i in range(len(block))]
            counts = [unpack_ints(x, np.uint32).astype(np.float64) if (x := asked_counts[i][k].as_py()) else np.zeros(0) for i in range(len(block))]
            lens = np.array([len(x) for x in keys])
            uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
            weight = np.concatenate(counts)
            del keys, counts
            all_ = np.bincount(at, weights=weight, minlength=len(uniq))
            less = all_ - np.bincount(at, weights=weight * np.repeat(kept, lens), minlength=len(uniq))
            if k == 0:
                end = uniq == END
                totals = [int(x) for own in (all_, less) for x in (own.sum(), (own > 0).sum(), own[end].sum())]
            for r, (i, n) in enumerate(zip(starts_of(lens).tolist(), lens.tolist(), strict=True)):
                own = at[i : i + n]
                full[r].append(pack_ints(all_[own].astype(np.uint64)) if n else b"")
                if kept[r]:
                    rest[r].append(pack_ints(less[own].astype(np.uint64)) if n else b"")
        return pa.table({
            "block": pa.array([*block, None], pa.int64()), "part": pa.array([*dest, None], pa.int32()), "kept": pa.array([*kept, None], pa.bool_()),
            "full": pa.array([*full, None], _BINARIES), "rest": pa.array([*rest, None], _BINARIES), "n": pa.array([*[None] * len(block), totals], pa.list_(pa.int64())),
        })

    return asked.groupBy("dest").applyInArrow(fn, "block long, part int, kept boolean, full array<binary>, rest array<binary>, n array<long>")


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, kept, ids, folds, lens, the number of each token's word, and the vocabulary, the most frequent word first. Texts that
    are kept back for the weights have blocks of their own."""
    key_name = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        size, count, key = {True: 0, False: 0}, {True: 0, False: 0}, None
        task = TaskContext.get().partitionId()

        def block(side: bool) -> pa.RecordBatch:
            own, held[side], size[side] = held[side], [], 0
            count[side] += 1
            ids, folds, hashes = zip(*own, strict=True)
            words, lens = np.concatenate(hashes), np.array([len(w) for w in hashes])
            uniq, inverse, often = np.unique(words, return_inverse=True, return_counts=True)
            rank = np.empty(len(uniq), np.uint32)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(uniq), dtype=np.uint32)
            number = number_of(words, lens, [*ids], (task, side, count[side]))
            columns = [pa.array([number], pa.int64()), pa.array([side]), pa.array([[*ids]], pa.list_(key)), pa.array([folds], pa.list_(pa.int32())), pa.array([lens.tolist()], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pack_numbers(rank[inverse])]), pa.array([pack_keys(uniq[np.argsort(rank)])])], names=["block", "kept", "ids", "folds", "lens", "numbers", "vocabulary"])

        for batch in batches:
            key = batch.schema.field(0).type
            for i, f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch, "_text"), strict=True):
                own = np.append(common.word_hashes(data.translate(common.ASCII_LOWER)), END)
                side = f == 9
                held[side].append((i, f, own))
                size[side] += len(own)
                if size[side] >= BLOCK_TOKENS:
                    yield block(side)
        for side in (True, False):
            if held[side]:
                yield block(side)

    small = common.keyed(docs, id_col, text_col).toDF("_id", "_text")
    small = small.select("_id", common.fold(F.col("_id"), 10).cast("int").alias("_fold"), "_text")
    return small.mapInArrow(run, f"block long, kept boolean, ids array<{key_name}>, folds array<int>, lens array<int>, numbers binary, vocabulary binary")


@dataclass(frozen=True)
class Totals:
    tokens: int
    kinds: int
    texts: int


@dataclass
class Estimates:
    """By token: the count of its word, the maximum-likelihood estimate of each n-gram from the word on, and for those from
    the bigram on the bucket of the context."""

    lens: np.ndarray
    word: np.ndarray
    likely: list[np.ndarray]
    bucket: list[np.ndarray]


def estimates(block: pa.Table, answers: pa.Table, without_kept: bool, totals: Totals, order: int) -> Estimates:
    if block.num_rows != 1:
        raise ValueError("a block has no row of its own")
    own = block.select(["lens", "numbers", "vocabulary"]).to_pylist()[0]
    rows = sorted(answers.select(["part", "rest" if without_kept else "full"]).to_pylist(), key=lambda r: r["part"])
    lens, number, vocabulary = np.array(own["lens"], dtype=np.int64), unpack_numbers(own["numbers"]), unpack_keys(own["vocabulary"])
    words, first = vocabulary[number], starts_of(lens)
    found: list[np.ndarray] = []
    for k, hashes in enumerate(grams(words, lens, order)):
        parts = [unpack_ints(x, np.uint64) for r in rows if (x := r["rest" if without_kept else "full"][k])]
        counts = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
        keys, at = np.unique(hashes, return_inverse=True)
        if len(keys) != len(counts):
            raise ValueError("a block's answers do not fit it")
        found.append(counts[at])
        del keys, at
    likely, bucket = [found[0] / max(totals.tokens, 1)], []
    for k in range(1, order):
        context = np.empty(len(words))
        context[1:] = found[k - 1][:-1]
        context[first] = totals.texts
        likely.append(np.minimum(found[k] / np.maximum(context, 1), 1.0))
        bucket.append(np.minimum(np.log2(context + 1).astype(np.int8), BUCKETS - 1))
    return Estimates(lens, found[0], likely, bucket)


def level(p: np.ndarray) -> np.ndarray:
    """Place of a probability on the grid; 0 for none."""
    return np.where(p > 0, np.minimum(1 + np.rint(-np.log2(np.maximum(p, 1e-30)) * OCTAVE), LEVELS), 0).astype(np.int64)


#: The probability of each place on the grid.
VALUES = np.r_[0.0, 2.0 ** (-np.arange(LEVELS) / OCTAVE)]


def expectation_maximisation(bucket: np.ndarray, p: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of the mixture of p's columns for each bucket; a bucket without held-out tokens takes those of all, and without
    any tokens the last column counts alone."""
    m = p.shape[1]

    def mixed(rows: np.ndarray) -> np.ndarray:
        w = np.full(m, 1 / m)
        for _ in range(rounds):
            share = p[rows] * w
            share *= (weight[rows] / np.maximum(share.sum(1), 1e-300))[:, None]
            new = (share.sum(0) + 1e-3) / (weight[rows].sum() + m * 1e-3)
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        return w

    every = np.ones(len(p), bool)
    overall = mixed(every) if len(p) else np.r_[np.zeros(m - 1), 1.0]
    return np.array([mixed(bucket == b) if (bucket == b).any() else overall for b in range(BUCKETS)])


def mixture(e: Estimates, weights: list[np.ndarray], uniform: float) -> np.ndarray:
    """Each token's probability under as many levels of weights as there are: bigram, word and uniform share; then, level by
    level, the next longer n-gram and what is below it."""
    if not weights:  # order 1
        return e.likely[0]
    w = weights[0][e.bucket[0]]
    p = w[:, 0] * e.likely[1] + w[:, 1] * e.likely[0] + w[:, 2] * uniform
    for k, more in enumerate(weights[1:], 1):
        w = more[e.bucket[k]]
        p = w[:, 0] * e.likely[k + 1] + w[:, 1] * p
    return p


def language_scores(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10). ``order`` is 2 or more."""
    if order < 2:
        raise ValueError("an interpolation needs bigrams at least")
    spark, key_name = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    texts, _ = common.stored(blocks(docs, id_col, text_col), "blocks", {"parquet.block.size": ROW_GROUP})
    counts = common.written(counted(questions(texts, parts, order), order), "counts")
    sums = counts.where(F.col("block").isNull()).select(*[F.sum(F.get("n", F.lit(i))) for i in range(6)]).first()
    full, rest = (Totals(*(int(x or 0) for x in sums[i : i + 3])) for i in (0, 3))
    answers = counts.where(F.col("block").isNotNull()).select("block", "part", "kept", "full", "rest")

    kept = texts.where("kept").groupBy("block").cogroup(answers.where("kept").groupBy("block"))
    weights: list[np.ndarray] = []
    for k in range(1, order):

        def histogram(block: pa.Table, own: pa.Table) -> pa.Table:
            """Held-out tokens by bucket of the context and places of the estimates that this level mixes."""
            e = estimates(block, own, True, rest, k + 1)
            below = e.likely[0] if k == 1 else mixture(e, weights, 1 / (rest.kinds + 1))
            cell, n = np.unique((e.bucket[k - 1].astype(np.int64) * (LEVELS + 1) + level(e.likely[k])) * (LEVELS + 1) + level(below), return_counts=True)
            return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

        grid = kept.applyInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        cell, n = grid["cell"].to_numpy(dtype=np.int64), grid["n"].to_numpy(dtype=np.float64)
        p = [VALUES[cell // (LEVELS + 1) % (LEVELS + 1)], VALUES[cell % (LEVELS + 1)]]
        p += [np.full(len(cell), 1 / (rest.kinds + 1))] if k == 1 else []
        weights.append(expectation_maximisation(cell // (LEVELS + 1) ** 2, np.column_stack(p), n))

    def score(block: pa.Table, own: pa.Table) -> pa.Table:
        e = estimates(block, own, False, full, order)
        logp = np.log10(mixture(e, weights, 1 / (full.kinds + 1)))
        base = np.log10((e.word + 0.1) / (full.tokens + 0.1 * (full.kinds + 1)))
        first = starts_of(e.lens)
        return pa.table({
            id_col: block.column("ids").combine_chunks().flatten(),
            "held_out": pa.array(block.column("folds").combine_chunks().flatten().to_numpy() == 0),
            "n_tokens": pa.array(e.lens),
            "n_known": pa.array(np.add.reduceat((e.word > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(e.lens), full.tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, first)),
            "score": pa.array(np.add.reduceat(logp, first)),
        })

    every = texts.groupBy("block").cogroup(answers.groupBy("block"))
    return every.applyInArrow(score, f"{id_col} {key_name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
