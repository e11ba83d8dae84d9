"""Exact Jaccard self-join on word n-grams by a partitioned universe and the pigeonhole principle.

Sets whose Jaccard similarity is at least t differ in at most H = floor((|X| + |Y|)(1 - t) / (1 + t)) shingles. A hash
deals the universe of shingles into m segments, m by the size band of the smaller set. Each segment has an allowance v:
0, its part of the set must match as it is, or 1, it may differ by one shingle, found through its one-deletion
neighbourhood. As the segments share at most H differences, a similar pair agrees in some segment as long as the sum of
v + 1 exceeds H. The allowances of a band are those of least estimated cost, signatures plus chance meetings
(``allocate``); and a set leaves out its empty segments as long as the rest still exceed H.

Sets with equal shingles are one node from the start. Nodes with a signature in common form a bucket:

* Of a small bucket all pairs are candidates. A node whose small buckets alone exceed H is settled by them.
* Of a large bucket only the nodes that are not settled go on. Its hub, the node in most large buckets, is compared with
  the others; near copies of one text all meet its plainest version that way. A second round takes a new hub from the
  nodes that the first one left in other components.
* What is left, unsettled nodes whose large buckets hold several components, meets by rare shingles: in the order of their
  frequency among these nodes, two similar sets share one of their first shingles, as many as their two sizes leave
  room for differences, and one. Pairs in different components that do become candidates.

Signatures of many documents are combined within each batch of the scan, so that one of a third of all documents reaches
its reducer as a few rows. Members of a bucket that holds more than one in ``HOT_SHARE`` of all members (and ``HOT_LEAST``) meet its
hub where they are: there are fewer than HOT_SHARE such buckets, whatever the input, so these hubs are broadcast and no bucket is
one task's work. All candidates are verified on their whole texts' shingles. So components are exact, and
their number of candidates does not grow with the square of a group of copies.

Defined results: null and empty texts and texts without words have no shingles, no links, and their own id as component;
a null id links nothing and has a null component; repeated rows each return; of equally good hubs the one with the larger
hash is taken; very long texts count with all their shingles; an empty table gives no rows; columns other than id and
text are never read. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, NUM, DEN = 4, 85, 100


class Rule(NamedTuple):
    """What counts as similar: shingles of so many words, and a Jaccard similarity of at least num / den."""

    words: int = WORDS
    num: int = NUM
    den: int = DEN


RULE = Rule()
SMALL_BUCKET = 6
LOCAL_BUCKET = 64
HOT_SHARE, HOT_LEAST = 10_000, 1000
#: Shingles of the documents for each task that gathers signatures.
TASK_SHINGLES = 2_000_000
_A = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(64)]


def shingles(data: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; one for the whole sequence where it is shorter."""
    h = common.word_hashes(data.translate(common.ASCII_LOWER))
    n = len(h)
    if not n:
        return h
    with np.errstate(over="ignore"):
        if n < k:
            x = np.zeros(1, np.uint64) + np.uint64(n)
            for i in range(n):
                x = x * _A + h[i]
        else:
            x = h[k - 1 :].copy()
            for i in range(1, k):
                x += h[k - 1 - i : n - i] * _POWERS[i]
        return np.unique(common.mix(x))


def most_different(x: int, y: int, rule: Rule = RULE) -> int:
    """H for two set sizes."""
    return (x + y) * (rule.den - rule.num) // (rule.den + rule.num)


@lru_cache(maxsize=None)
def band_start(j: int) -> int:
    """First set size of band j: single sizes at first, then a ratio of 1.5."""
    s = 1
    for _ in range(j):
        s = max(s + 1, s * 3 // 2)
    return s


@lru_cache(maxsize=None)
def band_of(n: int) -> int:
    j = 0
    while band_start(j + 1) <= n:
        j += 1
    return j


def reserve(need: int, segments: int) -> int:
    """Further segments, so that empty and crowded ones can be left out; a few large segments are neither."""
    return 0 if segments <= 3 else 1 + need // 16


def allocate(need: int, size: int, meet: float = 0.6, weight: float = 200.0) -> tuple[int, int]:
    """(segments of allowance 1, of allowance 0) whose sum of v + 1 is at least ``need``, at the least estimated cost.

    ``meet`` is the chance that a shingle of a set is in an unrelated one which it might meet, ``weight`` the number of such
    sets. A segment of allowance 0 costs one signature and the sets that have the same shingles there; one of allowance 1
    costs a signature for each shingle too, with one shingle less to tell sets apart, but saves a segment, so that all
    are larger. Small sets come out with one-deletion neighbourhoods, large ones with many plain segments."""
    best = None
    for ones in range(min(need // 2, 32) + 1):
        zeros = need - 2 * ones
        zeros += reserve(need, ones + zeros)
        m = ones + zeros
        same = (1 - (1 - meet) / m) ** size
        cost = zeros * (1 + weight * same) + ones * (1 + size / m) * (1 + weight * same / meet)
        if best is None or cost < best[0]:
            best = (cost, ones, zeros)
    return best[1], best[2]


@lru_cache(maxsize=None)
def band_plan(j: int, rule: Rule = RULE) -> tuple[int, int]:
    """(segments of allowance 1, of allowance 0) of band j."""
    top = band_start(j + 1) - 1
    return allocate(most_different(top, top * rule.den // rule.num, rule) + 1, (band_start(j) + top) // 2)


@lru_cache(maxsize=None)
def bands_for(n: int, rule: Rule = RULE) -> tuple[tuple[int, int], ...]:
    """(band, most differences to a partner there) of the pairs whose smaller set is in the band, for a set of size n."""
    own = band_of(n)
    out = [(own, most_different(n, n * rule.den // rule.num, rule))]
    j = own - 1
    while j >= 0 and band_start(j + 1) - 1 >= -(-n * rule.num // rule.den):
        out.append((j, most_different(n, min(n, band_start(j + 1) - 1), rule)))
        j -= 1
    return tuple(out)


_BAND_BITS = np.uint64(6)


def signatures(tokens: np.ndarray, rule: Rule = RULE) -> list[tuple[int, np.ndarray, int]]:
    """(band, signatures, by how much the allowances exceed H) in each band where the set may have partners."""
    out = []
    with np.errstate(over="ignore"):
        high = tokens >> np.uint64(32)
        mixed = common.mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
        for j, most in bands_for(len(tokens), rule):
            ones, zeros = band_plan(j, rule)
            m = ones + zeros
            seg = ((high * np.uint64(m)) >> np.uint64(32)).astype(np.int64)  # ascending, as tokens are sorted
            begin = np.searchsorted(seg, np.arange(m + 1))
            total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
            sums = total[begin[1:]] - total[begin[:-1]]
            count = np.diff(begin)
            weight = np.ones(m, np.int64)
            weight[:ones] = 2
            full = count > 0
            have = int(weight[full].sum())
            use = full if have > most else np.ones(m, bool)
            tag = np.arange(m, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(j + 1)
            made = [common.mix(sums[use] + tag[use])]
            for i in range(ones):
                if use[i]:
                    made.append(common.mix(sums[i] - mixed[begin[i] : begin[i + 1]] + tag[i]))
            sig = np.concatenate(made)
            sig = (sig >> _BAND_BITS << _BAND_BITS) | np.uint64(min(j, 63))
            out.append((j, sig, (have if have > most else int(weight.sum())) - most - 1))
    return out


def node_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        a = common.mix(tokens + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
        b = common.mix(tokens ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
        pair = common.mix(np.array([a, b], dtype=np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


NODES = "doc_id {key}, n long, node long, proof long, spare array<struct<band:int,spare:int>>"


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """One row per document: its set's size and hashes, and what its allowances exceed H by in each band."""
    key = docs.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, node, proof, spare = [], [], [], []
        for data in common.texts(batch, "_text"):
            t = shingles(data, rule.words)
            a, b = node_of(t) if len(t) else (None, None)
            n.append(len(t))
            node.append(a)
            proof.append(b)
            spare.append([{"band": j, "spare": s} for j, _, s in signatures(t, rule)] if len(t) else [])
        kind = pa.list_(pa.struct([("band", pa.int32()), ("spare", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(proof, pa.int64()), pa.array(spare, kind)], names=["doc_id", "n", "node", "proof", "spare"])

    return common.map_batches(common.keyed(docs, id_col, text_col).toDF("doc_id", "_text"), fn, NODES.format(key=key))


# Kinds of rows between scan and buckets: a signature and a node; the same from a batch that has many members; an edge; a
# member of a large bucket.
ROW, CROWDED, EDGE, MEMBER = 0, 1, 2, 3
ROWS = "x long, y long, kind int"


def _batch(x, y, kind) -> pa.RecordBatch:
    kind = np.broadcast_to(np.asarray(kind, dtype=np.int32), np.shape(x))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)), pa.array(np.asarray(y, dtype=np.int64)), pa.array(kind)], names=["x", "y", "kind"])


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if len(x) else np.zeros(0, bool)
    return x[new], y[new]


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """ROWS of all documents; a signature with many members in one batch as one marked row, and its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, owner, known = [], [], set()
            for data in common.texts(batch, "_text"):
                t = shingles(data, rule.words)
                if not len(t):
                    continue
                node = node_of(t)[0]
                if node in known:
                    continue
                known.add(node)
                for _, s, _ in signatures(t, rule):
                    sigs.append(s.view(np.int64))
                    owner.append(np.full(len(s), node, np.int64))
            if not sigs:
                continue
            x, y = _distinct(np.concatenate(sigs), np.concatenate(owner))
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            size = np.diff(np.r_[start, len(x)])
            crowd = np.repeat(size > LOCAL_BUCKET, size)
            yield _batch(x[~crowd], y[~crowd], ROW)
            if crowd.any():
                yield _batch(x[start[size > LOCAL_BUCKET]], y[start[size > LOCAL_BUCKET]], CROWDED)
                yield _batch(x[crowd], y[crowd], MEMBER)

    # A null id links nothing.
    small = common.keyed(docs, id_col, text_col).toDF("_id", "_text")
    return small.where(F.col("_id").isNotNull()).select("_text").mapInArrow(run, ROWS)


def _bucket_rows(x: np.ndarray, y: np.ndarray, crowded: np.ndarray, large: int | None) -> tuple[list[pa.RecordBatch], int | None]:
    """Output of whole or started buckets in sorted, distinct rows; ``large``: signature of a large bucket that goes on."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    size = np.diff(np.r_[start, len(x)])
    big = (size > SMALL_BUCKET) | np.logical_or.reduceat(crowded, start)
    if large is not None and x[0] == large:
        big[0] = True
    small = np.repeat(~big, size)
    pairs = []
    for d in range(1, SMALL_BUCKET):
        same = (x[d:] == x[:-d]) & small[d:]
        pairs.append((y[:-d][same], y[d:][same]))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    a, b = _distinct(np.minimum(a, b), np.maximum(a, b))
    return [_batch(a, b, EDGE), _batch(x[~small], y[~small], MEMBER)], int(x[-1]) if big[-1] else None


def bucketed(rows: DataFrame) -> DataFrame:
    """EDGE and MEMBER rows from ROWS that are sorted by (x, y, kind) and hold a signature in one partition. Streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        large: int | None = None
        for batch in batches:
            x, y, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            done = kind >= EDGE
            if done.any():
                yield _batch(x[done], y[done], kind[done])
            x, y, crowd = x[~done], y[~done], kind[~done] == CROWDED
            x, y, crowd = (np.concatenate(p) for p in zip(held, (x, y, crowd), strict=True))
            if not len(x):
                continue
            new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            at = np.flatnonzero(new)
            x, y, crowd = x[at], y[at], np.logical_or.reduceat(crowd, at)
            last = int(np.searchsorted(x, x[-1]))
            if len(x) - last > SMALL_BUCKET or large == x[-1]:
                cut = len(x)  # a large bucket may go on
            else:
                cut = last
            if cut:
                out, large = _bucket_rows(x[:cut], y[:cut], crowd[:cut], large)
                yield from out
            held = (x[cut:], y[cut:], crowd[cut:])
        if len(held[0]):
            yield from _bucket_rows(*held, large)[0]

    return rows.mapInArrow(run, ROWS)


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar enough; texts: (node, text), one row per node."""
    left = texts.select(F.col("node").alias("_na"), F.col("text").alias("_ta"))
    right = texts.select(F.col("node").alias("_nb"), F.col("text").alias("_tb"))
    wide = pairs.join(right, F.col("b") == F.col("_nb")).select("a", "b", "_tb").join(left, F.col("a") == F.col("_na")).select("a", "b", "_ta", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            ta, tb = (batch.column(i).cast(pa.binary()) for i in (2, 3))
            for i, node in enumerate(a.tolist()):
                if node != last:
                    last, own = node, shingles(ta[i].as_py(), rule.words)
                other = shingles(tb[i].as_py(), rule.words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep[i] = rule.den * both >= rule.num * (len(own) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """(node, text) for wanted (node, doc_id), one row per node."""
    small = common.keyed(docs, id_col, text_col).toDF("_id", "_text")
    found = small.join(wanted, F.col("_id") == F.col("doc_id")).select("node", "_text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [node_of(t)[0] == n if len(t := shingles(x, rule.words)) else False for n, x in zip(batch.column(0).to_pylist(), common.texts(batch, "_text"), strict=True)]
        return batch.filter(pa.array(keep, pa.bool_())).rename_columns(["node", "text"])

    # An id may stand on several rows; the text is the one that has the node's shingles.
    return common.map_batches(found, fn, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def unsettled(members: DataFrame, kinds: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(sig, node, hot) of large buckets' members that their small buckets do not settle; hot: how many large ones a node is in."""
    banded = members.withColumn("band", F.col("sig").bitwiseAND(63).cast("int"))
    twice = [j for j in range(63) if band_plan(j, rule)[0]]
    crowd = banded.groupBy("node", "band").agg(F.count("*").alias("hot"))
    spare = kinds.select("node", F.inline("spare")).groupBy("node", F.least(F.col("band"), F.lit(63)).alias("band")).agg(F.min("spare").alias("spare"))
    weight = F.col("hot") * F.when(F.col("band").isin(twice), 2).otherwise(1)
    needy = crowd.join(spare, ["node", "band"]).where(weight > F.col("spare")).select("node", "band", "hot")
    return common.cut(banded.join(needy, ["node", "band"]).select("sig", "node", "hot"))


def hot_signatures(members: DataFrame) -> DataFrame:
    """Signatures of more than one in HOT_SHARE of the members, and HOT_LEAST of them at least: fewer than HOT_SHARE rows."""
    total = members.count()
    return common.cut(members.groupBy("sig").agg(F.count("*").alias("n")).where((F.col("n") * HOT_SHARE > total) & (F.col("n") >= HOT_LEAST)).select("sig").repartition(1))


def by_signature(rows: DataFrame, one: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Joins rows to a table with one row a signature; rows of hot signatures are not moved."""
    few = one.join(F.broadcast(hot), "sig", "left_semi")
    return rows.join(F.broadcast(few), "sig", how).unionAll(rows.join(F.broadcast(hot), "sig", "left_anti").join(one.join(F.broadcast(hot), "sig", "left_anti"), "sig", how))


def least_common(x: Column, y: Column, rule: Rule = RULE) -> Column:
    """The least intersection of similar sets of sizes x and y; with a y of 0, of one of size x and the smallest it may meet."""
    both = F.when(y > 0, x + y)
    return F.when(y > 0, -F.floor(-both * rule.num / (rule.num + rule.den))).otherwise(-F.floor(-x * rule.num / rule.den)).cast("long")


def rare_pairs(nodes_: DataFrame, texts: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(a, b), a < b, of different roots that share one of their rarest shingles. nodes_: (node, root).

    Any fixed order of shingles would do for completeness; by frequency, a shingle that many have is in few sets' first
    ones, unless they have hardly any other, and those are near copies of one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shingles(x, rule.words) for x in common.texts(batch, "text")]
            n = np.array([len(t) for t in tokens])
            node, root = (np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node), pa.array(root), pa.array(np.repeat(n, n))], names=["token", "node", "root", "n"])

    own = common.written(nodes_.join(texts, "node").select("node", "root", "text").mapInArrow(run, "token long, node long, root long, n long"), "tokens")
    often = own.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = own.join(often, "token", "left").select("node", "root", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token").alias("t"))
    # The sets' first shingles: n - ceil(t n) + 1 of them when the partner is smaller, fewer when it is larger.
    lead = ranked.groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.array_sort(F.collect_list("t")).alias("t"))
    lead = lead.select("node", "root", "n", F.posexplode(F.slice("t", 1, (F.col("n") - least_common(F.col("n"), F.lit(0), rule) + 1).cast("int"))).alias("at", "t"))
    lead = common.cut(lead.where("t.df > 1").select("node", "root", "n", "at", F.col("t.token").alias("token")))
    mixed = lead.groupBy("token").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l <> _h").select("token")
    lead = lead.join(mixed, "token", "left_semi")
    side = lambda k: lead.select("token", F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("root", "n", "at")])
    small = side("b").where(F.col("at_b") <= F.col("n_b") - least_common(F.col("n_b"), F.col("n_b"), rule))
    met = side("a").join(small, "token").where((F.col("root_a") != F.col("root_b")) & ((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))))
    common_ = least_common(F.col("n_a"), F.col("n_b"), rule)
    met = met.where((F.col("at_a") <= F.col("n_a") - common_) & (F.col("at_b") <= F.col("n_b") - common_))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """id, n_shingles and component_id: the least id that links reach, one row per document."""
    own = common.cut(nodes(docs, id_col, text_col, rule))
    kinds = own.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("spare").alias("spare"), F.assert_true(F.min("proof") == F.max("proof"), F.lit("two sets with one 64-bit hash; change the seed")).alias("_proof")
    )
    kinds = common.cut(kinds.where(F.col("_proof").isNull()).drop("_proof"))

    rows = signed(docs, id_col, text_col, rule)
    by = F.when(F.col("kind") >= EDGE, F.xxhash64("x", "y")).otherwise(F.col("x"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(own.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES))
    found = common.written(bucketed(rows.withColumn("by", by).repartition(parts, "by").drop("by").sortWithinPartitions("x", "y", "kind")), "buckets")

    size = lambda side: kinds.select(F.col("node").alias(f"_n{side}"), F.col("n").alias(f"_s{side}"))

    def sized(pairs: DataFrame) -> DataFrame:
        both = pairs.join(size("a"), F.col("a") == F.col("_na")).join(size("b"), F.col("b") == F.col("_nb"))
        return both.where(F.least("_sa", "_sb") * rule.den >= F.greatest("_sa", "_sb") * rule.num).select("a", "b")

    edges = found.where(F.col("kind") == EDGE).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    members = unsettled(found.where(F.col("kind") == MEMBER).select(F.col("x").alias("sig"), F.col("y").alias("node")).distinct(), kinds, rule)
    crowds = hot_signatures(members)
    hubs = members.groupBy("sig").agg(F.max(F.struct("hot", "node")).alias("_h")).select("sig", F.col("_h.node").alias("hub"))
    first = by_signature(members, hubs, crowds).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = common.cut(sized(edges.unionAll(first).distinct()))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionAll(members.select("node")).distinct()
    texts = common.written(_texts_of(docs, wanted.join(kinds.select("node", "doc_id"), "node"), id_col, text_col, rule), "texts")
    links = common.cut(verified(pairs, texts, rule))
    roots = components(links)

    def rooted() -> DataFrame:
        return common.cut(members.join(roots, "node", "left").select("sig", "node", "hot", F.coalesce("root", "node").alias("root")))

    here = rooted()
    of_hub = hubs.join(roots, F.col("hub") == F.col("node"), "left").select("sig", F.coalesce("root", "hub").alias("_root"))
    others = by_signature(here, of_hub, crowds).where("root <> _root").select("sig", "node", "hot")
    again = others.groupBy("sig").agg(F.max(F.struct("hot", "node")).alias("_h")).select("sig", F.col("_h.node").alias("hub"))
    second = by_signature(others, again, crowds).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    second_links = common.cut(verified(sized(second), texts, rule))
    if not second_links.isEmpty():
        links = links.unionAll(second_links)
        roots = components(links)
        here = rooted()

    rest = here.select("sig", "node", "root")
    mixed = rest.groupBy("sig").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l <> _h").select("sig")
    rest = common.cut(by_signature(rest, mixed, crowds, "left_semi").select("node", "root").distinct())
    third = rare_pairs(rest, texts, rule).join(pairs, ["a", "b"], "left_anti")
    third_links = common.cut(verified(sized(third), texts, rule))
    if not third_links.isEmpty():
        roots = components(links.unionAll(third_links))

    least = roots.join(kinds.select("node", "doc_id"), "node").select("root", "doc_id").unionAll(roots.select("root").distinct().join(kinds.select(F.col("node").alias("root"), "doc_id"), "root")).groupBy("root").agg(F.min("doc_id").alias("component"))
    of_node = kinds.join(roots, "node", "left").select(F.col("node").alias("_node"), "doc_id", F.coalesce("root", "node").alias("root")).join(least, "root", "left").select("_node", F.coalesce("component", "doc_id").alias("_component"))
    out = own.join(of_node, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
