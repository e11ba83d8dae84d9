"""Best-fit packing with several permitted bin sizes.

Pieces are packed shard by shard in descending order of length. A piece goes to the open bin with the least room that
still takes it. If none does, a new bin opens, and its size is the one of the shard's menu whose expected cost for each
packed token is least: the cost of the size over what the shard's remaining pieces could put into it. When all pieces are
placed, each bin is cut down to the smallest permitted size that holds its contents. The menu, which of the permitted
sizes may be opened, is chosen for the shard as a whole: all its lengths are packed under every menu, and the packing of
least total cost stays.

Lengths are numbers of byte-level BPE tokens and an end mark (or any other count that is given), and ``sequences`` cuts the
documents' token ids and puts them into their bins. Texts longer than the largest size are cut into pieces, so that all
tokens are kept. Shards are fixed by a hash of the document id (of the text where the id is null) and the text's hash,
and sized by a count, so a task holds ``shard_pieces`` pieces on average, whatever the input. Only ids and lengths are shuffled for
packing; token ids are shuffled by bin, of which each holds at most the largest size.

Defined results: null and empty texts count the end mark alone; ties go by id, then piece number, then the text's hash;
repeated rows are packed each; a very long text gives as many pieces as it fills bins; an empty table gives no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe, common

SIZES = (256, 512, 1024, 2048, 4096)


def bin_cost(size: int, overhead: int = 32, quadratic: int = 1 << 15) -> float:
    """Cost of one sequence: its positions, a fixed share for launching it, and attention's square."""
    return size + overhead + size * size / quadratic


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, menu: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, start in the bin, size of each bin). Pieces must come in the order in which they are placed; only
    sizes of the menu are opened (all by default)."""
    sizes = sorted(sizes)
    menu = sizes if menu is None else sorted(menu)
    costs = {s: bin_cost(s) for s in menu}
    lengths = np.asarray(lengths, dtype=np.int64)
    where, start = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left_tokens = int(lengths.sum())
    room: dict[int, list[int]] = {}
    free = 0  # bit r: some bin has r positions left
    used: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        above = free >> n
        if above and n:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                del room[r]
                free ^= 1 << r
        else:
            size = min((s for s in menu if s >= n), key=lambda s: (costs[s] / min(s, max(left_tokens, 1)), s))
            b, r = len(used), size
            used.append(0)
        where[i], start[i] = b, used[b]
        used[b] += n
        left_tokens -= n
        if rest := r - n:
            room.setdefault(rest, []).append(b)
            free |= 1 << rest
    final = np.array(sizes, dtype=np.int64)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return where, start, final


def menus(sizes: Sequence[int], longest: int) -> list[tuple[int, ...]]:
    """All choices of sizes of which one takes the longest piece, the smallest choices first."""
    return [m for k in range(1, len(sizes) + 1) for m in combinations(sorted(sizes), k) if m[-1] >= longest]


def pack_jointly(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pack() under the menu whose whole packing costs least; of equals, the first."""
    best = None
    for menu in menus(sizes, max(lengths, default=0)):
        found = pack(lengths, sizes, menu)
        kinds, n = np.unique(found[2], return_counts=True)
        cost = sum(bin_cost(int(s)) * int(c) for s, c in zip(kinds, n, strict=True))
        if best is None or cost < best[0] - 1e-6:
            best = cost, found
    return best[1]


def pieces(counts: DataFrame, largest: int, id_col: str = "doc_id") -> DataFrame:
    """One row per piece: id, n_tokens of the document, text_hash, piece, n of the piece."""
    cut = F.explode(F.sequence(F.lit(0), ((F.greatest(F.col("n_tokens"), F.lit(1)) - 1) / F.lit(largest)).cast("int")))
    return counts.select(id_col, "n_tokens", "text_hash", cut.alias("piece")).withColumn("n", F.least(F.lit(largest), F.col("n_tokens") - F.col("piece").cast("long") * largest))


def word_count(text: str = "text", extra: int = 1) -> Column:
    """Words and the end mark; a stand-in for a tokenizer's count that stays in the JVM."""
    packed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(packed) - F.length(F.replace(packed, F.lit("w"), F.lit(""))) + F.lit(extra)


def bpe_counts(docs: DataFrame, vocabulary: str, extra: int = 1, id_col: str = "doc_id", remember: int = bpe.REMEMBER) -> DataFrame:
    """id, text_hash and n_tokens of each document, with the end mark. ``remember``: bytes of known words that a worker keeps."""
    return bpe.count_column(docs, vocabulary, id_col, remember=remember).withColumn("n_tokens", F.col("n_tokens") + extra)


def counted_by(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """The same by an expression over the documents."""
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    return docs.select(F.col(f"`{id_col}`"), F.xxhash64(text).alias("text_hash"), tokens.cast("long").alias("n_tokens"))


def best_fit(counts: DataFrame, sizes: Sequence[int] = SIZES, shard_pieces: int = 100_000, id_col: str = "doc_id") -> DataFrame:
    """One row per piece of (id, text_hash, n_tokens): id, n_tokens, piece, n, bin_id, bin_start, bin_size, bin_fill, text_hash."""
    cut = common.cut(pieces(counts, max(sizes), id_col))
    shards = max(1, -(-cut.count() // shard_pieces))
    key = cut.schema[id_col].dataType.simpleString()
    own = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("text_hash"), F.col("piece")), F.lit(shards))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", id_col, "piece", "text_hash"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        where, start, size = pack_jointly(pdf["n"].to_numpy(), sizes)
        fill = np.bincount(where, weights=pdf["n"].to_numpy(), minlength=len(size)).astype(np.int64)
        return pdf.assign(bin_id=[f"{s}-{b}" for s, b in zip(pdf["shard"], where)], bin_start=start, bin_size=size[where], bin_fill=fill[where])[[id_col, "n_tokens", "piece", "n", "bin_id", "bin_start", "bin_size", "bin_fill", "text_hash"]]

    return cut.withColumn("shard", own).groupBy("shard").applyInPandas(run, f"{id_col} {key}, n_tokens long, piece int, n long, bin_id string, bin_start long, bin_size long, bin_fill long, text_hash long")


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, end_id: int, largest: int = max(SIZES), id_col: str = "doc_id") -> DataFrame:
    """One row per bin of best_fit(bpe_counts(docs)): bin_id, bin_size, starts of its pieces, and ids, the token ids of all
    its pieces with end_id behind each document. Rows of equal id and text are encoded once; null ids meet null ids; null and
    empty texts are the end id alone; empty tables give no rows; further columns are ignored, whatever their names."""
    ids = bpe.encode_column(docs, vocabulary, id_col, with_hash=True).dropDuplicates([id_col, "text_hash"])
    whole = F.concat("ids", F.array(F.lit(end_id).cast("int")))
    cut = ids.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), whole.alias("ids")).select("_id", "_hash", "ids", F.explode(F.sequence(F.lit(0), F.expr(f"(size(ids) - 1) div {largest}").cast("int"))).alias("_piece"))
    cut = cut.select("_id", "_hash", "_piece", F.slice("ids", F.col("_piece") * largest + 1, F.lit(largest)).alias("ids"))
    met = packed.join(cut, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("piece") == F.col("_piece")))
    own = met.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list(F.struct("bin_start", "ids"))).alias("s"))
    return own.select("bin_id", "bin_size", F.transform("s", lambda x: x["bin_start"]).alias("starts"), F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"))
