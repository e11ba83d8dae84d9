"""Byte-level BPE, encoded in batched numpy merge rounds and decoded from the vocabulary's bytes.

The distinct words of a batch that no earlier batch had are laid out as one flat array of symbol ids. In each round, the
keys of all adjacent pairs are looked up by binary search among the sorted keys of the merge table; every word merges all
places of its own lowest-ranked pair, from left to right; the rounds end when no word has a pair that merges. Ids of known
words are kept for later batches in a table of bounded bytes, which is emptied when full and costs only time.

Defined results: null and empty texts have no tokens and decode to the empty text; special tokens written out in a text
are encoded as such; repeated rows each return; ties between pairs go by rank, then from the left; a very long text is one
batch, whole; an empty table gives no rows; columns other than id and text are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The public pattern that cuts texts into words for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: visible Latin-1 characters themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file in the tokenizers library's format."""

    def __init__(self, path: str, remember: int = 160 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)  # by rank
        one = np.repeat(self.first, 256), np.tile(self.first, 256)
        self.first_ranks = self.ranked(*one)  # of all pairs of bytes
        self.split = regex.compile(PATTERN)
        letters, numbers, blanks = ("".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        narrow = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"(?!\S)", f"(?![^{blanks}])")
        self.narrow = re.compile(narrow.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{blanks}]"))
        self.mark = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Known words: (number of ids, ids, bytes), the number of ids alone, or the packed ids alone.
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.sizes: dict[str, int] = {}
        self.ids: dict[str, bytes] = {}
        self.remember, self.held = remember, 0

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search among the sorted keys; len(made) for a pair that does not merge."""
        pair = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.made))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        none = len(self.made)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat = self.first[raw]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_owner = [], []
        # The rank of each symbol with the next one; kept up to date where symbols merge.
        rank = np.full(len(flat), none, dtype=np.int64)
        if len(flat) > 1:
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.first_ranks[raw[:-1].astype(np.int64) << 8 | raw[1:]], none)
        while len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(flat)]))
            over = lowest == none
            if over.any():  # words that are finished leave the array
                done_ids.append(flat[over])
                done_owner.append(owner[over])
                stay = ~over
                flat, owner, rank, lowest = flat[stay], owner[stay], rank[stay], lowest[stay]
                if not len(flat):
                    break
            hit = rank == lowest
            where = np.flatnonzero(hit)
            first = np.r_[True, np.diff(where) > 1]  # of overlapping places, every other one from the left
            nth = np.arange(len(where)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            take = where[nth % 2 == 0]
            flat[take] = self.made[rank[take]]
            keep = np.ones(len(flat), bool)
            keep[take + 1] = False
            at = take - np.arange(len(take))  # places after the merge: one symbol less for each merge before
            flat, owner, rank = flat[keep], owner[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(flat) - 1)
                rank[i] = np.where((i < j) & (owner[i] == owner[j]), self.ranked(flat[i], flat[j]), none)
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owners = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def emptied_if_full(self) -> None:
        """Before a batch: what earlier batches have learned is kept as long as its bytes are bounded."""
        if self.held > self.remember:
            self.words.clear()
            self.sizes.clear()
            self.ids.clear()
            self.held = 0

    def new_words(self, words: set[str], known: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words that a table lacks, their ids in a row and their numbers of ids."""
        new = [w for w in words if w not in known]
        return new, *self.merge([w.encode() for w in new])

    def learn(self, words: set[str]) -> None:
        self.emptied_if_full()
        new, ids, counts = self.new_words(words, self.words)
        ends, flat = np.cumsum(counts).tolist(), ids.tolist()
        for w, end, n in zip(new, ends, counts.tolist(), strict=True):
            own = flat[end - n : end]
            self.words[w] = (n, ",".join(map(str, own)).encode(), b"".join([self.bytes[i] for i in own]))
            self.held += 300 + 8 * len(w)

    def pieces(self, text: str) -> list[str]:
        """Words of a text, with each special token as a piece of its own."""
        if self.mark is None or not any(t in text for t in self.special):
            return self.cut(text)
        out: list[str] = []
        for part in self.mark.split(text):
            out += [part] if part in self.special else self.cut(part)
        return out

    def cut(self, text: str) -> list[str]:
        """Words of a text without special tokens. For texts of Latin-1 alone, the pattern has its classes written out."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(text)
        return self.narrow.findall(text)

    def run(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of tokens, decimal ids joined by commas, decoded bytes) of each text."""
        own = [self.pieces(t) for t in texts]
        self.learn({w for ws in own for w in ws if w not in self.special})
        special = {t: (1, str(i).encode(), self.bytes[i]) for t, i in self.special.items()}
        out = []
        for ws in own:
            found = [special.get(w) or self.words[w] for w in ws] if any(t in self.words or t in ws for t in special) else [self.words[w] for w in ws]
            out.append((sum([f[0] for f in found]), b",".join([f[1] for f in found]), b"".join([f[2] for f in found])))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        self.emptied_if_full()
        own = [self.pieces(t) for t in texts]
        new, _, n = self.new_words({w for ws in own for w in ws}.difference(self.special), self.sizes)
        self.sizes.update(zip(new, n.tolist(), strict=True))
        self.held += sum(map(len, new)) * 2 + 150 * len(new)
        sizes = self.sizes | dict.fromkeys(self.special, 1) if any(t in ws for ws in own for t in self.special) else self.sizes
        return [sum(map(sizes.__getitem__, ws)) for ws in own]

    def packed(self, texts: list[str], kind: np.dtype) -> list[bytes]:
        """The ids of each text in a row, as numbers of one type; one codec must be asked for one type only."""
        self.emptied_if_full()
        own = [self.pieces(t) for t in texts]
        known = self.ids
        new, ids, n = self.new_words({w for ws in own for w in ws}.difference(self.special), known)
        raw, ends = ids.astype(kind).tobytes(), (np.cumsum(n) * np.dtype(kind).itemsize).tolist()
        known.update((w, raw[a:b]) for w, a, b in zip(new, [0, *ends], ends))
        self.held += sum(map(len, new)) * 2 + 190 * len(new)
        for t, i in self.special.items():
            known[t] = np.array([i], kind).tobytes()
        return [b"".join(map(known.__getitem__, ws)) for ws in own]

    def encode(self, text: str) -> list[int]:
        n, ids, _ = self.run([text])[0]
        return [int(x) for x in ids.split(b",")] if n else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


#: Bytes of known words that a Python worker keeps, beside a vocabulary of some megabytes.
REMEMBER = 160 << 20


@cache
def codec(path: str, remember: int = REMEMBER) -> Codec:
    """The codec of a file, once a process. A bare name is that of a public vocabulary, found where the task runs."""
    if "/" not in path:
        import public_tokenizers

        path = str(public_tokenizers.path(path))
    return Codec(path, remember)


def slices(texts: list[str], most: int = 2_000_000):
    """Texts in runs of about so many characters; a longer text stands alone and whole."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    key = docs.schema[id_col].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = codec(path), []
        for some in slices([t or "" for t in batch.column(1).to_pylist()]):
            out += [(n, sha(ids), sha(raw.decode("utf-8", "replace").encode())) for n, ids, raw in own.run(some)]
        n, ids, raw = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_batches(common.keyed(docs, id_col, text_col), fn, f"{id_col} {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remember: int = REMEMBER) -> DataFrame:
    """id, text_hash (of the text, null as empty) and n_tokens."""
    key = docs.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = codec(path, remember), []
        for some in slices([t or "" for t in batch.column(2).to_pylist()]):
            out += own.counts(some)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[id_col, "text_hash", "n_tokens"])

    small = common.keyed(docs, id_col, text_col).toDF("_id", "_text")
    return common.map_batches(small.select("_id", F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_hash"), "_text"), fn, f"{id_col} {key}, text_hash long, n_tokens long")


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """id and the ids of its text as an array; ``with_hash``: and text_hash, as count_column() has it."""
    key = docs.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        ids = [own.encode(t or "") for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "text_hash", "ids"])

    small = common.keyed(docs, id_col, text_col).toDF("_id", "_text")
    out = common.map_batches(small.select("_id", F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_hash"), "_text"), fn, f"{id_col} {key}, text_hash long, ids array<int>")
    return out if with_hash else out.drop("text_hash")


def decode_column(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of arrays of ids. Null and empty arrays are the empty text; bytes that are no UTF-8 are decoded with the
    replacement sign, as the library does; null document ids stay; an empty table gives no rows; a null or unknown id within
    an array is an error; further columns are ignored, whatever their names."""
    key = tokens.schema[id_col].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        out = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return common.map_batches(common.keyed(tokens, id_col, ids_col), fn, f"{id_col} {key}, text string")
