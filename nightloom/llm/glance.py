"""What of many texts a toxicity model has to look at, found with numpy over whole stacks of texts.

Most tokens are plain letters with some signs at their ends. For these, two tables over the letters (those that stand twice
written once) tell enough: a bound on the log-odds of all words that begin with the same letters, and the automaton of the
beginnings of the table's words. Both err to the side of looking: what they leave out cannot change a text's features.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Letters that bounds are told apart by.
BEGIN = 8
_BITS = 20
_FEW = 4  # as many letters index a table directly
#: Words and prefixes of log-odds up to this share one bound.
_LOW = 0.25


def _keys(words: list[str]) -> np.ndarray:
    """Numbers of the words' first letters."""
    codes = np.array(words, dtype=f"S{BEGIN}").view(np.uint8).reshape(len(words), BEGIN).astype(np.int64)
    return (np.maximum(codes - 96, 0) * 27 ** np.arange(BEGIN)).sum(axis=1)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def _plain(word: str) -> bool:
    return word.isascii() and word.isalpha()


@dataclass
class Glance:
    """One text. ``odd``: tokens that are no letters with signs at their ends; ``bounds``: of all tokens, minus infinity for odd ones;
    ``kept``: tokens other than marks; ``odd_starts``, ``starts``: positions in ``kept`` at which a word in shreds may
    begin, by the token alone and by the next one as well; ``spaced``: three short tokens stand together."""

    odd: np.ndarray
    bounds: np.ndarray
    kept: np.ndarray
    odd_starts: np.ndarray
    starts: np.ndarray
    spaced: bool


class Tables:
    """``odds``: words and prefixes (with a plus sign), squeezed, with their log-odds; ``heads``: the beginnings of those that are
    looked for in neighbouring tokens, and whether a prefix ends there; ``lead``, ``tail``: signs before and
    behind letters that stand for none; ``edge``: all signs that a word's ends lose; ``marks``: those that may stand between neighbours."""

    def __init__(self, odds: Iterable[tuple[str, float]], none: float, heads: dict[str, bool], lead: str, tail: str, edge: str, marks: str):
        low = np.nextafter(np.float32(max(none, _LOW)), np.float32(np.inf))
        self.few = np.full(27**_FEW, low, dtype=np.float32)
        self.more = [np.full(1 << _BITS, low, dtype=np.float32) for _ in range(_FEW, BEGIN)]
        found = [(w.removesuffix("+")[:BEGIN], w.endswith("+"), s) for w, s in odds if s > low]
        found = [x for x in found if _plain(x[0])]
        keys, sizes = _keys([w for w, _, _ in found]), np.array([len(w) for w, _, _ in found], dtype=np.int64)
        prefix, most = np.array([x for _, x, _ in found], dtype=bool), np.array([s for _, _, s in found], dtype=float)
        most = np.nextafter(most.astype(np.float32), np.float32(np.inf))  # not below what it stands for
        sizes[~prefix] = BEGIN
        for k, table in enumerate(self.more, _FEW + 1):
            np.maximum.at(table, _slot(keys[sizes == k]), most[sizes == k])
        for k in np.flatnonzero(sizes <= _FEW):
            part = self.few.reshape(-1, 27 ** sizes[k])[:, keys[k]]
            np.maximum(part, most[k], out=part)
        plain = sorted(h for h in heads if _plain(h))
        number = {h: k for k, h in enumerate(plain, 1)} | {"": 0}
        self.next = np.full((len(number), 27), -1, dtype=np.int32)
        self.ends, self.on = np.zeros(len(number), dtype=bool), np.zeros(len(number), dtype=bool)
        for h, k in number.items():
            if h:
                self.next[number[h[:-1]], ord(h[-1]) - 96] = k
                self.next[k, ord(h[-1]) - 96] = k
                self.ends[k] = heads[h]
                self.on[k] = any(h + c in heads for c in edge)
        self.kind = np.full(128, 31, dtype=np.uint8)
        self.kind[[ord(c) for c in map(chr, range(128)) if c.isspace()]] = 0
        self.kind[97:123] = np.arange(1, 27)
        held = {c for c in lead if c in heads}
        self.lead, self.tail, self.edge, self.marks = (np.zeros(129, dtype=bool) for _ in range(4))
        for table, signs in ((self.lead, set(lead) - held), (self.tail, tail), (self.edge, edge), (self.marks, marks)):
            table[[ord(c) for c in signs if ord(c) < 128]] = True
        self.wide = np.array(sorted(ord(c) for c in marks if ord(c) > 127), dtype=np.uint32)

    def _walk(self, letters: np.ndarray, at: np.ndarray, state: np.ndarray, stop: bool) -> np.ndarray:
        """Where letters from ``at`` on lead: states, or -1. ``stop``: once a prefix has ended, the state is kept."""
        out, who = np.full(len(at), -1, dtype=np.int32), np.arange(len(at))
        while len(who):
            x = letters[at]
            done = x == 0
            out[who[done]] = state[done]
            who, at, state, x = who[~done], at[~done], state[~done], x[~done]
            state = self.next[state, x]
            live = state >= 0
            if stop:
                ended = live & self.ends[state]
                out[who[ended]] = state[ended]
                live &= ~ended
            who, at, state = who[live], at[live] + 1, state[live]
        return out

    def glances(self, texts: list[str]) -> Iterator[Glance]:
        """A Glance at each of the texts, which are lower-cased and folded."""
        stack = " ".join([*texts, ""]) + " "
        if stack.isascii():
            chars = np.frombuffer(stack.encode("ascii"), dtype=np.uint8)
            codes, wide = chars, None
        else:
            wide = np.frombuffer(stack.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes = np.minimum(wide, 128).astype(np.uint8)
        kind = np.append(self.kind, np.uint8(31))[codes]
        letter = (kind > 0) & (kind < 27)
        blank = kind == 0
        start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        size = end - start
        before = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
        inner = before[end] - before[start]
        edges = np.concatenate([[0], np.cumsum(self.edge[codes], dtype=np.int32)])
        tails = np.concatenate([[0], np.cumsum(self.tail[codes], dtype=np.int32)])
        initial = letter[start]
        core = start + ~initial
        stop = core + inner
        bare = (inner > 0) & (initial | self.lead[codes[start]]) & (stop <= end)
        over = np.where(bare, stop, end)
        bare &= (before[over] - before[core] == inner) & (edges[end] - edges[over] == end - over)
        tail = bare & initial & (tails[end] - tails[over] == end - over)
        sign = self.marks[codes]
        if wide is not None and len(self.wide):
            sign = sign | np.isin(wide, self.wide)
        signs = np.concatenate([[0], np.cumsum(sign, dtype=np.int32)])
        mark = signs[end] - signs[start] == size

        keep = np.concatenate([[True], ~(letter[1:] & (kind[1:] == kind[:-1]))])
        place = np.cumsum(keep) - 1
        letters = np.concatenate([np.where(letter, kind, 0)[keep], np.zeros(BEGIN, dtype=np.uint8)])
        at = place[core]
        key, on, bound = np.zeros(len(at), dtype=np.int64), bare, np.zeros(0)
        for k in range(BEGIN):
            x = np.where(on, letters[at + k], 0)
            on = x > 0
            key = key + x.astype(np.int64) * 27**k
            if k >= _FEW - 1:
                own = self.few[key] if k < _FEW else self.more[k - _FEW][_slot(key)]
                bound = own if k < _FEW else np.maximum(bound, own)
        bound[~bare] = -np.inf

        state = np.full(len(at), -1, dtype=np.int32)
        state[bare] = self._walk(letters, at[bare], np.zeros(int(bare.sum()), dtype=np.int32), False)
        kept = np.flatnonzero(~mark)
        own = state[kept]
        sure = tail[kept] & ~((own >= 0) & self.on[own] & (inner[kept] < size[kept]))
        odd_start = ~bare[kept] | ((own >= 0) & ~sure)
        starts = np.flatnonzero(sure & (own >= 0))
        starts = starts[starts < len(kept) - 1]
        starts = starts[self._walk(letters, place[start[kept[starts + 1]]], own[starts], True) >= 0]
        # What a single sign is folded to: one character or a digraph (dz, ij, lj, nj, or with a sign that is not ASCII).
        first, last = codes[start], codes[end - 1]
        two = (last == 106) | ((first == 100) & (last == 122)) | (first > 127) | (last > 127)
        short = (size == 1) | ((size == 2) & two)
        three = np.flatnonzero(short[:-2] & short[1:-1] & short[2:])

        stops = np.cumsum([len(t) + 1 for t in texts])
        tokens = np.concatenate([[0], np.searchsorted(start, stops)])
        inside = np.searchsorted(kept, tokens)
        odd, odd_starts = np.flatnonzero(~bare), np.flatnonzero(odd_start)
        cuts = [(np.searchsorted(x, y), x, y) for x, y in ((odd, tokens), (odd_starts, inside), (starts, inside), (three, tokens))]
        for k in range(len(texts)):
            a, b = tokens[k], tokens[k + 1]
            own_odd, own_odd_starts, own_starts, own_three = (x[c[k] : c[k + 1]] - y[k] for c, x, y in cuts)
            rows = kept[inside[k] : inside[k + 1]] - a
            more = len(rows) - 1  # the last token has no next one
            yield Glance(own_odd, bound[a:b], rows, own_odd_starts[own_odd_starts < more], own_starts[own_starts < more], len(own_three) > 0)
