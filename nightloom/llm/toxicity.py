"""Toxicity scores behind a noisy-channel deobfuscator.

Accents are taken off and letters of other widths written plainly (compatibility decomposition). A token that looks
disguised (letters mixed with digits or signs, a letter three times or more, or twice in a word that the table lacks,
marks between letters, or single letters spaced out) is restored before it is judged, however long it is. Each of its
characters opens a column of a lattice: the letter itself, the letters it may stand for (any letter, at a higher cost, for a
sign between letters that looks like none), nothing at all for a separator, and one or two letters for a run. Viterbi's
algorithm picks the path with the most probable letters under a character trigram model, given the cost of each disguise.
The restored word replaces the token.

Blanks are signs of the lattice as well. In letters that are spaced out, a word may end after each one, so that a run
comes back as several words; a wider gap ends one. Between any two neighbouring tokens, a blank either ends a word, as
written, or stands for nothing, so that a word in shreds is put together again. Which neighbours to decode is
found by spelling them along the table's words and prefixes of log-odds above ``JOINED``. A word that was put together
counts where the table knows it, or, if one of its shreds is no word of the table, a prefix of it that ends within its last shred.
A token with a sign for any letter also counts as the word above JOINED that it may stand for.

The judge is a table of words and word prefixes with their log-odds of occurring in toxic texts, learned from all labelled
ids (whole texts); a word that the table lacks backs off to its longest known prefix. Words are counted by label on the
executors, and there the table is cut out of the counts: words in one text of ``FREQUENT``, of which there cannot be more
in a larger corpus; rarer ones whose log-odds are above ``JOINED`` and not explained by chance; and words or prefixes that
these would wrongly put above it. Only that table, and the trigrams of an alphabet, reach the driver and the workers.
Tokens whose log-odds cannot be among a text's three highest, and neighbours that lead nowhere, are told by glance.Tables and
not restored. The three highest log-odds among a text's distinct words go through a logistic model, fitted on the half of the labelled
texts that built no table, by sums over the executors.

Defined results: null and empty texts have no words and get the model's score for none; without labelled rows of both
kinds in both halves every score is 0; repeated rows each return (and teach once); of equally good paths the first
counts; very long texts and tokens are read whole; an empty table gives no rows; columns other than id and text are
never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, fitting, glance

# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
    "*": "aeiou", "μ": "u",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "у": "y",
}
SEPARATORS = frozenset(".-_*~'`^,:;=/\\\u200b\u00ad")
BRACKETS = frozenset("\"()[]{}<>«»„“”‘’")
#: Marks that stand for no letter and are cut off a word's end.
_BEHIND = ".,;:?\"'"
#: Tokens of these alone stand between neighbours.
MARKS = (SEPARATORS | BRACKETS | frozenset("#%?&|!")) - LOOKALIKES.keys()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EDGE = ".,;:!?\"'()[]{}<>|#*%&$-_~`^=/\\"
#: Every sign and look-alike, or one letter three times. Letters that stand twice are looked at where no table has the word.
_SUSPECT = re.compile(r"[^\w\s]|[" + re.escape("".join(sorted({*LOOKALIKES, *SEPARATORS}))) + r"]|(.)\1\1")
_ODD = re.compile(r"(?<=[^\W_])([^\w\s" + re.escape("".join(sorted({*LOOKALIKES, *SEPARATORS, *BRACKETS}))) + r"])\1?(?=[^\W_])")
_TWICE = re.compile(r"([^\W\d_])\1")
_PLAIN = re.compile(r"[a-z]+")
_START, _END = "\x02", "\x03"
#: Log-odds above which a word or prefix of the table is looked for in neighbouring tokens.
JOINED = 2.0


def _folded(token: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", token).lower() if not unicodedata.combining(c) and not c.isspace())


class _Folds(dict):
    """What each character of a lower-case text is folded to: decomposition goes by characters. A blank stays one; a capital
    sigma too, as its small form depends on its neighbours."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kept = (x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x) and not x.isspace())
        self[code] = " " if c.isspace() else "".join(x if x == "Σ" else x.lower() for x in kept)
        return self[code]


_FOLDS = _Folds()


def folded(token: str) -> str:
    """A lower-case token without accents, its letters of plain width."""
    if token.isascii():
        return token
    found = token.translate(_FOLDS)
    return _folded(token) if "Σ" in found else found.replace(" ", "")


def plain_text(data: bytes) -> str:
    """A text, lower-cased and folded."""
    text = data.decode("utf-8", "replace").lower()
    if data.isascii():
        return text
    found = text.translate(_FOLDS)
    return " ".join(map(folded, text.split())) if "Σ" in found else found


def tokens_of(data: bytes) -> list[str]:
    """The tokens of a text between blanks, lower-cased and folded."""
    return plain_text(data).split()


#: Bytes of texts that are glanced at together.
STACK = 1 << 16


def stacks(data: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in stacks of about STACK bytes; a longer text is one of its own."""
    own, size = [], 0
    for x in data:
        if own and size + len(x) > STACK:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x)
    if own:
        yield own


_OTHER = "\x04"
#: Weights of trigrams are sums of multiples of 1 / _UNIT, which are the same in any order.
_UNIT = 1 << 20


def classed(letters: str) -> str:
    """Letters with all but a to z as one class, so that there are no more trigrams than the alphabet has."""
    return letters if letters.isascii() else "".join(_OTHER if c.isalpha() and not c.isascii() else c for c in letters)


def trigrams(words: Iterable[tuple[str, int]]) -> Counter[str]:
    """The weights of the trigrams of words, in units, given the number of texts of each."""
    out: Counter[str] = Counter()
    for w, n in words:
        if w.isalpha():
            full = _START * 2 + classed(w) + _END
            weight = round((1 + math.log(n)) * _UNIT)
            for i in range(2, len(full)):
                out[full[i - 2 : i + 1]] += weight
    return out


class CharModel:
    """Trigram letters with backing-off by interpolation."""

    def __init__(self, words: dict[str, int], three: dict[str, int] | None = None):
        self.three: Counter[str] = Counter()
        self.two: Counter[str] = Counter()
        self.one: Counter[str] = Counter()
        for gram, weight in sorted((trigrams(words.items()) if three is None else three).items()):
            self.three[gram] += weight / _UNIT
            self.two[gram[:2]] += weight / _UNIT
            self.one[gram[2]] += weight / _UNIT
        self.total = sum(self.one.values()) or 1.0
        self.known: dict[str, float] = {}

    def log(self, context: str, char: str) -> float:
        key = context + char
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            three = classed(key)
            p1 = (self.one.get(three[2:], 0) + 0.1) / (self.total + 100)
            p3 = (self.three.get(three, 0) + 2 * p1) / (self.two.get(three[:2], 0) + 2)
            found = self.known[key] = math.log(p3)
        return found


SWAP, ANY, DROP, KEEP_ODD, BREAK, JOIN = -1.0, -2.0, -0.5, -6.0, -1.0, 0.0


def stands_for(token: str, i: int, j: int) -> str:
    """The letters that a run of one character, from i to j, may stand for: its look-alikes, or any for another sign between letters."""
    c = token[i]
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    odd = not c.isalnum() and c not in SEPARATORS and c not in BRACKETS and j - i <= 2
    return _LETTERS if odd and i and token[i - 1].isalnum() and token[j : j + 1].isalnum() else ""


#: The column of a plain letter that stands once.
_ONE = {c: [(c, 0.0)] for c in _LETTERS}


def columns(token: str, i: int = 0) -> Iterator[list[tuple[str, float]]]:
    """The lattice of a token from a run's start on: for each run of one character, the strings it may stand for and their costs."""
    while i < len(token):
        c, j = token[i], i
        if c in _ONE and token[i + 1 : i + 2] != c:
            yield _ONE[c]
            i += 1
            continue
        while j < len(token) and token[j] == c:
            j += 1
        run, here = j - i, []
        for x in ([c] if c.isalpha() else []) + [*stands_for(token, i, j)]:
            cost = 0.0 if x == c else SWAP if c in LOOKALIKES else ANY
            if run <= 2:
                here.append((x * run, cost * run))
            here += [(x, cost + DROP * (run > 1)), (x * 2, cost + DROP)] if run > 1 else []
        if c in SEPARATORS or not c.isalnum():
            here.append(("", DROP))
        if not c.isalpha():
            here.append((c * run, KEEP_ODD))
        yield here
        i = j


def _through(best: dict, column: list[tuple[str, float]], model: CharModel) -> dict:
    """The best path to each context after a column, from those before it: (log probability, (path before, letters))."""
    then: dict = {}
    if len(column) == 1 and len(column[0][0]) == 1:
        ((x, cost),) = column
        for context, (logp, path) in best.items():
            p, c = logp + cost + model.log(context, x), context[1] + x
            if c not in then or p > then[c][0]:
                then[c] = (p, (path, x))
        return then
    for context, (logp, path) in best.items():
        for letters, cost in column:
            p, c = logp + cost, context
            for x in letters:
                p += model.log(c, x)
                c = c[1] + x
            if c not in then or p > then[c][0]:
                then[c] = (p, (path, letters))
    return then


def _text(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def restore(token: str, model: CharModel) -> str:
    """The most probable word behind a token."""
    best: dict = {_START * 2: (0.0, None)}
    for column in columns(token):
        best = _through(best, column, model)
    return _text(max(((p + model.log(c, _END), path) for c, (p, path) in best.items()), key=lambda x: x[0])[1])


def restore_words(run: str, model: CharModel) -> list[str]:
    """The most probable words behind letters that were spaced out; a blank in the run ends a word."""
    out = []
    for part in run.split():
        best: dict = {_START * 2: (0.0, None)}
        for i, column in enumerate(columns(part)):
            if i:
                p, path = max(((p + model.log(c, _END) + BREAK, path) for c, (p, path) in best.items() if c != _START * 2), key=lambda x: x[0], default=(0.0, None))
                if path is not None and p > best.get(_START * 2, (-math.inf,))[0]:
                    best[_START * 2] = (p, (path, " "))
            best = _through(best, column, model)
        out += _text(max(((p + model.log(c, _END) * (c != _START * 2), path) for c, (p, path) in best.items()), key=lambda x: x[0])[1]).split()
    return out


JOINT = "\x01"


def restore_shreds(tokens: Iterable[str], model: CharModel) -> str:
    """The most probable words behind neighbouring tokens, with a blank between words and JOINT where two tokens are one word."""
    best: dict = {_START * 2: (0.0, None)}
    for i, token in enumerate(tokens):
        if i:
            ended = max(((p + model.log(c, _END), path) for c, (p, path) in best.items()), key=lambda x: x[0])
            best = {c: (p + JOIN, (path, JOINT)) for c, (p, path) in best.items() if c != _START * 2}
            best[_START * 2] = (ended[0], (ended[1], " "))
        for column in columns(token):
            best = _through(best, column, model)
    return _text(max(((p + model.log(c, _END), path) for c, (p, path) in best.items()), key=lambda x: x[0])[1])


#: What a model remembers of its table and of tokens.
_LOOKED_UP = ("_heads", "_dead", "_tables")


@dataclass
class Model:
    chars: CharModel
    odds: dict[str, float] = field(default_factory=dict)
    none: float = 0.0
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    prefixes: tuple[int, ...] = (7, 6, 5, 4)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in _LOOKED_UP}

    def restored(self, word: str, known: Container[str] | None = None) -> str:
        """The word behind a token; ``known``: words that are not disguised by a letter that stands twice."""
        core = word.strip(_EDGE)
        if word[:1] in "$@(!|<" and core and len(word) > len(core):
            core = word.rstrip(_EDGE)
        if len(core) > 2 and any(c.isalpha() for c in core):
            if _SUSPECT.search(core) or (core not in (self.odds if known is None else known) and _TWICE.search(core)):
                return restore(core, self.chars)
        return core

    def found(self, word: str) -> float | None:
        """Log-odds of a word or else of its longest known prefix."""
        found = self.odds.get(word)
        if found is None:
            for n in self.prefixes:
                if len(word) > n and (found := self.odds.get(word[:n] + "+")) is not None:
                    break
        return found

    def word(self, word: str) -> float:
        """Log-odds of one token."""
        if word.isascii() and word.isalpha() and not _TWICE.search(word):  # nothing to restore
            found = self.found(word)
            return self.none if found is None else found
        word = folded(word)
        found = self.found(self.restored(word))
        if found is None:  # what the lattice changed for nothing
            found = self.found(word.strip(_EDGE))
        found = self.none if found is None else found
        if _ODD.search(word):  # a sign that stands for any letter tells little; the table says which words there may be
            ends = self.spelled(frozenset(("",)), word.strip(_EDGE), 0)[0]
            found = max((found, *(self.heads()[at][1] for at in ends if at)))
        return found

    def spaced(self, run: str) -> dict[str, float]:
        """Words behind a run of spaced letters with their log-odds: one word or several, as the higher odds have it."""
        several = {w: self.none if (s := self.found(w)) is None else s for w in restore_words(run, self.chars)}
        whole = run.replace(" ", "")
        one = self.word(whole)
        return several if several and max(several.values()) >= one else {whole: one}

    def heads(self) -> dict[str, tuple[float, float, float]]:
        """Every beginning of the table's words and prefixes above JOINED, letters that stand twice written once: the highest
        log-odds of what begins so, of the word itself and of the prefix itself."""
        if not hasattr(self, "_heads"):
            self._heads: dict[str, tuple[float, float, float]] = {}
            for w, s in self.odds.items():
                if s > JOINED:
                    whole = squeezed(w.removesuffix("+"))
                    for k in range(1, len(whole) + 1):
                        best, word, prefix = self._heads.get(whole[:k], (-math.inf,) * 3)
                        if k == len(whole):
                            word, prefix = (word, max(prefix, s)) if w.endswith("+") else (max(word, s), prefix)
                        self._heads[whole[:k]] = (max(best, s), word, prefix)
        return self._heads

    def tables(self) -> glance.Tables:
        """What tells which tokens of a text have to be looked at."""
        if not hasattr(self, "_tables"):
            odds = ((squeezed(w.removesuffix("+")) + "+" * w.endswith("+"), s) for w, s in self.odds.items())
            heads = {h: prefix > -math.inf for h, (_, _, prefix) in self.heads().items()}
            mute = "".join(c for c in _EDGE if c not in LOOKALIKES)
            self._tables = glance.Tables(odds, self.none, heads, mute, mute, _EDGE, "".join(MARKS))
        return self._tables

    def spelled(self, states: frozenset[str], token: str, least: int) -> tuple[frozenset[str], float]:
        """Where the readings of a token lead from beginnings of the table's words, and the highest log-odds of what they meet
        beyond ``least`` letters: words where the token ends, prefixes anywhere in it."""
        heads, met = self.heads(), -math.inf
        if token.isascii() and token.isalpha():  # one reading
            ends = set()
            for at in states:
                for x in token:
                    if at[-1:] != x:
                        at += x
                        head = heads.get(at)
                        if head is None:
                            break
                        if head[2] > met and len(at) > least:
                            met = head[2]
                else:
                    ends.add(at)
            return frozenset(ends), max((met, *(heads[at][1] for at in ends if len(at) > least)))
        if plain := _PLAIN.match(token):  # letters in front have one reading
            ends = set()
            for at in states:
                for x in plain[0]:
                    if at[-1:] != x:
                        at += x
                    head = heads.get(at)
                    if head is None:
                        break
                    if head[2] > met and len(at) > least:
                        met = head[2]
                else:
                    ends.add(at)
            states = frozenset(ends)
            if not states:
                return states, met
        for column in columns(token, plain.end() if plain else 0):
            ahead = (state if not x or state[-1:] == x[0] else state + x[0] for state in states for x, _ in column)
            states = frozenset(at for at in ahead if at in heads or not at)
            if not states:
                break
            met = max((met, *(heads[at][2] for at in states if len(at) > least)))
        return states, max((met, *(heads[at][1] for at in states if len(at) > least)))

    def joined(self, tokens: tuple[str, ...]) -> tuple[str, float]:
        """The word that neighbouring tokens make together, and its log-odds; none where the best path leaves them apart, and
        where the table knows neither the word nor, for shreds that are not all words of the table, a prefix ending in the last."""
        text = restore_shreds(tokens, self.chars)
        *before, last = text.split(JOINT)
        word = "".join((*before, last))
        if " " in text or not before:
            return word, self.none
        found = self.odds.get(word)
        if found is None and any(t.strip(_EDGE) not in self.odds for t in tokens):
            known = (self.odds.get(word[:n] + "+") for n in self.prefixes if len(word) > n > len(word) - len(last))
            found = next((s for s in known if s is not None), None)
        return word, found if found is not None and found > JOINED else self.none

    def opening(self, token: str) -> tuple[frozenset[str], int, str] | None:
        """The beginnings of the table's words that a token may be, the fewest letters of one, and the only one, where it is alone."""
        start = token[:6]
        if MARKS.issuperset(start) and MARKS.issuperset(token):
            return None
        if (plain := _PLAIN.match(start)) and plain[0] not in self.heads() and not _TWICE.search(plain[0]):
            return None
        states = self.spelled(frozenset(("",)), token, 0)[0] - {""}
        return (states, min(map(len, states)), next(iter(states)) if len(states) == 1 else "") if states else None

    def judged(self, token: str, cache: dict) -> tuple[float, tuple[frozenset[str], int, str] | None]:
        """Log-odds of a token and its opening(). Letters with marks behind them are what the letters are alone, unless a word of
        the table goes on with the first mark."""
        own = cache.get(token)
        if own is None:
            core = token.rstrip(_BEHIND)
            if core != token and core.isascii() and core.isalpha():
                own = cache.get(core)
                if own is None:
                    own = cache[core] = (self.word(core), self.opening(core))
                if own[1] is not None and any(at + token[len(core)] in self.heads() for at in own[1][0]):
                    own = (own[0], self.opening(token))
            else:
                own = (self.word(token), self.opening(token))
            cache[token] = own
        return own

    def shreds(self, tokens: list[str], opens: dict[str, tuple[frozenset[str], int, str]], floor: float, cache: dict, starts: Iterable[int] | None = None) -> dict[str, float]:
        """The words above ``floor`` that neighbouring tokens make together, with their log-odds. A word begins at any token of
        ``opens`` (``starts``: of these positions) and goes on as long as every token adds to a beginning of one of the table's words."""
        out: dict[str, float] = {}
        if not hasattr(self, "_dead"):
            self._dead: dict[frozenset[str], set[str]] = {}
        if len(self._dead) > REMEMBERED // 100:
            self._dead.clear()
        dead = {w: self._dead.setdefault(at[0], set()) for w, at in opens.items()}
        for i in range(len(tokens) - 1) if starts is None else starts:
            if tokens[i] not in dead:
                continue
            states, least, _ = opens[tokens[i]]
            start = tokens[i + 1][:3]
            if start in dead[tokens[i]]:
                continue
            if start.isascii() and start.isalpha():
                ahead, met = self.spelled(states, start, least)
                if not ahead and met <= JOINED:  # three letters tell most that lead nowhere
                    dead[tokens[i]].add(start)
                    continue
            for j in range(i + 1, len(tokens)):
                ahead, met = self.spelled(states, tokens[j], least)
                states = ahead - states
                if met > floor:
                    key = tuple(tokens[i : j + 1])
                    found = cache.get(key)
                    if found is None:
                        found = cache[key] = self.joined(key)
                    if found[1] > floor:
                        out[found[0]] = found[1]
                if not states:
                    break
        return out

    def features(self, data: bytes, cache: dict) -> tuple[float, ...]:
        return next(self.features_of([data], cache))

    def features_of(self, data: list[bytes], cache: dict) -> Iterator[tuple[float, ...]]:
        """features() of each of the texts, which are glanced at in stacks."""
        for some in stacks(data):
            texts = [plain_text(x) for x in some]
            for x, text, seen in zip(some, texts, self.tables().glances(texts), strict=True):
                yield self._features(x, text, seen, cache)

    def _features(self, data: bytes, text: str, seen: glance.Glance, cache: dict) -> tuple[float, ...]:
        if len(cache) > REMEMBERED:
            cache.clear()
        tokens = text.split()
        top = [self.none] * 3

        def offer(s: float) -> None:
            if s > top[2]:
                top[2] = s
                top.sort(reverse=True)

        for w in {tokens[i] for i in seen.odd.tolist()}:
            offer((cache.get(w) or self.judged(w, cache))[0])
        some = np.flatnonzero(seen.bounds > top[2])
        some = some[np.argsort(-seen.bounds[some], kind="stable")]
        met = set()
        for i, bound in zip(some.tolist(), seen.bounds[some].tolist(), strict=True):
            if bound <= top[2]:
                break  # the others are none of the three highest
            w = tokens[i]
            if w not in met:
                met.add(w)
                offer((cache.get(w) or self.judged(w, cache))[0])
        runs = spaced_runs(data, tokens) if seen.spaced or "\u034f" in text else set()
        near = tokens if len(seen.kept) == len(tokens) else [tokens[i] for i in seen.kept.tolist()]
        starts = sorted([*seen.odd_starts.tolist(), *seen.starts.tolist()])
        judged = ((w, (cache.get(w) or self.judged(w, cache))[1]) for w in {near[i] for i in starts})
        opens = {w: own for w, own in judged if own is not None}
        together = self.shreds(near, opens, max(JOINED, top[2]), cache, starts)
        for run in runs:
            together.update(self.spaced(run))
        words = set(tokens) if together else set()
        for w, s in together.items():
            if w not in words:
                offer(s)
        return (*top, max(top[0] - 4.5, 0.0), max(top[1] - 4.5, 0.0))

    def scores(self, data: list[bytes], cache: dict | None = None) -> np.ndarray:
        if self.calibration is None:
            return np.zeros(len(data))
        cache = {} if cache is None else cache
        out = np.array(list(self.features_of(data, cache)), dtype=float).reshape(-1, 5)
        return fitting.probability(out, self.calibration)


_SIGN = "[A-Za-z0-9À-ɏ！-～#%?&" + re.escape("".join(sorted({*LOOKALIKES, *SEPARATORS}))) + "][\u0300-\u036f]*"
_SPACED = re.compile(rf"(?:(?<=\s)|^)(?:{_SIGN}\s+){{2,}}{_SIGN}(?=\s|$)")


#: What single signs of _SIGN fold to, where that is more than one character.
_DIGRAPHS = frozenset(("dz", "ij", "l·", "lj", "nj", "ʼn"))


def may_be_spaced(tokens: list[str]) -> bool:
    """Whether three neighbouring tokens are what single signs fold to. One mark of those behind a sign is not folded away."""
    short = {w for w in {*tokens} if len(w) == 1 or w in _DIGRAPHS or (w[-1] == "͏" and (len(w.replace("͏", "")) == 1 or w.replace("͏", "") in _DIGRAPHS))}
    at = [i for i, w in enumerate(tokens) if w in short] if short else []
    return any(c - a == 2 for a, c in zip(at, at[2:]))


def spaced_runs(data: bytes, tokens: list[str] | None = None) -> set[str]:
    """Runs of single signs between spaces, closed up; gaps wider than the run's narrowest are left as one blank. ``tokens``:
    those of the text."""
    found: set[str] = set()
    if not may_be_spaced(tokens_of(data) if tokens is None else tokens):
        return found
    for m in _SPACED.finditer(data.decode("utf-8", "replace")):
        signs, gaps = [folded(x) for x in m[0].lower().split()], [len(g) for g in re.findall(r"\s+", m[0])]
        if 1 < len(set(signs)) and any(c.isalpha() for c in signs):
            narrow = min(gaps)
            found.add("".join(c + " " * (g > narrow) for c, g in zip(signs, [*gaps, narrow], strict=True)))
    return found


def squeezed(word: str) -> str:
    """Letters that stand twice or more often written once."""
    return _TWICES.sub(r"\1", word) if _TWICE.search(word) else word


_TWICES = re.compile(r"(.)\1+")


def spaced_words(data: bytes) -> set[str]:
    """spaced_runs() without blanks."""
    return {run.replace(" ", "") for run in spaced_runs(data)}


def plain_words(data: bytes) -> set[str]:
    return {w.strip(_EDGE) for w in tokens_of(data)}


#: Tokens that a task remembers.
REMEMBERED = 250_000


def evidence(data: bytes, model: Model, often: Container[str], known: dict[str, tuple[str, ...]]) -> set[str]:
    """Restored words and prefixes (with a plus sign) of one text. ``often``: frequent plain words, at least those in which a
    letter stands twice; ``known``: a cache."""
    own: set[str] = set()
    if len(known) > REMEMBERED:
        known.clear()
    runs = spaced_runs(data)
    for run in runs:
        own.update(restore_words(run, model.chars))
    raws = {*tokens_of(data), *(run.replace(" ", "") for run in runs)}
    for raw in [x for x in raws if x not in known]:
        core = raw.rstrip(_BEHIND)
        w = core if core.isascii() and core.isalpha() and not _TWICE.search(core) else model.restored(raw, often)
        known[raw] = (w, *[w[:k] + "+" for k in model.prefixes if len(w) > k])
    own.update(*map(known.__getitem__, raws))
    return own


#: A word is frequent if it is in two texts and in one of so many.
FREQUENT = 2000


#: A rare word tells of toxic texts if it would be in as many of them by chance less often than this.
CHANCE = 1e-4


def frequent(n: int, texts: int) -> bool:
    return n >= 2 and n * FREQUENT >= texts


def telling(a: int, b: int, share: float) -> bool:
    """Whether chance hardly puts a word into ``a`` toxic and ``b`` other texts, by Chernoff's bound."""
    n = a + b
    return a > share * n and a * math.log(a / (share * n)) + (b * math.log(b / ((1 - share) * n)) if b else 0.0) >= -math.log(CHANCE)


def log_odds(counts: Iterable[tuple[str, int, int]], n: tuple[int, int], smooth: float = 0.5) -> Iterator[tuple[str, float, bool]]:
    """Shrunk log-odds of words from (word, harmless texts, toxic texts), and whether the table of odds has them: frequent words,
    and those above JOINED that chance does not explain. Words of one text alone say nothing."""
    for w, b, a in counts:
        if a + b >= 2:
            odds = math.log((a + smooth * n[1] / sum(n)) / (n[1] + smooth)) - math.log((b + smooth * n[0] / sum(n)) / (n[0] + smooth))
            odds *= (a + b) / (a + b + 1.5)
            yield w, odds, frequent(a + b, sum(n)) or (odds > JOINED and telling(a, b, n[1] / sum(n)))


def exceptions(odds: Iterable[tuple[str, float, bool]], model: Model) -> Iterator[tuple[str, float]]:
    """Words and prefixes that the table lacks, but that it would take for a word or prefix above JOINED."""
    for w, s, has in odds:
        if not has:
            if w.endswith("+"):
                shorter = (model.odds.get(w[:k] + "+") for k in model.prefixes if len(w) > k + 1)
                found = next((x for x in shorter if x is not None), None)
            else:
                found = model.word(w)
            if found is not None and found > JOINED:
                yield w, s


def fit(build: list[tuple[bytes, int]], rest: list[tuple[bytes, int]]) -> Model:
    """toxicity_model() on lists, in one place."""
    plain: Counter[str] = Counter()
    for data, _ in build:
        plain.update(plain_words(data))
    model = Model(CharModel(plain))
    n = tuple(sum(y == k for _, y in build) for k in (0, 1))
    if not min(n) or len({y for _, y in rest}) < 2:
        return model
    seen, known, often = (Counter(), Counter()), {}, {w for w, c in plain.items() if frequent(c, len(build))}
    for data, y in build:
        seen[y].update(evidence(data, model, often, known))
    found = list(log_odds(((w, seen[0][w], seen[1][w]) for w in {*seen[0], *seen[1]}), n))
    model.odds = {w: s for w, s, has in found if has}
    model.odds |= dict(exceptions(found, Model(model.chars, model.odds)))
    model.calibration = fitting.logistic(np.array([model.features(x, {}) for x, _ in rest]), np.array([y for _, y in rest], dtype=float))
    return model


def score(docs: DataFrame, model: Model, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of a toxic text) and predicted (1 from ``cut`` on)."""
    key = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table of odds

    def run(batches):
        cache: dict = {}
        own = shared.value
        for batch in batches:
            s = own.scores(common.texts(batch, "_text"), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= cut).astype("int32"))], names=[id_col, "score", "predicted"])

    return common.keyed(docs, id_col, text_col).toDF(id_col, "_text").mapInArrow(run, f"{id_col} {key}, score double, predicted int")


def _rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` over all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in schema.split(", ")])
        rows = iter(fn(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        while some := list(islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)


def toxicity_model(docs: DataFrame, labels: DataFrame, learns: Column | None = None, rows_per_class: int | None = None) -> Model:
    """Fits on the executors, to all labelled texts or to ``rows_per_class`` of each label: plain words for the character model,
    then restored words by label, then features to calibrate. The driver gets the alphabet's trigrams, the table of odds
    and sums."""
    sample = fitting.labelled_sample(docs, labels, "toxic", rows_per_class, learns)
    context = docs.sparkSession.sparkContext
    build, rest = sample.where("_build"), sample.where("NOT _build")
    n = dict(build.groupBy("_label").count().collect())
    texts = sum(n.values())
    plain = common.written(fitting.counted_words(build, plain_words).select("word", (F.col("n0") + F.col("n1")).alias("n")), "plain")
    three = _rows(plain, lambda rows: trigrams(rows).items(), "gram string, weight long").groupBy("gram").agg(F.sum("weight").alias("weight"))
    model = Model(CharModel({}, dict(three.toLocalIterator())))
    if len(n) < 2 or rest.select("_label").distinct().count() < 2:
        return model
    least = F.greatest(F.lit(2), F.ceil(F.lit(texts) / F.lit(FREQUENT)))
    often = {w for (w,) in plain.where(F.col("n") >= least).select("word").toLocalIterator() if _TWICE.search(w)}
    shared = context.broadcast((model, often))
    known: dict[str, tuple[str, ...]] = {}  # one for each task
    counts = fitting.counted_words(build, lambda data: evidence(data, *shared.value, known)).where("n0 + n1 >= 2")
    both = (n[0], n[1])
    odds = common.written(counts, "odds")
    model.odds = dict(_rows(odds, lambda rows: ((w, s) for w, s, has in log_odds(rows, both) if has), "word string, odds double").toLocalIterator())
    table = context.broadcast(Model(model.chars, model.odds))
    model.odds = model.odds | dict(_rows(odds, lambda rows: exceptions(log_odds(rows, both), table.value), "word string, odds double").toLocalIterator())
    judge, cache = context.broadcast(model), {}
    model.calibration = fitting.logistic_of(fitting.feature_table(rest, lambda data: judge.value.features_of(data, cache)))
    return model
