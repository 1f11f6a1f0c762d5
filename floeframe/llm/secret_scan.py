"""Secrets by inferred format: base patterns, and probabilistic automata learned from labelled credentials.

Three base patterns label credentials (``assign``, ``access``, ``hex``; see the patterns below). For each kind a prefix tree
of labelled values is generalised by merging statistically compatible states (Hoeffding test on symbol and end
frequencies), at equal depth first and then between depths, giving a probabilistic automaton over character classes that keeps the
lengths and places which the values share. Every other candidate, a run of ``LEAST`` or more characters of the ``assign`` alphabet
outside the base spans, is then scored by its log likelihood under the automata. It becomes a span of kind ``format`` if one of them
makes it likelier than a background model of ordinary tokens does, by the odds of meeting one (``margin``), and if its moves are not
more unusual there than those of nearly all labelled values (``floor``). An unseen length only costs likelihood, so a shorter value of
a known alphabet can pass. Whether digits, letters or both belong to a kind is learned from its labelled values too: else a row
of digits, each of them likely in a hexadecimal key, would pass for one. A run that does not pass is scored without its outer
dots, then by its parts between dots, since a dot may be the text's own.

Base spans always stay. Added spans never overlap a base span; a run that one cuts is scored by its parts outside. Offsets are
code points, end exclusive.

Fit bounds (parameter): at most ``per_kind`` distinct labelled values of each kind and ``background`` ordinary
tokens, the first by a seeded hash. Scanning reads every text whole.

Edge cases: a null or empty text has no spans; a kind without ``least`` labelled values gets no automaton; equal starts
are listed in the kinds' order; repeated rows are scanned each; other columns, and their names, do not matter.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")       # the same as maximal runs of which those of 24 and more stay
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "format")
LEAST = 6                                # characters of a credential
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
SYMBOLS = 11                             # character classes and punctuation of a candidate
FLOOR = -3.0                             # deviations by which a credential may be unusual for its format, at least


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign", m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access", m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(*m.span(), "hex", m.group()) for m in HEX.finditer(text)]
    return out


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters outside ``taken``, which is in order of start."""
    at = 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        for low, high in itertools.takewhile(lambda x: x[0] < e, itertools.islice(taken, at, None)):
            if low - s >= LEAST:
                yield s, low
            s = max(s, high)
        if e - s >= LEAST:
            yield s, e


_CLASSES = str.maketrans({c: "0" if c.isdigit() else ("a" if c in "abcdef" else "g") if c.islower() else "A" if c in "ABCDEF" else "G"
                          for c in string.ascii_letters + string.digits})


def symbols(value: str) -> str:
    """Character classes: hex letters, other letters, digits; punctuation stands for itself."""
    if value.isascii():
        return value.translate(_CLASSES)
    return "".join("0" if c.isdigit() else ("a" if c in "abcdef" else "g") if c.islower() else ("A" if c in "ABCDEF" else "G") if c.isupper() else c
                   for c in value)


def mix(syms: str) -> tuple[bool, bool]:
    """Whether there are digits, and letters."""
    return "0" in syms, any(c in syms for c in "agAG")


@dataclass
class Automaton:
    moves: dict[int, dict[str, tuple[int, float]]]      # state -> symbol -> (state, log probability)
    ends: dict[int, float]                              # state -> log probability of ending, never 0
    misses: dict[int, float]                            # state -> log probability of one symbol not seen there
    floor: float = 0.0
    mixes: frozenset[tuple[bool, bool]] = frozenset()
    usual: dict[int, tuple[float, float]] = field(default_factory=dict)     # state -> mean and variance of a move's log probability

    def __post_init__(self) -> None:
        for q, out in self.moves.items():
            p = [(math.exp(x), x) for _, x in out.values()]
            total = sum(w for w, _ in p) or 1.0
            mean = sum(w * x for w, x in p) / total
            self.usual[q] = mean, max(0.0, sum(w * x * x for w, x in p) / total - mean * mean)

    def read(self, syms: str) -> tuple[float, float]:
        """Log likelihood of the whole string; how many deviations its moves lie from what the passed states usually give.

        A symbol not seen in a state leaves it there, and lies as many deviations off as the logarithm of its share says.
        """
        state, total, off, spread, missed = 0, 0.0, 0.0, 0.25, 0.0
        for s in syms:
            move = self.moves[state].get(s)
            if move is None:
                total += self.misses[state]
                missed += self.misses[state]
            else:
                mean, variance = self.usual[state]
                off += move[1] - mean
                spread += variance
                total += move[1]
                state = move[0]
        return total + self.ends[state], off / math.sqrt(spread) + missed


class _Tree:
    """The prefix tree of symbol strings, whose states can be merged; counts belong to merged states."""

    def __init__(self, values: list[str], alpha: float):
        self.kids: list[dict[str, int]] = [{}]
        self.arrive, self.stop, self.up = [0], [0], [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for v in values:
            at = 0
            self.arrive[0] += 1
            for s in v:
                if s not in self.kids[at]:
                    self.kids[at][s] = len(self.kids)
                    self.up.append(len(self.kids))
                    self.kids.append({})
                    self.arrive.append(0)
                    self.stop.append(0)
                at = self.kids[at][s]
                self.arrive[at] += 1
            self.stop[at] += 1
        self.passed = [{s: self.arrive[t] for s, t in k.items()} for k in self.kids]

    def find(self, q: int) -> int:
        while self.up[q] != q:
            self.up[q] = self.up[self.up[q]]
            q = self.up[q]
        return q

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (n1 ** -0.5 + n2 ** -0.5)

    def compatible(self, a: int, b: int) -> bool:
        """No end or symbol frequency differs, here and in all states reached by equal symbols."""
        pairs, seen = [(a, b)], set()
        while pairs:
            p, q = map(self.find, pairs.pop())
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            if self._differ(self.stop[p], self.arrive[p], self.stop[q], self.arrive[q]):
                return False
            for s in self.kids[p].keys() | self.kids[q].keys():
                if self._differ(self.passed[p].get(s, 0), self.arrive[p], self.passed[q].get(s, 0), self.arrive[q]):
                    return False
                if s in self.kids[p] and s in self.kids[q]:
                    pairs.append((self.kids[p][s], self.kids[q][s]))
        return True

    def merge(self, a: int, b: int) -> None:
        """b becomes a; states that equal symbols lead to become one too."""
        pairs = [(a, b)]
        while pairs:
            p, q = map(self.find, pairs.pop())
            if p == q:
                continue
            self.up[q] = p
            self.arrive[p] += self.arrive[q]
            self.stop[p] += self.stop[q]
            for s, t in self.kids[q].items():
                self.passed[p][s] = self.passed[p].get(s, 0) + self.passed[q][s]
                if s in self.kids[p]:
                    pairs.append((self.kids[p][s], t))
                else:
                    self.kids[p][s] = t

    def next_of(self, states: list[int]) -> list[int]:
        return list(dict.fromkeys(self.find(t) for q in states for _, t in sorted(self.kids[q].items())))


def infer(values: list[str], alpha: float = 0.05, floor_share: float = 0.02, evidence: int = 10) -> Automaton:
    """Merge compatible states of the values' prefix tree, first at equal depth, then between depths.

    Deep in the tree a state holds one or two strings, and no test can tell it from any other. So states of equal depth are
    pooled first: what remains there has counts that a test can use. Only then, and only where both have ``evidence``
    strings, are states of different depths merged, which makes loops. A length or a place that all values share stays, since the
    ends or symbols behind it differ.
    """
    tree = _Tree([symbols(v) for v in values], alpha)
    level = tree.next_of([0])
    while level:
        kept: list[int] = []
        for b in sorted(level, key=lambda q: (-tree.arrive[q], q)):
            match = next((a for a in kept if tree.compatible(a, b)), None)
            if match is None:
                kept.append(b)
            else:
                tree.merge(match, b)
        level = tree.next_of(kept)
    red, blue = [0], tree.next_of([0])
    while blue:
        for b in blue:
            b = tree.find(b)
            red = list(dict.fromkeys(map(tree.find, red)))
            if b in red:
                continue
            match = next((r for r in red if min(tree.arrive[r], tree.arrive[b]) >= evidence and tree.compatible(r, b)), None)
            if match is None:
                red.append(b)
            else:
                tree.merge(match, b)
        red = list(dict.fromkeys(map(tree.find, red)))
        blue = [q for q in tree.next_of(red) if q not in red]
    name = {q: i for i, q in enumerate(red)}
    moves, ends, misses = {}, {}, {}
    for q, i in name.items():
        n = tree.arrive[q] + 1                        # half a string more for an end, half for symbols not seen
        moves[i] = {s: (name[tree.find(t)], math.log(tree.passed[q][s] / n)) for s, t in tree.kids[q].items()}
        ends[i] = math.log((tree.stop[q] + 0.5) / n)
        misses[i] = math.log(0.5 / n / SYMBOLS)
    got = Automaton(moves, ends, misses)
    fits = sorted(got.read(symbols(v))[1] for v in values)
    got.floor = min(FLOOR, fits[int(floor_share * len(fits))] if fits else FLOOR)
    kinds = Counter(mix(symbols(v)) for v in values)
    got.mixes = frozenset(k for k, n in kinds.items() if n >= floor_share * len(values))
    return got


@dataclass
class Background:
    log: dict[str, float]          # symbol -> log probability in ordinary tokens, that a token goes on included
    miss: float
    end: float

    def read(self, syms: str) -> float:
        """Log likelihood of the whole string."""
        return sum(self.log.get(s, self.miss) for s in syms) + self.end


def background_of(tokens: list[str]) -> Background:
    count: dict[str, int] = defaultdict(int)
    for t in tokens:
        for s in symbols(t):
            count[s] += 1
    steps = sum(count.values()) + len(count) + 1 + len(tokens) + 1
    return Background({s: math.log((n + 1) / steps) for s, n in count.items()}, math.log(1 / steps), math.log((len(tokens) + 1) / steps))


@dataclass
class SecretModel:
    automata: dict[str, Automaton]
    background: Background
    margin: float = 8.0            # log of how many ordinary tokens there are to one credential, about 3,000
    known: dict[str, bool] = field(default_factory=dict, repr=False, compare=False)     # verdicts on short symbol strings

    def likely(self, value: str) -> bool:
        syms = symbols(value)
        got = self.known.get(syms)
        if got is None:
            got = self._likely(syms)
            if len(syms) <= 64:
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[syms] = got
        return got

    def _likely(self, syms: str) -> bool:
        held = mix(syms)
        able = [a for a in self.automata.values() if held in a.mixes]
        ordinary = self.background.read(syms) if able else 0.0
        return any(total >= ordinary + self.margin and off >= a.floor for a in able for total, off in (a.read(syms),))

    def formats(self, text: str, s: int, e: int) -> Iterator[tuple[int, int]]:
        """The candidate, or it without outer dots, or its parts between dots, as far as they are likely."""
        value = text[s:e]
        if self.likely(value):
            yield s, e
        elif "." in value:
            bare = value.strip(".")
            low = s + len(value) - len(value.lstrip("."))
            if len(bare) >= LEAST and len(bare) < len(value) and self.likely(bare):
                yield low, low + len(bare)
            else:
                for part in bare.split("."):
                    if len(part) >= LEAST and self.likely(part):
                        yield low, low + len(part)
                    low += len(part) + 1


def fit(docs: DataFrame, text: str = "text", per_kind: int = 400, background: int = 5000, least: int = 5, seed: int = 5) -> SecretModel:
    """Automata from the credentials that the base patterns label, in all texts."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def labelled(texts: pd.Series) -> pd.Series:
        rows = []
        for t in texts:
            t = t or ""
            found = [(k, v) for _, _, k, v in base_spans(t)]
            # one ordinary token for every text, taken by the text's own hash
            words = t.split()
            if words:
                w = words[int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=6).digest(), "big") % len(words)]
                found.append(("ordinary", w[:64]))
            rows.append([{"kind": k, "value": v} for k, v in found])
        return pd.Series(rows)

    values = (docs.select(F.inline(labelled(F.col(text)))).distinct()
              .withColumn("_h", F.xxhash64("kind", "value", F.lit(seed))))
    got: dict[str, list[str]] = {}
    spark = docs.sparkSession
    from .common import Scratch
    scratch = Scratch(spark, "secrets")
    values = scratch.store(values, "labelled")
    for kind, n in (("assign", per_kind), ("access", per_kind), ("hex", per_kind), ("ordinary", background)):
        got[kind] = [r["value"] for r in values.where(F.col("kind") == kind).orderBy("_h", "value").limit(n).collect()]
    scratch.drop(values)
    automata = {k: infer(got[k]) for k in ("assign", "access", "hex") if len(got[k]) >= least}
    return SecretModel(automata, background_of(got["ordinary"]))


def spans_of(text: str | None, model: SecretModel) -> list[tuple[int, int, str]]:
    """All spans of a text in order of start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    taken: list[tuple[int, int]] = []                  # base spans, overlapping ones as one
    for s, e in sorted((s, e) for s, e, _, _ in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = [(s, e, k) for s, e, k, _ in base]
    for s, e in candidates(text, taken):
        out += [(low, high, "format") for low, high in model.formats(text, s, e)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame, model: SecretModel, text: str = "text", name: str = "secret_spans") -> DataFrame:
    """``docs`` with an array of (start, end, kind)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in spans_of(t, m)] for t in texts], dtype=object)

    return docs.withColumn(name, spans(F.col(text)))
