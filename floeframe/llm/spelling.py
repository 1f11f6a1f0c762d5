"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

Words are maximal runs of letters, lower-cased, of at least ``least`` code points and two occurrences. A word's vector counts
its letters (accented letters share six of the 32 places, which can only bring words nearer). One replaced letter moves
one count up and one down, L1 distance two at most; one inserted letter moves one count up. So for each pair of lengths
(l, l) and (l, l + 1) the words near a given one lie in a small box around its vector.

Two layers of trees. A tree per length, with splits from a sample, deals the words out into cells; any splits give the same result, the sample
only balances the cells. A word is a target in its own cell, and a query in every cell whose box is within reach: of its own
length (towards lower cells, so that each pair meets once) and of the next. In a cell the targets make a k-d tree with tight
boxes; queries stream through it batch by batch, boxes out of reach are pruned, and what is left is verified letter by letter.
Both ends of each pair are counted at once, so that no pair leaves its task. A cell with too many targets (anagrams, which no
count can part) is dealt out to several tasks, and its queries to all of them.

A form is the near word of largest n, and a root is found along forms by pointer doubling: n grows tenfold each step, so
the steps are at most log10 of the largest n.

Edge cases: a null text has no words; a null id is written as an empty string in the hash; repeated rows count again; ties go to
the smallest word in code-point order; a word of any length takes part; an empty table gives no rows; columns beside doc_id and text are
not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import Scratch

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACES = 32
FOLD = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])      # letter to place in the vector
FACTOR = 10              # a form is at least so many times as frequent
LEAF = 48                # words in a leaf of a cell's tree
CELL = 4096              # words a cell is meant to hold
MOST_CELLS = 20_000      # beyond so many, cells grow instead
SAMPLE = 16              # sampled words for each cell, for the splits
PAIRS = 1 << 21          # code points compared at once


# --- trees -------------------------------------------------------------------------------------------------

def codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letters; all are below U+0100."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def counts(letters: np.ndarray) -> np.ndarray:
    n, length = letters.shape
    places = FOLD[letters] + np.arange(n)[:, None] * PLACES
    out = np.bincount(places.ravel(), minlength=n * PLACES).reshape(n, PLACES)
    return out.astype(np.int8 if length < 127 else np.int32)


class Tree:
    """A k-d tree over count vectors: boxes per node, row numbers (or one cell number) per leaf."""

    def __init__(self, vectors: np.ndarray, leaf: int, tight: bool):
        self.low, self.high, self.children, self.rows = [], [], [], []
        self.cells = 0
        top = np.iinfo(vectors.dtype).max
        self._grow(vectors, np.arange(len(vectors)), leaf, tight, np.zeros(PLACES, vectors.dtype), np.full(PLACES, top, vectors.dtype))

    def _grow(self, vectors, rows, leaf, tight, low, high) -> int:
        at, held = len(self.low), vectors[rows]
        self.low.append(held.min(0) if tight and len(rows) else low)
        self.high.append(held.max(0) if tight and len(rows) else high)
        self.children.append(None)
        self.rows.append(None)
        cut = self._cut(held) if len(rows) > leaf else None
        if cut is None:
            self.rows[at] = rows if tight else self.cells
            self.cells += 1
            return at
        place, most = cut
        left = held[:, place] <= most
        upper, lower = high.copy(), low.copy()
        upper[place], lower[place] = most, most + 1
        a = self._grow(vectors, rows[left], leaf, tight, low, upper)
        b = self._grow(vectors, rows[~left], leaf, tight, lower, high)
        self.children[at] = (a, b)
        return at

    @staticmethod
    def _cut(held: np.ndarray) -> tuple[int, int] | None:
        """Place and threshold that part the rows most evenly; None where all rows are alike."""
        best, found = len(held), None
        medians = np.median(held, axis=0).astype(int)
        for most in {0, 1, 2, 3}:
            there = (held <= most).sum(0)
            place = int(np.abs(2 * there - len(held)).argmin())
            if abs(2 * int(there[place]) - len(held)) < best:
                best, found = abs(2 * int(there[place]) - len(held)), (place, most)
        if found is None:                                        # all counts are above the usual thresholds
            for place in range(PLACES):
                for most in (int(medians[place]), int(medians[place]) - 1, int(held[:, place].min())):
                    there = int((held[:, place] <= most).sum())
                    if abs(2 * there - len(held)) < best:
                        best, found = abs(2 * there - len(held)), (place, most)
        return found

    def search(self, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[object, np.ndarray]]:
        """(leaf's rows or cell, numbers of the vectors in reach): counts may rise by ``up`` and fall by ``down`` in all."""
        stack = [(0, np.arange(len(vectors)), np.ascontiguousarray(vectors.T))]
        while stack:
            at, q, v = stack.pop()                               # places by words, so that sums run along memory
            reach = np.maximum(self.low[at][:, None] - v, 0).sum(0, dtype=v.dtype) <= up
            reach &= np.maximum(v - self.high[at][:, None], 0).sum(0, dtype=v.dtype) <= down
            if not reach.all():
                q, v = q[reach], v[:, reach]
            if not len(q):
                continue
            if self.children[at] is None:
                yield self.rows[at], q
            else:
                stack += [(self.children[at][0], q, v), (self.children[at][1], q, v)]


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in exactly one letter."""
    return (a != b).sum(1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b's rows are a's with one letter more."""
    n = a.shape[1]
    before, after = a != b[:, :n], a != b[:, 1:]
    head = np.where(before.any(1), before.argmax(1), n)
    tail = np.where(after.any(1), after[:, ::-1].argmax(1), n)
    return head + tail >= n


def pairs(tree: Tree, targets: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, target numbers) of verified pairs; targets have the queries' length or one letter more."""
    same = targets.shape[1] == queries.shape[1]
    check = replaced if same else inserted
    vectors = counts(queries)
    if targets.shape[1] >= 127:
        vectors = vectors.astype(np.int32)
    for rows, q in tree.search(vectors, 1, int(same)):
        step = max(1, PAIRS // (len(rows) * targets.shape[1]))
        for i in range(0, len(q), step):
            one, two = np.repeat(q[i:i + step], len(rows)), np.tile(rows, len(q[i:i + step]))
            good = check(queries[one], targets[two])
            if good.any():
                yield one[good], two[good]


# --- words -------------------------------------------------------------------------------------------------

def words(docs: DataFrame, least: int = 7, varied: int | None = 31) -> DataFrame:
    """word, n: runs of ``least`` letters or more with two occurrences or more.

    ``varied``: where it divides the CRC-32 of "id:run", the letter at that number modulo the length is deleted first.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    if varied:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = "cast(h % char_length(run) as int)"
        runs = runs.withColumn("run", F.when(F.col("h") % varied == 0, F.expr(f"concat(substr(run, 1, {at}), substr(run, {at} + 2))")).otherwise(F.col("run")))
    out = runs.where(F.char_length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") > 1)


# --- cells -------------------------------------------------------------------------------------------------

def by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def fit_trees(vocabulary: DataFrame) -> dict[int, Tree | None]:
    """A tree of cells for each length of words; None where one cell is enough.

    The driver gets one row for each length and about ``SAMPLE`` words for each cell, at most SAMPLE * MOST_CELLS.
    """
    size = F.char_length("word")
    lengths = {r[0]: r[1] for r in vocabulary.groupBy(size).count().collect()}
    cell = max(CELL, sum(lengths.values()) // MOST_CELLS)
    large = [n for n, rows in lengths.items() if rows > cell]
    sample: dict[int, list[str]] = defaultdict(list)
    if large:
        picked = vocabulary.where(size.isin(large) & (F.pmod(F.xxhash64("word"), F.lit(cell)) < SAMPLE)).select("word")
        for r in picked.collect():
            sample[len(r[0])].append(r[0])
    return {n: Tree(counts(codes(sample[n])), SAMPLE, tight=False) if sample[n] else None for n in lengths}


def _cells(tree: Tree | None, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    if tree is None:
        yield 0, np.arange(len(vectors))
    else:
        yield from tree.search(vectors, up, down)


def _home(trees: dict[int, Tree | None]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cells = np.zeros(len(f), dtype=np.int32)
            for length, at in by_length(f["word"]):
                for cell, q in _cells(trees[length], counts(codes(f["word"].iloc[at].tolist())), 0, 0):
                    cells[at[q]] = cell
            yield f.assign(cell=cells)
    return run


def _route(trees: dict[int, Tree | None], ways: dict[tuple[int, int], int]):
    """Each word as a target (role 0) of its own cell and as a query of its own (1) and other cells (2)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            home = f["cell"].to_numpy()
            salts = np.array([xxhash.xxh32_intdigest(w.encode()) for w in f["word"]], dtype=np.int64)
            rows = []                                            # (row numbers, size, cell, role, salt), one array each
            for length, at in by_length(f["word"]):
                vectors = counts(codes(f["word"].iloc[at].tolist()))
                if length == 126:
                    vectors = vectors.astype(np.int32)           # the next length counts in wider numbers
                for size in (length, length + 1):
                    if size not in trees:
                        continue
                    for cell, q in _cells(trees[size], vectors, 1, int(size == length)):
                        parts, q = ways.get((size, cell), 1), at[q]
                        role = np.full(len(q), 2)
                        if size == length:
                            role[home[q] == cell] = 1
                            own = q[role == 1]
                            rows.append((own, size, cell, np.zeros(len(own), int), salts[own] % parts))
                            q, role = q[home[q] >= cell], role[home[q] >= cell]
                        rows += [(q, size, cell, role, np.full(len(q), salt)) for salt in range(parts) if len(q)]
            picked = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, int)
            lengths = [len(r[0]) for r in rows]
            for begin in range(0, len(picked), ROUTED_ROWS):
                some = slice(begin, begin + ROUTED_ROWS)
                out = f.iloc[picked[some]][["word", "n"]]
                yield out.assign(cell=np.repeat([r[2] for r in rows], lengths)[some], size=np.repeat([r[1] for r in rows], lengths)[some],
                                 role=np.concatenate([r[3] for r in rows])[some], salt=np.concatenate([r[4] for r in rows])[some])
    return run


ROUTED_ROWS = 50_000     # rows handed on at once
ROUTED = "word string, n long, cell int, size int, role int, salt int"
FOUND = "word string, near long, best_n long, best string"


def _best(words: np.ndarray, ns: np.ndarray, one: list[int], other: list[int], other_words: np.ndarray, other_ns: np.ndarray) -> pd.DataFrame:
    """Number of near words and the best of them, for each word that has any."""
    found: dict[int, list] = {}
    for a, b in zip(one, other):
        key = (-int(other_ns[b]), other_words[b])
        held = found.get(a)
        if held is None:
            found[a] = [1, key]
        else:
            held[0] += 1
            held[1] = min(held[1], key)
    return pd.DataFrame([(words[a], k, -key[0], key[1]) for a, (k, key) in found.items()], columns=["word", "near", "best_n", "best"])


def _cell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words within cells. Rows come cell by cell, targets first; only the targets of one cell are held."""
    at, targets, tree, letters, words, ns = None, [], None, None, None, None
    for f in frames:
        keys = f[["size", "cell", "salt"]].to_numpy()
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(f)]
        for begin, end in zip(edges[:-1], edges[1:]):
            if begin == end:
                continue
            if tuple(keys[begin]) != at:
                at, targets, tree = tuple(keys[begin]), [], None
            part = f.iloc[begin:end]
            role = part["role"].to_numpy()
            if (role == 0).any():
                targets.append(part[role == 0])
            queries = part[role > 0]
            if not len(queries) or not targets:
                continue
            if tree is None:
                held = pd.concat(targets)
                words, ns = held["word"].to_numpy(), held["n"].to_numpy()
                letters = codes(words.tolist())
                tree = Tree(counts(letters), LEAF, tight=True)
            own = queries["role"].to_numpy() == 1
            for _, rows in by_length(queries["word"]):
                asked, asked_ns, mine = queries["word"].to_numpy()[rows], queries["n"].to_numpy()[rows], own[rows]
                one, two = [], []
                for a, b in pairs(tree, letters, codes(asked.tolist())):
                    keep = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if not mine[x] or asked[x] < words[y]]
                    one += [x for x, _ in keep]
                    two += [y for _, y in keep]
                if one:
                    yield pd.concat([_best(asked, asked_ns, one, two, words, ns), _best(words, ns, two, one, asked, asked_ns)])


def near(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """word, near (number of words one edit away), best_n, best (the most frequent of them). ``vocabulary``: word, n."""
    trees = fit_trees(vocabulary)
    homes = scratch.store(vocabulary.select("word", "n").mapInPandas(_home(trees), "word string, n long, cell int"), "homes")
    # one row for each cell: at most MOST_CELLS and a few for each length
    held = homes.groupBy(F.char_length("word"), "cell").count().collect()
    ways = {(size, cell): k for size, cell, rows in held if (k := math.ceil(rows * max(size, 64) / (2 * CELL * 64))) > 1}
    key = ["size", "cell", "salt"]
    routed = spread(homes).mapInPandas(_route(trees, ways), ROUTED).repartition(*key).sortWithinPartitions(*key, "role")
    found = routed.mapInPandas(_cell, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b"))).alias("m")
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("m.a")).alias("best_n"), F.col("m.b").alias("best"))


def roots(forms: DataFrame, steps: int, scratch: Scratch) -> DataFrame:
    """word, root: where the links word -> form end after at most ``steps``."""
    chain = scratch.store(forms.select("word", F.col("form").alias("root")), "chain")
    for _ in range(max(0, steps - 1).bit_length()):
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        before, chain = chain, scratch.store(chain.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "chain")
        scratch.drop(before)
    return chain


def variants(docs: DataFrame, scratch: Scratch, least: int = 7, varied: int | None = 31) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    vocabulary = scratch.store(words(docs, least, varied), "words")
    found = near(vocabulary, scratch)
    joined = vocabulary.join(found, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), "best", "best_n")
    fits = F.col("best_n") >= FACTOR * F.col("n")
    out = scratch.store(joined.select("word", "n", "n_near", F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    most = out.agg(F.max("n")).first()[0] or 1
    chain = roots(out.where(F.col("form").isNotNull()), math.ceil(math.log(most, FACTOR)) + 1, scratch)
    return out.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))
