"""Documents that contain benchmark items, by SimHash of item-sized windows.

For each length of an item there are windows of as many words at every position of a document. A window and an item
are compared by 128-bit SimHash fingerprints of their five-word shingles, a shingle counting as often as it stands there.
Fingerprints are indexed by 16 blocks of 8 bits: within ``RADIUS`` bits of difference at least one block differs in at
most ``RADIUS // 16`` bits, so looking up each block's near values finds every item within the radius. Candidates are then
verified by the exact weighted Jaccard similarity of their shingles, ``THRESHOLD`` or more.

Only windows that hold at least one shingle of some item are fingerprinted. Any other window has similarity 0
with all items, so nothing is lost by that. All words of all texts are looked at.

Words are runs of letters, digits and underscores without case. Items are taken in blocks of bounded text size, each
block against all documents, so a large benchmark is never sent out whole.

Edge cases: a text shorter than an item is one window; an item with fewer than five words is one shingle; null
or wordless items match nothing, null or empty texts contain nothing; repeated items or rows are reported for each
distinct id; equal similarity takes the first window; null ids are reported as null. Other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 34          # similarity 0.8 is 19.4 bits on average with a deviation of 4.1: beyond 3.5 deviations
BLOCKS = 16
BLOCK_CHARS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_NEAR = [[v for v in range(256) if bin(v ^ x).count("1") <= RADIUS // BLOCKS] for x in range(256)]


def words_of(text: str | None) -> list[str]:
    return list(map(str.lower, WORD.findall(text))) if text else []


def _keys(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of all runs of k ids."""
    n = len(ids) - k + 1
    h = np.zeros(max(0, n), dtype=np.uint64)
    for c in range(k):
        h = h * BASE + ids[c:c + n]
    return h


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    z = h + np.array([salt], dtype=np.uint64) * BASE
    z = (z ^ (z >> np.uint64(30))) * MIX[0]
    z = (z ^ (z >> np.uint64(27))) * MIX[1]
    return z ^ (z >> np.uint64(31))


def sign_bits(keys: np.ndarray) -> np.ndarray:
    """One row of 128 values of 1 and -1 for each shingle."""
    raw = np.stack([_mixed(keys, 1), _mixed(keys, 2)], axis=1).view(np.uint8).reshape(len(keys), 16)
    return np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1


def simhash(keys: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints (16 bytes each) of the windows of ``size`` shingles at ``starts``."""
    sums = np.vstack([np.zeros((1, 128), dtype=np.int32), np.cumsum(sign_bits(keys), axis=0, dtype=np.int32)])
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1)


class Items:
    """Index of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.vocab = {w: n + 1 for n, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.hash = {w: xxhash.xxh64_intdigest(w) for w in self.vocab}
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for n, ws in enumerate(self.words):
            if ws:
                self.by_size[len(ws)].append(n)
        self.shingles: list[Counter] = []
        posts: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for n, ws in enumerate(self.words):
            k = min(SHINGLE, len(ws))
            self.shingles.append(Counter(_keys(self._word_hashes(ws), k).tolist()) if ws else Counter())
            if ws:
                for q, key in enumerate(_keys(np.array([self.vocab[w] for w in ws], dtype=np.uint64), k).tolist()):
                    posts[k][key].add((n, q))
        self.posts = posts
        self.sorted_keys = {k: np.array(sorted(p), dtype=np.uint64) for k, p in posts.items()}
        # multi-index: for each item length, block and block value, the items whose block is near that value
        self.near: dict[int, tuple[list[list[list[int]]], np.ndarray]] = {}
        for size, members in self.by_size.items():
            table = [[[] for _ in range(256)] for _ in range(BLOCKS)]
            prints = np.vstack([simhash(h := _keys(self._word_hashes(self.words[n]), min(SHINGLE, size)), np.array([0]), len(h)) for n in members])
            for at, fp in enumerate(prints):
                for b in range(BLOCKS):
                    for v in _NEAR[fp[b]]:
                        table[b][v].append(at)
            self.near[size] = table, prints

    def _word_hashes(self, ws: list[str]) -> np.ndarray:
        get = self.hash.get
        return np.array([get(w) or xxhash.xxh64_intdigest(w) for w in ws], dtype=np.uint64)

    def starts(self, ws: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Ranges of window starts, for each item length, in which some item's shingle lies."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in ws), dtype=np.uint64, count=len(ws))
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, known in self.sorted_keys.items():
            if len(ids) < k:
                continue
            inside = np.concatenate([[0], np.cumsum(ids > 0)])
            live = np.flatnonzero(inside[k:] - inside[:-k] == k)
            if not len(live):
                continue
            h = np.zeros(len(live), dtype=np.uint64)
            for c in range(k):
                h = h * BASE + ids[live + c]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            for p, key in zip(live[hit].tolist(), h[hit].tolist()):
                for n in {len(self.words[item]) for item, _ in self.posts[k][key]}:
                    last = max(0, len(ws) - n)
                    low, high = max(0, min(last, p - (n - k))), min(last, p)
                    if out[n] and out[n][-1][1] >= low - 1:
                        out[n][-1] = (min(out[n][-1][0], low), max(out[n][-1][1], high))
                    else:
                        out[n].append((low, high))
        return out

    def matches(self, ws: list[str]) -> list[tuple[int, float, int, int]]:
        """(item number, similarity, first word, word after the last) of the best window for each item found."""
        ranges = self.starts(ws)
        if not ranges:
            return []
        hashes = self._word_hashes(ws)
        best: dict[int, tuple[float, int, int]] = {}
        for size, spans in sorted(ranges.items()):
            k = min(SHINGLE, size)
            width = min(size, len(ws))
            if width < k:
                continue
            table, prints = self.near[size]
            members = self.by_size[size]
            for low, high in spans:
                keys = _keys(hashes[low:high + width], k)
                starts = np.arange(high - low + 1)
                found = simhash(keys, starts, width - k + 1)
                seen: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for s, fp in enumerate(found):
                    near = set().union(*(table[b][fp[b]] for b in range(BLOCKS)))
                    if near:
                        at = np.fromiter(near, dtype=np.int64, count=len(near))
                        far = np.bitwise_count(prints[at] ^ fp).sum(axis=1)
                        for a, d in zip(at[far <= RADIUS].tolist(), far[far <= RADIUS].tolist()):
                            seen[a].append((d, s))
                flat = keys.tolist()
                for a, places in seen.items():
                    want = self.shingles[members[a]]
                    for _, s in places:
                        have = Counter(flat[s:s + width - k + 1])
                        shared = sum(min(c, want[x]) for x, c in have.items() if x in want)
                        union = have.total() + want.total() - shared
                        if shared >= THRESHOLD * union:
                            sim = shared / union
                            old = best.get(members[a])
                            if old is None or (-sim, low + s) < (-old[0], old[1]):
                                best[members[a]] = (sim, low + s, low + s + width)
        return [(n, *b) for n, b in sorted(best.items())]


MATCH = "doc_id long, text_hash long, item_id long, similarity double, start_word int, end_word int, start_char int, end_char int"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and benchmark item in it: best window, as words and as characters, and xxhash64 of the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("_item")).where(F.col("_item").isNotNull()).distinct()
    chars = items.agg(F.coalesce(F.sum(F.char_length("_item")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    out = None
    for b in range(blocks):        # each block of about BLOCK_CHARS characters against all documents
        rows = items.where(F.pmod(F.xxhash64("item_id", "_item"), F.lit(blocks)) == b).orderBy("item_id", "_item").collect()
        got = texts.mapInPandas(_finder(spark.sparkContext.broadcast([(r["item_id"], r["_item"]) for r in rows])), MATCH)
        out = got if out is None else out.unionByName(got)
    return out.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct("similarity", "start_word", "end_word", "start_char", "end_char"),
                                                        F.struct("similarity", -F.col("start_word"))).alias("m")).select("doc_id", "text_hash", "item_id", "m.*")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a benchmark item."""
    hit = find(docs, benchmark, text).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left_anti")


def _finder(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Items(shared.value)
        for f in frames:
            rows = []
            for doc_id, th, text in zip(f["doc_id"], f["text_hash"], f["text"]):
                found = index.matches(words_of(text))
                if found:
                    at = [m.span() for m in WORD.finditer(text)]
                    rows += [(doc_id, th, index.ids[n], sim, s, e, at[s][0], at[e - 1][1]) for n, sim, s, e in found]
            out = pd.DataFrame(rows, columns=["doc_id", "text_hash", "item_id", "similarity", "start_word", "end_word", "start_char", "end_char"])
            yield out.astype({"similarity": "float64"})
    return run
