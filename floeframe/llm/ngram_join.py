"""N-gram Jaccard join with adaptive multi-match prefixes, down to groups of near-duplicates.

A document's set is its distinct word n-grams. Two documents link when ``den * |A & B| >= num * |A | B|``. The result is
the connected components of all links, one row per document.

1. Documents with the same set form a class, and only one document of a class goes on: copies cost nothing further.
2. All sets are sorted in one global order. First come the grams whose hash lies below a fixed share of the range, the
   rarest first; then the rest by hash. Only the first part and the few grams that prefixes need beyond it are counted
   and moved, in ``PARTS`` shares, one after the other. Grams that stand in one document alone hold places in its order but are never joined.
3. If two sets link, then the first ``l`` grams that they share lie in both prefixes, for every ``l``: the prefix of the
   smaller set has ``n - ceil(2 num n / (num + den)) + l`` grams and that of the larger ``n - ceil(num n / den) + l``.
   Each document takes the ``l`` (1 to ``MOST``) with the least estimated cost: postings read, and candidates that can
   have ``l`` matches, from the grams' document counts. A pair needs as many shared prefix grams as the smaller ``l``.
4. Candidates are verified on their whole texts. Only components are wanted, so all documents with a prefix gram are first
   compared with one of them, the centre: the one with the fewest grams of its own, and for larger groups then once more
   with the one closest to what most of the group has. Let D(x) be the grams in which x and its centre differ. If x and y
   link and do not both link to the centre, then D(x) and D(y) share at least ``(|D(x)| + |D(y)| - k) / 2`` grams and at least
   one, where k is the largest difference of linking sets of their sizes. So they share one of the first
   ``(den - num) n / num + 1`` grams of D in any common order, with enough grams left after it. The order here puts what
   sets the centre apart from most of its group last, and the rest by class of hash and then the rarest first.
   D(x) and D(y) differ in what x and y differ in, so a bit of parity for each of ``BITS`` residues of the hashes in D bounds
   that number from below: where x and y have unlike parities, they differ in a gram. Pairs that have such a gram, lie in
   different components and have no more unlike parities than linking sets may differ in are formed; those that also share
   enough prefix grams are verified. Every candidate is verified or already connected: no link is lost. Sets of far
   more grams than ``BITS`` have about half their parities unlike, which is then too few to rule a pair out: the later tests decide.

Edge cases: null or wordless texts have an empty set and are components of their own; texts with fewer words than a gram are one
gram; a null id belongs to the component of its class and never names one (the component is null if all ids are); rows
that repeat an id are one node; the component is the smallest id in it, so ties do not arise. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MOST = 4             # the longest prefix extension
SPARE = 1.5          # share of the hash range that is ordered by rarity, in longest prefixes
VERIFY = 8.0         # cost of verifying a candidate, in postings read
BITS = 1024          # parities of a document's differences: 16 longs
GROUP = 8            # documents of one centre from which a second centre is looked for
CLASSES = np.array([2 ** (64 - i) for i in range(10, 0, -1)], dtype=np.uint64)      # upper ends of hash classes
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    """Word hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def split(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def gram_hashes(words: list[bytes], size: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word grams; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=len(words))], dtype=np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for c in range(size):
        h = (h ^ (h >> np.uint64(29))) * P1 + w[c:c + n] * P2
    h = (h ^ (h >> np.uint64(31))) * P3
    h ^= h >> np.uint64(30)
    return np.unique(h)


def gram_set(words: list[bytes], size: int) -> set[bytes]:
    """The grams themselves, for verification. Words hold no white space, so joined grams are unambiguous."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def prefix_lengths(n: int, l: int, num: int, den: int) -> tuple[int, int]:  # noqa: E741
    """Lengths of the l-prefix of a set of n grams as the smaller and as the larger of a pair."""
    short = n + (-2 * num * n // (num + den)) + l
    long = n + (-num * n // den) + l
    return min(n, short), min(n, long)


def choose(n: int, tier: int, shared: list[tuple[int, int, int]], num: int, den: int) -> tuple[int, list[tuple[int, bool]]]:
    """The cheapest l, and its prefix in order, as (gram, in the short prefix too).

    ``shared`` holds (place in hash order, gram, documents) of the grams that other documents have too; ``tier`` grams
    of the set are ordered by rarity.
    """
    rare = sorted((docs, g & 0xFFFFFFFFFFFFFFFF, g) for i, g, docs in shared if i < tier)
    alone = tier - len(rare)                       # grams that no other document has come first
    order = [(alone + r, g, docs) for r, (docs, _, g) in enumerate(rare)] + sorted((i, g, docs) for i, g, docs in shared if i >= tier)
    best = None
    for l in range(1, MOST + 1):  # noqa: E741
        short, long = prefix_lengths(n, l, num, den)
        head = [x for x in order if x[0] < long]
        read = sum(docs for _, _, docs in head)
        cost = read + VERIFY * read / l            # at most read / l documents can have l matches
        if best is None or cost < best[0]:
            best = (cost, l, [(g, at < short) for at, g, _ in head])
        if long == n or len(head) < l:             # fewer than l grams can match: nothing can link
            if len(head) < l:
                best = (0.0, l, [])
            break
    return best[1], best[2]


SETS = "did long, n int, digest binary, tier int, grams array<long>"


def _sets(size: int, num: int, den: int):
    edge = np.uint64(int(min(0.9, SPARE * (1 - num / den)) * 2.0 ** 64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for f in frames:
            for i in range(0, len(f), 2000):
                rows = []
                for did, text in zip(f["did"].iloc[i:i + 2000], f["text"].iloc[i:i + 2000]):
                    h = gram_hashes(split(text), size, cache)
                    tier = int(np.searchsorted(h, edge))
                    keep = max(tier, prefix_lengths(len(h), MOST, num, den)[1])
                    rows.append((did, len(h), xxhash.xxh3_128_digest(h.tobytes()), tier, h[:keep].view(np.int64)))
                    if len(cache) > 500_000:
                        cache.clear()
                out = pd.DataFrame(rows, columns=["did", "n", "digest", "tier", "grams"])
                yield out.astype({"n": "int32", "tier": "int32"})
    return run


HELD = 50_000            # grams or differences that a task hands on at once
HEADS = "node long, n int, l int, rare double, short int, long array<long>"      # the first ``short`` of the grams are the short prefix


def _heads(num: int, den: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["node", "n", "l", "rare", "short", "long"]).astype({"node": "int64", "n": "int32", "l": "int32", "rare": "float64", "short": "int32"})

        for f in frames:
            rows, held = [], 0
            for node, n, tier, *shared in zip(f["node"], f["n"], f["tier"], f["i"], f["gram"], f["docs"]):
                grams = list(zip(*(x.tolist() for x in shared)))
                l, head = choose(n, tier, grams, num, den)  # noqa: E741
                if head:
                    alone = 1.0 - sum(1 for i, _, _ in grams if i < tier) / max(1, tier)
                    rows.append((node, n, l, alone, sum(short for _, short in head), [g for g, _ in head]))
                    held += len(head)
                if held >= HELD:
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)
    return run


def _squeeze(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=1)
    for f in frames:
        yield pd.DataFrame({"node": f["node"], "body": [pack.compress(t.encode("utf-8", "replace")) for t in f["text"]]})


PARTS = 4            # shares in which grams and differences are counted, so that only one share is shuffled at a time
MEASURED = "g long, a long, b long, m int, linked boolean, n int, size int, h array<long>, ends array<int>, bits array<long>"


def _measure(size: int, num: int, den: int, differences: bool):
    """Whether a and b link; the number of grams in which they differ, and of these as hashes what a's key may need.

    Hashes ``h`` come in classes of halving share of the range, the smallest class first; whole classes are given until there
    are half as many again as the longest prefix has. Those ``aside`` come after all others. ``ends`` has where each class ends;
    ``m``, the size of the pair's group, is handed on if it is given.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()

        def grams(body: bytes) -> set[bytes]:
            return gram_set(unpack.decompress(body).lower().split(), size)

        def first(apart: set[bytes], most: int, aside: np.ndarray) -> tuple[np.ndarray, ...]:
            h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, apart), dtype=np.uint64, count=len(apart)))
            odd = np.bincount((h % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2
            t = np.searchsorted(CLASSES, h, side="right")
            late = np.isin(h.view(np.int64), aside)
            t[late] += len(CLASSES) + 1
            if np.count_nonzero(~late) > most:
                take = t <= t[~late][most - 1]
                h, t = h[take], t[take]
            ends = np.cumsum(np.bincount(t, minlength=2 * len(CLASSES) + 2))
            return h.view(np.int64)[np.argsort(t, kind="stable")], ends.astype(np.int32), np.packbits(odd.astype(np.uint8)).view(np.int64)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return (pd.DataFrame(rows, columns=["g", "a", "b", "m", "linked", "n", "size", "h", "ends", "bits"])
                    .astype({"g": "int64", "a": "int64", "b": "int64", "m": "int32", "linked": bool, "n": "int32", "size": "int32"}))

        none = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

        last, kept = None, set()
        for f in frames:
            rows, held = [], 0
            of = f["m"] if "m" in f else [0] * len(f)
            for g, a, b, m, mine, theirs, aside in zip(f["g"], f["a"], f["b"], of, f["body_a"], f["body_b"], f["aside"]):
                if theirs != last:                  # rows come sorted by b, so its set is made once
                    last, kept = theirs, grams(theirs)
                other = grams(mine)
                both = len(other & kept)
                linked = den * both >= num * (len(other) + len(kept) - both)
                apart = first(other ^ kept, 3 * ((den - num) * len(other) // num + 1) // 2, aside) if differences else none
                rows.append((g, a, b, m, linked, len(other), len(other) + len(kept) - 2 * both, *apart))
                held += len(apart[0])
                if held >= HELD:
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)
    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp: the smallest node that links reach. Least labels spread along links and then along labels."""
    both = scratch.store(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        step = labels.join(near, "node").select("node", F.least("comp", "least").alias("to"), "comp")
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        new = scratch.store(step.join(jump, "to").select("node", F.least("to", "further").alias("comp"), (F.least("to", "further") < F.col("comp")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            scratch.drop(both)
            return labels.select("node", "comp")


def join(docs: DataFrame, text: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    texts = docs.select(F.col("doc_id").cast("long").alias("did"), F.col(text).alias("text"))
    sets = scratch.store(texts.mapInPandas(_sets(size, num, den), SETS), "sets")
    classes = scratch.store(sets.where("n > 0").groupBy("digest").agg(
        F.min("did").alias("node"), F.first("n").alias("n"), F.first("tier").alias("tier"), F.first("grams").alias("grams")), "classes")
    reps = classes.where(F.col("node").isNotNull())

    slim = scratch.store(sets.select("did", "n", "digest"), "slim")       # all that the result needs of it
    scratch.drop(sets)

    # grams that at least two classes have, back with their documents, in the cheapest prefix for each
    parts = []
    for part in range(PARTS):
        held = reps.select("node", F.posexplode("grams").alias("i", "gram")).where(F.pmod("gram", F.lit(PARTS)) == part)
        counted = held.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("docs")).where("docs > 1")
        parts.append(scratch.store(held.join(counted, "gram").select("node", "i", "gram", "docs"), "shared"))
        scratch.drop()
    shared = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.collect_list(F.struct("i", "gram", "docs")).alias("shared"))
    shared = (shared.join(reps.select("node", "n", "tier"), "node")
              .select("node", "n", "tier", *[F.col(f"shared.{c}").alias(c) for c in ("i", "gram", "docs")]))
    heads = scratch.store(shared.mapInPandas(_heads(num, den), HEADS), "heads")
    named = scratch.store(classes.select("digest", "node"), "named")
    scratch.drop(classes, *parts)
    placed = heads.select("node", "rare", "short", F.posexplode("long").alias("at", "key")).withColumn("short", F.col("at") < F.col("short")).drop("at")
    # a gram matters where two documents hold it, one of them in its short prefix
    live = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("short").alias("any_short")).where("c > 1 and any_short").select("key")
    buckets = scratch.store(placed.drop("short").join(live, "key"), "buckets")
    needed = buckets.select("node").distinct()
    bodies = scratch.store(texts.where(F.col("text").isNotNull() & F.col("did").isNotNull()).select(F.col("did").alias("node"), "text")
                           .mapInPandas(_squeeze, "node long, body binary").join(needed, "node"), "bodies")

    def measured(pairs: DataFrame, differences: bool) -> DataFrame:
        full = (pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
                .join(bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b"))
        return full.select("g", "a", "b", "m", "body_a", "body_b", "aside").mapInPandas(_measure(size, num, den, differences), MEASURED)

    nothing = F.array().cast("array<bigint>")

    # a group is named after its first centre
    centres = buckets.groupBy("key").agg(F.min(F.struct("rare", "node")).alias("c")).select("key", F.col("c.node").alias("b"))
    stars = scratch.store(buckets.join(centres, "key").where("node <> b").select(F.col("b").alias("g"), F.col("node").alias("a"), "b").distinct(), "stars")
    scratch.drop(buckets)
    filled = stars.groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("m"))
    once = scratch.store(measured(stars.join(filled, "g").withColumn("aside", nothing), True), "compared")
    scratch.drop()
    # larger groups: the document that has most of what is common among the differences, and least else, is the better centre
    members, large = filled.where(F.col("m") >= GROUP), once.where(F.col("m") >= GROUP)
    common = large.select("g", "m", F.explode("h").alias("h")).groupBy("g", "m", "h").agg(F.count(F.lit(1)).alias("docs")).where("docs * 2 > m")
    usual = members.join(common.groupBy("g").agg(F.collect_list("h").alias("usual")), "g", "left")      # as many as a set has differences
    usual = scratch.store(usual.select("g", F.coalesce("usual", nothing).alias("usual")), "usual")
    scratch.drop()
    off = (large.select("g", F.col("a").alias("node"), "h").join(usual, "g")
           .select("g", "node", (F.size("h") + F.size("usual") - 2 * F.size(F.array_intersect("h", "usual"))).alias("off"))
           .unionByName(usual.select("g", F.col("g").alias("node"), F.size("usual").alias("off"))))
    better = scratch.store(off.groupBy("g").agg(F.min(F.struct("off", "node")).alias("c")).select("g", F.col("c.node").alias("to")), "better")
    own = better.join(large.select("g", F.col("a").alias("to"), F.col("h").alias("own")), ["g", "to"], "left").join(usual, "g")
    own = (own.withColumn("own", F.coalesce("own", nothing))
           .select("g", F.col("to").alias("b"), F.concat(F.array_except("usual", "own"), F.array_except("own", "usual")).alias("aside")))
    better = scratch.store(own, "better")
    scratch.drop(usual)
    stars = large.select("g", "a", "m").unionByName(members.select("g", F.col("g").alias("a"), "m")).join(better, "g").where("a <> b")
    again = scratch.store(measured(stars.select("g", "a", "b", "m", "aside"), True), "compared")
    scratch.drop()
    links = once.unionByName(again).where("linked").select("a", "b")
    comps = components(links, scratch)

    # every group by the centre it ended with, if parts of it are still apart
    last = once.where(F.col("m") < GROUP).unionByName(again)
    final = (last.select("g", "a", "b", "n", "size", "ends").join(comps.withColumnRenamed("node", "a"), "a", "left")
             .withColumn("comp", F.coalesce("comp", "a")).join(comps.select(F.col("node").alias("b"), F.col("comp").alias("hub")), "b", "left")
             .withColumn("hub", F.coalesce("hub", "b")))
    torn = (final.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min(F.least("comp", "hub")).alias("low"), F.max(F.greatest("comp", "hub")).alias("high"))
            .where("m > 1 and low < high").select("g"))
    odd = scratch.store(final.join(torn, "g").select("g", F.col("a").alias("node"), "n", "size", "comp", "ends"), "odd")
    # the documents are dealt out by what sets them apart; places in the order count also what no other document shares
    rows = (last.join(odd.select("g").distinct(), "g", "left_semi").select("g", F.col("a").alias("node"), F.posexplode("h").alias("pos", "h"))
            .select("g", "node", "pos", F.xxhash64("g", "h").alias("key")))
    parts = []
    for part in range(PARTS):
        some = rows.where(F.pmod("key", F.lit(PARTS)) == part)
        counted = some.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("docs")).where("docs > 1")     # documents of a group share it
        parts.append(scratch.store(some.join(counted, "key"), "met"))
        scratch.drop()
    inside = Window.partitionBy("g", "node", "t")
    keyed = (reduce(DataFrame.unionByName, parts).join(odd, ["g", "node"])
             .withColumn("t", F.size(F.filter("ends", lambda e: e <= F.col("pos"))))              # its class: within one, positions follow the hashes
             .withColumn("at", F.col("ends")[F.col("t")] - F.count(F.lit(1)).over(inside) + F.row_number().over(inside.orderBy("docs", "pos")) - 1)
             .where(F.col("at") <= F.expr(f"({den} - {num}) * n div {num}")).select("g", "key", "node", "n", "size", "at", "comp"))
    keyed = placed = scratch.store(keyed, "placed")
    held = keyed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = (held.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
             .where("comps > 1").drop("comps"))
    scratch.drop(odd, *parts)
    parities = last.select("g", F.col("a").alias("node"), *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)])
    keyed = scratch.store(keyed.join(mixed, "key").join(parities, ["g", "node"]), "keyed")
    scratch.drop(placed)

    # what shares a key and is still apart: all but a key's largest component, against all that have the key
    x, y = keyed.where(F.col("comp") != F.col("main")).alias("x"), keyed.alias("y")
    single = (F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    sizes = den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")
    most = f"({den} - {num}) * (x.n + y.n) div ({den} + {num})"              # grams in which linking sets may differ
    enough = F.expr(f"2 * least(x.size - x.at, y.size - y.at) >= x.size + y.size - {most}")
    close = F.expr(" + ".join(f"bit_count(x.bits{i} ^ y.bits{i})" for i in range(BITS // 64)) + f" <= {most}")
    near = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & single & sizes & enough & close)
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    near = scratch.store(near, "near")
    # prefixes as 32-bit hashes; ``twice`` is how many of a prefix's grams may hide behind others that have the same one
    prefixes = heads.select("node", "n", "l", "short", F.transform("long", lambda g: F.hash(g)).alias("long"))
    prefixes = prefixes.withColumn("twice", F.size("long") - F.size(F.array_distinct("long")))
    prefixes = scratch.store(prefixes.join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "prefixes")
    prefix = lambda one, other: F.when(F.col(f"{one}.n") <= F.col(f"{other}.n"), F.slice(f"{one}.long", 1, F.col(f"{one}.short"))).otherwise(F.col(f"{one}.long"))
    common = F.size(F.array_intersect(prefix("x", "y"), prefix("y", "x"))) + F.col("x.twice")
    rest = (near.join(prefixes.alias("x"), F.col("a") == F.col("x.node")).join(prefixes.alias("y"), F.col("b") == F.col("y.node"))
            .where(common >= F.least("x.l", "y.l")).select("a", "b"))
    rest = rest.select(F.lit(0).cast("long").alias("g"), "a", "b", F.lit(0).alias("m"), nothing.alias("aside"))
    more = scratch.store(measured(rest, False).where("linked").select("a", "b"), "links")
    scratch.drop(keyed, near, prefixes, bodies)
    if more.limit(1).count():
        comps = components(links.unionByName(more), scratch)
    named = named.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id"))
    out = slim.select(F.col("did").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
