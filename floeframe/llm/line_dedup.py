"""Repeated runs of lines, found by hashes of line windows and winnowed grams; the first copy stays.

A document's lines that are not blank are hashed (white space collapsed). A window is the fewest lines with ``GUARANTEE``
words in all, from a line on or back from a line. Windows with the same lines are joined to their first occurrence (by id,
then position), and every later one loses all of its lines. Any run of lines with ``GUARANTEE`` words that stands in two
places is covered by its own windows, and each of these has its own first occurrence at the earlier place or before; so
all lines of a repeated run go, wherever its parts stand first.

Shorter runs are found by winnowing. From every line a gram starts: the fewest lines with ``NOISE`` words in all. Every
window picks the gram with the least hash in it (of equal ones the last). A picked gram of fewer than ``GUARANTEE`` words
is joined to its first occurrence and extended line by line both ways, and the later place loses the lines of that run.
Nothing below ``NOISE`` words is ever taken.

The first copy of a line is never deleted, since every deleted line has an equal line earlier. A document has at most two
windows and one gram per line, each matched to one place, so a line that stands in a third of all documents costs as many
rows as it has occurrences.

Edge cases: null text stays null and loses nothing; blank lines are neither matched nor deleted; a null id sorts last; rows that
repeat id and text count as one document and get the same result; an empty table gives an empty result; a document may
lose all of its lines (its text is then ''). Other columns, and their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

NOISE = 5
GUARANTEE = 10
LAST = 9223372036854775807


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def line_hashes(text: str) -> tuple[list[int], list[int], list[int]]:
    """Hash, word count and line number of every line that is not blank."""
    hashes, words, numbers = [], [], []
    for i, line in enumerate(text.split("\n")):
        w = line.split()
        if w:
            hashes.append(_signed(xxhash.xxh64_intdigest(" ".join(w))))
            words.append(len(w))
            numbers.append(i)
    return hashes, words, numbers


def _ends(words: list[int], least: int) -> list[int]:
    """End of the fewest lines from each line on that have ``least`` words."""
    out, e, total = [], 0, 0
    for w in words:
        while e < len(words) and total < least:
            total += words[e]
            e += 1
        out.append(e if total >= least else 0)       # 0: too few words up to the end
        total -= w
    return out


def fingerprints(hashes: list[int], words: list[int], noise: int = NOISE, guarantee: int = GUARANTEE) -> list[tuple[int, int, int, bool]]:
    """(hash, position, lines, window) of all windows, and of the grams below ``guarantee`` words that windows pick."""
    n = len(hashes)
    raw = np.array(hashes, dtype=np.int64).tobytes()

    def key(s: int, e: int) -> int:
        return hashes[s] if e == s + 1 else _signed(xxhash.xxh64_intdigest(raw[8 * s:8 * e]))

    gram_end, window_end = _ends(words, noise), _ends(words, guarantee)
    gram = [key(i, e) if e else None for i, e in enumerate(gram_end)]
    picked, windows = set(), set()
    for i, e in enumerate(window_end):
        if e:
            windows.add((i, e))
            picked.add(min((s for s in range(i, e) if gram[s] is not None and gram_end[s] <= e), key=lambda s: (gram[s], -s)))
    for i, e in enumerate(_ends(words[::-1], guarantee)):
        if e:
            windows.add((n - e, n - i))
    # a gram of ``guarantee`` words is a window
    return ([(key(s, e), s, e - s, True) for s, e in sorted(windows)]
            + [(gram[s], s, gram_end[s] - s, False) for s in sorted(picked) if (s, gram_end[s]) not in windows])


SHAPE = "did long, th long, hashes array<long>, numbers array<int>, marks array<struct<key:long,pos:int,size:int,whole:boolean>>"


def _shape(noise: int, guarantee: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 1000):
                rows = []
                for did, th, text in zip(f["did"][i:i + 1000], f["th"][i:i + 1000], f["text"][i:i + 1000]):
                    h, w, at = line_hashes(text)
                    marks = [{"key": k, "pos": p, "size": s, "whole": whole} for k, p, s, whole in fingerprints(h, w, noise, guarantee)]
                    rows.append((did, th, h, at, marks))
                yield pd.DataFrame(rows, columns=["did", "th", "hashes", "numbers", "marks"])
    return run


def _extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Line numbers that the later document loses, for each pair of documents."""
    for f in frames:
        lost = []
        for mine, theirs, numbers, marks in zip(f["hashes"], f["other"], f["numbers"], f["marks"]):
            gone: set[int] = set()
            for m in marks:
                p, q, size = m["pos"], m["fpos"], m["size"]
                a, b = p, q
                while a > 0 and b > 0 and mine[a - 1] == theirs[b - 1]:
                    a, b = a - 1, b - 1
                e, g = p + size, q + size
                while e < len(mine) and g < len(theirs) and mine[e] == theirs[g]:
                    e, g = e + 1, g + 1
                gone.update(range(a, e))
            lost.append([int(numbers[i]) for i in sorted(gone)])
        yield pd.DataFrame({"did": f["did"], "th": f["th"], "lost": lost})


def repeated_lines(docs: DataFrame, scratch: Scratch, text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """did, th (id and text hash of a document) and the line numbers it loses."""
    keyed = (docs.where(F.col(text).isNotNull())
             .select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("th"), F.col(text).alias("text")))
    shaped = scratch.store(keyed.mapInPandas(_shape(noise, guarantee), SHAPE), "lines")
    marks = shaped.select("did", "th", F.explode("marks").alias("m")).select("did", "th", "m.key", "m.pos", "m.size", "m.whole")
    first = (marks.groupBy("key").agg(F.min(F.struct("did", "th", "pos")).alias("f"), F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1).select("key", "f"))
    at = F.struct("did", "th", "pos")
    # a document that is there twice counts once; a window needs no partner, all of its lines go
    later = (marks.join(first, "key").where(at > F.col("f"))
             .select("did", "th", "pos", "size", *[F.when(~F.col("whole"), F.col(f"f.{c}")).alias(f"f{c}") for c in ("did", "th", "pos")]).distinct())
    later = scratch.store(later, "later")
    lines = shaped.select("did", "th", "hashes", "numbers").dropDuplicates(["did", "th"])
    windows = later.where(F.col("fdid").isNull()).groupBy("did", "th").agg(F.collect_list(F.struct("pos", "size")).alias("marks"))
    whole = windows.join(lines.select("did", "th", "numbers"), ["did", "th"]).select(
        "did", "th", F.array_distinct(F.flatten(F.transform("marks", lambda m: F.slice("numbers", m["pos"] + 1, m["size"])))).alias("lost"))
    pairs = (later.where(F.col("fdid").isNotNull()).groupBy("did", "th", "fdid", "fth")
             .agg(F.collect_list(F.struct("pos", "fpos", "size")).alias("marks")))
    theirs = lines.select(F.col("did").alias("fdid"), F.col("th").alias("fth"), F.col("hashes").alias("other"))
    both = pairs.join(lines, ["did", "th"]).join(theirs, ["fdid", "fth"])
    found = both.select("did", "th", "hashes", "numbers", "other", "marks").mapInPandas(_extend, "did long, th long, lost array<int>").unionByName(whole)
    return found.groupBy("did", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lost")))).alias("lost"))


def dedup(docs: DataFrame, text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """``docs`` with repeated runs taken out of the text; ``n_lines`` and ``deleted_lines`` (0-based) say what went."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lost = scratch.store(repeated_lines(docs, scratch, text, noise, guarantee), "lost").select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("lost").alias("_lost"))
    joined = docs.join(lost, (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("_did")) & (F.xxhash64(text) == F.col("_th")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_lost"), i)), "\n")
    cleaned = F.when(F.col("_lost").isNull(), F.col(text)).when(F.trim(F.regexp_replace(kept, r"\s+", " ")) == "", F.lit("")).otherwise(kept)
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines))
    return (joined.withColumn("n_lines", n).withColumn("deleted_lines", F.coalesce("_lost", F.array().cast("array<int>")))
            .withColumn(text, cleaned).drop("_did", "_th", "_lost"))
