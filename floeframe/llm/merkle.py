"""Merkle manifest of a dataset, its nodes stored in van Emde Boas order.

Each row is a leaf: the SHA-256 of its fields. Leaves of one language ascend by id; every 8 consecutive nodes become one
node until a single one remains, the language's subroot. Subroots ordered by language become the root in the same way.

Storage. A tree is cut into aligned subtrees (blocks) of up to ``BLOCK_HEIGHT`` hash steps, built from the leaves up:
one group of at most 8**BLOCK_HEIGHT rows makes one block, and the blocks' roots are the leaves of the next round, so that
the rounds are as few as the height by ``BLOCK_HEIGHT``. A block keeps its 32-byte digests in one value in van Emde Boas
order: a tree of h levels is stored as its upper half of levels followed by the subtrees that hang below, each laid out
by the same rule. ``addresses`` gives the places by arithmetic alone; building writes through it and proofs read through
it. Blocks are Parquet in the shared folder.

Proofs go down from the root: a block's children get the siblings found in the block, followed by what the block itself
has inherited. Blocks cut positions, not keys, so a language with any share of the rows is spread evenly.

Edge cases: a null field is ``-``; a null language is a tree of its own and comes first; null ids come first within a
language; rows that repeat an id are ordered by their leaf, and equal rows are leaves like others; an empty text is
``0:``; an empty table has no blocks and gives no rows; columns beside doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BITS = 3                 # 8 children a node
ARITY = 1 << BITS
BLOCK_HEIGHT = 3         # hash steps in one block: at most 512 leaves and 585 nodes
MOST_HEIGHT = 21         # 8**21 exceeds any row number
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """Hex digest of the fields, each with its length in bytes, so that no two rows run together alike."""
    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[told(c) for c in fields]).cast("binary"), 256)


def tree_height(n: Column) -> Column:
    """Hash steps from ``n`` leaves to one node."""
    return sum((F.when(n > (1 << BITS * k), 1).otherwise(0) for k in range(MOST_HEIGHT)), F.lit(0)).cast("int")


def nodes_in(levels: int) -> int:
    return ((1 << BITS * levels) - 1) // (ARITY - 1)


@cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Per depth, from the root, the address of every node of a full tree in van Emde Boas order."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    top = levels // 2
    upper, lower = addresses(top), addresses(levels - top)
    below = []
    for depth, places in enumerate(lower):
        i = np.arange(1 << BITS * (top + depth))
        below.append(nodes_in(top) + (i >> BITS * depth) * nodes_in(levels - top) + places[i & ((1 << BITS * depth) - 1)])
    return upper + tuple(below)


def _digest(hexes: str) -> str:
    return hashlib.sha256(hexes.encode()).hexdigest()


def build_block(digests: list[str], height: int) -> bytes:
    """The block over up to 8**height leaf digests; nodes beyond the last leaf stay zero."""
    places = addresses(height + 1)
    out = np.zeros((nodes_in(height + 1), 32), dtype=np.uint8)
    for depth in range(height, -1, -1):
        out[places[depth][:len(digests)]] = np.frombuffer(bytes.fromhex("".join(digests)), dtype=np.uint8).reshape(-1, 32)
        if depth:
            digests = [_digest("".join(digests[i:i + ARITY])) for i in range(0, len(digests), ARITY)]
    return out.tobytes()


def block_siblings(block: bytes, height: int, n: int, local: list[int]) -> list[bytes]:
    """For each leaf number in ``local``, its siblings up to the block's root, level by level, left to right."""
    nodes = np.frombuffer(block, dtype=np.uint8).reshape(-1, 32)
    levels = []
    for depth in range(height, 0, -1):
        there = -(-n >> BITS * (height - depth))                # nodes on this level, rounded up
        levels.append(nodes[addresses(height + 1)[depth][:there]].tobytes())
    out = []
    for i in local:
        parts = []
        for level in levels:
            start, at = (i & -ARITY) * 32, i * 32
            parts += (level[start:at], level[at + 32:start + ARITY * 32])
            i >>= BITS
        out.append(b"".join(parts))
    return out


def fold(digest: str, places: list[tuple[int, int]], proof: bytes) -> str:
    """The root that ``digest`` and its siblings lead to. ``places``: (position, number of leaves) in each tree, lowest first."""
    told, at = proof.hex(), 0
    for i, n in places:
        while n > 1:
            before = i % ARITY
            others = min(ARITY, n - (i - before)) - 1
            mid, end = at + 64 * before, at + 64 * others
            digest = _digest(told[at:mid] + digest + told[mid:end])
            i, n, at = i >> BITS, -(-n >> BITS), end
    return digest


# --- blocks ------------------------------------------------------------------------------------------------

BLOCKS = "tree string, block long, height int, steps int, n int, nodes binary"


def _with_blocks(nodes: DataFrame) -> DataFrame:
    steps = F.least("height", F.lit(BLOCK_HEIGHT))
    return nodes.withColumn("steps", steps).withColumn("block", F.call_function("shiftright", F.col("pos"), (steps * BITS).cast("int")))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    height, steps = int(rows["height"].iat[0]), int(rows["steps"].iat[0])
    return pd.DataFrame([(key[0], key[1], height, steps, len(rows), build_block(rows["digest"].tolist(), steps))],
                        columns=["tree", "block", "height", "steps", "n", "nodes"])


def build(nodes: DataFrame, highest: int, scratch: Scratch) -> list[DataFrame]:
    """Blocks of all trees, lowest round first. ``nodes``: tree, pos, height (hash steps to the tree's root), digest."""
    rounds = []
    for _ in range(-(-highest // BLOCK_HEIGHT)):
        cut = _with_blocks(nodes.where(F.col("height") > 0)).select("tree", "pos", "height", "steps", "block", "digest")
        blocks = scratch.store(cut.groupBy("tree", "block").applyInPandas(_build, BLOCKS), "blocks")
        rounds.append(blocks)
        nodes = blocks.select("tree", F.col("block").alias("pos"), (F.col("height") - F.col("steps")).alias("height"),
                              F.lower(F.hex(F.substring("nodes", 1, 32))).alias("digest"))
    return rounds


def tree_roots(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """tree, digest: the root of each tree; a lone leaf is its tree's root."""
    out = nodes.where(F.col("height") == 0).select("tree", "digest")
    for blocks in rounds:
        out = out.unionByName(blocks.where(F.col("height") == F.col("steps"))
                              .select("tree", F.lower(F.hex(F.substring("nodes", 1, 32))).alias("digest")))
    return out


def _prove(key: tuple, rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    mask = (1 << BITS * int(block["steps"].iat[0])) - 1
    found = block_siblings(block["nodes"].iat[0], int(block["steps"].iat[0]), int(block["n"].iat[0]), [int(p) & mask for p in rows["pos"]])
    above = block["above"].iat[0]
    return rows.drop(columns="block").assign(proof=[x + above for x in found])


def proofs(nodes: DataFrame, rounds: list[DataFrame], seeds: DataFrame, carry: list[str]) -> DataFrame:
    """tree, pos, the columns to carry, and proof: siblings from each node up to the seed.

    ``seeds``: tree, above (what follows the tree's own siblings).
    """
    levels = [nodes.select("tree", "pos", "height", *carry)]
    levels += [b.select("tree", F.col("block").alias("pos"), (F.col("height") - F.col("steps")).alias("height")) for b in rounds]
    found = inherited = None                                    # ``inherited``: the blocks in which a level's nodes hang
    for blocks, level in zip([None, *rounds][::-1], levels[::-1]):
        kept = [c for c in level.columns if c != "height"]
        found = level.where(F.col("height") == 0).join(seeds, "tree").select(*kept, F.col("above").alias("proof"))
        if inherited is not None:
            cut = _with_blocks(level.where(F.col("height") > 0)).select("block", *kept)
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in level.select(*kept).schema) + ", proof binary"
            found = found.unionByName(cut.groupBy("tree", "block").cogroup(inherited.groupBy("tree", "block")).applyInPandas(_prove, schema))
        if blocks is not None:
            inherited = (blocks.join(found.select("tree", F.col("pos").alias("block"), F.col("proof").alias("above")), ["tree", "block"])
                         .select("tree", "block", "steps", "n", "nodes", "above"))
    return found


# --- the manifest of a documents table ---------------------------------------------------------------------

def positions(rows: DataFrame, key: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with pos (0-based within key) and n (rows of the key): one range sort and a small table of offsets."""
    ties = F.monotonically_increasing_id()                      # equal rows may part anywhere, so that they need not share a task
    placed = rows.withColumn("_tie", ties).orderBy(key, *order, "_tie").withColumn("_mid", F.monotonically_increasing_id()).drop("_tie")
    placed = (scratch.store(placed, "sorted").withColumn("_slice", F.shiftright("_mid", 33))
              .withColumn("_at", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid"))
    # one row per key and slice of the sort: at most as many as keys and slices together
    slices = placed.groupBy(key, "_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(key, "_slice", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_rows").over(whole).alias("n"))
    return (placed.join(slices, [key, "_slice"]).withColumn("pos", F.col("_at") + F.col("_shift"))
            .drop("_slice", "_at", "_shift"))


def manifest(docs: DataFrame, scratch: Scratch, changed: Column | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """Leaves and blocks of all languages, subroots and blocks of the tree above them.

    Leaves: tree, doc_id, digest, altered (the digest with ``changed`` in place of text), pos, n, height.
    """
    fields = [F.col(c) for c in FIELDS]
    altered = leaf(fields) if changed is None else leaf([*fields[:-1], changed])
    tree = F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n"))  # null first, then by bytes
    rows = scratch.store(docs.select("doc_id", tree.alias("tree"), leaf(fields).alias("digest"), altered.alias("altered")), "leaves")
    leaves = positions(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], scratch)
    leaves = scratch.store(leaves.withColumn("height", tree_height(F.col("n"))), "placed")
    rounds = build(leaves, leaves.agg(F.max("height")).first()[0] or 0, scratch)
    subroots = tree_roots(leaves, rounds).withColumnRenamed("tree", "lang").withColumn("tree", F.lit("root"))
    subroots = positions(subroots, "tree", [F.col("lang")], scratch).withColumn("height", tree_height(F.col("n")))
    subroots = scratch.store(subroots, "subroots")
    upper = build(subroots, subroots.agg(F.max("height")).first()[0] or 0, scratch)
    return leaves, rounds, subroots, upper


def prove_all(docs: DataFrame, scratch: Scratch, changed: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, altered, subroot, root, proof (sibling digests as bytes), pos, n, tree_pos, n_trees."""
    leaves, rounds, subroots, upper = manifest(docs, scratch, changed)
    root = tree_roots(subroots, upper).first()                  # a single row, or none for an empty table
    top = proofs(subroots, upper, docs.sparkSession.createDataFrame([("root", b"")], "tree string, above binary"), ["lang", "digest", "n"])
    # one row per language
    trees = top.select(F.col("lang").alias("tree"), F.col("proof").alias("above"), F.col("digest").alias("subroot"),
                       F.lit(root and root["digest"]).alias("root"), F.col("pos").alias("tree_pos"), F.col("n").alias("n_trees"))
    trees = scratch.store(trees, "trees")
    # a language's row meets its leaves range by range of positions, so that a hot language is dealt out
    part = F.call_function("shiftright", F.col("pos"), F.lit(8)).alias("_part")
    parts = leaves.select("tree", part).distinct().join(trees.drop("above"), "tree")
    leaves = leaves.select("*", part).join(parts, ["tree", "_part"])
    carry = ["doc_id", "digest", "altered", "subroot", "root", "n", "tree_pos", "n_trees"]
    return proofs(leaves, rounds, trees.select("tree", "above"), carry).withColumnRenamed("digest", "leaf").drop("tree")


def folded(digest: Column | str, pos: Column | str, n: Column | str, tree_pos: Column | str, n_trees: Column | str, proof: Column | str) -> Column:
    """Root recomputed from a leaf digest, its place in both trees, and its proof."""
    @F.pandas_udf("string")
    def run(digest: pd.Series, pos: pd.Series, n: pd.Series, tree_pos: pd.Series, n_trees: pd.Series, proof: pd.Series) -> pd.Series:
        return pd.Series([fold(d, [(p, m), (q, k)], bytes(w)) for d, p, m, q, k, w in zip(digest, pos, n, tree_pos, n_trees, proof)], dtype=object)
    return run(digest, pos, n, tree_pos, n_trees, proof)
