"""Exact duplicates through an extendible-hash index on shared files, with DataFrame functions only.

Texts are equal when they are identical after deleting all white space. The 64-bit hash of the normalised text is the
key. A directory over the leading bits of the key starts with one bucket and doubles: a bucket with more than
``capacity`` keys splits by one more bit until it fits or the directory's depth is used up. The directory is computed
from counted keys, so copies never split a bucket.

Owner tasks take whole buckets, that is ranges of keys. A key with more than ``capacity`` rows is dealt out to several
owners by a salt, and what they found is merged afterwards, so no task holds a hot group. Within a bucket rows chain
under their key, and only rows with the same bytes share an entry: different texts with one hash stay apart.

The index is Parquet in the shared folder: bucket, local depth, key, bytes, and the entry's members in bounded lists.

Edge cases: a null text counts as empty, and all empty texts are equal; null ids sort after all others when ties are
broken, and repeated rows are members like others; an empty table gives an empty index; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
MOST_BITS = 20       # the directory has at most 2**20 slots


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, bits: int) -> DataFrame:
    """Slots of the deepest directory with the bucket that each belongs to: slot, local_depth, bucket.

    ``keys`` has one row per distinct key. A bucket is the widest prefix of a slot that holds at most ``capacity`` keys.
    """
    fine = keys.groupBy(_slot(F.col("key"), bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    per_depth = fine.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    per_depth = per_depth.withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    full = (per_depth.groupBy("depth", "prefix").agg(F.sum("n").alias("held")))
    fits = (per_depth.join(full, ["depth", "prefix"]).where((F.col("held") <= capacity) | (F.col("depth") == bits))
            .groupBy("slot").agg(F.min("depth").alias("local_depth")))
    # a bucket's number carries its depth, so that prefixes of different lengths differ
    return fits.withColumn("bucket", F.expr(f"shiftleft(1L, local_depth) + shiftright(slot, {bits} - local_depth)"))


def build(docs: DataFrame, scratch: Scratch, capacity: int | None = None, text: str = "text") -> DataFrame:
    """The index: bucket, local_depth, key, salt, body (the bytes), members (doc_id, n_chars)."""
    spark = docs.sparkSession
    body = normalised(F.col(text))
    keyed = docs.select("doc_id", F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), body.alias("body"))
    keyed = keyed.withColumn("key", F.xxhash64("body"))
    keys = scratch.store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "keys")
    n_keys, n_rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    capacity = capacity or max(256, n_rows // 100_000)
    bits = min(MOST_BITS, max(0, (n_keys // capacity).bit_length() + 3)) if n_keys > capacity else 0
    slots = scratch.store(directory(keys, capacity, bits).coalesce(1), "directory")
    # Both tables below are bounded: at most 2**MOST_BITS slots, and at most n_rows / capacity <= 100,000 hot keys.
    hot = F.broadcast(keys.where(F.col("rows") > capacity)
                      .select("key", F.ceil(F.col("rows") / capacity).cast("int").alias("_ways")))
    owned = (keyed.withColumn("slot", _slot(F.col("key"), bits)).join(F.broadcast(slots), "slot").join(hot, "key", "left")
             .withColumn("salt", F.when(F.col("_ways").isNotNull(), F.pmod(F.xxhash64("doc_id", "n_chars"), F.col("_ways"))).otherwise(0)
                         .cast("int")))
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = (owned.repartition(owners, "bucket", "salt")
               .groupBy("bucket", "salt", "local_depth", "key", "body")
               .agg(F.collect_list(F.struct("doc_id", "n_chars")).alias("members"), F.first(F.col("_ways").isNotNull()).alias("spread")))
    index = entries.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    index = scratch.store(index, "index")
    scratch.drop(keys)
    return index


def resolve(index: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    most = F.array_sort("members", lambda a, b: F.when(a["n_chars"] != b["n_chars"], F.when(a["n_chars"] > b["n_chars"], -1).otherwise(1))
                        .when(a["doc_id"].isNull() | b["doc_id"].isNull(), a["doc_id"].isNull().cast("int") - b["doc_id"].isNull().cast("int"))
                        .otherwise(F.when(a["doc_id"] < b["doc_id"], -1).when(a["doc_id"] > b["doc_id"], 1).otherwise(0)))
    slim = index.select("key", "digest", "spread", "members", F.size("members").cast("long").alias("size"), F.element_at(most, 1).alias("best"))
    alone = slim.where(~F.col("spread")).withColumn("group_size", F.col("size"))
    parts = slim.where(F.col("spread"))
    # hot keys: one row per owner and text, so these tables are small
    merged = (parts.groupBy(F.col("key").alias("_k"), F.col("digest").alias("_d"))
              .agg(F.sum("size").alias("group_size"),
                   F.min(F.struct((-F.col("best.n_chars")).alias("a"), F.col("best.doc_id").isNull().alias("b"), F.col("best.doc_id").alias("c"))).alias("_best")))
    merged = merged.select("_k", "_d", "group_size", F.struct(F.col("_best.c").alias("doc_id"), (-F.col("_best.a")).alias("n_chars")).alias("best"))
    spread = (parts.drop("best").join(merged, (F.col("key") == F.col("_k")) & (F.col("digest") == F.col("_d")))
              .select("key", "digest", "spread", "members", "size", "best", "group_size"))
    rows = alone.unionByName(spread).select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.explode("members").alias("m"))
    return rows.select(F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size", F.col("m.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, capacity: int | None = None, text: str = "text") -> DataFrame:
    return resolve(build(docs, Scratch(docs.sparkSession, "exact"), capacity, text))
