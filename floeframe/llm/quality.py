"""Quality by compression: which of two dictionaries, of good or of bad text, shortens a text more.

Two zstandard dictionaries are trained on blocks of labelled good and bad documents. A text is cut into
blocks of ``BLOCK`` UTF-8 bytes (all of them), each compressed against both dictionaries, and the sizes
are added up. The normalised difference ``x = 2 (bad - good) / (bad + good)`` is turned into a probability by
a logistic curve ``logit = (slope * x + offset) * n / (n + HALF) + prior`` over the text's ``n`` bytes, fitted on
labelled documents that gave nothing to the dictionaries: the less text there is, the closer the score stays to the
share of good labels.

Fit bounds (parameters): at most ``per_class`` labelled documents of each class, the first by a seeded hash
of the id, and of their blocks at most ``dict_blocks`` a class. Scoring reads every text whole.

Edge cases: a null or empty text scores the share of good labels; a label that is neither 0
nor 1, or a document labelled both ways, teaches nothing; repeated label rows count once; rows with a null id
are scored and count as not held out. Without labels of both classes every text scores the share of good
labels (0.5 without any). Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out

BLOCK = 4096
HALF = 150.0         # bytes at which the evidence of a text counts half


@dataclass(frozen=True)
class QualityModel:
    good: bytes          # a trained dictionary, or raw text where too little was there to train on
    bad: bytes
    slope: float
    offset: float
    prior: float         # log odds of a good label
    level: int = 3


def blocks(text: str | None) -> list[bytes]:
    """The whole text as UTF-8, in blocks."""
    data = (text or "").encode("utf-8", "replace")
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]


class _Sizes:
    """Compressors for both dictionaries, made once in a task."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.pair = [self._compressor(d, level) for d in (good, bad)]

    @staticmethod
    def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The normalised difference and 1, both weighted by how much text there is."""
        n = good = bad = 0
        for block in blocks(text):
            n += len(block)
            good += len(self.pair[0].compress(block))
            bad += len(self.pair[1].compress(block))
        share = n / (n + HALF)
        return (2.0 * (bad - good) / (bad + good) * share, share) if n else (0.0, 0.0)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:      # too few samples to train on: their text itself serves
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """Weighted logistic fit with a given constant, by Newton steps with a weak pull to zero."""
    w = w / w.sum() * len(w)
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta + prior, -35, 35)))
        grad = z.T @ (w * (y - p)) - 1e-2 * beta
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(beta)), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta / scale


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, dict_blocks: int = 1500, dict_bytes: int = 112_640,
        seed: int = 11) -> QualityModel:
    """Train both dictionaries and the curve on labelled documents outside the held-out remainder."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    labelled = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
                .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
                .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
                .where(F.col("quality") == F.col("_most")).drop("_most"))
    totals = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        share = (1.0 if 1 in totals else 0.0) if totals else 0.5
        return QualityModel(b"", b"", 0.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    prior = math.log(totals[1] / totals[0])
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = [labelled.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    # at most 2 * per_class ids: small enough to send to every task that scans the texts
    ids = F.broadcast(picked[0].unionByName(picked[1]).withColumn("_dict", F.xxhash64("doc_id", F.lit(seed + 1)) % 3 != 0))
    sample = scratch.store(docs.select("doc_id", "text").join(ids, "doc_id"), "sample")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(q, b) for q, t in zip(f["quality"], f["text"]) for b in blocks(t)]
            yield pd.DataFrame({"quality": [r[0] for r in rows], "block": [r[1] for r in rows]})

    def dictionary(q: int) -> bytes:
        pieces = (sample.where(F.col("_dict") & (F.col("quality") == q)).select("quality", "text")
                  .mapInPandas(cut, "quality int, block binary"))
        chosen = pieces.orderBy(F.xxhash64("block", F.lit(seed)), "block").limit(dict_blocks).collect()
        return _dictionary([bytes(r["block"]) for r in chosen], dict_bytes)

    good, bad = dictionary(1), dictionary(0)
    raw = QualityModel(good, bad, 0.0, 0.0, prior)
    measured = sample.where(~F.col("_dict")).select("quality", evidence_udf(raw)(F.col("text")).alias("e")).collect()
    scratch.drop(sample)
    if len({r["quality"] for r in measured}) < 2:
        return raw
    x = np.array([[r["e"]["x"], r["e"]["share"]] for r in measured])      # at most 2 * per_class rows
    y = np.array([r["quality"] for r in measured], dtype=float)
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())     # back to the classes' shares
    slope, offset = _logistic(x, y, weight, prior)
    return QualityModel(good, bad, float(slope), float(offset), prior)


def evidence_udf(model: QualityModel):
    """Column function: the compressed-size evidence of a whole text."""
    spec = model

    @F.pandas_udf("x double, share double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(spec.good, spec.bad, spec.level) if spec.good and spec.bad else None
        for texts in batches:
            got = [sizes.evidence(t) if sizes else (0.0, 0.0) for t in texts]
            yield pd.DataFrame({"x": [g[0] for g in got], "share": [g[1] for g in got]}, dtype="float64")

    return evidence


def score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in the column ``name``."""
    e = F.col("_evidence")
    logit = F.lit(model.slope) * e["x"] + F.lit(model.offset) * e["share"] + F.lit(model.prior)
    at = F.least(F.greatest(logit, F.lit(-35.0)), F.lit(35.0))
    return docs.withColumn("_evidence", evidence_udf(model)(F.col(text))).withColumn(name, 1.0 / (1.0 + F.exp(-at))).drop("_evidence")
