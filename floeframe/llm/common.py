"""What the training-data operators share: tables, scratch copies, folds, text digests."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """True where the id falls into the held-out remainder; a null id is not held out."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


class Scratch:
    """Written copies in the shared folder; what is no longer needed can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: survives executors and cuts the lineage."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete copies that no later step reads."""
        jvm = self.spark._jvm
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path is not None:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        # shuffle files of finished writes go when the driver collects garbage, which it does seldom by itself
        gc.collect()
        jvm.System.gc()
