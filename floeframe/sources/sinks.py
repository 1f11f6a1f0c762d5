"""Writers. All of them go to the folder the session names as shared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def scratch_path(spark, name: str) -> str:
    """A path no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """Write to a fresh shared path and read it back."""
    path = scratch_path(df.sparkSession, name)
    write_partitioned(df, path, list(partition_by))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Parquet by partition columns, dealt out by them first: few files for each value, and large values are split."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_cells(df: DataFrame, path: str) -> None:
    """Daily cells partitioned by month; days inside a month are pruned by Parquet statistics."""
    write_partitioned(df.withColumn("month", F.trunc("day", "month")), path, ["month"])


def read_days(spark, path: str, first: str, last: str) -> DataFrame:
    """Cells of a day range; the month filter keeps every other partition closed."""
    low, high = (F.lit(d).cast("date") for d in (first, last))
    return (spark.read.parquet(path)
            .where(F.col("month").between(F.trunc(low, "month"), F.trunc(high, "month")) & F.col("day").between(low, high))
            .drop("month"))


def write_predictions(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ["start_date"])


def write_exposure(df: DataFrame, path: str) -> None:
    """Sparse: only cells with a positive exposure are stored."""
    write_partitioned(df.where(F.col("exposure") > 0), path, ["bucket"])


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_new(candidates: DataFrame, path: str, key: list[str], compute) -> DataFrame:
    """Compute only the keys ``path`` does not hold yet, and append them.

    ``compute`` maps a DataFrame of missing keys to finished rows.
    """
    spark = candidates.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        stored = None
    missing = candidates if stored is None else candidates.join(stored.select(*key).distinct(), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)
