"""Track archives: CSV files whose headers differ, read as one table."""

from __future__ import annotations

import csv
import re
from collections import Counter, defaultdict
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tracks import melt_sensors, rejected_fixes

_PART = re.compile(r"^([A-Za-z][A-Za-z0-9]*)_([0-9]+)$")
ID_COLUMN = "iceberg_id"
KEPT = (ID_COLUMN, "date", "source_file", "source_row")


class HeaderError(ValueError):
    """A header that does not follow the archive's rule."""


def split_header(line: str) -> list[str]:
    """Column names of a header line, with or without quotes and byte order mark."""
    return [c.strip() for c in next(csv.reader([line.removeprefix("﻿")]), [])]


def resolve_header(columns: list[str]) -> dict:
    """Sensors and family of a header; a header that breaks the rule is refused whole.

    The rule: ``date``, any number of ``<sensor>_1, <sensor>_2[, <sensor>_3]``
    and optionally ``size_1, size_2``. Sensor names are open-ended. Higher numbers
    of a sensor that has a position are kept as they are and name the family too.
    """
    names = [c.strip() for c in columns]
    twice = sorted(c for c, n in Counter(names).items() if n > 1)
    if twice:
        raise HeaderError(f"more than one column is called {', '.join(map(repr, twice))}")
    if "date" not in names:
        raise HeaderError(f"none of {len(names)} columns is called 'date'")
    parts: dict[str, set[int]] = defaultdict(set)
    for c in names:
        found = _PART.match(c)
        if found:
            parts[found[1]].add(int(found[2]))
        elif c not in ("date", ID_COLUMN):
            raise HeaderError(f"cannot tell what {c!r} holds")
    size = parts.pop("size", set())
    if size not in (set(), {1, 2}):
        raise HeaderError("a size needs size_1 and size_2 and nothing else")
    if not parts:
        raise HeaderError("has no sensor")
    for sensor, seen in sorted(parts.items()):
        if not {1, 2} <= seen:
            raise HeaderError(f"sensor {sensor!r} needs {sensor}_1 and {sensor}_2")
    sensors = sorted(parts)
    preserved = sorted(f"{s}_{n}" for s in sensors for n in parts[s] - {1, 2, 3})
    return {"sensors": sensors, "flagged": [s for s in sensors if 3 in parts[s]], "has_size": bool(size), "preserved": preserved,
            "family": "+".join(sensors + preserved + (["size"] if size else []))}


def scan_headers(spark: SparkSession, path: str) -> list[tuple[str, str | None]]:
    """(file, first line that is not blank) of every CSV file below ``path``; None for a file without one.

    One row per file comes back to the driver, as with any file listing. Each task keeps one line of a file.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    lines = (text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
             .withColumn("_n", F.monotonically_increasing_id()).where((F.col("at") == 0) & (F.trim("value") != "")))
    place = lambda file: urlsplit(file)[1:3]                                # a listing may write file:/ as file:///
    first = {place(r["file"]): r["header"] for r in lines.groupBy("file").agg(F.min_by("value", "_n").alias("header")).collect()}
    return [(file, first.get(place(file))) for file in sorted(text.inputFiles())]


def number_records(rows: DataFrame) -> DataFrame:
    """``source_row``: the record's place in its file, from 1, header not counted.

    Blocks of a file are numbered apart and then moved by the records before them, so no task holds more than a block.
    """
    block = ["_path", "_block"]
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_c"))
              .select(*block, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_id"))
    return rows.withColumn("_at", place).join(before, block).withColumn("source_row", F.col("_before") + F.col("_at")).drop(*block, "_id", "_at", "_before")


def _families(spark: SparkSession, path: str) -> tuple[list[tuple[DataFrame, dict]], dict[str, str]]:
    """A wide table and its header's reading for each header, and the refused files with their reason."""
    by_header: dict[str, list[str]] = defaultdict(list)
    refused: dict[str, str] = {}
    for file, header in scan_headers(spark, path):
        try:
            if header is None:
                raise HeaderError("is empty")
            resolve_header(split_header(header))
            by_header[header].append(file)
        except HeaderError as exc:
            refused[file] = str(exc)
    tables = []
    for header, files in sorted(by_header.items()):
        names = split_header(header)
        wide = (spark.read.schema(", ".join(f"`{c}` string" for c in names)).option("header", "true").csv(files)
                .select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("_path"),
                        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")))
        if ID_COLUMN not in names:
            wide = wide.withColumn(ID_COLUMN, F.regexp_extract("source_file", r"([^/]+)\.csv$", 1))
        tables.append((wide, resolve_header(names)))
    if not tables:
        raise HeaderError(f"no readable track file below {path}: {refused}")
    return tables, refused


def read_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Observations of all well-formed files, and the refused files with their reason.

    Every file is either read or refused. ``date`` is the code as it stands in the file; ``source_file`` and ``source_row``
    tell where an observation comes from. Entries that are not numbers give no observation: see ``read_rejects``.
    """
    tables, refused = _families(spark, path)
    seen = [melt_sensors(number_records(wide), found["sensors"], KEPT).withColumn("schema_family", F.lit(found["family"])) for wide, found in tables]
    return reduce(DataFrame.unionByName, seen), refused


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Per file and sensor the records whose position holds something that is not a number."""
    tables, _ = _families(spark, path)
    return reduce(DataFrame.unionByName, [rejected_fixes(wide, found["sensors"], ["source_file"]) for wide, found in tables])
