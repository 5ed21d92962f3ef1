"""Login files read without losing a row: every row in comes out valid or rejected, with file and reason.

Fields are read as text, so a value of the wrong kind is seen and not turned into a null.
A row that its format cannot parse (too few or too many fields, broken JSON) is kept as it
stood. Files are grouped by their header first: a file that lacks a column that logins need
is rejected row by row, columns may stand in any order, and columns that nobody asked for
are passed over and reported by `drift`.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.functions.geo import valid_coordinates
from loginlens.schema import FILE_COLUMNS

MALFORMED, MISSING_COLUMN = "malformed", "missing_column"
#: Different headers that one scan may meet; more are a sign of something else than logins.
HEADERS = 64
_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Checked:
    """``rows``: valid logins with typed columns. ``rejects``: file, row (as text), reason. ``drift``: file, missing, extra."""

    rows: DataFrame
    rejects: DataFrame
    drift: DataFrame


def scan_checked_csv(spark: SparkSession, path: str, extra: tuple[str, ...] = (), sep: str = ",") -> Checked:
    """Delimited files with headers; ``extra`` names further columns to carry along as text."""
    headers = _headers(spark, path)
    parts, drifts = [], []
    for row in headers.groupBy("header").agg(F.collect_list("file").alias("files")).limit(HEADERS + 1).collect():
        if len(parts) == HEADERS:
            raise ValueError(f"more than {HEADERS} different headers in {path}")
        names = next(csv.reader([row["header"] or ""], delimiter=sep), [])
        drifts.append((row["files"], [c for c in FILE_COLUMNS if c not in names], [c for c in names if c not in (*FILE_COLUMNS, *extra)]))
        plain = [n if n and names.index(n) == i else f"_c{i}" for i, n in enumerate(names)] or ["_c0"]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*plain, _CORRUPT]])
        read = spark.read.schema(schema).csv(row["files"], header=True, sep=sep, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
        as_text = F.coalesce(_CORRUPT, F.to_csv(F.struct(*[F.col(f"`{n}`") for n in plain]), {"sep": sep}))
        parts.append(_judged(read, as_text, drifts[-1][1], extra))
    return _checked(spark, parts, drifts, extra)


def scan_checked_json(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> Checked:
    """JSON records, one per line; a record may lack fields, which then counts as a missing value."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*FILE_COLUMNS, *extra, _CORRUPT]])
    read = spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    as_text = F.coalesce(_CORRUPT, F.to_json(F.struct(*FILE_COLUMNS, *extra)))
    return _checked(spark, [_judged(read, as_text, [], extra)], [], extra)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """`file, header` of every file: its first line. Only the lines of a file's first block are ranked."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"))
    first = lines.where("start = 0").withColumn("at", F.monotonically_increasing_id())
    return first.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def _judged(read: DataFrame, as_text: Column, missing: list[str], extra: tuple[str, ...]) -> DataFrame:
    """`file, row, reason` and the typed columns of rows as they were read."""
    held = {c: F.col(f"`{c}`") if c in read.columns else F.lit(None).cast("string") for c in (*FILE_COLUMNS, *extra)}
    typed = read.select(F.col("_metadata.file_path").alias("_file"), as_text.alias("_row"), F.col(_CORRUPT).isNotNull().alias("_bad"),
                        *[held[c].alias(c) for c in (*extra, "id", "device_id")],
                        F.try_to_timestamp(held["login_time"]).alias("login_time"),
                        *[held[c].try_cast("double").alias(c) for c in ("latitude", "longitude")])
    rules = [(F.col("_bad"), MALFORMED), (F.lit(bool(missing)), MISSING_COLUMN), (F.col("id").isNull(), "missing_id"),
             (F.col("device_id").isNull(), "missing_device"), (F.col("login_time").isNull(), "bad_time"),
             (~valid_coordinates(), "bad_coordinates")]
    reason = reduce(lambda found, rule: found.when(rule[0], rule[1]), rules, F.when(F.lit(False), ""))
    return typed.withColumn("_reason", reason)


def _checked(spark: SparkSession, parts: list[DataFrame], drifts: list[tuple], extra: tuple[str, ...]) -> Checked:
    if not parts:
        raise ValueError("there are no files to read")
    rows = reduce(DataFrame.unionByName, parts)
    drift = [(f, missing, more) for files, missing, more in drifts if missing or more for f in files]
    return Checked(
        rows.where(F.col("_reason").isNull()).select(*extra, *FILE_COLUMNS),
        rows.where(F.col("_reason").isNotNull()).select(*[F.col(f"_{c}").alias(c) for c in ("file", "row", "reason")]),
        spark.createDataFrame(drift, "file string, missing array<string>, extra array<string>"))
