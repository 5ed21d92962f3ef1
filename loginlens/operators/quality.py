"""Cleaning, validation flags and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loginlens.functions.geo import valid_coordinates
from loginlens.functions.text import valid_ip
from loginlens.schema import (FILE_COLUMNS, LOGIN_COLUMNS, TIME, USER,
                              require_columns)


def _is_time(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz")


def parse_timestamps(df: DataFrame, column: str = TIME) -> DataFrame:
    """Text to timestamp; unparsable text becomes null (see :func:`rejected_times`)."""
    if _is_time(df, column):
        return df
    return df.withColumn(column, F.try_to_timestamp(F.col(column)))


def rejected_times(df: DataFrame, column: str = TIME) -> DataFrame:
    """Rows whose time text is present but cannot be parsed."""
    if _is_time(df, column):
        return df.limit(0)
    return df.where(F.col(column).isNotNull() & F.try_to_timestamp(F.col(column)).isNull())


def coerce_numeric(df: DataFrame, columns=("latitude", "longitude")) -> DataFrame:
    """Non-numeric text becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def drop_null_coords(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["latitude", "longitude"])


def null_coord_counts(df: DataFrame) -> DataFrame:
    missing = F.col("latitude").isNull() | F.col("longitude").isNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(missing).alias("dropped"))


def default_columns(df: DataFrame) -> DataFrame:
    """Add the scoring columns a raw login table lacks."""
    defaults = {"is_anomalous": F.lit(False), "anomaly_score": F.lit(0.0)}
    absent = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def clean_file(df: DataFrame, order: bool = False) -> DataFrame:
    """Loader contract: required columns, parsed time, valid coordinates; sorted by id and time on demand."""
    require_columns(df, FILE_COLUMNS)
    if any(df.schema[c].dataType.typeName() == "string" for c in ("latitude", "longitude")):
        df = coerce_numeric(df)
    # The range test also rejects missing coordinates.
    kept = parse_timestamps(df, "login_time").where(valid_coordinates())
    return kept.orderBy("id", "login_time") if order else kept


def quality_flags(df: DataFrame) -> DataFrame:
    """One boolean per rule, plus their conjunction ``is_valid``."""
    require_columns(df, LOGIN_COLUMNS)
    time_ok = (F.col(TIME).isNotNull() if _is_time(df, TIME)
               else F.try_to_timestamp(F.col(TIME)).isNotNull())
    flags: dict[str, Column] = {
        "has_user": F.col(USER).isNotNull(),
        "has_device": F.col("device_id").isNotNull(),
        "has_time": time_ok,
        "has_coordinates": valid_coordinates(),
    }
    if "ip_address" in df.columns:
        flags["has_valid_ip"] = valid_ip()
    out = df.withColumns(flags)
    return out.withColumn("is_valid", reduce(lambda a, b: a & b, map(F.col, flags)))


def ensure_valid(df: DataFrame) -> DataFrame:
    flagged = quality_flags(df)
    return flagged.where("is_valid").select(*df.columns)


def filter_user(df: DataFrame, user_id: str) -> DataFrame:
    return df.where(F.col(USER) == user_id)


def date_range_filter(df: DataFrame, days: int = 30, end=None) -> DataFrame:
    """Rows within ``days`` before ``end``; the table's newest time by default."""
    if end is None:
        end = df.select(F.max(TIME).alias("end")).scalar()
    else:
        end = F.lit(end)
    return df.where(F.col(TIME).between(end - F.make_interval(days=F.lit(days)), end))


def anomalies_only(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("is_anomalous"), F.lit(False)))


def known_users(df: DataFrame, profiles: DataFrame) -> DataFrame:
    return df.join(profiles.select(USER), USER, "left_semi")


def new_users(df: DataFrame, profiles: DataFrame) -> DataFrame:
    return df.join(profiles.select(USER), USER, "left_anti")


def distinct_users(df: DataFrame) -> DataFrame:
    return df.select(USER).distinct()


def sort_time(df: DataFrame) -> DataFrame:
    return df.orderBy(TIME, "event_id")
