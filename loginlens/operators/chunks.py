"""Numbered chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.operators.segments import SKEW, Ordered, SkewPolicy


def chunk_id(logins: DataFrame, size: int, skew: SkewPolicy = SKEW) -> DataFrame:
    """Consecutive chunks of at most ``size`` logins within each user, from 0."""
    if size < 1:
        raise ValueError("size must be at least 1")
    numbered = Ordered.of(logins, skew).number("_position").result()
    return (numbered.withColumn("chunk_id", F.floor((F.col("_position") - 1) / size).cast("bigint"))
            .drop("_position"))
