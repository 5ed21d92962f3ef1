"""Addresses to coordinates by a reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_address(address) -> Column:
    """Lower case, single spaces, no spaces around commas."""
    c = F.col(address) if isinstance(address, str) else address
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r" ?, ?", ",")


def geocode_addresses(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Every distinct address with its coordinates, null where unknown.

    ``addresses`` has ``address``; ``gazetteer`` has ``address``, ``lat``, ``lon``
    and may list an address twice: the smallest (lat, lon) counts. Spark joins
    by the measured size of both sides.
    """
    known = (gazetteer.select(normalized_address("address").alias("_key"), F.struct("lat", "lon").alias("_at"))
             .groupBy("_key").agg(F.min("_at").alias("_at")))
    wanted = addresses.select("address").distinct().withColumn("_key", normalized_address("address"))
    return wanted.join(known, "_key", "left").select(
        "address", F.col("_at.lat").alias("latitude"), F.col("_at.lon").alias("longitude"))
