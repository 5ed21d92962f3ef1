"""Event and pattern tables, JSON columns, GeoJSON output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.operators.profiles import upsert
from loginlens.schema import EVENT, TIME, USER, WEIGHTS

DETAILS = tuple(f"{name}_details" for name in WEIGHTS)


def login_events(logins: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Logins in stored form: verdict, score and details where a result exists.

    Of several rows with one event id the earliest stays.
    """
    columns = [EVENT, USER, TIME, "latitude", "longitude", "device_id", "ip_address"]
    rows = logins if "ip_address" in logins.columns else logins.withColumn("ip_address", F.lit(None).cast("string"))
    rows = (rows.groupBy(EVENT).agg(F.min(F.struct(TIME, *[c for c in columns if c not in (EVENT, TIME)])).alias("_first"))
            .select(EVENT, "_first.*"))
    if results is None:
        return rows.select(*columns, F.lit(False).alias("is_anomalous"), F.lit(0.0).alias("anomaly_score"),
                           F.lit(None).cast("string").alias("details"))
    verdict = results.select(
        EVENT, F.col("is_anomalous").alias("_odd"), F.col("combined_score").alias("_score"),
        (F.to_json(F.struct(*[c for c in DETAILS if c in results.columns]))
         if any(c in results.columns for c in DETAILS) else F.lit("{}")).alias("details"))
    # Details as text are many times the size that the stored structs suggest: never to be broadcast through the driver.
    return (rows.join(verdict.hint("merge"), EVENT, "left")
            .select(*columns, F.coalesce("_odd", F.lit(False)).alias("is_anomalous"),
                    F.coalesce("_score", F.lit(0.0)).alias("anomaly_score"), "details"))


def append_login_events(events: DataFrame, path: str) -> None:
    """Append to the event table, partitioned by day.

    Rows are rebalanced by day: small days share a task, and a large day is split
    by its size, whatever the volume.
    """
    dated = (events.withColumn("login_date", F.to_date(TIME))
             .withColumn("created_at", F.current_timestamp()))
    dated.hint("rebalance", "login_date").write.mode("append").partitionBy("login_date").parquet(path)


def upsert_snapshot(existing: DataFrame, updates: DataFrame, path: str) -> DataFrame:
    """Write the merged table to a new directory and read it back."""
    upsert(existing, updates).write.mode("errorifexists").parquet(path)
    return existing.sparkSession.read.parquet(path)


def nested_to_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def json_to_nested(df: DataFrame, column: str, schema: T.DataType) -> DataFrame:
    """Parse a JSON column; ``<column>_ok`` is false for text that is not JSON."""
    parsed = F.from_json(column, schema)
    return df.withColumns({f"{column}_ok": F.coalesce(F.expr(f"try_parse_json({column})").isNotNull(), F.lit(False)),
                           column: parsed})


def write_geojson(features: DataFrame, path: str) -> None:
    """One feature per line (newline-delimited GeoJSON), written in parallel."""
    features.select("feature").write.mode("errorifexists").text(path)


def read_geojson(spark, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "feature")
