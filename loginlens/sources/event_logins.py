"""Login table derived from the generic ``events`` stream table.

``events`` has users and times but no coordinates, device or address. They are
derived here by integer arithmetic on the ids, row by row, so the login table
is as large as ``events`` and any SQL engine can rebuild it bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The eight home cities (latitude, longitude).
HOME_CITIES = (
    (40.75, -74.0), (51.5, -0.15), (35.7, 139.7), (48.85, 2.35),
    (-33.85, 151.2), (37.75, -122.4), (-16.8, 179.99), (1.3, 103.85),
)


def logins_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_logins(spark.read.parquet(f"{sf_dir}/events.parquet"))


def derive_logins(events: DataFrame) -> DataFrame:
    """event_id, user_id, timestamp, latitude, longitude, device_id, ip_address."""
    events = events.withColumnRenamed("user_id", "uid")
    uid, event = F.col("uid"), F.col("event_id")
    habitual = uid % 3 == 0
    nine = F.col("ts") - F.make_interval(hours=F.hour("ts") - 9)
    city = (F.when(event % 29 == 0, (uid + 3) % 8).when(event % 31 == 0, (uid + 5) % 8)
            .otherwise(uid % 8).cast("int"))
    # props is {"k": n}; cutting the text is cheaper than a JSON parser per use.
    k = F.substring_index(F.substring_index("props", ":", -1), "}", 1).cast("int")

    def of_city(axis: int):
        return F.element_at(F.array(*[F.lit(float(c[axis])) for c in HOME_CITIES]), city + 1)

    lat_step = F.when(habitual, 0).otherwise(k % 25 - 12).cast("double") / 1000.0
    lon_step = F.when(habitual, event % 3).otherwise(event % 37 - 18).cast("double") / 1000.0
    lon = of_city(1) + lon_step
    kind = (F.when(F.col("event_type").isin("click", "view", "purchase"), "mobile")
            .when(F.col("event_type") == "signup", "tablet").otherwise("desktop"))
    device = (F.when(event % 41 == 0, F.concat(F.lit("device_new_"), event.cast("string")))
              .when(habitual, F.concat(F.lit("device_mobile_"), uid.cast("string")))
              .otherwise(F.concat(F.lit("device_"), kind, F.lit("_"), uid.cast("string"))))
    address = F.concat(F.lit("10."), (uid % 256).cast("string"), F.lit("."), k.cast("string"),
                       F.lit("."), (event % 256).cast("string"))
    return events.select(
        "event_id",
        F.concat(F.lit("user"), uid.cast("string")).alias("user_id"),
        F.when(habitual & (event % 17 != 0), nine).otherwise(F.col("ts")).alias("timestamp"),
        (of_city(0) + lat_step).alias("latitude"),
        F.when(lon > 180, lon - 360.0).otherwise(lon).alias("longitude"),
        device.alias("device_id"),
        address.alias("ip_address"))


def raw_logins(logins: DataFrame) -> DataFrame:
    """The same logins as untyped text with a share of defective values.

    Times, coordinates, devices and addresses are spoilt on fixed id patterns,
    the way exported files are: unparsable, out of range or missing.
    """
    event = F.col("event_id")
    ip = (F.when(event % 37 == 0, "300.1.1.1").when(event % 43 == 0, F.lit(None).cast("string"))
          .when(event % 73 == 0, ":::").when(event % 79 == 0, "1:2").when(event % 83 == 0, "1::2::3")
          .when(event % 89 == 0, "2001:db8::12345").when(event % 97 == 0, "2001:DB8::1:2")
          .when(event % 101 == 0, "::ffff:10.0.0.1")
          .otherwise(F.col("ip_address")))
    return logins.select(
        "event_id", "user_id",
        F.when(event % 47 == 0, "not a time")
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when(event % 53 == 0, "abc").when(event % 59 == 0, "95.5")
        .when(event % 61 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.when(event % 67 == 0, "-180.5").otherwise(F.col("longitude").cast("string")).alias("longitude"),
        F.when(event % 71 == 0, F.lit(None).cast("string")).otherwise(F.col("device_id")).alias("device_id"),
        ip.alias("ip_address"))
