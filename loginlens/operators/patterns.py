"""Feature engineering and per-cluster statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlens.functions import clock, geo
from loginlens.operators.profiles import shift_antimeridian, standard_distance, user_devices
from loginlens.operators.segments import SKEW, Ordered, SkewPolicy, join_per_user
from loginlens.schema import EVENT, TIME, USER

NUMERIC = ("latitude", "lon_unwrapped", "hour_sin", "hour_cos", "day_sin", "day_cos")
NOISE = -1
#: Logins that agree on these columns are one point in feature space.
SITE = (USER, "device_id", "day", "hour", "latitude", "longitude")


def login_features(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Latitude, unwrapped longitude and four cyclic columns; device stays a category."""
    return (shift_antimeridian(logins, skew)
            .withColumns({**clock.cyclic_time(), "hour": clock.login_hour(), "day": clock.login_day()})
            .select(USER, EVENT, TIME, "latitude", "longitude", "device_id", *NUMERIC[1:], "hour", "day"))


def device_indicators(logins: DataFrame) -> DataFrame:
    """One-hot device features in long form: only the ones are stored."""
    return logins.select(USER, EVENT, F.concat(F.lit("device_"), "device_id").alias("feature"),
                         F.lit(1).alias("value"))


def with_site(logins: DataFrame) -> DataFrame:
    """Logins with the hour and weekday that complete their site columns."""
    return logins.withColumns({"hour": clock.login_hour(), "day": clock.login_day()})


def feature_frame(logins: DataFrame) -> DataFrame:
    """One row per user: mean and population std of every numeric feature.

    Whether a user's longitudes must be unwrapped depends on their spread, so
    both readings are aggregated and the right one is picked: one pass in all.
    A zero std counts as 1.
    """
    east = F.when(F.col("longitude") < 0, F.col("longitude") + 360).otherwise(F.col("longitude"))
    values = {"latitude": F.col("latitude"), "_plain": F.col("longitude"), "_east": east, **clock.cyclic_time()}
    stats = logins.groupBy(USER).agg(
        F.count("*").alias("points"), (F.max("longitude") - F.min("longitude")).alias("lon_range"),
        *[F.avg(c).alias(f"{n}_mean") for n, c in values.items()],
        *[F.stddev_pop(c).alias(f"{n}_std") for n, c in values.items()])
    wide = (F.col("points") > 1) & (F.col("lon_range") > 180)

    def pick(kind: str) -> Column:
        return F.when(wide, F.col(f"_east_{kind}")).otherwise(F.col(f"_plain_{kind}"))

    chosen = stats.withColumns({"lon_unwrapped_mean": pick("mean"), "lon_unwrapped_std": pick("std")})
    scales = [F.when(F.col(f"{c}_std") < 1e-12, 1.0).otherwise(F.col(f"{c}_std")).alias(f"{c}_std") for c in NUMERIC]
    return chosen.select(USER, "points", "lon_range", *[f"{c}_mean" for c in NUMERIC], *scales)


def with_frame(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Feature columns of every login together with its user's means and scales."""
    base = logins.select(USER, EVENT, TIME, "latitude", "longitude", "device_id")
    return (join_per_user(base, feature_frame(base), skew)
            .withColumns({"lon_unwrapped": geo.unwrap_longitude("longitude", "lon_range", "points"),
                          **clock.cyclic_time(), "hour": clock.login_hour(), "day": clock.login_day()}))


def standardize(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """z-scores per user in columns named ``<feature>_z``."""
    z = [((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{c}_z") for c in NUMERIC]
    return with_frame(logins, skew).select(USER, EVENT, TIME, "device_id", *z)


def device_scale(logins: DataFrame) -> DataFrame:
    """Squared weight of a device's one-hot column after standardising: 1 / (p(1-p)).

    A device all of a user's logins share has a constant column and weight 0.
    """
    share = F.col("percentage") / 100
    return user_devices(logins).select(
        USER, "device_id",
        F.when(share >= 1, 0.0).otherwise(F.lit(1.0) / (share * (F.lit(1.0) - share))).alias("device_weight"))


def distance_to_previous(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Feature-space distance of each login to the user's preceding one.

    The one-hot part needs no wide vector: equal devices add nothing, two
    different devices add the sum of their weights.
    """
    skew = skew.measured(logins)
    scaled = standardize(logins, skew).join(device_scale(logins), [USER, "device_id"])
    point = F.struct("device_id", "device_weight", *[f"{c}_z" for c in NUMERIC])
    pairs = Ordered.of(scaled, skew).previous("_prev", point).result().where("_prev IS NOT NULL")
    numeric = sum((F.pow(F.col(f"{c}_z") - F.col(f"_prev.{c}_z"), F.lit(2.0)) for c in NUMERIC), F.lit(0.0))
    device = F.when(F.col("device_id") == F.col("_prev.device_id"), 0.0).otherwise(
        F.col("device_weight") + F.col("_prev.device_weight"))
    return pairs.select(USER, EVENT, F.sqrt(numeric + device).alias("distance"))


def cluster_stats(labelled: DataFrame) -> DataFrame:
    """Per (user, cluster): size, share of all the user's rows, centre, spread.

    ``labelled`` needs user, cluster and coordinates; noise (-1) counts in the
    denominator only.
    """
    sizes = labelled.groupBy(USER, "cluster").agg(F.count("*").alias("count"))
    totals = sizes.groupBy(USER).agg(
        F.sum("count").alias("_total"),
        F.count_if(F.col("cluster") != NOISE).alias("num_clusters"))
    real = labelled.where(F.col("cluster") != NOISE)
    spread = standard_distance(real, USER, "cluster").drop("points")
    return (sizes.where(F.col("cluster") != NOISE).join(spread, [USER, "cluster"]).join(totals, USER)
            .select(USER, "cluster", "count", (F.col("count") / F.col("_total") * 100).alias("percentage"),
                    "center_lat", "center_lon", "std_distance", "num_clusters"))


def cluster_breakdown(labelled: DataFrame, part: Column, name: str) -> DataFrame:
    """Login counts per (user, cluster, device), hour or weekday."""
    return (labelled.where(F.col("cluster") != NOISE)
            .groupBy(USER, "cluster", part.alias(name)).agg(F.count("*").alias("count")))


def cluster_devices(labelled: DataFrame) -> DataFrame:
    return cluster_breakdown(labelled, F.col("device_id"), "device_id")


def cluster_hours(labelled: DataFrame) -> DataFrame:
    return cluster_breakdown(labelled, clock.login_hour(), "hour")


def cluster_days(labelled: DataFrame) -> DataFrame:
    return cluster_breakdown(labelled, clock.login_day(), "day")


def elbow_k(inertias: DataFrame) -> DataFrame:
    """Best k per user: largest second difference of inertia, plus two.

    Input rows are (user_id, k, inertia) with k from 1. Two inertias or fewer
    give the default of 2. A user has at most nine rows, so windows are small.
    """
    w = Window.partitionBy(USER).orderBy("k")
    bend = (F.lead("inertia", 2).over(w) - F.lead("inertia", 1).over(w)) - (
        F.lead("inertia", 1).over(w) - F.col("inertia"))
    return (inertias.withColumn("_bend", bend).groupBy(USER)
            .agg(F.max_by("k", F.when(F.col("_bend").isNotNull(), F.struct("_bend", -F.col("k")))).alias("_k"))
            .select(USER, F.coalesce(F.col("_k") + 1, F.lit(2)).cast("int").alias("best_k")))
