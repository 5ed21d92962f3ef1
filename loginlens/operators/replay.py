"""Score a whole history, each login against the state just before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.functions import clock
from loginlens.operators import scoring
from loginlens.operators.profiles import CELL, with_cell
from loginlens.operators.segments import SKEW, Ordered, SkewPolicy
from loginlens.schema import EVENT, TIME, USER

_PREVIOUS = ("last_login", "prev_lat", "prev_lon")


def _previous_place(ordered: Ordered) -> Ordered:
    """Time of the preceding login and the first-seen coordinates of its cell."""
    placed = ordered.first("_cell_first", F.struct("latitude", "longitude"), CELL)
    before = F.struct(F.col(TIME).alias("last_login"), F.col("_cell_first.latitude").alias("prev_lat"),
                      F.col("_cell_first.longitude").alias("prev_lon"))
    moved = placed.previous("_before", before)
    columns = {name: F.col(f"_before.{name}") for name in _PREVIOUS}
    return Ordered(moved.rows.withColumns(columns).drop("_before", "_cell_first", *CELL), moved.is_hot)


def replay_velocity(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Travel speed from the user's preceding login; first logins are left out."""
    rows = logins.select(USER, EVENT, TIME, "latitude", "longitude")
    ordered = _previous_place(Ordered.of(with_cell(rows), skew))
    return scoring.velocity_columns(ordered.result()).where(F.col("last_login").isNotNull())


def impossible_travel(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Logins reached at airliner speed or faster."""
    return (replay_velocity(logins, skew).where(F.col("velocity_score") >= 0.9)
            .select(USER, EVENT, TIME, F.col("velocity_details.distance_km").alias("distance_km"),
                    F.col("velocity_details.time_diff_hours").alias("time_diff_hours"),
                    F.col("velocity_details.velocity_km_h").alias("velocity_km_h"), "velocity_score"))


def replay_state(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Counters of the profile as it stood before each login."""
    rows = with_cell(logins).withColumns({"_hour": clock.login_hour(), "_day": clock.login_day()})
    ordered = Ordered.of(rows, skew)
    ordered = ordered.count_before("total_logins", small=True)
    ordered = _previous_place(ordered)
    ordered = ordered.count_before("device_count", by=("device_id",))
    ordered = ordered.count_before("hour_count", by=("_hour",), small=True)
    ordered = ordered.count_before("day_count", by=("_day",), small=True)
    return ordered.result().drop("_hour", "_day")


def replay_scores(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Device, time and velocity scores of every login against its own past.

    A user's first login has no past: all three scores are neutral.
    """
    state = replay_state(logins, skew)
    # Null instead of zero for a first login, so that shares of nothing stay null.
    total = F.col("_total")
    first = total.isNull()
    share = F.when(F.col("device_count") > 0, F.col("device_count") / total * 100)
    scored = scoring.velocity_columns(state.withColumn("_total", F.nullif("total_logins", F.lit(0))))
    neutral = F.lit(scoring.NEUTRAL)
    return scored.select(
        USER, EVENT, TIME, "total_logins", "device_count", "hour_count", "day_count",
        F.when(first, neutral).otherwise(scoring.device_score(share)).alias("device_score"),
        F.when(first, neutral).otherwise(
            scoring.time_score(F.col("hour_count"), F.col("day_count"), total)).alias("time_score"),
        F.when(first, neutral).otherwise(F.col("velocity_score")).alias("velocity_score"))
