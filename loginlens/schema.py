"""Column contracts, weights and limits shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

USER = "user_id"
TIME = "timestamp"
EVENT = "event_id"
#: Total order of one user's logins.
ORDER = (TIME, EVENT)

LOGIN_COLUMNS = ("user_id", "timestamp", "latitude", "longitude", "device_id")
FILE_COLUMNS = ("id", "device_id", "login_time", "latitude", "longitude")

LOGIN_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
])

# Detector weights and the verdict threshold (strict >).
WEIGHTS = {
    "location": 0.25,
    "device": 0.2,
    "time": 0.15,
    "velocity": 0.2,
    "isolation_forest": 0.1,
    "mahalanobis": 0.1,
}
THRESHOLD = 0.7
NEUTRAL = 0.5
#: Message of a model that has too few logins to learn from.
INSUFFICIENT = "too_few_logins"

# Lower speed bound in km/h (strict >) and the score above it.
VELOCITY_TIERS = ((1000.0, 1.0), (800.0, 0.9), (300.0, 0.6), (150.0, 0.3), (80.0, 0.1))

#: Default of the `history_limit` of the Mahalanobis model and of replays from a store: the newest events of a
#: user that they learn from. None means all.
HISTORY_LIMIT = 1000
ADVANCED_MIN_ROWS = 10
MAHALANOBIS_MIN_ROWS = 5


def require_columns(df: DataFrame, columns=LOGIN_COLUMNS) -> DataFrame:
    """Fail while the plan is built when a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required column: {', '.join(missing)}")
    return df
