import datetime as dt
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loginlens.session import build_session  # noqa: E402
from loginlens.sources.event_logins import logins_from_events  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = ("event_id long, user_id string, timestamp timestamp_ntz, latitude double, longitude double, "
          "device_id string, ip_address string")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def logins(spark):
    return logins_from_events(spark, SF)


@pytest.fixture(scope="session")
def small(logins):
    """Three users, one of them habitual."""
    return logins.where(F.col("user_id").isin("user0", "user1", "user2"))


@pytest.fixture(scope="session")
def make(spark):
    """Login table from (event, user, 'YYYY-MM-DD HH:MM:SS', lat, lon, device) rows."""
    def build(rows):
        full = [(e, u, dt.datetime.fromisoformat(t), lat, lon, d, None) for e, u, t, lat, lon, d in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
