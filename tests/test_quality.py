import pytest
from pyspark.sql import functions as F

from loginlens.operators import quality
from loginlens.schema import require_columns
from loginlens.sources.event_logins import raw_logins


def test_missing_column_fails_when_the_plan_is_built(logins):
    with pytest.raises(ValueError, match="Missing required column: device_id"):
        require_columns(logins.drop("device_id"))


def test_clean_file_rules(spark):
    rows = [("a", "d", "2024-01-01 00:00:00", "1", "2"), ("a", "d", "2024-01-01 00:00:01", "abc", "2"),
            ("a", "d", "2024-01-01 00:00:02", "90", "180"), ("a", "d", "2024-01-01 00:00:03", "90.0001", "0"),
            ("a", "d", "2024-01-01 00:00:04", None, "0"), ("a", "d", "2023-01-01 00:00:00", "NaN", "0")]
    df = spark.createDataFrame(rows, "id string, device_id string, login_time string, latitude string, longitude string")
    kept = [r.login_time.second for r in quality.clean_file(df, order=True).collect()]
    assert kept == [0, 2]


def test_rejects_and_parsed_times_are_complementary(logins):
    raw = raw_logins(logins)
    parsed = quality.parse_timestamps(raw).where(F.col("timestamp").isNotNull()).count()
    assert parsed + quality.rejected_times(raw).count() == raw.count()


def test_default_columns_keep_existing(logins):
    df = logins.select("event_id", F.lit(True).alias("is_anomalous"))
    row = quality.default_columns(df).first()
    assert row.is_anomalous is True and row.anomaly_score == 0.0


def test_date_range_is_inclusive(make):
    df = make([(1, "a", "2024-01-01 00:00:00", 0.0, 0.0, "d"), (2, "a", "2024-01-08 00:00:00", 0.0, 0.0, "d"),
               (3, "a", "2023-12-31 23:59:59", 0.0, 0.0, "d")])
    assert {r.event_id for r in quality.date_range_filter(df, 7).collect()} == {1, 2}
