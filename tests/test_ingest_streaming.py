import pytest
from pyspark.sql import functions as F

from conftest import SF, rows_of
from loginlens.operators import profiles, replay
from loginlens.plans.ingest import Snapshot, process_logins, stored_events
from loginlens.sources.event_logins import derive_logins
from loginlens.streaming.ingest import stream_ingest
from loginlens.streaming.scores import drop_repeats, stream_scores


def split(df, moment):
    at = F.lit(moment).cast("timestamp_ntz")
    return df.where(F.col("timestamp") < at), df.where(F.col("timestamp") >= at)


def test_two_batches_equal_one_profile(spark, small, tmp_path):
    store = str(tmp_path)
    first, second = split(small, "2024-01-15")
    assert tuple(process_logins(first, store, 0, None).first()) == (3, 3, 0)
    assert tuple(process_logins(second, store, 1, 0).first()) == (3, 0, 3)
    # Running a batch again replaces its own output only.
    assert tuple(process_logins(second, store, 1, 0).first()) == (3, 0, 3)
    assert stored_events(spark, store, 1).count() == small.count()
    merged, whole = Snapshot.read(spark, f"{store}/snapshots/1"), profiles.build_profile(small)
    assert rows_of(whole.totals) == rows_of(merged.profile.totals, *whole.totals.columns)
    assert rows_of(whole.devices) == rows_of(merged.profile.devices, *whole.devices.columns)
    assert {r.user_id for r in merged.patterns.collect()} == {"user0", "user1", "user2"}


def test_repeats_and_rejects(spark, small, tmp_path):
    """A login delivered again in a later batch counts once; an unusable row is set aside."""
    store = str(tmp_path)
    first, second = split(small, "2024-01-15")
    process_logins(first, store, 0, None)
    again = first.limit(25)
    bad = second.limit(3).withColumn("event_id", F.col("event_id") + 10_000_000).withColumn("latitude", F.lit(99.0))
    process_logins(second.unionByName(again).unionByName(bad), store, 1, 0)
    assert stored_events(spark, store, 1).count() == small.count()
    assert spark.read.parquet(f"{store}/rejects/batch_id=1").count() == 3
    merged, whole = Snapshot.read(spark, f"{store}/snapshots/1").profile, profiles.build_profile(small)
    for part in ("totals", "devices", "gaps", "spread"):
        assert rows_of(getattr(whole, part)) == rows_of(getattr(merged, part), *getattr(whole, part).columns)


def test_history_limit_bounds_merged_metrics(small, tmp_path):
    first, second = split(small, "2024-01-15")
    old = profiles.build_profile(first)
    counts = lambda p: {r.user_id: r.total_logins for r in p.totals.collect()}
    whole, bounded = (profiles.merge_profiles(old, second, small, history_limit=n) for n in (None, 10))
    assert counts(whole) == counts(bounded)
    assert rows_of(whole.gaps) == rows_of(profiles.build_profile(small).gaps, *whole.gaps.columns)
    assert rows_of(whole.gaps) != rows_of(bounded.gaps)


def test_history_option(small, tmp_path):
    with pytest.raises(ValueError, match="history"):
        process_logins(small, str(tmp_path), 0, None, history="everything")


@pytest.fixture(scope="module")
def login_files(spark, small, tmp_path_factory):
    """Three files in time order."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id IN (0, 1, 2)")
    lows, mid = split(events.withColumnRenamed("ts", "timestamp"), "2024-01-10")
    mid, highs = split(mid, "2024-01-20")
    for part in (lows, mid, highs):
        part.withColumnRenamed("timestamp", "ts").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return derive_logins(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


def run(writer, out, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def test_stream_equals_replay(spark, small, login_files, tmp_path):
    out = f"{tmp_path}/out"
    run(stream_scores(stream(spark, login_files)).writeStream.format("parquet"), out, f"{tmp_path}/c")
    columns = ("event_id", "total_logins", "device_score", "time_score", "velocity_score")
    assert rows_of(spark.read.parquet(out), *columns) == rows_of(replay.replay_scores(small), *columns)


def test_stream_passes_over_unusable_rows(spark, tmp_path):
    kind = "event_id long, user_id string, timestamp timestamp, latitude double, longitude double, device_id string"
    rows = [(1, "u", "2024-01-01 00:00:00", -16.8005, 0.0), (2, "u", "2024-01-01 01:00:00", None, 0.0),
            (3, "u", "2024-01-01 02:00:00", float("nan"), 0.0), (4, None, "2024-01-01 03:00:00", 1.0, 0.0),
            (5, "u", None, 1.0, 0.0), (6, "u", "2024-01-01 04:00:00", -16.801, 0.0)]
    frame = spark.createDataFrame([(*r[:2], r[2], *r[3:], "d") for r in rows],
                                  kind.replace("timestamp timestamp", "timestamp string"))
    frame.withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    run(stream_scores(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.format("parquet"),
        f"{tmp_path}/out", f"{tmp_path}/c")
    assert rows_of(spark.read.parquet(f"{tmp_path}/out"), "event_id", "total_logins") == [(1, 0), (6, 1)]


def test_repeats_are_dropped(spark, small, login_files, tmp_path):
    rows = stream(spark, login_files).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = rows.select("event_id", "timestamp")
    out = f"{tmp_path}/out"
    run(drop_repeats(rows.unionByName(rows), "60 days").writeStream.format("parquet"), out, f"{tmp_path}/c")
    assert spark.read.parquet(out).count() == small.count()


def test_stream_ingest_merges_batches(spark, small, login_files, tmp_path):
    writer = stream_ingest(stream(spark, login_files), f"{tmp_path}/store", f"{tmp_path}/c")
    writer.trigger(availableNow=True).start().awaitTermination()
    whole = profiles.user_totals(small)
    last = Snapshot.read(spark, f"{tmp_path}/store/snapshots/2").profile.totals
    assert rows_of(whole) == rows_of(last, *whole.columns)
