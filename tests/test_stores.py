import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from loginlens.operators import profiles, seeded
from loginlens.operators.segments import latest
from loginlens.plans.ingest import process_logins
from loginlens.session import run_dir
from loginlens.sources import event_store
from loginlens.sources.event_store import EventStore
from loginlens.sources.profile_log import ProfileLog, increments_after
from loginlens.sources.sinks import login_events
from loginlens.streaming.replay import stream_replay


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text, df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture()
def kept(spark, logins):
    store = EventStore.open(spark, run_dir(spark, "events"), buckets=16)
    events = login_events(logins)
    for i in range(3):
        store.append(events.where(F.col("event_id") % 3 == i), i)
    return store


def test_the_store_side_is_never_shuffled(spark, logins, kept):
    newest = kept.latest(5)
    assert "Exchange" not in plan(newest)[0]
    assert rows_of(newest, "event_id", "recency") == rows_of(latest(logins, 5), "event_id", "recency")
    grouped = profiles.user_totals(kept.events())
    assert "Exchange" not in plan(grouped)[0] and rows_of(grouped) == rows_of(profiles.user_totals(logins))
    # Users beyond the number that is looked up by name are joined in the buckets: they are dealt to them, the events stay.
    many = EventStore(spark, kept.path, kept.buckets, kept.hot_rows, named_users=1)
    wanted = logins.where("user_id IN ('user3', 'user5')")
    joined = many.of_users(wanted)
    text = plan(joined.hint("merge"))[0]
    assert not re.search(r"Exchange[^\n]*\n[^\n]*(Project|Filter)?[^\n]*\n?[^\n]*login_events_", text)
    assert rows_of(joined, "event_id") == rows_of(wanted, "event_id")


def test_named_users_open_their_buckets_only(spark, logins, kept):
    wanted = logins.where("user_id IN ('user3', 'user5')")
    newest = kept.latest(5, users=wanted)
    buckets = {r.b for r in wanted.select(F.pmod(F.hash("user_id"), F.lit(16)).alias("b")).distinct().collect()}
    assert f"SelectedBucketsCount: {len(buckets)} out of 16" in plan(newest)[1]
    assert rows_of(newest, "event_id") == rows_of(latest(wanted, 5), "event_id")
    rows = kept.of_users(wanted)
    assert rows_of(rows, "event_id") == rows_of(wanted, "event_id")
    assert {int(re.search(r"_(\d{5})\.c", f).group(1)) for f in rows.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == buckets
    assert kept.of_users(logins.limit(0)).count() == 0


def test_batches_are_replaced_and_compacted(spark, logins, kept):
    events = login_events(logins)
    kept.append(events.where("event_id % 3 = 2"), 2)  # a second attempt
    assert rows_of(kept.events(), "event_id") == rows_of(logins, "event_id")
    assert kept.events(0).count() == logins.where("event_id % 3 = 0").count() and kept.batch(1).count() == logins.where("event_id % 3 = 1").count()
    kept.compact(1)
    again = EventStore.open(spark, kept.path, buckets=99)
    assert again.buckets == 16 and rows_of(again.events(), "event_id") == rows_of(logins, "event_id")
    assert sorted(os.listdir(f"{kept.path.replace('file:', '')}/events")) [:1] and not os.path.exists(f"{kept.path}/events/batch_id=0")
    assert "Exchange" not in plan(again.latest(5))[0]


def test_a_compaction_that_fails_is_finished_on_opening(spark, logins, kept, monkeypatch):
    def fail(*a):
        raise RuntimeError("lost")
    monkeypatch.setattr(event_store, "_delete", fail)
    with pytest.raises(RuntimeError):
        kept.compact(2)
    monkeypatch.undo()
    assert rows_of(EventStore.open(spark, kept.path).events(), "event_id") == rows_of(logins, "event_id")


def test_hot_users_leave_their_bucket(spark, logins):
    store = EventStore.open(spark, run_dir(spark, "events"), buckets=4, hot_rows=40)
    events = login_events(logins)
    for i in range(4):
        store.append(events.where(F.col("event_id") % 4 == i), i)
    totals = {r.user_id: r.total_logins for r in profiles.user_totals(logins).collect()}
    assert {r.user_id for r in store.hot_users().collect()} == {u for u, n in totals.items() if n > 40}
    most = store.ordinary().groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert most <= 40 and rows_of(store.events(), "event_id") == rows_of(logins, "event_id")
    assert rows_of(store.latest(5), "event_id") == rows_of(latest(logins, 5), "event_id")
    assert rows_of(store.of_users(logins.where("user_id = 'user3'")), "event_id") == rows_of(logins.where("user_id = 'user3'"), "event_id")
    assert store.batch(2).count() == logins.where("event_id % 4 = 2").count()
    store.compact(3)
    assert rows_of(store.events(), "event_id") == rows_of(logins, "event_id")


def test_repeats_of_any_age_are_unseen_no_more(spark, logins, kept):
    """Ids decide: an altered time, place or user does not hide a repeat; the ids are not shuffled."""
    again = login_events(logins.limit(7)).withColumns({
        "timestamp": F.expr("timestamp + INTERVAL 400 DAYS"), "user_id": F.lit("somebody else"), "latitude": F.lit(0.5)})
    new = again.limit(2).withColumn("event_id", F.col("event_id") + 10_000_000)
    batch = again.unionByName(new)
    assert kept.unseen(batch).select("event_id").distinct().count() == 2
    first = {r.event_id for r in kept.batch(0).select("event_id").collect()}
    assert kept.unseen(batch, 0).where(~F.col("event_id").isin(list(first))).count() == kept.unseen(batch, 0).count()
    many = EventStore(spark, kept.path, kept.buckets, kept.hot_rows, named_users=1).unseen(batch)
    assert many.select("event_id").distinct().count() == 2
    ids = kept._table("ids").where(F.col("event_id").isin([r.event_id for r in again.collect()]))
    assert ids.count() == again.count()
    opened = {f for (f,) in ids.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(opened) <= 7 < len(kept._table("ids").inputFiles())


def flat(profile):
    return {r.user_id: tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in profiles.flat_profile(profile).collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder.replace("file:", "")) for f in files)


def commit(log, batch, version, previous):
    added = increments_after(batch, log, previous)
    before = {n: log.read(n, previous) if previous is not None else added[n].limit(0) for n in ("gap_counts", "coordinates")}
    metrics = profiles.touched_metrics(added, before["gap_counts"], before["coordinates"])
    patterns = batch.groupBy("user_id").agg(F.lit(version).alias("cluster"))
    log.commit(version, added, {**metrics, "patterns": patterns})


def test_five_batches_equal_a_rebuild(spark, logins, monkeypatch):
    """One batch is committed twice, one fails half-way first; a compaction lies between."""
    log = ProfileLog(spark, run_dir(spark, "log"))
    batch = [logins.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i) for i in range(5)]
    for i in range(5):
        if i == 2:
            with monkeypatch.context() as m:
                m.setattr(ProfileLog, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    commit(log, batch[i], i, i - 1)
            assert log.versions() == [0, 1]
        commit(log, batch[i], i, i - 1 if i else None)
        if i == 1:
            commit(log, batch[i], i, 0)
        if i == 3:
            log.compact(2)
            assert log.versions() == [2, 3]
    so_far = lambda n: logins.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) <= n)
    for version in (1, 2, 4):
        assert flat(log.profile(version)) == flat(profiles.build_profile(so_far(version)))
    last = {r.user_id: r.cluster for r in log.patterns().collect()}
    assert len(last) == log.patterns().count() == log.read("totals").count() and set(last.values()) <= set(range(5))
    few = logins.where("user_id IN ('user3', 'user5')")
    assert {r.user_id for r in log.patterns(users=few).collect()} == {"user3", "user5"} == {
        r.user_id for r in log.profile(users=few).gaps.collect()}
    log.compact(4)
    before = size(f"{log.path}/data")
    log.vacuum()
    assert size(f"{log.path}/data") < before / 2 and log.versions() == [4]
    assert flat(log.profile()) == flat(profiles.build_profile(logins))


def test_a_batch_writes_what_it_changes(spark, logins):
    log = ProfileLog(spark, run_dir(spark, "log"))
    commit(log, logins, 0, None)
    first = size(f"{log.path}/data")
    small = logins.limit(3).withColumn("event_id", F.col("event_id") + 10_000_000)
    commit(log, small.coalesce(1), 1, 0)
    rows = {n: sum(spark.read.parquet(f"{c['folder']}/{n}").count() for c in log._commits(None) if c["version"] == 1)
            for n in ("totals", "devices", "gaps", "times")}
    assert rows["totals"] == rows["gaps"] <= 3 and rows["devices"] <= 3 and rows["times"] <= 3 and first > 0


def test_nothing_committed_reads_as_none(spark):
    log = ProfileLog(spark, run_dir(spark, "log"))
    assert log.read("totals") is None and log.versions() == [] and log.patterns() is None
    log.vacuum()
    with pytest.raises(ValueError):
        EventStore.open(spark, run_dir(spark, "events")).events()


def test_stream_replay_equals_one_replay(spark, logins):
    """Micro-batches of a store's users, one with late and repeated logins, against the replay of all at once."""
    few = logins.where("user_id IN ('user0', 'user1', 'user2', 'user3')").drop("ip_address")
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    past, rest = few.where(F.col("timestamp") < at("12")), few.where(F.col("timestamp") >= at("12"))
    work = run_dir(spark, "replay")
    process_logins(past, f"{work}/store", 0, None, buckets=4)
    parts = [rest.where(F.col("timestamp") < at("18")), rest.where(F.col("timestamp") >= at("18"))]
    parts[1] = parts[1].unionByName(parts[0].limit(5))  # delivered again
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = spark.readStream.schema(rest.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    writer = stream_replay(stream, f"{work}/store", f"{work}/out", f"{work}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    log = ProfileLog(spark, f"{work}/store")
    assert log.versions() == [0, 1, 2] and log.written("patterns") == [0]
    whole = seeded.replay_from_snapshot(rest, seeded.Seed.of(past), log.patterns(0), past)
    columns = ["event_id", "stored", "total_logins", "device_count", "hour_count", "day_count", "velocity_score"]
    got = spark.read.parquet(f"{work}/out")
    assert rows_of(got, *columns) == rows_of(whole, *columns) and got.where("stored").count() > 50
    scores = lambda df: {r.event_id: tuple(round(r[c], 9) for c in df.columns if c.endswith("_score")) for r in df.collect()}
    assert scores(got) == scores(whole)
    assert flat(log.profile())["user0"][:2] == flat(profiles.build_profile(few))["user0"][:2]
    stored = EventStore.open(spark, f"{work}/store").batch(2)
    assert stored.count() == parts[1].select("event_id").distinct().count() - 5
    assert {r.event_id for r in stored.where("is_anomalous").collect()} == {
        r.event_id for r in got.where("is_anomalous AND part = 1").collect()}


def test_verdicts_with_details_are_not_broadcast(spark, make):
    rows = make([(e, "a", "2024-01-01 10:00:00", 10.0, 20.0, "d") for e in range(3)])
    results = spark.createDataFrame([(0, True, 0.9, ("known",)), (2, False, 0.1, ("new",))],
                                    "event_id long, is_anomalous boolean, combined_score double, device_details struct<device_status string>")
    stored = login_events(rows, results)
    got = sorted(tuple(r) for r in stored.select("event_id", "is_anomalous", "anomaly_score", "details").collect())
    assert got == [(0, True, 0.9, '{"device_details":{"device_status":"known"}}'), (1, False, 0.0, None),
                   (2, False, 0.1, '{"device_details":{"device_status":"new"}}')]
    assert "Broadcast" not in stored._jdf.queryExecution().executedPlan().toString()
