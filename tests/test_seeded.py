import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from loginlens.operators import profiles, seeded
from loginlens.operators.identify import identify_patterns
from loginlens.operators.outliers import isolation_forest_scores
from loginlens.operators.segments import SKEW, SkewPolicy, join_per_key
from loginlens.session import durable

SCORES = ("location_score", "device_score", "time_score", "velocity_score", "isolation_forest_score", "mahalanobis_score")
TIERS = ((1000, 1.0), (800, 0.9), (300, 0.6), (150, 0.3), (80, 0.1))


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return round(6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - min(h, 1))), 2)


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


class Keeper:
    """One user's state, moved on login by login."""

    def __init__(self):
        self.n, self.last, self.devices, self.hours, self.days, self.cells, self.points = 0, None, Counter(), Counter(), Counter(), {}, []

    def add(self, r):
        self.n += 1
        self.devices[r.device_id] += 1
        self.hours[r.timestamp.hour] += 1
        self.days[r.timestamp.weekday()] += 1
        cell = (half_up(r.latitude * 1000), half_up(r.longitude * 1000))
        kept = self.cells.setdefault(cell, [r.latitude, r.longitude, r.timestamp])
        kept[2] = max(kept[2], r.timestamp)
        if self.last is None or r.timestamp >= self.last[0]:
            self.last = (r.timestamp, kept[0], kept[1])
        self.points.append((half_up(r.latitude * 1e6) / 1e6, half_up(r.longitude * 1e6) / 1e6, r.timestamp.hour))

    def scores(self, r):
        used = self.devices[r.device_id]
        device = 1 - used / self.n if used else 0.9
        time = 1 - (0.7 * self.hours[r.timestamp.hour] / self.n + 0.3 * self.days[r.timestamp.weekday()] / self.n)
        hours = (r.timestamp - self.last[0]).total_seconds() / 3600
        speed = km(self.last[1], self.last[2], r.latitude, r.longitude) / hours if hours > 0 else math.inf
        velocity = next((s for above, s in TIERS if speed > above), 0.0)
        distance = None
        if self.n >= 10:
            x = np.array(self.points)
            cov, off = np.cov(x.T), np.array([r.latitude, r.longitude, r.timestamp.hour]) - x.mean(axis=0)
            if np.linalg.matrix_rank(cov, hermitian=True) == 3 and np.linalg.cond(cov) < 1e10:
                distance = math.sqrt(off @ np.linalg.solve(cov, off))
        return device, time, velocity, distance


@pytest.fixture(scope="module")
def cut(logins):
    times = logins.select(F.percentile_approx(F.unix_micros(F.col("timestamp").cast("timestamp")), [0.4, 0.7]).alias("q")).first().q
    return [dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=m) for m in times]


def between(rows, low, high):
    for moment, keep in ((low, ">="), (high, "<")):
        if moment is not None:
            rows = rows.where(f"timestamp {keep} TIMESTAMP_NTZ'{moment.isoformat(sep=' ')}'")
    return rows


@pytest.fixture(scope="module")
def replayed(logins, cut):
    past = between(logins, None, cut[0])
    patterns = durable(identify_patterns(past))
    return past, patterns, durable(seeded.replay_from_snapshot(between(logins, cut[0], None), seeded.Seed.of(past), patterns, past))


def by_event(rows, *columns):
    return {r.event_id: tuple(None if r[c] is None else round(r[c], 9) for c in columns) for r in rows.collect()}


def test_equals_a_state_machine(logins, cut, replayed):
    past, patterns, out = replayed
    known = {r.user_id for r in past.select("user_id").distinct().collect()} & {r.user_id for r in patterns.collect()}
    state, got, checked = defaultdict(Keeper), {r.event_id: r for r in out.collect()}, Counter()
    for r in past.orderBy("timestamp", "event_id").collect():
        state[r.user_id].add(r)
    fresh = between(logins, cut[0], None).orderBy("timestamp", "event_id").collect()
    assert len(got) == len(fresh)
    for r in fresh:
        found = got[r.event_id]
        assert found.stored == (r.user_id in known)
        if not found.stored:
            assert [found[s] for s in SCORES] == [0.5] * 6 and found.combined_score == 0.5
            continue
        device, time, velocity, distance = state[r.user_id].scores(r)
        assert found.total_logins == state[r.user_id].n
        assert (found.device_score, found.time_score) == pytest.approx((device, time), abs=1e-9)
        assert found.velocity_score == velocity
        if distance is not None and found.mahalanobis_details.degenerate is False:
            assert found.mahalanobis_details.mahalanobis_distance == pytest.approx(distance, rel=1e-5)
            checked["distance"] += 1
        checked["rows"] += 1
        state[r.user_id].add(r)
    assert checked["rows"] > 300 and checked["distance"] > 100


def test_two_runs_equal_one(logins, cut, replayed):
    """The last part, seeded by the state after the middle part, scores as it does in the run over both."""
    past, patterns, whole = replayed
    middle, last = between(logins, cut[0], cut[1]), between(logins, cut[1], None)
    accepted = middle.join(whole.where("stored").select("event_id"), "event_id", "left_semi")
    again = seeded.replay_from_snapshot(last, seeded.Seed.of(past).advanced(accepted), patterns, past)
    columns = ("stored", "combined_score", "total_logins", "device_count", "hour_count", "day_count", *SCORES)
    want = by_event(between(whole, cut[1], None), *columns)
    assert by_event(again, *columns) == want and len(want) > 100


def test_hot_users_score_alike(logins, cut, replayed):
    past, patterns, whole = replayed
    hot = SkewPolicy(share=0.01, min_rows=20)
    again = seeded.replay_from_snapshot(between(logins, cut[0], None), seeded.Seed.of(past, hot), patterns, past, skew=hot)
    columns = ("stored", "combined_score", "total_logins", "device_count", "hour_count", "day_count", *SCORES)
    assert by_event(again, *columns) == by_event(whole, *columns)


def test_crowded_devices_join_alike(logins):
    hot = SkewPolicy(share=0.01, min_rows=20)
    devices = profiles.user_devices(logins)
    plain, split = (join_per_key(logins, devices, ["device_id"], s) for s in (SKEW, hot))
    assert rows_of(plain) == rows_of(split, *plain.columns)
    stranger = logins.withColumn("device_id", F.when(F.col("event_id") % 2 == 0, F.lit("new")).otherwise(F.col("device_id")))
    plain, split = (join_per_key(stranger, devices, ["device_id"], s) for s in (SKEW, hot))
    assert rows_of(plain) == rows_of(split, *plain.columns)


def test_versions_in_force(logins, cut):
    """Each login meets the newest patterns before it, and a forest of the events before those."""
    first, second = (identify_patterns(between(logins, None, c)) for c in cut)
    both = durable(first.withColumn("since", F.lit(cut[0])).unionByName(second.withColumn("since", F.lit(cut[1]))))
    past = between(logins, None, cut[0])
    out = durable(seeded.replay_from_snapshot(between(logins, cut[0], None), seeded.Seed.of(past), both, logins))
    centres = defaultdict(list)
    for c in both.collect():
        centres[c.user_id, c.since].append((c.center_lat, c.center_lon, c.cluster))
    for r in out.where("stored").collect():
        since = max(s for u, s in centres if u == r.user_id and s <= r.timestamp)
        near = min((km(a, b, r.latitude, r.longitude), c) for a, b, c in centres[r.user_id, since])
        assert (r.location_details.distance_km, r.location_details.closest_cluster) == (pytest.approx(near[0], abs=0.011), near[1])
    newest = between(out.where("stored"), cut[1], None)
    want = by_event(isolation_forest_scores(newest, between(logins, None, cut[1])), "isolation_forest_score")
    assert by_event(newest, "isolation_forest_score") == want and len(want) > 50
    early = between(logins, None, cut[0]).limit(40)
    assert {r.stored for r in seeded.replay_from_snapshot(early, seeded.Seed.of(past), both).collect()} == {False}


def test_late_and_first_logins(make, spark):
    """A login before the snapshot's last one is late; a known cell keeps its first coordinates; repeats of an id stay."""
    past = make([(i, "a", f"2024-01-{i:02d} 10:00:00", 10.0001, 20.0001, "d") for i in range(1, 11)])
    fresh = make([(20, "a", "2024-01-05 10:00:00", 50.0, 20.0, "e"), (21, "a", "2024-01-10 12:00:00", 10.0004, 20.0004, "d"),
                  (21, "a", "2024-01-10 13:00:00", 10.0002, 20.0002, "e"), (22, "b", "2024-01-10 13:00:00", 1.0, 2.0, "e")])
    patterns = spark.createDataFrame([("a", 0, 10.0, 20.0, 5.0)], "user_id string, cluster int, center_lat double, center_lon double, std_distance double")
    rows = seeded.replay_from_snapshot(fresh, seeded.Seed.of(past), patterns).orderBy("timestamp", "event_id", "user_id").collect()
    assert [(r.event_id, r.total_logins, r.device_count, r.velocity_score) for r in rows[:3]] == [
        (20, 10, 0, 1.0), (21, 11, 10, 0.0), (21, 12, 1, 0.0)]
    assert rows[1].velocity_details.prev_lat == 10.0001 and rows[2].velocity_details.prev_lat == 10.0001
    assert rows[2].velocity_details.time_diff_hours == 1.0 and not rows[3].stored
    assert seeded.replay_from_snapshot(fresh.limit(0), seeded.Seed.of(past), patterns, past).count() == 0


def test_replay_keeps_its_partitions(spark, logins):
    """Partitions of little data but much work are not merged, or a task or two make the stage wait."""
    out = seeded.replay_from_snapshot(logins, seeded.Seed.of(logins), identify_patterns(logins).limit(0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
