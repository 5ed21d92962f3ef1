import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows_of
from loginlens.operators import chunks, layers, profiles, replay
from loginlens.operators.segments import Ordered, SkewPolicy, join_per_user, latest
from loginlens.plans import catalog

HOT = SkewPolicy(share=0.01, min_rows=5)


def test_one_login(make):
    one = make([(1, "a", "2024-01-01 10:00:00", 10.0, 20.0, "d")])
    flat = profiles.flat_profile(profiles.build_profile(one)).first()
    assert flat.total_logins == 1 and flat.standard_distance == 0.0
    assert flat.mean_gap_h is None and flat.median_gap_h is None


def test_gap_statistics(make):
    df = make([(i, "a", t, 0.0, 0.0, "d") for i, t in enumerate(
        ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 04:00:00", "2024-01-01 04:00:00"])])
    g = profiles.login_gaps(df).first()
    assert (g.mean_gap_h, g.min_gap_h, g.max_gap_h, g.median_gap_h) == (pytest.approx(4 / 3), 0.0, 3.0, 1.0)
    assert g.std_gap_h == pytest.approx(math.sqrt(((1 - 4 / 3) ** 2 + (3 - 4 / 3) ** 2 + (4 / 3) ** 2) / 3))


def test_antimeridian_pair(make):
    df = make([(1, "a", "2024-01-01 00:00:00", 0.0, 179.9, "d"), (2, "a", "2024-01-01 01:00:00", 0.0, -179.9, "d")])
    assert {round(r.lon_unwrapped, 6) for r in profiles.shift_antimeridian(df).collect()} == {179.9, 180.1}
    spread = profiles.standard_distance(df, "user_id").first()
    assert abs(abs(spread.center_lon) - 180) < 1e-9 and spread.std_distance == pytest.approx(11.12)


def test_empty_table_centres_on_zero(make):
    empty = make([(1, "a", "2024-01-01 00:00:00", 1.0, 1.0, "d")]).limit(0)
    assert tuple(profiles.geo_mean_center(empty).first())[:2] == (0.0, 0.0)
    assert tuple(profiles.map_center(empty).first()) == (0.0, 0.0)


def test_location_keeps_first_coordinates(make):
    df = make([(2, "a", "2024-01-01 02:00:00", 1.0004, 2.0, "d"), (1, "a", "2024-01-01 01:00:00", 1.0001, 2.0, "d")])
    cell = profiles.user_locations(df).first()
    assert (cell["count"], cell.lat, cell.cell_lat) == (2, 1.0001, 1000)


@pytest.mark.parametrize("cut", ["2024-01-05", "2024-01-20"])
def test_merge_equals_rebuild(logins, cut):
    before = logins.where(F.col("timestamp") < F.lit(cut).cast("timestamp_ntz"))
    after = logins.where(F.col("timestamp") >= F.lit(cut).cast("timestamp_ntz"))
    whole = profiles.build_profile(logins)
    # Merging is symmetric in the counters, so a late batch gives the same.
    for old, batch in ((before, after), (after, before)):
        merged = profiles.merge_profiles(profiles.build_profile(old), batch, logins)
        for part in ("totals", "devices", "locations", "hours", "days"):
            a = getattr(whole, part)
            assert rows_of(a) == rows_of(getattr(merged, part), *a.columns), part
    gaps = {r.user_id: r.median_gap_h for r in whole.gaps.collect()}
    assert {r.user_id: r.median_gap_h for r in merged.gaps.collect()} == pytest.approx(gaps)


def test_skewed_plan_gives_the_same_results(logins):
    assert HOT.hot(logins).count() == 15
    assert SkewPolicy().hot(logins) is None
    assert Ordered.of(logins, HOT).rows.select("user_id", "segment").distinct().count() > 60
    for run in (profiles.gap_to_next, layers.trajectory_segments, replay.replay_state, replay.replay_scores,
                lambda d, *s: chunks.chunk_id(d, 7, *s), lambda d, *s: latest(d, 10, *s)):
        plain = run(logins)
        assert rows_of(plain) == rows_of(run(logins, HOT), *plain.columns)
    plain, split = profiles.login_gaps(logins), profiles.login_gaps(logins, HOT)
    a = {r.user_id: tuple(r)[1:] for r in plain.collect()}
    b = {r.user_id: tuple(r)[1:] for r in split.select(*plain.columns).collect()}
    assert a.keys() == b.keys() and all(a[u] == pytest.approx(b[u]) for u in a)


def test_salted_join_equals_plain_join(logins):
    totals = profiles.user_totals(logins).where("user_id <> 'user3'")
    for how in ("inner", "left"):
        plain = logins.join(totals, "user_id", how)
        assert rows_of(plain) == rows_of(join_per_user(logins, totals, HOT, how), *plain.columns)
    spread = {r.user_id: r.std_distance for r in profiles.standard_distance(logins, "user_id").collect()}
    salted = {r.user_id: r.std_distance for r in profiles.standard_distance(logins, "user_id", skew=HOT).collect()}
    assert spread == pytest.approx(salted)


def test_counters_from_one_pass(logins):
    counted = profiles.user_counters(logins)
    single = {"totals": profiles.user_totals, "devices": profiles.user_devices, "hours": profiles.user_hours,
              "days": profiles.user_days}
    for name, alone in single.items():
        want = alone(logins)
        assert rows_of(want) == rows_of(counted[name], *want.columns)


def test_one_user_with_a_third_of_all_rows(spark, logins):
    heavy = logins.where("user_id = 'user1'").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(7))))
    heavy = (heavy.withColumn("event_id", F.col("event_id") + F.col("copy") * 100000)
             .withColumn("timestamp", F.col("timestamp") + F.make_interval(secs=F.col("copy"))).drop("copy"))
    skewed = logins.where("user_id <> 'user1'").unionByName(heavy)
    policy = SkewPolicy(share=0.1, min_rows=50)
    assert [r.user_id for r in policy.hot(skewed).collect()] == ["user1"]
    assert rows_of(replay.replay_scores(skewed)) == rows_of(replay.replay_scores(skewed, policy))


def test_plain_profile_plan_is_native_and_joins_no_cross_product(logins):
    plan = replay.replay_scores(logins)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nested_profile_and_upsert(small):
    p = profiles.build_profile(small)
    row = profiles.nested_profile(p).where("user_id = 'user0'").first()
    assert sum(row.time_patterns.hour_distribution.values()) == row.total_logins
    assert set(row.behavioral_metrics.geo_variance.asDict()) == set(profiles.SPREAD_FIELDS)
    parts = profiles.nested_entries(p).where("user_id = 'user1'").collect()
    assert len(parts) > 1 and sum(len(r.locations or {}) for r in parts) == p.locations.where("user_id = 'user1'").count()
    mine = [r for r in profiles.nested_entries(p, buckets=3).where("user_id = 'user0'").collect()]
    assert sum(d["count"] for r in mine for d in (r.devices or {}).values()) == row.total_logins
    updates = p.totals.where("user_id = 'user1'").withColumn("total_logins", F.lit(1).cast("bigint"))
    after = {r.user_id: r.total_logins for r in profiles.upsert(p.totals, updates).collect()}
    assert after["user1"] == 1 and len(after) == 3


def test_whole_profile_reads_metrics_from_fixed_tables(logins):
    """Else windows, sorts and joins of all parts share one stage, and its tasks the memory of all."""
    lazy, whole = profiles.build_profile(logins), profiles.build_profile(logins, whole=True)
    plan = profiles.flat_profile(whole)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert rows_of(profiles.flat_profile(whole)) == rows_of(profiles.flat_profile(lazy))


def test_whole_profile_has_every_entry(spark, logins):
    whole = profiles.build_profile(logins, whole=True)
    flat = profiles.flat_profile(whole)
    got = profiles.with_entries(flat, whole)
    columns = {"device": profiles.user_devices, "location": profiles.user_locations, "hour": profiles.user_hours, "day": profiles.user_days}
    for part, table in columns.items():
        want = table(logins).drop("first_order")
        assert rows_of(got.where(F.col("part") == part), *want.columns) == rows_of(want, *want.columns)
    assert rows_of(got.where("part = 'user'"), *flat.columns) == rows_of(flat)


def test_user_profile_query_returns_the_entries(spark):
    rows = catalog.QUERIES["user_profile"](spark, SF).collect()
    per_user = {r.user_id: r for r in rows if r.part == "user"}
    for part, total in (("device", "devices"), ("location", "locations")):
        found = Counter(r.user_id for r in rows if r.part == part)
        assert found == {u: r[total] for u, r in per_user.items()}
    shares = Counter()
    for r in rows:
        shares[r.part, r.user_id] += r["count"] or 0
    assert all(shares[part, u] == r.total_logins for part in ("device", "location", "hour", "day") for u, r in per_user.items())
