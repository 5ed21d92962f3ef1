import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from loginlens.operators import mergeable, profiles
from loginlens.operators.segments import SkewPolicy


def plain_gaps(times):
    times = sorted(times)
    out = {}
    for a, b in zip(times, times[1:]):
        out[b - a] = out.get(b - a, 0) + 1
    return out


def counts(df):
    return {(r.user_id, r.gap_us): r.times for r in df.collect()}


def metrics(df):
    return {r.user_id: tuple(None if v is None else round(v, 6) for v in tuple(r)[1:]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_spliced_counts_equal_all_counts(spark, seed):
    """Random batches of random users, in order, late and overlapping, against the gaps of all times."""
    rng = random.Random(seed)
    hour = 3_600_000_000
    batches = [[(rng.choice("abcd"), rng.choice([rng.randrange(0, 6 * hour), rng.randrange(0, 400) * hour // 7]))
                for _ in range(rng.choice([1, 8, 40]))] for _ in range(4)]
    made = spark.createDataFrame([(i, e, u, t) for i, rows in enumerate(batches) for e, (u, t) in enumerate(rows)],
                                 "batch int, event_id long, user_id string, us long")
    made = made.withColumn("timestamp", F.expr("timestampadd(MICROSECOND, us, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    done = None
    for i in range(len(batches)):
        batch = made.where(f"batch = {i}")
        if done is None:
            totals, times, held = profiles.user_totals(batch), mergeable.login_times(batch), mergeable.gap_counts(batch)
        else:
            held = mergeable.merge_gap_counts(held.unionByName(mergeable.gap_changes(batch, totals, times)))
            times = mergeable.merge_times(times.unionByName(mergeable.login_times(batch)))
            totals = profiles.merge_totals(totals.unionByName(profiles.user_totals(batch)))
        done = [r for rows in batches[:i + 1] for r in rows]
        want = {(u, g): n for u in "abcd" for g, n in plain_gaps([t for w, t in done if w == u]).items()}
        assert counts(held) == want


def test_metrics_equal_those_of_the_events(logins):
    hot = SkewPolicy(share=0.01, min_rows=20)
    counted = mergeable.gap_counts(logins)
    assert counts(counted) == counts(mergeable.gap_counts(logins, hot))
    gaps = mergeable.gaps_of(counted, profiles.user_totals(logins))
    assert metrics(gaps) == metrics(profiles.login_gaps(logins).select(*gaps.columns))
    spread = mergeable.spread_of(mergeable.coordinates(logins), profiles.SPREAD_FIELDS)
    assert metrics(spread) == metrics(profiles.geo_variance(logins).select(*spread.columns))


def test_one_login_has_no_gap(make):
    one = make([(1, "a", "2024-01-01 00:00:00", 1.0, 2.0, "d")])
    assert tuple(mergeable.gaps_of(mergeable.gap_counts(one), profiles.user_totals(one)).first()) == ("a",) + (None,) * 5
    assert mergeable.spread_of(mergeable.coordinates(one), profiles.SPREAD_FIELDS).first().standard_distance == 0.0
    again = profiles.merge_profiles(profiles.build_profile(one), one.withColumn("event_id", F.lit(2).cast("bigint")))
    assert again.gaps.first().mean_gap_h == 0.0 and again.totals.first().total_logins == 2


@pytest.mark.parametrize("slices", [1, 4])
def test_merged_profile_equals_rebuilt_one(logins, slices):
    """Batches dealt by event id overlap each other wholly in time."""
    merged = None
    for i in range(slices + 1):
        batch = logins.where(F.pmod(F.xxhash64("event_id"), F.lit(slices + 1)) == i)
        merged = profiles.build_profile(batch) if merged is None else profiles.merge_profiles(merged, batch)
    whole = profiles.build_profile(logins)
    for part in ("totals", "devices", "locations", "hours", "days", "gap_counts", "times", "coordinates"):
        a = getattr(whole, part)
        assert rows_of(a) == rows_of(getattr(merged, part), *a.columns), part
    for part in ("gaps", "spread"):
        a = getattr(whole, part)
        assert metrics(a) == metrics(getattr(merged, part).select(*a.columns)), part
