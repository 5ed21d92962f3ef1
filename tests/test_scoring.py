import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from loginlens.operators import outliers, patterns, profiles, replay, scoring
from loginlens.operators.segments import SkewPolicy
from loginlens.schema import WEIGHTS

CUT = "2024-01-20"


@pytest.fixture(scope="module")
def past(logins):
    return logins.where(F.col("timestamp") < F.lit(CUT).cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def fresh(logins):
    return logins.where(F.col("timestamp") >= F.lit(CUT).cast("timestamp_ntz"))


def history(n):
    return [(e, "a", f"2024-01-{e + 1:02d} {e % 5 + 8:02d}:00:00", 10 + e % 3 * 0.01, 20 + e % 4 * 0.01, "d")
            for e in range(n)]


def one_cluster(df):
    return patterns.cluster_stats(df.withColumn("cluster", F.lit(0)))


def analyze(make, past_rows, login, **args):
    past = make(past_rows)
    return scoring.analyze_logins(make([login]), profiles.build_profile(past), one_cluster(past), past, **args).first()


def test_unknown_user_is_neutral_and_not_stored(make):
    row = analyze(make, history(12), (99, "b", "2024-02-01 09:00:00", 1.0, 1.0, "d"))
    assert all(row[f"{n}_score"] == 0.5 for n in WEIGHTS) and row.combined_score == pytest.approx(0.5)
    assert not row.is_anomalous and not row.stored
    assert row.location_details.message == "too_few_logins"


@pytest.mark.parametrize("n,scored", [(9, False), (10, True)])
def test_advanced_gate(make, n, scored):
    row = analyze(make, history(n), (99, "a", "2024-02-01 09:00:00", 10.0, 20.0, "d"))
    assert (row.mahalanobis_details.message is None) is scored
    assert (row.isolation_forest_details.message is None) is scored
    if not scored:
        assert row.mahalanobis_score == row.isolation_forest_score == 0.5


def test_devices(make):
    past = [(e, "a", f"2024-01-01 10:{e:02d}:00", 1.0, 1.0, "rare" if e == 0 else "usual") for e in range(20)]
    rows = make([(90, "a", "2024-02-01 00:00:00", 1.0, 1.0, d) for d in ("rare",)]
                + [(91, "a", "2024-02-01 00:00:00", 1.0, 1.0, "unseen"), (92, "a", "2024-02-01 00:00:00", 1.0, 1.0, None)])
    out = {r.event_id: r for r in scoring.with_device(rows, profiles.user_devices(make(past))).collect()}
    assert out[90].device_score == pytest.approx(0.95) and out[91].device_score == 0.9
    assert out[92].device_score == 0.9 and out[92].device_details.device_status == "error"


def test_late_login_and_unknown_place(make):
    past = make(history(3))
    rows = make([(90, "a", "2024-01-02 00:00:00", 80.0, 80.0, "d"), (91, "zz", "2024-01-02 00:00:00", 80.0, 80.0, "d")])
    out = {r.event_id: r for r in scoring.with_velocity(rows, profiles.build_profile(past)).collect()}
    assert out[90].velocity_score == 1.0 and out[90].velocity_details.message == "not_after_last_login"
    assert out[91].velocity_score == 0.0


def test_nearest_cluster_prefers_the_lower_number(spark, make):
    clusters = spark.createDataFrame([("a", 1, 0.0, 1.0, 5.0), ("a", 0, 0.0, -1.0, 2.0)],
                                     "user_id string, cluster int, center_lat double, center_lon double, std_distance double")
    row = scoring.with_location(make([(1, "a", "2024-01-01 00:00:00", 0.0, 0.0, "d")]), clusters).first()
    assert row.location_details.closest_cluster == 0


def test_scores_stay_in_range_and_weights_sum_to_one(past, fresh):
    assert sum(WEIGHTS.values()) == pytest.approx(1)
    out = scoring.analyze_logins(fresh, profiles.build_profile(past), one_cluster(past), past)
    bounds = out.agg(*[f(f"{n}_score").alias(f"{f.__name__}_{n}") for n in WEIGHTS for f in (F.min, F.max)]).first()
    assert min(bounds) >= 0 and max(bounds) <= 1 and out.count() == fresh.count()


def test_skewed_plan_scores_the_same(past, fresh):
    profile, clusters = profiles.build_profile(past), one_cluster(past)
    columns = ("event_id", "combined_score", "is_anomalous", "stored")
    plain = scoring.analyze_logins(fresh, profile, clusters, past, isolation=False)
    split = scoring.analyze_logins(fresh, profile, clusters, past, isolation=False,
                                   skew=SkewPolicy(share=0.01, min_rows=5))
    assert rows_of(plain, *columns) == rows_of(split, *columns)


def test_replay_of_the_last_login_equals_the_batch_score(logins):
    last = logins.groupBy("user_id").agg(F.max(F.struct("timestamp", "event_id")).alias("m"))
    last = last.select(F.col("m.event_id").alias("event_id"))
    before, latest_rows = logins.join(last, "event_id", "left_anti"), logins.join(last, "event_id", "left_semi")
    p = profiles.build_profile(before)
    batch = scoring.with_device(scoring.with_velocity(latest_rows, p), p.devices)
    batch = batch.join(scoring.with_time(latest_rows, p).select("event_id", "time_score"), "event_id")
    columns = ("event_id", "device_score", "time_score", "velocity_score")
    replayed = replay.replay_scores(logins).join(last, "event_id", "left_semi")
    assert rows_of(batch, *columns) == rows_of(replayed, *columns)


def test_mahalanobis_matches_numpy(make):
    past = history(15)
    row = analyze(make, past, (99, "a", "2024-02-01 20:00:00", 10.05, 20.0, "d"))
    x = np.array([[r[3], r[4], float(r[2][11:13])] for r in past])
    delta = np.array([10.05, 20.0, 20.0]) - x.mean(axis=0)
    distance = np.sqrt(delta @ np.linalg.inv(np.cov(x.T)) @ delta)
    assert row.mahalanobis_details.mahalanobis_distance == pytest.approx(distance, rel=1e-6)
    model = outliers.mahalanobis_model(make(past))
    squared = outliers.with_mahalanobis(make([(99, "a", "2024-02-01 20:00:00", 10.05, 20.0, "d")]), model, squared=True)
    assert squared.first().mahalanobis_score > row.mahalanobis_score


def test_degenerate_covariance_is_regularised(make):
    past = [(e, "a", f"2024-01-{e + 1:02d} 09:00:00", 10.0, 20.0, "d") for e in range(12)]
    row = analyze(make, past, (99, "a", "2024-02-01 09:00:00", 10.0, 20.0, "d"))
    assert row.mahalanobis_details.degenerate and row.mahalanobis_score == pytest.approx(0.0, abs=1e-6)


def test_isolation_forest_ranks_a_planted_outlier_and_repeats(make):
    rng = np.random.default_rng(1)
    past = [(e, "a", f"2024-01-{e % 28 + 1:02d} 09:00:00", float(10 + rng.normal(0, .01)), float(20 + rng.normal(0, .01)), "d")
            for e in range(80)]
    rows = make([(90, "a", "2024-02-05 09:00:00", 10.0, 20.0, "d"), (91, "a", "2024-02-05 03:00:00", 50.0, -100.0, "new")])
    history_rows = make(past)
    first = {r.event_id: r.isolation_forest_score for r in outliers.isolation_forest_scores(rows, history_rows).collect()}
    again = {r.event_id: r.isolation_forest_score
             for r in outliers.isolation_forest_scores(rows, history_rows.repartition(5), chunk_rows=1).collect()}
    assert first == again and first[91] > first[90]


def test_isolation_forest_marks_about_a_tenth(logins):
    out = outliers.isolation_forest_scores(logins, logins)
    share = out.agg(F.avg((F.col("raw_score") < 0).cast("double"))).first()[0]
    assert 0.05 < share < 0.15


def moved(n):
    """A user's history whose last 1,000 logins come from elsewhere, and features of it as the forest takes them."""
    start = dt.datetime(2024, 1, 1)
    old = n - 1000
    return [(e, "a", str(start + dt.timedelta(hours=e)), 10.0 + e % 7 / 100 if e < old else 50.0 + e % 7 / 100,
             20.0 + e % 11 / 100, "old" if e < old else "new") for e in range(n)]


def forest_inputs(rows):
    when = [dt.datetime.fromisoformat(r[2]) for r in rows]
    turn = lambda x, n: (np.sin(2 * np.pi * np.array(x) / n), np.cos(2 * np.pi * np.array(x) / n))
    numeric = np.column_stack([[r[3] for r in rows], [r[4] for r in rows], *turn([t.hour for t in when], 24), *turn([t.weekday() for t in when], 7)])
    return numeric, np.array([["old", "new", "other"].index(r[5]) for r in rows])


def asked_of(rows):
    return [(9000, *rows[5][1:]), (9001, *rows[-5][1:]), (9002, "a", "2024-05-05 05:00:00", -30.0, 100.0, "other")]


def test_isolation_forest_learns_from_the_whole_history(make):
    past = moved(1400)
    asked = asked_of(past)
    forest = outliers.IsolationForest(*forest_inputs(past), outliers._seed("a"))
    numeric, codes = forest_inputs(asked)
    want = dict(zip((9000, 9001, 9002), forest.decision(numeric, np.where(codes == 2, -1, codes))))
    got = {r.event_id: r.raw_score for r in outliers.isolation_forest_scores(make(asked), make(past)).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_long_histories_are_learnt_in_parts(make):
    past = moved(1400)
    other = [(e + 5000, "b", t, lat, lon, d) for e, _, t, lat, lon, d in past[:30]]
    asked = [*asked_of(past), (9003, "b", *past[3][2:])]
    numeric, codes = forest_inputs(past)
    drawn = outliers._drawn("a", len(past), 100, 256)
    assert all(len(set(d)) == 256 for d in drawn.tolist()) and drawn.max() >= 1300 and drawn.min() < 100
    forest = outliers.IsolationForest(numeric, codes, outliers._seed("a"), drawn=drawn)
    offset = np.percentile(forest.scores(numeric, codes), 10)
    numeric, codes = forest_inputs(asked_of(past))
    want = dict(zip((9000, 9001, 9002), forest.scores(numeric, codes) - offset))
    rows, history_rows = make(asked), make(past + other)
    plain = {r.event_id: r.raw_score for r in outliers.isolation_forest_scores(rows, history_rows).collect()}
    for skew in (outliers.SKEW, SkewPolicy(share=0.1, min_rows=50)):
        got = {r.event_id: r.raw_score for r in outliers.isolation_forest_scores(
            rows, history_rows, skew, chunk_rows=300, learn_rows=500).collect()}
        assert got == pytest.approx({**want, 9003: plain[9003]}, abs=1e-9)


def test_threshold_of_counted_scores_is_the_percentile(spark):
    rng = np.random.default_rng(3)
    users = {"many": -rng.random(5000), "few": -rng.random(11), "same": np.full(40, -0.5), "two": np.r_[np.full(4, -0.7), np.full(36, -0.3)],
             "edge": np.r_[-0.9, np.full(9, -0.4), -0.35]}
    known = spark.createDataFrame([(u, float(x)) for u, xs in users.items() for x in xs], "user_id string, score double")
    sizes = spark.createDataFrame([(u, len(xs)) for u, xs in users.items()], "user_id string, _n long")
    got = {r.user_id: r.offset for r in outliers._offsets(known, sizes, 0.1).collect()}
    assert got == pytest.approx({u: np.percentile(xs, 10) for u, xs in users.items()}, abs=1e-12)
