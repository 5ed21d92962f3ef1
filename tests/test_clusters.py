import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from loginlens.operators import dbscan, identify, kmeans, patterns
from loginlens.operators.segments import SkewPolicy


def brute_force(rows, eps=0.5, min_samples=5):
    """Plain DBSCAN on the same standardised features with real one-hot columns."""
    rows = sorted(rows, key=lambda r: (r.timestamp, r.event_id))
    devices = sorted({r.device_id for r in rows})
    lon = np.array([r.longitude for r in rows])
    if len(rows) > 1 and lon.max() - lon.min() > 180:
        lon = np.where(lon < 0, lon + 360, lon)
    hour = np.array([r.timestamp.hour for r in rows])
    day = np.array([r.timestamp.weekday() for r in rows])
    x = np.column_stack([
        [r.latitude for r in rows], lon, np.sin(2 * np.pi * hour / 24), np.cos(2 * np.pi * hour / 24),
        np.sin(2 * np.pi * day / 7), np.cos(2 * np.pi * day / 7),
        *[[float(r.device_id == d) for r in rows] for d in devices]])
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std < 1e-12, 1, std)
    near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    labels, number = np.full(len(rows), -1), 0
    for i in range(len(rows)):
        if not core[i] or labels[i] != -1:
            continue
        labels[i], queue = number, [i]
        while queue:
            p = queue.pop()
            for q in np.flatnonzero(near[p]):
                if labels[q] == -1:
                    labels[q] = number
                    if core[q]:
                        queue.append(q)
        number += 1
    return {r.event_id: int(c) for r, c in zip(rows, labels)}


def check(df, **args):
    got = {r.event_id: r.cluster for r in dbscan.dbscan(df, **args).collect()}
    want, users = {}, {}
    for r in df.collect():
        users.setdefault(r.user_id, []).append(r)
    for rows in users.values():
        want.update(brute_force(rows, **args))
    assert got == want
    return got


def test_matches_brute_force_on_the_login_table(logins):
    labels = check(logins)
    assert sum(c != -1 for c in labels.values()) > 200


@pytest.mark.parametrize("eps", [0.1, 0.25, 0.7])
def test_matches_brute_force_where_cells_are_dense(make, eps):
    # Continuous coordinates in blobs a fraction of eps apart: dense cells whose boxes straddle eps.
    rng = np.random.default_rng(7)
    rows = []
    for e in range(900):
        blob = rng.integers(0, 6)
        lat, lon = 0.3 * blob + rng.normal(0, 0.08), 0.2 * blob + rng.normal(0, 0.15)
        day, hour = 1 + 7 * rng.integers(0, 3), 9 + rng.integers(0, 3)
        rows.append((e, "u", f"2024-01-{day:02d} {hour:02d}:{rng.integers(0, 60):02d}:00", float(lat), float(lon), "d"))
    labels = check(make(rows), eps=eps)
    assert len(set(labels.values())) > 1


def test_undecided_boxes_are_split(spark, make, monkeypatch):
    seen = []
    original = dbscan._decide
    def spy(pairs, members, side, eps):
        seen.append(pairs.where("NOT touch").count())
        return original(pairs, members, side, eps)
    monkeypatch.setattr(dbscan, "_decide", spy)
    rng = np.random.default_rng(3)
    rows = [(e, "u", f"2024-01-01 09:{e % 60:02d}:00", float(rng.uniform(0, 1)), float(rng.uniform(0, 1)), "d")
            for e in range(700)]
    check(make(rows), eps=0.2)
    assert seen[0] > 0


def test_labels_do_not_depend_on_partitioning(small):
    a = rows_of(dbscan.dbscan(small), "event_id", "cluster")
    b = rows_of(dbscan.dbscan(small.repartition(7, "event_id")), "event_id", "cluster")
    assert a == b


def test_skewed_plan_gives_the_same_clusters(small):
    hot = SkewPolicy(share=0.01, min_rows=5)
    assert rows_of(identify.label_logins(small), "event_id", "cluster") == rows_of(
        identify.label_logins(small, skew=hot), "event_id", "cluster")


def test_eps_limit(small):
    with pytest.raises(ValueError, match="eps"):
        dbscan.dbscan(small, eps=0.9)


def test_single_login_is_one_cluster(make):
    one = make([(1, "a", "2024-01-01 10:00:00", 10.0, 20.0, "d")])
    assert rows_of(identify.identify_patterns(one), "cluster", "count", "std_distance") == [(0, 1, 0.0)]


def test_large_users_fit_like_small_ones(logins):
    rows = logins.where("user_id IN ('user1', 'user4')").where(F.col("event_id") < 420)
    sites, fits = kmeans.kmeans_fits(rows)
    columns = ("user_id", "site", "k", "cluster")
    assert rows_of(fits.where("k <= 3"), *columns) == rows_of(kmeans._fit_large(sites, max_k=3), *columns)


def test_kmeans_separates_two_places(make):
    rows = [(e, "a", f"2024-01-01 10:{e:02d}:00", 10.0 + 40 * (e % 2) + e * 1e-3, 20.0, "d") for e in range(12)]
    sites, fits = kmeans.kmeans_fits(make(rows))
    two = {r.site: r.cluster for r in fits.where("k = 2").collect()}
    assert len({two[e] for e in range(0, 12, 2)}) == 1 and two[0] != two[1]


def test_elbow(spark):
    rows = [("a", 1, 100.0), ("a", 2, 40.0), ("a", 3, 30.0), ("a", 4, 25.0), ("b", 1, 9.0), ("b", 2, 1.0)]
    best = patterns.elbow_k(spark.createDataFrame(rows, "user_id string, k int, inertia double"))
    assert rows_of(best) == [("a", 2), ("b", 2)]


def test_cluster_stats_count_noise_in_the_denominator(make):
    rows = make([(e, "a", "2024-01-01 10:00:00", 10.0, 20.0, "d") for e in range(4)])
    labelled = rows.withColumn("cluster", F.when(F.col("event_id") < 3, 0).otherwise(-1))
    assert rows_of(patterns.cluster_stats(labelled), "cluster", "count", "percentage", "num_clusters") == [(0, 3, 75.0, 1)]


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_neighbours_do_not_depend_on_what_counts_as_a_small_group(make, monkeypatch, few):
    rng = np.random.default_rng(11)
    rows = [(e, f"u{e % 3}", f"2024-01-0{1 + e % 2} {9 + e % 3:02d}:{e % 60:02d}:00", float(rng.normal(0, 1)), float(rng.normal(0, 1)),
             f"d{e % 2}") for e in range(400)]
    monkeypatch.setattr(dbscan, "SMALL_GROUP", few)
    sites = dbscan.with_cell_weight(dbscan.scaled_sites(make(rows)))
    got = {(r.site.event_id, r.other.event_id) for r in dbscan.thin_neighbours(sites).collect()}
    found = sites.collect()
    same = lambda a, b: all(a[c] == b[c] for c in dbscan.GROUP)
    far = lambda a, b: sum((a[c] - b[c]) ** 2 for c in "uvpq")
    assert got == {(a.earliest.event_id, b.earliest.event_id) for a in found if a.cell_weight < dbscan.MIN_SAMPLES
                   for b in found if same(a, b) and far(a, b) <= dbscan.EPS ** 2}


def test_logins_of_small_groups_are_not_copied_to_the_blocks_around(make):
    rows = [(e, "u", f"2024-01-0{1 + e % 7} 10:00:00", 10.0 + e, 20.0, "d") for e in range(70)]
    sites = dbscan.with_cell_weight(dbscan.scaled_sites(make(rows)))
    assert "Generate" not in dbscan.thin_neighbours(sites)._jdf.queryExecution().optimizedPlan().toString()
