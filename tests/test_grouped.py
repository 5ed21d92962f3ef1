import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loginlens.operators import kmeans, outliers
from loginlens.operators.grouped import groups_of, map_groups


def test_groups_span_batches_and_nulls_are_one_group():
    users, numbers = ["a", "a", "b", "b", "b", None, None], [0, 0, 0, 0, 1, 0, 0]
    whole = pa.RecordBatch.from_arrays([pa.array(users), pa.array(numbers), pa.array(range(7))], ["u", "n", "v"])
    for cuts in ([0, 7], [0, 1, 3, 3, 6, 7], list(range(8))):
        parts = [whole.slice(i, j - i) for i, j in zip(cuts, cuts[1:])]
        assert [g.column(2).to_pylist() for g in groups_of(iter(parts), 2)] == [[0, 1], [2, 3], [4], [5, 6]]


def test_groups_arrive_whole_and_in_order(spark):
    rows = spark.range(30_000).select((F.col("id") % 7).alias("key"), (-F.col("id")).alias("value"))

    def work(group):
        values = group.column("value").to_numpy()
        return pa.RecordBatch.from_arrays([group.column("key").slice(0, 1), pa.array([len(values)]), pa.array([bool((np.diff(values) > 0).all())])],
                                          ["key", "n", "rising"])

    got = sorted(tuple(r) for r in map_groups(rows, ["key"], ["value"], work, "key long, n long, rising boolean").collect())
    assert got == [(k, 30_000 // 7 + (k < 30_000 % 7), True) for k in range(7)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_forests_are_not_handed_over_one_by_one(logins):
    scores = outliers.isolation_forest_scores(logins, logins)
    assert "CoGroups" not in plan_of(scores) and "MapInArrow" in plan_of(scores)


def test_forest_paths_of_its_own_rows_are_those_of_a_walk():
    rng = np.random.default_rng(5)
    for rows in (10, 42, 256, 300):
        numeric = np.column_stack([rng.normal(size=rows).round(1), np.zeros(rows), rng.normal(size=rows)])
        category = rng.integers(-1, 4, rows)
        forest = outliers.IsolationForest(numeric, category, seed=rows)
        assert forest.offset == np.percentile(forest.scores(numeric, category), 10)
        one_by_one = [forest.scores(numeric[i:i + 1], category[i:i + 1])[0] for i in range(rows)]
        assert np.allclose(forest.scores(numeric, category), one_by_one, rtol=0, atol=1e-12)
        assert (forest.size.reshape(forest.trees, -1)[:, 0] == min(rows, 256)).all()


def alone(x, device, w_point, w_device, weight, k):
    """Plain k-means for one k."""
    points = x.T
    one_hot = np.eye(len(w_device))[device]
    def far(centers, shares):
        numeric = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
        return (numeric + ((one_hot[:, None] - shares[None]) ** 2 * w_device).sum(axis=2)).round(9)
    mean = np.average(points, axis=0, weights=weight), np.average(one_hot, axis=0, weights=weight)
    chosen = [int(far(mean[0][None], mean[1][None])[:, 0].argmin())]
    while len(chosen) < k:
        chosen.append(int(far(points[chosen], one_hot[chosen]).min(axis=1).argmax()))
    centers, shares, labels = points[chosen], one_hot[chosen], None
    while True:
        new = far(centers, shares).argmin(axis=1)
        if labels is not None and (new == labels).all():
            return labels.tolist()
        labels = new
        for c in set(labels.tolist()):
            mine = labels == c
            centers[c] = np.average(points[mine], axis=0, weights=weight[mine])
            shares[c] = np.average(one_hot[mine], axis=0, weights=weight[mine])


def test_all_k_together_fit_as_each_alone():
    rng = np.random.default_rng(9)
    for n in (2, 9, 40, 90):
        device = np.unique(rng.integers(0, 4, n), return_inverse=True)[1]
        x, weight = rng.normal(size=(6, n)), rng.integers(1, 4, n).astype(float)
        share = np.bincount(device, weights=weight) / weight.sum()
        w_device = np.where(share >= 1, 0.0, 1 / np.where(share >= 1, 1.0, share * (1 - share)))
        most = min(9, n)
        labels, inertia = kmeans._lloyd(x, device, w_device[device], w_device, weight, most)
        assert [labels[k - 1].tolist() for k in range(1, most + 1)] == [
            alone(x, device, w_device[device], w_device, weight, k) for k in range(1, most + 1)]
        assert len(inertia) == most and inertia[0] > 0
