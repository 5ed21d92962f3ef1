"""Per-user k-means, used where density clustering finds nothing to tell apart.

Distances use the standardised feature space of :mod:`patterns` without wide
one-hot vectors: for a login on device d and a centroid whose logins use device
e with share c_e, the one-hot part of the squared distance is
w_d (1 - 2 c_d) + sum_e c_e^2 w_e with w_e = 1 / (p_e (1 - p_e)).

Start and ties are fixed (point nearest the mean, then farthest-first, earliest
login wins), so both ways of running give the same labels:

* users of ordinary size fit one at a time in grouped tasks;
* larger users run Lloyd's rounds as joins and aggregations over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loginlens.functions import clock, geo
from loginlens.operators.grouped import map_groups
from loginlens.operators.patterns import NUMERIC, SITE, device_scale, elbow_k, feature_frame, with_site
from loginlens.operators.segments import SKEW, SkewPolicy, join_per_user
from loginlens.schema import EVENT, TIME, USER
from loginlens.session import discard, durable

MAX_K = 9
#: Lloyd's rounds end when no label changes; so many without an end are an error.
ROUNDS = 10_000
LOCAL_SITES = 20_000
Z = tuple(f"{c}_z" for c in NUMERIC)

_LABELS = f"{USER} string, site long, k int, cluster int, inertia double"


def kmeans_sites(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Distinct logins with multiplicity and z-scores; ``rank_time``/``site`` order ties."""
    placed = with_site(logins).groupBy(*SITE).agg(
        F.count("*").alias("weight"), F.min(F.struct(TIME, EVENT)).alias("_first"))
    hour, day = clock.cyclic(F.col("hour"), 24), clock.cyclic(F.col("day"), 7)
    framed = (join_per_user(placed, feature_frame(logins), skew)
              .withColumns({"lon_unwrapped": geo.unwrap_longitude("longitude", "lon_range", "points"),
                            "hour_sin": hour[0], "hour_cos": hour[1], "day_sin": day[0], "day_cos": day[1]}))
    z = [((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{c}_z") for c in NUMERIC]
    return (framed.join(device_scale(logins), [USER, "device_id"])
            .select(*SITE, "device_weight", *z, "weight", F.col(f"_first.{TIME}").cast("timestamp").alias("rank_time"),
                    F.col(f"_first.{EVENT}").alias("site")))


# --- One user in one task ----------------------------------------------------

def _distances(x, device, w_point, w_device, centers, shares):
    """Squared distance of every row to every centroid; `x` and `centers` hold a feature a line."""
    numeric = np.zeros((x.shape[1], centers.shape[1]))
    for mine, theirs in zip(x, centers):
        gap = mine[:, None] - theirs
        gap *= gap
        numeric += gap
    return numeric + w_point[:, None] * (1 - 2 * shares[:, device].T) + (shares ** 2 * w_device).sum(axis=1)


def _starts(x, device, w_point, w_device, weight, most):
    """The rows that clusters start from: nearest to the mean, then farthest first. Those of k are the first k."""
    def to(center, share):
        return _distances(x, device, w_point, w_device, center[:, None], share[None])[:, 0]

    total = np.bincount(device, weights=weight, minlength=len(w_device)) / weight.sum()
    mean = (x * weight).cumsum(axis=1)[:, -1] / weight.sum()
    chosen = [int(np.argmin(to(mean, total).round(9)))]
    near = None
    while len(chosen) < most:
        share = np.zeros(len(w_device))
        share[device[chosen[-1]]] = 1.0
        far = to(x[:, chosen[-1]], share)
        near = far if near is None else np.minimum(near, far)
        chosen.append(int(np.argmax(near.round(9))))
    return chosen


def _lloyd(x, device, w_point, w_device, weight, most):
    """Labels and inertia for every k up to `most`; rows are in tie-breaking order.

    The rounds of all k run together, their centroids side by side; a k that has
    settled finds its own centroids again until the last one has.
    """
    chosen = np.array(_starts(x, device, w_point, w_device, weight, most))
    first = [k * (k - 1) // 2 for k in range(1, most + 2)]  # where the centroids of k begin
    count, rows, kinds = first[-1], x.shape[1], len(w_device)
    seed = np.concatenate([chosen[:k] for k in range(1, most + 1)])
    centers, shares = x[:, seed].copy(), np.zeros((count, kinds))
    shares[np.arange(count), device[seed]] = 1.0
    labels = None
    for step in range(ROUNDS):
        d = _distances(x, device, w_point, w_device, centers, shares)
        rounded = d.round(9)
        new = np.stack([rounded[:, i:j].argmin(axis=1) + i for i, j in zip(first, first[1:])])
        if labels is not None and np.array_equal(new, labels):
            break
        labels = new
        if step == ROUNDS - 1:
            raise RuntimeError("k-means did not settle")
        flat, heavy = labels.ravel(), np.tile(weight, most)
        mass = np.bincount(flat, weights=heavy, minlength=count)
        full = mass > 0  # a cluster left empty keeps its old centre
        for mine, theirs in zip(x, centers):
            theirs[full] = np.bincount(flat, weights=np.tile(mine * weight, most), minlength=count)[full] / mass[full]
        by_device = np.bincount(flat * kinds + np.tile(device, most), weights=heavy, minlength=count * kinds)
        shares[full] = by_device.reshape(count, kinds)[full] / mass[full, None]
    inertia = [float((d[np.arange(rows), own] * weight).sum()) for own in labels]
    return labels - np.array(first[:-1])[:, None], inertia


def _fit_user(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Every k tried for one user, whose sites come in tie-breaking order."""
    device = rows.column("device_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    numbers = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype(float)
    w_point, weight = numbers("device_weight"), numbers("weight")
    w_device = np.zeros(device.max() + 1)
    w_device[device] = w_point
    x = np.stack([numbers(c) for c in Z])
    # k below min(10, logins); more clusters than distinct logins cannot be filled.
    top = max(1, min(MAX_K, int(weight.sum()) - 1))
    most = min(max(top, 2), rows.num_rows)
    labels, inertia = _lloyd(x, device, w_point, w_device, weight, most)
    n = rows.num_rows
    again = pa.array(np.tile(np.arange(n), most))
    return pa.RecordBatch.from_arrays(
        [rows.column(USER).take(again), rows.column("site").take(again),
         pa.array(np.repeat(np.arange(1, most + 1, dtype=np.int32), n)), pa.array(labels.ravel().astype(np.int32)),
         pa.array(np.repeat(inertia, n))], [USER, "site", "k", "cluster", "inertia"])


# --- Users too large for one task --------------------------------------------

def _to_centroids(sites: DataFrame, centroids: DataFrame, shares: DataFrame) -> DataFrame:
    """Squared distance of every site to each centroid of its user and k.

    A user has at most 45 centroids, so the join multiplies rows by a constant.
    """
    numeric = sum(((F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}")) for c in Z), F.lit(0.0))
    device = F.col("device_weight") * (1 - 2 * F.coalesce("share", F.lit(0.0))) + F.col("square")
    return (sites.join(centroids, USER).join(shares, [USER, "k", "c", "device_id"], "left")
            .withColumn("d", F.round(numeric + device, 9)))


def _centroids(assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    mean = [(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(f"m_{c}") for c in Z]
    by_device = assigned.groupBy(USER, "k", "c", "device_id", "device_weight").agg(F.sum("weight").alias("_w"))
    mass = by_device.groupBy(USER, "k", "c").agg(F.sum("_w").alias("_mass"))
    shares = (by_device.join(mass, [USER, "k", "c"])
              .withColumn("share", F.col("_w") / F.col("_mass")))
    square = shares.groupBy(USER, "k", "c").agg(
        F.sum(F.col("share") * F.col("share") * F.col("device_weight")).alias("square"))
    centers = assigned.groupBy(USER, "k", "c").agg(*mean).join(square, [USER, "k", "c"])
    return durable(centers), durable(shares.select(USER, "k", "c", "device_id", "share"))


def _picked(sites: DataFrame, best: DataFrame, c: int, max_k: int) -> DataFrame:
    """The chosen start sites as one-login clusters, for every k that needs them."""
    ks = F.explode(F.sequence(F.lit(c + 1), F.lit(max_k)))
    return (sites.join(best, [USER, "site"], "left_semi")
            .withColumn("k", ks).withColumn("c", F.lit(c)).withColumn("weight", F.lit(1).cast("bigint")))


def _nearest(sites: DataFrame, centroids: DataFrame, shares: DataFrame) -> DataFrame:
    best = F.min(F.struct("d", "c")).alias("_best")
    return (_to_centroids(sites, centroids, shares)
            .groupBy(USER, "site", "k").agg(best)
            .select(USER, "site", "k", F.col("_best.c").alias("c"), F.col("_best.d").alias("d")))


def _fit_large(sites: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """Lloyd's rounds for all large users and every k at once."""
    sites = durable(sites)
    whole = sites.withColumns({"k": F.lit(0), "c": F.lit(0)})
    d = _nearest(sites, *_centroids(whole))
    order = F.struct("rank_time", "site")
    def first_site(scored: DataFrame, extreme: Column) -> DataFrame:
        return (scored.join(sites.select(USER, "site", "rank_time"), [USER, "site"])
                .groupBy(USER).agg(extreme.alias("site")))
    chosen = durable(_picked(sites, first_site(d, F.min_by("site", F.struct("d", "rank_time", "site"))), 0, max_k))
    for c in range(1, max_k):
        near = _nearest(sites, *_centroids(chosen.where(F.col("k") == max_k)))
        farthest = F.min_by("site", F.struct(-F.col("d"), order))
        chosen = durable(chosen.unionByName(_picked(sites, first_site(near, farthest), c, max_k)))
    centroids, shares = _centroids(chosen)
    labels = durable(_nearest(sites, centroids, shares))
    for step in range(ROUNDS):
        rows = sites.join(labels.select(USER, "site", "k", "c"), [USER, "site"])
        new_centroids, new_shares = _centroids(rows)
        # A cluster left empty keeps its old centre.
        gone = centroids.join(new_centroids, [USER, "k", "c"], "left_anti")
        kept = shares.join(gone.select(USER, "k", "c"), [USER, "k", "c"], "left_semi")
        before = (centroids, shares, new_centroids, new_shares)
        centroids = durable(new_centroids.unionByName(gone))
        shares = durable(new_shares.unionByName(kept))
        discard(*before)
        new = durable(_nearest(sites, centroids, shares))
        moved = new.join(labels.select(USER, "site", "k", F.col("c").alias("_old")), [USER, "site", "k"])
        stable = moved.where(F.col("c") != F.col("_old")).isEmpty()
        discard(labels)
        labels = new
        if stable:
            break
        if step == ROUNDS - 1:
            raise RuntimeError("k-means did not settle")
    inertia = (labels.join(sites.select(USER, "site", "weight"), [USER, "site"])
               .groupBy(USER, "k").agg(F.sum(F.col("d") * F.col("weight")).alias("inertia")))
    return labels.join(inertia, [USER, "k"]).select(
        USER, "site", F.col("k").cast("int").alias("k"), F.col("c").cast("int").alias("cluster"), "inertia")


def kmeans_fits(logins: DataFrame, local_sites: int = LOCAL_SITES,
                skew: SkewPolicy = SKEW) -> tuple[DataFrame, DataFrame]:
    """Sites, and their cluster with the inertia for every k tried."""
    sites = durable(kmeans_sites(logins, skew))
    sizes = sites.groupBy(USER).agg(F.count("*").alias("_n"))
    small = sites.join(sizes.where(F.col("_n") <= local_sites), USER, "left_semi")
    large = sites.join(sizes.where(F.col("_n") > local_sites), USER, "left_semi")
    order = [F.col("rank_time").asc_nulls_last(), F.col("site").asc_nulls_last()]
    fits = map_groups(small, [USER], order, _fit_user, _LABELS)
    if not large.isEmpty():
        fits = fits.unionByName(_fit_large(large))
    return sites, durable(fits)


def kmeans_labels(logins: DataFrame, local_sites: int = LOCAL_SITES, skew: SkewPolicy = SKEW) -> DataFrame:
    """Distinct logins of each user with the cluster of the elbow k.

    A user whose logins are all alike, or with a single login, is one cluster.
    """
    sites, fits = kmeans_fits(logins, local_sites, skew)
    sizes = sites.groupBy(USER).agg(F.sum("weight").alias("_logins"))
    inertias = (fits.select(USER, "k", "inertia").distinct().join(sizes, USER)
                .where(F.col("k") < F.least(F.lit(10), F.col("_logins"))))
    largest = fits.groupBy(USER).agg(F.max("k").alias("_max"))
    wanted = (largest.join(elbow_k(inertias), USER, "left")
              .select(USER, F.least(F.coalesce("best_k", F.lit(2)), "_max").alias("k")))
    return fits.join(wanted, [USER, "k"]).join(sites.drop("weight"), [USER, "site"])


def kmeans(logins: DataFrame, local_sites: int = LOCAL_SITES, skew: SkewPolicy = SKEW) -> DataFrame:
    """Cluster number of every login, by (user, event)."""
    labels = kmeans_labels(logins, local_sites, skew.measured(logins))
    # Joined on raw columns: recomputed z-scores may differ in their last bit.
    return with_site(logins).join(labels.select(*SITE, "cluster"), list(SITE)).select(USER, EVENT, "cluster")
