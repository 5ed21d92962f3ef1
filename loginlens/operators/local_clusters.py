"""Density clusters, and k-means where they tell nothing apart, of users of ordinary size.

A user of a few dozen logins costs more to carry through the joins of :mod:`dbscan` and
:mod:`kmeans` than to compute. Here logins are dealt by user once, pass as one stream per
partition, and are labelled a user at a time. Labels are those of the distributed steps.

Users with more than LOCAL_LOGINS logins, or GROUP_LOGINS of them on one device and weekday,
are left to those steps, so a task holds a bounded number of rows and of distances. So are
users with a coordinate that is no finite number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.functions import clock, geo
from loginlens.operators.grouped import map_groups
from loginlens.operators.kmeans import MAX_K, _lloyd
from loginlens.operators.patterns import NOISE, NUMERIC, feature_frame
from loginlens.schema import EVENT, TIME, USER
from loginlens.session import durable, spread_evenly

LOCAL_LOGINS = 20_000
GROUP_LOGINS = 512
LOGIN = (USER, EVENT, TIME, "latitude", "longitude", "device_id")


def label_by_size(logins: DataFrame, eps: float, min_samples: int, fallback: bool,
                  distributed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`label_users` of ordinary users, `distributed` of the others; logins without a user are noise."""
    apart = _not_local(logins)
    if apart is None:
        return label_users(logins, eps, min_samples, fallback)
    known = logins.where(F.col(USER).isNotNull())
    found = label_users(known.join(apart, USER, "left_anti"), eps, min_samples, fallback)
    if not apart.where(F.col(USER).isNull()).isEmpty():
        unknown = logins.where(F.col(USER).isNull())
        found = found.unionByName(unknown.select(*LOGIN, F.lit(NOISE).alias("cluster")))
    large = apart.where(F.col(USER).isNotNull())
    return found if large.isEmpty() else found.unionByName(distributed(known.join(large, USER, "left_semi")))


def _not_local(logins: DataFrame) -> DataFrame | None:
    """Users whose logins are not labelled in one task, a null where logins have no user; None if there are none."""
    odd = F.coalesce(F.max(F.isnan(F.col("latitude") * 0) | F.isnan(F.col("longitude") * 0)), F.lit(False))
    many = durable(logins.groupBy(USER).agg(F.count("*").alias("_n"), odd.alias("_odd"))
                   .where((F.col("_n") > GROUP_LOGINS) | F.col("_odd") | F.col(USER).isNull()))
    if many.isEmpty():
        return None
    crowded = (logins.join(many.select(USER), USER, "left_semi").groupBy(USER, "device_id", clock.login_day().alias("day"))
               .agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_LOGINS).select(USER))
    large = (F.col("_n") > LOCAL_LOGINS) | F.col("_odd") | F.col(USER).isNull()
    apart = durable(many.where(large).select(USER).union(crowded).distinct())
    return None if apart.isEmpty() else apart


def label_users(logins: DataFrame, eps: float, min_samples: int, fallback: bool) -> DataFrame:
    """Logins with `cluster` as of `dbscan`; with `fallback`, users of a single label get k-means' labels.

    Every user must be small and known.
    """
    dealt = spread_evenly(logins.select(*LOGIN), USER)
    # The frame is worked out where the logins lie; both sides of the join are the same shuffle.
    hour, day = clock.cyclic(F.col("hour"), 24), clock.cyclic(F.col("day"), 7)
    framed = (dealt.join(feature_frame(dealt), USER)
              .withColumns({"hour": clock.login_hour(), "day": clock.login_day()})
              .withColumns({"lon_unwrapped": geo.unwrap_longitude("longitude", "lon_range", "points"),
                            "hour_sin": hour[0], "hour_cos": hour[1], "day_sin": day[0], "day_cos": day[1]})
              .select(*LOGIN, "hour", "day", *NUMERIC[1:], *[f"{c}_mean" for c in NUMERIC], *[f"{c}_std" for c in NUMERIC]))
    order = [F.col(TIME).asc_nulls_first(), F.col(EVENT).asc_nulls_first(), "device_id", "latitude", "longitude"]

    def label(rows: pa.RecordBatch) -> pa.RecordBatch:
        return _label_user(rows, eps, min_samples, fallback)

    schema = T.StructType([*dealt.schema.fields, T.StructField("cluster", T.IntegerType())])
    return map_groups(framed, [USER], order, label, schema, dealt=True)


class _Sites:
    """Distinct logins of one user, whose rows come in order of time, as arrays.

    `of` is the site of each row, -1 for rows that are left out; sites are numbered by their
    earliest row, `first`.
    """

    def __init__(self, taken: np.ndarray, keys: list[np.ndarray]):
        at = np.flatnonzero(taken)
        keys = [k[at] for k in keys]
        order = np.lexsort(keys)
        new = np.zeros(len(at), dtype=bool)
        new[:1] = True
        for k in keys:
            k = k[order]
            gap = k[1:] != k[:-1]
            if k.dtype.kind == "f":
                gap &= ~(np.isnan(k[1:]) & np.isnan(k[:-1]))
            new[1:] |= gap
        first = order[new]  # the sort is stable, so a run begins with its earliest row
        rank = np.argsort(first)
        number = np.empty(len(first), dtype=int)
        number[rank] = np.arange(len(first))
        self.of = np.full(len(taken), -1)
        self.of[at[order]] = number[np.cumsum(new) - 1]
        self.first = at[first[rank]]
        self.weight = np.bincount(self.of[at], minlength=len(first))


def _label_user(rows: pa.RecordBatch, eps: float, min_samples: int, fallback: bool) -> pa.RecordBatch:
    def numbers(name: str, none=np.nan) -> np.ndarray:
        return rows.column(name).fill_null(none).to_numpy(zero_copy_only=False)

    devices = rows.column("device_id")
    device = devices.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    place = numbers("day", -1).astype(int) * 24 + numbers("hour", 0)  # negative without a time
    # Zero and minus zero are one place.
    keys = [numbers("longitude") + 0.0, numbers("latitude") + 0.0, place, device]
    frame = {c: rows.column(c)[0].as_py() for c in rows.schema.names[-2 * len(NUMERIC):]}
    frame = {c: np.nan if v is None else v for c, v in frame.items()}
    whole = (device >= 0) & (place >= 0) & ~np.isnan(keys[0]) & ~np.isnan(keys[1])
    sites = _Sites(whole, keys)
    at = sites.first
    x = [numbers(c)[at] / frame[f"{c}_std"] for c in NUMERIC[:4]]
    found = _dense(x, device[at].astype(int) * 7 + place[at] // 24, sites.weight, eps, min_samples)
    cluster = np.full(rows.num_rows, NOISE, dtype=np.int32)
    cluster[whole] = found[sites.of[whole]]
    taken = None
    if fallback and (cluster == cluster[0]).all():
        taken, cluster = _fallback(rows.column(EVENT), devices, [numbers(c) for c in NUMERIC], frame, keys, whole)
    login = rows.select(LOGIN)
    login = login if taken is None else login.take(pa.array(taken))
    return pa.RecordBatch.from_arrays([*login.columns, pa.array(cluster, pa.int32())], [*LOGIN, "cluster"])


def _dense(x: list[np.ndarray], group: np.ndarray, weight: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """DBSCAN of one user's sites, in order of time: cluster numbers by the earliest core site, or NOISE."""
    count = len(group)
    label = np.full(count, count)  # a cluster's earliest core site; `count` is noise
    parts = [np.arange(count)] if count <= GROUP_LOGINS else [np.flatnonzero(group == g) for g in np.unique(group)]
    for part in parts:
        if len(part):
            own = group[part]
            near = own[:, None] == own
            square = 0.0
            for axis in x:
                gap = axis[part][:, None] - axis[part]
                square = square + gap * gap
            near &= square <= eps * eps
            core = near @ weight[part] >= min_samples
            if core.any():
                reach = near[:, core]
                label[part] = _spread(reach, core, part, count)
    _, numbered = np.unique(np.append(label, count), return_inverse=True)
    return np.where(label == count, NOISE, numbered[:-1])


def _spread(reach: np.ndarray, core: np.ndarray, part: np.ndarray, none: int) -> np.ndarray:
    """Smallest core site that each site is connected to; `reach` says which core sites lie near a site."""
    inside = reach[core]
    own = np.arange(inside.shape[0])
    while True:
        heard = np.where(inside, own, none).min(axis=1)
        heard = heard[heard]
        if np.array_equal(heard, own):
            break
        own = heard
    return np.where(reach, part[core][own], none).min(axis=1)


def _fallback(event: pa.Array, devices: pa.Array, features: list[np.ndarray], frame: dict[str, float],
              keys: list[np.ndarray], whole: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Rows and their cluster by k-means of the elbow k, as `kmeans` joined with the logins by event."""
    known = keys[3] >= 0
    sites = _Sites(known, keys)
    timed = keys[2][sites.first] >= 0
    blank = event.is_null().to_numpy(zero_copy_only=False)
    # Sites in order of time and event, nulls last.
    order = np.lexsort((np.arange(len(timed)), ~timed)) if not timed.all() else np.arange(len(timed))
    at = sites.first[order]
    label = np.full(len(timed), -1)
    if len(at):
        codes = devices.take(pa.array(at)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        share = np.bincount(keys[3][known])[keys[3][at]] / len(keys[3]) * 100 / 100
        w_point = np.zeros(len(at))
        mixed = share < 1
        w_point[mixed] = 1.0 / (share[mixed] * (1.0 - share[mixed]))
        w_device = np.zeros(codes.max() + 1)
        w_device[codes] = w_point
        weight = sites.weight[order].astype(float)
        x = np.stack([(f[at] - frame[f"{c}_mean"]) / frame[f"{c}_std"] for c, f in zip(NUMERIC, features)])
        logins = int(weight.sum())
        most = min(max(max(1, min(MAX_K, logins - 1)), 2), len(at))
        labels, inertia = _lloyd(x, codes, w_point, w_device, weight, most)
        label[order] = labels[min(_elbow(inertia[:min(10, logins) - 1]), most) - 1]
        label[blank[sites.first]] = -1
    mine = np.where(known, label[sites.of] if len(at) else -1, -1)
    good = np.flatnonzero(whole & (mine >= 0) & ~blank)
    if not blank.any() and len(event.unique()) == len(event):
        return (None if len(good) == len(event) else good), mine[good].astype(np.int32)
    # An event id that several rows share is joined with each of them.
    ids = event.to_pylist()
    same: dict = {}
    for i in good:
        same.setdefault(ids[i], []).append(mine[i])
    taken = [(i, c) for i, e in enumerate(ids) for c in same.get(e, ())]
    return np.array([i for i, _ in taken], dtype=int), np.array([c for _, c in taken], dtype=np.int32)


def _elbow(inertia: list[float]) -> int:
    """Largest second difference of inertia, the least k for equal ones; 2 for two inertias or fewer."""
    if len(inertia) < 3:
        return 2
    step = np.diff(inertia)
    bend = np.diff(step)
    return int(np.argmax(np.where(np.isnan(bend), np.inf, bend))) + 2
