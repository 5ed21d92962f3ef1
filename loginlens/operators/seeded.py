"""Score logins one after another from a stored snapshot, the state advancing after each.

Batch scoring judges all logins against one frozen profile. Here every login is judged
against the profile as it stands just before it: the snapshot's counters plus what the
earlier logins of the same run have added. The snapshot is joined once per user, device
and cell; the additions are running counts and sums over the user's ordered logins, so a
run of any length is a few joins and windows.

* device, time: counters of the snapshot plus running counts.
* velocity: the preceding login of the run, or the snapshot's last place while that is
  the later one. A place has the coordinates with which its cell was first seen.
* Mahalanobis: covariance from exact decimal sums of all earlier logins, the snapshot's
  sums plus running ones.
* location, isolation forest: the patterns in force, and the events before them.
  They change only when an ingest renews them; several versions may follow each other.

A login of a user without profile, or with no patterns in force at its time, is cold: its
scores are neutral, it is not stored, and it advances nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.functions import clock
from loginlens.operators import scoring
from loginlens.operators.outliers import (MOMENTS, covariance_sums, isolation_forest_scores, mahalanobis_columns, merge_sums,
                                          model_of_stats, moments, stats_of_sums)
from loginlens.operators.profiles import CELL, Profile, apply_logins, build_profile, with_cell
from loginlens.operators.segments import SKEW, Ordered, SkewPolicy, join_per_key, join_per_user
from loginlens.schema import ADVANCED_MIN_ROWS, EVENT, INSUFFICIENT, NEUTRAL, THRESHOLD, TIME, USER, WEIGHTS
from loginlens.session import durable, spread_evenly

#: From when a version of the patterns is in force; patterns without this column always are.
SINCE = "since"


@dataclass(frozen=True)
class Seed:
    """What a run starts from: a profile and the sums behind its covariance model."""

    profile: Profile
    sums: DataFrame

    @classmethod
    def of(cls, logins: DataFrame, skew: SkewPolicy = SKEW, whole: bool = False) -> "Seed":
        """The seed of some logins; ``whole`` as for ``build_profile``, for a seed that is stored."""
        return cls(build_profile(logins, skew, whole), covariance_sums(logins))

    def advanced(self, logins: DataFrame) -> "Seed":
        """The seed after the stored logins of a run."""
        return Seed(apply_logins(self.profile, logins), merge_sums(self.sums.unionByName(covariance_sums(logins))))


def replay_from_snapshot(logins: DataFrame, seed: Seed, patterns: DataFrame, history: DataFrame | None = None,
                         weights=WEIGHTS, threshold: float = THRESHOLD, skew: SkewPolicy = SKEW) -> DataFrame:
    """Six scores, verdict and details of each login against its user's state just before it.

    ``patterns`` may hold several versions, told apart by a column ``since``. The
    forest learns from ``history``: per version the events before it, or all
    of ``history`` for patterns without versions; without ``history`` it is neutral.
    Logins are taken in order of time and event id; those older than the snapshot's
    last login count as late and score 1.0 for velocity.
    """
    columns = [USER, EVENT, TIME, "latitude", "longitude", "device_id"]
    base = logins.select(*columns, *[c for c in logins.columns if c == "ip_address"])
    columns = base.columns
    now = skew.measured(base)
    if now.hot(base) is None:
        # Windows and scores cost far more than the bytes that AQE would merge partitions by; one stage holds them all.
        base = spread_evenly(base, USER)
    versions = _versions(patterns, base)
    gate = seed.profile.totals.select(USER).join(
        versions.select(USER, F.col("versions")[0][SINCE].alias("_from")), USER)
    gated = join_per_user(base, gate, now, "left").withColumn("_live", F.coalesce(F.col("_from") <= F.col(TIME), F.lit(False)))
    moved = _advance(gated.where("_live").drop("_from", "_live"), seed, now)
    rows = moved.withColumn("_live", F.lit(True)).unionByName(gated.where("NOT _live").drop("_from"), allowMissingColumns=True)

    state = scoring.user_state(seed.profile).join(
        seed.sums.select(USER, *[F.col(c).alias(f"_seed_{c}") for c in ("n", *MOMENTS)]), USER, "left").join(versions, USER, "left")
    rows = join_per_user(rows, state.withColumnsRenamed({"last_login": "_seed_last", "prev_lat": "_seed_lat", "prev_lon": "_seed_lon"}),
                         now, "left")
    scored = _mahalanobis(_velocity(_time_and_device(_location(rows))))
    if history is None:
        scored = scoring.neutral_isolation_forest(scored)
    else:
        scored = _forest(durable(scored), history, SINCE in patterns.columns, skew, now)
    scored = scoring.cold_start(scored, ~F.col("_live"))
    return scoring.combine_scores(scored, weights, threshold).select(
        *columns, "stored", "is_anomalous", "combined_score", "threshold", "total_logins", "device_count", "hour_count",
        "day_count", *[f"{name}_score" for name in WEIGHTS], *[f"{name}_details" for name in WEIGHTS])


def _versions(patterns: DataFrame, logins: DataFrame) -> DataFrame:
    """`user_id, versions`: the user's (since, centres) in order of time."""
    kind = logins.schema[TIME].dataType
    since = F.col(SINCE).cast(kind) if SINCE in patterns.columns else F.lit("0001-01-01 00:00:00").cast(kind)
    lists = scoring.centre_lists(patterns.withColumn(SINCE, since), SINCE)
    return lists.groupBy(USER).agg(F.sort_array(F.collect_list(F.struct(SINCE, "centres"))).alias("versions"))


def _advance(logins: DataFrame, seed: Seed, skew: SkewPolicy) -> DataFrame:
    """What the run's earlier logins have added before each login, and the snapshot's device counters."""
    devices = seed.profile.devices.select(USER, "device_id", F.col("count").alias("_seed_device"))
    cells = seed.profile.locations.select(USER, *CELL, F.struct("lat", "lon").alias("_seed_cell"))
    rows = with_cell(logins).withColumns({"_hour": clock.login_hour(), "_day": clock.login_day(), **moments()})
    ordered = Ordered.of(rows, skew)
    ordered = ordered.count_before("n", small=True)
    ordered = ordered.sums_before({c: F.col(c) for c in MOMENTS})
    ordered = ordered.first("_first", F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), CELL)
    placed = join_per_key(ordered.rows, cells, list(CELL), skew)
    ordered = Ordered(placed.withColumn("_first", F.coalesce("_seed_cell", "_first")).drop("_seed_cell"), ordered.is_hot)
    ordered = ordered.previous("_before", F.struct(TIME, "_first"))
    ordered = ordered.count_before("device_count", by=("device_id",))
    ordered = ordered.count_before("hour_count", by=("_hour",), small=True)
    ordered = ordered.count_before("day_count", by=("_day",), small=True)
    known = join_per_key(ordered.result(), devices, ["device_id"], skew)
    return known.drop("_first", "_hour", "_day", *CELL)


def _location(rows: DataFrame) -> DataFrame:
    """The version in force and the nearest of its centres."""
    force = F.filter("versions", lambda v: v[SINCE] <= F.col(TIME))
    rows = rows.withColumn("_force", F.when(F.size(force) > 0, F.element_at(force, -1)))
    rows = rows.withColumns({"centres": F.col("_force.centres"), SINCE: F.col(f"_force.{SINCE}")})
    return scoring.location_columns(rows.drop("_force", "versions"))


def _time_and_device(rows: DataFrame) -> DataFrame:
    none = F.lit(0)
    used = F.coalesce("_seed_device", none) + F.coalesce("device_count", none)
    hour = F.coalesce(F.try_element_at("hour_counts", clock.login_hour()), none) + F.coalesce("hour_count", none)
    day = F.coalesce(F.try_element_at("day_counts", clock.login_day()), none) + F.coalesce("day_count", none)
    rows = rows.withColumns({"total_logins": F.col("total_logins") + F.coalesce("n", none), "device_count": used,
                             "hour_count": hour, "day_count": day})
    known = F.when(F.col("device_count") > 0, F.col("device_count"))
    rows = rows.withColumns({"_count": known, "_pct": known / F.col("total_logins") * 100})
    return scoring.device_columns(scoring.time_columns(rows)).drop("hour_counts", "day_counts", "_seed_device")


def _velocity(rows: DataFrame) -> DataFrame:
    own = F.coalesce(F.col(f"_before.{TIME}") >= F.col("_seed_last"), F.lit(False))
    rows = rows.withColumns({
        "last_login": F.when(own, F.col(f"_before.{TIME}")).otherwise(F.col("_seed_last")),
        "prev_lat": F.when(own, F.col("_before._first.lat")).otherwise(F.col("_seed_lat")),
        "prev_lon": F.when(own, F.col("_before._first.lon")).otherwise(F.col("_seed_lon"))})
    return scoring.velocity_columns(rows).drop("_before", "_seed_last", "_seed_lat", "_seed_lon")


def _mahalanobis(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("n", *MOMENTS) and not c.startswith("_seed_")]
    both = rows.withColumns({
        "n": F.coalesce("_seed_n", F.lit(0)) + F.coalesce("n", F.lit(0)),
        **{c: (F.coalesce(f"_seed_{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).cast("decimal(38,0)") for c in MOMENTS}})
    return mahalanobis_columns(model_of_stats(stats_of_sums(both, *kept), *kept), ADVANCED_MIN_ROWS)


def _forest(rows: DataFrame, history: DataFrame, versioned: bool, skew: SkewPolicy, now: SkewPolicy) -> DataFrame:
    """Scores of each version's logins against the events before it. There is a version per ingest, so a few."""
    past = skew.measured(history)
    live = rows.where("_live")
    if versioned:
        scores = None
        for version in live.select(SINCE).distinct().orderBy(SINCE).collect():
            since = F.lit(version[SINCE]).cast(rows.schema[SINCE].dataType)
            part = isolation_forest_scores(live.where(F.col(SINCE) == since), history.where(F.col(TIME) < since), past, login_skew=now)
            scores = part if scores is None else scores.unionByName(part)
        if scores is None:
            return scoring.neutral_isolation_forest(rows)
    else:
        scores = isolation_forest_scores(live, history, past, login_skew=now)
    details = F.struct("raw_score", F.col("message"))
    joined = rows.join(scores.withColumn("isolation_forest_details", details).drop("raw_score", "message"), [USER, EVENT], "left")
    unscored = F.struct(F.lit(None).cast("double").alias("raw_score"), F.lit(INSUFFICIENT).alias("message"))
    return joined.withColumns({"isolation_forest_score": F.coalesce("isolation_forest_score", F.lit(NEUTRAL)),
                               "isolation_forest_details": F.coalesce("isolation_forest_details", unscored)})
