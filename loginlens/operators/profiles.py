"""Per-user behaviour profiles as normalised, mergeable tables."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loginlens.functions import clock, geo
from loginlens.operators.mergeable import (coordinates, gap_changes, gap_counts, gaps_of, login_times, merge_coordinates,
                                            merge_gap_counts, merge_times, spread_of)
from loginlens.operators.segments import SKEW, Ordered, SkewPolicy, join_per_user, latest
from loginlens.schema import EVENT, ORDER, TIME, USER
from loginlens.session import durable

CELL = ("cell_lat", "cell_lon")
GAP_FIELDS = ("mean_gap_h", "std_gap_h", "min_gap_h", "max_gap_h", "median_gap_h")
SPREAD_FIELDS = ("standard_distance", "robust_distance", "weighted_distance",
                 "multimodal_distance", "combined_score")


def with_cell(logins: DataFrame) -> DataFrame:
    return logins.withColumns({"cell_lat": geo.cell_lat(), "cell_lon": geo.cell_lon()})


def user_totals(logins: DataFrame) -> DataFrame:
    return logins.groupBy(USER).agg(
        F.count("*").alias("total_logins"),
        F.min(TIME).alias("first_login"),
        F.max(TIME).alias("last_login"))


def _with_share(devices: DataFrame) -> DataFrame:
    """Share of the user's logins, from totals over the already small device table."""
    totals = devices.groupBy(USER).agg(F.sum("count").alias("_total"))
    return (devices.join(totals, USER)
            .withColumn("percentage", F.col("count") / F.col("_total") * 100)
            .select(USER, "device_id", "count", "percentage", "first_seen", "last_seen"))


def _device_counts(logins: DataFrame) -> DataFrame:
    return logins.groupBy(USER, "device_id").agg(
        F.count("*").alias("count"),
        F.min(TIME).alias("first_seen"),
        F.max(TIME).alias("last_seen"))


def user_devices(logins: DataFrame) -> DataFrame:
    return _with_share(_device_counts(logins))


def user_locations(logins: DataFrame) -> DataFrame:
    """0.001 degree cells with the coordinates of the first login in each."""
    first = F.min_by(F.struct("latitude", "longitude"), F.struct(*ORDER))
    return (with_cell(logins).groupBy(USER, *CELL).agg(
        F.count("*").alias("count"),
        first.alias("_first"),
        F.min(F.struct(*ORDER)).alias("first_order"),
        F.min(TIME).alias("first_seen"),
        F.max(TIME).alias("last_seen"))
        .select(USER, *CELL, "count", F.col("_first.latitude").alias("lat"),
                F.col("_first.longitude").alias("lon"), "first_seen", "last_seen",
                "first_order"))


def user_hours(logins: DataFrame) -> DataFrame:
    return logins.groupBy(USER, clock.login_hour().alias("hour")).agg(F.count("*").alias("count"))


def user_days(logins: DataFrame) -> DataFrame:
    return logins.groupBy(USER, clock.login_day().alias("day")).agg(F.count("*").alias("count"))


def gap_to_next(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Hours from each login to the user's next one; the last login is dropped."""
    ordered = Ordered.of(logins.select(USER, TIME, EVENT), skew).following("_next", F.struct(TIME))
    return (ordered.result().where(F.col("_next").isNotNull())
            .select(USER, EVENT, TIME, clock.hours_between(TIME, F.col("_next.timestamp")).alias("gap_h")))


def login_gaps(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Mean, population std, min, max and median gap in hours; null for one login.

    ``percentile`` keeps one counter per distinct gap of a user. Ordinary users
    are bounded by the skew limit. For hot users the gaps are counted first, in
    parallel, and the median is read off the running count; a user's distinct
    gaps number at most sqrt(2 * history in microseconds).
    """
    base = logins.select(USER, TIME, EVENT)
    ordered = Ordered.of(base, skew).previous("_prev", F.struct(TIME))
    gaps = ordered.rows.withColumn("_us", clock.micros_between(F.col("_prev.timestamp"), TIME))
    hours = F.col("_us") / F.lit(float(clock.MICROS_PER_HOUR))
    wanted = [F.avg(hours).alias("mean_gap_h"), F.stddev_pop(hours).alias("std_gap_h"),
              F.min(hours).alias("min_gap_h"), F.max(hours).alias("max_gap_h")]
    if not ordered.is_hot:
        return gaps.groupBy(USER).agg(*wanted, F.percentile(hours, F.lit(0.5)).alias("median_gap_h"))
    summary = gaps.groupBy(USER).agg(*wanted, F.count("_us").alias("_n"))
    counted = gaps.where("_us IS NOT NULL").groupBy(USER, "_us").agg(F.count("*").alias("_times"))
    upto = F.sum("_times").over(Window.partitionBy(USER).orderBy("_us"))
    middle = (counted.withColumn("_upto", upto).join(summary.select(USER, "_n"), USER)
              .groupBy(USER).agg(
                  F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) / 2), hours)).alias("_lo"),
                  F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), hours)).alias("_hi"))
              .select(USER, ((F.col("_lo") + F.col("_hi")) / 2).alias("median_gap_h")))
    return summary.drop("_n").join(middle, USER, "left")


def geo_mean_center(logins: DataFrame, *keys: str) -> DataFrame:
    """Spherical mean centre per group (the whole table without keys; empty is 0, 0)."""
    means = logins.groupBy(*keys).agg(
        *[c.alias(name) for name, c in geo.unit_vector_means().items()],
        F.count("*").alias("_points"))
    return means.select(
        *keys, F.coalesce(geo.center_lat(), F.lit(0.0)).alias("center_lat"),
        F.coalesce(geo.center_lon(), F.lit(0.0)).alias("center_lon"),
        F.col("_points").alias("points"))


def standard_distance(logins: DataFrame, *keys: str, skew: SkewPolicy = SKEW) -> DataFrame:
    """Root mean square distance to the mean centre; 0 for a single point.

    Groups are the user, or the user and one more column.
    """
    keys = keys or (USER,)
    center = geo_mean_center(logins, *keys)
    away = geo.haversine_km("latitude", "longitude", "center_lat", "center_lon")
    points = logins.select(*keys, "latitude", "longitude")
    if keys == (USER,):
        placed = join_per_user(points, center, skew)
    else:
        placed = points.join(center, list(keys))
    return (placed.groupBy(*keys, "center_lat", "center_lon", "points")
            .agg(F.sqrt(F.avg(away * away)).alias("_rms"))
            .select(*keys, "center_lat", "center_lon", "points",
                    F.when(F.col("points") <= 1, 0.0).otherwise(F.col("_rms")).alias("std_distance")))


def geo_variance(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Five dispersion fields per user, all equal to the standard distance."""
    spread = standard_distance(logins, USER, skew=skew)
    return spread.select(USER, *[F.col("std_distance").alias(name) for name in SPREAD_FIELDS])


def map_center(logins: DataFrame) -> DataFrame:
    """Plain mean coordinates; (0, 0) for an empty table."""
    return logins.agg(F.coalesce(F.avg("latitude"), F.lit(0.0)).alias("center_lat"),
                      F.coalesce(F.avg("longitude"), F.lit(0.0)).alias("center_lon"))


def time_extent(logins: DataFrame, *keys: str) -> DataFrame:
    """First and last time with the span in whole days."""
    ends = logins.groupBy(*keys).agg(F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"))
    micros_per_day = 24 * clock.MICROS_PER_HOUR
    span = F.floor(clock.micros_between("first_time", "last_time") / micros_per_day)
    return ends.withColumn("span_days", span.cast("bigint"))


def longitude_range(logins: DataFrame, *keys: str) -> DataFrame:
    return logins.groupBy(*(keys or (USER,))).agg(
        F.count("*").alias("points"),
        (F.max("longitude") - F.min("longitude")).alias("lon_range"))


def shift_antimeridian(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """Add ``lon_unwrapped``: longitudes of wide-spread users on 0..360."""
    spread = longitude_range(logins, USER)
    return (join_per_user(logins, spread, skew)
            .withColumn("lon_unwrapped", geo.unwrap_longitude("longitude", "lon_range", "points"))
            .drop("points", "lon_range"))


@dataclass(frozen=True)
class Profile:
    """One table per part of the profile, each keyed by user first."""

    totals: DataFrame
    devices: DataFrame
    locations: DataFrame
    hours: DataFrame
    days: DataFrame
    gaps: DataFrame
    spread: DataFrame
    # What the two metrics are merged from.
    gap_counts: DataFrame
    times: DataFrame
    coordinates: DataFrame

    def write(self, path: str) -> "Profile":
        """Write a snapshot to a directory of its own, replacing an earlier attempt."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
        return Profile.read(self.totals.sparkSession, path)

    @classmethod
    def read(cls, spark, path: str) -> "Profile":
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})

    def of_users(self, users: DataFrame) -> "Profile":
        """The same profile restricted to wanted users."""
        wanted = users.select(USER).distinct()
        return replace(self, **{f.name: getattr(self, f.name).join(wanted, USER, "left_semi")
                                for f in fields(self)})


def user_counters(logins: DataFrame) -> dict[str, DataFrame]:
    """Totals, devices, hours and days from one scan and one shuffle.

    Grouping sets count all four at once; the result is stored by part, and
    each table reads its own part only.
    """
    rows = logins.select(USER, "device_id", clock.login_hour().alias("hour"), clock.login_day().alias("day"), TIME)
    user, device, hour, day = (F.col(c) for c in (USER, "device_id", "hour", "day"))
    counted = rows.groupingSets([[user], [user, device], [user, hour], [user, day]], user, device, hour, day).agg(
        F.grouping_id().cast("int").alias("part"), F.count("*").alias("count"),
        F.min(TIME).alias("first_seen"), F.max(TIME).alias("last_seen"))
    stored = durable(counted, "part")
    # The grouping id has one bit per column left out, for device, hour and day.
    totals, devices, hours, days = (stored.where(F.col("part") == part) for part in (7, 3, 5, 6))
    return {
        "totals": totals.select(USER, F.col("count").alias("total_logins"),
                                F.col("first_seen").alias("first_login"), F.col("last_seen").alias("last_login")),
        "devices": _with_share(devices.select(USER, "device_id", "count", "first_seen", "last_seen")),
        "hours": hours.select(USER, "hour", "count"),
        "days": days.select(USER, "day", "count"),
    }


def build_profile(logins: DataFrame, skew: SkewPolicy = SKEW, whole: bool = False) -> Profile:
    """The profile of some logins; ``whole`` is for those who read all of it, as scoring does not.

    The tables behind the metrics are read several times then, so they are fixed once. Without
    that cut every window, sort and join of them lands in the reader's stage, whose tasks hold
    the memory of all at once.
    """
    skew = skew.measured(logins)
    counters, counts, places = user_counters(logins), gap_counts(logins, skew), coordinates(logins)
    cells = user_locations(logins)
    if whole:
        counts, places, cells = durable(counts), durable(places), durable(cells)
    return Profile(**counters, locations=cells,
                   gaps=gaps_of(counts, counters["totals"]), spread=spread_of(places, SPREAD_FIELDS),
                   gap_counts=counts, times=login_times(logins), coordinates=places)


def _merge_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("count").alias("count"))


def merge_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(USER).agg(
        F.sum("total_logins").alias("total_logins"),
        F.min("first_login").alias("first_login"),
        F.max("last_login").alias("last_login"))


def merge_devices(rows: DataFrame) -> DataFrame:
    return _with_share(rows.groupBy(USER, "device_id").agg(
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen")))


def merge_locations(rows: DataFrame) -> DataFrame:
    earliest = F.min_by(F.struct("lat", "lon"), F.col("first_order"))
    return (rows.groupBy(USER, *CELL).agg(
        F.sum("count").alias("count"), earliest.alias("_first"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("first_order").alias("first_order"))
        .select(USER, *CELL, "count", F.col("_first.lat").alias("lat"),
                F.col("_first.lon").alias("lon"), "first_seen", "last_seen", "first_order"))


#: Tables that are sums: how rows of several batches, or of a profile and a batch, become one table.
MERGES = {
    "totals": merge_totals, "devices": merge_devices, "locations": merge_locations,
    "hours": lambda rows: _merge_counts(rows, USER, "hour"), "days": lambda rows: _merge_counts(rows, USER, "day"),
    "gap_counts": merge_gap_counts, "times": merge_times, "coordinates": merge_coordinates,
}


def increments(batch: DataFrame, totals: DataFrame, times: DataFrame, skew: SkewPolicy = SKEW) -> dict[str, DataFrame]:
    """What a batch adds to each table of ``MERGES``, given the totals and login times of what went before."""
    return {**user_counters(batch), "locations": user_locations(batch),
            "gap_counts": gap_changes(batch, totals, times, skew), "times": login_times(batch),
            "coordinates": coordinates(batch)}


def touched_metrics(added: dict[str, DataFrame], counts: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """Gap and spread metrics of the users of a batch, from its increments and their counts and places before it."""
    users = added["totals"].select(USER)
    gaps = merge_gap_counts(counts.join(users, USER, "left_semi").unionByName(added["gap_counts"]))
    spread = merge_coordinates(places.join(users, USER, "left_semi").unionByName(added["coordinates"]))
    return {"gaps": gaps_of(durable(gaps), users), "spread": spread_of(durable(spread), SPREAD_FIELDS)}


def merge_profiles(old: Profile, batch: DataFrame, stored: DataFrame | None = None,
                   skew: SkewPolicy = SKEW, history_limit: int | None = None) -> Profile:
    """Fold a batch into a profile.

    Everything adds up, so only the batch is aggregated, and the metrics of its users
    follow from their gap counts and places. The result equals a profile built from
    all events, in whatever order they came. With ``history_limit`` the metrics are
    those of the newest events in ``stored`` (which include the batch).
    """
    added = increments(batch, old.totals, old.times, skew)
    merged = {name: MERGES[name](_plain(getattr(old, name)).unionByName(_plain(rows))) for name, rows in added.items()}
    if history_limit is None:
        merged = {**merged, "gap_counts": durable(merged["gap_counts"]), "coordinates": durable(merged["coordinates"])}
        return Profile(**merged, gaps=gaps_of(merged["gap_counts"], merged["totals"]),
                       spread=spread_of(merged["coordinates"], SPREAD_FIELDS))
    metrics = recent_metrics(batch, stored, history_limit, skew)
    return Profile(**merged, **{name: upsert(getattr(old, name), rows) for name, rows in metrics.items()})


def recent_metrics(batch: DataFrame, stored: DataFrame, history_limit: int, skew: SkewPolicy = SKEW) -> dict[str, DataFrame]:
    """Gap and spread metrics of a batch's users from their newest stored events."""
    recent = latest(stored.join(batch.select(USER).distinct(), USER, "left_semi"), history_limit, skew)
    rows = durable(recent.select(*LOGIN_METRIC_COLUMNS))  # read several times, and ranking is costly
    return {"gaps": login_gaps(rows, skew), "spread": geo_variance(rows, skew)}


LOGIN_METRIC_COLUMNS = (USER, EVENT, TIME, "latitude", "longitude")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.drop("percentage")


def apply_logins(profile: Profile, logins: DataFrame) -> Profile:
    """Counter update after scoring: no metric is recomputed, new users get none."""
    added = increments(logins, profile.totals, profile.times)
    return replace(profile, **{
        name: MERGES[name](_plain(getattr(profile, name)).unionByName(_plain(rows))) for name, rows in added.items()})


def upsert(existing: DataFrame, updates: DataFrame, key: str = USER) -> DataFrame:
    """Replace every row of the keys present in ``updates``."""
    updates = durable(updates)  # read twice
    kept = existing.join(updates.select(key).distinct(), key, "left_anti")
    return kept.unionByName(updates)


def orphans(child: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows whose user has no profile."""
    return child.join(profiles.select(USER), USER, "left_anti")


def flat_profile(profile: Profile) -> DataFrame:
    """One flat row per user: totals, table sizes, busiest hour and day, metrics."""
    devices = profile.devices.groupBy(USER).agg(
        F.count("*").alias("devices"), F.max("count").alias("top_device_logins"))
    places = profile.locations.groupBy(USER).agg(F.count("*").alias("locations"))
    hours = profile.hours.groupBy(USER).agg(F.max_by("hour", F.struct("count", -F.col("hour"))).alias("top_hour"))
    days = profile.days.groupBy(USER).agg(F.max_by("day", F.struct("count", -F.col("day"))).alias("top_day"))
    out = profile.totals
    # What is computed from more than counters is fixed first, so that the joins hold rows per user alone.
    for part in (devices, durable(places), hours, days, durable(profile.gaps), durable(profile.spread)):
        out = out.join(part, USER, "left")
    return out


def with_entries(flat: DataFrame, profile: Profile) -> DataFrame:
    """The whole profile: the flat rows, and a row for each device, cell, hour and weekday of a user.

    ``part`` tells the rows apart; columns of other parts are null. Devices and cells have no
    bound per user, so they are rows rather than maps.
    """
    out = flat.withColumn("part", F.lit("user"))
    entries = {"device": profile.devices, "location": profile.locations.drop("first_order"),
               "hour": profile.hours, "day": profile.days}
    for part, rows in entries.items():
        out = out.unionByName(rows.withColumn("part", F.lit(part)), allowMissingColumns=True)
    return out


def nested_profile(profile: Profile) -> DataFrame:
    """One row per user, at any size: totals, hour and weekday maps, metrics.

    Devices and cells, which have no bound, are the rows of ``nested_entries``.
    """
    def as_map(table, key, name):
        return table.groupBy(USER).agg(F.map_from_entries(F.collect_list(F.struct(key, "count"))).alias(name))

    metrics = profile.gaps.join(profile.spread, USER, "full").select(
        USER, F.struct(F.struct(*GAP_FIELDS).alias("login_velocity"),
                       F.struct(*SPREAD_FIELDS).alias("geo_variance")).alias("behavioral_metrics"))
    out = (profile.totals.join(as_map(profile.hours, "hour", "hour_distribution"), USER, "left")
           .join(as_map(profile.days, "day", "day_of_week_distribution"), USER, "left")
           .join(metrics, USER, "left"))
    return (out.withColumn("time_patterns", F.struct("hour_distribution", "day_of_week_distribution"))
            .drop("hour_distribution", "day_of_week_distribution"))


#: Buckets of ``nested_entries``: a user's devices and cells are dealt over so many map rows.
ENTRY_BUCKETS = 64


def nested_entries(profile: Profile, buckets: int = ENTRY_BUCKETS) -> DataFrame:
    """Devices and cells of every user as maps, in rows keyed (user, bucket) by a hash of the map key.

    Every user is bucketed alike; empty buckets have no row.
    """
    def maps(table, key, value, name):
        keyed = table.select(USER, key.alias("key"), value.alias("value"))
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
        return keyed.groupBy(USER, bucket).agg(
            F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(name))

    cell = F.concat_ws("_", F.format_string("%.3f", F.col("cell_lat") / 1000.0),
                       F.format_string("%.3f", F.col("cell_lon") / 1000.0))
    devices = maps(profile.devices, F.col("device_id"),
                   F.struct("count", "percentage", "first_seen", "last_seen"), "devices")
    places = maps(profile.locations, cell, F.struct("count", "lat", "lon", "first_seen", "last_seen"), "locations")
    return devices.join(places, [USER, "bucket"], "full")


def ingest_stats(batch: DataFrame, profiles: DataFrame) -> DataFrame:
    """How many users a batch touches, and how many of them are new."""
    users = batch.select(USER).distinct()
    known = users.join(profiles.select(USER, F.lit(True).alias("_known")), USER, "left")
    return known.agg(F.count("*").alias("users_processed"),
                     F.count_if(F.col("_known").isNull()).alias("new_users"),
                     F.count_if(F.col("_known").isNotNull()).alias("updated_users"))
