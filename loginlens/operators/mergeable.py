"""Gap and spread metrics as sums of changes, so that a merge needs no stored events.

Three tables stand behind the metrics, and all of them add up:

* `gap_counts` (user, gap in microseconds, times): how often each gap between
  neighbouring logins occurs. Mean, deviation, extremes and the exact median are read off.
* `times` (user, segment, times): the login times of a user by segments of an hour.
* `coordinates` (user, latitude, longitude, count): the distinct places. When the mean
  centre moves, the distances to it are computed again from these.

New logins change the gaps around them. For a user whose new logins come after the known
ones, only the last known time matters. New logins among known ones are spliced in: in
every segment that they touch, and in the next one after it, the gaps that end there are
counted as they were and as they are, and the difference is the change. Whether the new
logins come in order, late, or overlap with other batches, the counts equal those of all
logins together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlens.functions import clock, geo
from loginlens.operators.segments import SKEW, Ordered, SkewPolicy
from loginlens.schema import EVENT, TIME, USER
from loginlens.session import durable

SEGMENT_MICROS = clock.MICROS_PER_HOUR
GAP = "gap_us"


# ---- the tables of some logins

def login_times(logins: DataFrame) -> DataFrame:
    at = clock.micros_since_epoch(TIME)
    return logins.groupBy(USER, F.floor(at / SEGMENT_MICROS).alias("slot")).agg(
        F.sort_array(F.collect_list(at)).alias("times"))


def gap_counts(logins: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    ordered = Ordered.of(logins.select(USER, TIME, EVENT), skew).previous("_prev", F.struct(TIME))
    gaps = ordered.rows.withColumn(GAP, clock.micros_between(F.col(f"_prev.{TIME}"), TIME))
    return gaps.where(F.col(GAP).isNotNull()).groupBy(USER, GAP).agg(F.count("*").alias("times"))


def coordinates(logins: DataFrame) -> DataFrame:
    return logins.groupBy(USER, "latitude", "longitude").agg(F.count("*").alias("count"))


# ---- adding tables up

def merge_times(rows: DataFrame) -> DataFrame:
    return rows.groupBy(USER, "slot").agg(F.sort_array(F.flatten(F.collect_list("times"))).alias("times"))


def merge_gap_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(USER, GAP).agg(F.sum("times").alias("times")).where("times <> 0")


def merge_coordinates(rows: DataFrame) -> DataFrame:
    return rows.groupBy(USER, "latitude", "longitude").agg(F.sum("count").alias("count"))


def gap_changes(batch: DataFrame, totals: DataFrame, times: DataFrame, skew: SkewPolicy = SKEW) -> DataFrame:
    """What a batch changes in `gap_counts` of the users that have `totals` and `times` already.

    `totals` (user_id, last_login) tells late users from others; `times` is read for late users only.
    """
    last = totals.select(USER, F.col("last_login").alias("_last"))
    first = durable(batch.groupBy(USER).agg(F.min(TIME).alias("_first")).join(last, USER, "left"))
    late = first.where(F.col("_first") < F.col("_last")).select(USER)
    none_late = late.isEmpty()
    inside = gap_counts(batch if none_late else batch.join(late, USER, "left_anti"), skew)
    joint = first.where(F.col("_first") >= F.col("_last")).select(
        USER, clock.micros_between("_last", "_first").alias(GAP), F.lit(1).cast("bigint").alias("times"))
    if none_late:
        return merge_gap_counts(inside.unionByName(joint))
    spliced = splice(times.join(late, USER, "left_semi"), login_times(batch.join(late, USER, "left_semi")))
    return merge_gap_counts(inside.unionByName(joint).unionByName(spliced))


def splice(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of gap counts when the times of `new` come among those of `old`, by (user, slot)."""
    none = F.array().cast("array<bigint>")
    both = old.withColumnRenamed("times", "_old").join(new.withColumnRenamed("times", "_new"), [USER, "slot"], "full")
    both = both.withColumns({"_old": F.coalesce("_old", none), "_new": F.coalesce("_new", none)})
    both = both.withColumn("_all", F.when(F.size("_new") > 0, F.sort_array(F.concat("_old", "_new"))).otherwise(F.col("_old")))
    before = Window.partitionBy(USER).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)

    def ending(times: str) -> Column:
        return F.last(F.when(F.size(times) > 0, F.element_at(times, -1)), ignorenulls=True).over(before)

    placed = both.withColumns({"_old_left": ending("_old"), "_all_left": ending("_all")})
    touched = placed.where((F.size("_new") > 0) | ~F.col("_old_left").eqNullSafe(F.col("_all_left")))

    def gaps(left: str, times: str) -> Column:
        chain = F.concat(F.when(F.col(left).isNotNull(), F.array(left)).otherwise(none), F.col(times))
        return F.when((F.size(times) > 0) & (F.size(chain) > 1), F.zip_with(
            F.slice(chain, 2, F.size(chain) - 1), F.slice(chain, 1, F.size(chain) - 1), lambda a, b: a - b)).otherwise(none)

    changes = touched.select(USER, F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("sign"), gaps("_all_left", "_all").alias("gaps")),
        F.struct(F.lit(-1).cast("bigint").alias("sign"), gaps("_old_left", "_old").alias("gaps")))).alias("_c"))
    return merge_gap_counts(changes.select(USER, F.explode("_c.gaps").alias(GAP), F.col("_c.sign").alias("times")))


# ---- the metrics

def _exact(value: Column) -> Column:
    """A sum that does not depend on the order of rows, so that a merged metric is a rebuilt one to the last bit."""
    return F.sum(value.cast("decimal(38,15)")).cast("double")


def gaps_of(counts: DataFrame, users: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and exact median in hours of each of `users`; null without gaps."""
    hours = F.col(GAP) / F.lit(float(clock.MICROS_PER_HOUR))
    summary = counts.groupBy(USER).agg(
        F.sum("times").alias("_n"),
        (F.sum(F.col(GAP).cast("decimal(18,0)") * F.col("times").cast("decimal(18,0)")).cast("double")
         / F.sum("times") / float(clock.MICROS_PER_HOUR)).alias("mean_gap_h"),
        F.min(hours).alias("min_gap_h"), F.max(hours).alias("max_gap_h"))
    upto = F.sum("times").over(Window.partitionBy(USER).orderBy(GAP))
    near = counts.withColumn("_upto", upto).join(summary.select(USER, "_n", "mean_gap_h"), USER)
    off = hours - F.col("mean_gap_h")
    rest = near.groupBy(USER).agg(
        F.sqrt(_exact(off * off * F.col("times")) / F.first("_n")).alias("std_gap_h"),
        ((F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) / 2), hours))
          + F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), hours))) / 2).alias("median_gap_h"))
    return users.select(USER).join(summary.drop("_n"), USER, "left").join(rest, USER, "left").select(
        USER, "mean_gap_h", "std_gap_h", "min_gap_h", "max_gap_h", "median_gap_h")


def spread_of(places: DataFrame, fields) -> DataFrame:
    """The dispersion fields of each user, all equal to the standard distance."""
    times = F.col("count")
    lat, lon = F.radians("latitude"), F.radians("longitude")
    mean = places.groupBy(USER).agg(
        F.sum("count").alias("_n"), *[(_exact(c * times) / F.sum("count")).alias(name) for name, c in {
            "mean_x": F.cos(lat) * F.cos(lon), "mean_y": F.cos(lat) * F.sin(lon), "mean_z": F.sin(lat)}.items()])
    centre = mean.select(USER, "_n", geo.center_lat().alias("_lat"), geo.center_lon().alias("_lon"))
    away = geo.haversine_km("latitude", "longitude", "_lat", "_lon")
    rms = F.sqrt(_exact(away * away * times) / F.first("_n"))
    return (places.join(centre, USER).groupBy(USER).agg(F.when(F.first("_n") <= 1, 0.0).otherwise(rms).alias("_d"))
            .select(USER, *[F.col("_d").alias(name) for name in fields]))
