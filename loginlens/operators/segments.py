"""Ordered per-user history that stays parallel when one user is huge.

A window partitioned by user puts all rows of a user into one task. Here users
holding more than a fixed share of all rows are cut into consecutive time
segments. Windows run inside (user, segment); what must flow across a segment
border (a running count, the last row, the first row) is aggregated once per
segment, scanned over the few segments of the user, and joined back. The result
is exactly that of the plain window.

Size bounds: with share s at most 1/s users are hot and at most 2/s segments
exist, whatever the data volume. That proves the broadcasts below safe.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlens.functions import clock
from loginlens.schema import EVENT, TIME, USER
from loginlens.session import durable

QUANTILES = 1024
SEGMENT = "segment"


@dataclass(frozen=True)
class SkewPolicy:
    """When a user is cut up: above ``share`` of all rows and above ``min_rows``.

    ``measured`` fixes the list of hot users of one table, so that the steps of
    a job count them once. Which users are on it affects speed only: results
    are the same with any list.
    """

    share: float = 1 / QUANTILES
    min_rows: int = 1_000_000
    known: DataFrame | None = None
    is_measured: bool = False

    def limit(self, total_rows: int) -> int:
        return int(max(self.min_rows, total_rows * self.share))

    def measured(self, logins: DataFrame) -> "SkewPolicy":
        if self.is_measured:
            return self
        return replace(self, known=self._count(logins), is_measured=True)

    def hot(self, logins: DataFrame) -> DataFrame | None:
        """(user, rows, segments) of hot users, at most 1/share of them; None for none."""
        return self.measured(logins).known

    def _count(self, logins: DataFrame) -> DataFrame | None:
        total = logins.count()
        limit = self.limit(total)
        if total <= limit:
            return None
        segments = F.least(F.ceil(F.col("rows") / limit), F.lit(QUANTILES)).cast("int")
        hot = durable(logins.groupBy(USER).agg(F.count("*").alias("rows"))
                      .where(F.col("rows") > limit).withColumn("segments", segments))
        return None if hot.isEmpty() else hot


SKEW = SkewPolicy()


def segment_bounds(logins: DataFrame, hot: DataFrame) -> DataFrame:
    """(user, bounds): times that cut a hot user's history into parts of similar size."""
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    cuts = (logins.join(F.broadcast(hot.select(USER, "segments")), USER)
            .groupBy(USER, "segments")
            .agg(F.percentile_approx(clock.micros_since_epoch(TIME), steps).alias("q")))
    picked = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("segments") - 1, F.lit(1))),
        lambda i: F.element_at("q", F.greatest(F.floor(i * QUANTILES / F.col("segments")), F.lit(1)).cast("int")))
    # Approximate quantiles may differ between evaluations, so fix them once.
    return durable(cuts.select(USER, F.array_distinct(picked).alias("bounds")))


def join_per_user(rows: DataFrame, table: DataFrame, skew: SkewPolicy = SKEW, how: str = "inner") -> DataFrame:
    """Join logins with a table keyed by user, without gathering a hot user's logins.

    The logins of hot users are salted by a hash of the row, and the few table
    rows of those users are copied to every salt. Copies are bounded: at most
    1/share users, with twice as many salts in total.
    """
    hot = skew.hot(rows)
    if hot is None:
        return rows.join(table, USER, how)
    marks = F.broadcast(hot.select(USER, F.col("segments").alias("_salts")))
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_salts").cast("bigint")))
    left = rows.join(marks, USER, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts") - 1, F.lit(0)).cast("bigint"))
    right = table.join(marks, USER, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [USER, "_salt"], how).drop("_salt")


def join_per_key(rows: DataFrame, table: DataFrame, keys: list[str], skew: SkewPolicy = SKEW) -> DataFrame:
    """Left join of logins with a table of one row per (user, keys), a key that many logins share not being gathered.

    Only a hot user can have a key of more than a segment's worth of logins. Such keys
    are at most as many as there are segments, so their table rows are broadcast.
    """
    on = [USER, *keys]
    hot = skew.hot(rows)
    if hot is None:
        return rows.join(table, on, "left")
    share = F.broadcast(hot.select(USER, (F.col("rows") / F.col("segments")).alias("_share")))
    crowded = (rows.select(*on).join(share, USER).groupBy(*on).agg(F.count("*").alias("_n"), F.first("_share").alias("_share"))
               .where(F.col("_n") > F.col("_share")).select(*on))
    few = durable(F.broadcast(crowded).join(table, on))
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(table, on, "left")
    return rows.join(F.broadcast(few), on).unionByName(rest)


def cut_segments(logins: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """Add the segment number: 0 for ordinary users, 1..k for hot ones."""
    if bounds is None:
        return logins.withColumn(SEGMENT, F.lit(0))
    at = clock.micros_since_epoch(TIME)
    return (logins.join(F.broadcast(bounds), USER, "left")
            .withColumn("_at", at)
            .withColumn(SEGMENT, F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(
                F.size(F.filter("bounds", lambda b: b <= F.col("_at"))) + 1))
            .drop("bounds", "_at"))


@dataclass(frozen=True)
class Ordered:
    """Logins in (timestamp, event_id) order, with segment-aware window helpers.

    Each helper returns a new ``Ordered`` whose rows carry one more column.
    ``by`` narrows the history to rows that agree on further columns. When the
    number of ``by`` values per user is bounded, pass ``small=True`` so that
    the carried rows are broadcast.
    """

    rows: DataFrame
    is_hot: bool = False

    @classmethod
    def of(cls, logins: DataFrame, skew: SkewPolicy = SKEW) -> "Ordered":
        hot = skew.hot(logins)
        if hot is None:
            return cls(cut_segments(logins, None).repartition(USER))
        rows = cut_segments(logins, segment_bounds(logins, hot))
        return cls(rows.repartition(USER, SEGMENT), True)

    def _next(self, rows: DataFrame) -> "Ordered":
        return Ordered(rows, self.is_hot)

    def _window(self, by=()):
        return Window.partitionBy(USER, SEGMENT, *by).orderBy(TIME, EVENT)

    def _carry(self, by, agg: Column, scan, small: bool) -> DataFrame:
        """One value per (user, segment, by) brought in from other segments."""
        keys = [USER, *by]
        summary = (self.rows.where(F.col(SEGMENT) > 0)
                   .groupBy(USER, SEGMENT, *by).agg(agg.alias("_own")))
        carried = summary.select(
            USER, SEGMENT, *by,
            scan(F.col("_own"), Window.partitionBy(*keys).orderBy(SEGMENT)).alias("_carry"))
        return F.broadcast(carried) if small else carried

    def _with_carry(self, name, inside, by, agg, scan, combine, small):
        rows = self.rows.withColumn(name, inside)
        if not self.is_hot:
            return self._next(rows)
        carry = self._carry(by, agg, scan, small)
        rows = rows.join(carry, [USER, SEGMENT, *by], "left")
        return self._next(rows.withColumn(name, combine(F.col(name), F.col("_carry")))
                          .drop("_carry"))

    def count_before(self, name: str, by=(), small=False) -> "Ordered":
        """Number of strictly earlier logins."""
        w = self._window(by).rowsBetween(Window.unboundedPreceding, -1)
        return self._with_carry(
            name, F.count(F.lit(1)).over(w), by, F.count(F.lit(1)),
            lambda own, over: F.sum(own).over(over.rowsBetween(Window.unboundedPreceding, -1)),
            lambda inside, carry: inside + F.coalesce(carry, F.lit(0)), small)

    def sums_before(self, values: dict[str, Column]) -> "Ordered":
        """Sums of decimal columns over strictly earlier logins, zero for the first; one window for all.

        Sums are decimal(38,0), so they do not depend on how the history is cut.
        """
        w = self._window().rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("decimal(38,0)")
        total = lambda c: F.coalesce(F.sum(c).cast("decimal(38,0)"), zero)
        inside = F.struct(*[F.coalesce(F.sum(c).over(w).cast("decimal(38,0)"), zero).alias(k) for k, c in values.items()])
        agg = F.struct(*[total(c).alias(k) for k, c in values.items()])
        scan = lambda own, over: F.struct(*[
            F.coalesce(F.sum(own[k]).over(over.rowsBetween(Window.unboundedPreceding, -1)).cast("decimal(38,0)"), zero).alias(k)
            for k in values])
        add = lambda a, b: F.struct(*[
            (a[k] + F.coalesce(b[k], zero)).cast("decimal(38,0)").alias(k) for k in values])
        out = self._with_carry("_sums", inside, (), agg, scan, add, True)
        return self._next(out.rows.withColumns({k: F.col(f"_sums.{k}") for k in values}).drop("_sums"))

    def number(self, name: str) -> "Ordered":
        """1-based position of the login in the user's history."""
        out = self.count_before(name, small=True)
        return self._next(out.rows.withColumn(name, F.col(name) + 1))

    def previous(self, name: str, value: Column) -> "Ordered":
        """``value`` (a struct) of the preceding login, null for the first."""
        return self._with_carry(
            name, F.lag(value).over(self._window()), (),
            F.max_by(value, F.struct(TIME, EVENT)),
            lambda own, over: F.lag(own).over(over),
            lambda inside, carry: F.coalesce(inside, carry), True)

    def following(self, name: str, value: Column) -> "Ordered":
        """``value`` (a struct) of the next login, null for the last."""
        return self._with_carry(
            name, F.lead(value).over(self._window()), (),
            F.min_by(value, F.struct(TIME, EVENT)),
            lambda own, over: F.lead(own).over(over),
            lambda inside, carry: F.coalesce(inside, carry), True)

    def first(self, name: str, value: Column, by) -> "Ordered":
        """``value`` (a struct) of the earliest login agreeing on ``by``."""
        return self._with_carry(
            name, F.first(value).over(self._window(by)), by,
            F.min_by(value, F.struct(TIME, EVENT)),
            lambda own, over: F.first(own, ignorenulls=True).over(
                over.rowsBetween(Window.unboundedPreceding, -1)),
            lambda inside, carry: F.coalesce(carry, inside), False)

    def result(self) -> DataFrame:
        return self.rows.drop(SEGMENT)


def latest(logins: DataFrame, n: int, skew: SkewPolicy = SKEW) -> DataFrame:
    """The newest ``n`` rows per user, exact.

    Spark limits each map task to ``n`` rows per user before the shuffle. For
    hot users that is repeated on salted groups first, so that no task receives
    more than salts * n rows of one user.
    """
    hot = skew.hot(logins)
    newest = (F.col(TIME).desc(), F.col(EVENT).desc())
    if hot is not None:
        salt = F.pmod(F.xxhash64(EVENT), F.lit(QUANTILES))
        marked = (logins.join(F.broadcast(hot.select(USER, F.lit(True).alias("_hot"))), USER, "left")
                  .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(-1))))
        local = Window.partitionBy(USER, "_salt").orderBy(*newest)
        logins = (marked.withColumn("_rank", F.row_number().over(local))
                  .where(F.col("_rank") <= n).drop("_rank", "_salt", "_hot"))
    return (logins.withColumn("recency", F.row_number().over(Window.partitionBy(USER).orderBy(*newest)))
            .where(F.col("recency") <= n))
