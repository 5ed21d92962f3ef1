"""Stored login events, clustered by user.

Events of ordinary users lie in a bucketed table: one file per bucket and batch, sorted by
user and time inside. A query that groups, ranks or joins by user reads the buckets as they
are, so the store side is never shuffled; a query for named users opens their buckets
alone, and of these the row groups that hold them.

A user of more than `hot_rows` events would make one bucket, and so one task, too large.
From the batch in which a user is found hot, their events go to a second table in parts by
a hash of the event, which the skew-aware operators spread. What lay in the bucket before
stays there; it is at most `hot_rows` and one batch.

A third table holds the ids alone, clustered by id and with a Bloom filter per row group. By
it `unseen` finds events that any earlier batch has stored, however old and whatever else of
them has changed: a few ids are looked up by name, and the filters keep most row groups
closed; many are dealt to the buckets, and the ids stay where they are.

Each batch is a partition and is replaced whole, so a batch that is written again after a
failure leaves no trace of the first attempt. `compact` rewrites the batches up to one of
them as a single batch with one file per bucket.

The layout (number of buckets) is written beside the data once, and every session registers
the tables in its own catalog from there, under a name made from the path.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlens.operators.segments import SKEW, SkewPolicy, latest
from loginlens.schema import EVENT, TIME, USER
from loginlens.session import durable, shuffled_joins

#: Buckets of a new store unless told otherwise; a bucket of one batch is one file, so large stores take thousands.
BUCKETS = 16
HOT_ROWS = 1_000_000
#: Named users or ids up to this number are looked up in their buckets; more touch most buckets anyway.
NAMED_USERS = 4_096
#: Tables with buckets: what they are clustered and sorted by.
CLUSTERED = {"events": (USER, (USER, TIME, EVENT)), "ids": (EVENT, (EVENT,))}
HOT_PARTS = 64
NOTE = "part string, upto int, merged string"


@dataclass(frozen=True)
class EventStore:
    spark: SparkSession
    path: str
    buckets: int
    hot_rows: int
    named_users: int = NAMED_USERS

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = BUCKETS, hot_rows: int = HOT_ROWS) -> "EventStore":
        """The store below `path`; a new one if there is none, an old one with the layout it was made with."""
        path = path.rstrip("/")
        if not _exists(spark, f"{path}/layout/_SUCCESS"):
            spark.createDataFrame([(buckets, hot_rows)], "buckets int, hot_rows long").coalesce(1).write.mode(
                "overwrite").json(f"{path}/layout")
        kept = spark.read.schema("buckets int, hot_rows long").json(f"{path}/layout").first()
        store = cls(spark, path, kept["buckets"], kept["hot_rows"])
        store._finish_compaction()
        return store

    # ---- writing

    def append(self, events: DataFrame, batch_id: int) -> None:
        """Write one batch, in place of an earlier attempt at it."""
        with shuffled_joins(self.spark):
            events = durable(events)  # read for counts and for two tables
            hot = self._hot_users(events, batch_id)
            marked = events if hot is None else events.join(F.broadcast(hot), USER, "left_anti")
            self._write("events", marked.repartition(self.buckets, USER), batch_id)
            if hot is not None:
                spread = F.pmod(F.xxhash64(EVENT), F.lit(HOT_PARTS))
                self._write("hot", events.join(F.broadcast(hot), USER, "left_semi").repartition(HOT_PARTS, spread), batch_id)
            elif _exists(self.spark, f"{self.path}/hot/batch_id={batch_id}"):
                self._write("hot", events.limit(0), batch_id)
            self._write("ids", events.select(EVENT).distinct().repartition(self.buckets, EVENT), batch_id)

    def _hot_users(self, events: DataFrame, batch_id: int) -> DataFrame | None:
        """Users with over `hot_rows` events in other batches and this one; the bound keeps them few.

        Only users of this batch are counted, in the file footers and buckets that hold them.
        """
        here = events.groupBy(USER).agg(F.count("*").alias("n"))
        known = self.hot_users()
        before = self._table("events")
        if before is not None:
            before = before.where(F.col("batch_id") != batch_id)
            # Both sides are clustered by user already or small; the store is not shuffled.
            earlier = before.groupBy(USER).agg(F.count("*").alias("m"))
            here = here.join(earlier, USER, "left").select(USER, (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        hot = here.where(F.col("n") > self.hot_rows).select(USER)
        hot = durable(hot if known is None else hot.union(known).distinct())
        return None if hot.isEmpty() else hot

    def hot_users(self) -> DataFrame | None:
        """Users whose newer events lie in the second table: at most one per `hot_rows` events or part of a batch."""
        held = self._table("hot")
        return None if held is None else held.select(USER).distinct()

    def _write(self, part: str, rows: DataFrame, batch_id: int) -> None:
        name = self._register(part, rows.drop("batch_id"))
        view = f"batch_{uuid.uuid4().hex}"
        rows.drop("batch_id").createOrReplaceTempView(view)
        session = rows.sparkSession
        columns = ", ".join(f"`{c}`" for c in session.table(name).columns if c != "batch_id")
        session.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch_id = {int(batch_id)}) SELECT {columns} FROM {view}")
        session.catalog.dropTempView(view)
        session.catalog.refreshTable(name)

    def compact(self, upto: int) -> None:
        """One batch in place of all batches up to `upto`; readers must be done with those.

        The merged rows are written aside first, and a note says where. Whoever opens the
        store and finds the note finishes the exchange, which may be done any number of times.
        """
        for part in ("events", "hot", "ids"):
            held = self._table(part)
            if held is not None:
                merged = durable(held.where(F.col("batch_id") <= upto).drop("batch_id"))
                note = [(part, upto, merged._durable_path)]
                self.spark.createDataFrame(note, NOTE).coalesce(1).write.mode("overwrite").json(f"{self.path}/compacting")
                self._finish_compaction()

    def _finish_compaction(self) -> None:
        note = f"{self.path}/compacting"
        if not _exists(self.spark, f"{note}/_SUCCESS"):
            return
        r = self.spark.read.schema(NOTE).json(note).first()
        part, upto = r["part"], r["upto"]
        merged = self.spark.read.parquet(r["merged"])
        deal = ((self.buckets, CLUSTERED[part][0]) if part in CLUSTERED
                else (HOT_PARTS, F.pmod(F.xxhash64(EVENT), F.lit(HOT_PARTS))))
        self._write(part, merged.repartition(*deal), upto)
        batches = self._table(part).where(F.col("batch_id") < upto).select("batch_id").distinct().collect()
        for batch in batches:  # one number a batch since the last compaction
            _delete(self.spark, f"{self.path}/{part}/batch_id={batch['batch_id']}")
        self.spark.catalog.refreshTable(self._name(part))
        _delete(self.spark, note)

    # ---- reading

    def events(self, upto: int | None = None) -> DataFrame:
        """All events, or those of the batches up to and including one."""
        parts = [self.ordinary(upto), self.hot(upto)]
        parts = [p for p in parts if p is not None]
        if not parts:
            raise ValueError(f"no events are stored in {self.path}")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def ordinary(self, upto: int | None = None) -> DataFrame | None:
        return self._upto("events", upto)

    def hot(self, upto: int | None = None) -> DataFrame | None:
        return self._upto("hot", upto)

    def batch(self, batch_id: int) -> DataFrame:
        """The events of one batch."""
        held = [t.where(F.col("batch_id") == batch_id).drop("batch_id")
                for t in (self._table("events"), self._table("hot")) if t is not None]
        return held[0] if len(held) == 1 else held[0].unionByName(held[1])

    def _upto(self, part: str, upto: int | None) -> DataFrame | None:
        held = self._table(part)
        if held is None:
            return None
        return (held if upto is None else held.where(F.col("batch_id") <= upto)).drop("batch_id")

    def of_users(self, users: DataFrame, upto: int | None = None) -> DataFrame:
        """Events of wanted users. Few are looked up by name in their buckets; for many, buckets are joined in place."""
        wanted = durable(users.select(USER).distinct())
        names = [r[USER] for r in wanted.limit(self.named_users + 1).collect()]
        rows = self.events(upto)
        if len(names) <= self.named_users:
            return rows.where(F.col(USER).isin([n for n in names if n is not None]))
        return rows.join(wanted, USER, "left_semi")

    def unseen(self, events: DataFrame, upto: int | None = None) -> DataFrame:
        """`events` without those whose id a batch up to `upto` has stored."""
        held = self._upto("ids", upto)
        if held is None:
            return events
        new = durable(events.select(EVENT).distinct())
        names = [r[EVENT] for r in new.limit(self.named_users + 1).collect()]
        if len(names) <= self.named_users:
            seen = held.where(F.col(EVENT).isin([n for n in names if n is not None]))
        else:
            seen = held.join(new, EVENT, "left_semi")
        return events.join(seen, EVENT, "left_anti")

    def latest(self, n: int, upto: int | None = None, users: DataFrame | None = None, skew: SkewPolicy = SKEW) -> DataFrame:
        """The newest `n` events per user; within the buckets for ordinary users, by parts first for hot ones."""
        rows = self.events(upto) if users is None else self.of_users(users, upto)
        if self.hot(upto) is None:
            known = SkewPolicy(skew.share, skew.min_rows, None, True)  # no user of the buckets is hot
            return latest(rows, n, known)
        return latest(rows, n, skew)

    # ---- the catalog

    def _name(self, part: str) -> str:
        return f"login_{part}_{hashlib.md5(self.path.encode()).hexdigest()}"

    def _table(self, part: str) -> DataFrame | None:
        name = self._name(part)
        if not self.spark.catalog.tableExists(name):
            if not _exists(self.spark, f"{self.path}/{part}"):
                return None
            self._register(part, self.spark.read.parquet(f"{self.path}/{part}").drop("batch_id"))
        return self.spark.table(name)

    def _register(self, part: str, rows: DataFrame) -> str:
        name = self._name(part)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        clustered = options = ""
        if part in CLUSTERED:
            by, order = CLUSTERED[part]
            clustered = f"CLUSTERED BY ({by}) SORTED BY ({', '.join(order)}) INTO {self.buckets} BUCKETS"
            options = f"OPTIONS ('parquet.bloom.filter.enabled#{by}' = 'true')"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch_id INT) USING parquet {options} "
                       f"PARTITIONED BY (batch_id) {clustered} LOCATION '{self.path}/{part}'")
        return name


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _exists(spark: SparkSession, path: str) -> bool:
    files, found = _path(spark, path)
    return files.exists(found)


def _delete(spark: SparkSession, path: str) -> None:
    files, found = _path(spark, path)
    files.delete(found, True)
