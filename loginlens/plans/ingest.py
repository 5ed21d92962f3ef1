"""Batch ingest: store events, build or merge profiles, renew patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loginlens.operators.identify import identify_patterns
from loginlens.operators.profiles import Profile, ingest_stats, recent_metrics, touched_metrics
from loginlens.operators.segments import SKEW, SkewPolicy, latest
from loginlens.operators.quality import ensure_valid
from loginlens.schema import EVENT, USER, require_columns
from loginlens.session import durable
from loginlens.sources.event_store import BUCKETS, EventStore
from loginlens.sources.profile_log import ProfileLog, increments_after
from loginlens.sources.sinks import login_events


@dataclass(frozen=True)
class Snapshot:
    """Profiles and patterns after one batch."""

    profile: Profile
    patterns: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Snapshot":
        """The snapshot that ``snapshot_path`` names, put together from the log of its store."""
        store, version = path.rsplit("/snapshots/", 1)
        log = ProfileLog(spark, store)
        return cls(log.profile(int(version)), log.patterns(int(version)))


def snapshot_path(store: str, batch_id: int) -> str:
    return f"{store}/snapshots/{batch_id}"


def stored_events(spark: SparkSession, store: str, batch_id: int) -> DataFrame:
    """Events of all batches up to and including one."""
    return EventStore.open(spark, store).events(batch_id)


def process_logins(batch: DataFrame, store: str, batch_id: int, previous: int | None,
                   history: str = "stored", skew: SkewPolicy = SKEW, history_limit: int | None = None,
                   buckets: int = BUCKETS) -> DataFrame:
    """Ingest one batch and return (users_processed, new_users, updated_users).

    Events go to a store clustered by user; ``buckets`` is the layout of a new one.
    Profiles and patterns go to a log, of which a batch writes its own changes. Running
    the same batch again replaces its own output and never the input. Rows that fail the
    quality checks go to a reject table; logins stored by an earlier batch are
    not stored or counted again. Metrics follow from counts that add up; patterns of the
    batch's users come from their stored events (or the newest ``history_limit`` of them,
    then of the metrics too), in the first batch as in later ones; ``history='batch'``
    takes patterns from the batch alone.
    """
    if history not in ("stored", "batch"):
        raise ValueError("history must be 'stored' or 'batch'")
    spark = batch.sparkSession
    require_columns(batch)
    kept, log = EventStore.open(spark, store, buckets), ProfileLog(spark, store)
    valid = ensure_valid(batch)
    batch.join(valid.select(EVENT).distinct(), EVENT, "left_anti").write.mode("overwrite").parquet(
        f"{store}/rejects/batch_id={batch_id}")
    events = login_events(valid)
    if previous is not None:
        events = kept.unseen(events, previous)
    kept.append(events, batch_id)
    logins = kept.batch(batch_id)

    added = increments_after(logins, log, previous, skew)
    added = {**added, "gap_counts": durable(added["gap_counts"])}
    users = added["totals"].select(USER)
    before = {name: None if previous is None else log.read(name, previous, users)
              for name in ("totals", "gap_counts", "coordinates")}
    before = {name: added[name].limit(0) if rows is None else rows for name, rows in before.items()}
    stats = durable(ingest_stats(logins, before["totals"]))
    stored = None if history == "batch" and history_limit is None else kept.of_users(logins, batch_id)
    if history_limit is None:
        metrics = touched_metrics(added, before["gap_counts"], before["coordinates"])
    else:
        metrics = recent_metrics(logins, stored, history_limit, skew)
    source = logins if history == "batch" else stored
    if history_limit is not None:
        source = latest(source, history_limit, skew).drop("recency")
    log.commit(batch_id, added, {**metrics, "patterns": identify_patterns(source, skew=skew)})
    return stats
