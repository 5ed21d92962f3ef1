"""Score a batch of logins, store them with their verdict, and count them into the profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loginlens.operators.quality import ensure_valid
from loginlens.operators.scoring import analyze_logins
from loginlens.operators.seeded import replay_from_snapshot
from loginlens.operators.segments import SKEW, SkewPolicy
from loginlens.plans.ingest import Snapshot, snapshot_path
from loginlens.schema import EVENT, HISTORY_LIMIT, USER, require_columns
from loginlens.session import durable, shuffled_joins
from loginlens.sources.event_store import EventStore
from loginlens.sources.profile_log import ProfileLog, increments_after
from loginlens.sources.sinks import login_events


def replay_logins(batch: DataFrame, store: str, batch_id: int, previous: int, isolation: bool = True,
                  skew: SkewPolicy = SKEW, history_limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """Scores and details of a batch, each login against its user's state just before it; stores and counts them.

    As ``score_logins``, but the state advances within the batch too, so what is returned
    does not depend on how a history is cut into batches. Only rows of the batch's users are
    read: their snapshot from the log, their patterns, and for the forest the newest
    ``history_limit`` of their events that the last ingest has seen. Logins whose id is
    stored already are passed over.
    """
    spark = batch.sparkSession
    log, kept = ProfileLog(spark, store), EventStore.open(spark, store)
    with shuffled_joins(spark):
        valid = durable(login_events(ensure_valid(require_columns(batch))).drop("is_anomalous", "anomaly_score", "details"))
        fresh = durable(kept.unseen(valid, previous))
        users = durable(fresh.select(USER).distinct())
        patterns = log.patterns(previous, users)
        # The models learn from what was stored when the patterns were last renewed.
        renewed = max(v for v in log.written("patterns") if v <= previous)
        history = kept.latest(history_limit, renewed, users, skew).drop("recency") if isolation else None
        results = durable(replay_from_snapshot(fresh, log.seed(previous, users), patterns, history, skew=skew))
        accepted = results.where("stored")
        kept.append(login_events(fresh.join(accepted.select(EVENT).hint("merge"), EVENT, "left_semi"), accepted), batch_id)
        log.commit(batch_id, increments_after(kept.batch(batch_id), log, previous, skew), {})
    return results


def score_logins(batch: DataFrame, store: str, batch_id: int, previous: int, isolation: bool = True,
                 skew: SkewPolicy = SKEW) -> DataFrame:
    """Scores and details of a batch against snapshot ``previous``; makes it snapshot ``batch_id``.

    Logins of users with enough stored data are stored with verdict and details
    and added to the counters; those of other users get neutral scores and leave
    no trace. Gap and spread metrics and patterns stay as they were. Running the
    same batch again replaces its own output.
    """
    spark = batch.sparkSession
    with shuffled_joins(spark):
        old = Snapshot.read(spark, snapshot_path(store, previous))
        valid = ensure_valid(require_columns(batch))
        kept = EventStore.open(spark, store)
        results = durable(analyze_logins(valid, old.profile, old.patterns, kept.of_users(valid, previous), isolation, skew=skew))
        accepted = results.where("stored")
        kept.append(login_events(valid.join(accepted.select(EVENT).hint("merge"), EVENT, "left_semi"), accepted), batch_id)
        # Metrics and patterns stay; the counts behind the metrics move on, for the next ingest.
        ProfileLog(spark, store).commit(batch_id, increments_after(kept.batch(batch_id), ProfileLog(spark, store), previous, skew), {})
    return results
