"""The score-store-update queries on patterns of every user, against plain counts."""

from collections import Counter

from conftest import SF
from loginlens.plans import catalog


def test_every_known_user_is_scored_stored_and_counted(spark):
    past = Counter(r.user_id for r in catalog.hist(spark, SF).select("user_id").collect())
    fresh = {r.event_id: r.user_id for r in catalog.fresh(spark, SF).select("event_id", "user_id").collect()}
    known = {e: u for e, u in fresh.items() if u in past}
    now = Counter(known.values())
    rows = catalog.QUERIES["score_logins_all_users"](spark, SF).collect()
    assert {r.event_id: r.user_id for r in rows} == known and len(rows) == len(known)
    assert all(r.total_after == past[r.user_id] + now[r.user_id] for r in rows)
    assert all(r.closest_cluster is not None for r in rows)


def test_every_known_user_has_a_location_score(spark):
    past = {r.user_id for r in catalog.hist(spark, SF).select("user_id").collect()}
    rows = catalog.QUERIES["score_location_all_users"](spark, SF).collect()
    assert len(rows) == catalog.fresh(spark, SF).count()
    assert all((r.closest_cluster is not None) == (r.user_id in past) for r in rows)
