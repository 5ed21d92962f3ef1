"""Users labelled in one task get the labels of the distributed steps."""

from collections import Counter

import numpy as np
import pytest

from loginlens.operators import dbscan, identify, local_clusters


def counted(labelled):
    return Counter(tuple(r) for r in labelled.select("user_id", "event_id", "device_id", "latitude", "cluster").collect())


@pytest.fixture(scope="module")
def mixed(make):
    """Users with clusters, without any, with a single login, with repeated rows, with gaps, and logins without a user."""
    rng = np.random.default_rng(5)
    rows = [(e, f"u{e % 5}", f"2024-01-{1 + e % 9:02d} {8 + e % 4:02d}:{e % 60:02d}:00", 10.0 + float(rng.integers(0, 4)),
             20.0 + float(rng.normal(0, 1)) * (e % 5), f"d{e % 2}") for e in range(200)]
    rows += [(300, "alone", "2024-01-01 10:00:00", 1.0, 2.0, "d")]
    rows += [(400 + e, "twice", f"2024-01-0{1 + e % 3} 10:00:00", float(e), 179.0 * (-1) ** e, "d") for e in range(6)] * 2
    rows += [(500 + e, "gaps", f"2024-01-0{1 + e} 10:00:00", float(e) if e != 2 else None, 2.0, "d" if e != 4 else None) for e in range(8)]
    rows += [(600 + e, None, "2024-01-01 10:00:00", 1.0, 2.0, "d") for e in range(6)]
    return make(rows)


def test_labels_are_those_of_the_steps(mixed):
    assert counted(dbscan.dbscan(mixed)) == counted(dbscan.dbscan_in_steps(mixed))
    assert counted(identify.label_logins(mixed)) == counted(identify.label_in_steps(mixed))


@pytest.mark.parametrize("limit", ["LOCAL_LOGINS", "GROUP_LOGINS"])
def test_labels_do_not_depend_on_who_is_large(mixed, monkeypatch, limit):
    want = counted(identify.label_logins(mixed))
    monkeypatch.setattr(local_clusters, "GROUP_LOGINS", 5)
    if limit == "LOCAL_LOGINS":
        monkeypatch.setattr(local_clusters, "LOCAL_LOGINS", 10)
    assert counted(identify.label_logins(mixed)) == want


def test_ordinary_users_are_not_carried_through_the_steps(logins, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("joined")
    monkeypatch.setattr(dbscan, "scaled_sites", never)
    assert identify.label_logins(logins).count() == logins.count()


def test_a_user_of_one_large_group_is_left_to_the_steps(make):
    rows = [(e, "u", "2024-01-01 10:00:00", float(e), 2.0, "d") for e in range(local_clusters.GROUP_LOGINS + 1)]
    assert [r.user_id for r in local_clusters._not_local(make(rows)).collect()] == ["u"]
    assert local_clusters._not_local(make(rows[1:])) is None
