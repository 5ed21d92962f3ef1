"""Every quick query against its SQL twin; CHECK_ALL=1 adds the slow ones."""

import os

import duckdb
import pytest

from conftest import SF
import __spark_entry__ as contract
from loginlens.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SLOW = {"process_logins", "score_logins", "stream_ingest", "analyze_logins", "analyze_logins_native", "detector_details",
        "kmeans_fallback", "identify_patterns", "cluster_stats", "cluster_breakdown", "score_location"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(0.0 if r[i] == 0 and isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def names():
    everything = contract.queries()
    # The corpus operators have tests of their own.
    ours = [n for n in everything if n in catalog.QUERIES]
    return [n for n in ours if n not in SLOW or os.environ.get("CHECK_ALL")]


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in contract.oracle_sql():
        result = duck.execute(contract.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        assert table(df.columns, rows) == table(columns, result.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
