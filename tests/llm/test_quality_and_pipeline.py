import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loginlens.llm import decontaminate, line_join, order_minhash, quality
from loginlens.llm.common import with_row_id
from loginlens.session import durable

from .conftest import SF


@pytest.fixture(scope="module")
def larger(spark):
    """Documents of the largest table that is quick to read, and their labels."""
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_held_out_accuracy(larger):
    docs, labels = larger
    first = labels.where(F.xxhash64("doc_id") % 3 != 0)
    rows = quality.classify(docs.select("doc_id", "source", "lang", "text"), docs, first, "source", "lang")
    held = (rows.join(labels.where(F.xxhash64("doc_id") % 3 == 0).groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t")), "doc_id").select("p_low", "p_toxic", "q", "t").toPandas())
    for column, unfit in (("p_low", held["q"] == 0), ("p_toxic", held["t"] == 1)):
        said = held[column] > 0.5
        assert (said & unfit).sum() / unfit.sum() > 0.9
        assert (said & ~unfit).sum() / (~unfit).sum() < 0.02


def test_sparse_sites_are_pulled_to_their_parents(spark):
    model = {"weights": {}, "traits": {"low": {"base": 0.2}, "toxic": {"base": 0.2}}}
    rows = [("bad", "x", 6.0)] * 400 + [("bad", "y", -6.0)] * 2 + [("good", "x", -6.0)] * 400 + [("new", "x", 6.0)]
    scored = spark.createDataFrame([(h, p, e, -6.0) for h, p, e in rows], "h string, p string, e_low double, e_toxic double")
    rates = {(r["_host"], r["_path"]): r for r in quality.site_rates(scored, "h", "p", model).collect()}
    plain = {"bad": 400 / 402, "good": 0.0, "new": 1.0}
    whole = 401 / 803
    for host, own in plain.items():
        shrunk = rates[(host, "x")]["host_low"]
        assert min(own, whole) - 0.01 <= shrunk <= max(own, whole) + 0.01
    # One document says less of its host than four hundred do.
    assert abs(rates[("new", "x")]["host_low"] - 1) > abs(rates[("bad", "x")]["host_low"] - plain["bad"])
    assert rates[("bad", "y")]["path_low"] < rates[("bad", "x")]["path_low"]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, None if i % 3 else 1) for i in range(1, 9)] + [(None, 1, 0), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = quality.classify(odd.withColumn("keep", F.lit("mine")), odd, marks, "source", "lang").collect()
        assert len(rows) == odd.count() and all(0 <= r.p_low <= 1 and r.keep in (True, False) for r in rows)
    assert all(r.keep for r in rows)  # without labels nothing is rejected
    assert quality.classify(none, odd, labels, "source", "lang").count() == 0


def test_logistic_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4_000, 2))
    y = (rng.random(4_000) < 1 / (1 + np.exp(-(x[:, 0] * 2 - 1)))).astype(float)
    beta = quality.fit_logistic(x, y)
    assert abs(beta[0] - 2) < 0.25 and abs(beta[1]) < 0.15 and abs(beta[2] + 1) < 0.15


def test_pipeline_stages(spark, documents):
    """Each stage against what its operator says of the very table that it was given."""
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = durable(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == documents.columns
        seen["after " + name] = docs
    ids = lambda frame: sorted(r.doc_id for r in frame.collect())
    rows = with_row_id(seen["decontamination"])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.contaminated(rows, bench).collect()}
    assert ids(seen["after decontamination"]) == sorted(set(ids(seen["decontamination"])) - hit)
    groups = order_minhash.groups(with_row_id(seen["near_dedup"])).collect()
    assert ids(seen["after near_dedup"]) == sorted(r.doc_id for r in groups if r.keep)
    lines = line_join.judged_lines(with_row_id(seen["line_dedup"])).where("not keep").collect()
    gone = {(r.doc_id, r.at) for r in lines}
    want = {}
    for r in seen["line_dedup"].collect():
        left = [x for at, x in enumerate(r.text.split("\n")) if (r.doc_id, at) not in gone]
        if left:
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in seen["after line_dedup"].collect()} == want
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in pieces) and sorted(r.doc_id for r in pieces) == ids(seen["packing"])


def test_pipeline_on_an_empty_table(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
