import random
import re

import duckdb
import numpy as np
import pytest

from loginlens.llm import decontaminate, vptree
from loginlens.llm.common import with_row_id

from .conftest import SF


def brute(vectors, ids, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def found(index, queries, factor, k=20):
    got = {}
    for r in vptree.nearest(index, queries, k, factor).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.fixture(scope="module")
def embedded(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = frame.toPandas()
    return frame, np.array(rows["embedding"].tolist(), dtype=float), rows["vec_id"].to_numpy()


def test_factor_one_is_exact(embedded):
    frame, vectors, ids = embedded
    index = vptree.build_index(frame, shards=3)
    assert found(index, frame.where("vec_id % 20 = 0"), 1.0) == brute(vectors, ids, 20)


def test_recall_at_the_production_factor():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(6_000, 64)) * np.exp(rng.normal(size=(6_000, 1)))  # norms of a heavy tail
    lifted = np.column_stack([vectors, np.sqrt(np.maximum((vectors ** 2).sum(1).max() - (vectors ** 2).sum(1), 0))])
    ids, tree = np.arange(6_000), vptree.build(lifted)
    own = ids[ids % 20 == 0]
    queries = np.column_stack([vectors[own], np.zeros(len(own))])
    want = brute(vectors, ids, 20)
    for factor, least in ((1.0, 1.0), (0.9, 0.95)):
        _, names = vptree.search(tree, lifted, ids, queries, own, 20, factor)
        recall = np.mean([len(set(want[int(q)]) & set(n.tolist())) / 20 for q, n in zip(own, names)])
        assert recall >= least


def test_repeated_and_missing_ids(spark):
    """Rows of one id keep their own vectors; rows without an id come back without one."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (None, [0.0, 3.0]), (None, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shards in (1, 3):
        got = vptree.nearest(vptree.build_index(frame, shards=shards), frame.where("vec_id = 20"), 9, 1.0).collect()
        one = [(None, 3.0), (1, 1.0), (2, 0.5), (None, 0.5), (1, 0.0)]
        other = [(1, 1.0), (2, 0.5), (None, 0.5), (1, 0.0), (None, 0.0)]
        assert sorted(((r.rank, r.vec_id, r.score) for r in got), key=repr) == sorted(
            [(i, v, s) for found in (one, other) for i, (v, s) in enumerate(found, 1)], key=repr)


def test_recall_over_several_shards(embedded):
    frame, vectors, ids = embedded
    got = found(vptree.build_index(frame, shards=4), frame.where("vec_id % 20 = 0"), 0.9)
    want = brute(vectors, ids, 20)
    assert np.mean([len(set(want[q]) & set(got[q])) / len(want[q]) for q in want]) >= 0.95


def test_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 0.0]), (101, None), (102, [float("nan"), 1.0]),
            (103, [1.0, None]), (104, [float("inf"), 0.0]), (120, [0.0, 1.0]), (140, [1.0, 2.0, 3.0]), (160, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(vptree.build_index(frame), frame.where("vec_id % 20 = 0"), 1.0, k=3)
    assert got == {0: [1, 2, 3], 20: [0, 1, 2], 120: [0, 1, 2]}
    few = frame.where("vec_id < 2")
    assert found(vptree.build_index(few), few, 1.0) == {0: [1], 1: [0]}
    none = frame.limit(0)
    assert found(vptree.build_index(none), none, 1.0) == {}


def windows(doc, item, width=13, substitutions=2):
    """Number of shifts at which a stretch of `width` words differs in at most `substitutions`."""
    n = 0
    for shift in range(-len(item), len(doc) + 1):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        if len(item) < width:
            n += low == 0 and high == len(item) and doc[shift:shift + len(item)] == item
            continue
        same = [doc[p + shift] == item[p] for p in range(low, high)]
        n += any(sum(same[s:s + width]) >= width - substitutions for s in range(len(same) - width + 1))
    return n


def test_contamination_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, some(rng.choice([3, 5, 8, 12, 13, 14, 20, 40]))) for i in range(25)]
    docs = []
    for i in range(150):
        doc = some(rng.randint(0, 60))
        if i % 2:
            planted = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 5)):
                planted[rng.randrange(len(planted))] = rng.choice(words)
            at = rng.randint(0, len(doc))
            doc[at:at] = planted[rng.randint(0, 2):]
        docs.append((i, doc))
    want = sorted((i, j, n) for i, d in docs for j, t in items if len(t) >= 5 and (n := windows(d, t)))
    table = spark.createDataFrame([(i, "  ".join(d).capitalize() + "!") for i, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(j, ", ".join(t)) for j, t in items] + [(99, None), (98, "")], "item_id long, text string")
    for limit in (1_000_000, 0):  # broadcast and shuffled seeds
        got = decontaminate.contaminated(with_row_id(table), bench, broadcast_rows=limit)
        assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "alignments").collect()) == want
    assert want


def test_contamination_equals_sql(spark, documents):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = decontaminate.contaminated(with_row_id(documents), bench).select("doc_id", "item_id", "alignments")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(
        f"select doc_id, item_id, alignments from ({decontaminate.ORACLE})").fetchall())


def test_main_path_is_native(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = decontaminate.contaminated(with_row_id(documents), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_dropping_contaminated_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text twice in a row, word for word it is")], "item_id long, text string")
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.columns == odd.columns
    assert left.count() == odd.count() - 2
    assert decontaminate.drop_contaminated(none, bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
