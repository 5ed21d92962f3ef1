import math
import random
import re
from collections import Counter

import numpy as np

from loginlens.llm import max_sketch

from .conftest import SF

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """(item, rank, doc, score) from the formulas alone; rows are (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (doc, c) in enumerate(counted):
            m = 25 + 75 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    index = max_sketch.build_index(docs)
    rows = max_sketch.search(index, items, k).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_equals_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()],
                 [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    assert want and found(spark, documents, items, 10) == want


def test_small_blocks_and_stretches(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 12")
    whole = found(spark, documents, items, 4)
    monkeypatch.setattr(max_sketch, "BLOCK_TERMS", 100)
    monkeypatch.setattr(max_sketch, "LOOKUPS", 500)
    assert found(spark, documents, items, 4) == whole


def test_bounds_are_never_below_scores():
    rng = random.Random(5)
    words = [f"w{i}".encode() for i in range(400)]
    for _ in range(30):
        docs = [Counter(rng.choices(words, k=rng.randint(1, 600))) for _ in range(10)]
        lengths = [rng.randint(25, 900) for _ in docs]
        flat = [np.array(x, np.int64) for x in zip(*[(max_sketch.crc32(t), n) for d in docs for t, n in d.items()])]
        sketches = max_sketch.fold_impacts([len(d) for d in docs], *flat, lengths)
        block = max_sketch.QueryBlock([{t: rng.randint(1, 20_000) for t in rng.sample(words, rng.randint(1, 50))} for _ in range(5)])
        for first, bounds in block.bounds(sketches):
            for d in range(len(bounds)):
                for q in range(5):
                    assert bounds[d, q] >= block.score(q, docs[first + d], lengths[first + d])


def test_slices_of_a_long_text(monkeypatch):
    text = ("Äpfel and pears, 3pm! " * 300).encode() + b"x" * 900
    whole = max_sketch.count_terms(text)
    monkeypatch.setattr(max_sketch, "SLICE", 64)
    assert max_sketch.count_terms(text) == whole == Counter(t.encode() for t in terms(text.decode()))


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "same text twice in a row"), (1, "short and other"), (2, None), (3, ""), (None, "lorem"), (4, "!!! --- ???"),
         (5, "nowhere-to-be-found"), (6, "SAID said Said ÄÖ")], "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in items.collect()], 3)
    assert found(spark, odd, items, 3) == want
    assert found(spark, none, items, 3) == [] and found(spark, odd, items.limit(0), 3) == []


def test_many_ties(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(500, 0, -1)] + [(1, "one two three"), (None, "one two three")]
                                 + [(1_000 + i, "four five six") for i in range(700)], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(9, "one")], "item_id long, text string")
    assert [r[2] for r in sorted(found(spark, docs, items, 5), key=lambda r: r[1])] == [1, 1, 2, 3, 4]
