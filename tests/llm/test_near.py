import collections
import random
import time

import numpy as np
import pytest

from loginlens.llm import line_join, order_minhash
from loginlens.llm.common import components, with_row_id


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(5_000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 10)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b, limit = "".join(b), rng.randint(0, 4)
        assert line_join.edit_distance(a, b, limit) == min(plain_distance(a, b), limit + 1)


def test_edit_distance_of_long_lines():
    """Work grows with length times limit: a megabyte takes seconds, whatever differs at its ends."""
    rng = random.Random(8)
    a = "".join(rng.choices("abcdefgh ", k=1_000_000))
    b = "x" + a[:300_000] + "y" + a[300_001:600_000] + a[600_001:] + "z"
    started = time.time()
    assert line_join.edit_distance(a, b, 4) == 4 and line_join.edit_distance(a, b, 3) == 4
    assert line_join.edit_distance(a, a[::-1], 20) == 21 and time.time() - started < 60


def test_dedup_of_a_document_of_many_repeats(spark):
    """A line that goes costs no look at the others that go."""
    rows = [(1, "\n".join(f"line number {i}" for i in range(60_000))), (2, "\n".join(["own", *[f"line number {i}" for i in range(60_000)]]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.time()
    left = {r.doc_id: r.text for r in line_join.dedup_lines(frame, edits=0).collect()}
    assert left == {1: rows[0][1], 2: "own"} and time.time() - started < 120


def judged(rows, edits, least):
    """What judged_lines should return, by comparing every pair of lines."""
    places = collections.defaultdict(list)
    for number, (i, text) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line) >= least:
                places[line].append((i is None, i or 0, number, at))
    lines = list(places)
    first = {x: min(p) for x, p in places.items()}
    n, lead = collections.Counter(), dict.fromkeys(lines, True)
    for x, a in enumerate(lines):
        for b in lines[x + 1:]:
            if abs(len(a) - len(b)) <= edits and plain_distance(a, b) <= edits:
                n[a] += 1
                n[b] += 1
                lead[max(a, b, key=first.get)] = False
    return sorted((p[1] if not p[0] else -1, p[3], n[x], lead[x] and p == min(places[x])) for x in lines for p in places[x])


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_equal_brute_force(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(4, 14))) for _ in range(25)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, edits + 1)):
                at = rng.randint(0, len(line))
                line[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            lines.append("".join(line))
        rows.append((i if i % 9 else i + 1_000, rng.choice(["\n".join(lines), "\n".join(lines), None])))
    frame = with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))
    got = line_join.judged_lines(frame, edits, 5).collect()
    assert sorted((r.doc_id, r.at, r.n_links, r.keep) for r in got) == judged(rows, edits, 5)


def test_dedup_of_odd_rows(odd, none):
    left = line_join.dedup_lines(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    texts = collections.Counter(r.text for r in rows)
    assert texts[None] == 2 and texts[""] == 2  # nulls and empty texts take no part
    assert texts["same text twice in a row, word for word it is"] == 1
    line = "a line that is said again and again in many texts"
    assert texts[f"{line}\nshort"] == 1 and texts["other"] == 1
    assert line_join.dedup_lines(none).count() == 0


def test_many_copies_and_variants_of_one_line(spark):
    line = "the same long line of text that is in every document"
    rows = [(i, line) for i in range(2_000)] + [(9_000 + i, line[:i] + "~" + line[i + 1:]) for i in range(50)]
    got = line_join.judged_lines(with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert [r.doc_id for r in got if r.keep] == [0]
    assert {r.n_links for r in got if r.doc_id < 9_000} == {50}
    assert {r.n_links for r in got if r.doc_id >= 9_000} == {50}  # its 49 siblings are two edits away


def grouped(rows, least):
    """Smallest id of each text's component, over all pairs of different texts."""
    texts = sorted({t for _, t in rows if t is not None})
    items = [order_minhash.items(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            if order_minhash.similarity(items[x], items[y], least) > 0:
                root[find(x)] = find(y)
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[find(texts.index(t)) if t is not None else ("alone", i)].append(i)
    return sorted((i, min(members)) for members in ids.values() for i in members)


def slow_similarity(a, b):
    """Longest common subsequence of the items, over all of the rest."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1] / (len(a) + len(b) - row[-1])


def variants(rng, n):
    rows = []
    for group in range(n):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(copy))
                copy[at:at + rng.randint(0, 2)] = rng.choice([[], ["new"]])
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_banded_similarity():
    rng = random.Random(8)
    texts = [t for _, t in variants(rng, 25)]
    items = [order_minhash.items(t) for t in texts]
    for a in items:
        for b in items:
            exact = slow_similarity(a.tolist(), b.tolist())
            assert order_minhash.similarity(a, b) == (exact if exact >= 0.8 - 1e-12 else 0)
    repeated = order_minhash.items("again " * 500)
    assert len(set(repeated.tolist())) == 496


def test_groups_equal_brute_force(spark):
    rows = variants(random.Random(4), 120)
    shared = " ".join(f"shared{i}" for i in range(60))  # a passage that many different texts hold
    rows += [(len(rows) + i, shared + " " + " ".join(f"own{i}x{j}" for j in range(80))) for i in range(60)]
    frame = with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))
    got = order_minhash.groups(frame).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == grouped(rows, 0.8)
    assert sum(r.keep for r in got) == len({r.class_id for r in got})


def test_one_huge_group_of_variants(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i % 190] + ["changed" + str(i)] + words[i % 190 + 1:])) for i in range(600)]
    rows += [(1_000 + i, " ".join(words)) for i in range(600)]
    got = order_minhash.groups(with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.class_id for r in got} == {0} and {r.copies for r in got} == {1_200}


def test_near_dedup_of_odd_rows(odd, none):
    left = order_minhash.deduplicate(odd)
    assert left.columns == odd.columns
    texts = collections.Counter(r.text for r in left.collect())
    assert texts[None] == 2 and texts[""] == 1 and texts["  \n\n "] == 1
    assert sum(texts.values()) == odd.count() - 2
    assert order_minhash.deduplicate(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 500]], "id long")
    got = {r.id: r.label for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 500: 500}


def test_sketches_keep_order():
    a = np.array([5, 9, 2, 7], dtype=np.uint64)
    assert (order_minhash.sketch(a) != order_minhash.sketch(a[::-1].copy())).all()


def test_limit_grows_with_the_line(spark):
    """Every pair within the growing limit is linked, by comparing all pairs, also across the borders of bands."""
    rng = random.Random(12)
    rows = []
    for n in (20, 31, 33, 62, 65, 127, 130, 200, 254, 258, 400, 515):
        base = [rng.choice("abcdefghé ") for _ in range(n)]
        for _ in range(7):
            line = list(base)
            for _ in range(rng.randint(0, n // line_join.SHARE + 2)):
                at = rng.randint(0, len(line))
                line[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
            rows.append((len(rows), "".join(line)))
    different = {x for _, x in rows if len(x) >= 20}
    frame = with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.n_links for r in line_join.judged_lines(frame).collect()}
    assert got == {i: sum(plain_near(x, y) for y in different if y != x) for i, x in rows if x in different}
    assert sum(got.values()) > 100


def plain_near(a, b):
    least = min(len(a), len(b))
    limit = max(min(2, least // 6), least // line_join.SHARE)
    return abs(len(a) - len(b)) <= limit and plain_distance(a, b) <= limit


def test_replaced_word_is_a_repeat(spark):
    words = [f"word{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:12] + ["another"] + words[13:]))]
    got = line_join.judged_lines(with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {(r.doc_id, r.n_links, r.keep) for r in got} == {(1, 1, True), (2, 1, False)}


def test_short_lines_take_part(spark):
    """Every line that is not empty has a row; short ones are linked within 2, 1 or 0 edits."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abc é") for _ in range(n)) for n in (1, 2, 3, 5, 6, 7, 9, 11, 12, 13, 16, 19) for _ in range(2)]
    rows = []
    for i in range(100):
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(line))
            line[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        rows.append((i, "".join(line)))
    different = {x for _, x in rows if x}
    first = {x: min(i for i, y in rows if y == x) for x in different}
    near = {x: [y for y in different if y != x and plain_near(x, y)] for x in different}
    frame = with_row_id(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_links, r.keep) for r in line_join.judged_lines(frame).collect())
    assert got == [(i, len(near[x]), first[x] == i and all(first[y] > i for y in near[x])) for i, x in rows if x]


def test_dedup_of_short_repeats(spark):
    rows = [(1, "yes\n\nno"), (2, "yes\n\nnew"), (3, "yes")]
    left = line_join.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in left) == [(1, "yes\n\nno"), (2, "\nnew")]
    left = line_join.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=20).collect()
    assert sorted(tuple(r) for r in left) == rows


def test_short_texts_that_agree_in_one_sketch(spark):
    """A text linked to two others that are apart, to the second of them by one sketch only."""
    agreed = lambda a, b: int((order_minhash.sketch(order_minhash.items(a)) == order_minhash.sketch(order_minhash.items(b))).sum())
    for i in range(2_000):
        words = [f"w{i}x{j}" for j in range(10)]
        before, after, core = " ".join(words[:9]), " ".join(words[1:]), " ".join(words[1:9])
        if agreed(core, after) == 1 and agreed(core, before) > 1:
            break
    else:
        raise AssertionError("no such texts")
    rows = spark.createDataFrame([(0, before), (1, after), (2, core)], "doc_id long, text string").coalesce(1)
    got = order_minhash.groups(with_row_id(rows)).collect()
    assert {r.class_id for r in got} == {0}


def test_rare_seeds_meet_after_any_edits():
    """Lines within the limit share a seed, and a common passage alone gives few."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    lines, pairs = [], []
    for n in [32, 33, 47, 48, 100, 255, 256, 300, 700] * 12:
        a = "the common passage of all " + " ".join(rng.choice(words) for _ in range(n))
        a = a[:n]
        limit, b = line_join.limit_of(n), list(a)
        for i in range(limit):  # evenly spread, which spares the shortest runs
            at = min(len(b) - 1, (2 * i + 1) * n // (2 * limit))
            kind = rng.randint(0, 2)
            b[at:at + (kind != 1)] = [rng.choice("xyz")] * (kind != 2)
        pairs.append((len(lines), len(lines) + 1))
        lines += [a, "".join(b)]
    counts = np.zeros(line_join.SLOTS, np.int64)
    np.add.at(counts, (line_join.hashes_of(lines, line_join.GRAM, 0) & np.uint64(line_join.SLOTS - 1)).astype(np.int64), 1)
    order = np.argsort(counts, kind="stable")
    levels = np.empty(line_join.SLOTS, np.uint8)
    levels[order] = np.searchsorted(line_join.LEVELS, np.cumsum(counts[order]) / counts.sum())
    line, key, _ = line_join.rare_seeds(lines, levels, None)
    given = [set(key[line == i].tolist()) for i in range(len(lines))]
    assert all(given[a] & given[b] for a, b in pairs)
    assert len(key) < 0.8 * sum(len(x) for x in lines)
    common = line_join.hashes_of([lines[-2][:26]], line_join.GRAM, 0)
    assert sum(len(g & set(common.tolist())) for g in given) < len(lines) * len(common) / 2


def test_lines_compared_either_way_are_the_same(spark, monkeypatch):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    for a in lines[:12]:
        for _ in range(4):
            b = list(a)
            for _ in range(rng.randint(1, 8)):
                b[rng.randrange(len(b))] = rng.choice("abxé")
            lines.append("".join(b))
    rows = line_join.lines_of(with_row_id(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")), 1)
    short = sorted(map(tuple, line_join.links(rows).collect()))
    monkeypatch.setattr(line_join, "LONG", 0)
    assert short == sorted(map(tuple, line_join.links(rows).collect())) and len(short) > 20
