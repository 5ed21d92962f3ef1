import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from loginlens.llm import queries, runs

from .conftest import SF


def brute(words, least=24, exponent=3):
    """Every run by trying every period from every start."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i:j + q]
            if len(stretch) >= max(least, exponent * q) and not any(
                    stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def spoilt(rng, letters):
    words = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
    for _ in range(rng.randint(0, 3)):
        if words:
            start, period = rng.randrange(len(words)), rng.randint(1, 9)
            for i in range(start + period, min(len(words), start + rng.randint(5, 60))):
                words[i] = words[i - period]
    return words


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 2), (1, 2), (9, 4)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(150):
        texts = [spoilt(rng, rng.choice(["a", "ab", "abc", "abcdefghijklmnopqrstuvwxyz"])) for _ in range(5)]
        found, collapsed = runs.runs_in_texts([" ".join(t).encode() for t in texts], least, exponent)
        assert found == [brute(t, least, exponent) for t in texts]
        assert [c.decode() for c in collapsed] == [collapse(t, f) for t, f in zip(texts, found)]


def test_long_texts():
    one, many = b"a " * 100_000, " ".join(map(str, range(3_000))).encode() + b" "
    found, collapsed = runs.runs_in_texts([one, many * 20, b"x " * 23, b"x " * 24])
    assert found == [[(0, 100_000, 1)], [(0, 60_000, 3_000)], [], [(0, 24, 1)]]
    assert [len(c.split()) for c in collapsed] == [1, 3_000, 23, 1]


def test_positions_keep_order():
    rng = random.Random(3)
    members = rng.sample(range(50_000), 10_000)
    held = runs.Positions(members[0])
    for x in members[1:]:
        held.add(x)
    assert list(held) == sorted(members) and held.size == len(members)
    among = set(members)
    for x in rng.sample([x for x in range(50_000) if x not in among], 300):
        assert held.around(x) == (max((m for m in members if m < x), default=None), min((m for m in members if m > x), default=None))


def test_query_equals_brute_force(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words)
        best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2])) if found else (None,) * 3
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in found)
        want[r.doc_id] = (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                          hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, found).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 5


def test_odd_rows(spark, odd, none):
    named = odd.withColumnRenamed("key", "runs").withColumnRenamed("id", "collapsed")
    got = runs.with_runs(named).collect()
    assert len(got) == odd.count()
    assert all(r.runs == [] and r.collapsed == "" for r in got if r.doc_id == 2 or r.doc_id is None and r.n_chars is None)
    long = next(r for r in got if r.doc_id == 4)
    assert [tuple(x) for x in long.runs] == [(0, 100_000, 5)] and long.collapsed == "lorem ipsum dolor sit amet"
    assert runs.with_runs(none).count() == 0
    with pytest.raises(ValueError):
        runs.with_runs(odd, least_exponent=1)
