import random
import zlib

import duckdb
import pytest

from loginlens.llm import chat, sharding


def rendered(frame):
    return sorted(tuple(r) for r in chat.format_chats(frame).collect())


def by_sql(frame):
    con = duckdb.connect()
    con.register("conversations", frame.toPandas())
    return sorted(con.execute(f"select conv_id, chunk, n_turns, rendered from ({chat.ORACLE})").fetchall())


SCHEMA = "conv_id long, turn long, role string, text string, pos string, block int"


def test_snapshots_collapse(spark):
    rows = []
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    for conv, upto in ((1, 1), (2, 2), (3, 3), (4, 3), (5, 2)):
        rows += [(conv, t, *turns[t], "p", 0) for t in range(upto)]
    rows += [(6, 0, "user", "hi", "p", 0), (6, 1, "assistant", "other", "p", 0), (7, 0, "assistant", "hi", "p", 0)]
    got = rendered(spark.createDataFrame(rows, SCHEMA))
    assert [r[0] for r in got] == [3, 6, 7]
    assert got[2][3] == "<|assistant|>\nhi\n<|end|>\n"


def test_random_logs_equal_sql(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "b", "", None, "long " * 500]), "p", 0))
    rows += [(None, 1, "user", "lost", "p", 0)] + [(500, t, "user", "t", "p", 0) for t in range(700)]
    rows += [(501, t, "user", "t", "p", 0) for t in range(650)] + [(502, 1, "user", "twice", "p", 0)] * 2
    frame = spark.createDataFrame(rows, SCHEMA)
    got = rendered(frame)
    assert got == by_sql(frame)
    assert 501 not in {r[0] for r in got} and [r[1] for r in got if r[0] == 500] == [0, 1, 2]


def test_no_conversations(spark):
    assert rendered(spark.createDataFrame([], SCHEMA)) == []


def check_shards(rows, docs, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d.doc_id is None, d.doc_id or 0) for d in docs)
    for number in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == number)
        assert slots == list(range(len(slots)))
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((size(d.text), zlib.crc32((d.text or "").encode())) for d in docs)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_level_and_groups_whole(documents, shards):
    rows = sharding.shard(documents, shards).collect()
    check_shards(rows, documents.collect(), shards)
    load = [sum(r.size for r in rows if r.shard == n) for n in range(shards)]
    largest = max(r.size for r in rows)
    assert max(load) - min(load) <= max(0.02 * max(load), largest if max(load) < 2 * largest else 0)
    where = {}
    for r in rows:
        where.setdefault(r.group_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_group_above_a_shard_is_cut(spark):
    docs = spark.createDataFrame([(i, "copy " * 20 if i % 3 else f"own {i}") for i in range(3_000)], "doc_id long, text string")
    rows = sharding.shard(docs, 8).collect()
    check_shards(rows, docs.collect(), 8)
    load = [sum(r.size for r in rows if r.shard == n) for n in range(8)]
    assert max(load) < 1.2 * min(load)


def test_odd_rows(odd, none):
    check_shards(sharding.shard(odd, 3).collect(), odd.collect(), 3)
    assert sharding.shard(none, 3).count() == 0
