import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlens.llm import packing, queries, rollups, token_files
from loginlens.llm.common import running_total
from loginlens.llm import encoding
from loginlens.llm.encoding import Encoder, TokenCounter
from loginlens.llm.queries import tokenizer
from loginlens.session import run_dir

KINDS = {"word_bpe_49k.json": "words", "byte_bpe_50k.json": "bytes"}


def plain(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


@pytest.mark.parametrize("name", KINDS)
def test_pieces_encode_like_whole_texts(name):
    rng = random.Random(5)
    parts = ["a", "B", "é", "é", "Σ", "ς", " ", "  ", "\n", "\n\n", "\t", " ", "\xa0", "　", "\x1c",
             "\x85", "1", "23", "!", ".", ",", "...", "'s", "'LL", "漢字", "İ", "​", "́", "<|endoftext|>",
             "<|ENDOFTEXT|>", "the", "𝒳", "|", "É", "x" * 90]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5_000)]
    whole, encode = plain(name), Encoder(tokenizer(name), KINDS[name], "<u2", remember=500)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at:at + 100], encode(texts[at:at + 100])):
            assert np.frombuffer(ids, "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def expected_files(rows):
    whole, at, out = plain("word_bpe_49k.json"), 0, []
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def files_of(spark, docs):
    manifest = token_files.write_token_files(docs, run_dir(spark, "test"), tokenizer("word_bpe_49k.json"), "words", 1, 49_408)
    return manifest.persist()


def test_token_files_round_trip(spark, documents):
    manifest = files_of(spark, documents)
    got = [tuple(r)[:4] for r in token_files.read_token_files(manifest).orderBy("start").collect()]
    rows = [tuple(r) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]
    assert got == expected_files(rows)
    part = manifest.orderBy("part").toPandas().iloc[0]
    ids = plain("word_bpe_49k.json").encode(rows[3][1], add_special_tokens=False).ids
    assert token_files.document_ids(part, 3).tolist() == [*ids, 1]


def test_token_files_odd_rows(spark, odd, none):
    got = token_files.read_token_files(files_of(spark, odd)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in odd.collect()], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    assert [r.n_tokens for r in got if r.doc_id == 1] == [1]
    assert token_files.read_token_files(files_of(spark, none)).count() == 0


def check_packed(pieces, texts):
    whole = plain("byte_bpe_50k.json")
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert sorted(zlib.crc32(x.tobytes()) for x in ids) == sorted(whole_crcs(pieces, ids))
    filled = pieces.sort_values(["sequence_id", "offset"])
    lengths = filled.groupby("sequence_id")["length"].sum()
    assert lengths.index.tolist() == list(range(len(lengths))) and (lengths.iloc[:-1] == 1024).all()
    assert (filled["offset"] == filled.groupby("sequence_id")["length"].cumsum() - filled["length"]).all()


def whole_crcs(pieces, ids):
    """Checksums of the documents put together again from their pieces' ids."""
    for _, rows in pieces.sort_values(["doc", "start"]).groupby("doc"):
        raw = [np.frombuffer(x, "<u2").astype("<u4") for x in rows["ids"]]
        assert [zlib.crc32(x.tobytes()) for x in raw] == rows["ids_crc32"].tolist()
        assert rows["start"].tolist() == np.cumsum([0, *rows["length"].tolist()[:-1]]).tolist()
        assert (rows["doc_tokens"] == rows["length"].sum()).all()
        yield zlib.crc32(np.concatenate(raw).tobytes())


def packed(docs, **options):
    encoded = packing.encode_documents(docs, tokenizer("byte_bpe_50k.json"), "bytes", 0, 50_257)
    rows = packing.pack(encoded, 2, with_ids=True, **options).toPandas()
    # Pieces of rows that share an id are told apart by walking through each id's starts.
    rows["doc"] = list(zip(rows["doc_id"].fillna(-1), rows["doc_tokens"]))
    return rows


def test_packing_whole_corpus(documents):
    rows = packed(documents)
    check_packed(rows, [r.text for r in documents.collect()])


def test_packing_keeps_the_mixture_in_every_round(spark):
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 50).alias("text"),
        F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "middle").otherwise("small").alias("source"))
    rows = packed(docs)
    at = rows["sequence_id"] // 64
    total = rows.groupby("source")["length"].sum() / rows["length"].sum()
    for number in sorted(at.unique())[:-1]:
        share = rows[at == number].groupby("source")["length"].sum() / rows[at == number]["length"].sum()
        assert (share - total).abs().max() < 0.15
    wanted = packed(docs, targets={"big": 0.2, "middle": 0.4, "small": 0.4}, round_sequences=8)
    first = wanted[wanted["sequence_id"] < 8].groupby("source")["length"].sum()
    assert abs(first["big"] / first.sum() - 0.2) < 0.05
    assert wanted["length"].sum() == rows["length"].sum()


def test_packing_odd_rows(odd, none):
    rows = packed(odd.where("doc_id is null or doc_id not in (2, 5)"))
    assert rows["doc_id"].isna().sum() >= 2
    assert len(packed(none)) == 0
    every = packed(odd)
    assert every["length"].sum() > rows["length"].sum()


def test_running_total_splits_groups(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"),
                                     (F.col("id") % 7).alias("v"))
    got = running_total(rows.repartition(7), "g", ["id"], "v", "at").toPandas().sort_values("id")
    seen = {}
    for row in got.itertuples():
        key = None if row.g != row.g else row.g
        assert row.at == seen.get(key, 0)
        seen[key] = seen.get(key, 0) + row.v


def test_rollup_commits_once_and_adds_up(spark):
    store = rollups.Rollup(spark, run_dir(spark, "rollup"))
    assert store.totals().count() == 0
    schema = "source string, lang string, tokenizer string, docs long, tokens long"
    first = spark.createDataFrame([("a", "en", "v1", 1, 10), ("a", "en", "v1", 1, 5), (None, None, "v1", 1, 2),
                                   ("a", "en", "v1", None, None)], schema)
    assert store.commit("1", first) and not store.commit("1", first)
    assert store.commit("2", spark.createDataFrame([("a", "en", "v1", -1, -5), ("a", "en", "v2", 1, 4)], schema))
    want = {("a", "en", "v1"): (1, 10), ("a", "en", "v2"): (1, 4), (None, None, "v1"): (1, 2)}
    read = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}
    assert read() == want
    store.compact()
    assert read() == want and not store.commit("2", first)
    assert store.commit("3", spark.createDataFrame([("a", "en", "v2", -1, -4)], schema))
    assert read()[("a", "en", "v2")] == (0, 0)
    assert store.commit("4", first.limit(0)) and "4" in store.committed()
    # A write that did not finish leaves no marker: readers pass over it, and a new try replaces it.
    first.coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.root}/batch=5")
    assert read()[("a", "en", "v1")] == (1, 10) and store.commit("5", first)
    assert read()[("a", "en", "v1")] == (3, 25)


def test_a_commit_during_compaction_counts_once(spark, monkeypatch):
    """A batch that commits between the listing and the sums of a compaction is in neither, or in both."""
    store = rollups.Rollup(spark, run_dir(spark, "rollup"))
    rows = lambda docs, tokens: spark.createDataFrame([("a", "en", "t", docs, tokens)], rollups.SUMS)
    store.commit("1", rows(1, 10))
    summed = rollups.Rollup._summed

    def slow(self, *parts):
        monkeypatch.setattr(rollups.Rollup, "_summed", summed)
        store.commit("2", rows(1, 5))
        return self._summed(*parts)

    monkeypatch.setattr(rollups.Rollup, "_summed", slow)
    store.compact()
    assert [tuple(r)[3:] for r in store.totals().collect()] == [(2, 15)]
    store.compact()
    rollups.Rollup(spark, store.root).compact()
    assert [tuple(r)[3:] for r in store.totals().collect()] == [(2, 15)] and store.committed() == {"1", "2"}
    assert not store.commit("2", rows(1, 5))


def test_count_tokens(odd):
    whole = plain("byte_bpe_50k.json")
    rows = rollups.count_tokens(odd, tokenizer("byte_bpe_50k.json"), "bytes").collect()
    assert all(r.tokens == len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in rows)


def test_yearly_rollup_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "only null ids", "en", "a"), (None, "only null ids", "en", "a"), (1, "mixed ids", "en", "a"),
            (None, "mixed ids", "en", "b"), (2, "one id twice", "de", "a"), (2, "one id twice", "de", "a"),
            (None, None, "en", "a"), (None, None, "en", "a"), (3, "alone", None, None), (None, "alone too", "en", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens)
           for r in queries.op5_token_rollup(spark, str(tmp_path)).collect()}
    kept = {}  # the copy of least id, null last; copies that tie are alike
    for i, text, lang, source in rows:
        kept.setdefault(text, []).append((i is None, i or 0, source, lang))
    word = plain("word_bpe_49k.json")
    want = {(source, lang, "byte_bpe_50k"): (0, 0) for _, _, lang, source in rows}
    for text, copies in kept.items():
        key = (*min(copies)[2:], "word_bpe_49k")
        docs, tokens = want.get(key, (0, 0))
        want[key] = docs + 1, tokens + len(word.encode(text or "", add_special_tokens=False).ids)
    assert got == want


@pytest.mark.parametrize("name, cut", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words"), ("word_bpe_49k.json", "whole")])
def test_counter_remembers_numbers_and_agrees_with_the_encoder(name, cut):
    texts = ["one two, three.\n\nFour  five " + "x" * 200, None, "", " \t ", "one two <|endoftext|> \u00e9t\u00e9 " * 3, "\u4e2d\u6587 42"]
    encode, count = Encoder(tokenizer(name), cut, "<u4"), TokenCounter(tokenizer(name), cut, remember=3)
    for _ in range(3):
        assert count(texts) == [len(x) // 4 for x in encode(texts)]
    assert all(isinstance(n, int) for n in [*count.known.values(), *count.older.values()])


@pytest.mark.parametrize("name, cut", KINDS.items())
def test_words_go_to_the_model_alone(name, cut, monkeypatch):
    draw = random.Random(5)
    letters = "abcdefgzABZ\xe9\xc9\xfc\xf1\xdf\u0153\u0141\u0142\u01c5\u0149"
    words = ["".join(draw.choices(letters, k=draw.randint(1, 70))) for _ in range(3000)]
    texts = [" ".join(words[i:i + 30]) for i in range(0, len(words), 30)] + ["<|x ABC \xc9T\xc9 abc", "abc ABC"]
    texts += ["".join(draw.choices([*letters, *" .,;:!?|&$#%*+=/()[]\"@~^-'_<>\n0\u0338\u0301"], k=400)) for _ in range(100)]
    encode, long_way = Encoder(tokenizer(name), cut, "<u4"), []
    joined = Encoder._joined
    monkeypatch.setattr(Encoder, "_joined", lambda self, pieces: long_way.extend(pieces) or joined(self, pieces))
    assert encode(texts) == Encoder(tokenizer(name), "whole", "<u4")(texts)
    assert TokenCounter(tokenizer(name), cut)(texts) == [len(x) // 4 for x in encode(texts)]
    long_way.clear()
    assert len(Encoder(tokenizer(name), cut)(["ordinary words of a text, twice"])[0]) >= 6 * 4 and not {"words", " words"} & {*long_way}


def test_a_tokenizer_that_changes_words_takes_the_long_way(tmp_path):
    import json

    kind = json.load(open(tokenizer("byte_bpe_50k.json")))
    kind["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "low.json").write_text(json.dumps(kind))
    encode = Encoder(str(tmp_path / "low.json"), "bytes")
    assert encode.model is None
    assert encode(["Two Words"]) == Encoder(str(tmp_path / "low.json"), "whole")(["Two Words"])


@pytest.mark.parametrize("name, cut", KINDS.items())
def test_a_known_piece_is_looked_up_once(name, cut):
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counted.asked += 1
            return super().__contains__(key)

    texts = ["one two, three four: \xe9t\xe9 \xfcber.\n", "five six"] * 3 + [None, ""]
    encode = Encoder(tokenizer(name), cut)
    first = encode(texts)
    encode.known = Counted(encode.known)
    pieces = sum(len(encoding.CUTS[cut].findall(t)) for t in texts if t)
    assert encode(texts) == first and Counted.asked == pieces
    words = ["one", " one", "\xe9t\xe9", " \xfcber", "œuvre", "Łłŉ", " \xe0\xe1", "\xed\xff"]
    assert encode._all_shown(words) == [encode._shown(w) for w in words] and encode._all_shown([]) == []
