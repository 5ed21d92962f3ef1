"""Ranked lexical search over hashed max-sketches.

A term's impact in a document grows with its occurrences and shrinks with the
document's length. Each document folds its terms' impacts into a sketch of
coordinates chosen by a hash: a coordinate holds the largest impact of the terms
that fall on it, rounded up to a byte. Summing the weights of a query's terms times
the coordinates they fall on can thus only overestimate the document's score, so
sketches give upper bounds, for a block of queries and a batch of documents at once.

Searching takes two passes over the sketches. The first takes each query's documents
of highest bound and scores them exactly: the k-th best score is a threshold that no
result lies below. The second goes through every batch of documents by descending
bound, scores exactly while bounds reach the threshold, and raises it as it finds
better ones. Tasks return their k best per query, which are merged by rank. Nothing
but these and the term counts is shuffled.

The index has two tables: documents with sketch, length factor and text, and term
frequencies. Sketches are SPREAD coordinates a distinct term wide, rounded up to a
power of two. Scores are whole numbers, so results are exact and do not depend on
partitioning. Queries are taken in blocks of about BLOCK_TERMS terms, of which the
driver holds one at a time.

Cases: terms are maximal runs of ASCII letters and digits and of all characters
beyond ASCII; only A to Z are lowered. Texts that are null or hold no term take no
part on either side, nor do documents of score 0. Equal scores are ordered by
`doc_id`, null last, then by row. Rows with one id are documents or queries of
their own. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loginlens.llm.common import small_batches, with_row_id
from loginlens.session import durable

SPREAD, NARROWEST = 4, 64
#: One step of a sketch byte; impacts lie below 1,000,000.
STEP = 4_000
BLOCK_TERMS = 65_536
#: Different terms a task counts before it passes them on.
PARTIAL = 300_000
#: Sketch coordinates looked up at once.
LOOKUPS = 2_000_000
SLICE = 8 << 20

#: Every byte that is no part of a term becomes a space; A to Z are lowered.
TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))

ROW = "_row struct<file:long,at:long>"


def count_terms(text: bytes) -> Counter[bytes]:
    """Occurrences of each term, the text split a slice at a time."""
    plain, counts, first = text.translate(TERM_BYTES), Counter(), 0
    while len(plain) - first > SLICE:
        last = plain.find(b" ", first + SLICE)
        if last < 0:
            break
        counts.update(plain[first:last].split())
        first = last
    counts.update(plain[first:].split() if first else plain.split())
    return counts


def impact(occurrences: int, m: int) -> int:
    return 1_000_000_000 * occurrences // (1000 * occurrences + 8 * m)


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


@dataclass
class Index:
    documents: DataFrame    # doc_id, _row, m, sketch, text
    frequencies: DataFrame  # term, docs
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame) -> Index:
    """Index of `doc_id, text`; each document's sketch depends on all through the mean length alone."""
    small_batches(docs.sparkSession)
    read = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   F.col("text").cast("binary").alias("text"), *_metadata(docs)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n_docs = n_terms = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = count_terms(text) if text else None
                if counts:
                    seen.update(counts.keys())
                    n_docs, n_terms = n_docs + 1, n_terms + counts.total()
                    if len(seen) > PARTIAL:
                        yield _tallied(seen)
                        seen = Counter()
        yield _tallied(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.binary()), "docs": [n_docs], "terms": [n_terms]})

    sums = read.select("text").mapInArrow(tally, "term binary, docs long, terms long").groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))
    sums = durable(sums)
    total = sums.where("term IS NULL").first()
    n_docs, n_terms = (total["docs"], total["terms"]) if total else (0, 0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lengths, sizes, hashes, occurrences = [], [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                counts = count_terms(text) if text else None
                if counts:
                    kept.append(at)
                    lengths.append(25 + 75 * counts.total() * n_docs // n_terms)
                    sizes.append(len(counts))
                    hashes.append(np.fromiter(map(crc32, counts), np.int64, len(counts)))
                    occurrences.append(np.fromiter(counts.values(), np.int64, len(counts)))
            if kept:
                sketches = fold_impacts(sizes, np.concatenate(hashes), np.concatenate(occurrences), lengths)
                doc_id, text, row = (c.take(pa.array(kept)) for c in batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, row, pa.array(lengths, pa.int64()), pa.array(sketches, pa.binary()), text],
                    ["doc_id", "_row", "m", "sketch", "text"])

    folded = read.select("doc_id", "text", "_row").mapInArrow(
        fold, f"doc_id long, {ROW}, m long, sketch binary, text binary")
    return Index(durable(folded), sums.where("term IS NOT NULL").select("term", "docs"), n_docs, n_terms)


def _metadata(docs: DataFrame) -> list[str]:
    try:
        docs.select("_metadata.row_index")
    except Exception:  # not a file scan
        return []
    return ["_metadata"]


def _tallied(seen: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.binary()), "docs": pa.array(list(seen.values()), pa.int64()),
                                       "terms": pa.array(np.zeros(len(seen), np.int64))})


def fold_impacts(sizes: list[int], hashes: np.ndarray, occurrences: np.ndarray, lengths: list[int]) -> list[bytes]:
    """The sketch of each document of a batch, from its terms' hashes and occurrences laid end to end."""
    widths = np.array([max(NARROWEST, 1 << (SPREAD * n - 1).bit_length()) for n in sizes], np.int64)
    starts = np.cumsum(widths) - widths
    impacts = 1_000_000_000 * occurrences // (1000 * occurrences + 8 * np.repeat(np.array(lengths, np.int64), sizes))
    flat = np.zeros(int(widths.sum()), np.uint8)
    at = np.repeat(starts, sizes) + (hashes & np.repeat(widths - 1, sizes))
    np.maximum.at(flat, at, ((impacts + STEP - 1) // STEP).astype(np.uint8))
    return [flat[i:i + n].tobytes() for i, n in zip(starts.tolist(), widths.tolist())]


class QueryBlock:
    """Queries by number: their terms' weights (times repeats) and, laid end to end, hashes for lookups."""

    def __init__(self, queries: list[dict[bytes, int]]) -> None:
        self.queries = queries
        self.hashes = np.array([crc32(t) for q in queries for t in q], np.int64)
        self.weights = np.array([w for q in queries for w in q.values()], np.int64)
        sizes = np.array([len(q) for q in queries])
        self.starts = np.cumsum(sizes) - sizes

    def bounds(self, sketches: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first document, upper bounds by document and query) for stretches of a batch."""
        together = max(1, LOOKUPS // len(self.hashes))
        for first in range(0, len(sketches), together):
            some = sketches[first:first + together]
            widths = np.array([len(s) for s in some], np.int64)
            flat = np.frombuffer(b"".join(some), np.uint8)
            at = (np.cumsum(widths) - widths)[:, None] + (self.hashes[None, :] & (widths - 1)[:, None])
            yield first, np.add.reduceat(flat[at] * self.weights[None, :], self.starts, axis=1) * STEP

    def score(self, query: int, counts: Counter[bytes], m: int) -> int:
        return sum(w * impact(counts[t], m) for t, w in self.queries[query].items() if t in counts)


def search(index: Index, queries: DataFrame, k: int, key: str = "item_id") -> DataFrame:
    """For each of `queries` (`key, text`) its k highest-scoring documents: `key, rank, doc_id, score`."""
    terms = durable(_query_terms(queries, key).join(index.frequencies, "term", "left")
                    .withColumn("docs", F.coalesce("docs", F.lit(0).cast("long"))))
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found = None
    for number in range(blocks):
        held: dict[tuple[int, int], tuple[object, dict[bytes, int]]] = {}
        mine = terms.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == number)
        for r in mine.toLocalIterator():
            value = weight(index.n_docs, r["docs"]) * r["times"]
            if value > 0:
                held.setdefault(tuple(r["_row"]), (r[key], {}))[1][bytes(r["term"])] = value
        names = [name for name, _ in held.values()]
        part = _search_block(index, QueryBlock([q for _, q in held.values()]), k) if held else None
        if part is not None:
            kind = queries.schema[key].dataType
            called = index.documents.sparkSession.createDataFrame(list(enumerate(names)), f"query int, `{key}` {kind.simpleString()}")
            part = durable(part.join(F.broadcast(called), "query").select(key, "rank", "doc_id", "score"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        kind = queries.schema[key].dataType.simpleString()
        return index.documents.sparkSession.createDataFrame([], f"`{key}` {kind}, rank int, doc_id long, score long")
    return found


def _query_terms(queries: DataFrame, key: str) -> DataFrame:
    read = with_row_id(queries.select(F.col(f"`{key}`").alias(key), F.col("text").cast("binary").alias("text"), *_metadata(queries)))
    kind = queries.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(1).to_pylist()):
                counts = count_terms(text) if text else None
                if counts:
                    same = pa.array([at] * len(counts))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(2).take(same), pa.array(list(counts), pa.binary()),
                         pa.array(list(counts.values()), pa.int64())], [key, "_row", "term", "times"])

    return read.select(F.col(f"`{key}`"), "text", "_row").mapInArrow(split, f"`{key}` {kind}, {ROW}, term binary, times long")


def _search_block(index: Index, block: QueryBlock, k: int) -> DataFrame:
    spark = index.documents.sparkSession
    shared = spark.sparkContext.broadcast(block)
    n = len(block.queries)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.zeros((0, n), np.int64), np.zeros((0, n, 2), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(0).field(f).to_numpy(zero_copy_only=False) for f in (0, 1)], axis=1)
            for first, bounds in shared.value.bounds(batch.column(1).to_pylist()):
                own = np.broadcast_to(rows[first:first + len(bounds), None, :], (*bounds.shape, 2))
                best, at = np.concatenate([best, bounds]), np.concatenate([at, own])
                if len(best) > k:
                    top = np.argpartition(-best, k - 1, axis=0)[:k]
                    best, at = np.take_along_axis(best, top, 0), np.take_along_axis(at, top[:, :, None], 0)
        kept = np.flatnonzero(best.ravel() > 0)
        if len(kept):
            where = at.reshape(-1, 2)[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array((kept % n).astype(np.int32)), pa.array(best.ravel()[kept]),
                 pa.StructArray.from_arrays([pa.array(where[:, 0]), pa.array(where[:, 1])], ["file", "at"])],
                ["query", "bound", "_row"])

    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "_row"))
    seeds = index.documents.select("_row", "sketch").mapInArrow(highest, f"query int, bound long, {ROW}")
    seeds = durable(seeds.withColumn("rank", order).where(F.col("rank") <= k).select("query", F.col("_row").alias("seed")))

    def score_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, m = batch.column(0), batch.column(1).to_pylist()
            scores = [shared.value.score(q, count_terms(t), m[i]) for i, (q, t) in
                      enumerate(zip(query.to_pylist(), batch.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([query, pa.array(scores, pa.int64())], ["query", "score"])

    # At most k documents a query: the seeds of one block may be broadcast.
    texts = index.documents.join(F.broadcast(seeds), F.col("_row") == F.col("seed")).select("query", "m", "text")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    reached = texts.mapInArrow(score_seeds, "query int, score long").withColumn("nth", nth).where(F.col("nth") == k)
    threshold = np.ones(n, np.int64)  # a result scores above 0
    for r in reached.collect():  # one number a query of the block
        threshold[r["query"]] = max(1, r["score"])

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = threshold.copy()
        best: list[list[tuple]] = [[] for _ in range(n)]
        for batch in batches:
            ids, m = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, bounds in shared.value.bounds(batch.column(3).to_pylist()):
                docs, asked = np.nonzero(bounds >= least)
                if not len(docs):
                    continue
                reach = bounds[docs, asked]
                counted: dict[int, Counter[bytes]] = {}
                for at in np.argsort(-reach, kind="stable").tolist():
                    d, q = first + int(docs[at]), int(asked[at])
                    if reach[at] < least[q]:
                        continue
                    if d not in counted:
                        counted[d] = count_terms(batch.column(4)[d].as_py())
                    score = shared.value.score(q, counted[d], m[d])
                    if score >= least[q]:
                        row = batch.column(1)[d].as_py()
                        insort(best[q], (-score, ids[d] is None, ids[d] or 0, row["file"], row["at"]))
                        if len(best[q]) >= k:
                            del best[q][k:]
                            least[q] = max(least[q], -best[q][-1][0])
        flat = [(q, *b) for q, some in enumerate(best) for b in some]
        if flat:
            query, score, none, doc, file, at = zip(*flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array([-s for s in score], pa.int64()),
                 pa.array([None if x else i for x, i in zip(none, doc)], pa.int64()),
                 pa.StructArray.from_arrays([pa.array(file, pa.int64()), pa.array(at, pa.int64())], ["file", "at"])],
                ["query", "score", "doc_id", "_row"])

    found = index.documents.select("doc_id", "_row", "m", "sketch", "text").mapInArrow(
        rescore, f"query int, score long, doc_id long, {ROW}")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


ORACLE = r"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS r,
           list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                          lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
    FROM documents),
docs AS (SELECT doc_id, r, terms, len(terms) AS n FROM split WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
    SELECT item_id, q, term, count(*) AS times
    FROM (SELECT item_id, row_number() OVER () AS q,
                 unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
          FROM benchmark)
    GROUP BY item_id, q, term),
weighed AS (
    SELECT item_id, q, term, times * floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM asked JOIN df USING (term), corpus),
scored AS (
    SELECT item_id, q, doc_id, r,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
    FROM weighed JOIN tf USING (term) JOIN docs USING (r), corpus
    GROUP BY item_id, q, doc_id, r),
ranked AS (
    SELECT item_id, doc_id, score,
           row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
