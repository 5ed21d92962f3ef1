"""Near-duplicate documents by Order MinHash.

A text becomes lower-case words and these five-word shingles. Equal shingles are
told apart by their occurrence number, so a text is a sequence of different
items. Each of SKETCHES hash functions picks the MINIMA items of least hash and
keeps them in the order of the text: two texts agree in a sketch if they share
these items in this order, which tracks their edit similarity. Candidates are
texts that agree in at least AGREE sketches, or in one where either has fewer
than FEW items. Minima are drawn without replacement, so short texts agree less:
at a similarity of 0.8 about 7 in 100,000 pairs of 100 items miss two sketches,
but 8 in 10,000 of 10 and 8 items, and 3.3 % of 5 and 4 items; 0.5 % of those
have no sketch in common and are no candidates.

Candidates are verified by banded alignment of the two item sequences: with m
items aligned in order, within the band that the threshold leaves, the
similarity is m / (n1 + n2 - m). Linked texts form a group; groups are connected
components.

Work does not grow with the square of a group. Equal texts are one class from
the start. Then each class is first compared with one class only, the smallest
of the bucket it shares most often, and components are formed. Only candidates
of different components are compared after that, and only where enough items occur
in other components; any other pair is in one group already or too far apart. So every candidate pair is either compared or connected, and no link
between groups is lost. Within a bucket the largest component is not enumerated
against itself.

Cases: a text of fewer than five words is one shingle. Empty and wordless texts
are equal to each other only if their texts are equal. A null text is in no
group but its own. Repeated rows are equal texts. Null document ids are allowed
and never represent a group that has an id. Ties go to the smaller id. An empty
table gives an empty result. Other columns pass through in `deduplicate`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.llm.common import carried, components, fingerprint, uncarried
from loginlens.session import discard, durable

WORD = re.compile(r"\w+")
SHINGLE = 5
SKETCHES = 24
MINIMA = 4
AGREE = 2
#: Items below which one shared sketch makes a candidate.
FEW = 32
SIMILARITY = 0.8
REMEMBER = 200_000
BATCH = 128
#: Members from which on a bucket of several components is tested for texts that cannot be linked.
CROWD = 16

_ODD = (np.random.default_rng(20).integers(0, 2**63, size=(2, SKETCHES), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_known: dict[str, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def items(text: str, width: int = SHINGLE) -> np.ndarray:
    """The occurrence-labelled shingles of a text, in order, as 64-bit numbers; all different."""
    words = WORD.findall(text.lower())
    if not words:
        return np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))], dtype=np.uint64)
    if len(_known) > REMEMBER:
        _known.clear()
    for w in filterfalse(_known.__contains__, set(words)):
        _known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    codes = np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(codes))
    n = len(codes) - span + 1
    rolled = np.full(n, span, dtype=np.uint64)
    for i in range(span):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + n]
    rolled = mixed(rolled)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if not first.all():
        at = np.arange(n)
        occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
        label = np.empty(n, dtype=np.uint64)
        label[order] = occurrence.astype(np.uint64)
        rolled = mixed(rolled + label * np.uint64(0xD1B54A32D192ED03))
    return rolled


def sketch(sequence: np.ndarray, minima: int = MINIMA) -> np.ndarray:
    """One 64-bit number per hash function: its items of least hash, in text order."""
    out = np.empty(SKETCHES, dtype=np.uint64)
    step = max(1, 2_000_000 // len(sequence))
    with np.errstate(over="ignore"):
        for low in range(0, SKETCHES, step):
            high = min(low + step, SKETCHES)
            values = sequence[None, :] * _ODD[0, low:high, None]
            values ^= values >> np.uint64(32)
            values *= _ODD[1, low:high, None]
            if len(sequence) > minima:
                picked = np.sort(np.argpartition(values, minima - 1, axis=1)[:, :minima], axis=1)
                chosen = sequence[picked]
            else:
                chosen = np.broadcast_to(sequence, (high - low, len(sequence)))
            key = np.arange(low, high, dtype=np.uint64)
            for column in chosen.T:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
            out[low:high] = key
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned share of two item sequences; 0 where it is below `least`.

    Items are unique, so the alignment is the longest rising run of matching
    positions. A pair that reaches `least` shifts positions by no more than the
    items it leaves unaligned, which bounds the band.
    """
    n = len(a) + len(b)
    needed = least * n / (1 + least)
    if min(len(a), len(b)) < needed - 1e-9:
        return 0.0
    order = np.argsort(a)
    at = np.searchsorted(a, b, sorter=order)
    at[at == len(a)] = 0
    where = order[at]
    match = np.flatnonzero(a[where] == b)
    where = where[match]
    inside = np.abs(where - match) <= n - 2 * needed + 1
    where = where[inside]
    if len(where) < needed - 1e-9:
        return 0.0
    if (np.diff(where) > 0).all():
        aligned = len(where)
    else:
        tails: list[int] = []
        for x in where.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        aligned = len(tails)
    found = aligned / (n - aligned)
    return found if found >= least - 1e-12 else 0.0


def sketches(rows: DataFrame) -> DataFrame:
    """`id, _row, doc_id, same, n, keys` per row with a text; written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                sequences = [items(t) for t in some.column(3).to_pylist()]
                keys = np.concatenate([sketch(s) for s in sequences]).view(np.int64)
                offsets = np.arange(len(sequences) + 1, dtype=np.int32) * SKETCHES
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(number, number + len(sequences)), pa.int64()), *some.columns[:3],
                     pa.array([len(s) for s in sequences], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                    ["id", "_row", "doc_id", "same", "n", "keys"])
                number += len(sequences)

    texts = rows.where("text is not null").select(
        "_row", F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("same"), "text")
    pair = "struct<{}: long, {}: long>"
    return durable(texts.mapInArrow(run, f"id long, _row {pair.format('file', 'at')}, doc_id long, "
                                         f"same {pair.format('a', 'b')}, n int, keys array<long>"))


def coded_texts(ids: DataFrame, sketched: DataFrame, rows: DataFrame) -> DataFrame:
    """`id, items` of the classes that share a bucket with another, each text read once."""
    needed = durable(ids.join(sketched.select("id", "_row"), "id"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                coded = [items(t).view(np.int64) for t in some.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))],
                    ["id", "items"])

    return durable(rows.select("_row", "text").join(needed, "_row").select("id", "text")
                   .mapInArrow(encode, "id long, items array<long>"))


def verify(pairs: DataFrame, coded: DataFrame, least: float) -> DataFrame:
    """The links among candidate pairs (a, b) of class ids: `a, b, similarity`."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                values, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
                sides.append([values[i:j] for i, j in zip(at - at[0], at[1:] - at[0])])
            found = np.array([similarity(x, y, least) for x, y in zip(*sides)], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)],
                                             ["a", "b", "similarity"])

    a = coded.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    b = coded.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "items_a", "items_b")
    return durable(both.mapInArrow(align, "a long, b long, similarity double").where("similarity > 0"))


def linkable(members: DataFrame, coded: DataFrame, least: float) -> DataFrame:
    """Of `id, label`, the ids that can have a link to another component at all.

    In a link at least the share `least` of either side's items is aligned, so
    that many must occur in some other component. This is exact and costs one
    pass over the items; texts that only share a passage fall out here, however
    many they are, before any two of them are paired.
    """
    spread = durable(members.join(coded, "id").select("id", "label", F.size("items").alias("n"),
                                                      F.explode("items").alias("item")))
    across = durable(spread.groupBy("item").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                     .where("low <> high").select("item"))
    return (spread.join(across, "item").groupBy("id", "n").agg(F.count("*").alias("shared"))
            .where(F.col("shared") >= F.col("n") * F.lit(least) - 1e-9).select("id"))


def groups(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Per row of `_row, doc_id, text`: `class_id` (its group's smallest document id), `keep` and `copies`.

    `keep` is true for the one row that stands for the group.
    """
    sketched = sketches(rows)
    classes = durable(sketched.groupBy("same").agg(F.min("id").alias("id")))
    apart = sketched.join(classes.select("id"), "id", "left_semi").select("id", "n", "keys")
    every = durable(apart.select("id", "n", F.explode("keys").alias("key")))
    shared = durable(every.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("centre"))
                     .where("size > 1").select("key", "centre"))
    buckets = durable(every.join(shared, "key"))
    discard(every)
    first = (buckets.where("id <> centre").groupBy("id", "centre").agg(F.count("*").alias("times"))
             .groupBy("id").agg(F.max(F.struct("times", -F.col("centre"))).alias("best"))
             .select(F.col("id").alias("a"), (-F.col("best.col2")).alias("b")))
    coded = coded_texts(buckets.select("id").distinct(), sketched, rows)
    links = verify(first, coded, least)
    nodes = classes.select("id")
    labels = durable(components(nodes, links))

    # Candidates of different components, from buckets that hold several.
    placed = buckets.select("key", "id", "n").join(labels, "id")
    sizes = durable(placed.groupBy("key", "label").agg(F.count("*").alias("members")))
    mixed_keys = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum("members").alias("total"),
                                          F.max(F.struct("members", "label")).alias("top"))
    mixed_keys = durable(mixed_keys.where("labels > 1").select("key", "total", F.col("top.label").alias("main")))
    held = durable(placed.join(mixed_keys, "key"))
    # In a crowded bucket every partner is in a crowded bucket too, so the test below sees them all.
    crowd = held.where(F.col("total") > CROWD)
    able = linkable(crowd.select("id", "label").distinct(), coded, least)
    held = durable(held.where(F.col("total") <= CROWD).unionByName(crowd.join(able, "id", "left_semi")))
    rest = held.where("label <> main").select("key", F.col("id").alias("a"), F.col("n").alias("na"),
                                              F.col("label").alias("la"))
    other = held.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), "main")
    # Both in the rest: once, by the order of their ids. Lengths that no alignment can bridge: not at all.
    cross = rest.join(other, "key").where(
        (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
        & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least)))
    second = (cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("na", "nb").alias("n"))
              .groupBy("a", "b").agg(F.count("*").alias("times"), F.min("n").alias("n"))
              .where((F.col("times") >= AGREE) | (F.col("n") < FEW)).select("a", "b"))
    more = verify(second, coded, least)
    merged = components(labels.select(F.col("label").alias("id")).distinct(),
                        more.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a")
                        .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
                        .select(F.col("la").alias("a"), F.col("lb").alias("b")))
    final = labels.join(merged.select(F.col("id").alias("label"), F.col("label").alias("group")), "label").select("id", "group")
    member = (sketched.select("id", "_row", "doc_id", "same")
              .join(classes.select("same", F.col("id").alias("class")), "same")
              .join(final.select(F.col("id").alias("class"), "group"), "class"))
    member = durable(member.select("_row", "doc_id", "id", "group"))
    # The smallest document id, nulls last, then the first row.
    lead = member.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("lead"), F.count("*").alias("copies"))
    joined = member.join(lead, "group").select(
        "_row", "doc_id", F.col("lead.doc_id").alias("class_id"), (F.col("lead.id") == F.col("id")).alias("keep"), "copies")
    alone = rows.where("text is null").select(
        "_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"),
        F.lit(True).alias("keep"), F.lit(1).cast("long").alias("copies"))
    return joined.unionByName(alone)


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns."""
    rows = carried(docs, "doc_id", "text")
    kept = durable(groups(rows.select("_row", "doc_id", "text"), least).where("keep").select("_row"))
    return uncarried(rows.join(kept, "_row", "left_semi"), docs)
