"""Mixture-controlled packing of documents into training sequences.

Each source is a queue of its documents' tokens. Deficit round-robin serves the
queues in rounds (windows): in every round a source's deficit grows by its
quantum, whole tokens are sent, and the fraction is carried to the next round.
What a source has sent after w rounds is therefore floor(w x quantum), whatever
partition holds its documents, so every round's share of every queue is known
from the source totals alone, and all rounds are filled at once by ordinary
joins. Sequences are cut from the rounds' output end to end; only the last one
is padded.

A source's quantum is its target share of a round. Without given targets it is
its share of all tokens, and every queue lasts to the last round. With given
targets a source that runs dry drops out, and the later rounds keep the others'
proportions. A round has as many sequences as there are sources, at least 64,
so a mean quantum is no less than one sequence.

Cases: a null text is an empty document (its end id alone). Rows of one
document id are kept apart. A null source is a queue of its own. An empty table
gives no pieces. Columns other than `doc_id, text, source` pass by unread. A
target that is null, missing or not above zero falls to the smallest one given.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loginlens.llm.common import div, running_total
from loginlens.llm.encoding import encoder, id_type
from loginlens.session import durable

ENCODED = "row long, doc_id long, source string, n long, ids binary"
SEQUENCE = 1024
ROUND_SEQUENCES = 64
BATCH = 512


def encode_documents(docs: DataFrame, tokenizer: str, cut: str, end_id: int, vocabulary_size: int) -> DataFrame:
    """Table of encoded documents: a row number, `doc_id`, `source`, `n` ids with the end id, the ids."""
    kind = id_type(max(vocabulary_size, end_id + 1))
    end = np.array([end_id], dtype=kind).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, width = TaskContext.get().partitionId() << 36, np.dtype(kind).itemsize
        run = encoder(tokenizer, cut, kind)
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                ids = [x + end for x in run(some.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(ids)), pa.int64()), some.column(0), some.column(1),
                     pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "source", "n", "ids"])
                row += len(ids)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        "text")
    return durable(texts.mapInArrow(encode, ENCODED))


def plan_pieces(sizes: DataFrame, targets: Mapping[str, float] | None = None, sequence: int = SEQUENCE,
                round_sequences: int = ROUND_SEQUENCES) -> DataFrame:
    """Pieces `row, start, length, sequence_id, offset` of documents `row, doc_id, source, n` (n > 0)."""
    queued = running_total(sizes.select("source", "doc_id", "row", "n"), "source", ["doc_id", "row"], "n", "at")
    queued = queued.withColumn("source_key", F.xxhash64("source", F.col("source").isNull()))
    sources = queued.groupBy("source_key").agg(F.sum("n").alias("total"), F.first("source").alias("name"))
    if targets:
        least = float(min(t for t in targets.values() if t and t > 0))
        known = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
        given = F.try_element_at(known, F.col("name"))
        sources = sources.withColumn("share", F.when(given > 0, given).otherwise(F.lit(least)))
    else:
        sources = sources.withColumn("share", F.col("total").cast("double"))
    sources = durable(sources)
    figures = sources.agg(F.sum("total").alias("n"), F.count("*").alias("k"), F.sum("share").alias("shares"),
                          F.max(F.col("total") / F.col("share")).alias("longest")).first()
    size = sequence * max(round_sequences, figures["k"] or 0)
    if targets:
        rounds = int(np.ceil((figures["longest"] or 0) * (figures["shares"] or 0) / size)) + 1
        quantum = F.col("share") / F.lit(figures["shares"]) * F.lit(size)
        sent = lambda w: F.least(F.col("total"), F.floor(quantum * w).cast("long"))
        sources = sources.withColumn("rounds", F.least(F.lit(rounds), F.ceil(F.col("total") / quantum) + 1))
    else:
        rounds = max(1, -(-(figures["n"] or 0) // size))
        # floor(total x w / rounds) in whole numbers: total = q x rounds + r.
        whole, rest = div(F.col("total"), rounds), F.col("total") % F.lit(rounds)
        sent = lambda w: (whole * w + div(rest * w, rounds)).cast("long")
        sources = sources.withColumn("rounds", F.lit(rounds))
    each = (sources.select("*", F.explode(F.sequence(F.lit(0), F.col("rounds").cast("long") - 1)).alias("round"))
            .withColumn("from", sent(F.col("round"))).withColumn("upto", sent(F.col("round") + 1))
            .where("upto > from").select("source_key", "round", "from", "upto"))
    each = durable(each)
    per_round = each.groupBy("round").agg(F.sum(F.col("upto") - F.col("from")).alias("filled"))
    per_round = per_round.withColumn("one", F.lit(0))
    bases = running_total(per_round, "one", ["round"], "filled", "base").select("round", "base")
    inside = Window.partitionBy("round").orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    shares = (each.join(bases, "round")
              .withColumn("base", F.col("base") + F.coalesce(F.sum(F.col("upto") - F.col("from")).over(inside), F.lit(0))))
    # A document meets the rounds that its stretch of the queue crosses. Both
    # sides are keyed by (source, block of the queue), so no join is on a source
    # alone; a block is the mean quantum, which a round's share spans evenly.
    block = max(sequence, size // max(1, figures["k"] or 1))
    blocks = lambda low, high: F.explode(F.sequence(div(low, block), div(high - 1, block)))
    left = queued.select("row", "n", "at", "source_key", blocks(F.col("at"), F.col("at") + F.col("n")).alias("block"))
    right = shares.select("source_key", "from", "upto", "base", blocks(F.col("from"), F.col("upto")).alias("block"))
    met = (left.join(right, ["source_key", "block"])
           .withColumn("low", F.greatest("at", "from")).withColumn("high", F.least(F.col("at") + F.col("n"), "upto"))
           .where("low < high")
           # Seen in several common blocks: keep the one that holds the first token.
           .where(div(F.col("low"), block) == F.col("block"))
           .select("row", (F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("low")).alias("length"),
                   (F.col("base") + F.col("low") - F.col("from")).alias("place")))
    wide = F.lit(sequence)
    cut = met.select("*", F.explode(F.sequence(
        div(F.col("place"), sequence), div(F.col("place") + F.col("length") - 1, sequence))).alias("sequence_id"))
    low = F.greatest(F.col("place"), F.col("sequence_id") * wide)
    high = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * wide)
    return cut.select("row", (F.col("start") + low - F.col("place")).alias("start"), (high - low).alias("length"),
                      "sequence_id", (low - F.col("sequence_id") * wide).alias("offset"))


PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "source string")


def pack(encoded: DataFrame, width: int, with_ids: bool = False, **options: object) -> DataFrame:
    """One row per piece of the documents of `encode_documents`, with its checksum and, on wish, its ids.

    `ids` are little-endian unsigned integers of `width` bytes; the checksum is
    the unsigned CRC-32 of the ids as 32-bit integers.
    """
    pieces = plan_pieces(encoded.select("row", "doc_id", "source", "n"), **options)
    # A document's pieces are at most its tokens, so this list is bounded by one document.
    lists = pieces.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = encoded.join(lists, "row").select("doc_id", "source", "n", "ids", "pieces")

    schema = PACKED + (", ids binary" if with_ids else "")
    names = [column.split()[0] for column in schema.split(", ")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                lists = some.column(4)
                flat = lists.flatten()
                counts = np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(some.num_rows), counts)
                start, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
                raw = [np.frombuffer(x, dtype=f"<u{width}") for x in some.column(3).to_pylist()]
                cuts = [raw[o][s:s + n] for o, s, n in zip(owner.tolist(), start.tolist(), length.tolist())]
                take = pa.array(owner)
                columns = [some.column(0).take(take), flat.field("start"), flat.field("length"),
                           pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cuts], pa.int64()),
                           some.column(2).take(take), flat.field("sequence_id"), flat.field("offset"),
                           some.column(1).take(take)]
                if with_ids:
                    columns.append(pa.array([c.tobytes() for c in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(fill, schema)
