"""Shards balanced in bytes, tokens and rows at once, by vector bin packing.

Documents of equal text form a group. A group is a vector (bytes, tokens, rows),
each relative to one shard's even share, the shard's capacity. Vectors are
placed from the largest down, each where its dot product with the residual
capacity is highest; bytes weigh most, because the law that is promised is
`bytes`: the shards' sizes are near equal.

Only vectors of a bounded number are placed one by one. A group of more than
1/LARGE of a shard in any dimension is a vector of its own (there are at most
3 x shards x LARGE); smaller groups are added up by hash into shards x CELLS
cells first. The placement thus sees a bounded table at any size of input, and
everything else is grouped aggregation and joins. A group above a whole shard
is cut into pieces by a hash of its rows, as no shard could hold it.

Cases: a null text has no bytes and no tokens; null texts are one group, apart
from empty ones. Repeated rows stay repeated. Null ids are placed like others.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.llm.common import fingerprint, running_total
from loginlens.session import durable

DIMENSIONS = ("size", "tokens", "rows")
WEIGHTS = (8.0, 1.0, 1.0)
LARGE = 64
CELLS = 256
OVERHEAD = 8


def place(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each vector (rows, in units of one shard's capacity)."""
    scale = np.sqrt(np.array(weights))
    scaled = vectors * scale
    residual = np.tile(scale, (shards, 1))
    chosen = np.empty(len(vectors), dtype=np.int64)
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        chosen[i] = int(np.argmax(residual @ scaled[i]))
        residual[chosen[i]] -= scaled[i]
    return level(vectors[:, 0], chosen, shards)


def level(sizes: np.ndarray, chosen: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Exchange vectors between the fullest and the emptiest shard while that narrows their gap in bytes."""
    load = np.bincount(chosen, weights=sizes, minlength=shards)
    for _ in range(rounds):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        ours, theirs = np.flatnonzero(chosen == high), np.append(np.flatnonzero(chosen == low), -1)
        give = np.append(sizes, 0.0)[theirs]
        order = np.argsort(give, kind="stable")
        # For each of ours, the one of theirs whose exchange moves nearest to half the gap.
        want = sizes[ours] - gap / 2
        at = np.clip(np.searchsorted(give[order], want), 1, max(1, len(order) - 1))
        near = [np.abs(want - give[order][np.clip(at - d, 0, len(order) - 1)]) for d in (0, 1)]
        best = np.minimum(*near)
        i = int(best.argmin()) if len(best) else -1
        if i < 0 or best[i] >= gap / 2 - 1e-12 * max(1.0, gap):
            break
        j = theirs[order[np.clip(at[i] - (0 if near[0][i] <= near[1][i] else 1), 0, len(order) - 1)]]
        moved = sizes[ours[i]] - (sizes[j] if j >= 0 else 0.0)
        chosen[ours[i]] = low
        if j >= 0:
            chosen[j] = high
        load[high] -= moved
        load[low] += moved
    return chosen


def shard(docs: DataFrame, shards: int, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per document: `doc_id, size, text_crc32, law, shard, slot, grown_shard`, then its group."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = durable(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        fingerprint(text).alias("group")).withColumn("size", F.col("bytes") + OVERHEAD))
    groups = durable(rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
                                               F.count("*").alias("rows")))
    whole = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    capacity = [max(whole[d] or 0, 1) / shards for d in DIMENSIONS]
    share = F.greatest(*[F.col(d) / F.lit(c) for d, c in zip(DIMENSIONS, capacity)])
    cell = F.pmod(F.col("group.a"), F.lit(shards * CELLS))
    placed = groups.select(
        "*", F.when(share * LARGE > 1, F.col("group")).alias("large"),
        F.when(share > 1, F.ceil(share * 2)).otherwise(F.lit(1)).cast("int").alias("pieces"))
    # The large groups' list is bounded by its definition, whatever the input.
    large = durable(placed.where("large is not null").select("group", "pieces"))
    split = large.where("pieces > 1")
    key = F.pmod(F.xxhash64("doc_id", "group.b"), F.col("pieces")).cast("int")
    pieces = rows.join(F.broadcast(split), "group").groupBy("group", key.alias("piece")).agg(
        *[F.sum(d).alias(d) for d in ("size", "tokens")], F.count("*").alias("rows"))
    vectors = (placed.where("pieces = 1").groupBy("large", F.when(F.col("large").isNull(), cell).alias("cell"))
               .agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).withColumn("piece", F.lit(0))
               .unionByName(pieces.withColumnRenamed("group", "large").withColumn("cell", F.lit(None).cast("long"))))
    figures = vectors.select("large", "cell", "piece", *DIMENSIONS).orderBy("cell", "large", "piece").collect()
    matrix = np.array([[r[d] / c for d, c in zip(DIMENSIONS, capacity)] for r in figures], dtype=float).reshape(-1, 3)
    where = spark.createDataFrame(
        [(r["large"], r["cell"], r["piece"], int(s)) for r, s in zip(figures, place(matrix, shards, weights))],
        "large struct<a: long, b: long>, cell long, piece int, shard int")
    marked = (rows.join(F.broadcast(large), "group", "left")
              .withColumn("piece", F.when(F.col("pieces") > 1, key).otherwise(F.lit(0)))
              .withColumn("cell", F.when(F.col("pieces").isNull(), cell)))
    small = where.where("large is null").select("cell", F.col("shard").alias("by_cell"))
    own = where.where("large is not null").select(F.col("large").alias("group"), "piece", F.col("shard").alias("by_group"))
    chosen = (marked.join(F.broadcast(small), "cell", "left").join(F.broadcast(own), ["group", "piece"], "left")
              .select("doc_id", "size", "tokens", "text_crc32", "group", F.coalesce("by_cell", "by_group").alias("shard"),
                      F.lit(1).cast("long").alias("one")))
    slots = running_total(chosen, "shard", ["doc_id", "text_crc32"], "one", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "tokens",
                        F.col("group.a").alias("group_id"))
