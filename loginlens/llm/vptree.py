"""Nearest neighbours by inner product with one vantage-point tree per shard.

Vectors are dealt into shards by a hash of their id, one tree is built per shard
and stored as a row of an index table. Inner products become distances by one
more component: with M the largest norm, (x, sqrt(M^2 - |x|^2)) and (q, 0) have
squared distance M^2 + |q|^2 - 2 x.q, so the nearest vector is the one of
largest product, and the triangle inequality holds.

A node splits its vectors at the median distance `mu` from a vantage point. A
query at distance d can find nothing nearer than its k-th best distance r in the
inner half if d - mu >= r, nor in the outer half if mu - d > r. With a pruning
factor f the halves are left out at |d - mu| > f r: f = 1 is the exact search,
smaller factors look at fewer leaves. Queries descend in batches, and leaves are
compared by matrix products, in double precision.

Queries are blocks of bounded size; a block meets each tree once, and the
shards' nearest are merged by rank. No step holds all queries or all vectors.

Cases: vectors that are null, zero, or hold nulls or values that are not finite
take no part; of another length than the most frequent one neither. Repeated
ids are searched as rows, each with its own vector; repeated queries are answered
each for itself; a query row does not meet candidates of its own id. Vectors without
an id are candidates, come back with a null id, and are last among ties.
Fewer than k candidates: all are returned. Empty tables give empty results.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loginlens.session import durable

SHARD_ROWS = 8_192
LEAF = 256
BLOCK = 4_096
FOUND = "query_id long, query_row long, vec_id long, score double"


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & good & F.exists(embedding, lambda x: x != 0), F.lit(False))


def build(vectors: np.ndarray, leaf: int = LEAF, seed: int = 7) -> dict:
    """A vantage-point tree over rows of `vectors`: arrays of nodes and the order of rows in its leaves."""
    rng = np.random.default_rng(seed)
    order = np.arange(len(vectors))
    nodes: list[tuple[int, float, int, int, int, int]] = []  # vantage row, mu, inner, outer, low, high

    def grow(low: int, high: int) -> int:
        here = len(nodes)
        nodes.append((-1, 0.0, -1, -1, low, high))
        if high - low <= leaf:
            return here
        rows = order[low:high]
        vantage = int(rows[rng.integers(len(rows))])
        away = np.sqrt(((vectors[rows] - vectors[vantage]) ** 2).sum(axis=1))
        middle = len(rows) // 2
        by = np.argpartition(away, middle)
        order[low:high] = rows[by]
        mu = float(away[by[middle]])
        if away.max() == away.min():  # copies of one vector: nothing to split by
            return here
        inner = grow(low, low + middle)
        outer = grow(low + middle, high)
        nodes[here] = (vantage, mu, inner, outer, low, high)
        return here

    if len(vectors):
        grow(0, len(vectors))
    return {"nodes": nodes, "order": order}


def search(tree: dict, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int,
           factor: float, without_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest (squared distance, row) of each query, rows of its own id left out; missing ones are infinite.

    Rows are in order of their ids, so the smaller row of a tie has the smaller id; the last `without_id` have none.
    """
    named = len(ids) - without_id
    best = np.full((len(queries), k), np.inf)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    squares = (queries ** 2).sum(axis=1)

    def visit(node: int, active: np.ndarray) -> None:
        vantage, mu, inner, outer, low, high = tree["nodes"][node]
        if inner < 0:
            for first in range(low, high, 4096):
                rows = tree["order"][first:min(first + 4096, high)]
                some = vectors[rows]
                away = squares[active, None] - 2 * queries[active] @ some.T + (some ** 2).sum(axis=1)
                away = np.maximum(away, 0)
                away[(own[active, None] == ids[rows]) & (rows < named)] = np.inf
                all_away = np.concatenate([best[active], away], axis=1)
                all_names = np.concatenate([names[active], np.broadcast_to(rows, away.shape)], axis=1)
                by = np.argpartition(all_away, k - 1, axis=1)[:, :k]
                near, called = np.take_along_axis(all_away, by, 1), np.take_along_axis(all_names, by, 1)
                # Ties with the k-th go to the earlier row.
                least = near.max(axis=1)
                for i in np.flatnonzero((all_away <= least[:, None]).sum(axis=1) > k):
                    tied = np.flatnonzero(all_away[i] <= least[i])
                    tied = tied[np.lexsort((all_names[i, tied], all_away[i, tied]))][:k]
                    near[i], called[i] = all_away[i, tied], all_names[i, tied]
                best[active], names[active] = near, called
            return
        d = np.sqrt(((queries[active] - vectors[vantage]) ** 2).sum(axis=1))
        near_inner = d < mu
        for first, second, side in ((inner, outer, near_inner), (outer, inner, ~near_inner)):
            if side.any():
                visit(first, active[side])
                gap = np.abs(d[side] - mu)
                reach = np.sqrt(best[active[side]].max(axis=1))
                still = gap <= factor * reach
                if still.any():
                    visit(second, active[side][still])

    if len(ids) and len(queries):
        visit(0, np.arange(len(queries)))
    return best, names


def build_index(vectors: DataFrame, shards: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Index table: one row per shard with its tree, ids and vectors (`vec_id, embedding` in)."""
    good = vectors.where(usable(F.col("embedding"))).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(0).cast("long")).alias("vec_id"), F.col("vec_id").isNull().alias("none"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.withColumn("width", F.size("embedding"))
    figures = good.groupBy("width").agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).orderBy(
        F.desc("n"), "width").first()
    rows, width, square = (figures["n"], figures["width"], figures["square"]) if figures else (0, 0, 0.0)
    shards = shards or max(1, -(-rows // shard_rows))
    longest = float(np.sqrt(square))

    def plant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["none", "vec_id"], kind="stable")
        plain = np.array(rows["embedding"].tolist(), dtype=np.float64)
        rest = np.sqrt(np.maximum(longest ** 2 - (plain ** 2).sum(axis=1), 0))
        lifted = np.column_stack([plain, rest])
        tree = build(lifted)
        held = {"tree": tree, "ids": rows["vec_id"].to_numpy(np.int64), "vectors": lifted,
                "without_id": int(rows["none"].sum())}
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(held)]})

    dealt = good.where(F.col("width") == width).withColumn(
        "shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    return durable(dealt.groupBy("shard").applyInPandas(plant, "shard int, index binary"))


def nearest(index: DataFrame, queries: DataFrame, k: int, factor: float, block: int = BLOCK) -> DataFrame:
    """For each of `queries` (vec_id, embedding) its k nearest in the index: `query_id, rank, vec_id, score`."""
    good = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = durable(good.withColumn("query_row", F.monotonically_increasing_id()))  # fixed by being written
    blocks = max(1, -(-good.count() // block))
    shards = [r["shard"] for r in index.select("shard").toLocalIterator()]
    left = (good.withColumn("block", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(blocks)))
            .withColumn("shard", F.explode(F.lit(shards).cast("array<int>"))))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if held.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "query_row": "int64", "vec_id": "int64", "score": "float64"})
        tree = pickle.loads(held["index"].iloc[0])
        rows = rows[rows["embedding"].map(len) + 1 == tree["vectors"].shape[1]]
        own = rows["query_id"].to_numpy(np.int64)
        plain = np.array(rows["embedding"].tolist(), dtype=np.float64).reshape(len(own), -1)
        lifted = np.column_stack([plain, np.zeros(len(own))])
        away, places = search(tree["tree"], tree["vectors"], tree["ids"], lifted, own, k, factor, tree["without_id"])
        real = np.isfinite(away.ravel())
        at, owner = places.ravel()[real], np.repeat(np.arange(len(own)), k)[real]
        called = pd.Series(tree["ids"][at], dtype="Int64")
        called[at >= len(tree["ids"]) - tree["without_id"]] = pd.NA
        score = (plain[owner] * tree["vectors"][at, :-1]).sum(axis=1)
        return pd.DataFrame({"query_id": own[owner], "query_row": rows["query_row"].to_numpy(np.int64)[owner],
                             "vec_id": called, "score": score})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(look, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
