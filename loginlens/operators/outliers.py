"""Per-user multivariate outlier models: Mahalanobis distance and isolation forest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlens.functions import clock, stats
from loginlens.operators.grouped import map_groups
from loginlens.operators.segments import SKEW, Ordered, SkewPolicy, join_per_user, latest
from loginlens.schema import (ADVANCED_MIN_ROWS, EVENT, HISTORY_LIMIT, INSUFFICIENT,
                              MAHALANOBIS_MIN_ROWS, NEUTRAL, TIME, USER)
from loginlens.session import durable

RIDGE = 1e-6
PIVOT_FLOOR = 1e-9
TREES = 100
SUBSAMPLE = 256
CONTAMINATION = 0.1
CHUNK_ROWS = 20_000


def recent_history(history: DataFrame, skew: SkewPolicy = SKEW, history_limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """The newest events of each user that the outlier models learn from; all of them without a limit."""
    return history if history_limit is None else latest(history, history_limit, skew)


# --- Mahalanobis -------------------------------------------------------------

def moments() -> dict[str, Column]:
    """A login's whole microdegrees and hour with their products, whose sums make the covariance model."""
    micro = {
        "x": F.round(F.col("latitude") * 1e6).cast("decimal(19,0)"),
        "y": F.round(F.col("longitude") * 1e6).cast("decimal(19,0)"),
        "h": clock.login_hour().cast("decimal(19,0)"),
    }
    products = {f"s{a}{b}": (micro[a] * micro[b]).cast("decimal(38,0)") for a, b in ("xx", "xy", "xh", "yy", "yh", "hh")}
    return {**{f"s{a}": c for a, c in micro.items()}, **products}


MOMENTS = ("sx", "sy", "sh", "sxx", "sxy", "sxh", "syy", "syh", "shh")


def covariance_sums(logins: DataFrame) -> DataFrame:
    """Exact, mergeable sums of (lat, lon, hour) and their products per user.

    Coordinates are whole microdegrees in decimals, so the sums do not depend
    on row order and two batches merge by plain addition.
    """
    sums = [F.sum(c).cast("decimal(38,0)").alias(name) for name, c in moments().items()]
    return logins.groupBy(USER).agg(F.count("*").alias("n"), *sums)


def merge_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(USER).agg(
        F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in MOMENTS])


def covariance_stats(logins: DataFrame) -> DataFrame:
    """Mean vector and sample covariance of (lat, lon, hour), in degrees and hours."""
    return stats_of_sums(covariance_sums(logins), USER)


def stats_of_sums(s: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, `n`, and mean and covariance out of the sums."""
    n = F.col("n").cast("double")
    n_dec = F.col("n").cast("decimal(19,0)")
    unit = {"x": 1e6, "y": 1e6, "h": 1.0}

    def cov(a: str, b: str) -> Column:
        top = (n_dec * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double")
        return F.when(F.col("n") > 1, top / (n * (n - 1)) / (unit[a] * unit[b]))

    means = {f"mean_{name}": F.col(f"s{a}").cast("double") / F.nullif(n, F.lit(0.0)) / unit[a]
             for a, name in (("x", "lat"), ("y", "lon"), ("h", "hour"))}
    covs = {f"cov_{a}{b}": cov(a, b) for a, b in ("xx", "xy", "xh", "yy", "yh", "hh")}
    return s.select(*keep, "n", *[c.alias(k) for k, c in {**means, **covs}.items()])


def _factor(s: dict[str, Column]) -> dict[str, Column]:
    """Pivots and multipliers (LDL^T) of the 3x3 covariance; null past a zero pivot."""
    a, b, c, d, e, f = (s[k] for k in ("xx", "xy", "xh", "yy", "yh", "hh"))
    p1 = F.nullif(a, F.lit(0.0))
    p2 = F.nullif(d - b * b / p1, F.lit(0.0))
    m = e - b * c / p1
    p3 = F.nullif(f - c * c / p1 - m * m / p2, F.lit(0.0))
    return {"p1": p1, "p2": p2, "p3": p3, "l21": b / p1, "l31": c / p1, "l32": m / p2}


def mahalanobis_model(history: DataFrame, skew: SkewPolicy = SKEW,
                      history_limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """One row per user: mean, factored covariance and whether it was degenerate.

    A nearly singular covariance gets a ridge of 1e-6 on its diagonal.
    """
    return model_of_stats(covariance_stats(recent_history(history, skew, history_limit)).where("n > 1"), USER)


def model_of_stats(s: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and the model's, out of means and covariances."""
    keys = ("xx", "xy", "xh", "yy", "yh", "hh")
    plain = _factor({k: F.col(f"cov_{k}") for k in keys})
    sound = ((F.col("cov_xx") > 0)
             & (plain["p2"] / F.nullif("cov_yy", F.lit(0.0)) > PIVOT_FLOOR)
             & (plain["p3"] / F.nullif("cov_hh", F.lit(0.0)) > PIVOT_FLOOR))
    marked = s.withColumn("degenerate", ~F.coalesce(sound, F.lit(False)))
    ridge = F.when(F.col("degenerate"), RIDGE).otherwise(0.0)
    filled = marked.withColumns({f"cov_{k}": F.col(f"cov_{k}") + ridge for k in ("xx", "yy", "hh")})
    factors = _factor({k: F.col(f"cov_{k}") for k in keys})
    return filled.select(
        *keep, F.col("n").alias("history_rows"), "mean_lat", "mean_lon", "mean_hour", "degenerate",
        *[c.alias(k) for k, c in factors.items()])


def mahalanobis_distance(lat="latitude", lon="longitude", ts=TIME) -> Column:
    """Distance of a login joined to its user's model row."""
    x, y = F.col(lat) - F.col("mean_lat"), F.col(lon) - F.col("mean_lon")
    h = clock.login_hour(ts) - F.col("mean_hour")
    z2 = y - F.col("l21") * x
    z3 = h - F.col("l31") * x - F.col("l32") * z2
    square = x * x / F.col("p1") + z2 * z2 / F.col("p2") + z3 * z3 / F.col("p3")
    return F.sqrt(F.when(square < 0, 0.0).otherwise(square))


_MODEL = ("history_rows", "mean_lat", "mean_lon", "mean_hour", "degenerate", "p1", "p2", "p3", "l21", "l31", "l32")


def mahalanobis_columns(joined: DataFrame, min_rows: int = MAHALANOBIS_MIN_ROWS, squared: bool = False) -> DataFrame:
    """Score and details of logins that carry their user's model columns."""
    rows = joined.withColumn("_d", mahalanobis_distance())
    tested = F.col("_d") * F.col("_d") if squared else F.col("_d")
    enough = F.coalesce(F.col("history_rows") >= min_rows, F.lit(False)) & F.col("_d").isNotNull()
    score = F.when(enough, stats.chi2_cdf_3(tested)).otherwise(NEUTRAL)
    details = F.struct(
        F.when(enough, F.col("_d")).alias("mahalanobis_distance"),
        F.when(enough, F.lit(1.0) - F.col("mahalanobis_score")).alias("p_value"),
        F.when(enough, 3).alias("degrees_of_freedom"),
        F.when(enough, F.col("degenerate")).alias("degenerate"),
        F.when(~enough, INSUFFICIENT).alias("message"))
    return (rows.withColumn("mahalanobis_score", score)
            .withColumn("mahalanobis_details", details).drop("_d", *_MODEL))


def with_mahalanobis(logins: DataFrame, model: DataFrame, min_rows: int = MAHALANOBIS_MIN_ROWS,
                     squared: bool = False, skew: SkewPolicy = SKEW) -> DataFrame:
    """Add ``mahalanobis_score`` and ``mahalanobis_details``.

    The chi-square CDF is applied to the distance; ``squared=True`` applies it
    to the squared distance, which is the textbook form.
    """
    return mahalanobis_columns(join_per_user(logins, model, skew, "left"), min_rows, squared)


# --- Isolation forest --------------------------------------------------------

def _average_path(sizes: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of the given size."""
    n = np.asarray(sizes, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _path_lengths(most: int) -> np.ndarray:
    """`_average_path` of every size up to `most`, to be looked up."""
    return _average_path(np.arange(most + 1))


class IsolationForest:
    """Isolation trees (Liu, Ting, Zhou 2008) over numeric columns and one category.

    The category behaves like its one-hot columns: a split on value v sends v to
    the right and all others to the left, and every value present in a mixed
    node is one more candidate column. All trees grow together, level by level.
    Rows lie in the order of (tree, node, category) throughout: a split parts
    each node's rows in place, so that no level is sorted anew.

    Every tree is grown from its own draw of `subsample` rows of the whole history. Where the rows at
    hand are only those that some tree has drawn, `drawn` has each tree's rows, and the offset, which
    takes the scores of the whole history, is left to the caller.
    """

    def __init__(self, numeric: np.ndarray, category: np.ndarray, seed: int, trees: int = TREES,
                 subsample: int = SUBSAMPLE, contamination: float = CONTAMINATION, drawn: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        rows, width = numeric.shape
        self.sample = min(subsample, rows) if drawn is None else drawn.shape[1]
        self.depth = int(np.ceil(np.log2(max(self.sample, 2))))
        slots = self.slots = 2 ** (self.depth + 1)
        self.trees = trees
        self.column = np.full(trees * slots, -1)
        self.cut = np.zeros(trees * slots)
        self.size = np.zeros(trees * slots, dtype=int)
        self.path = _path_lengths(self.sample)
        sorted_rows = np.argsort(category, kind="stable")
        every = drawn is None and self.sample == rows
        if every:
            rng.bit_generator.advance(trees * rows)  # every row is drawn, whatever the numbers
            row = np.tile(sorted_rows, trees)
        else:
            chosen = drawn
            if drawn is None:
                chosen = np.argpartition(rng.random((trees, rows)), self.sample - 1, axis=1)[:, :self.sample]
            rank = np.empty(rows, dtype=int)
            rank[sorted_rows] = np.arange(rows)
            row = sorted_rows[np.sort(rank[chosen], axis=1)].ravel()
        flat = np.ascontiguousarray(numeric.T)
        where = np.arange(trees) * slots  # tree and node of each group of rows, as one number
        self.size[where] = sizes = np.full(trees, self.sample)
        tree = np.repeat(np.arange(trees), self.sample)
        # Where each row of the history ends, as long as every tree holds all of them.
        ends = np.empty((trees, rows)) if every else None
        for level in range(self.depth):
            if not len(row):
                break
            first = np.cumsum(sizes) - sizes
            group = np.repeat(np.arange(len(sizes)), sizes)
            x, c = flat.take(row, axis=1), category.take(row)
            low = np.minimum.reduceat(x, first, axis=1)
            high = np.maximum.reduceat(x, first, axis=1)
            varies = high > low
            numeric_options = varies.sum(axis=0)
            new = np.ones(len(row), dtype=bool)
            np.not_equal(c[1:], c[:-1], out=new[1:])
            new[first] = True
            distinct = np.flatnonzero(new)
            values = np.add.reduceat(new, first, dtype=int)
            value_start = np.cumsum(values) - values
            options = numeric_options + np.where(values > 1, values, 0)
            pick = np.floor(rng.random(len(first)) * options).astype(int)
            shift = rng.random(len(first))
            by_number = pick < numeric_options
            column = np.argmax(np.cumsum(varies, axis=0) == pick + 1, axis=0)
            at = np.arange(len(first))
            least, most = low[column, at], high[column, at]
            threshold = least + shift * (most - least)
            threshold = np.where(threshold >= most, least, threshold)
            slot = np.minimum(value_start + np.maximum(pick - numeric_options, 0), len(distinct) - 1)
            value = c[distinct[slot]]
            split = options > 0
            self.column[where] = np.where(split, np.where(by_number, column, width), -1)
            self.cut[where] = np.where(by_number, threshold, value)
            own = x.ravel().take(column[group] * len(row) + np.arange(len(row)))
            right = np.where(by_number[group], own > threshold[group], c == value[group])
            moved = split[group]
            if ends is not None and not split.all():
                stay = ~moved
                ends[tree[stay], row[stay]] = level + self.path[sizes][group[stay]]
            # The rows of each node that go left, then those that go right, either in their old order.
            target = (group * 2 + right)[moved]
            order = np.argsort(target.astype(np.uint16) if 2 * len(sizes) <= 65_536 else target, kind="stable")
            row, tree = row[moved][order], tree[moved][order]
            counts = np.bincount(target, minlength=2 * len(sizes))
            filled = np.flatnonzero(counts)
            base = where - where % slots
            node = 2 * (where % slots) + 1
            where = (base + node)[filled // 2] + filled % 2
            sizes = counts[filled]
            self.size[where] = sizes
        if ends is not None and len(row):
            ends[tree, row] = self.depth + np.repeat(self.path[sizes], sizes)
        if drawn is None:
            known = self.scores(numeric, category) if ends is None else self._score(ends)
            self.offset = np.percentile(known, 100 * contamination)

    def packed(self) -> list[pa.Array]:
        """What scoring needs, as one row of FOREST."""
        return [pa.array([self.trees], pa.int32()), pa.array([self.sample], pa.int32()), pa.array([self.column], pa.list_(pa.int8())),
                pa.array([self.cut], pa.list_(pa.float64())), pa.array([self.size], pa.list_(pa.int32()))]

    @classmethod
    def unpacked(cls, row: pa.RecordBatch) -> "IsolationForest":
        """The forest of a row of FOREST, without its offset."""
        forest = cls.__new__(cls)
        forest.trees, forest.sample = (row.column(c)[0].as_py() for c in ("trees", "sample"))
        forest.column, forest.cut, forest.size = (row.column(c)[0].values.to_numpy(zero_copy_only=False).astype(kind)
                                                  for c, kind in (("column", int), ("cut", float), ("size", int)))
        forest.slots = len(forest.cut) // forest.trees
        forest.depth = forest.slots.bit_length() - 2
        forest.path = _path_lengths(forest.sample)
        return forest

    def _score(self, path: np.ndarray) -> np.ndarray:
        return -np.power(2.0, -path.mean(axis=0) / _average_path(np.array([self.sample]))[0])

    def scores(self, numeric: np.ndarray, category: np.ndarray) -> np.ndarray:
        """Negative anomaly score of each row, lower is stranger."""
        rows, width = numeric.shape
        flat = np.concatenate([numeric.T.ravel(), np.zeros(rows)])
        start = np.repeat(np.arange(self.trees) * self.slots, rows)  # the tree of each pair of tree and row
        at = np.tile(np.arange(rows), self.trees)
        open_pairs = np.arange(len(start))
        node = np.zeros(len(start), dtype=int)
        path = np.zeros(len(start))
        for level in range(self.depth + 1):
            place = start[open_pairs] + node
            column = self.column.take(place)
            inner = column >= 0
            closed = ~inner
            path[open_pairs[closed]] = level + self.path.take(self.size.take(place[closed]))
            if not inner.any():
                break
            open_pairs, node, place, column = open_pairs[inner], node[inner], place[inner], column[inner]
            cut, row = self.cut.take(place), at.take(open_pairs)
            right = np.where(column == width, category.take(row) == cut, flat.take(column * rows + row) > cut)
            node = 2 * node + 1 + right
        return self._score(path.reshape(self.trees, rows))

    def decision(self, numeric: np.ndarray, category: np.ndarray) -> np.ndarray:
        return self.scores(numeric, category) - self.offset


_FEATURES = ["latitude", "longitude", "hour_sin", "hour_cos", "day_sin", "day_cos"]
_SCORED = f"{USER} string, {EVENT} long, isolation_forest_score double, raw_score double, message string"


def _seed(user: str) -> int:
    return int.from_bytes(hashlib.blake2b(str(user).encode(), digest_size=8).digest(), "big")


def _chunk_scorer(trees: int, subsample: int, contamination: float):
    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        return _score_chunk(rows, trees, subsample, contamination)
    return score


def _score_chunk(rows: pa.RecordBatch, trees: int, subsample: int, contamination: float) -> pa.RecordBatch:
    """Scores of one chunk: the history that it learns from in order of time, then the logins."""
    learnt = rows.num_rows - pc.sum(rows.column("asked")).as_py()
    history, logins = rows.slice(0, learnt), rows.slice(learnt)
    n = logins.num_rows
    if learnt < ADVANCED_MIN_ROWS or not n:
        score, raw, message = np.full(n, NEUTRAL), pa.nulls(n, pa.float64()), pa.array([INSUFFICIENT] * n, pa.string())
    else:
        devices = history.column("device_id").dictionary_encode()
        codes = devices.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        forest = IsolationForest(_features(history), codes, _seed(rows.column(USER)[0].as_py()), trees, subsample,
                                 contamination)
        seen = pc.index_in(logins.column("device_id"), devices.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        found = forest.decision(_features(logins), seen)
        score, raw = np.clip(1.0 - (found + 0.5), 0.0, 1.0), pa.array(found, from_pandas=True)
        message = pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([logins.column(USER), logins.column(EVENT), pa.array(score, from_pandas=True), raw, message],
                                      [USER, EVENT, "isolation_forest_score", "raw_score", "message"])


def _features(rows: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy(zero_copy_only=False) for c in _FEATURES])


def _model_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumns(clock.cyclic_time()).select(
        USER, EVENT, F.col(TIME).cast("timestamp").alias(TIME), "device_id", *_FEATURES, *more)


def isolation_forest_scores(logins: DataFrame, history: DataFrame, skew: SkewPolicy = SKEW,
                            chunk_rows: int = CHUNK_ROWS, login_skew: SkewPolicy = SKEW,
                            history_limit: int | None = None, trees: int = TREES, subsample: int = SUBSAMPLE,
                            contamination: float = CONTAMINATION, learn_rows: int = CHUNK_ROWS) -> DataFrame:
    """Score logins against a forest of their user's history, all of it unless ``history_limit`` bounds it.

    Trees draw from the whole history and the threshold is taken from the scores of the whole history.
    The forest is seeded by the user, so it can be grown again for every chunk of a busy user's logins:
    a task holds at most about ``chunk_rows`` logins and ``learn_rows`` events that it learns from.
    Users with a longer history are learnt in parts (``_scores_by_parts``), so no task holds a whole one.
    """
    past = recent_history(history, skew, history_limit)
    asked = logins.groupBy(USER).agg(F.count("*").alias("_logins"))
    chunks = asked.select(USER, F.ceil(F.col("_logins") / chunk_rows).cast("int").alias("_chunks"))
    long = None
    if history_limit is None or history_limit > learn_rows:
        long = durable(past.groupBy(USER).agg(F.count("*").alias("_n")).where(F.col("_n") > learn_rows).join(asked, USER)
                       .withColumn("_chunks", F.ceil((F.col("_n") + F.col("_logins")) / chunk_rows).cast("int")).drop("_logins"))
        if long.isEmpty():
            long = None
        else:
            # One of ``learn_rows`` rows at most is that of such a user.
            chunks = chunks.join(F.broadcast(long.select(USER)), USER, "left_anti")
    spread = (join_per_user(_model_columns(logins), chunks, login_skew)
              .withColumn("chunk", F.pmod(F.xxhash64(EVENT), F.col("_chunks")).cast("int")).drop("_chunks"))
    copies = (_model_columns(past).join(chunks, USER)
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks"))
    # Growing trees costs far more than the few bytes of input, so all partitions are kept:
    # AQE would merge them by size.
    both = copies.withColumn("asked", F.lit(False)).unionByName(spread.withColumn("asked", F.lit(True)))
    order = ["asked", F.col(TIME).asc_nulls_last(), F.col(EVENT).asc_nulls_last(), "device_id", *_FEATURES]
    scores = map_groups(both, [USER, "chunk"], order, _chunk_scorer(trees, subsample, contamination), _SCORED)
    if long is None:
        return scores
    return scores.unionByName(_scores_by_parts(logins, past, long, skew, login_skew, trees, subsample, contamination))


# --- Forests of long histories -------------------------------------------------

#: A grown forest as columns of one row.
FOREST = "trees int, sample int, column array<tinyint>, cut array<double>, size array<int>"
#: Parts of the range of scores in which the threshold is looked for first.
SCORE_BINS = 65_536


def _drawn(user: str, rows: int, trees: int, subsample: int) -> np.ndarray:
    """Each tree's places in a history of so many rows, drawn without the rows."""
    rng = np.random.default_rng([_seed(user), 1])
    return np.stack([rng.choice(rows, min(subsample, rows), replace=False, shuffle=False) for _ in range(trees)])


def _scores_by_parts(logins: DataFrame, past: DataFrame, users: DataFrame, skew: SkewPolicy, login_skew: SkewPolicy,
                     trees: int, subsample: int, contamination: float) -> DataFrame:
    """Scores of users whose history is too long for one task; ``users`` has their rows ``_n`` and their ``_chunks``.

    The rows that the trees draw are picked by their places and meet in one task per user, `trees` times
    `subsample` at most. The grown forest then goes to every part of the user's history and logins, and the
    threshold is read off the counted scores of the whole history.
    """
    few = F.broadcast(users)
    numbered = Ordered.of(past.join(F.broadcast(users.select(USER)), USER, "left_semi"), skew).number("_at").result()
    rows = durable(_model_columns(numbered, "_at"))

    def places(batches):
        for batch in batches:
            for user, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.unique(_drawn(user, n, trees, subsample)) + 1
                yield pa.RecordBatch.from_arrays([pa.array([user] * len(at), pa.string()), pa.array(at), pa.array(np.full(len(at), n))],
                                                 [USER, "_at", "_n"])

    def grow(part: pa.RecordBatch) -> pa.RecordBatch:
        user = part.column(USER)[0].as_py()
        at = part.column("_at").to_numpy() - 1
        drawn = np.searchsorted(at, _drawn(user, part.column("_n")[0].as_py(), trees, subsample))
        devices = part.column("device_id").dictionary_encode()
        forest = IsolationForest(_features(part), devices.indices.fill_null(-1).to_numpy(zero_copy_only=False), _seed(user), trees,
                                 subsample, drawn=drawn)
        return pa.RecordBatch.from_arrays([part.column(USER).slice(0, 1), pa.array([devices.dictionary.to_pylist()], pa.list_(pa.string())),
                                           *forest.packed()], [USER, "devices", "trees", "sample", "column", "cut", "size"])

    picks = users.select(USER, "_n").mapInArrow(places, f"{USER} string, _at long, _n long")
    forests = map_groups(rows.join(picks, [USER, "_at"]), [USER], ["_at"], grow, f"{USER} string, devices array<string>, {FOREST}")
    spots = lambda spot: F.pmod(spot, F.col("_chunks")).cast("int")
    both = (rows.join(few, USER).select(USER, spots(F.col("_at")).alias("chunk"), EVENT, F.lit(False).alias("asked"), "device_id", *_FEATURES)
            .unionByName(_model_columns(logins).join(few, USER).select(
                USER, spots(F.xxhash64(EVENT)).alias("chunk"), EVENT, F.lit(True).alias("asked"), "device_id", *_FEATURES))
            .unionByName(durable(forests).join(few.select(USER, "_chunks"), USER)
                         .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks"),
                         allowMissingColumns=True))
    scored = durable(map_groups(both, [USER, "chunk"], [F.col("trees").isNull()], _score_part,
                                f"{USER} string, {EVENT} long, asked boolean, score double"))
    offsets = _offsets(scored.where("not asked"), users, contamination)
    raw = F.col("score") - F.col("offset")
    return join_per_user(scored.where("asked").drop("asked"), offsets, login_skew).select(
        USER, EVENT, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - (raw + 0.5))).alias("isolation_forest_score"),
        raw.alias("raw_score"), F.lit(None).cast("string").alias("message"))


def _score_part(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Scores of a part of a user's history and logins, under the forest in its first row."""
    forest, rest = IsolationForest.unpacked(rows), rows.slice(1)
    devices = rest.column("device_id")
    codes = pc.index_in(devices, rows.column("devices")[0].values).fill_null(-2)  # no tree has drawn it
    codes = pc.if_else(pc.is_null(devices), pa.scalar(-1, codes.type), codes).to_numpy(zero_copy_only=False)
    found = forest.scores(_features(rest), codes) if rest.num_rows else np.zeros(0)
    return pa.RecordBatch.from_arrays([rest.column(USER), rest.column(EVENT), rest.column("asked"), pa.array(found)],
                                      [USER, EVENT, "asked", "score"])


def _offsets(known: DataFrame, users: DataFrame, contamination: float) -> DataFrame:
    """The percentile of each user's scores below which a share ``contamination`` lies, linear between neighbours.

    Scores are counted, then counts by bin tell the bins that hold the two neighbours, and only the scores of
    those are put in order.
    """
    counted = durable(known.groupBy(USER, "score").agg(F.count("*").alias("times"))
                      .withColumn("bin", F.floor(F.col("score") * SCORE_BINS).cast("int")))
    upto = F.sum("times").over(Window.partitionBy(USER).orderBy("bin"))
    place = (F.col("_n") - 1) * F.lit(contamination)
    ranks = F.broadcast(users.select(USER, F.floor(place).alias("low"), (place - F.floor(place)).alias("part")))
    bins = (counted.groupBy(USER, "bin").agg(F.sum("times").alias("times")).withColumn("upto", upto).join(ranks, USER)
            .where((F.col("upto") > F.col("low")) & (F.col("upto") - F.col("times") <= F.col("low") + 1))
            .select(USER, "bin", (F.col("upto") - F.col("times")).alias("before"), "low", "part"))
    near = counted.join(bins, [USER, "bin"])
    first = Window.partitionBy(USER, "bin").orderBy("score")
    ordered = near.withColumn("upto", F.col("before") + F.sum("times").over(first))
    ends = ordered.groupBy(USER, "part").agg(
        F.min(F.when(F.col("upto") > F.col("low"), F.col("score"))).alias("a"),
        F.min(F.when(F.col("upto") > F.col("low") + 1, F.col("score"))).alias("b"))
    return ends.select(USER, (F.col("a") + (F.coalesce("b", "a") - F.col("a")) * F.col("part")).alias("offset"))
