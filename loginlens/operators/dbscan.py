"""Exact DBSCAN for all users at once, without enumerating pairs inside a group.

Features are the per-user standardised latitude, longitude and cyclic time plus
device one-hots. In that space two logins closer than eps share device and
weekday: two devices are at least sqrt(8) apart, two weekdays at least
2 sin(pi/7) = 0.8677, because standard deviations of sines and cosines are at
most 1. Inside one (user, device, weekday) the problem is two-dimensional, with
an offset per pair of hours.

Work stays close to linear in the number of logins:

* Equal logins collapse into weighted *sites*.
* Sites fall into grid cells whose diagonal is below eps. A cell with
  ``min_samples`` logins consists of core points only. Only sites of thinner
  cells, at most ``min_samples - 1`` each, are compared with the blocks around
  them, or with all of their (user, device, weekday) where that has few sites.
* Connectivity is decided between cells by their bounding boxes. Only where a
  box pair straddles eps are both boxes split, eight-fold per axis, until every
  pair is decided. A box holding one location is a point, so this ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loginlens.functions import clock, geo
from loginlens.operators.local_clusters import label_by_size
from loginlens.operators.patterns import NOISE, SITE, feature_frame, with_site
from loginlens.operators.segments import SKEW, SkewPolicy, join_per_user
from loginlens.schema import EVENT, TIME, USER
from loginlens.session import discard, durable

EPS = 0.5
MIN_SAMPLES = 5
MAX_EPS = 2 * math.sin(math.pi / 7)
SPLIT = 8
#: Rows of a (user, device, weekday) up to which all are compared with each other; any number is right.
SMALL_GROUP = 32
GROUP = (USER, "device_id", "day")
CELL = (*GROUP, "hour", "i", "j")


def check_eps(eps: float) -> None:
    if not 0 < eps < MAX_EPS:
        raise ValueError(f"eps must lie between 0 and {MAX_EPS:.4f}: beyond it weekdays may mix")


def scaled_sites(logins: DataFrame, eps: float = EPS, skew: SkewPolicy = SKEW) -> DataFrame:
    """Distinct places in feature space with their login count and earliest login."""
    check_eps(eps)
    side = eps / math.sqrt(2) * (1 - 1e-9)
    placed = with_site(logins).groupBy(*SITE).agg(
        F.count("*").alias("weight"), F.min(F.struct(TIME, EVENT)).alias("earliest"))
    hour_sin, hour_cos = clock.cyclic(F.col("hour"), 24)
    return (join_per_user(placed, feature_frame(logins), skew)
            .withColumn("lon_unwrapped", geo.unwrap_longitude("longitude", "lon_range", "points"))
            .withColumns({"u": F.col("latitude") / F.col("latitude_std"),
                          "v": F.col("lon_unwrapped") / F.col("lon_unwrapped_std"),
                          "p": hour_sin / F.col("hour_sin_std"),
                          "q": hour_cos / F.col("hour_cos_std")})
            .withColumns({"i": F.floor(F.col("u") / side), "j": F.floor(F.col("v") / side)})
            .select(*CELL, "latitude", "longitude", "weight", "earliest", "u", "v", "p", "q"))


def _squared(du: Column, dv: Column, a: str, b: str) -> Column:
    dp, dq = F.col(f"{a}.p") - F.col(f"{b}.p"), F.col(f"{a}.q") - F.col(f"{b}.q")
    return du * du + dv * dv + dp * dp + dq * dq


def _around(block_i: Column, block_j: Column) -> Column:
    """The block itself and its eight neighbours."""
    return F.explode(F.array(*[
        F.struct((block_i + di).alias("bi"), (block_j + dj).alias("bj"))
        for di in (-1, 0, 1) for dj in (-1, 0, 1)]))


def _crowded(rows: DataFrame) -> DataFrame | None:
    """Groups of more than SMALL_GROUP rows, None if there are none; the rows are counted, not gathered."""
    found = durable(rows.groupBy(*GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL_GROUP).select(*GROUP))
    return None if found.isEmpty() else found


def _split_by_size(a: DataFrame, b: DataFrame, crowded: DataFrame | None, block_of) -> list[tuple[DataFrame, DataFrame, tuple[str, ...]]]:
    """Both sides of a neighbour join with its keys: small groups are joined whole, crowded ones block by block.

    Copies of `a` in nine blocks cost more than the few pairs of a small group.
    """
    if crowded is None:
        return [(a, b, GROUP)]
    on = list(GROUP)
    far = b.join(crowded, on, "left_semi")
    bi, bj = block_of()
    spread = a.join(crowded, on, "left_semi").withColumn("block", _around(bi, bj)).select("*", "block.bi", "block.bj")
    return [(a.join(crowded, on, "left_anti"), b.join(crowded, on, "left_anti"), GROUP),
            (spread, far.withColumns({"bi": bi, "bj": bj}), (*GROUP, "bi", "bj"))]


def with_cell_weight(sites: DataFrame) -> DataFrame:
    """Sites with `cell_weight`, the logins of their grid cell."""
    return sites.join(sites.groupBy(*CELL).agg(F.sum("weight").alias("cell_weight")), list(CELL))


def thin_neighbours(sites: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Sites of thin cells with every site within eps of them (themselves included); needs `cell_weight`."""
    place = ("earliest", "u", "v", "p", "q")
    thin = sites.where(F.col("cell_weight") < min_samples).select(*GROUP, *place)
    near = sites.select(*GROUP, *place, "weight")
    d2 = _squared(F.col("a.u") - F.col("b.u"), F.col("a.v") - F.col("b.v"), "a", "b")
    found = []
    for left, right, keys in _split_by_size(thin, near, _crowded(sites), lambda: (F.floor(F.col("u") / eps), F.floor(F.col("v") / eps))):
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
        found.append(left.alias("a").join(right.alias("b"), same).where(d2 <= eps * eps)
                     .select(F.col(f"a.{USER}").alias(USER), F.col("a.earliest").alias("site"),
                             F.col("b.earliest").alias("other"), F.col("b.weight").alias("weight")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _bbox() -> list[Column]:
    return [F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"),
            F.max("v").alias("v1"), F.first("p").alias("p"), F.first("q").alias("q")]


def _bounds() -> tuple[Column, Column]:
    """Smallest and largest squared distance two boxes ``a`` and ``b`` allow."""
    def gap(axis):
        return F.greatest(F.col(f"a.{axis}0") - F.col(f"b.{axis}1"),
                          F.col(f"b.{axis}0") - F.col(f"a.{axis}1"), F.lit(0.0))
    def reach(axis):
        return F.greatest(F.col(f"a.{axis}1") - F.col(f"b.{axis}0"),
                          F.col(f"b.{axis}1") - F.col(f"a.{axis}0"))
    return (_squared(gap("u"), gap("v"), "a", "b"), _squared(reach("u"), reach("v"), "a", "b"))


def _cell_pairs(nodes: DataFrame, eps: float) -> DataFrame:
    """Pairs of core cells that may touch, marked as touching or undecided."""
    low, high = _bounds()
    found = []
    for left, right, keys in _split_by_size(nodes, nodes, _crowded(nodes), lambda: (F.floor(F.col("i") / 2), F.floor(F.col("j") / 2))):
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
        found.append(left.alias("a").join(right.alias("b"), same)
                     .where(F.col("a.node") < F.col("b.node"))
                     .where(low <= eps * eps)
                     .select(F.col("a.node").alias("left"), F.col("b.node").alias("right"),
                             (high <= eps * eps).alias("touch")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _decide(pairs: DataFrame, members: DataFrame, side: float, eps: float) -> list[DataFrame]:
    """Split the boxes of undecided cell pairs until each pair is settled."""
    found = []
    open_boxes = pairs.where(~F.col("touch")).select(
        "left", "right", F.lit(0).cast("bigint").alias("li"), F.lit(0).cast("bigint").alias("lj"),
        F.lit(0).cast("bigint").alias("ri"), F.lit(0).cast("bigint").alias("rj"))
    if open_boxes.isEmpty():
        return found
    level, factor = 0, 1
    members = durable(members)
    while True:
        level, factor = level + 1, factor * SPLIT
        # Box numbers are relative to the cell, so that splits nest exactly.
        x = F.floor((F.col("u") / side - F.col("i")) * factor)
        y = F.floor((F.col("v") / side - F.col("j")) * factor)
        boxes = (members.withColumns({"x": x, "y": y}).groupBy("node", "x", "y").agg(*_bbox())
                 .withColumns({"px": F.floor(F.col("x") / SPLIT) if level > 1 else F.lit(0).cast("bigint"),
                               "py": F.floor(F.col("y") / SPLIT) if level > 1 else F.lit(0).cast("bigint")}))
        low, high = _bounds()
        a, b, o = boxes.alias("a"), boxes.alias("b"), open_boxes.alias("o")
        tested = (o.join(a, (F.col("o.left") == F.col("a.node")) & (F.col("o.li") == F.col("a.px"))
                         & (F.col("o.lj") == F.col("a.py")))
                  .join(b, (F.col("o.right") == F.col("b.node")) & (F.col("o.ri") == F.col("b.px"))
                        & (F.col("o.rj") == F.col("b.py")))
                  .where(low <= eps * eps)
                  .select("o.left", "o.right", F.col("a.x").alias("li"), F.col("a.y").alias("lj"),
                          F.col("b.x").alias("ri"), F.col("b.y").alias("rj"),
                          (high <= eps * eps).alias("touch")))
        tested = durable(tested)
        touching = tested.where("touch").select("left", "right").distinct()
        found.append(touching)
        open_boxes = tested.drop("touch").join(touching, ["left", "right"], "left_anti")
        if open_boxes.isEmpty():
            return found


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node with an edge is connected to.

    Every round takes the neighbours' smallest label and then follows labels
    one hop further, so long chains shorten geometrically.
    """
    both = edges.select("left", "right").unionByName(
        edges.select(F.col("right").alias("left"), F.col("left").alias("right")))
    labels = durable(both.groupBy(F.col("left").alias("node")).agg(
        F.least(F.min("right"), F.col("node")).alias("label")))
    stored = labels
    while True:
        heard = (both.join(labels.withColumnRenamed("node", "right"), "right")
                 .groupBy(F.col("left").alias("node")).agg(F.min("label").alias("_heard")))
        spread = (labels.join(heard, "node", "left")
                  .select("node", F.col("label").alias("_old"),
                          F.least("label", "_heard").alias("label")))
        hop = spread.select(F.col("node").alias("label"), F.col("label").alias("_hop"))
        after = durable(spread.join(hop, "label", "left")
                        .select("node", "_old", F.least("label", "_hop").alias("label")))
        discard(stored)
        stored, labels = after, after.select("node", "label")
        if after.where(F.col("label") != F.col("_old")).isEmpty():
            return labels


def cell_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of every core cell; a cell without edges is its own component."""
    own = nodes.select("node", F.col("node").alias("_own"))
    if edges.isEmpty():
        return own.withColumnRenamed("_own", "label")
    return (own.join(connected_components(edges), "node", "left")
            .select("node", F.coalesce("label", "_own").alias("label")))


def core_sites(sites: DataFrame, pairs: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Sites with at least ``min_samples`` logins within eps, their own included; needs `cell_weight`."""
    near = pairs.groupBy(F.col("site").alias("earliest")).agg(F.sum("weight").alias("_near"))
    dense = sites.where(F.col("cell_weight") >= min_samples)
    thin = sites.where(F.col("cell_weight") < min_samples).join(near.where(F.col("_near") >= min_samples).select("earliest"),
                                                                "earliest", "left_semi")
    return dense.unionByName(thin).drop("cell_weight")


def core_logins(logins: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES,
                skew: SkewPolicy = SKEW) -> DataFrame:
    """Logins that are DBSCAN core points."""
    skew = skew.measured(logins)
    sites = durable(with_cell_weight(durable(scaled_sites(logins, eps, skew))))
    cores = core_sites(sites, thin_neighbours(sites, eps, min_samples), min_samples)
    return with_site(logins).join(cores.select(*SITE), list(SITE), "left_semi")


def dbscan(logins: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES,
           skew: SkewPolicy = SKEW) -> DataFrame:
    """Logins with ``cluster``: 0, 1, ... by each cluster's earliest core login, -1 is noise.

    A border login within reach of several clusters joins the lowest-numbered. Users of
    ordinary size are labelled in one task each, the others by the steps above.
    """
    check_eps(eps)
    return label_by_size(logins, eps, min_samples, False, lambda rows: dbscan_in_steps(rows, eps, min_samples, skew))


def dbscan_in_steps(logins: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES,
                    skew: SkewPolicy = SKEW) -> DataFrame:
    """`dbscan` by joins over all tasks, whatever a user's size."""
    skew = skew.measured(logins)
    sites = durable(with_cell_weight(durable(scaled_sites(logins, eps, skew))))
    pairs = durable(thin_neighbours(sites, eps, min_samples))
    cores = durable(core_sites(sites, pairs, min_samples))
    side = eps / math.sqrt(2) * (1 - 1e-9)
    nodes = durable(cores.groupBy(*CELL).agg(F.min("earliest").alias("node"), *_bbox()))
    members = cores.join(nodes.select(*CELL, "node"), list(CELL))
    cell_pairs = durable(_cell_pairs(nodes, eps))
    edges = cell_pairs.where("touch").select("left", "right")
    for more in _decide(cell_pairs, members, side, eps):
        edges = edges.unionByName(more)
    labels = durable(cell_labels(nodes, edges))
    core_labels = members.select(USER, "node", F.col("earliest").alias("site")).join(labels, "node").select(
        USER, "site", "label")
    borders = (pairs.join(core_labels.select("site"), "site", "left_anti")
               .join(core_labels.select(F.col("site").alias("other"), "label"), "other")
               .groupBy(USER, "site").agg(F.min("label").alias("label")))
    numbered = labels.join(nodes.select("node", USER), "node").select(USER, "label").distinct()
    numbered = numbered.withColumn(
        "cluster", F.row_number().over(Window.partitionBy(USER).orderBy("label")) - 1)
    site_cluster = (core_labels.unionByName(borders).join(numbered, [USER, "label"])
                    .select(F.col("site").alias("earliest"), "cluster"))
    by_place = sites.join(site_cluster, "earliest").select(*SITE, "cluster")
    return (with_site(logins).join(by_place, list(SITE), "left")
            .withColumn("cluster", F.coalesce("cluster", F.lit(NOISE)).cast("int"))
            .select(USER, EVENT, TIME, "latitude", "longitude", "device_id", "cluster"))
