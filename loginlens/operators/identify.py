"""Login patterns of every user: density clusters, else k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.operators.dbscan import EPS, MIN_SAMPLES, check_eps, dbscan_in_steps
from loginlens.operators.kmeans import kmeans
from loginlens.operators.local_clusters import label_by_size
from loginlens.operators.patterns import cluster_stats
from loginlens.operators.segments import SKEW, SkewPolicy
from loginlens.schema import EVENT, USER
from loginlens.session import durable


def undivided_users(labelled: DataFrame) -> DataFrame:
    """Users for whom density clustering gave a single label, noise included."""
    return (labelled.groupBy(USER).agg(F.min("cluster").alias("_a"), F.max("cluster").alias("_b"))
            .where(F.col("_a") == F.col("_b")).select(USER))


def label_logins(logins: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES,
                 skew: SkewPolicy = SKEW) -> DataFrame:
    """Logins with their cluster number; -1 is noise. Users of ordinary size pass once, for both kinds of clusters."""
    check_eps(eps)
    return label_by_size(logins, eps, min_samples, True, lambda rows: label_in_steps(rows, eps, min_samples, skew))


def label_in_steps(logins: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES,
                   skew: SkewPolicy = SKEW) -> DataFrame:
    """`label_logins` by joins over all tasks, whatever a user's size."""
    skew = skew.measured(logins)
    dense = durable(dbscan_in_steps(logins, eps, min_samples, skew))
    undivided = undivided_users(dense)
    rest = logins.join(undivided, USER, "left_semi")
    split = kmeans(rest, skew=skew)
    relabelled = dense.join(undivided, USER, "left_semi").drop("cluster").join(split, [USER, EVENT])
    return dense.join(undivided, USER, "left_anti").unionByName(relabelled)


def identify_patterns(logins: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES,
                      skew: SkewPolicy = SKEW) -> DataFrame:
    """Cluster statistics of every user, one row per (user, cluster)."""
    return cluster_stats(durable(label_logins(logins, eps, min_samples, skew)))
