"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group that the links a-b make: (member, smallest member), one row a member beyond the smallest.

    Used inside tasks, so what leaves a task is at most one edge for each linked member.
    """
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, label[x], label[y])
        np.minimum.at(new, label[y], label[x])
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[rest], ids[label[rest]]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", salts: int = 8) -> DataFrame:
    """(id, component): each id that has an edge, with the smallest id reachable from it.

    Each round is two aggregations and two joins over edges only; minima are combined before the shuffle, and rows of a
    hub are dealt over ``salts`` tasks. Rounds grow with the logarithm of the longest path. Nulls, self links and
    repeated links have no effect; ids without a link to another are not returned. No edge: an empty result.
    """

    def nearest(pairs: DataFrame) -> DataFrame:
        """pairs(u, v) with m, the smallest v of u or u itself."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        least = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "s"]).drop("s")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct()
    e = cut(e)
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = nearest(large)
        e = cut(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct())
        after = state(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
