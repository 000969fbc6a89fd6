"""Connected components of a stored list of links, by alternating small and large stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import forget, keep


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b to links (node, smallest node of its connected set)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = ends[:len(a)], ends[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint, either way round) to (node, root): root is the smallest node that can be reached.

    Each round hangs every node's larger neighbours below its smallest one, and every node's smaller neighbours likewise, until
    every component is a star. Links are stored after each round, which cuts the lineage; grouped minima are combined before
    the shuffle, and a node with very many links is a skewed join side that Spark may split. Links of a node to itself and
    repeated links do no harm; nodes without links are not listed.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = _state(edges)
    while before[0]:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = keep(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        both = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        above = small.select(F.col("b").alias("u"), F.col("a").alias("v"))  # neighbours above a node
        old, edges = edges, keep(above.join(least.select(F.col("a").alias("u"), "m"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        forget(small, old)
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
