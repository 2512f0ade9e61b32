"""Connected components of an edge table, as rounds of joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import stored


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges (a, b) as edges to each one's smallest node."""
    if not len(a):
        return a, b
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = both[:len(a)], both[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (long): the root is the
    smallest node that can be reached.

    Large-star and small-star rounds: every node passes its larger neighbours, then
    its smaller ones, to the smallest node it knows. A node with very many neighbours
    is one key of an aggregate with partial sums and of a join that Spark can split."""
    pairs = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "components")
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (large.join(low, F.col("u") == F.col("k"))
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u != v").distinct())
        pairs = stored(small, "components")
        before, state = state, _state(pairs)
        if state == before:
            break
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(pairs: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)),
                           F.coalesce(F.sum(F.shiftright(h, 24)), F.lit(0))).first())
