"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the components of the given edges."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contract(batches):
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        if len(a):
            a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _contract_all(batches):
    """All batches as one."""
    parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        a, b = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


SMALL = 1 << 20
"""Edges (16 MB) that one task contracts."""


def components(edges: DataFrame, rounds: int = 100, small: int = SMALL) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long); root is the smallest node reachable.

    Each batch is contracted on its executor first. ``small`` edges at most
    that are left go to one task; of more, large and small stars alternate
    until nothing changes, each round cut at a checkpoint. Only counts come to
    the driver.
    """
    stars = edges.where(F.col("a") != F.col("b")).mapInArrow(_contract, "a long, b long")
    stars, before = cut(stars.distinct()), None
    if stars.count() <= small:
        roots = cut(stars.coalesce(1).mapInArrow(_contract_all, "a long, b long")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # every edge now points from a larger node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        stars = cut(small.where(F.col("a") != F.col("b")).distinct())
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
