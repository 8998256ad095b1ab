"""Connected components by alternating large-star and small-star rounds.

Each round keeps at most as many edges as there were. Minima per node are aggregated with map-side combine and joined
back to the edges in a plain equi-join, whose skewed partitions the planner splits, so a node with very many
neighbours is no bottleneck. Every round is written to the shared folder, in files whose number follows the edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowire.llm.common import materialise


#: Edges that one file of a written round holds.
EDGES_PER_FILE = 250_000


def least_reachable(links: np.ndarray) -> np.ndarray:
    """For each row the least row reachable over the symmetric link matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node that has an edge; component is the least id reachable.

    ``edges`` has two long columns u, v; direction, repetition and loops do not matter.
    """
    start = edges.toDF("u", "v").where("u is not null and v is not null and u != v")
    current = materialise(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    files, state = current.count() // EDGES_PER_FILE + 1, None  # rounds never add edges
    while True:
        current = materialise(_small_star(_large_star(current)).coalesce(files), "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # at the end every edge leads from a node to the least of its component
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        current.select(F.col("v"), F.col("v")).distinct())
