"""Connected components of a graph given as a table of edges, by repeated contraction.

While more than ``SMALL`` edges are left, each round contracts the graph: every node points to the neighbour (or itself) that comes first in the round's order, edges move to what
their ends point to, and loops and repeats vanish. The order changes with the round, so that no chain of ids is
walked one step a round. Nothing is gathered for a node but a minimum, so that hubs are no hot spots, and each
round's tables go to the shared checkpoint folder. What is left in the end, at most ``SMALL`` edges, one task joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Edges that one task joins at most; 16 bytes each.
SMALL = 1 << 16
_MULTIPLIER, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mask(round_: int) -> int:
    """A signed 64-bit pattern for the round; ids are ordered by id XOR pattern."""
    x = (round_ + 1) * _MULTIPLIER & _MASK
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _MASK
    return x - (1 << 64) if x >> 63 else x


def _ordered(id_: Column, mask: int) -> Column:
    return id_.bitwiseXOR(F.lit(mask))


class Forest:
    """Disjoint sets of indexes; joins many pairs at once."""

    def __init__(self, count: int):
        self.parent = np.arange(count)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [rows.to_numpy(np.int64) for rows in batches]
    if parts:
        ends = np.concatenate(parts)
        nodes, at = np.unique(ends, return_inverse=True)
        forest, at = Forest(len(nodes)), at.reshape(ends.shape)
        forest.join(at[:, 0], at[:, 1])
        yield pd.DataFrame({"a": nodes, "to": nodes[forest.roots(np.arange(len(nodes)))]})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long; any repeats, loops and directions).

    root is one node of the component, the same for all of it. Rows with a null end are no edges. An empty table
    gives an empty one.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = checkpointed(edges)
    rounds: list[DataFrame] = []
    while count := edges.count():
        if count <= SMALL:
            rounds.append(checkpointed(edges.repartition(1).mapInPandas(_joined, "a long, to long")))
            break
        mask = _mask(len(rounds))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_ordered(F.col("b"), mask)).alias("m"))
        to = first.select("a", _ordered(F.least("m", _ordered(F.col("a"), mask)), mask).alias("to"))
        to = checkpointed(to)
        rounds.append(to)
        left = edges.join(to.withColumnRenamed("to", "p"), "a")
        ends = left.join(to.select(F.col("a").alias("b"), F.col("to").alias("q")), "b").where("p <> q")
        edges = checkpointed(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for to in rounds[1:]:
        step = to.select(F.col("a").alias("root"), F.col("to").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
