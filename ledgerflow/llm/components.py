"""Connected components of an edge table: union-find inside partitions, then contraction until no edge is left.

Defined cases: an edge from a node to itself links nothing; edges that repeat, or stand both ways, count once; an edge with a null
end is left out; without edges there are no components; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Nodes that a task holds before it gives out what it knows and starts anew.
HELD = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as (node, smallest node that they lead to); edges given out in parts link the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def known() -> pd.DataFrame:
        found = [(x, root(x)) for x in list(parent)]
        return pd.DataFrame([f for f in found if f[0] != f[1]], columns=["a", "b"], dtype="int64")

    for batch in batches:
        if len(parent) > HELD:
            yield known()
            parent.clear()
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield known()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), both long: the smallest node that it is linked to.

    Each round every node takes its smallest neighbour for a parent, parents are followed to the top and the edges move
    to the tops. A round at least halves the nodes that still have edges; all tables stay distributed.
    """
    left = staged(edges.select("a", "b").dropna().mapInPandas(_forest, "a long, b long"), "edges")
    known = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("top")), "parents")
        while True:
            up = parents.select(F.col("node").alias("top"), F.col("top").alias("higher"))
            higher = staged(parents.join(up, "top").select("node", F.col("higher").alias("top"), (F.col("higher") < F.col("top")).alias("moved")), "parents")
            parents, moved = higher.select("node", "top"), higher.where("moved").isEmpty()
            if moved:
                break
        if known is None:
            known = parents
        else:
            up = parents.select(F.col("node").alias("top"), F.col("top").alias("higher"))
            known = known.join(up, "top", "left").select("node", F.coalesce("higher", "top").alias("top"))
            known = staged(known.unionByName(parents.join(known, "node", "left_anti")), "tops")
        a, b = (parents.select(F.col("node").alias(k), F.col("top").alias(f"top_{k}")) for k in "ab")
        moved_edges = left.join(a, "a").join(b, "b").where("top_a <> top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
        left = staged(moved_edges.distinct(), "edges")
    return known.withColumnRenamed("top", "component") if known is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
