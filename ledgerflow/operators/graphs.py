"""Rings: connected components of a use graph, without listing the pairs that a shared key makes.

A key links its members to the smallest of them, so a key of n members is n - 1 edges, not n^2 pairs, and one of a single member is none; a ring is a
component of that graph over the members.
Components are found by contraction: in turn every node links its larger neighbours, then its smaller ones, to the smallest node that it knows,
until nothing moves; the edges are then a star around each component's smallest node. Rounds grow with the logarithm of
the nodes. What a node knows is an aggregate, which each task takes of its own rows first; it goes back to the node's edges by `heavy_join`,
so that a hub's edges stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import staged

#: A key is heavy from this share of the rows on, so at most that many keys are heavy and their table broadcasts; fewer rows than these fit a task anyway.
HEAVY, FEW = 1000, 1 << 16


def heavy_join(rows: DataFrame, facts: DataFrame, key: str, n: str, heavy: int = HEAVY, few: int = FEW) -> DataFrame:
    """rows with the columns of facts, which has one row a key and in n how many rows hold it; rows without facts go.

    Keys with over 1 / heavy of all rows are fewer than `heavy`: their facts are broadcast and their rows are not shuffled. The others are joined by
    key, and none of them fills a task.
    """
    total, most = facts.agg(F.sum(n), F.max(n)).first()
    bound = max((total or 0) / heavy, few)
    if (most or 0) <= bound:
        return rows.join(facts.drop(n), key)
    big, small = facts.where(F.col(n) > bound).drop(n), facts.where(F.col(n) <= bound).drop(n)
    return rows.join(F.broadcast(big), key).unionByName(rows.join(F.broadcast(big.select(key)), key, "left_anti").join(small, key))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, heavy: int = HEAVY, few: int = FEW) -> DataFrame:
    """(node, component, of the type of edges' columns a and b): the smallest node that each node is linked to.

    Nulls link nothing, nor does an edge from a node to itself; a node that has no other edge is not in the result.
    """
    known = lambda df: staged(df.where("a <> b").distinct(), "edges")
    left = known(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(edges["a"].isNotNull() & edges["b"].isNotNull()))
    before = _state(left)
    while True:
        # larger neighbours: every node links them to the smallest of its neighbourhood
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.sum((F.col("b") > F.col("a")).cast("long")).alias("n")), "least")
        left = known(heavy_join(both.where("b > a"), least, "a", "n", heavy, few).select(F.col("b").alias("a"), F.col("least").alias("b")))
        # smaller neighbours, and the node itself
        least = staged(left.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")), "least")
        moved = heavy_join(left, least, "a", "n", heavy, few)
        left = known(moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))))
        after = _state(left)
        if after == before:
            break
        before = after
    return left.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(left.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def rings(uses: DataFrame, by: str, who: str, confirmed: str, heavy: int = HEAVY, few: int = FEW) -> DataFrame:
    """(who, ring, members, keys, confirmed) for each member: its ring's smallest member, how many members and keys the ring has, and its confirmed uses.

    Uses without a member are left out; a use without a key makes its member a ring of its own, unless it has others.
    """
    rows = staged(uses.select(by, who, F.coalesce(F.col(confirmed).cast("long"), F.lit(0)).alias("__own")).where(F.col(who).isNotNull()), "uses")
    # every key stands for its smallest member; only keys of several members link any
    facts = staged(rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(who).alias("__least"), F.max(who).alias("__most"), F.count(F.lit(1)).alias("__n")), "keys")
    shared = facts.where(F.col("__least") < F.col("__most")).drop("__most")
    edges = heavy_join(rows.drop("__own"), shared, by, "__n", heavy, few).select(F.col(who).alias("a"), F.col("__least").alias("b"))
    ring = staged(components(edges, heavy, few), "components").select(F.col("node").alias("__who"), F.col("component").alias("__ring"))
    each = rows.groupBy(who).agg(F.sum("__own").alias("__own"))
    first = facts.groupBy(F.col("__least").alias("__first")).agg(F.count(F.lit(1)).alias("__keys"))
    each = each.join(ring, F.col(who) == F.col("__who"), "left").join(first, F.col(who) == F.col("__first"), "left")
    each = staged(each.select(who, "__own", F.coalesce("__keys", F.lit(0)).alias("__keys"), F.coalesce("__ring", who).alias("ring")), "members")
    totals = each.groupBy("ring").agg(F.count(F.lit(1)).alias("members"), F.sum("__keys").alias("keys"), F.sum("__own").alias("confirmed"), F.count(F.lit(1)).alias("__n"))
    return heavy_join(each.select(who, "ring"), staged(totals, "rings"), "ring", "__n", heavy, few).select(who, "ring", "members", "keys", "confirmed")
