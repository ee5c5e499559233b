"""Exact quantiles and other order statistics, by key, without a key's values in one task.

`percentile` keeps all distinct values of its group in one task. Beyond SMALL rows a value at a place in a key's order is
found otherwise: a sketch brackets it, the rows below the bracket are counted, and the few distinct values inside are ranked by running
totals over ranges. Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.workspace import staged

#: Rows up to which a plain percentile is taken.
SMALL = 1 << 20
ACCURACY = 1000
#: A sketch misses a rank by a share of 1 / ACCURACY; the bracket leaves room for four times that.
SLACK = 4.0 / ACCURACY


def running_total(df: DataFrame, order: str | list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value up to each row in a total order, by ranges and the offsets of the ranges before."""
    order = [order] if isinstance(order, str) else order
    part = staged(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sums = part.groupBy("__p").agg(F.sum(value).alias("s"))
    before = sums.select("__p", F.coalesce(F.sum("s").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(W.partitionBy("__p").orderBy(*order))
    return part.withColumn("__in", inside).join(F.broadcast(before), "__p").withColumn(out, F.col("__in") + F.col("__before")).drop("__p", "__in", "__before")  # one row a range


def at_places(narrow: DataFrame, value: str, at: dict[str, tuple[float, Callable[[Column, Column], Column]]], *keys: str, slack: float = SLACK) -> DataFrame:
    """(keys, a column of each name): the interpolated values at places of each key's ascending order; nulls have no place.

    at: name -> (about the share of the rows below, place from (values, rows), counted from 0). A key without values gives nulls. Where a
    bracket turns out not to hold its place, brackets eight times as wide are taken.
    """
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    v = narrow.select(*keys, F.col(value).cast("double").alias("__v"))
    low, high = ([min(1.0, max(0.0, q + s)) for q, _ in at.values()] for s in (-slack, slack))
    sketch = lambda shares: F.percentile_approx("__v", F.array(*[F.lit(x) for x in shares]), F.lit(ACCURACY))
    found = v.groupBy(*keys).agg(F.count("__v").alias("__n"), F.count(F.lit(1)).alias("__rows"), sketch(low).alias("__low"), sketch(high).alias("__high"))
    # few values are bracketed whole
    few = (F.col("__n") * slack < 8) | F.lit(slack >= 1)
    found = found.withColumns({"__low": F.when(few, F.array_repeat(F.lit(float("-inf")), len(at))).otherwise(F.col("__low")), "__high": F.when(few, F.array_repeat(F.lit(float("inf")), len(at))).otherwise(F.col("__high"))})
    found = staged(found.select(*[F.col(k).alias(f"__{k}") for k in keys], "__n", "__rows", "__low", "__high"), "brackets")
    joined = v.where("__v IS NOT NULL")
    # an aggregate without keys is one row at any scale
    joined = joined.join(found, on=_all(same)) if keys else joined.crossJoin(F.broadcast(found))
    below = joined.groupBy(*keys).agg(*[F.sum((F.col("__v") < F.col("__low")[k]).cast("long")).alias(f"__below{k}") for k in range(len(at))])
    inside = F.filter(F.array(*[F.when((F.col("__v") >= F.col("__low")[k]) & (F.col("__v") <= F.col("__high")[k]), F.lit(k)) for k in range(len(at))]), lambda x: x.isNotNull())
    counts = joined.select(*keys, F.explode(inside).alias("__which"), "__v").groupBy(*keys, "__which", "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = staged(running_total(counts, [*keys, "__which", "__v"], "__c", "__upto"), "ranked")
    starts = ranked.groupBy(*keys, "__which").agg(F.min(F.col("__upto") - F.col("__c")).alias("__start")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__which").alias("__which_s"), "__start")
    ranked = ranked.join(starts, on=_all([F.col("__which") == F.col("__which_s"), *same])).drop("__which_s", *[f"__{k}" for k in keys])
    places = {k: place(F.col("__n"), F.col("__rows")) for k, (_, place) in enumerate(at.values())}
    below = below.withColumnsRenamed({k: f"__{k}" for k in keys})
    facts = _facts(found, below, places, keys)
    if _missed(ranked, facts, len(at), keys):
        return at_places(narrow, value, at, *keys, slack=slack * 8)
    return _interpolated(ranked, facts, list(at), keys)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _facts(found: DataFrame, below: DataFrame, places: dict[int, Column], keys: tuple[str, ...]) -> DataFrame:
    """One row a key: values, wanted places, and the rows below each bracket."""
    own = [f"__{k}" for k in keys]
    facts = found.select(*own, "__n", *[p.alias(f"__place{k}") for k, p in places.items()])
    below = below.withColumnsRenamed({k: f"_b{k}" for k in own})
    facts = facts.join(below, on=_all([F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in own]), how="left").drop(*[f"_b{k}" for k in own]) if keys else facts.crossJoin(F.broadcast(below))
    return staged(facts, "places")


def _missed(ranked: DataFrame, facts: DataFrame, n: int, keys: tuple[str, ...]) -> bool:
    """Whether a wanted place lies outside its bracket."""
    upto = F.col("__upto") - F.col("__start")
    inside = ranked.groupBy(*[F.col(k).alias(f"_i{k}") for k in keys]).agg(*[F.coalesce(F.max(F.when(F.col("__which") == k, upto)), F.lit(0)).alias(f"__inside{k}") for k in range(n)])
    met = facts.join(inside, on=_all([F.col(f"__{k}").eqNullSafe(F.col(f"_i{k}")) for k in keys]), how="left") if keys else facts.crossJoin(F.broadcast(inside))
    want = [F.col(f"__place{k}") - F.col(f"__below{k}") for k in range(n)]
    out = [(F.floor(w) < 0) | (F.ceil(w) >= F.coalesce(F.col(f"__inside{k}"), F.lit(0))) for k, w in enumerate(want)]
    wrong = out[0]
    for o in out[1:]:
        wrong = F.coalesce(wrong, F.lit(False)) | F.coalesce(o, F.lit(False))
    return not met.where((F.col("__n") > 0) & wrong).isEmpty()


def _interpolated(ranked: DataFrame, facts: DataFrame, names: list[str], keys: tuple[str, ...]) -> DataFrame:
    own = [f"__{k}" for k in keys]
    met = ranked.join(facts, on=_all([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])) if keys else ranked.crossJoin(F.broadcast(facts))
    upto = F.col("__upto") - F.col("__start")
    want = [F.col(f"__place{k}") - F.col(f"__below{k}") for k in range(len(names))]
    value = lambda k, place: F.min(F.when((F.col("__which") == k) & (upto > place), F.col("__v")))
    pairs = met.groupBy(*keys).agg(*[x for k in range(len(names)) for x in (value(k, F.floor(want[k])).alias(f"__a{k}"), value(k, F.ceil(want[k])).alias(f"__z{k}"), F.first(want[k] - F.floor(want[k])).alias(f"__f{k}"))])
    values = [F.when(F.col(f"__f{k}") == 0, F.col(f"__a{k}")).otherwise(F.col(f"__a{k}") + (F.col(f"__z{k}") - F.col(f"__a{k}")) * F.col(f"__f{k}")).alias(name) for k, name in enumerate(names)]
    out = pairs.select(*keys, *values)
    if not keys:
        return out
    # keys whose values are all null
    return facts.select(*[F.col(k).alias(k[2:]) for k in own]).join(out.withColumnsRenamed({k: f"_o{k}" for k in keys}), on=_all([F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys]), how="left").drop(*[f"_o{k}" for k in keys])


def quantiles(df: DataFrame, value: str | Column, at: dict[str, float], *keys: str, small: int = SMALL) -> DataFrame:
    """(keys, a column of each name): exact interpolated quantiles, by key or over all rows as one row."""
    value = F.col(value) if isinstance(value, str) else value
    narrow = staged(df.select(*keys, value.cast("double").alias("__value")), "values")
    if narrow.count() <= small:
        q = F.percentile("__value", F.array(*[F.lit(x) for x in at.values()]))
        return narrow.groupBy(*keys).agg(q.alias("__q")).select(*keys, *[F.col("__q")[k].alias(name) for k, name in enumerate(at)])
    return at_places(narrow, "__value", {name: (q, lambda n, _, q=q: (n - 1) * q) for name, q in at.items()}, *keys)


def kth_largest(df: DataFrame, key: str, value: str, share: float, small: int = SMALL) -> DataFrame:
    """(key, threshold): the k-th largest value of each key, k = max(1, int(rows share)); null where fewer have a value."""
    narrow = staged(df.select(key, F.col(value).alias("__value")), "values")
    k = lambda rows: F.greatest(F.lit(1).cast("long"), F.floor(rows * share))
    if narrow.count() <= small:
        by = W.partitionBy(key)
        ranked = narrow.withColumn("__r", F.row_number().over(by.orderBy(F.desc("__value")))).withColumn("__n", F.count(F.lit(1)).over(by))
        return ranked.where(F.col("__r") == k(F.col("__n"))).select(key, F.col("__value").alias("threshold"))
    return at_places(narrow, "__value", {"threshold": (1 - share, lambda n, rows: F.when(n >= k(rows), (n - k(rows)).cast("double")))}, key)
