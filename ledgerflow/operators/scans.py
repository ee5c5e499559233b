"""Running aggregates by key, over keys of any size: segmented scans over time blocks.

`blocks` deals the rows by ranges of (entity, time, tie) and writes them once with the number of their range, so an entity that holds a third
of the rows lies in many blocks of equal size. A running aggregate is then taken inside each block; what a key brought from its earlier blocks, a
mergeable state a block, is scanned by key and merged in. Keys that stand in one block, nearly all, have nothing to merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.workspace import staged


def blocks(df: DataFrame, entity: str = "cc_num", time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """The rows with a time, in ranges of the entity's order, with their block's number."""
    dealt = df.where(F.col(time).isNotNull()).repartitionByRange(entity, time, tie)
    return staged(dealt.withColumn("__block", F.spark_partition_id()), "blocks")


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)])


def _brought(rows: DataFrame, keys: list[str], states: dict[str, Column], scanned: dict[str, Column]) -> DataFrame:
    """rows with the columns of `scanned`, aggregates over the states of the key's earlier blocks; null where there are none.

    Only keys that stand in several blocks are joined back.
    """
    by = [f"__k{k}" for k in range(len(keys))]
    each = rows.groupBy(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col("__block").alias("__b")).agg(*[c.alias(n) for n, c in states.items()])
    ahead = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    known = each.withColumns({n: c.over(ahead) for n, c in scanned.items()} | {"__at": F.row_number().over(W.partitionBy(*by).orderBy("__b"))})
    known = known.where("__at > 1").select(*by, "__b", *scanned)
    return rows.join(known, _same([*keys, "__block"], [*by, "__b"]), "left").drop(*by, "__b")


def running_count(rows: DataFrame, keys: list[str], out: str, time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """blocks' rows with the number of the key's rows so far, this one included."""
    inside = F.row_number().over(W.partitionBy("__block", *keys).orderBy(time, tie))
    rows = _brought(rows.withColumn("__n", inside.cast("long")), keys, {"__rows": F.count(F.lit(1))}, {"__ahead": F.sum("__rows")})
    return rows.withColumn(out, F.col("__n") + F.coalesce("__ahead", F.lit(0))).drop("__n", "__ahead")


def running_moments(rows: DataFrame, keys: list[str], value: str, prefix: str = "run", time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """blocks' rows with count, sum, mean and squared deviations (cnt, sum, mean, m2) of the key's values so far, this one included.

    The blocks' means are merged as distances from the mean of the key's first block, so that large means don't drown small deviations.
    """
    v = F.col(value).cast("double")
    inside = W.partitionBy("__block", *keys).orderBy(time, tie).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"__n": F.count(v).over(inside), "__s": F.sum(v).over(inside), "__m": F.avg(v).over(inside), "__v": F.var_pop(v).over(inside)})
    by = [f"__k{k}" for k in range(len(keys))]
    each = rows.groupBy(*[F.col(k).alias(b) for k, b in zip(keys, by)], F.col("__block").alias("__b")).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    whole = W.partitionBy(*by).orderBy("__b")
    ahead = whole.rowsBetween(W.unboundedPreceding, -1)
    centre = F.first("m", ignorenulls=True).over(whole.rowsBetween(W.unboundedPreceding, 0))
    each = each.withColumns({"__c": centre, "__at": F.row_number().over(whole)})
    each = each.withColumn("__c", F.first("__c", ignorenulls=True).over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn("__d", F.col("m") - F.col("__c"))
    total = lambda c: F.sum(c).over(ahead)
    known = each.withColumns({"__pn": total("n"), "__ps": total("s"), "__pd": total(F.col("n") * F.col("__d")), "__pq": total(F.col("n") * (F.coalesce("v", F.lit(0.0)) + F.col("__d") * F.col("__d")))})
    known = known.where("__at > 1").select(*by, "__b", "__c", "__pn", "__ps", "__pd", "__pq")
    rows = rows.join(known, _same([*keys, "__block"], [*by, "__b"]), "left").drop(*by, "__b")
    n0, n1 = F.coalesce("__pn", F.lit(0)), F.col("__n")
    zero = F.lit(0.0)
    # the earlier blocks' mean and squares, from their distances
    mean0 = F.col("__c") + F.try_divide("__pd", n0)
    m20 = F.coalesce(F.greatest(zero, F.col("__pq") - F.try_divide(F.col("__pd") * F.col("__pd"), n0)), zero)
    gap = F.col("__m") - mean0
    n = n0 + n1
    merged = {
        "cnt": n, "sum": F.when(n > 0, F.coalesce("__ps", zero) + F.coalesce("__s", zero)), "mean": F.coalesce(mean0 + F.try_divide(gap * n1, n), mean0, F.col("__m")),
        "m2": F.when(n > 0, m20 + n1 * F.coalesce("__v", zero) + F.coalesce(F.try_divide(gap * gap * n0 * n1, n), zero)),
    }
    return rows.withColumns({f"{prefix}_{k}": c for k, c in merged.items()}).drop("__n", "__s", "__m", "__v", "__c", "__pn", "__ps", "__pd", "__pq")


def previous(rows: DataFrame, keys: list[str], value: str, out: str, time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """blocks' rows with the value of the key's previous row, in a struct `out` that is null for the first row."""
    held = F.struct(F.col(value).alias("value"))
    inside = F.lag(held).over(W.partitionBy("__block", *keys).orderBy(time, tie))
    rows = _brought(rows.withColumn("__in", inside), keys, {"__last": F.max_by(held, F.struct(time, tie))}, {"__ahead": F.last("__last")})
    return rows.withColumn(out, F.coalesce("__in", "__ahead")).drop("__in", "__ahead")


def expanding(df: DataFrame, entity: str = "cc_num", amount: str = "amount", time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """Running count, sum, mean, sample deviation and z score by entity, this row included; no deviation counts as 0."""
    rows = running_moments(blocks(df, entity, time, tie), [entity], amount, "run", time, tie)
    std = F.coalesce(F.sqrt(F.try_divide("run_m2", F.col("run_cnt") - 1)), F.lit(0.0))
    rows = rows.withColumn("run_std", std)
    return rows.withColumn("run_z", F.coalesce(F.try_divide(F.col(amount) - F.col("run_mean"), F.col("run_std")), F.lit(0.0))).drop("__block", "run_m2")


def prior_risk(df: DataFrame, entity: str, label: str, default: float = 0.0, time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """The mean label of the entity's earlier rows."""
    rows = running_moments(blocks(df, entity, time, tie), [entity], label, "__run", time, tie)
    own, one = F.coalesce(F.col(label).cast("double"), F.lit(0.0)), F.col(label).isNotNull().cast("long")
    prior = F.try_divide(F.col("__run_sum") - own, F.col("__run_cnt") - one)
    return rows.withColumn("prior_risk", F.coalesce(prior, F.lit(default))).drop("__block", "__run_cnt", "__run_sum", "__run_mean", "__run_m2")


def transitions(df: DataFrame, key: str = "operation_type", entity: str = "cc_num", time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """1 / (earlier moves from the previous key to this one + 1); 0 for the entity's first row."""
    rows = previous(blocks(df, entity, time, tie), [entity], key, "__prev", time, tie)
    rows = running_count(rows.withColumns({"__has": F.col("__prev").isNotNull(), "__from": F.col("__prev.value")}), [entity, "__has", "__from", key], "__moves", time, tie)
    return rows.withColumn("transition_rarity", F.when(F.col("__has"), 1.0 / F.col("__moves")).otherwise(0.0)).drop("__block", "__prev", "__has", "__from", "__moves")


def shares(df: DataFrame, key: str = "merchant_name", entity: str = "cc_num", time: str = "us", tie: str = "transaction_id") -> DataFrame:
    """Share of earlier rows with this key among the entity's rows so far, and rarity of the key."""
    rows = running_count(running_count(blocks(df, entity, time, tie), [entity], "__rows", time, tie), [entity, key], "__same", time, tie)
    return rows.withColumns({"key_ratio": (F.col("__same") - 1) / F.col("__rows"), "key_rarity": 1.0 / F.col("__same")}).drop("__block", "__rows", "__same")
