"""Orders, splits, samples and set operations over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_share
from . import quantiles


def global_index(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """Row numbers from 0 in a total order, without a window over all rows.

    Rows are dealt by range; numbers inside a partition get the offset of the partitions before it. The sorted rows are written
    once (checkpoint), as the offsets must be those of the same partitions.
    """
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).checkpoint()
    counts = part.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    inside = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return part.withColumn("__i", inside).join(F.broadcast(offsets.select("__p", "before")), "__p").withColumn(out, F.col("__i") + F.col("before")).drop("__p", "__i", "before")


def chrono_split(df: DataFrame, *order: str, train: float = 0.8, calibrate: float = 0.1) -> DataFrame:
    """part: train, calibrate (the last of the training rows) or test, by place in time."""
    df = global_index(df, *order)
    n = df.count()
    cut = int(n * train)
    held = cut - int(cut * calibrate)
    return df.withColumn("part", F.when(F.col("idx") < held, "train").when(F.col("idx") < cut, "calibrate").otherwise("test"))


def expanding_folds(df: DataFrame, *order: str, cuts: tuple[tuple[float, float], ...] = ((0.6, 0.8), (0.8, 1.0))) -> DataFrame:
    """A row for each fold that takes it: (fold, part) with all before the first cut for training, up to the second for testing."""
    df = global_index(df, *order)
    n = df.count()
    folds = []
    for k, (a, b) in enumerate(cuts):
        a, b = int(n * a), int(n * b)
        folds.append(df.where(F.col("idx") < b).withColumn("fold", F.lit(k)).withColumn("part", F.when(F.col("idx") < a, "train").otherwise("test")))
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    return out


def time_quantile_split(df: DataFrame, time: str, at: float = 0.85) -> DataFrame:
    cut = quantiles.quantiles(df, time, {"__cut": at})  # one row
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(time) < F.col("__cut"), "train").otherwise("test")).drop("__cut")


def key_split(df: DataFrame, key: str, test: float = 0.2, salt: str = "split") -> DataFrame:
    """Whole groups go to one side, by a hash of their key."""
    return df.withColumn("part", F.when(hash_share(F.col(key), salt) < test, "test").otherwise("train"))


def traffic(df: DataFrame, key: str, share: float, salt: str) -> DataFrame:
    return df.withColumn("treated", (hash_share(F.col(key), salt) < share).cast("int"))


def stratified(df: DataFrame, label: str, shares: dict, key: str, salt: str = "strata") -> DataFrame:
    """A share of the rows of each label, drawn by a hash of their key, so that reruns agree; labels without a share give none."""
    share = F.coalesce(*[F.when(F.col(label) == value, F.lit(float(p))) for value, p in shares.items()], F.lit(0.0))
    return df.where(hash_share(F.col(key), salt) < share)


def cap_per_key(df: DataFrame, key: str, n: int, tie: str, salt: str = "cap") -> DataFrame:
    """At most n rows of a key, the first by hash."""
    w = W.partitionBy(key).orderBy(hash_share(F.col(tie), salt), tie)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def kth_largest(df: DataFrame, key: str, value: str, share: float, tie: str | None = None) -> DataFrame:
    """(key, threshold): the k-th largest value, k = max(1, int(n share)). Ties have one value, so their order doesn't matter."""
    return quantiles.kth_largest(df, key, value, share)


def best_row(df: DataFrame, key: str, by: str, *cols: str) -> DataFrame:
    """(key, cols): the row with a key's largest value of by; of equal values the one that is largest by cols, in their order. A key without values gets nulls."""
    row = F.struct(*cols)
    return df.groupBy(key).agg(F.max_by(row, F.when(F.col(by).isNotNull(), F.struct(F.col(by), row))).alias("b")).select(key, "b.*")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the first of the order; every task keeps its own first row of a key before they meet."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__r") == 1).drop("__r")


def with_support(df: DataFrame, key: str, least: int) -> DataFrame:
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return df.join(keys, key, "left_semi")


def segments(df: DataFrame, key: str, top: int = 4) -> DataFrame:
    """segment: the key for its most frequent values, OTHER for the rest."""
    best = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), key).limit(top).select(F.col(key).alias("__k"))
    return df.join(F.broadcast(best), df[key] == F.col("__k"), "left").withColumn("segment", F.coalesce("__k", F.lit("OTHER"))).drop("__k")  # at most `top` rows


def legit_below(df: DataFrame, label: str, amount: str, at: float = 0.995) -> DataFrame:
    """Legitimate rows under the amount quantile of the legitimate ones."""
    legit = df.where(F.col(label) == 0)
    cut = quantiles.quantiles(legit, amount, {"__cut": at})  # one row
    return legit.crossJoin(F.broadcast(cut)).where(F.col(amount) < F.col("__cut")).drop("__cut")


def label_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Codes from 0 in the order of the distinct values; a null has none."""
    codes = global_index(df.select(F.col(col).alias("__v")).where(F.col(col).isNotNull()).distinct(), "__v", out=out)  # one row a value, by ranges
    return df.join(codes, df[col] == codes["__v"], "left").drop("__v")


def leaks(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(column, pattern, n): the string values that match a pattern."""
    strings = [c for c, t in df.dtypes if t == "string"]
    counts = [F.sum(F.coalesce(F.col(c).rlike(p), F.lit(False)).cast("long")).alias(f"{c}|{name}") for c in strings for name, p in patterns.items()]
    names = [f"{c}|{name}" for c in strings for name in patterns]
    long = df.agg(*counts).unpivot([], names, "key", "n")
    return long.select(F.split("key", r"\|")[0].alias("column"), F.split("key", r"\|")[1].alias("pattern"), F.coalesce("n", F.lit(0)).alias("n"))
