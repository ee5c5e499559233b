"""Statistics of the last days that are added to, not computed anew: a stored table of mergeable daily states.

A day's state is small: of each key and value bracket the count, the sum and the squared deviations. Brackets grow by a fixed ratio, so a quantile read
off them is off by at most the relative accuracy that was asked for, at any number of rows; counts, means and deviations are exact. States of any
days merge by addition, in any order, so a refresh reads the rows of the new day and the states of the others. A day that
runs again replaces its own state.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.workspace import removed

#: Relative error of a quantile, at most.
ACCURACY = 0.005
STATE = "key string, bracket int, n long, total double, squares double"


def bracket(value: Column, accuracy: float = ACCURACY) -> Column:
    """The number of a value's bracket, negative below 0: brackets end at powers of (1 + accuracy) / (1 - accuracy), and 0 is one of its own."""
    ratio, size = log((1 + accuracy) / (1 - accuracy)), F.abs(value)
    # magnitudes from 1e-9 on count from 1
    at = F.greatest(F.ceil(F.log(size) / F.lit(ratio)) + int(-log(1e-9) / ratio) + 1, F.lit(1).cast("long"))
    return F.when(value == 0, 0).otherwise(F.signum(value).cast("int") * at.cast("int")).cast("int")


def bracket_value(number: Column, accuracy: float = ACCURACY) -> Column:
    """The value that is within the accuracy of all values of a bracket."""
    growth = (1 + accuracy) / (1 - accuracy)
    at = F.abs(number) - int(-log(1e-9) / log(growth)) - 1
    return F.when(number == 0, 0.0).otherwise(F.signum(number) * 2 * F.pow(F.lit(growth), at) / (growth + 1))


def state_of(df: DataFrame, key: str, value: str, accuracy: float = ACCURACY) -> DataFrame:
    """The state of df's rows, one row for each key and bracket; null values don't count, a null key is a key."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(F.col(key).cast("string").alias("key"), bracket(v, accuracy).alias("bracket")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), (F.var_pop(v) * F.count(F.lit(1))).alias("squares"))


def merged(states: DataFrame) -> DataFrame:
    """States of several days as one."""
    sums = states.groupBy("key", "bracket").agg(F.sum("n").alias("__n"), F.sum("total").alias("__t"))
    met = states.join(sums.withColumnsRenamed({"key": "__key", "bracket": "__b"}), F.col("key").eqNullSafe(F.col("__key")) & (F.col("bracket") == F.col("__b")))
    gap = F.col("total") / F.col("n") - F.col("__t") / F.col("__n")
    return met.groupBy("key", "bracket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("squares") + F.col("n") * gap * gap).alias("squares"))


def figures(state: DataFrame, quantiles: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """(key, n, mean, std, a column of each quantile) of a merged state: the lower value at a quantile's place, within the accuracy."""
    whole = state.groupBy(F.col("key").alias("__key")).agg(F.sum("n").alias("__n"), (F.sum("total") / F.sum("n")).alias("__mean"))  # a row a key
    met = state.join(whole, F.col("key").eqNullSafe(F.col("__key"))).withColumn("__upto", F.sum("n").over(W.partitionBy("key").orderBy("bracket")))  # a row a bracket
    gap = F.col("total") / F.col("n") - F.col("__mean")
    at = {name: F.min(F.when(F.col("__upto") > F.floor((F.col("__n") - 1) * q), F.col("bracket"))) for name, q in quantiles.items()}
    found = met.groupBy("key").agg(F.first("__n").alias("n"), F.first("__mean").alias("mean"), F.sum(F.col("squares") + F.col("n") * gap * gap).alias("__squares"), *[c.alias(f"__{name}") for name, c in at.items()])
    std = F.coalesce(F.sqrt(F.try_divide("__squares", F.col("n") - 1)), F.lit(0.0))
    return found.select("key", "n", "mean", std.alias("std"), *[bracket_value(F.col(f"__{name}"), accuracy).alias(name) for name in quantiles])


class DailyStates:
    """A folder of daily states, day=N for each day number, which refreshes add to and age out."""

    def __init__(self, spark: SparkSession, path: str, days: int = 90, accuracy: float = ACCURACY):
        self.spark, self.path, self.days, self.accuracy = spark, path, days, accuracy

    def load(self, df: DataFrame, key: str, value: str, day: str) -> None:
        """The states of many days at once, for a first load; day: a column of day numbers. Days that df holds are replaced."""
        v = F.col(value).cast("double")
        rows = df.where(v.isNotNull() & ~F.isnan(v) & F.col(day).isNotNull())
        states = rows.groupBy(F.col(day).cast("long").alias("day"), F.col(key).cast("string").alias("key"), bracket(v, self.accuracy).alias("bracket")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), (F.var_pop(v) * F.count(F.lit(1))).alias("squares"))
        states.repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def refresh(self, rows: DataFrame, key: str, value: str, day: int) -> DataFrame:
        """Add a day, whose rows are given and alone are read; returns the merged state of the days up to it. Days that have aged out are removed."""
        state_of(rows, key, value, self.accuracy).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/day={day}")
        for old in self.known():
            if old <= day - self.days:
                removed(self.spark, f"{self.path}/day={old}")
        return merged(self.between(day - self.days, day))

    def known(self) -> list[int]:
        """The days that have a state: names of folders."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(hadoop)] if files.exists(hadoop) else []
        return sorted(int(n[4:]) for n in names if n.startswith("day="))

    def between(self, after: int, upto: int) -> DataFrame:
        """The states of the days after `after`, up to `upto`; only their folders are read."""
        return self.spark.read.schema(f"{STATE}, day long").parquet(self.path).where((F.col("day") > after) & (F.col("day") <= upto)).drop("day")
