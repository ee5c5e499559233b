"""Aggregates: frequencies, robust statistics, profiles, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.workspace import staged
from . import quantiles as qs


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def frequency(df: DataFrame, col: str, out: str = "freq") -> DataFrame:
    """Share of the rows by value, null as UNK; fit on the training rows only."""
    counts = df.groupBy(F.coalesce(F.col(col), F.lit("UNK")).alias(col)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(col, (F.col("n") / F.col("total")).alias(out))  # total is one row


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    v = F.col(value)
    moments = df.groupBy(key).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"))
    return by_key(moments, qs.quantiles(df, value, {"median": 0.5, "p90": 0.9, "p99": 0.99}, key), key)


def by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The columns of two tables with one row a key, null a key like others."""
    b = b.withColumnRenamed(key, "__key")
    return a.join(b, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def beside(df: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """df with the columns of facts, one row for each combination of keys, null a key like others.

    In place of a window over whole keys: facts are aggregates, which tasks take of their own rows first, and the join splits a large key's rows.
    """
    named = facts.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return df.join(named, same).drop(*[f"__key_{k}" for k in keys])


def rank_share(df: DataFrame, key: str, value: str, out: str = "rank_share") -> DataFrame:
    """The share of the key's other rows whose value is less (null less than all), from counts of values and running totals: no key in one task."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = staged(qs.running_total(counts, [key, value], "__c", "__upto"), "ranked")
    ends = ranked.groupBy(key).agg(F.min(F.col("__upto") - F.col("__c")).alias("__start"), F.sum("__c").alias("__n"))
    facts = beside(ranked, ends, key).select(key, value, F.coalesce(F.try_divide(F.col("__upto") - F.col("__c") - F.col("__start"), F.col("__n") - 1), F.lit(0.0)).alias(out))
    return beside(df, facts, key, value)


def robust_fit(df: DataFrame, key: str, value: str, cap_at: float = 0.995) -> DataFrame:
    """(key, cap, median, iqr): the statistics are those of the capped values."""
    rows = df.where(F.col(key).isNotNull()).select(key, value)
    caps = qs.quantiles(rows, value, {"cap": cap_at}, key)
    capped = rows.join(caps, key).withColumn("__w", F.when(F.col(value).isNotNull(), F.least(value, "cap")))
    quartiles = qs.quantiles(capped, "__w", {"q1": 0.25, "median": 0.5, "q3": 0.75}, key)
    return caps.join(quartiles, key).select(key, "cap", "median", (F.col("q3") - F.col("q1")).alias("iqr"))


def robust_apply(df: DataFrame, fitted: DataFrame, key: str, value: str) -> DataFrame:
    """df with the capped value and robust z; no spread or an unknown key gives null."""
    out = df.join(fitted, key, "left").withColumn("capped", F.when(F.col(value).isNotNull(), F.least(value, "cap")))
    return out.withColumn("robust_z", F.try_divide(F.col("capped") - F.col("median"), F.nullif("iqr", F.lit(0.0)))).drop("cap", "median", "iqr")


def category_z(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distance from the mean in deviations; no deviation counts as 1."""
    std = F.coalesce(F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1.0))
    facts = df.groupBy(key).agg(F.avg(value).alias("__mean"), std.alias("__std"))
    return beside(df, facts, key).withColumn("category_z", (F.abs(value) - F.col("__mean")) / F.col("__std")).drop("__mean", "__std")


def missingness(df: DataFrame) -> DataFrame:
    """(column, missing) for each column, the emptiest first; one pass."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "missing").orderBy(F.desc("missing"), F.desc("column"))


def profile(df: DataFrame, top: int = 10) -> DataFrame:
    """A row for each column: kind, fill rate, moments, distinct estimate and most frequent values."""
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))

    def stats(c: str) -> Column:
        x = finite(c) if c in numeric else F.lit(None).cast("double")
        return F.struct(F.count(c).alias("filled"), F.count(F.lit(1)).alias("rows"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(c)

    row = df.agg(*[stats(c) for c in df.columns]).unpivot([], df.columns, "column", "s").select("column", "s.*")
    kinds = reduce(lambda a, c: a.when(F.col("column") == c[0], c[1]), df.dtypes, F.when(F.lit(False), ""))
    row = row.withColumn("dtype", kinds).withColumn("fill_rate", F.try_divide("filled", "rows"))
    return row.join(top_values(df, top), "column", "left")


def top_values(df: DataFrame, top: int = 10) -> DataFrame:
    """(column, top_values): the most frequent values of every column, from one unpivot and one count."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "value"))).where(F.col("r") <= top)
    return best.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "count"))), lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias("top_values"))


def label_rate(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.sum(F.col(label).cast("long")).alias("positives"), F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("rate"))


def time_coverage(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def entity_risk(df: DataFrame, entity: str, label: str) -> DataFrame:
    """The entity's mean label over the table; it knows each row's own label."""
    return beside(df, df.groupBy(entity).agg(F.avg(F.col(label).cast("double")).alias("risk")), entity)


def customer_profile(df: DataFrame, entity: str, amount: str, category: str, other: str) -> DataFrame:
    """Mean, deviation, count, distinct others and usual category, rounded to cents."""
    return df.groupBy(entity).agg(F.avg(amount).alias("mean_amount"), F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("std_amount"), F.count(F.lit(1)).alias("n"), F.countDistinct(other).alias("n_other"), F.mode(category, True).alias("usual"))


def banded(df: DataFrame, col: str, value: str, edges: tuple[float, ...] = (0.0, 0.3, 0.6, 1.0)) -> DataFrame:
    """Mean, deviation and count for each band, open below and closed above."""
    band = reduce(lambda a, e: a.when((F.col(col) > e[0]) & (F.col(col) <= e[1]), F.lit(f"({e[0]:g},{e[1]:g}]")), zip(edges, edges[1:]), F.when(F.lit(False), ""))
    return df.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))


def daily_rate(df: DataFrame, time: str, label: str) -> DataFrame:
    """A row a day, days without rows with 0."""
    days = df.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def chain_merchants(df: DataFrame, merchant: str, at: float = 0.9) -> DataFrame:
    """1 where the merchant has as many rows as the row-weighted p90 of the merchants' row counts, or more."""
    counts = df.groupBy(merchant).agg(F.count(F.lit(1)).alias("merchant_rows"))
    edge = counts.agg(F.percentile("merchant_rows", F.lit(at), F.col("merchant_rows")).alias("edge"))  # one row
    return df.join(counts.crossJoin(F.broadcast(edge)), merchant).withColumn("is_chain", (F.col("merchant_rows") >= F.col("edge")).cast("int")).drop("edge")


def drift_snapshot(df: DataFrame, category: str, amount: str) -> DataFrame:
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(amount).isNull().cast("double")).alias("null_rate"))
    return by_key(counts, qs.quantiles(df, amount, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, category), category)


def new_share(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Share of rows whose key the baseline does not have."""
    k = known.select(F.col(key).alias("__k")).distinct()
    return df.join(k, df[key] == k["__k"], "left").agg(F.avg(F.col("__k").isNull().cast("double")).alias("new_share"))


def bucket_of(value: str, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e < F.col(value)))


def psi(base: DataFrame, now: DataFrame, value: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index and KL divergence over the baseline's quantile bins."""
    cuts = {f"e{k}": k / bins for k in range(1, bins)}
    edges = qs.quantiles(base, value, cuts).select(F.array(*cuts).alias("edges"))  # one row
    shares = []
    for name, df in (("b", base), ("c", now)):
        counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(bucket_of(value, F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n").alias("total"))
        shares.append(counts.crossJoin(F.broadcast(total)).select("bin", F.greatest(F.col("n") / F.col("total"), F.lit(floor)).alias(name)))
    both = shares[0].join(shares[1], "bin", "full").na.fill(floor, ["b", "c"])
    return both.agg(F.sum((F.col("c") - F.col("b")) * F.log(F.col("c") / F.col("b"))).alias("psi"), F.sum(F.col("c") * F.log(F.col("c") / F.col("b"))).alias("kl"))


def k_anonymous(df: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Groups below k lose their key values."""
    return beside(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), *keys).withColumns({c: F.when(F.col("__n") >= k, F.col(c)) for c in keys}).drop("__n")


def class_weight(df: DataFrame, label: str, factor: float = 1.0) -> DataFrame:
    ones = F.sum(F.col(label).cast("long"))
    return df.agg((F.lit(factor) * (F.count(F.lit(1)) - ones) / F.greatest(ones, F.lit(1))).alias("pos_weight"))


def histogram(df: DataFrame, value: str, label: str, bins: int = 50) -> DataFrame:
    bin_ = F.least(F.greatest(F.floor(F.col(value) * bins), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(bin_.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))


def latency(df: DataFrame, value: str, limit: float) -> DataFrame:
    row = df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.avg((F.col(value) < limit).cast("double")).alias("under"))
    return row.crossJoin(F.broadcast(qs.quantiles(df, value, {"p95": 0.95}))).select("mean", "p95", "max", "under")  # one row each


def correlations(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "corr").orderBy(F.desc(F.abs("corr")))


def target_encoding(train: DataFrame, key: str, label: str, smooth: float = 10.0) -> DataFrame:
    """(key, encoded): mean label by value, drawn towards the overall mean."""
    overall = train.agg(F.avg(F.col(label).cast("double")).alias("overall"))  # one row
    sums = train.groupBy(key).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.crossJoin(F.broadcast(overall)).select(key, ((F.col("s") + smooth * F.col("overall")) / (F.col("n") + smooth)).alias("encoded"))


def target_encoding_by_fold(folds: DataFrame, key: str, label: str, smooth: float = 10.0) -> DataFrame:
    """folds (fold, part) with `encoded`: the value's mean label among the training rows of its fold, unknown values get the overall mean."""
    train = folds.where("part = 'train'")
    overall = train.groupBy(F.col("fold").alias("__f")).agg(F.avg(F.col(label).cast("double")).alias("__all"))  # one row a fold
    sums = train.groupBy(F.col("fold").alias("__g"), F.col(key).alias("__k")).agg(F.sum(F.col(label).cast("double")).alias("__s"), F.count(F.lit(1)).alias("__n"))
    out = folds.join(overall, F.col("fold") == F.col("__f")).join(sums, (F.col("fold") == F.col("__g")) & F.col(key).eqNullSafe(F.col("__k")), "left")
    encoded = F.coalesce((F.col("__s") + smooth * F.col("__all")) / (F.col("__n") + smooth), F.col("__all"))
    return out.withColumn("encoded", encoded).drop("__f", "__all", "__g", "__k", "__s", "__n")


def iqr_scaled(df: DataFrame, value: str, out: str) -> DataFrame:
    """The value's distance from the median in inter-quartile ranges; no range gives null."""
    q = qs.quantiles(df, value, {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75})
    scaled = F.try_divide(F.col(value) - F.col("__q2"), F.nullif(F.col("__q3") - F.col("__q1"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(q)).withColumn(out, scaled).drop("__q1", "__q2", "__q3")  # one row


def exact_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row: the interpolated quantile, by a bracket from a sketch and an exact rank inside it, whatever the table's size."""
    return qs.quantiles(df, value, {"quantile": q}, small=0)


def top_summary(df: DataFrame, score: str, tie: str, confidence: str, quality: str, n: int = 20) -> DataFrame:
    """One row over the n highest scores: means of confidence and quality, share of low confidence."""
    top = df.orderBy(F.desc(score), tie).limit(n)
    return top.agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(quality).alias("quality"), F.avg((F.col(confidence) < 0.5).cast("double")).alias("low_share"))


def top_categories(df: DataFrame, score: str, tie: str, category: str, n: int = 20) -> DataFrame:
    """(category, n) among the n highest scores."""
    return value_counts(df.orderBy(F.desc(score), tie).limit(n), category)


def attribution_correlations(wide: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, corr) of the attributions of every two features; wide has a column for each."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    both = lambda a, b: F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    row = wide.agg(*[both(a, b).alias(f"{a}|{b}") for a, b in pairs]).unpivot([], [f"{a}|{b}" for a, b in pairs], "key", "corr")
    return row.select(F.split("key", r"\|")[0].alias("a"), F.split("key", r"\|")[1].alias("b"), "corr")
