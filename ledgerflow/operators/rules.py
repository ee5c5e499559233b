"""Rules, thresholds and alert decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def quantile_row(df: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row with a column for each quantile."""
    return quantiles(df, value, at)


def with_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row table; an aggregate without keys is one row at any scale."""
    return df.crossJoin(F.broadcast(row))


def weighted(rules: dict[str, tuple[float, Column]]) -> dict[str, Column]:
    """A 0/1 column for each rule and their weighted sum rule_score."""
    flags = {name: F.coalesce(hit.cast("int"), F.lit(0)) for name, (_, hit) in rules.items()}
    score = reduce(lambda a, b: a + b, [F.lit(weight) * flags[name] for name, (weight, _) in rules.items()])
    return flags | {"rule_score": score}


def rules_a(df: DataFrame, amount: str = "abs_amount") -> DataFrame:
    """Needs is_new_merchant, cnt_1h and amount_z; quantiles are those of df."""
    df = with_one_row(df, quantile_row(df, amount, {"p995": 0.995, "p999": 0.999}))
    a = F.col(amount)
    return df.withColumns(weighted({"rule_extreme": (2.0, a >= F.col("p999")), "rule_high": (1.5, a >= F.col("p995")), "rule_new_high": (1.0, (F.col("is_new_merchant") == 1) & (a >= F.col("p995"))), "rule_rapid": (0.5, F.col("cnt_1h") >= 5), "rule_z3": (1.5, F.col("amount_z") >= 3.0)}))


def rules_b(df: DataFrame, fitted: DataFrame, amount: str = "abs_amount") -> DataFrame:
    """fitted: one row with p995, from training rows or stored."""
    df = with_one_row(df, fitted)
    a = F.col(amount)
    return df.withColumns(weighted({"rule_high": (1.5, a >= F.col("p995")), "rule_new_high": (1.0, (F.col("is_new_merchant") == 1) & (a >= F.col("p995"))), "rule_rapid": (0.5, F.col("cnt_24h") >= 10)}))


def rules_c(df: DataFrame, fitted: DataFrame, amount: str = "abs_amount") -> DataFrame:
    df = with_one_row(df, fitted)
    return df.withColumns(weighted({"rule_high": (1.0, F.col(amount) >= F.col("p995")), "rule_new": (0.5, F.col("is_new_merchant") == 1)}))


def tau(df: DataFrame, score: str, rate: float) -> DataFrame:
    """One row, tau: the score quantile of an alert rate; not positive, that of the positive scores, and without these a stricter one."""
    s = F.col(score)
    row = quantiles(df, s, {"all": 1 - rate, "strict": 1 - min(rate / 2, 0.001)})
    row = with_one_row(row, quantiles(df.where(s > 0), s, {"positive": 1 - rate}))
    return row.select(F.when(F.col("all") > 0, F.col("all")).otherwise(F.coalesce("positive", "strict")).alias("tau"))


def tau_per_category(df: DataFrame, score: str, category: str, rate: float, least: int = 50, stored: DataFrame | None = None) -> DataFrame:
    """(category, tau_category) of categories with enough rows; stored thresholds win, values that are not positive become the global one."""
    rows = df.where(F.col(category).isNotNull())
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    own = counts.join(quantiles(rows, score, {"own": 1 - rate}, category), category)
    own = with_one_row(own, tau(df, score, rate)).select(category, F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("tau")).alias("tau_category"))
    if stored is None:
        return own
    return stored.select(category, "tau_category").unionByName(own.join(stored, category, "left_anti"))


def hybrid(df: DataFrame, score: str, category: str, rate: float) -> DataFrame:
    """anomaly_alert by category threshold, and the decision over rules and scores; needs rule_score."""
    df = with_one_row(df.join(tau_per_category(df, score, category, rate), category, "left"), tau(df, score, rate))
    alert = (F.col(score) >= F.coalesce("tau_category", "tau")).cast("int")
    df = df.withColumn("anomaly_alert", alert)
    final = (F.col("rule_score") >= 2) | (F.col("anomaly_alert") == 1) | ((F.col("rule_score") > 0) & (F.col(score) >= F.col("tau") * 0.9))
    return df.withColumn("final_alert", F.coalesce(final, F.lit(False)).cast("int"))


def capped(alerts: DataFrame, entity: str, day: str, merchant: str, order: list[Column], per_merchant: int = 2, per_day: int = 3) -> DataFrame:
    """The first alerts of each (entity, day, merchant), then of each (entity, day); a null merchant counts as one."""
    alerts = alerts.withColumn("__m", F.coalesce(F.col(merchant), F.lit("UNK")))
    first = alerts.withColumn("__r", F.row_number().over(W.partitionBy(entity, day, "__m").orderBy(*order))).where(F.col("__r") <= per_merchant)
    return first.withColumn("__r", F.row_number().over(W.partitionBy(entity, day).orderBy(*order))).where(F.col("__r") <= per_day).drop("__r", "__m")


def safety_net(p: Column, anomaly: Column, tau1: float, tau2: float) -> Column:
    return ((p > tau1) | (anomaly > tau2)).cast("int")


def risk_level(p: Column) -> Column:
    return F.when(p > 0.7, "HIGH").when(p > 0.3, "MEDIUM").otherwise("LOW")


def reason(p: Column, conditions: dict[str, Column]) -> Column:
    """The texts of the conditions that hold; fixed texts for low risk and for none."""
    held = F.concat_ws("; ", *[F.when(c, F.lit(text)) for text, c in conditions.items()])
    return F.when(p < 0.1, "Low risk - normal transaction pattern").otherwise(F.when(held == "", "Multiple risk factors detected").otherwise(held))


def concentration(alerts: DataFrame, key: str) -> DataFrame:
    """Share of the alerts by key."""
    n = alerts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return with_one_row(n, n.agg(F.sum("n").alias("total"))).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def shadow(a: DataFrame, b: DataFrame, key: str, score: str, cut: float, shift: float = 0.2, rate_change: float = 0.1) -> DataFrame:
    """One row that compares two models on the same rows, with flags for a large shift."""
    both = a.select(key, F.col(score).alias("a")).join(b.select(key, F.col(score).alias("b")), key)
    stats = both.agg(*[f.alias(f"{n}_{x}") for x in "ab" for n, f in (("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("rate", F.avg((F.col(x) >= cut).cast("double"))))])
    for x in "ab":
        stats = with_one_row(stats, quantiles(both, x, {f"p99_{x}": 0.99}))
    change = lambda n: F.abs(F.coalesce(F.try_divide(F.col(f"{n}_b") - F.col(f"{n}_a"), F.abs(f"{n}_a")), F.lit(0.0)))
    moved = F.greatest(change("mean"), change("std"), change("p99")) > shift
    return stats.withColumn("score_shift", moved.cast("int")).withColumn("rate_shift", (change("rate") > rate_change).cast("int"))


def descriptor_rules(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(text).rlike(p).cast("int"), F.lit(0)) for name, p in patterns.items()})


def alert_summary(scored: DataFrame, alert: str, category: str) -> DataFrame:
    """By category and, with a null category, over all."""
    return scored.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.sum(alert).alias("alerts"), F.avg(F.col(alert).cast("double")).alias("rate"))
