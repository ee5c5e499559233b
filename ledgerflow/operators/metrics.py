"""Evaluation as DataFrame aggregates. Scores add up by value first, so cumulative sums run over distinct scores only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.workspace import dealt


def by_score(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def curve(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """(keys, score, tp, n, precision, recall) at each distinct score from the top.

    Totals run within each key by ranges of scores: totals inside a range, plus those of the ranges above it.
    """
    counts = by_score(df, score, label, *keys)
    ranged = counts.repartitionByRange(F.desc("score")).withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy(*keys, "__part").agg(F.sum("pos").alias("pp"), F.sum("n").alias("pn"))
    above = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = sums.select(*keys, "__part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("op"), F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("on"), F.sum("pp").over(whole).alias("all_pos"), F.sum("pn").over(whole).alias("all_n"))
    inside = W.partitionBy(*keys, "__part").orderBy(F.desc("score"))
    out = ranged.withColumn("tp", F.sum("pos").over(inside)).withColumn("upto", F.sum("n").over(inside)).join(offsets, [*keys, "__part"])  # adaptive execution knows their size
    out = out.withColumn("tp", F.col("tp") + F.col("op")).withColumn("upto", F.col("upto") + F.col("on"))
    return out.select(*keys, "score", "pos", F.col("n"), "tp", "upto", (F.col("tp") / F.col("upto")).alias("precision"), F.try_divide("tp", "all_pos").alias("recall"), "all_pos", "all_n")


def average_precision(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Sum over distinct scores of the rise in recall times precision."""
    c = curve(df, score, label, *keys)
    return c.groupBy(*keys).agg(F.sum(F.col("precision") * F.try_divide("pos", "all_pos")).alias("ap"))


def roc_auc(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """Rank sum, ties with average ranks."""
    c = curve(df, score, label, *keys)
    negatives_below = (F.col("all_n") - F.col("all_pos")) - (F.col("upto") - F.col("tp"))
    wins = F.col("pos") * (negatives_below + (F.col("n") - F.col("pos")) / 2)
    return c.groupBy(*keys).agg(F.try_divide(F.sum(wins), F.max("all_pos") * (F.max("all_n") - F.max("all_pos"))).alias("auc"))


def precision_at(df: DataFrame, score: str, label: str, share: float, tie: str) -> DataFrame:
    """Precision among the k = max(1, int(n share)) highest scores, ties by id."""
    k = max(1, int(df.count() * share))
    return df.orderBy(F.desc(score), tie).limit(k).agg(F.count(F.lit(1)).alias("k"), F.avg(F.col(label).cast("double")).alias("precision"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """One row: alerts and their precision; a key without a threshold never alerts, no alerts give 0."""
    found = df.join(thresholds, key, "left").withColumn("alert", F.coalesce(F.col(score) >= F.col("threshold"), F.lit(False)))
    return found.agg(F.sum(F.col("alert").cast("long")).alias("alerts"), F.coalesce(F.avg(F.when(F.col("alert"), F.col(label).cast("double"))), F.lit(0.0)).alias("precision"))


def confusion(df: DataFrame, score: str, label: str, cuts: list[float], fn_cost: float = 100.0, fp_cost: float = 1.0) -> DataFrame:
    """A row for each threshold (score > threshold): counts, rates and costs; one pass over the rows."""
    hit = lambda t, y: F.sum(((F.col(score) > t) & (F.col(label) == y)).cast("long"))
    row = df.agg(*[hit(t, y).alias(f"{n}{k}") for k, t in enumerate(cuts) for n, y in (("tp", 1), ("fp", 0))], F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q"))
    out = row.select("p", "q", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k, t in enumerate(cuts)])).alias("x")).select("x.*", "p", "q")
    out = out.withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("q") - F.col("fp")})
    out = out.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)), "fpr": F.coalesce(F.try_divide("fp", "q"), F.lit(0.0))})
    out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return out.withColumns({"cost": F.col("fn") * fn_cost + F.col("fp") * fp_cost, "savings": F.col("tp") * fn_cost - F.col("fp") * fp_cost}).drop("p", "q")


def best_threshold(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("threshold", F.struct("savings", -F.col("threshold"))).alias("threshold"), F.max("savings").alias("savings"))


def ndcg(df: DataFrame, session: str, relevance: str, score: str, k: int) -> DataFrame:
    """Mean over sessions of at least k items; linear gain, log2 discount, tied scores share their discounts, nothing relevant gives 0."""
    by = W.partitionBy(session)
    df = dealt(df.select(session, relevance, score), session, rows=1 << 19)  # every window sorts a task's rows anew
    df = df.withColumn("__n", F.count(F.lit(1)).over(by)).where(F.col("__n") >= k)
    discount = lambda r: F.when(r <= k, 1.0 / F.log2(r + 1.0)).otherwise(0.0)
    place = F.row_number().over(by.orderBy(F.desc(score)))
    df = df.withColumn("__d", discount(place)).withColumn("__d", F.avg("__d").over(W.partitionBy(session, score)))
    df = df.withColumn("__i", discount(F.row_number().over(by.orderBy(F.desc(relevance)))))
    each = df.groupBy(session).agg(F.coalesce(F.try_divide(F.sum(F.col(relevance) * F.col("__d")), F.sum(F.col(relevance) * F.col("__i"))), F.lit(0.0)).alias("ndcg"))
    return each.agg(F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("sessions"))


def session_metrics(df: DataFrame, session: str, relevant: str, score: str, tie: str, value: str, k: int = 10) -> DataFrame:
    """MAP, MRR, recall at k and the expected value of the first item, averaged over sessions."""
    by = W.partitionBy(session).orderBy(F.desc(score), tie)
    r = df.withColumn("__r", F.row_number().over(by)).withColumn("__h", F.sum(relevant).over(by.rowsBetween(W.unboundedPreceding, 0)))
    each = r.groupBy(session).agg(F.sum(F.when(F.col(relevant) == 1, F.col("__h") / F.col("__r"))).alias("s"), F.sum(relevant).alias("n"), F.min(F.when(F.col(relevant) == 1, F.col("__r"))).alias("first"), F.sum(F.when(F.col("__r") <= k, F.col(relevant))).alias("top"), F.max(F.when(F.col("__r") == 1, F.col(value) * F.col(relevant))).alias("value"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.agg(F.avg(zero(F.try_divide("s", "n"))).alias("map"), F.avg(zero(F.try_divide(F.lit(1.0), F.col("first")))).alias("mrr"), F.avg(zero(F.try_divide("top", "n"))).alias("recall"), F.avg("value").alias("value"))


def group_correlation(df: DataFrame, session: str, a: str, b: str, groups: int | None = None) -> DataFrame:
    """The mean correlation over the groups: all of them, or the first few where `groups` is given."""
    if groups is not None:
        df = df.join(df.select(session).distinct().orderBy(session).limit(groups), session, "left_semi")
    return df.groupBy(session).agg(F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).alias("c")).agg(F.avg("c").alias("mean_corr"))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, value, passed): metrics (metric, value) against limits (metric, least, most), null as no bound."""
    return limits.join(metrics, "metric", "left").select("metric", "value", F.coalesce((F.col("value") >= F.coalesce("least", F.lit(float("-inf")))) & (F.col("value") <= F.coalesce("most", F.lit(float("inf")))), F.lit(False)).alias("passed"))


def operating_cost(rate: float, daily: int = 10_000, each: float = 2.5) -> tuple[int, float]:
    alerts = int(rate * daily)
    return alerts, alerts * each


def alert_cost(df: DataFrame, alert: Column, daily: int = 10_000, each: float = 2.5) -> DataFrame:
    """One row: alerts a day at the alert rate of df, and their cost."""
    row = df.agg(F.floor(F.avg(alert.cast("double")) * daily).alias("daily_alerts"))
    return row.withColumn("cost", F.col("daily_alerts") * F.lit(each))


def lift_table(metrics: DataFrame, name: str, base: str, columns: list[str], needed: dict[str, float]) -> DataFrame:
    """Each candidate's mean metrics less those of the base, and whether one rises by what is needed; metrics: (name, fold, columns)."""
    mean = metrics.groupBy(name).agg(*[F.avg(c).alias(c) for c in columns])
    own = mean.where(F.col(name) == base).select(*[F.col(c).alias(f"__{c}") for c in columns])  # one row
    out = mean.where(F.col(name) != base).crossJoin(F.broadcast(own)).withColumns({f"lift_{c}": F.col(c) - F.col(f"__{c}") for c in columns})
    take = F.lit(False)
    for c, least in needed.items():
        take = take | (F.col(f"lift_{c}") >= least)
    return out.withColumn("take", take).drop(*[f"__{c}" for c in columns])


def rule_quality(df: DataFrame, rules: list[str], label: str) -> DataFrame:
    """(rule, hits, precision, recall) of 0/1 rule columns."""
    long = df.unpivot([label], rules, "rule", "hit")
    hit = F.col("hit") == 1
    positive = F.col(label) == 1
    return long.groupBy("rule").agg(F.sum(hit.cast("long")).alias("hits"), F.coalesce(F.avg(F.when(hit, F.col(label).cast("double"))), F.lit(0.0)).alias("precision"), F.coalesce(F.avg(F.when(positive, hit.cast("double"))), F.lit(0.0)).alias("recall"))


def quality_checks(df: DataFrame, checks: dict) -> DataFrame:
    """(check, value) of named aggregates, all in one pass."""
    return df.agg(*[c.cast("double").alias(n) for n, c in checks.items()]).unpivot([], list(checks), "check", "value")


def snapshot_id(df: DataFrame, time: str, content: list[Column]) -> DataFrame:
    """Time range, rows and a content hash that does not depend on their order: the sum of the first 48 bits of each row's MD5, nulls marked."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in content])
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(h).alias("content"))
