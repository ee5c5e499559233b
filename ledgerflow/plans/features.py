"""Queries of the point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans, sliding
from ..operators import windows as w
from .views import ORD_SQL, TIES_SQL, TXN_SQL, near, near_sql, over_sql, txn, txn_ties

_H, _D = w.HOUR, w.DAY


def _sql(select: str, view: str = TIES_SQL, more: str = "") -> str:
    return near_sql(f"WITH {view}, {ORD_SQL}{more} {select}")


def _over(units: int, size: int, keys: str = "cc_num") -> str:
    return over_sql(units * size, keys)


def _seq(keys: str = "cc_num") -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY ord)"


def _r(*names: str) -> list:
    return [near(n).alias(n) for n in names]


def txn_velocity(spark, sf_dir):
    df = w.velocity(w.prepared(txn(spark, sf_dir)))
    return df.select("transaction_id", "cnt_1h", "cnt_6h", "cnt_24h", *_r("sum_24h", "mean_24h", "std_24h"))


def velocity_ties(spark, sf_dir):
    df = w.spans(w.prepared(txn_ties(spark, sf_dir)), (24, 168, 720))
    return df.select("transaction_id", *[f"n_{h}h" for h in (24, 168, 720)], *_r(*[f"sum_{h}h" for h in (24, 168, 720)]))


def velocity_running_totals(spark, sf_dir):
    df = w.long_spans(w.prepared(txn_ties(spark, sf_dir)), 90 * w.DAY)
    return df.select("transaction_id", "span_count", near("span_sum", 2).alias("span_sum"))


def velocity_bucketed(spark, sf_dir):
    return w.bucketed(txn_ties(spark, sf_dir), 30 * w.DAY, {"span_count": w.counted(30 * w.DAY)}).select("transaction_id", "span_count")


def features_bucketed(spark, sf_dir):
    """Count, sum, mean, deviation and distinct merchants of 30 days, without an entity in one task."""
    size, month = F.abs("amount"), 30 * w.DAY
    df = w.bucketed(txn_ties(spark, sf_dir), month, {"n_30d": w.counted(month), "sum_30d": w.summed(size, month), "mean_30d": w.averaged(size, month), "std_30d": w.deviation(size, month)})
    df = sliding.over_windows(df, {"uniq_30d": sliding.Distinct("merchant_name", month)})
    return df.select("transaction_id", "n_30d", *[near(c, 2).alias(c) for c in ("sum_30d", "mean_30d", "std_30d")], "uniq_30d")


def sliding_quantiles(spark, sf_dir):
    """Median and 90 % quantile of the amounts of 7 and 30 days."""
    measures = {f"p{round(q * 100)}_{d}d": sliding.Quantile("amount", q, d * w.DAY) for d in (7, 30) for q in (0.5, 0.9)}
    return sliding.over_windows(txn_ties(spark, sf_dir), measures).select("transaction_id", *_r(*measures))


def txn_recency(spark, sf_dir):
    df = w.recency(w.prepared(txn_ties(spark, sf_dir)))
    df = w.since_same(df, "merchant_name", "days_since_merchant", w.DAY)
    df = w.since_same(df, "operation_type", "secs_since_category", 1_000_000)
    return df.select("transaction_id", "secs_since_prev", "days_since_merchant", "secs_since_category")


def merchant_novelty(spark, sf_dir):
    df = w.prepared(txn_ties(spark, sf_dir))
    df = w.first_seen(df, "merchant_name", "new_merchant")
    df = w.seen_within(df, "merchant_name", "merchant_7d", 7 * w.DAY)
    df = w.first_seen(df, "operation_type", "new_category")
    return df.select("transaction_id", "new_merchant", "merchant_7d", "new_category")


def merchant_diversity(spark, sf_dir):
    df = w.diversity(txn_ties(spark, sf_dir))
    return df.select("transaction_id", "uniq_7d", "uniq_30d", *_r("new_share_7d", "new_share_30d"))


def merchant_counts(spark, sf_dir):
    df = w.same_counts(w.prepared(txn_ties(spark, sf_dir)))
    return df.select("transaction_id", "same_7d", "same_30d", "same_prior_7d", "same_prior_30d")


def category_transition(spark, sf_dir):
    return scans.transitions(txn_ties(spark, sf_dir)).select("transaction_id", *_r("transition_rarity"))


def merchant_rarity(spark, sf_dir):
    return scans.shares(txn_ties(spark, sf_dir)).select("transaction_id", *_r("key_ratio", "key_rarity"))


def expanding_zscore(spark, sf_dir):
    df = scans.expanding(txn_ties(spark, sf_dir))
    return df.select("transaction_id", "run_cnt", near("run_sum", 2).alias("run_sum"), near("run_mean", 2).alias("run_mean"), near("run_std", 2).alias("run_std"), near("run_z", 4).alias("run_z"))


def usual_category(spark, sf_dir):
    return w.usual_key(txn_ties(spark, sf_dir)).select("transaction_id", "is_usual")


def merchant_share_long(spark, sf_dir):
    df = w.same_counts(w.prepared(txn_ties(spark, sf_dir)), (30, 90))
    df = w.mean_gap(df, 90)
    for d in (30, 90):
        df = df.withColumn(f"share_{d}d", F.col(f"same_{d}d") / w.counted(d * w.DAY)("cc_num"))
    return df.select("transaction_id", *_r("share_30d", "share_90d", "mean_gap_s"))


def balance_depletion(spark, sf_dir):
    df = w.prepared(txn_ties(spark, sf_dir)).withColumn("balance", F.col("transaction_id") % 1000 + 100.0)
    return w.depletion(df, "balance", 30 * w.DAY).select("transaction_id", *_r("depletion"))


def sudden_large_debit(spark, sf_dir):
    return w.sudden_large(w.prepared(txn_ties(spark, sf_dir)), 1.5, 3).select("transaction_id", "sudden_large")


def just_under_limit(spark, sf_dir):
    return w.repeats_under(w.prepared(txn_ties(spark, sf_dir)), 100_000.0, 0.8, 90 * w.DAY).select("transaction_id", "just_under")


QUERIES = {f.__name__: f for f in (txn_velocity, velocity_ties, velocity_running_totals, velocity_bucketed, features_bucketed, sliding_quantiles, txn_recency, merchant_novelty, merchant_diversity, merchant_counts, category_transition, merchant_rarity, expanding_zscore, usual_category, merchant_share_long, balance_depletion, sudden_large_debit, just_under_limit)}

_PAIR, _TYPE = "cc_num, merchant_name", "cc_num, operation_type"
ORACLE_SQL = {
    "txn_velocity": _sql(f"""SELECT transaction_id, count(*) {_over(1, _H)} AS cnt_1h, count(*) {_over(6, _H)} AS cnt_6h, count(*) {_over(1, _D)} AS cnt_24h, NEAR(sum(abs(amount)) {_over(1, _D)}, 4) AS sum_24h,
  NEAR(avg(abs(amount)) {_over(1, _D)}, 4) AS mean_24h, NEAR(coalesce(stddev_pop(abs(amount)) {_over(1, _D)}, 0), 4) AS std_24h FROM o""", TXN_SQL),
    "velocity_ties": _sql("SELECT transaction_id, " + ", ".join(f"count(*) {_over(h, _H)} AS n_{h}h, NEAR(sum(abs(amount)) {_over(h, _H)}, 4) AS sum_{h}h" for h in (24, 168, 720)) + " FROM o"),
    "velocity_running_totals": _sql(f"SELECT transaction_id, count(*) {_over(90, _D)} AS span_count, NEAR(sum(abs(amount)) {_over(90, _D)}, 2) AS span_sum FROM o"),
    "features_bucketed": _sql(f"SELECT transaction_id, count(*) {_over(30, _D)} AS n_30d, NEAR(sum(abs(amount)) {_over(30, _D)}, 2) AS sum_30d, NEAR(avg(abs(amount)) {_over(30, _D)}, 2) AS mean_30d, NEAR(stddev_pop(abs(amount)) {_over(30, _D)}, 2) AS std_30d, count(DISTINCT merchant_name) {_over(30, _D)} AS uniq_30d FROM o"),
    "sliding_quantiles": _sql("SELECT transaction_id, " + ", ".join(f"NEAR(quantile_cont(amount, {q}) {_over(d, _D)}, 4) AS p{round(q * 100)}_{d}d" for d in (7, 30) for q in (0.5, 0.9)) + " FROM o"),
    "velocity_bucketed": _sql(f"SELECT transaction_id, count(*) {_over(30, _D)} AS span_count FROM o"),
    "txn_recency": _sql(f"""SELECT transaction_id, CAST(floor((us - lag(us) {_seq()}) / 1e6) AS BIGINT) AS secs_since_prev, CAST(floor((us - lag(us) {_seq(_PAIR)}) / 86400e6) AS BIGINT) AS days_since_merchant,
  CAST(floor((us - lag(us) {_seq(_TYPE)}) / 1e6) AS BIGINT) AS secs_since_category FROM o"""),
    "merchant_novelty": _sql(f"""SELECT transaction_id, CAST(row_number() {_seq(_PAIR)} = 1 AS INT) AS new_merchant, coalesce(CAST(us - lag(us) {_seq(_PAIR)} <= {7 * w.DAY} AS INT), 0) AS merchant_7d,
  CAST(row_number() {_seq(_TYPE)} = 1 AS INT) AS new_category FROM o"""),
    "merchant_diversity": _sql(f"""SELECT transaction_id, count(DISTINCT merchant_name) {_over(7, _D)} AS uniq_7d, count(DISTINCT merchant_name) {_over(30, _D)} AS uniq_30d,
  NEAR(avg(is_new) {_over(7, _D)}, 4) AS new_share_7d, NEAR(avg(is_new) {_over(30, _D)}, 4) AS new_share_30d FROM n""", more=f", n AS (SELECT *, CAST(row_number() {_seq(_PAIR)} = 1 AS INT) AS is_new FROM o)"),
    "merchant_counts": _sql("SELECT transaction_id, " + ", ".join(f"count(*) {_over(d, _D, _PAIR)} AS same_{d}d, count(*) {_over(d, _D, _PAIR)} - 1 AS same_prior_{d}d" for d in (7, 30)) + " FROM o"),
    "category_transition": _sql("SELECT transaction_id, NEAR(CASE WHEN k = 1 THEN 0.0 ELSE 1.0 / row_number() OVER (PARTITION BY cc_num, p, operation_type ORDER BY ord) END, 4) AS transition_rarity FROM n", more=f", n AS (SELECT *, lag(operation_type) {_seq()} AS p, row_number() {_seq()} AS k FROM o)"),
    "merchant_rarity": _sql(f"SELECT transaction_id, NEAR((row_number() {_seq(_PAIR)} - 1)::DOUBLE / row_number() {_seq()}, 4) AS key_ratio, NEAR(1.0::DOUBLE / row_number() {_seq(_PAIR)}, 4) AS key_rarity FROM o"),
    "expanding_zscore": _sql("SELECT transaction_id, n AS run_cnt, NEAR(s, 2) AS run_sum, NEAR(m, 2) AS run_mean, NEAR(d, 2) AS run_std, NEAR(coalesce((amount - m) / nullif(d, 0), 0), 4) AS run_z FROM n", more=", n AS (SELECT *, count(*) OVER f AS n, sum(amount) OVER f AS s, avg(amount) OVER f AS m, coalesce(stddev_samp(amount) OVER f, 0) AS d FROM o WINDOW f AS (PARTITION BY cc_num ORDER BY ord ROWS UNBOUNDED PRECEDING))"),
    "usual_category": _sql("SELECT transaction_id, CAST(operation_type = u AS INT) AS is_usual FROM o JOIN k USING (cc_num)", more=", c AS (SELECT cc_num, operation_type AS u, count(*) AS n FROM txn GROUP BY ALL), k AS (SELECT cc_num, u FROM (SELECT *, row_number() OVER (PARTITION BY cc_num ORDER BY n DESC, u) AS r FROM c) WHERE r = 1)"),
    "merchant_share_long": _sql("SELECT transaction_id, " + ", ".join(f"NEAR(count(*) {_over(d, _D, _PAIR)}::DOUBLE / count(*) {_over(d, _D)}, 4) AS share_{d}d" for d in (30, 90)) + f", NEAR((max(us) {_over(90, _D)} - min(us) {_over(90, _D)})::DOUBLE / 1e6 / nullif(count(*) {_over(90, _D)} - 1, 0), 4) AS mean_gap_s FROM o"),
    "balance_depletion": _sql(f"SELECT transaction_id, NEAR(sum(abs(amount)) {_over(30, _D)} / first_value(transaction_id % 1000 + 100.0::DOUBLE) {_over(30, _D)}, 4) AS depletion FROM o"),
    "sudden_large_debit": _sql(f"SELECT transaction_id, CAST(abs(amount) > 1.5 * quantile_cont(abs(amount), 0.5) {_over(30, _D)} AND count(*) {_over(7, _D)} < 3 AS INT) AS sudden_large FROM o"),
    "just_under_limit": _sql(f"SELECT transaction_id, CAST(sum(CAST(amount < 100000 AND amount >= 80000 AS BIGINT)) {_over(90, _D)} AS BIGINT) AS just_under FROM o"),
}
