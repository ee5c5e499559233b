"""Queries of rules, alerts, splits, top-k and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import metrics as m
from ..operators import rules as ru
from ..operators import select as se
from ..operators import stats as st
from ..operators import windows as w
from .views import ORD_SQL, TIES_SQL, TXN_SQL, near, near_sql, over_sql, read, txn, txn_ties

_DAY = 86_400_000_000


def _n(*names: str, places: int = 4) -> list:
    return [near(n, places).alias(n) for n in names]


def _features(df):
    df = w.first_seen(w.velocity(w.prepared(df)), "merchant_name", "is_new_merchant").withColumn("abs_amount", F.abs("amount"))
    stats = df.groupBy("cc_num").agg(F.avg("abs_amount").alias("mean"), F.stddev_samp("abs_amount").alias("std"))
    df = df.join(stats, "cc_num", "left")
    return df.withColumn("amount_z", s.guarded_z(F.col("abs_amount"), F.col("mean"), F.col("std"), None)).withColumn("day", F.floor(F.col("us") / _DAY))


def _score():
    return (F.col("transaction_id") * 7919 % 1000) / 1000.0


def _scored(spark, sf_dir):
    return txn_ties(spark, sf_dir).withColumn("score", _score())


def rule_alerts_capped(spark, sf_dir):
    """Which transactions does the rule engine alert on, at most three per card per day?"""
    scored = ru.rules_a(_features(txn(spark, sf_dir)))
    alerts = ru.capped(scored.where("rule_score >= 2"), "cc_num", "day", "merchant_name", [F.desc("rule_score"), F.col("transaction_id")])
    return alerts.select("transaction_id", "cc_num", "day", "merchant_name", *_n("abs_amount"), "rule_score")


def rules_b_scores(spark, sf_dir):
    df = _features(txn_ties(spark, sf_dir))
    fitted = ru.quantile_row(df.where("transaction_id % 5 <> 0"), "abs_amount", {"p995": 0.995})
    return ru.rules_b(df, fitted).select("transaction_id", "rule_score")


def rules_c_scores(spark, sf_dir):
    df = _features(txn_ties(spark, sf_dir))
    fitted = ru.quantile_row(df, "abs_amount", {"p995": 0.995})
    return ru.rules_c(df, fitted).select("transaction_id", "rule_score")


def tau_per_category(spark, sf_dir):
    return ru.tau_per_category(_scored(spark, sf_dir), "score", "operation_type", 0.02).select("operation_type", *_n("tau_category", places=6))


def tau_global(spark, sf_dir):
    return ru.tau(_scored(spark, sf_dir).withColumn("score", F.col("score") - 0.995), "score", 0.02).select(*_n("tau", places=6))


def hybrid_alert(spark, sf_dir):
    df = _scored(spark, sf_dir).withColumn("rule_score", (F.col("transaction_id") % 9) / 4.0)
    return ru.hybrid(df, "score", "operation_type", 0.02).select("transaction_id", "anomaly_alert", "final_alert")


def alert_summary(spark, sf_dir):
    df = _scored(spark, sf_dir).withColumn("alert", (F.col("score") >= 0.98).cast("long"))
    return ru.alert_summary(df, "alert", "operation_type").select(F.coalesce("operation_type", F.lit("ALL")).alias("operation_type"), "n", "alerts", *_n("rate", places=6))


def alert_concentration(spark, sf_dir):
    return ru.concentration(_scored(spark, sf_dir).where("score >= 0.98"), "merchant_name").select("merchant_name", "n", *_n("share", places=6))


def decision_reasons(spark, sf_dir):
    p = F.col("score")
    why = {"Unusually high transaction amount": F.col("amount") > 200_000, "High-risk merchant category": F.col("operation_type").startswith("1"), "New account": F.col("cc_num") < 10}
    return _scored(spark, sf_dir).select("transaction_id", (p > 0.5).alias("blocked"), ru.risk_level(p).alias("risk"), ru.reason(p, why).alias("reason"), ru.safety_net(p, F.col("amount"), 0.9, 250_000.0).alias("safety"))


def shadow_comparison(spark, sf_dir):
    a = _scored(spark, sf_dir)
    return ru.shadow(a, a.withColumn("score", F.col("score") * F.col("score")), "transaction_id", "score", 0.9).select(*_n(*[f"{n}_{x}" for x in "ab" for n in ("mean", "std", "p99", "rate")], places=5), "score_shift", "rate_shift")


def descriptor_rules(spark, sf_dir):
    df = read(spark, sf_dir, "part")
    return ru.descriptor_rules(df, "p_type", {"metal": "(?i)brass|steel|copper", "size": "^SMALL|^LARGE"}).groupBy("metal", "size").agg(F.count(F.lit(1)).alias("n"))


def profile_features(spark, sf_dir):
    """Features of later rows from the profile of earlier ones; customers without a profile get defaults."""
    df = txn_ties(spark, sf_dir)
    # every row is profile, up to the middle of the time span, or scored, after it
    df = ru.with_one_row(df, df.agg(F.floor((F.min("us") + F.max("us")) / 2).alias("middle")))
    return _profiled(df.where("us <= middle"), df.where("us > middle"))


def _profiled(earlier, later):
    p = st.customer_profile(earlier, "cc_num", "amount", "operation_type", "merchant_name")
    out = later.join(p, "cc_num", "left")
    z = s.guarded_z(F.col("amount"), F.col("mean_amount"), F.col("std_amount"))
    return out.select("transaction_id", near(z).alias("z"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce((F.col("usual") == F.col("operation_type")).cast("int"), F.lit(0)).alias("usual"))


def chrono_split(spark, sf_dir):
    return se.chrono_split(txn_ties(spark, sf_dir), "us", "transaction_id").select("transaction_id", "idx", "part")


def expanding_folds(spark, sf_dir):
    df = se.expanding_folds(txn_ties(spark, sf_dir), "us", "transaction_id")
    return df.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last"))


def time_quantile_split(spark, sf_dir):
    return se.time_quantile_split(txn_ties(spark, sf_dir), "us").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def session_split(spark, sf_dir):
    return se.key_split(read(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "part")


def hash_split(spark, sf_dir):
    return se.traffic(txn_ties(spark, sf_dir), "cc_num", 0.05, "exp1").select("transaction_id", "treated")


def seeded_flags(spark, sf_dir):
    k = F.col("transaction_id")
    return txn_ties(spark, sf_dir).select("transaction_id", s.bernoulli(k, "site", 0.4).alias("site"), s.categorical(k, "sources", {1: 0.3, 2: 0.5, 3: 0.2}).alias("sources"))


def cap_per_entity(spark, sf_dir):
    return se.cap_per_key(txn_ties(spark, sf_dir), "cc_num", 20, "transaction_id").select("transaction_id", "cc_num")


def top_scores(spark, sf_dir):
    return se.top_n(_scored(spark, sf_dir), 20, F.desc("score"), "transaction_id").select("transaction_id", "score")


def best_order(spark, sf_dir):
    """Each customer's order of the highest price; of equal prices the one with the largest order key."""
    return se.best_row(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", "o_orderpriority")


def dedupe(spark, sf_dir):
    return se.latest(read(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


def category_thresholds(spark, sf_dir):
    return se.kth_largest(_scored(spark, sf_dir), "operation_type", "score", 0.01, "transaction_id")


def threshold_eval(spark, sf_dir):
    df = _scored(spark, sf_dir)
    t = se.kth_largest(df.where("transaction_id % 2 = 0"), "operation_type", "score", 0.01, "transaction_id")
    return m.apply_thresholds(df.where("transaction_id % 2 = 1"), t, "operation_type", "score", "is_fraud").select("alerts", *_n("precision", places=6))


def minimum_support(spark, sf_dir):
    return se.with_support(txn_ties(spark, sf_dir), "merchant_name", 406).groupBy("merchant_name").agg(F.count(F.lit(1)).alias("n"))


def segment_membership(spark, sf_dir):
    return se.segments(txn_ties(spark, sf_dir), "merchant_name").groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def contamination_guard(spark, sf_dir):
    return se.legit_below(txn_ties(spark, sf_dir), "is_fraud", "amount").agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("top"))


def union_sources(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("dataset"), F.col("c_custkey").alias("id"), "c_mktsegment")
    b = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("dataset"), F.col("s_suppkey").alias("id"), "s_acctbal")
    return a.unionByName(b, allowMissingColumns=True)


def set_difference(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")).distinct(), "k", "left_anti")


def avg_precision(spark, sf_dir):
    return m.average_precision(_scored(spark, sf_dir), "score", "is_fraud").select(*_n("ap", places=6))


def avg_precision_by_category(spark, sf_dir):
    return m.average_precision(_scored(spark, sf_dir), "score", "is_fraud", "operation_type").select("operation_type", *_n("ap", places=6))


def pr_curve(spark, sf_dir):
    return m.curve(_scored(spark, sf_dir), "score", "is_fraud").select("score", "tp", F.col("upto").alias("n"), *_n("precision", "recall", places=6))


def roc_auc(spark, sf_dir):
    return m.roc_auc(_scored(spark, sf_dir), "score", "is_fraud").select(*_n("auc", places=6))


def precision_at_k(spark, sf_dir):
    return m.precision_at(_scored(spark, sf_dir), "score", "is_fraud", 0.01, "transaction_id").select("k", *_n("precision", places=6))


def cost_curve(spark, sf_dir):
    t = m.confusion(_scored(spark, sf_dir), "score", "is_fraud", [0.1, 0.3, 0.5, 0.7, 0.9])
    return t.select("threshold", "tp", "fp", "fn", "tn", *_n("precision", "recall", "fpr", "f1", places=6), "cost", "savings")


def best_threshold(spark, sf_dir):
    return m.best_threshold(m.confusion(_scored(spark, sf_dir), "score", "is_fraud", [0.1, 0.3, 0.5, 0.7, 0.9]))


def _sessions(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("item"), s.relevance(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").alias("rel"), F.floor(F.col("l_quantity") / 10).alias("score"), F.struct("l_quantity", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax").alias("tie"), "l_quantity")


def ndcg(spark, sf_dir):
    return m.ndcg(_sessions(spark, sf_dir), "session", "rel", "score", 3).select(*_n("ndcg", places=6), "sessions")


def position_ctr(spark, sf_dir):
    from pyspark.sql import Window as W

    df = _sessions(spark, sf_dir).withColumn("position", F.row_number().over(W.partitionBy("session").orderBy("tie")))
    ctr = df.groupBy("position").agg(F.sum((F.col("rel") >= 1).cast("long")).alias("clicks"), F.count(F.lit(1)).alias("n"))
    return ctr.select("position", "clicks", "n", near(s.propensity_weight(F.try_divide("clicks", "n")), 6).alias("ipw"))


def session_metrics(spark, sf_dir):
    df = _sessions(spark, sf_dir).withColumn("relevant", (F.col("rel") == 3).cast("int"))
    return m.session_metrics(df, "session", "relevant", "score", "tie", "l_quantity", 2).select(*_n("map", "mrr", "recall", "value", places=6))


def group_correlation(spark, sf_dir):
    return m.group_correlation(_sessions(spark, sf_dir), "session", "rel", "l_quantity").select(*_n("mean_corr", places=5))


def quality_gates(spark, sf_dir):
    df = _scored(spark, sf_dir)
    auc = m.roc_auc(df, "score", "is_fraud").select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    ap = m.average_precision(df, "score", "is_fraud").select(F.lit("ap"), F.col("ap"))
    limits = spark.createDataFrame([("auc", 0.4, 0.6), ("ap", 0.5, None), ("none", 0.1, None)], "metric string, least double, most double")
    return m.gates(auc.union(ap), limits).select("metric", near("value", 6).alias("value"), "passed")


def operating_cost(spark, sf_dir):
    return m.alert_cost(_scored(spark, sf_dir), F.col("score") >= 0.98)


def rule_quality(spark, sf_dir):
    df = txn_ties(spark, sf_dir).withColumns({"r1": (F.col("amount") > 200_000).cast("int"), "r2": (F.col("transaction_id") % 8 == 0).cast("int")})
    return m.rule_quality(df, ["r1", "r2"], "is_fraud").select("rule", "hits", *_n("precision", "recall", places=6))


def quality_checks(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    return m.quality_checks(df, {"rows": F.count(F.lit(1)), "null_price": F.avg(F.col("o_totalprice").isNull().cast("double")), "negative": F.sum((F.col("o_totalprice") < 0).cast("int")), "bad_status": F.sum((~F.col("o_orderstatus").isin("F", "O", "P")).cast("int"))})


def snapshot(spark, sf_dir):
    content = [F.col(c) for c in ("transaction_id", "cc_num", "operation_type", "merchant_name", "is_fraud", "us")] + [F.floor(F.col("amount") * 100 + 0.37)]
    return m.snapshot_id(txn(spark, sf_dir), "us", content).select("first", "last", "n", F.col("content").cast("string").alias("content"))


def validity_flags(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    now, opened = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1993-01-01").cast("timestamp_ntz")
    flags = s.validity_flags(F.col("o_totalprice") - 1000, F.col("o_orderdate").cast("timestamp_ntz"), now, opened)
    return df.withColumns(flags).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def metric_lift(spark, sf_dir):
    """Lift of candidate features over the baseline, and whether to take them."""
    df = _scored(spark, sf_dir)
    rows = [df.where(f"transaction_id % 4 <> {k}").agg(F.lit(name).alias("candidate"), F.avg("score").alias("p1"), F.avg(F.col("score") * F.col("score")).alias("p2")) for name, k in (("baseline", 9), ("a", 0), ("b", 1))]
    out = m.lift_table(rows[0].unionByName(rows[1]).unionByName(rows[2]), "candidate", "baseline", ["p1", "p2"], {"p1": 0.01, "p2": 0.02})
    return out.withColumnsRenamed({"lift_p1": "lift1", "lift_p2": "lift2"}).select("candidate", *_n("lift1", "lift2", places=6), "take")


QUERIES = {f.__name__: f for f in (rule_alerts_capped, rules_b_scores, rules_c_scores, tau_per_category, tau_global, hybrid_alert, alert_summary, alert_concentration, decision_reasons, shadow_comparison, descriptor_rules, profile_features, chrono_split, expanding_folds, time_quantile_split, session_split, hash_split, seeded_flags, cap_per_entity, top_scores, best_order, dedupe, category_thresholds, threshold_eval, minimum_support, segment_membership, contamination_guard, union_sources, set_difference, avg_precision, avg_precision_by_category, pr_curve, roc_auc, precision_at_k, cost_curve, best_threshold, ndcg, position_ctr, session_metrics, group_correlation, quality_gates, operating_cost, rule_quality, quality_checks, snapshot, validity_flags, metric_lift)}

_ORD = ORD_SQL
_FEATURES = f"""f AS (SELECT *, abs(amount) AS a, floor(us / {_DAY}.0)::BIGINT AS day, CAST(row_number() OVER (PARTITION BY cc_num, merchant_name ORDER BY ord) = 1 AS INT) AS is_new,
 count(*) {over_sql(w.HOUR)} AS h1, count(*) {over_sql(w.DAY)} AS h24,
 avg(abs(amount)) OVER (PARTITION BY cc_num) AS mu, nullif(stddev_samp(abs(amount)) OVER (PARTITION BY cc_num), 0) AS sd FROM o)"""
_S = f"WITH {TIES_SQL}, x AS (SELECT *, (transaction_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM txn)"
_H = lambda key, salt: f"(('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_AP = "g AS (SELECT {k} score, sum(is_fraud) AS pos, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT *, sum(pos) OVER ({p} ORDER BY score DESC) AS tp, sum(n) OVER ({p} ORDER BY score DESC) AS upto, sum(pos) OVER ({p}) AS ap, sum(n) OVER ({p}) AS an FROM g)"
_AP0 = _AP.format(k="", p="")
_SESSION = "s AS (SELECT l_orderkey AS session, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END AS rel, CAST(floor(l_quantity / 10) AS BIGINT) AS score, l_quantity, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax FROM lineitem)"
_TIE = "l_quantity, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax"
ORACLE_SQL = {name: near_sql(sql) for name, sql in {
    "rule_alerts_capped": f"""WITH {TXN_SQL}, {_ORD}, {_FEATURES}, q AS (SELECT quantile_cont(a, 0.995) AS q1, quantile_cont(a, 0.999) AS q2 FROM f),
 r AS (SELECT f.*, CAST(a >= q2 AS INT) * 2.0::DOUBLE + CAST(a >= q1 AS INT) * 1.5::DOUBLE + CAST(is_new = 1 AND a >= q1 AS INT) + CAST(h1 >= 5 AS INT) * 0.5::DOUBLE + coalesce(CAST((a - mu) / sd >= 3 AS INT), 0) * 1.5::DOUBLE AS rule_score FROM f, q),
 c AS (SELECT *, row_number() OVER (PARTITION BY cc_num, day, merchant_name ORDER BY rule_score DESC, transaction_id) AS k FROM r WHERE rule_score >= 2), d AS (SELECT *, row_number() OVER (PARTITION BY cc_num, day ORDER BY rule_score DESC, transaction_id) AS j FROM c WHERE k <= 2)
 SELECT transaction_id, cc_num, day, merchant_name, NEAR(a, 4) AS abs_amount, rule_score FROM d WHERE j <= 3""",
    "rules_b_scores": f"WITH {TIES_SQL}, {_ORD}, {_FEATURES}, q AS (SELECT quantile_cont(a, 0.995) AS q1 FROM f WHERE transaction_id % 5 <> 0) SELECT transaction_id, CAST(a >= q1 AS INT) * 1.5::DOUBLE + CAST(is_new = 1 AND a >= q1 AS INT) + CAST(h24 >= 10 AS INT) * 0.5::DOUBLE AS rule_score FROM f, q",
    "rules_c_scores": f"WITH {TIES_SQL}, {_ORD}, {_FEATURES}, q AS (SELECT quantile_cont(a, 0.995) AS q1 FROM f) SELECT transaction_id, CAST(a >= q1 AS INT) + is_new * 0.5::DOUBLE AS rule_score FROM f, q",
    "tau_per_category": f"{_S} SELECT operation_type, NEAR(quantile_cont(score, 0.98), 6) AS tau_category FROM x GROUP BY 1 HAVING count(*) >= 50",
    "tau_global": f"{_S} SELECT NEAR(quantile_cont(score - 0.995, 0.98), 6) AS tau FROM x WHERE score - 0.995 > 0",
    "hybrid_alert": f"{_S}, g AS (SELECT quantile_cont(score, 0.98) AS tau FROM x), c AS (SELECT operation_type, quantile_cont(score, 0.98) AS tc FROM x GROUP BY 1) SELECT transaction_id, CAST(score >= tc AS INT) AS anomaly_alert, CAST(transaction_id % 9 / 4.0 >= 2 OR score >= tc OR (transaction_id % 9 > 0 AND score >= tau * 0.9::DOUBLE) AS INT) AS final_alert FROM x JOIN c USING (operation_type), g",
    "alert_summary": f"{_S} SELECT coalesce(operation_type, 'ALL') AS operation_type, count(*) AS n, CAST(sum(CAST(score >= 0.98 AS INT)) AS BIGINT) AS alerts, NEAR(avg(CAST(score >= 0.98 AS INT)), 6) AS rate FROM x GROUP BY ROLLUP (operation_type)",
    "alert_concentration": f"{_S} SELECT merchant_name, count(*) AS n, NEAR(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM x WHERE score >= 0.98 GROUP BY 1",
    "decision_reasons": f"{_S} SELECT transaction_id, score > 0.5 AS blocked, CASE WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN score < 0.1 THEN 'Low risk - normal transaction pattern' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN amount > 200000 THEN 'Unusually high transaction amount' END, CASE WHEN operation_type LIKE '1%' THEN 'High-risk merchant category' END, CASE WHEN cc_num < 10 THEN 'New account' END), ''), 'Multiple risk factors detected') END AS reason, CAST(score > 0.9 OR amount > 250000 AS INT) AS safety FROM x",
    "shadow_comparison": f"{_S}, y AS (SELECT score AS a, score * score AS b FROM x), z AS (SELECT " + ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}, quantile_cont({c}, 0.99) AS p99_{c}, avg(CAST({c} >= 0.9 AS INT)) AS rate_{c}" for c in "ab") + " FROM y) SELECT " + ", ".join(f"NEAR({n}_{c}, 5) AS {n}_{c}" for c in "ab" for n in ("mean", "std", "p99", "rate")) + ", CAST(greatest(abs(mean_b - mean_a) / abs(mean_a), abs(std_b - std_a) / abs(std_a), abs(p99_b - p99_a) / abs(p99_a)) > 0.2 AS INT) AS score_shift, CAST(abs(rate_b - rate_a) / rate_a > 0.1 AS INT) AS rate_shift FROM z",
    "descriptor_rules": "SELECT CAST(regexp_matches(p_type, '(?i)brass|steel|copper') AS INT) AS metal, CAST(regexp_matches(p_type, '^SMALL|^LARGE') AS INT) AS size, count(*) AS n FROM part GROUP BY 1, 2",
    "profile_features": f"WITH {TIES_SQL}, b AS (SELECT * FROM txn WHERE us <= (SELECT (min(us) + max(us)) // 2 FROM txn)), p AS (SELECT cc_num, avg(amount) AS mu, coalesce(stddev_samp(amount), 0) AS sd, count(*) AS n FROM b GROUP BY 1), u AS (SELECT cc_num, operation_type AS usual FROM (SELECT cc_num, operation_type, row_number() OVER (PARTITION BY cc_num ORDER BY count(*) DESC, operation_type) AS r FROM b GROUP BY 1, 2) WHERE r = 1) SELECT transaction_id, NEAR(coalesce((amount - mu) / nullif(sd, 0), 0), 4) AS z, coalesce(n, 0) AS n, coalesce(CAST(usual = operation_type AS INT), 0) AS usual FROM txn LEFT JOIN p USING (cc_num) LEFT JOIN u USING (cc_num) WHERE us > (SELECT (min(us) + max(us)) // 2 FROM txn)",
    "chrono_split": f"WITH {TIES_SQL}, i AS (SELECT transaction_id, row_number() OVER (ORDER BY us, transaction_id) - 1 AS idx, count(*) OVER () AS n FROM txn), c AS (SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS cut FROM i) SELECT transaction_id, idx, CASE WHEN idx < cut - floor(cut * 0.1::DOUBLE) THEN 'train' WHEN idx < cut THEN 'calibrate' ELSE 'test' END AS part FROM c",
    "expanding_folds": f"WITH {TIES_SQL}, i AS (SELECT us, row_number() OVER (ORDER BY us, transaction_id) - 1 AS idx, count(*) OVER () AS n FROM txn), f(fold, a, b) AS (VALUES (0, 0.6::DOUBLE, 0.8::DOUBLE), (1, 0.8::DOUBLE, 1.0::DOUBLE)) SELECT fold, CASE WHEN idx < floor(n * a) THEN 'train' ELSE 'test' END AS part, count(*) AS n, max(us) AS last FROM i, f WHERE idx < floor(n * b) GROUP BY 1, 2",
    "time_quantile_split": f"WITH {TIES_SQL} SELECT CASE WHEN us < (SELECT quantile_cont(us::DOUBLE, 0.85) FROM txn) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM txn GROUP BY 1",
    "session_split": f"SELECT o_orderkey, CASE WHEN {_H('o_custkey', 'split')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders",
    "hash_split": f"WITH {TIES_SQL} SELECT transaction_id, CAST({_H('cc_num', 'exp1')} < 0.05 AS INT) AS treated FROM txn",
    "seeded_flags": f"WITH {TIES_SQL} SELECT transaction_id, CAST({_H('transaction_id', 'site')} < 0.4 AS INT) AS site, CASE WHEN {_H('transaction_id', 'sources')} < 0.3 THEN 1 WHEN {_H('transaction_id', 'sources')} < 0.8 THEN 2 ELSE 3 END AS sources FROM txn",
    "cap_per_entity": f"WITH {TIES_SQL} SELECT transaction_id, cc_num FROM (SELECT *, row_number() OVER (PARTITION BY cc_num ORDER BY {_H('transaction_id', 'cap')}, transaction_id) AS r FROM txn) WHERE r <= 20",
    "top_scores": f"{_S} SELECT transaction_id, score FROM x ORDER BY score DESC, transaction_id LIMIT 20",
    "best_order": "SELECT o_custkey, b.o_orderkey, b.o_orderpriority FROM (SELECT o_custkey, arg_max({'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority}, (o_totalprice, o_orderkey, o_orderpriority)) FILTER (o_totalprice IS NOT NULL) AS b FROM orders GROUP BY 1)",
    "dedupe": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "category_thresholds": f"{_S} SELECT operation_type, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY operation_type ORDER BY score DESC, transaction_id) AS r, greatest(1, floor(count(*) OVER (PARTITION BY operation_type) * 0.01::DOUBLE)) AS k FROM x) WHERE r = k",
    "threshold_eval": f"{_S}, t AS (SELECT operation_type, score AS t FROM (SELECT *, row_number() OVER (PARTITION BY operation_type ORDER BY score DESC, transaction_id) AS r, greatest(1, floor(count(*) OVER (PARTITION BY operation_type) * 0.01::DOUBLE)) AS k FROM x WHERE transaction_id % 2 = 0) WHERE r = k) SELECT count(*) FILTER (score >= t) AS alerts, NEAR(coalesce(avg(is_fraud) FILTER (score >= t), 0), 6) AS precision FROM x LEFT JOIN t USING (operation_type) WHERE transaction_id % 2 = 1",
    "minimum_support": f"WITH {TIES_SQL} SELECT merchant_name, count(*) AS n FROM txn GROUP BY 1 HAVING count(*) >= 406",
    "segment_membership": f"WITH {TIES_SQL}, k AS (SELECT merchant_name FROM txn GROUP BY 1 ORDER BY count(*) DESC, merchant_name LIMIT 4) SELECT coalesce(k.merchant_name, 'OTHER') AS segment, count(*) AS n FROM txn LEFT JOIN k ON txn.merchant_name = k.merchant_name GROUP BY 1",
    "contamination_guard": f"WITH {TIES_SQL}, l AS (SELECT * FROM txn WHERE is_fraud = 0) SELECT count(*) AS n, max(amount) AS top FROM l WHERE amount < (SELECT quantile_cont(amount, 0.995) FROM l)",
    "union_sources": "SELECT 'customer' AS dataset, c_custkey AS id, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier",
    "set_difference": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "avg_precision": f"{_S}, {_AP0} SELECT NEAR(sum(tp::DOUBLE / upto * pos / ap), 6) AS ap FROM c",
    "avg_precision_by_category": f"{_S}, {_AP.format(k='operation_type,', p='PARTITION BY operation_type')} SELECT operation_type, NEAR(sum(tp::DOUBLE / upto * pos / ap), 6) AS ap FROM c GROUP BY 1",
    "pr_curve": f"{_S}, {_AP0} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(upto AS BIGINT) AS n, NEAR(tp::DOUBLE / upto, 6) AS precision, NEAR(tp::DOUBLE / ap, 6) AS recall FROM c",
    "roc_auc": f"{_S}, r AS (SELECT is_fraud, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM x) SELECT NEAR((sum(r) FILTER (is_fraud = 1) - sum(is_fraud) * (sum(is_fraud) + 1) / 2.0::DOUBLE) / (sum(is_fraud) * (count(*) - sum(is_fraud)))::DOUBLE, 6) AS auc FROM r",
    "precision_at_k": f"{_S}, t AS (SELECT is_fraud FROM x ORDER BY score DESC, transaction_id LIMIT (SELECT greatest(1, floor(count(*) * 0.01::DOUBLE)::BIGINT) FROM x)) SELECT count(*) AS k, NEAR(avg(is_fraud), 6) AS precision FROM t",
    "cost_curve": f"""{_S}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (score > threshold AND is_fraud = 1) AS tp, count(*) FILTER (score > threshold AND is_fraud = 0) AS fp, count(*) FILTER (score <= threshold AND is_fraud = 1) AS fn, count(*) FILTER (score <= threshold AND is_fraud = 0) AS tn FROM x, t GROUP BY 1), d AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c)
 SELECT threshold, tp, fp, fn, tn, NEAR(p, 6) AS precision, NEAR(r, 6) AS recall, NEAR(fp::DOUBLE / (fp + tn), 6) AS fpr, NEAR(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, fn * 100.0::DOUBLE + fp AS cost, tp * 100.0::DOUBLE - fp AS savings FROM d""",
    "best_threshold": f"{_S}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, sum(CASE WHEN is_fraud = 1 THEN 100.0::DOUBLE ELSE -1 END) AS savings FROM x, t WHERE score > threshold GROUP BY 1) SELECT threshold, savings FROM c ORDER BY savings DESC, threshold LIMIT 1",
    "ndcg": f"""WITH {_SESSION}, a AS (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY score DESC) AS p, row_number() OVER (PARTITION BY session ORDER BY rel DESC) AS i FROM s), b AS (SELECT *, CASE WHEN p <= 3 THEN 1 / log2(p + 1.0) ELSE 0 END AS d0, CASE WHEN i <= 3 THEN 1 / log2(i + 1.0) ELSE 0 END AS di FROM a WHERE n >= 3), c AS (SELECT *, avg(d0) OVER (PARTITION BY session, score) AS d FROM b), e AS (SELECT session, coalesce(sum(rel * d) / nullif(sum(rel * di), 0), 0) AS v FROM c GROUP BY 1) SELECT NEAR(avg(v), 6) AS ndcg, count(*) AS sessions FROM e""",
    "position_ctr": f"WITH {_SESSION}, p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {_TIE}) AS position FROM s) SELECT CAST(position AS INT) AS position, CAST(sum(CAST(rel >= 1 AS INT)) AS BIGINT) AS clicks, count(*) AS n, NEAR(coalesce(count(*)::DOUBLE / nullif(sum(CAST(rel >= 1 AS INT)), 0), 1), 6) AS ipw FROM p GROUP BY 1",
    "session_metrics": f"""WITH {_SESSION}, a AS (SELECT *, CAST(rel = 3 AS INT) AS y, row_number() OVER (PARTITION BY session ORDER BY score DESC, {_TIE}) AS r FROM s), b AS (SELECT *, sum(y) OVER (PARTITION BY session ORDER BY r) AS h FROM a), c AS (SELECT session, coalesce(sum(h::DOUBLE / r) FILTER (y = 1) / nullif(sum(y), 0), 0) AS ap, coalesce(1.0::DOUBLE / min(r) FILTER (y = 1), 0) AS rr, coalesce(sum(y) FILTER (r <= 2)::DOUBLE / nullif(sum(y), 0), 0) AS rec, max(l_quantity * y) FILTER (r = 1) AS v FROM b GROUP BY 1) SELECT NEAR(avg(ap), 6) AS map, NEAR(avg(rr), 6) AS mrr, NEAR(avg(rec), 6) AS recall, NEAR(avg(v), 6) AS value FROM c""",
    "group_correlation": f"WITH {_SESSION}, c AS (SELECT covar_pop(rel, l_quantity) / nullif(stddev_pop(rel) * stddev_pop(l_quantity), 0) AS c FROM s GROUP BY session) SELECT NEAR(avg(c), 5) AS mean_corr FROM c",
    "quality_gates": f"{_S}, {_AP0}, v AS (SELECT sum(tp::DOUBLE / upto * pos / ap) AS a FROM c), r AS (SELECT is_fraud, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM x), u AS (SELECT (sum(r) FILTER (is_fraud = 1) - sum(is_fraud) * (sum(is_fraud) + 1) / 2.0::DOUBLE) / (sum(is_fraud) * (count(*) - sum(is_fraud)))::DOUBLE AS a FROM r) SELECT 'auc' AS metric, NEAR(a, 6) AS value, a BETWEEN 0.4 AND 0.6 AS passed FROM u UNION ALL SELECT 'ap', NEAR(a, 6), a >= 0.5 FROM v UNION ALL SELECT 'none', NULL, false",
    "operating_cost": f"{_S} SELECT CAST(floor(avg(CAST(score >= 0.98 AS INT)) * 10000) AS BIGINT) AS daily_alerts, floor(avg(CAST(score >= 0.98 AS INT)) * 10000) * 2.5::DOUBLE AS cost FROM x",
    "rule_quality": f"WITH {TIES_SQL}, r AS (SELECT 'r1' AS rule, CAST(amount > 200000 AS INT) AS hit, is_fraud FROM txn UNION ALL SELECT 'r2', CAST(transaction_id % 8 = 0 AS INT), is_fraud FROM txn) SELECT rule, CAST(sum(hit) AS BIGINT) AS hits, NEAR(coalesce(avg(is_fraud) FILTER (hit = 1), 0), 6) AS precision, NEAR(coalesce(avg(hit) FILTER (is_fraud = 1), 0), 6) AS recall FROM r GROUP BY 1",
    "quality_checks": "SELECT 'rows' AS \"check\", count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'null_price', avg(CAST(o_totalprice IS NULL AS INT)) FROM orders UNION ALL SELECT 'negative', sum(CAST(o_totalprice < 0 AS INT))::DOUBLE FROM orders UNION ALL SELECT 'bad_status', sum(CAST(o_orderstatus NOT IN ('F', 'O', 'P') AS INT))::DOUBLE FROM orders",
    "snapshot": f"WITH {TXN_SQL} SELECT min(us) AS first, max(us) AS last, count(*) AS n, CAST(sum(('0x' || substr(md5(concat_ws('|', transaction_id, cc_num, coalesce(operation_type, '\\N'), coalesce(merchant_name, '\\N'), is_fraud, us, coalesce(CAST(CAST(floor(amount * 100 + 0.37::DOUBLE) AS BIGINT) AS VARCHAR), '\\N'))), 1, 12))::BIGINT) AS VARCHAR) AS content FROM txn",
    "validity_flags": "SELECT CAST(o_totalprice - 1000 < 0 AS INT) AS neg_amount, CAST(o_orderdate > TIMESTAMP '1998-01-01' + INTERVAL 90 DAY AS INT) AS future, CAST(o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 730 DAY OR o_orderdate < TIMESTAMP '1993-01-01' AS INT) AS stale, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "metric_lift": f"{_S}, b AS (SELECT avg(score) AS p1, avg(score * score) AS p2 FROM x), t AS (SELECT 'a' AS candidate, avg(score) AS q1, avg(score * score) AS q2 FROM x WHERE transaction_id % 4 <> 0 UNION ALL SELECT 'b', avg(score), avg(score * score) FROM x WHERE transaction_id % 4 <> 1) SELECT candidate, NEAR(q1 - p1, 6) AS lift1, NEAR(q2 - p2, 6) AS lift2, q1 - p1 >= 0.01 OR q2 - p2 >= 0.02 AS take FROM t, b",
}.items()}
#: Names that queries over whole tables had beside others over a part.
_ALSO = ("ndcg", "position_ctr", "session_metrics", "group_correlation", "profile_features")
QUERIES |= {f"{name}_all": QUERIES[name] for name in _ALSO}
ORACLE_SQL |= {f"{name}_all": ORACLE_SQL[name] for name in _ALSO}
