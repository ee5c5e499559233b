"""Queries of proxies, sources, samples, encodings by fold, candidate features, variants and ranked catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import joins as j
from ..operators import models, ranking
from ..operators import select as se
from ..operators import stats as st
from ..operators import windows as w
from ..sources import dictionary, sinks
from ..sources.workspace import dealt
from .decisions import _H
from .features import _seq, _sql
from .modelling import COLUMNS, _table
from .views import TIES_SQL, micros, near, near_sql, read, txn_ties

_LEAKS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", "card": "[0-9]{13,19}", "id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}
_SPELLED = ("UK", " usa ", "Deutschland", "fr", "Spain")
_FAMILIES = (("adult",), ("adult", "child"), ("adult", "child", "senior"))


def _one_of(values, key):
    return F.element_at(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def payment_proxies(spark, sf_dir):
    """Proxies, array lengths, fixed maps, tags, event times and countries of each order."""
    k = F.col("o_orderkey")
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", _one_of(_SPELLED, k).alias("spelled"))
    df = s.canonical_type(df, s.synonyms(spark, s.COUNTRIES), "spelled", "country")
    found = s.tags(F.when(k % 6 != 0, F.concat(F.lit('["a","t'), k % 3, F.lit('"]'))))
    return df.select(
        "o_orderkey", s.merchant_proxy(F.when(k % 3 == 0, F.concat(F.lit("mail"), k % 5)), F.when(k % 2 == 0, F.lit("visa"))).alias("merchant"), s.card_proxy(F.when(k % 4 != 0, k)).alias("card"),
        s.array_length(F.when(k % 5 != 0, F.sequence(F.lit(0).cast("long"), k % 4))).alias("n_items"), s.fixed_map(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2}, 9).alias("priority"),
        F.size(found).alias("n_tags"), F.element_at(F.concat(found, F.array(F.lit("none"))), F.greatest(F.size(found), F.lit(1))).alias("last_tag"), s.event_time_of(F.when(k % 7 == 0, k), F.when(k % 2 == 0, k + 1), k + 2).alias("event_time"), "country",
    )


def first_country(spark, sf_dir):
    df = txn_ties(spark, sf_dir).withColumn("country", F.concat(F.lit("C"), F.col("transaction_id") % 7))
    return w.first_seen(w.prepared(df), "country", "first_country").select("transaction_id", "first_country")


def redact_signals(spark, sf_dir):
    cols = s.redact_with_signals(F.coalesce("text", F.lit("")), {"has_at": "@", "has_digits": "[0-9]{4}"})
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()])


def plan_extras(spark, sf_dir):
    k = F.col("p_partkey")
    fit = s.family_fit(_one_of(_FAMILIES, k), _one_of(_FAMILIES, F.floor(k / 3)))
    return read(spark, sf_dir, "part").select("p_partkey", near(s.deductible_ratio(F.col("p_size") * 100, F.col("p_retailprice")), 6).alias("deductible_ratio"), ranking.switching(k % 2 == 0, k % 5, k % 3).alias("switching"), near(fit, 6).alias("family_fit"))


def eligible_plans(spark, sf_dir):
    plans = read(spark, sf_dir, "part").withColumn("codes", F.array(F.col("p_partkey") % 5, F.col("p_partkey") % 7))
    return ranking.eligible(plans, F.lit(3).cast("long"), "codes", "p_retailprice", F.lit(1200.0)).select("p_partkey", "p_retailprice")


def recent_runs(spark, sf_dir):
    """The ten newest runs; the limit is the feature."""
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("date").alias("started"))
    return sinks.recent_runs(runs).select("run_id", F.col("started").cast("string").alias("started"))


def stratified_sample(spark, sf_dir):
    return se.stratified(read(spark, sf_dir, "orders"), "o_orderstatus", {"F": 0.2, "O": 0.05}, "o_orderkey").select("o_orderkey", "o_orderstatus")


def attribution_pairs(spark, sf_dir):
    df = st.attribution_correlations(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return df.select("a", "b", near("corr", 6).alias("corr"))


def _raw_card(spark, sf_dir):
    k = F.col("o_orderkey")
    amount = F.when(k % 10 == 0, "bad").otherwise(F.col("o_totalprice").cast("string"))
    return read(spark, sf_dir, "orders").select(k.cast("string").alias("trans_num"), amount.alias("amt"), (k % 2).cast("string").alias("is_fraud"), F.floor(micros("o_orderdate") / 1_000_000).cast("string").alias("unix_time"))


def harmonised_card(spark, sf_dir):
    df = dictionary.detect_and_harmonise(_raw_card(spark, sf_dir), "card")
    return df.select("transaction_id", near("amount", 2).alias("amount"), "is_fraud", "event_time_ts")


def cast_failures(spark, sf_dir):
    raw = _raw_card(spark, sf_dir)
    named = raw.select(F.col("trans_num").alias("transaction_id"), F.col("amt").alias("amount"), F.col("unix_time").alias("event_time_ts"))
    return dictionary.cast_failures(named, dictionary.detect_and_harmonise(raw, "card"), "transaction_id")


def leak_check(spark, sf_dir):
    return se.leaks(read(spark, sf_dir, "documents"), _LEAKS)


def epoch_times(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("bad")
    return read(spark, sf_dir, "orders").select("o_orderkey", s.step_epoch(k).alias("step_ts"), F.unix_seconds(s.relative_time(k * 86_400)).alias("rel_ts"), F.unix_seconds(s.lenient_time(text)).alias("parsed"))


def fold_encoding(spark, sf_dir):
    """Target encoding of merchants, fitted on each fold's training rows only."""
    folds = se.expanding_folds(txn_ties(spark, sf_dir), "us", "transaction_id")
    return st.target_encoding_by_fold(folds, "merchant_name", "is_fraud").select("transaction_id", "fold", "part", near("encoded", 6).alias("encoded"))


def iqr_scaling(spark, sf_dir):
    return st.iqr_scaled(txn_ties(spark, sf_dir), "amount", "scaled").select("transaction_id", near("scaled", 6).alias("scaled"))


def top_anomaly_categories(spark, sf_dir):
    df = txn_ties(spark, sf_dir).withColumn("score", F.col("transaction_id") * 7919 % 1000)
    return st.top_categories(df, "score", "transaction_id", "operation_type").select("operation_type", "n")


def candidate_lift(spark, sf_dir):
    """Which blocks of features lift precision over two time folds, and whether to take them."""
    df = _table(spark, sf_dir).drop("idx", "part")
    return models.candidate_lift(df, COLUMNS[:2], {"velocity": COLUMNS[2:4], "novelty": COLUMNS[4:]}, "is_fraud", ["us", "transaction_id"], "transaction_id", depth=8, rounds=200)


def model_variants(spark, sf_dir):
    """Baseline, all features, and those that make up most of the importance."""
    df = _table(spark, sf_dir)
    train, test = df.where("part = 'train'"), df.where("part = 'test'")
    whole = models.fit_boosted(train, COLUMNS, "is_fraud", 8, 200)
    chosen = models.selected_features(whole, COLUMNS)
    return models.compare_variants(train, test, {"baseline": COLUMNS[:2], "all": COLUMNS, "selective": chosen}, "is_fraud", "transaction_id", {"all": whole}, depth=8, rounds=200)


def ranked_plans(spark, sf_dir):
    """Every customer's catalogue in the order of a fitted ranker: here nations stand for plans."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    c = c.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("own_region")), "c_nationkey").select("c_custkey", "c_nationkey", "c_acctbal", "own_region")
    c = dealt(c, rows=1 << 15)  # a small file of customers is many pairs
    items = n.select("n_nationkey", "n_regionkey", "n_name")
    features = {"same_region": (F.col("own_region") == F.col("n_regionkey")).cast("int"), "distance": F.abs(F.col("c_nationkey") - F.col("n_nationkey")), "balance": F.col("c_acctbal") / 10_000, "length": F.length("n_name")}
    pairs = j.pair_all(se.key_split(c, "c_custkey").where("part = 'train'"), items).withColumns(features)
    learnt = pairs.withColumns({"rel": s.relevance(F.col("c_nationkey") == F.col("n_nationkey"), F.col("same_region") == 1), "weight": F.lit(1.0)})
    model = models.fit_ranker(learnt, list(features), "rel", "weight", 3, 5)
    return ranking.rank_items(c, items, features, model, "c_custkey", "n_nationkey")


QUERIES = {f.__name__: f for f in (payment_proxies, first_country, redact_signals, plan_extras, eligible_plans, recent_runs, stratified_sample, attribution_pairs, harmonised_card, cast_failures, leak_check, epoch_times, fold_encoding, iqr_scaling, top_anomaly_categories, candidate_lift, model_variants, ranked_plans)}

_T = f"WITH {TIES_SQL}"
_quoted = lambda v: "[" + ", ".join(_quoted(x) if isinstance(x, tuple) else f"'{x}'" for x in v) + "]"
_FOLDS = "i AS (SELECT *, row_number() OVER (ORDER BY us, transaction_id) - 1 AS idx, count(*) OVER () AS total FROM txn), c(fold, a, b) AS (VALUES (0, 0.6::DOUBLE, 0.8::DOUBLE), (1, 0.8::DOUBLE, 1.0::DOUBLE)), f AS (SELECT transaction_id, merchant_name, is_fraud, fold, CASE WHEN idx < floor(total * a) THEN 'train' ELSE 'test' END AS part FROM i, c WHERE idx < floor(total * b))"
ORACLE_SQL = {name: near_sql(sql) for name, sql in {
    "payment_proxies": f"""WITH x AS (SELECT o_orderkey AS k, *, {_quoted(('GB', 'US', 'DE', 'FR', 'spain'))}[1 + o_orderkey % 5] AS country FROM orders)
 SELECT o_orderkey, coalesce(CASE WHEN k % 3 = 0 THEN concat('mail', k % 5) END, CASE WHEN k % 2 = 0 THEN 'visa' END, 'UNK') AS merchant, CASE WHEN k % 4 <> 0 THEN k ELSE -1 END AS card, CASE WHEN k % 5 <> 0 THEN k % 4 + 1 ELSE 0 END AS n_items,
 CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS priority, CASE WHEN k % 6 <> 0 THEN 2 ELSE 0 END AS n_tags, CASE WHEN k % 6 <> 0 THEN concat('t', k % 3) ELSE 'none' END AS last_tag, CASE WHEN k % 7 = 0 THEN k WHEN k % 2 = 0 THEN k + 1 ELSE k + 2 END AS event_time, country FROM x""",
    "first_country": _sql(f"SELECT transaction_id, CAST(row_number() {_seq('cc_num, transaction_id % 7')} = 1 AS INT) AS first_country FROM o"),
    "redact_signals": r"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '[0-9]{13,19}', '[CARD]', 'g') AS text, CAST(contains(coalesce(text, ''), '@') AS INT) AS has_at, CAST(regexp_matches(coalesce(text, ''), '[0-9]{4}') AS INT) AS has_digits FROM documents",
    "plan_extras": f"WITH x AS (SELECT *, p_partkey AS k, {_quoted(_FAMILIES)}[1 + p_partkey % 3] AS o, {_quoted(_FAMILIES)}[1 + p_partkey // 3 % 3] AS m FROM part) SELECT p_partkey, NEAR(p_size * 100 / (p_retailprice * 12), 6) AS deductible_ratio, CAST(k % 2 = 0 AND k % 5 <> k % 3 AS INT) AS switching, NEAR(len(list_intersect(m, o))::DOUBLE / len(m), 6) AS family_fit FROM x",
    "eligible_plans": "SELECT p_partkey, p_retailprice FROM part WHERE list_contains([p_partkey % 5, p_partkey % 7], 3) AND p_retailprice <= 1200",
    "recent_runs": "SELECT o_orderkey AS run_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS started FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT 10",
    "stratified_sample": f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_H('o_orderkey', 'strata')} < CASE o_orderstatus WHEN 'F' THEN 0.2::DOUBLE WHEN 'O' THEN 0.05::DOUBLE ELSE 0 END",
    "attribution_pairs": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, NEAR(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))),
    "harmonised_card": "SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CASE WHEN o_orderkey % 10 <> 0 THEN NEAR(o_totalprice, 2) END AS amount, o_orderkey % 2 = 1 AS is_fraud, epoch_us(o_orderdate) // 1000000 AS event_time_ts FROM orders",
    "cast_failures": "SELECT 'amount' AS \"column\", count(*) FILTER (o_orderkey % 10 = 0) AS failures FROM orders UNION ALL SELECT 'event_time_ts', 0",
    "leak_check": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{n}' AS pattern, count(*) FILTER (regexp_matches({c}, '{p}')) AS n FROM documents" for c in ("text", "lang", "source") for n, p in _LEAKS.items()),
    "epoch_times": f"SELECT o_orderkey, {s.STEP_EPOCH}::BIGINT + o_orderkey * 3600 AS step_ts, {s.RELATIVE_EPOCH}::BIGINT + o_orderkey * 86400 AS rel_ts, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) END AS parsed FROM orders",
    "fold_encoding": f"{_T}, {_FOLDS}, g AS (SELECT fold, avg(is_fraud) AS m FROM f WHERE part = 'train' GROUP BY 1), e AS (SELECT fold, merchant_name, sum(is_fraud) AS s, count(*) AS n FROM f WHERE part = 'train' GROUP BY 1, 2) SELECT transaction_id, f.fold, part, NEAR(coalesce((s + 10 * m) / (n + 10), m), 6) AS encoded FROM f JOIN g ON f.fold = g.fold LEFT JOIN e ON f.fold = e.fold AND f.merchant_name = e.merchant_name",
    "iqr_scaling": f"{_T}, q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.5) AS b, quantile_cont(amount, 0.75) AS c FROM txn) SELECT transaction_id, NEAR((amount - b) / nullif(c - a, 0), 6) AS scaled FROM txn, q",
    "top_anomaly_categories": f"{_T}, t AS (SELECT operation_type FROM txn ORDER BY transaction_id * 7919 % 1000 DESC, transaction_id LIMIT 20) SELECT operation_type, count(*) AS n FROM t GROUP BY 1",
}.items()}
