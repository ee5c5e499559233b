"""Queries of aggregates, joins and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import graphs as g
from ..operators import joins as j
from ..operators import rolling
from ..operators import rules as ru
from ..operators import scans
from ..operators import select as se
from ..operators import stats as st
from ..sources.workspace import scratch, staged
from .views import ORD_SQL, TIES_SQL, TXN_SQL, near, near_sql, read, txn, txn_ties


def _n(*names: str, places: int = 4) -> list:
    return [near(n, places).alias(n) for n in names]


def account_stats(spark, sf_dir):
    return st.group_stats(txn_ties(spark, sf_dir), "cc_num", "amount").select("cc_num", *_n("mean", "std", "median", "p90", "p99", places=2))


def robust_z(spark, sf_dir):
    df = txn_ties(spark, sf_dir)
    return st.robust_apply(df, st.robust_fit(df, "operation_type", "amount"), "operation_type", "amount").select("transaction_id", *_n("capped", "robust_z"))


def category_z(spark, sf_dir):
    return st.category_z(txn_ties(spark, sf_dir), "operation_type", "amount").select("transaction_id", *_n("category_z"))


def value_counts(spark, sf_dir):
    return st.value_counts(txn(spark, sf_dir), "operation_type")


def freq_encode(spark, sf_dir):
    df = txn_ties(spark, sf_dir)
    found = j.lookup(df, st.frequency(df.where("transaction_id % 5 <> 0 AND merchant_name <> 'M3'"), "merchant_name"), "merchant_name", {"freq": 0.0})
    return found.select("transaction_id", *_n("freq", places=6))


def chain_merchant(spark, sf_dir):
    return st.chain_merchants(txn(spark, sf_dir), "merchant_name").select("transaction_id", "merchant_rows", "is_chain")


def entity_risk(spark, sf_dir):
    return st.entity_risk(txn_ties(spark, sf_dir), "cc_num", "is_fraud").select("transaction_id", *_n("risk", places=6))


def prior_entity_risk(spark, sf_dir):
    from ..operators import windows as w

    return scans.prior_risk(txn_ties(spark, sf_dir), "cc_num", "is_fraud").select("transaction_id", *_n("prior_risk", places=6))


def customer_profile(spark, sf_dir):
    df = st.customer_profile(txn_ties(spark, sf_dir), "cc_num", "amount", "operation_type", "merchant_name")
    return df.select("cc_num", *_n("mean_amount", "std_amount", places=2), "n", "n_other", "usual")


def column_profile(spark, sf_dir):
    df = st.profile(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), 3)
    return df.select("column", "filled", "rows", *_n("mean", "std", "min", "max", places=2), F.col("top_values")[0]["count"].alias("top_count"))


def missingness(spark, sf_dir):
    l = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey") + 700, "left").select("o_orderkey", "c_custkey", "c_name", "c_acctbal")  # noqa: E741
    return st.missingness(l).select("column", *_n("missing", places=6))


def label_distribution(spark, sf_dir):
    return st.label_rate(txn(spark, sf_dir), "is_fraud")


def time_coverage(spark, sf_dir):
    return st.time_coverage(txn(spark, sf_dir), "us")


def distinct_per_group(spark, sf_dir):
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).groupBy("l_partkey").agg(F.countDistinct("o_custkey").alias("customers"))


def banded_amounts(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("share", F.col("o_orderkey") % 101 / 100)
    return st.banded(df, "share", "o_totalprice").select("band", *_n("mean", "std", places=2), "n")


def daily_rate(spark, sf_dir):
    df = read(spark, sf_dir, "orders").withColumn("is_fraud", (F.col("o_orderkey") % 40 == 0).cast("int"))
    return st.daily_rate(df, "o_orderdate", "is_fraud").select(F.col("day").cast("string").alias("day"), "n", *_n("rate", places=6))


def drift_snapshot(spark, sf_dir):
    return st.drift_snapshot(txn(spark, sf_dir), "operation_type", "amount").select("operation_type", "n", "null_rate", *_n("p50", "p90", "p99"))


def new_merchant_share(spark, sf_dir):
    df = txn_ties(spark, sf_dir)
    return st.new_share(df, df.where("transaction_id % 37 > 4"), "merchant_name").select(*_n("new_share", places=6))


def psi(spark, sf_dir):
    df = txn_ties(spark, sf_dir)
    return st.psi(df.where("transaction_id % 2 = 0"), df.where("transaction_id % 2 = 1").withColumn("amount", F.col("amount") * 1.25 + 1000), "amount").select(*_n("psi", "kl", places=5))


def k_anonymity(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return st.k_anonymous(df, ["c_nationkey", "c_mktsegment"], 12)


def category_refresh(spark, sf_dir):
    """Statistics of the last 90 days only."""
    df = txn_ties(spark, sf_dir)
    recent = ru.with_one_row(df, df.agg(F.max("us").alias("now"))).where(F.col("us") >= F.col("now") - 90 * 86_400_000_000)
    return st.group_stats(recent, "operation_type", "amount").select("operation_type", *_n("mean", "std", "median", "p90", "p99", places=2))


def category_refresh_daily(spark, sf_dir):
    """Statistics of 90 days from stored daily states: a first load, then ten days one after another, each reading its own rows only."""
    df = txn_ties(spark, sf_dir).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    # files of ranges of days, so that a day's rows are read from one or two
    paid = staged(df.select("operation_type", "amount", "day").repartitionByRange("day"), "payments")
    last = paid.agg(F.max("day")).first()[0]
    states = rolling.DailyStates(spark, scratch(spark, "states"))
    states.load(paid.where(F.col("day").between(last - 99, last - 10)), "operation_type", "amount", "day")
    for day in range(last - 9, last + 1):
        state = states.refresh(paid.where(F.col("day") == day), "operation_type", "amount", day)
    return rolling.figures(state, {"median": 0.5, "p99": 0.99}).select(F.col("key").alias("operation_type"), "n", *_n("mean", "std", places=2), *_n("median", "p99", places=0))


def score_histogram(spark, sf_dir):
    df = txn_ties(spark, sf_dir).withColumn("score", F.col("transaction_id") * 7919 % 1000 / 1000)
    return st.histogram(df, "score", "is_fraud")


def latency_summary(spark, sf_dir):
    return st.latency(txn(spark, sf_dir), "amount", 50.0).select(*_n("mean", "p95", "max", "under"))


def class_weight(spark, sf_dir):
    return st.class_weight(txn(spark, sf_dir), "is_fraud", 100.0).select(*_n("pos_weight"))


def correlations(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return st.correlations(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select("feature", *_n("corr", places=6))


def target_encoding(spark, sf_dir):
    """Every row's merchant, encoded as four fifths of the rows know it."""
    df = txn_ties(spark, sf_dir)
    return j.lookup(df, st.target_encoding(df.where("transaction_id % 5 <> 0"), "merchant_name", "is_fraud"), "merchant_name", {}).select("transaction_id", *_n("encoded", places=6))


def exact_quantile(spark, sf_dir):
    return st.exact_quantile(txn_ties(spark, sf_dir), "amount", 0.995).select(*_n("quantile"))


def identity_join(spark, sf_dir):
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    return j.left_on(o, l, "o_orderkey", "l_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("l_partkey").alias("matched"))


def fact_dimensions(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return j.fact_dimensions(c, [(n, "c_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")]).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), near(F.sum("c_acctbal"), 2).alias("balance"))


def profile_items(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return j.pair_all(c, read(spark, sf_dir, "region")).select("c_custkey", "r_regionkey", (F.col("c_acctbal") * (F.col("r_regionkey") + 1)).alias("x")).select("c_custkey", "r_regionkey", *_n("x", places=2))


_RATES = [("2023-01-01", 1.0), ("2023-06-01", 1.1), ("2024-01-01", 0.9), ("1995-01-01", 1.3), ("1996-06-15", 1.25), ("1997-01-01", 1.2)]


def fx_asof(spark, sf_dir):
    rates = spark.createDataFrame(_RATES, "d string, rate double").select(F.unix_micros(F.concat("d", F.lit("T00:00:00Z")).cast("timestamp")).alias("rate_us"), "rate")
    out = j.as_of(txn_ties(spark, sf_dir), rates, "us", "rate_us", "rate")
    return out.select("transaction_id", "rate", near(F.col("amount") * F.col("rate"), 2).alias("eur"))


def _device_uses(spark, sf_dir):
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("l_partkey").alias("device"), F.col("o_custkey").alias("customer"))


def shared_device(spark, sf_dir):
    return j.shared_pairs(_device_uses(spark, sf_dir), "device", "customer")


def device_rings(spark, sf_dir):
    """Customers whose order lines share a part and ship date, directly or through others; every 40th order is a confirmed fraud."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    uses = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.concat_ws("/", "l_partkey", "l_shipdate").alias("device"), F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 40 == 0).cast("int").alias("fraud"))
    return g.rings(uses, "device", "customer", "fraud")


def cycles(spark, sf_dir):
    return j.cycles(_edges(spark, sf_dir), 20 * 86_400_000_000, id_col="line")


def fan_in_out(spark, sf_dir):
    return j.fan(_edges(spark, sf_dir))


def _edges(spark, sf_dir):
    """A payment for each order line, from customer to supplier; accounts are their keys, numbered alike."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")  # noqa: E741
    from .views import micros

    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), micros("o_orderdate").alias("us"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))


def semi_anti(spark, sf_dir):
    df = txn_ties(spark, sf_dir)
    some = df.where("is_fraud = 1").select("merchant_name").distinct().where("merchant_name < 'M2'")
    yes, no = j.members(df, some, "merchant_name")
    return yes.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("in")).unionByName(no.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("out")))


def range_risk(spark, sf_dir):
    bands = spark.createDataFrame([(0, 49_999, "low"), (50_000, 149_999, "mid"), (150_000, 299_999, "high")], "lo long, hi long, band string")
    return j.in_range(txn_ties(spark, sf_dir).withColumn("v", F.floor("amount")), bands, "v", "lo", "hi").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


_NETWORKS = [("0.0.0.0/1", 1), ("64.0.0.0/3", 2), ("80.0.0.0/5", 3), ("81.0.0.0/8", 4), ("81.128.0.0/9", 5), ("128.0.0.0/2", 6), ("200.0.0.0/6", 7), ("200.16.0.0/12", 8), ("81.200.7.0/24", 9)]


def ip_risk(spark, sf_dir):
    """The most specific network of an address, and its risk."""
    networks = spark.createDataFrame(_NETWORKS, "network string, risk int")
    first, last = j.network_ends(F.col("network"))
    k = F.col("o_orderkey") * 2654435761 % 4294967296
    byte = lambda n: F.shiftright(k, n) % 256
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", *[byte(n).cast("string") for n in (24, 16, 8, 0)]).alias("address"))
    met = j.in_range(df.withColumn("number", j.ip_number(F.col("address"))), networks.select("network", "risk", first.alias("first"), last.alias("last")), "number", "first", "last")
    return met.select("o_orderkey", "address", "network", "risk")


def prefix_reference(spark, sf_dir):
    ref = spark.createDataFrame([("1", "one"), ("2", "two"), ("9", "nine")], "prefix string, issuer string")
    return j.by_prefix(txn_ties(spark, sf_dir), ref, F.col("transaction_id").cast("string"), 1, "prefix").groupBy("issuer").agg(F.count(F.lit(1)).alias("n"))


def canonical_type(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("ATM", "Refund", "p2p", "Other", "top_up")]), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("raw"))
    return s.canonical_type(df, s.synonyms(spark), "raw").select("o_orderkey", "transaction_type")


def token_hash(spark, sf_dir):
    return txn_ties(spark, sf_dir).select("transaction_id", s.token(F.col("cc_num"), "pepper").alias("token"))


def keyed_token(spark, sf_dir):
    return txn_ties(spark, sf_dir).select("transaction_id", s.versioned_token(F.col("cc_num"), {1: b"old", 2: b"new key"}).alias("t")).select("transaction_id", "t.*")


def merchant_clean(spark, sf_dir):
    return txn(spark, sf_dir).select("transaction_id", s.clean_merchant(F.col("merchant_name")).alias("merchant"))


def amount_transforms(spark, sf_dir):
    return txn(spark, sf_dir).select("transaction_id", near(F.abs("amount")).alias("abs_amount"), near(s.log_amount(F.col("amount")), 6).alias("log_amount"))


def cyclic_time(spark, sf_dir):
    t = s.epoch_time(F.floor(F.col("us") / 1_000_000))
    df = txn(spark, sf_dir).withColumns({k: v.cast("long") for k, v in s.calendar(t).items()})
    sin, cos = s.cyclic(F.col("hour"), 24)
    return df.select("transaction_id", "hour", "dow", "month", "is_night", "is_weekend", near(sin, 6).alias("hour_sin"), near(cos, 6).alias("hour_cos"))


def holiday(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", s.is_holiday(F.col("o_orderdate")).alias("is_holiday"))


def category_mapping(spark, sf_dir):
    codes = [c[1] for c in s.CATEGORIES if c[0] == "card"]
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("card").alias("dataset"), F.element_at(F.array(*[F.lit(c) for c in [*codes, "none"]]), (F.col("o_orderkey") % (len(codes) + 1) + 1).cast("int")).alias("code"))
    out = j.lookup(df, s.categories(spark), ["dataset", "code"], {})
    return out.groupBy("category", "subcategory", F.coalesce(F.col("subcategory").isin(*s.SUBSCRIPTIONS).cast("int"), F.lit(0)).alias("is_subscription")).agg(F.count(F.lit(1)).alias("n"))


def confidence_band(spark, sf_dir):
    k = F.col("o_orderkey")
    cols = [F.when(k % m == 0, F.lit("x")) for m in (2, 3, 5, 7)]
    df = read(spark, sf_dir, "orders").select("o_orderkey", s.completeness(cols).alias("n"))
    df = df.withColumn("confidence", s.confidence(F.col("n")))
    return df.select("o_orderkey", F.col("n").cast("long").alias("n"), near("confidence").alias("confidence"), s.confidence_band(F.col("confidence")).alias("band"), near(s.quality((k % 2 == 0).cast("int"), (k % 3 == 0).cast("int"), (k % 5 == 0).cast("int"), F.col("confidence"))).alias("quality"))


def label_encoding(spark, sf_dir):
    return se.label_index(txn_ties(spark, sf_dir), "operation_type", "code").select("transaction_id", F.col("code").cast("long").alias("code"))


def pii_redact(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", s.redact(F.coalesce("text", F.lit(""))).alias("text"))


def cosine_match(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    anchor = e.where("vec_id = 0").select(F.col("embedding").alias("anchor"))
    return ru.with_one_row(e, anchor).select("vec_id", near(s.cosine(F.col("embedding"), F.col("anchor")), 5).alias("cos"))


def account_flags(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    nul = lambda m, c: F.when(k % m != 0, c)
    df = df.select("o_orderkey", nul(3, k).alias("card"), nul(2, k + 1).alias("account"), k.alias("user"), nul(5, F.col("o_totalprice")).alias("amount"), nul(7, F.lit("x")).alias("kind"), F.when(k % 4 == 0, "card").otherwise("bank").alias("dataset"))
    df = s.fill(df, {"kind": "UNK", "amount": "median"})
    flags = s.risk_flags(F.col("card") % 5, k % 5 + k % 2, F.col("kind"), ("UNK",)) | s.refund_flags()
    return df.select("o_orderkey", s.entity_of(F.col("card"), F.col("account"), F.col("user")).alias("entity"), near("amount", 3).alias("amount"), "kind", s.country_default(F.col("dataset"), F.lit(None).cast("string")).alias("country"), *[c.alias(n) for n, c in flags.items()])


def top_anomalies(spark, sf_dir):
    df = txn_ties(spark, sf_dir).withColumns({"score": (F.col("transaction_id") * 7919 % 1000) / 1000.0, "confidence": (F.col("transaction_id") % 10) / 10.0, "quality": (F.col("transaction_id") % 7) / 7.0})
    return st.top_summary(df, "score", "transaction_id", "confidence", "quality").select("n", *_n("confidence", "quality", "low_share"))


QUERIES = {f.__name__: f for f in (account_flags, top_anomalies, account_stats, robust_z, category_z, value_counts, freq_encode, chain_merchant, entity_risk, prior_entity_risk, customer_profile, column_profile, missingness, label_distribution, time_coverage, distinct_per_group, banded_amounts, daily_rate, drift_snapshot, new_merchant_share, psi, k_anonymity, category_refresh, category_refresh_daily, score_histogram, latency_summary, class_weight, correlations, target_encoding, exact_quantile, identity_join, fact_dimensions, profile_items, fx_asof, shared_device, device_rings, cycles, fan_in_out, semi_anti, range_risk, ip_risk, prefix_reference, canonical_type, token_hash, keyed_token, merchant_clean, amount_transforms, cyclic_time, holiday, category_mapping, confidence_band, label_encoding, pii_redact, cosine_match)}

_T = f"WITH {TIES_SQL}"
_pad = lambda x: bytes(b ^ x for b in b"new key".ljust(64, b"\0")).hex()
_ORD = ORD_SQL
_STATS = "NEAR(avg(amount), 2) AS mean, NEAR(coalesce(stddev_samp(amount), 0), 2) AS std, NEAR(quantile_cont(amount, 0.5), 2) AS median, NEAR(quantile_cont(amount, 0.9), 2) AS p90, NEAR(quantile_cont(amount, 0.99), 2) AS p99"
_GROWTH = (1 + rolling.ACCURACY) / (1 - rolling.ACCURACY)
_RATIO = math.log(_GROWTH)
_EDGES = "e AS (SELECT o_custkey AS src, l_suppkey AS dst, epoch_us(o_orderdate) AS us, concat(l_orderkey, '-', l_linenumber) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _ends(network: str) -> tuple[int, int]:
    import ipaddress

    own = ipaddress.ip_network(network)
    return int(own.network_address), int(own.broadcast_address)


_codes = [c for c in s.CATEGORIES if c[0] == "card"]
_quote = lambda x: "'" + x.replace("'", "''") + "'"
ORACLE_SQL = {name: near_sql(sql) for name, sql in {
    "account_flags": "WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS c, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey + 1 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS p FROM orders) SELECT k AS o_orderkey, CASE WHEN c IS NOT NULL THEN concat('card:', c) WHEN a IS NOT NULL THEN concat('account:', a) ELSE concat('user:', k) END AS entity, NEAR(coalesce(p, (SELECT quantile_cont(p, 0.5) FROM x)), 3) AS amount, CASE WHEN k % 7 <> 0 THEN 'x' ELSE 'UNK' END AS kind, CASE WHEN k % 4 = 0 THEN 'US' ELSE 'unknown' END AS country, coalesce(CAST(c % 5 <> k % 5 + k % 2 AS INT), 0) AS country_mismatch, CAST(k % 7 = 0 AS INT) AS risky_category, 0 AS is_refund, 0 AS refund_risk FROM x",
    "top_anomalies": f"{_T}, t AS (SELECT transaction_id % 10 / 10.0::DOUBLE AS c, transaction_id % 7 / 7.0::DOUBLE AS q FROM txn ORDER BY transaction_id * 7919 % 1000 DESC, transaction_id LIMIT 20) SELECT count(*) AS n, NEAR(avg(c), 4) AS confidence, NEAR(avg(q), 4) AS quality, NEAR(avg(CAST(c < 0.5 AS INT)), 4) AS low_share FROM t",
    "account_stats": f"{_T} SELECT cc_num, {_STATS} FROM txn GROUP BY cc_num",
    "robust_z": f"{_T}, c AS (SELECT operation_type, quantile_cont(amount, 0.995) AS cap FROM txn GROUP BY 1), w AS (SELECT txn.*, least(amount, cap) AS w FROM txn JOIN c USING (operation_type)), q AS (SELECT operation_type, quantile_cont(w, 0.5) AS m, quantile_cont(w, 0.75) - quantile_cont(w, 0.25) AS r FROM w GROUP BY 1) SELECT transaction_id, NEAR(w, 4) AS capped, NEAR((w - m) / nullif(r, 0), 4) AS robust_z FROM w JOIN q USING (operation_type)",
    "category_z": f"{_T} SELECT transaction_id, NEAR((abs(amount) - avg(amount) OVER p) / coalesce(nullif(stddev_samp(amount) OVER p, 0), 1), 4) AS category_z FROM txn WINDOW p AS (PARTITION BY operation_type)",
    "value_counts": f"WITH {TXN_SQL} SELECT operation_type, count(*) AS n FROM txn GROUP BY 1",
    "freq_encode": f"{_T}, f AS (SELECT merchant_name, count(*)::DOUBLE / sum(count(*)) OVER () AS freq FROM txn WHERE transaction_id % 5 <> 0 AND merchant_name <> 'M3' GROUP BY 1) SELECT transaction_id, NEAR(coalesce(freq, 0), 6) AS freq FROM txn LEFT JOIN f USING (merchant_name)",
    "chain_merchant": f"WITH {TXN_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY merchant_name) AS merchant_rows FROM txn) SELECT transaction_id, merchant_rows, CAST(merchant_rows >= (SELECT quantile_cont(merchant_rows, 0.9) FROM c) AS INT) AS is_chain FROM c",
    "entity_risk": f"{_T} SELECT transaction_id, NEAR(avg(is_fraud) OVER (PARTITION BY cc_num), 6) AS risk FROM txn",
    "prior_entity_risk": f"{_T}, {_ORD} SELECT transaction_id, NEAR(coalesce(avg(is_fraud) OVER (PARTITION BY cc_num ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS prior_risk FROM o",
    "customer_profile": f"{_T}, u AS (SELECT cc_num, operation_type AS usual FROM (SELECT cc_num, operation_type, row_number() OVER (PARTITION BY cc_num ORDER BY count(*) DESC, operation_type) AS r FROM txn GROUP BY 1, 2) WHERE r = 1) SELECT cc_num, NEAR(avg(amount), 2) AS mean_amount, NEAR(coalesce(stddev_samp(amount), 0), 2) AS std_amount, count(*) AS n, count(DISTINCT merchant_name) AS n_other, any_value(usual) AS usual FROM txn JOIN u USING (cc_num) GROUP BY cc_num",
    "column_profile": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(*) AS \"rows\", NEAR(avg({c}), 2) AS mean, NEAR(stddev_samp({c}), 2) AS std, NEAR(min({c}), 2) AS min, NEAR(max({c}), 2) AS max, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY {c})) AS top_count FROM customer" for c in ("c_custkey", "c_nationkey", "c_acctbal")) + " UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(*), NULL, NULL, NULL, NULL, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) FROM customer)",
    "missingness": "WITH l AS (SELECT o_orderkey, c_custkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey + 700) SELECT 'o_orderkey' AS \"column\", NEAR(avg(CAST(o_orderkey IS NULL AS INT)), 6) AS missing FROM l" + "".join(f" UNION ALL SELECT '{c}', NEAR(avg(CAST({c} IS NULL AS INT)), 6) FROM l" for c in ("c_custkey", "c_name", "c_acctbal")),
    "label_distribution": f"WITH {TXN_SQL} SELECT CAST(sum(is_fraud) AS BIGINT) AS positives, count(*) AS \"rows\", avg(is_fraud) AS rate FROM txn",
    "time_coverage": f"WITH {TXN_SQL} SELECT min(us) AS first, max(us) AS last FROM txn",
    "distinct_per_group": "SELECT l_partkey, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "banded_amounts": "WITH x AS (SELECT o_totalprice AS v, (o_orderkey % 101) / 100.0::DOUBLE AS s FROM orders), b AS (SELECT v, CASE WHEN s > 0 AND s <= 0.3 THEN '(0,0.3]' WHEN s > 0.3 AND s <= 0.6 THEN '(0.3,0.6]' WHEN s > 0.6 AND s <= 1 THEN '(0.6,1]' END AS band FROM x) SELECT band, NEAR(avg(v), 2) AS mean, NEAR(coalesce(stddev_samp(v), 0), 2) AS std, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY 1",
    "daily_rate": "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, avg(CAST(o_orderkey % 40 = 0 AS INT)) AS rate FROM orders GROUP BY 1), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n, NEAR(coalesce(rate, 0), 6) AS rate FROM s LEFT JOIN d USING (day)",
    "drift_snapshot": f"WITH {TXN_SQL} SELECT operation_type, count(*) AS n, avg(CAST(amount IS NULL AS INT)) AS null_rate, NEAR(quantile_cont(amount, 0.5), 4) AS p50, NEAR(quantile_cont(amount, 0.9), 4) AS p90, NEAR(quantile_cont(amount, 0.99), 4) AS p99 FROM txn GROUP BY 1",
    "new_merchant_share": f"{_T} SELECT NEAR(avg(CAST(transaction_id % 37 <= 4 AS INT)), 6) AS new_share FROM txn",
    "psi": f"""{_T}, b AS (SELECT amount FROM txn WHERE transaction_id % 2 = 0), c AS (SELECT amount * 1.25::DOUBLE + 1000 AS amount FROM txn WHERE transaction_id % 2 = 1), q AS (SELECT unnest(quantile_cont(amount, [{', '.join(f'{k / 10}' for k in range(1, 10))}])) AS edge FROM b),
 x AS (SELECT amount, 0 AS t FROM b UNION ALL SELECT amount, 1 FROM c), y AS (SELECT t, (SELECT count(*) FROM q WHERE edge < amount) AS bin FROM x), z AS (SELECT t, bin, greatest(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY t), 1e-4) AS p FROM y GROUP BY 1, 2),
 f AS (SELECT bin, coalesce(max(p) FILTER (t = 0), 1e-4) AS b, coalesce(max(p) FILTER (t = 1), 1e-4) AS c FROM z GROUP BY 1) SELECT NEAR(sum((c - b) * ln(c / b)), 5) AS psi, NEAR(sum(c * ln(c / b)), 5) AS kl FROM f""",
    "k_anonymity": "SELECT c_custkey, CASE WHEN n >= 12 THEN c_nationkey END AS c_nationkey, CASE WHEN n >= 12 THEN c_mktsegment END AS c_mktsegment FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)",
    "category_refresh": f"{_T} SELECT operation_type, {_STATS} FROM txn WHERE us >= (SELECT max(us) FROM txn) - {90 * 86_400_000_000} GROUP BY 1",
    "category_refresh_daily": f"""{_T}, r AS (SELECT operation_type, amount, CAST(ceil(ln(amount) / {_RATIO!r}::DOUBLE) AS BIGINT) AS b FROM txn WHERE us // 86400000000 > (SELECT max(us) FROM txn) // 86400000000 - 90),
 o AS (SELECT *, row_number() OVER (PARTITION BY operation_type ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY operation_type) AS c FROM r),
 q AS (SELECT operation_type, max(b) FILTER (i = floor((c - 1) * 0.5::DOUBLE)) AS m, max(b) FILTER (i = floor((c - 1) * 0.99::DOUBLE)) AS p FROM o GROUP BY 1)
 SELECT operation_type, count(*) AS n, NEAR(avg(amount), 2) AS mean, NEAR(coalesce(stddev_samp(amount), 0), 2) AS std, NEAR(any_value(2 * pow({_GROWTH!r}::DOUBLE, m) / ({_GROWTH!r}::DOUBLE + 1)), 0) AS median, NEAR(any_value(2 * pow({_GROWTH!r}::DOUBLE, p) / ({_GROWTH!r}::DOUBLE + 1)), 0) AS p99
 FROM r JOIN q USING (operation_type) GROUP BY 1""",
    "score_histogram": f"{_T} SELECT least(CAST(floor((transaction_id * 7919 % 1000) / 1000.0::DOUBLE * 50) AS BIGINT), 49) AS bin, is_fraud, count(*) AS n FROM txn GROUP BY 1, 2",
    "latency_summary": f"WITH {TXN_SQL} SELECT NEAR(avg(amount), 4) AS mean, NEAR(quantile_cont(amount, 0.95), 4) AS p95, NEAR(max(amount), 4) AS max, NEAR(avg(CAST(amount < 50 AS INT)), 4) AS under FROM txn",
    "class_weight": f"WITH {TXN_SQL} SELECT NEAR(100.0 * (count(*) - sum(is_fraud)) / greatest(sum(is_fraud), 1), 4) AS pos_weight FROM txn",
    "correlations": " UNION ALL ".join(f"SELECT '{c}' AS feature, NEAR(corr({c}, l_extendedprice), 6) AS corr FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "target_encoding": f"{_T}, t AS (SELECT * FROM txn WHERE transaction_id % 5 <> 0), e AS (SELECT merchant_name, (sum(is_fraud) + 10 * (SELECT avg(is_fraud) FROM t)) / (count(*) + 10) AS encoded FROM t GROUP BY 1) SELECT transaction_id, NEAR(encoded, 6) AS encoded FROM txn LEFT JOIN e USING (merchant_name)",
    "exact_quantile": f"{_T} SELECT NEAR(quantile_cont(amount, 0.995), 4) AS quantile FROM txn",
    "identity_join": "SELECT o_orderstatus, count(*) AS n, count(l_partkey) AS matched FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "fact_dimensions": "SELECT r_name, count(*) AS n, NEAR(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "profile_items": "SELECT c_custkey, r_regionkey, NEAR(c_acctbal * (r_regionkey + 1), 2) AS x FROM customer, region",
    "fx_asof": f"{_T}, f(d, rate) AS (VALUES {', '.join(f"(epoch_us(TIMESTAMP '{d} 00:00:00'), {r}::DOUBLE)" for d, r in _RATES)}) SELECT transaction_id, rate, NEAR(amount * rate, 2) AS eur FROM txn ASOF LEFT JOIN f ON us >= d",
    "shared_device": "WITH u AS (SELECT DISTINCT l_partkey AS d, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT a.c AS a, b.c AS b, count(*) AS shared FROM u a JOIN u b ON a.d = b.d AND a.c < b.c GROUP BY 1, 2",
    "device_rings": """WITH RECURSIVE u AS (SELECT concat_ws('/', l_partkey, l_shipdate) AS d, o_custkey AS c, CAST(o_orderkey % 40 = 0 AS INT) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 p AS (SELECT DISTINCT a.c AS a, b.c AS b FROM u a JOIN u b ON a.d = b.d AND a.c <> b.c), r(c, s) AS (SELECT DISTINCT c, c FROM u UNION SELECT p.b, r.s FROM r JOIN p ON p.a = r.c), m AS (SELECT c, min(s) AS ring FROM r GROUP BY 1),
 k AS (SELECT ring, count(DISTINCT c) AS members, count(DISTINCT d) AS keys, CAST(sum(f) AS BIGINT) AS confirmed FROM u JOIN m USING (c) GROUP BY 1) SELECT c AS customer, ring, members, keys, confirmed FROM m JOIN k USING (ring)""",
    "cycles": f"WITH {_EDGES} SELECT a.line AS first, b.line AS second, c.line AS third FROM e a JOIN e b ON a.dst = b.src AND b.us > a.us JOIN e c ON b.dst = c.src AND c.us > b.us AND c.dst = a.src WHERE c.us - a.us <= {20 * 86_400_000_000} AND a.src <> a.dst AND b.src <> b.dst",
    "fan_in_out": f"WITH {_EDGES} SELECT coalesce(o.src, i.dst) AS node, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in FROM (SELECT src, count(DISTINCT dst) AS fan_out FROM e GROUP BY 1) o FULL JOIN (SELECT dst, count(DISTINCT src) AS fan_in FROM e GROUP BY 1) i ON o.src = i.dst",
    "semi_anti": f"{_T}, k AS (SELECT DISTINCT merchant_name FROM txn WHERE is_fraud = 1 AND merchant_name < 'M2') SELECT count(*) AS n, 'in' AS side FROM txn WHERE merchant_name IN (SELECT merchant_name FROM k) UNION ALL SELECT count(*), 'out' FROM txn WHERE merchant_name NOT IN (SELECT merchant_name FROM k)",
    "range_risk": f"{_T} SELECT CASE WHEN floor(amount) BETWEEN 0 AND 49999 THEN 'low' WHEN floor(amount) BETWEEN 50000 AND 149999 THEN 'mid' WHEN floor(amount) BETWEEN 150000 AND 299999 THEN 'high' END AS band, count(*) AS n FROM txn GROUP BY 1",
    "ip_risk": f"WITH n(network, risk, first, last) AS (VALUES {', '.join(f"('{c}', {r}, {_ends(c)[0]}, {_ends(c)[1]})" for c, r in _NETWORKS)}), a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS k FROM orders), m AS (SELECT o_orderkey, k, arg_min(network, last - first) AS network, arg_min(risk, last - first) AS risk FROM a LEFT JOIN n ON k BETWEEN first AND last GROUP BY 1, 2) SELECT o_orderkey, concat_ws('.', k >> 24, (k >> 16) % 256, (k >> 8) % 256, k % 256) AS address, network, risk FROM m",
    "prefix_reference": f"{_T} SELECT CASE left(CAST(transaction_id AS VARCHAR), 1) WHEN '1' THEN 'one' WHEN '2' THEN 'two' WHEN '9' THEN 'nine' END AS issuer, count(*) AS n FROM txn GROUP BY 1",
    "canonical_type": "SELECT o_orderkey, ['debit', 'credit', 'transfer', 'other', 'payment'][1 + o_orderkey % 5] AS transaction_type FROM orders",
    "token_hash": f"{_T} SELECT transaction_id, sha256('pepper:' || CAST(cc_num AS VARCHAR)) AS token FROM txn",
    "keyed_token": f"{_T} SELECT transaction_id, 2 AS key_version, sha256(from_hex('{_pad(0x5C)}') || from_hex(sha256(from_hex('{_pad(0x36)}') || encode(CAST(cc_num AS VARCHAR))))) AS token FROM txn",
    "merchant_clean": f"WITH {TXN_SQL} SELECT transaction_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(merchant_name), '^fraud_', ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS merchant FROM txn",
    "amount_transforms": f"WITH {TXN_SQL} SELECT transaction_id, NEAR(abs(amount), 4) AS abs_amount, NEAR(ln(1 + abs(amount)), 6) AS log_amount FROM txn",
    "cyclic_time": "SELECT event_id AS transaction_id, hour(ts) AS hour, isodow(ts) - 1 AS dow, month(ts) AS month, CAST(hour(ts) < 6 OR hour(ts) >= 22 AS BIGINT) AS is_night, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend, NEAR(sin(hour(ts) * 2 * pi() / 24), 6) AS hour_sin, NEAR(cos(hour(ts) * 2 * pi() / 24), 6) AS hour_cos FROM events",
    "holiday": f"SELECT o_orderkey, CAST(strftime(o_orderdate, '%m-%d') IN ({', '.join(map(_quote, s.HOLIDAYS))}) AS INT) AS is_holiday FROM orders",
    "category_mapping": f"WITH m(i, category, subcategory) AS (VALUES {', '.join(f'({i}, {_quote(c[2])}, {_quote(c[3])})' for i, c in enumerate(_codes))}) SELECT category, subcategory, coalesce(CAST(subcategory IN ({', '.join(map(_quote, s.SUBSCRIPTIONS))}) AS INT), 0) AS is_subscription, count(*) AS n FROM orders LEFT JOIN m ON o_orderkey % {len(_codes) + 1} = i GROUP BY 1, 2, 3",
    "confidence_band": "WITH x AS (SELECT o_orderkey AS k, (CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 3 = 0 AS INT) + CAST(o_orderkey % 5 = 0 AS INT) + CAST(o_orderkey % 7 = 0 AS INT))::BIGINT AS n FROM orders), y AS (SELECT *, least(0.5::DOUBLE + 0.1::DOUBLE * n, 0.95::DOUBLE) AS c FROM x) SELECT k AS o_orderkey, n, NEAR(c, 4) AS confidence, CASE WHEN c >= 0.75::DOUBLE THEN 'high' WHEN c >= 0.6::DOUBLE THEN 'medium' WHEN c >= 0.45::DOUBLE THEN 'low' ELSE 'very_low' END AS band, NEAR(0.3::DOUBLE * CAST(k % 2 = 0 AS INT) + 0.2::DOUBLE * CAST(k % 3 = 0 AS INT) + 0.2::DOUBLE * CAST(k % 5 = 0 AS INT) + 0.3::DOUBLE * c, 4) AS quality FROM y",
    "label_encoding": f"{_T} SELECT transaction_id, dense_rank() OVER (ORDER BY operation_type) - 1 AS code FROM txn",
    "pii_redact": r"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '[0-9]{13,19}', '[CARD]', 'g') AS text FROM documents",
    "cosine_match": "WITH a AS (SELECT embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id = 0) SELECT vec_id, NEAR(list_cosine_similarity(embedding::DOUBLE[], a), 5) AS cos FROM embeddings, a",
}.items()}
#: Names that queries over whole tables had beside others over a part.
_ALSO = ("daily_rate", "profile_items", "shared_device", "cycles", "fan_in_out")
QUERIES |= {f"{name}_all": QUERIES[name] for name in _ALSO}
ORACLE_SQL |= {f"{name}_all": ORACLE_SQL[name] for name in _ALSO}
