"""Queries of models, ranking, streams and sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import forest, metrics, models, ranking, select
from ..operators import rules as ru
from ..operators import stats as st
from ..operators import windows as w
from ..sources import readers, sinks
from ..sources.workspace import scratch, staged
from ..streaming import jobs
from .features import _D, _H, _over, _seq, _sql
from .views import TIES_SQL, TXN_SQL, micros, near, near_sql, read, txn, txn_ties

COLUMNS = ["amount", "log_amount", "cnt_24h", "sum_24h", "new_merchant", "robust_z"]
#: Rows of a file of a staged stream.
FILE_ROWS = 1 << 18


def _table(spark, sf_dir):
    """Model-ready rows; fitted tables come from the training part only."""
    df = w.first_seen(w.velocity(w.prepared(txn_ties(spark, sf_dir))), "merchant_name", "new_merchant").withColumn("log_amount", s.log_amount(F.col("amount")))
    df = select.chrono_split(staged(df, "windows"), "us", "transaction_id")  # ranges are drawn from a first pass, which would take the windows too
    df = st.robust_apply(df, st.robust_fit(df.where("part <> 'test'"), "operation_type", "amount"), "operation_type", "amount")
    df = df.withColumn("is_fraud", ((F.col("amount") > 250_000) | (F.col("transaction_id") % 97 == 0)).cast("int"))
    path = scratch(spark, "features")
    df.write.parquet(path)
    return spark.read.parquet(path)


def isolation_forest(spark, sf_dir):
    df = _table(spark, sf_dir)
    legit = select.legit_below(df.where("part <> 'test'"), "is_fraud", "amount")
    nodes = forest.fit(legit, COLUMNS, "transaction_id", trees=50)
    return forest.score(df, nodes, COLUMNS).select("transaction_id", "anomaly")


def forest_grid(spark, sf_dir):
    """Average precision of forests of several sizes."""
    df = _table(spark, sf_dir)
    out = None
    for trees in (20, 40):
        for sample in (64, 256):
            scored = forest.score(df.where("part = 'test'"), forest.fit(df.where("part <> 'test' AND is_fraud = 0"), COLUMNS, "transaction_id", trees, sample), COLUMNS, sample)
            row = metrics.average_precision(scored, "anomaly", "is_fraud").withColumns({"trees": F.lit(trees), "sample": F.lit(sample)})
            out = row if out is None else out.unionByName(row)
    return out


def boosted_alerts(spark, sf_dir):
    """Anomaly and rule scores stacked into boosted trees, calibrated, cut per category."""
    df = _table(spark, sf_dir)
    train = df.where("part <> 'test'")
    nodes = forest.fit(train.where("is_fraud = 0"), COLUMNS, "transaction_id", trees=30)
    df = forest.score(df, nodes, COLUMNS).withColumns({"abs_amount": F.abs("amount"), "is_new_merchant": F.col("new_merchant")})
    df = ru.rules_b(df, ru.quantile_row(train.withColumn("abs_amount", F.abs("amount")), "abs_amount", {"p995": 0.995}))
    columns = [*COLUMNS, "anomaly", "rule_score"]
    # scored once: the fit's passes read it again and again
    df = staged(df.select(*columns, "transaction_id", "operation_type", "is_fraud", "part", "idx"), "stacked")
    learnt = df.where("part = 'train'")
    last = learnt.agg(F.max("idx")).first()[0] or 0
    model = models.fit_boosted(learnt.withColumn("held", F.col("idx") > 0.9 * last), columns, "is_fraud", 3, 8, held="held")
    held = staged(models.probability(model, df.where("part = 'calibrate'"), columns).select("p", "is_fraud", "operation_type", "transaction_id"), "held")
    scored = models.calibrated(models.fit_calibration(held, "p", "is_fraud"), models.probability(model, df.where("part = 'test'"), columns), "p")
    cuts = select.kth_largest(held, "operation_type", "p", 0.01, "transaction_id")
    return scored.join(cuts, "operation_type", "left").select("transaction_id", "calibrated", F.coalesce(F.col("p") >= F.col("threshold"), F.lit(False)).alias("alert"))


def alert_reasons(spark, sf_dir):
    df = _table(spark, sf_dir)
    model = models.fit_boosted(df.where("part = 'train'"), COLUMNS, "is_fraud", 3, 5)
    alerts = models.probability(model, df.where("part = 'test'"), COLUMNS).where("p >= 0.5")
    return models.contributions(model, alerts, COLUMNS, "transaction_id")


def attribution_summary(spark, sf_dir):
    df = _table(spark, sf_dir)
    model = models.fit_boosted(df.where("part = 'train'"), COLUMNS, "is_fraud", 3, 5)
    return models.importance(models.contributions(model, df.where("part = 'test'"), COLUMNS, "transaction_id", len(COLUMNS)))


def segment_models(spark, sf_dir):
    return models.by_segment(_table(spark, sf_dir), "operation_type", COLUMNS[:3], "is_fraud", top=2, least=100, depth=2, rounds=3).select("transaction_id", "segment", "p")


def grid_search(spark, sf_dir):
    """The reference's grid, over all features. Its l2 penalties hardly prune a tree, and so do these least gains."""
    return models.grid(_table(spark, sf_dir).drop("idx", "part"), COLUMNS, "is_fraud", ["us", "transaction_id"], "transaction_id", {"depth": [6, 8], "least": [20, 50], "gain": [1e-7, 3e-7], "rounds": [300]})


def feature_ablation(spark, sf_dir):
    df = _table(spark, sf_dir)
    return models.ablation(df.where("part = 'train'"), df.where("part = 'test'"), {"amount": COLUMNS[:2], "velocity": COLUMNS[2:4], "novelty": COLUMNS[4:]}, "is_fraud", "transaction_id", depth=8, rounds=300)


def forest_classifier(spark, sf_dir):
    df = _table(spark, sf_dir)
    model = models.fit_forest(df.where("part = 'train'"), COLUMNS, "is_fraud", 10)
    return models.probability(model, df.where("part = 'test'"), COLUMNS).select("transaction_id", "p")


def impute_medians(spark, sf_dir):
    df = txn_ties(spark, sf_dir).withColumns({"amount": F.when(F.col("transaction_id") % 10 != 0, F.col("amount")), "operation_type": F.when(F.col("transaction_id") % 11 != 0, F.col("operation_type"))})
    fitted = models.fit_imputer(df.where("transaction_id % 2 = 0"), ["amount"], ["operation_type"])
    return models.impute(df, fitted).select("transaction_id", near("amount", 3).alias("amount"), "operation_type")


def standardised(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = txn_ties(spark, sf_dir)
    return models.standardise(df, ["amount"]).transform(df).select("transaction_id", near(vector_to_array("scaled")[0], 5).alias("z"))


def one_hot_merchants(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = txn_ties(spark, sf_dir)
    out = models.one_hot_frequent(df, "merchant_name", models.vocabulary(df, "merchant_name", 406), "hot")
    return out.select("transaction_id", F.aggregate(vector_to_array("hot"), F.lit(0.0), lambda a, x: a + x).cast("int").alias("known"))


def hashed_merchants(spark, sf_dir):
    return txn_ties(spark, sf_dir).select(s.hashed_bin(F.col("merchant_name"), 16).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def rank_scaling(spark, sf_dir):
    return st.rank_share(txn_ties(spark, sf_dir), "operation_type", "amount").select("transaction_id", near("rank_share", 6).alias("rank_share"))


def reconstruction_error(spark, sf_dir):
    return models.reconstruction_error(read(spark, sf_dir, "embeddings"), "embedding", 8).select("vec_id", "error")


def _items(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    df = l.select(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("item"), s.relevance(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").alias("rel"), "l_quantity", "l_discount", F.struct("l_quantity", "l_partkey", "l_extendedprice", "l_discount", "l_tax").alias("tie"))
    df = df.withColumn("position", F.row_number().over(W.partitionBy("session").orderBy("tie")))
    ctr = df.groupBy("position").agg(F.avg((F.col("rel") > 0).cast("double")).alias("ctr"))
    return df.join(ctr, "position").withColumn("ipw", s.propensity_weight(F.nullif("ctr", F.lit(0.0))))


def learned_ranking(spark, sf_dir):
    df = select.key_split(_items(spark, sf_dir), "session")
    model = models.fit_ranker(df.where("part = 'train'"), ["l_quantity", "l_discount"], "rel", "ipw", 3, 5)
    return models.ranked(model, df.where("part = 'test'"), ["l_quantity", "l_discount"], "session", "tie").select("session", "item", "score", "rank")


def diversified_ranking(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    df = e.select((F.col("vec_id") % F.lit(25)).alias("session"), F.col("vec_id").alias("item"), ((F.col("vec_id") * 7919) % 1000 / 1000.0).alias("score"), "embedding")
    return ranking.diversified(df.withColumn("session", F.floor(F.col("item") / 20)), "session", "item", "score", "embedding", 5)


def plan_features(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    plan = F.element_at(F.array(*[F.lit(x) for x in ("Bronze", "Silver", "Gold", "Platinum")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    k = F.col("p_partkey")
    cover = ranking.coverage(k % 3, k % 2 == 0, k % 5, k % 7 < 3, k % 11 < 4, k % 13 == 0, plan)
    return p.select("p_partkey", near(cover).alias("coverage"), ranking.age_fit(k % 80 + 18, plan).alias("age_fit"), near(s.affordability(F.col("p_retailprice"), F.lit(60_000.0)), 6).alias("affordability"))


def oversampled(spark, sf_dir):
    df = _table(spark, sf_dir).withColumn("is_fraud", (F.col("transaction_id") % 97 == 0).cast("int"))
    return models.smote(df, "is_fraud", ["amount", "cnt_24h"], ["operation_type"], "transaction_id")


def _events_stream(spark, sf_dir, per_trigger=1):
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern may name a file or a folder


def _events_in_files(spark, sf_dir, batches=3):
    """(the events as a stream in ranges of time, in order, one a batch; how many slots of cards they take); a batch is several files where it is large."""
    e = read(spark, sf_dir, "events")
    us = micros("ts")
    n, cuts = e.agg(F.count(F.lit(1)), F.percentile_approx(us, [k / batches for k in range(1, batches)], 10_000)).first()
    at = F.size(F.filter(F.lit(cuts or []).cast("array<bigint>"), lambda c: c <= us))
    sizes = dict(e.where("ts IS NOT NULL").groupBy(at.alias("at")).count().collect())  # a row a batch
    files = max(1, min(n // (batches * FILE_ROWS), min([sizes.get(k, 0) for k in range(batches)]) // 1024))
    path = scratch(spark, "events")
    for k in range(batches):
        e.where(F.col("ts").isNotNull() & (at == k)).repartition(files).write.mode("append").parquet(path)  # dealt in turn, so no file is empty
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path), max(64, n // jobs.SLOT_ROWS)


def _payments(events):
    merchant = F.concat(F.lit("fraud_Shop "), F.get_json_object("props", "$.k"), F.lit(", Ltd."))
    return events.select(F.col("event_id").alias("transaction_id"), F.col("user_id").alias("cc_num"), F.col("event_type").alias("operation_type"), F.col("value").alias("amount"), merchant.alias("merchant_name"), (F.col("event_id") % 50 == 0).cast("int").alias("is_fraud"), micros("ts").alias("us")).withColumn("event_time", F.timestamp_micros("us"))


def _run(spark, df, mode="append", path=None):
    """Run a stream over what is there and return its rows; one that ran into the same path before goes on where it ended."""
    path = path or scratch(spark, "stream")
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _keyed_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_decisions(spark, sf_dir):
    """Rules on each arriving row, over features from keyed state and a threshold of all rows."""
    _keyed_state(spark)
    fitted = staged(ru.quantile_row(txn(spark, sf_dir).withColumn("abs_amount", F.abs("amount")), "abs_amount", {"p995": 0.995}), "fitted")
    events, slots = _events_in_files(spark, sf_dir)
    out = _run(spark, jobs.decide_stream(_payments(events).drop("event_time"), fitted, slots=slots))
    return out.select("transaction_id", "rule_high", "rule_new_high", "rule_rapid", "rule_score", "alert")


def stream_late_rows(spark, sf_dir):
    """Rows in time and late rows of a stream whose second file repeats the times of the first."""
    e = read(spark, sf_dir, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    path, out = scratch(spark, "events"), scratch(spark, "split")
    for k in (0, 1):
        half = e.where(F.col("event_id") % 2 == k)
        cut = F.lit(low + (high - low) * 0.75)
        half = e.where((F.col("event_id") % 2 == 1) | (F.col("ts") > cut)) if k else half.where(F.col("ts") <= cut)
        half.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.split_stream(_payments(stream), out, f"{out}-log").awaitTermination()
    read_back = lambda side: spark.read.parquet(f"{out}/{side}").agg(F.count(F.lit(1)).alias("n"), F.sum("transaction_id").alias("ids")).withColumn("side", F.lit(side))
    return read_back("main").unionByName(read_back("late"))


def stream_velocity(spark, sf_dir):
    """The batch velocity features from keyed state, over several batches."""
    _keyed_state(spark)
    events, slots = _events_in_files(spark, sf_dir)
    out = _run(spark, jobs.score_stream(_payments(events).drop("event_time"), slots=slots))
    return out.select("transaction_id", "cnt_1h", "cnt_6h", "cnt_24h", near("sum_24h").alias("sum_24h"), "new_merchant", "uniq_7d", "same_30d")


def stream_dedupe(spark, sf_dir):
    p = _payments(_events_stream(spark, sf_dir))
    return _run(spark, jobs.deduplicated(p.unionByName(p))).select("transaction_id")


def stream_alert_rate(spark, sf_dir):
    """Closed daily windows; the last day stays open and is not emitted."""
    out = _run(spark, jobs.tumbling(_payments(_events_stream(spark, sf_dir)), "event_time", "is_fraud", "1 day"))
    return out.select(F.unix_seconds("start").alias("start"), "n", near("rate", 6).alias("rate"))


def stream_drift(spark, sf_dir):
    """Drift of the amounts by type and day, against the first quarter of the time; rows that a last file brings late stand apart, by day."""
    e = read(spark, sf_dir, "events")
    low, high, n = e.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    path, out, drifts = scratch(spark, "events"), scratch(spark, "split"), scratch(spark, "stream")
    quarter, files = (high - low) / 4, max(1, n // (4 * FILE_ROWS))
    late = (F.col("event_id") % 50 == 7) & (F.col("ts") < F.lit(low + quarter))
    baseline = staged(jobs.drift_baseline(_payments(e.where(F.col("ts") < F.lit(low + quarter))), "amount", "operation_type"), "baseline")
    for k in range(5):  # what a quarter brings, and then what comes late, is a batch of each stream, in however many files it lies
        part = e.where(~late if k < 4 else late)
        part = part.where(F.col("ts") >= F.lit(low + k * quarter)) if 0 < k < 4 else part
        part = part.where(F.col("ts") < F.lit(low + (k + 1) * quarter)) if k < 3 else part
        part.repartition(files).write.mode("append").parquet(path)
        jobs.split_stream(_payments(spark.readStream.schema(e.schema).parquet(path)), out, f"{out}-log").awaitTermination()
        main = spark.readStream.schema(spark.read.parquet(f"{out}/main").schema).parquet(f"{out}/main")
        found = _run(spark, jobs.drift(main, baseline, "event_time", "amount", "operation_type"), path=drifts)
    day = F.floor(F.col("us") / 86_400_000_000) * 86_400
    aside = spark.read.parquet(f"{out}/late").groupBy("operation_type", day.alias("start")).agg(F.count(F.lit(1)).alias("late"))
    found = found.select("operation_type", F.unix_seconds("start").alias("start"), "n", near("psi", 5).alias("psi"), near("kl", 5).alias("kl"))
    return found.join(aside, ["operation_type", "start"], "left").na.fill(0, ["late"])


def stream_sliding_counts(spark, sf_dir):
    out = _run(spark, jobs.sliding(_payments(_events_stream(spark, sf_dir)), "event_time", "cc_num", "1 day", "12 hours"))
    return out.select("cc_num", F.unix_seconds("start").alias("start"), "n")


def stream_append(spark, sf_dir):
    """Batches appended to a partitioned table, as the incremental load does."""
    path = scratch(spark, "append")
    df = _payments(_events_stream(spark, sf_dir)).withColumn("dataset", F.concat(F.lit("d"), F.col("cc_num") % 3))
    jobs.append_stream(df, path, f"{path}-log").awaitTermination()
    return sinks.read_merged(spark, path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("transaction_id").alias("ids"))


def late_rows(spark, sf_dir):
    df = _payments(read(spark, sf_dir, "events"))
    early, late = jobs.split_late(df, "us", 1_705_000_000_000_000)
    return early.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("in time")).unionByName(late.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("late")))


def partitioned_append(spark, sf_dir):
    path = scratch(spark, "parts")
    df = txn_ties(spark, sf_dir).withColumn("dataset", F.when(F.col("cc_num") % 4 > 0, F.concat(F.lit("d"), F.col("cc_num") % 4)))
    sinks.append_parts(df.where("is_fraud = 0").drop("merchant_name"), path)
    sinks.append_parts(df.where("is_fraud = 1"), path)
    return sinks.read_merged(spark, path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("merchant_name").alias("named"))


def relational_append(spark, sf_dir):
    """A table that is created, then gains a column; a batch that comes twice counts once; read back."""
    url, driver = f"jdbc:derby:memory:ledger{scratch(spark, 'x')[-12:]};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.substring("c_mktsegment", 1, 20).alias("segment"))
    for name, rows in (("even", df.where("id % 2 = 0").drop("segment")), ("odd", df.where("id % 2 = 1")), ("odd", df.where("id % 2 = 1"))):
        sinks.append_table(rows, url, "customers", driver, name, "VARCHAR(100)", connections=2)
    back = spark.read.format("jdbc").options(url=url, dbtable="customers", driver=driver).load()
    return back.groupBy(F.col("segment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), near(F.sum("balance"), 2).alias("balance"))


def alert_files(spark, sf_dir):
    path = scratch(spark, "alerts")
    df = txn_ties(spark, sf_dir).withColumn("alert", (F.col("amount") > 200_000).cast("int"))
    sinks.write_alerts(df.where("alert = 1").select("transaction_id", "cc_num"), ru.alert_summary(df, "alert", "operation_type"), path)
    return readers.read_csv(spark, f"{path}/alerts").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("transaction_id").cast("long")).alias("ids"))


def lookup_versions(spark, sf_dir):
    path = scratch(spark, "lookups")
    df = txn_ties(spark, sf_dir)
    sinks.save_lookup(st.frequency(df.where("is_fraud = 1"), "merchant_name"), path, "frequency", 1)
    sinks.save_lookup(st.frequency(df, "merchant_name"), path, "frequency", 2)
    return sinks.load_lookup(spark, path, "frequency").select("merchant_name", near("freq", 6).alias("freq"))


QUERIES = {f.__name__: f for f in (isolation_forest, forest_grid, boosted_alerts, alert_reasons, attribution_summary, segment_models, grid_search, feature_ablation, forest_classifier, impute_medians, standardised, one_hot_merchants, hashed_merchants, rank_scaling, reconstruction_error, learned_ranking, diversified_ranking, plan_features, oversampled, stream_velocity, stream_decisions, stream_late_rows, stream_dedupe, stream_alert_rate, stream_drift, stream_sliding_counts, stream_append, late_rows, partitioned_append, relational_append, alert_files, lookup_versions)}

_PAIR = "cc_num, merchant_name"
_PLAN = "['Bronze', 'Silver', 'Gold', 'Platinum'][1 + p_partkey % 4]"
ORACLE_SQL = {name: near_sql(sql) for name, sql in {
    "impute_medians": f"WITH {TIES_SQL}, x AS (SELECT transaction_id, CASE WHEN transaction_id % 10 <> 0 THEN amount END AS a, CASE WHEN transaction_id % 11 <> 0 THEN operation_type END AS o FROM txn), t AS (SELECT * FROM x WHERE transaction_id % 2 = 0), m AS (SELECT o FROM t WHERE o IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, o LIMIT 1) SELECT transaction_id, NEAR(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM t)), 3) AS amount, coalesce(o, (SELECT o FROM m)) AS operation_type FROM x",
    "hashed_merchants": f"WITH {TIES_SQL} SELECT ('0x' || substr(md5(merchant_name), 1, 8))::BIGINT % 16 AS bin, count(*) AS n FROM txn GROUP BY 1",
    "standardised": f"WITH {TIES_SQL} SELECT transaction_id, NEAR((amount - avg(amount) OVER ()) / stddev_samp(amount) OVER (), 5) AS z FROM txn",
    "one_hot_merchants": f"WITH {TIES_SQL} SELECT transaction_id, CAST(count(*) OVER (PARTITION BY merchant_name) >= 406 AS INT) AS known FROM txn",
    "rank_scaling": f"WITH {TIES_SQL} SELECT transaction_id, NEAR(percent_rank() OVER (PARTITION BY operation_type ORDER BY amount), 6) AS rank_share FROM txn",
    "plan_features": f"WITH p AS (SELECT *, {_PLAN} AS plan, p_partkey AS k FROM part) SELECT p_partkey, NEAR((CASE WHEN k % 3 > 0 THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN k % 2 = 0 THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN k % 5 > 2 AND k % 7 < 3 THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN k % 5 > 2 AND k % 11 < 4 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN k % 13 = 0 AND plan IN ('Gold', 'Platinum') THEN 0.2 ELSE 0 END)::DOUBLE, 4) AS coverage, CASE WHEN (k % 80 + 18 < 30 AND plan IN ('Bronze', 'Silver')) OR (k % 80 + 18 BETWEEN 30 AND 54 AND plan IN ('Silver', 'Gold')) OR (k % 80 + 18 >= 55 AND plan IN ('Gold', 'Platinum')) THEN 1 ELSE 0 END AS age_fit, NEAR(p_retailprice * 12 / 60000, 6) AS affordability FROM p",
    "stream_velocity": _sql(f"""SELECT transaction_id, count(*) {_over(1, _H)} AS cnt_1h, count(*) {_over(6, _H)} AS cnt_6h, count(*) {_over(1, _D)} AS cnt_24h, NEAR(sum(abs(amount)) {_over(1, _D)}, 4) AS sum_24h, CAST(row_number() {_seq(_PAIR)} = 1 AS INT) AS new_merchant,
 count(DISTINCT merchant_name) {_over(7, _D)} AS uniq_7d, count(*) {_over(30, _D, _PAIR)} AS same_30d FROM o""", TXN_SQL),
    "stream_decisions": _sql(f"""SELECT transaction_id, a AS rule_high, CAST(a = 1 AND is_new AS INT) AS rule_new_high, CAST(n >= 10 AS INT) AS rule_rapid, a * 1.5::DOUBLE + CAST(a = 1 AND is_new AS INT) + CAST(n >= 10 AS INT) * 0.5::DOUBLE AS rule_score, CAST(a * 1.5::DOUBLE + CAST(a = 1 AND is_new AS INT) + CAST(n >= 10 AS INT) * 0.5::DOUBLE >= 2 AS INT) AS alert
 FROM (SELECT transaction_id, CAST(abs(amount) >= (SELECT quantile_cont(abs(amount), 0.995) FROM txn) AS INT) AS a, row_number() {_seq(_PAIR)} = 1 AS is_new, count(*) {_over(1, _D)} AS n FROM o)""", TXN_SQL),
    "stream_late_rows": f"WITH {TXN_SQL}, t AS (SELECT *, (SELECT min(us) + (max(us) - min(us)) * 3 // 4 FROM txn) AS cut FROM txn), f AS (SELECT *, transaction_id % 2 = 0 AND us <= cut AS first FROM t), l AS (SELECT transaction_id, NOT first AND us < (SELECT max(us) FROM f WHERE first) - 3600000000 AS late FROM f) SELECT count(*) AS n, CAST(sum(transaction_id) AS BIGINT) AS ids, CASE WHEN late THEN 'late' ELSE 'main' END AS side FROM l GROUP BY 3",
    "stream_dedupe": f"WITH {TXN_SQL} SELECT transaction_id FROM txn",
    "stream_drift": f"""WITH {TXN_SQL}, q AS (SELECT min(us) AS low, (max(us) - min(us)) / 4.0 AS quarter FROM txn), b AS (SELECT operation_type, amount FROM txn, q WHERE us < low + quarter),
 e AS (SELECT operation_type, quantile_cont(amount, [{', '.join(f'{k / 10}' for k in range(1, 10))}]) AS edges FROM b GROUP BY 1),
 m AS (SELECT transaction_id, operation_type, amount, us // 86400000000 * 86400 AS start, transaction_id % 50 = 7 AND us < low + quarter AS late FROM txn, q),
 x AS (SELECT operation_type, -1 AS start, amount FROM b UNION ALL SELECT operation_type, start, amount FROM m WHERE NOT late),
 c AS (SELECT operation_type, start, len(list_filter(edges, lambda v: v < amount)) AS bin, count(*) AS k FROM x JOIN e USING (operation_type) GROUP BY 1, 2, 3),
 g AS (SELECT operation_type, start, sum(k) AS n FROM c GROUP BY 1, 2),
 h AS (SELECT g.operation_type, g.start, g.n, greatest(coalesce(c.k, 0)::DOUBLE / g.n, 1e-4) AS share, i.bin FROM g CROSS JOIN (SELECT unnest(range(10)) AS bin) i LEFT JOIN c ON c.operation_type = g.operation_type AND c.start = g.start AND c.bin = i.bin),
 l AS (SELECT operation_type, start, count(*) AS late FROM m WHERE late GROUP BY 1, 2)
 SELECT c.operation_type, CAST(c.start AS BIGINT) AS start, CAST(any_value(c.n) AS BIGINT) AS n, NEAR(sum((c.share - b.share) * ln(c.share / b.share)), 5) AS psi, NEAR(sum(c.share * ln(c.share / b.share)), 5) AS kl, coalesce(any_value(l.late), 0) AS late
 FROM h c JOIN h b ON b.start = -1 AND b.operation_type = c.operation_type AND b.bin = c.bin LEFT JOIN l ON l.operation_type = c.operation_type AND l.start = c.start
 WHERE c.start >= 0 AND (c.start + 90000) * 1000000 <= (SELECT max(us) FROM txn) GROUP BY 1, 2""",
    "stream_alert_rate": f"WITH {TXN_SQL}, d AS (SELECT CAST(us // 86400000000 AS BIGINT) * 86400 AS start, is_fraud FROM txn) SELECT start, count(*) AS n, NEAR(avg(is_fraud), 6) AS rate FROM d GROUP BY 1 HAVING (start + 90000) * 1000000 <= (SELECT max(us) FROM txn)",
    "stream_sliding_counts": f"WITH {TXN_SQL}, d AS (SELECT cc_num, (us // 43200000000 - k) * 43200 AS start FROM txn, (VALUES (0), (1)) AS v(k)) SELECT cc_num, CAST(start AS BIGINT) AS start, count(*) AS n FROM d GROUP BY 1, 2 HAVING (start + 90000) * 1000000 <= (SELECT max(us) FROM txn)",
    "stream_append": f"WITH {TXN_SQL} SELECT concat('d', cc_num % 3) AS dataset, count(*) AS n, CAST(sum(transaction_id) AS BIGINT) AS ids FROM txn GROUP BY 1",
    "late_rows": f"WITH {TXN_SQL} SELECT count(*) AS n, 'in time' AS side FROM txn WHERE us >= 1705000000000000 UNION ALL SELECT count(*), 'late' FROM txn WHERE us < 1705000000000000",
    "partitioned_append": f"WITH {TIES_SQL} SELECT CASE WHEN cc_num % 4 > 0 THEN concat('d', cc_num % 4) END AS dataset, count(*) AS n, count(CASE WHEN is_fraud = 1 THEN 1 END) AS named FROM txn GROUP BY 1",
    "relational_append": "SELECT CASE WHEN c_custkey % 2 = 1 THEN left(c_mktsegment, 20) END AS segment, count(*) AS n, NEAR(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
    "alert_files": f"WITH {TIES_SQL} SELECT count(*) AS n, CAST(sum(transaction_id) AS BIGINT) AS ids FROM txn WHERE amount > 200000",
    "lookup_versions": f"WITH {TIES_SQL} SELECT merchant_name, NEAR(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS freq FROM txn GROUP BY 1",
}.items()}
