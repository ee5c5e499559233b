"""Streams over several batches: rows in order equal the batch windows, late rows never see later ones."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import models, quantiles, rules, select
from ledgerflow.operators import windows as w
from ledgerflow.streaming import jobs

SCHEMA = "transaction_id long, cc_num long, us long, amount double, merchant_name string"
HOUR, DAY = jobs.HOUR, jobs.DAY
START = 1_700_000_000_000_000


def brute(rows):
    """The features of each row of the rows at or before it, in order of (time, id)."""
    out = {}
    for i, c, t, a, m in rows:
        before = [r for r in rows if r[1] == c and (r[2], r[0]) <= (t, i)]
        near = lambda span: [r for r in before if r[2] >= t - span]  # noqa: B023, E731
        out[i] = (len(near(HOUR)), len(near(6 * HOUR)), len(near(DAY)), round(sum(abs(r[3] or 0) for r in near(DAY)), 6), int(not [r for r in before if r[4] == m and r[0] != i]), len({r[4] for r in near(7 * DAY)} - {None}), len([r for r in near(30 * DAY) if r[4] == m]))
    return out


def features(rows):
    return {r["transaction_id"]: (r["cnt_1h"], r["cnt_6h"], r["cnt_24h"], round(r["sum_24h"] or 0, 6), r["new_merchant"], r["uniq_7d"], r["same_30d"]) for r in rows}


def run(spark, batches, tmp_path, make):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def test_velocity_over_batches_with_late_rows(spark, tmp_path):
    row = lambda i, hours, merchant="a", card=1, amount=2.5: (i, card, START + int(hours * HOUR), amount, merchant)
    first = [row(1, 0), row(2, 0.5, "b"), row(3, 30, "a", amount=-4.0), row(4, 100), row(5, 100, "c", 2), row(6, 100, None, 2, None)]
    late = [row(7, 99.5, "z"), row(8, 99.5, "a"), row(9, 101, "z"), row(10, 24 * 20, "b"), row(11, 24 * 20, None, 2)]
    last = [row(12, 24 * 40, "a"), row(13, 24 * 40, "b"), row(14, 24 * 20 + 0.2 - 0.5, "a")]
    got = features(run(spark, [first, late, last], tmp_path, jobs.score_stream))
    everything = first + late + last
    want = brute(everything)
    assert set(got) == set(want)
    # rows that came in time see what had come by then, late ones all rows before them
    for i in (1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 14):
        assert got[i] == want[i], i
    assert got[4] == brute(first)[4] and got[10] == brute(first + late)[10] and got[7][0] == 1 and got[8][2] == 2


def test_many_rows_of_one_card(spark, tmp_path):
    rows = [(i, 1, START + i * 60_000_000, float(i % 7), f"m{i % 50}") for i in range(12_000)]
    got = features(run(spark, [rows[:6000], rows[6000:]], tmp_path, jobs.score_stream))
    batch = w.same_counts(w.diversity(w.first_seen(w.velocity(w.prepared(spark.createDataFrame(rows, SCHEMA))), "merchant_name", "new_merchant")))
    want = {r["transaction_id"]: (r["cnt_1h"], r["cnt_6h"], r["cnt_24h"], round(r["sum_24h"], 6), r["new_merchant"], r["uniq_7d"], r["same_30d"]) for r in batch.collect()}
    assert got == want


def test_model_scores_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = [(i, i % 5, START + i * HOUR // 3, float(i * 7919 % 500), f"m{i % 11}") for i in range(300)]
    table = w.first_seen(w.velocity(w.prepared(spark.createDataFrame(rows, SCHEMA))), "merchant_name", "new_merchant").withColumn("y", (F.col("amount") > 400).cast("int"))
    columns = ["amount", "cnt_24h", "sum_24h", "new_merchant"]
    model = models.fit_boosted(table, columns, "y", 2, 3)
    want = {r["transaction_id"]: r["p"] for r in models.probability(model, table, columns).collect()}
    got = {r["transaction_id"]: r["p"] for r in run(spark, [rows[:150], rows[150:]], tmp_path, lambda p: jobs.predict_stream(p, model, columns))}
    assert got == pytest.approx(want)


def test_rules_on_a_stream(spark, tmp_path):
    rows = [(i, i % 3, START + i * HOUR // 2, float(i * 7919 % 500), f"m{i % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = quantiles.quantiles(df.withColumn("abs_amount", F.abs("amount")), "abs_amount", {"p995": 0.9})
    batch = w.first_seen(w.velocity(w.prepared(df)), "merchant_name", "is_new_merchant").withColumn("abs_amount", F.abs("amount"))
    want = {r["transaction_id"]: r["rule_score"] for r in rules.rules_b(batch, fitted).collect()}
    got = run(spark, [rows[:90], rows[90:]], tmp_path, lambda p: jobs.decide_stream(p, fitted))
    assert {r["transaction_id"]: r["rule_score"] for r in got} == want and {r["alert"] for r in got if r["rule_score"] >= 2} <= {1}


def test_a_repeated_batch_appends_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "d1"), (2, "d2")], "id long, dataset string")
    df.write.parquet(str(tmp_path / "in"))
    for log in ("log1", "log2"):
        jobs.append_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / log)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_late_rows_of_a_stream_go_aside(spark, tmp_path):
    batches = [[(1, 1, 10 * HOUR, 1.0, "a")], [(2, 1, 9 * HOUR + 1, 1.0, "a"), (3, 1, 8 * HOUR, 1.0, "a")], [(4, 1, 20 * HOUR, 1.0, "a")], [(5, 1, 18 * HOUR, 1.0, "a")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for log in ("log1", "log2"):  # run again from nothing: the same folders, the same rows
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.split_stream(stream, str(tmp_path / "out"), str(tmp_path / log)).awaitTermination()
        sides = {side: sorted(r[0] for r in spark.read.parquet(str(tmp_path / f"out/{side}")).select("transaction_id").collect()) for side in ("main", "late")}
        assert sides == {"main": [1, 2, 4], "late": [3, 5]}


def test_stopping_early_and_choosing_features(spark):
    df = spark.range(800).select("id", (F.col("id") * 7919 % 101).cast("double").alias("a"), (F.col("id") * 31 % 17).cast("double").alias("b"), (F.col("id") % 5 == 0).alias("held"))
    noise = df.withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).cast("int"))
    assert models.fit_boosted(noise, ["a", "b"], "y", 2, 20, held="held").getNumTrees < 20
    model = models.fit_boosted(df.withColumn("y", (F.col("a") > 50).cast("int")), ["a", "b"], "y", 2, 5)
    assert models.selected_features(model, ["a", "b"]) == ["a"]


def test_stratified_draws_agree_and_have_their_shares(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("label"))
    a, b = (select.stratified(d, "label", {"x": 0.5}, "id") for d in (df, df.repartition(7)))
    counts = defaultdict(int)
    for r in a.collect():
        counts[r["label"]] += 1
    assert 430 < counts["x"] < 570 and counts["y"] == 0 and {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}


def test_drift_over_batches(spark, tmp_path):
    schema = "us long, kind string, amount double"
    day = 24 * HOUR
    base = [(0, k, float(i)) for k in ("a", None) for i in range(100)] + [(0, "a", None)] * 25
    batches = [[(d * day + i * HOUR // 2, k, None if i % 10 == 3 else float(i * (1 + d * d))) for d in days for k in ("a", None, "new") for i in range(40)] for days in ((10, 11), (12,), (13, 14), (15,))]
    batches[3].append((10 * day + 5, "a", 1e9))  # its window is closed
    df = spark.createDataFrame(base, schema)
    fitted = jobs.drift_baseline(df, "amount", "kind", bins=5)
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("t", F.timestamp_micros("us"))
    found = jobs.drift(stream, fitted, "t", "amount", "kind", bins=5)
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = {(r["kind"], r["start"].day): r for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}
    assert set(rows) == {(k, d + 1) for k in ("a", None) for d in (10, 11, 12, 13, 14)}  # each once, the last day is open
    from ledgerflow.operators import stats

    for (kind, d), r in rows.items():
        now = [x for b in batches[: 3] for x in b if x[1] == kind and x[0] // day == d - 1]
        want = stats.psi(df.where(F.col("kind").eqNullSafe(kind)), spark.createDataFrame(now, schema), "amount", 5).first()
        assert r["n"] == 40 and r["nulls"] == pytest.approx(0.1) and r["null_gap"] == pytest.approx(0.1 - (0.2 if kind else 0.0))
        assert (r["psi"], r["kl"]) == (pytest.approx(want["psi"]), pytest.approx(want["kl"]))
