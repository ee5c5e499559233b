import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import forest, metrics, models, ranking, rules


def test_forest_ranks_planted_outliers_on_top(spark):
    df = spark.range(500).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    odd = spark.createDataFrame([(1000, 90.0, 90.0), (1001, -70.0, 80.0)], "id long, a double, b double")
    df = df.unionByName(odd)
    nodes = forest.fit(df, ["a", "b"], "id", 40, 128)
    top = forest.score(df, nodes, ["a", "b"], 128).orderBy(F.desc("anomaly")).limit(2).collect()
    assert {r["id"] for r in top} == {1000, 1001} and 0.5 < top[0]["anomaly"] <= 1
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, forest.fit(df.repartition(7), ["a", "b"], "id", 40, 128).collect()))


def test_boosted_model_learns_and_explains(spark):
    df = spark.range(600).select("id", (F.col("id") % 10).cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b")).withColumn("y", (F.col("a") > 6).cast("int"))
    model = models.fit_boosted(df, ["a", "b"], "y", 2, 5)
    scored = models.probability(model, df, ["a", "b"])
    assert metrics.average_precision(scored, "p", "y").first()["ap"] == pytest.approx(1.0)
    why = {r["feature"]: r["mean_abs"] for r in models.importance(models.contributions(model, df, ["a", "b"], "id")).collect()}
    assert why["a"] > 10 * why["b"]
    cal = models.calibrated(models.fit_calibration(scored, "p", "y"), scored, "p")
    assert cal.agg(F.min("calibrated"), F.max("calibrated")).first() == (0.0, 1.0)


def test_perfect_and_empty_metrics(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.1, 0)], "id long, s double, y int")
    assert metrics.average_precision(df, "s", "y").first()["ap"] == 1.0 and metrics.roc_auc(df, "s", "y").first()["auc"] == 1.0
    assert metrics.roc_auc(df.withColumn("s", F.lit(0.5)), "s", "y").first()["auc"] == 0.5
    assert metrics.operating_cost(0.02) == (200, 500.0)


def test_smote_reaches_the_share(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), F.lit("n").alias("c"), (F.col("id") % 20 == 0).cast("int").alias("y"))
    made = models.smote(df, "y", ["a"], ["c"], "id", 0.2)
    assert 45 <= made.count() <= 105
    one_point = spark.range(3000).select("id", F.lit(1.0).alias("a"), F.lit("n").alias("c"), (F.col("id") < 600).cast("int").alias("y"))
    assert {r["a"] for r in models.smote(one_point, "y", ["a"], ["c"], "id", 0.4).collect()} == {1.0}


def test_diversified_prefers_unlike_items(spark):
    df = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.8, [0.0, 1.0])], "s long, i long, score double, v array<double>")
    assert [r["i"] for r in ranking.diversified(df, "s", "i", "score", "v", 2, 0.5).orderBy("place").collect()] == [1, 3]


def test_null_merchants_are_capped_as_one(spark):
    df = spark.createDataFrame([(k, 1, 1, None, float(k)) for k in range(5)], "id long, c long, d long, m string, s double")
    assert rules.capped(df, "c", "d", "m", [F.desc("s")]).count() == 2


def test_tau_guards(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,)], "s double")
    assert rules.tau(df, "s", 0.01).first()["tau"] < 0


def test_as_of_by_key_with_ties_and_gaps(spark):
    from ledgerflow.operators import joins

    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "a", 99), (4, "b", 10), (5, "a", 1), (6, None, 50)], "id long, k string, t long")
    rates = spark.createDataFrame([("a", 5, 1.0), ("a", 10, 2.0), ("a", 10, 2.0), ("b", 11, 3.0), ("a", 500, 9.0)], "k string, rt long, rate double")
    got = joins.as_of(rows, rates, "t", "rt", "rate", "k", bucket=20)
    assert sorted((r["id"], r["rate"]) for r in got.collect()) == [(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, None), (6, None)]


def test_usable_features_and_candidate_lift(spark):
    from ledgerflow.functions import scalars

    df = spark.range(1200).select(F.col("id").alias("transaction_id"), (F.col("id") * 7919 % 97).cast("double").alias("noise"), (F.col("id") * 31 % 101).cast("double").alias("signal"), F.lit("t").alias("s"))
    df = df.withColumn("y", (F.col("signal") > 98).cast("int")).withColumn("us", F.col("transaction_id"))
    assert scalars.usable_features(df, ["noise", "signal", "s", "absent", "transaction_id"], ("transaction_id",)) == ["noise", "signal"]
    rows = {r["candidate"]: r for r in models.candidate_lift(df, ["noise"], {"good": ["signal"], "bad": ["us"]}, "y", ["us"], "transaction_id", depth=2, rounds=3).collect()}
    assert rows["good"]["take"] and rows["good"]["lift_p_one"] > 0.5 and rows["good"]["lift_p_one"] > rows["bad"]["lift_p_one"]


def test_ranked_items_are_whole_and_in_order(spark):
    people = spark.createDataFrame([(1, 0.0), (2, 1.0)], "c long, likes double")
    items = spark.createDataFrame([(10, 0.0), (11, 1.0), (12, 0.5)], "i long, kind double")
    features = {"gap": F.abs(F.col("likes") - F.col("kind"))}
    learnt = people.crossJoin(items).withColumns(features).withColumns({"rel": 1 - F.col("gap"), "weight": F.lit(1.0)})
    model = models.fit_ranker(learnt, ["gap"], "rel", "weight", 2, 3)
    got = sorted((r["c"], r["rank"], r["i"]) for r in ranking.rank_items(people, items, features, model, "c", "i").collect())
    assert got == [(1, 1, 10), (1, 2, 12), (1, 3, 11), (2, 1, 11), (2, 2, 12), (2, 3, 10)]
    assert ranking.rank_items(people, items, features, model, "c", "i", top=1).count() == 2
