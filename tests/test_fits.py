"""Model runs over segments, grids, blocks and variants, and the fits that no other test reaches."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerflow.operators import forest, metrics, models, quantiles, select, stats


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1600).select("id", F.col("id").alias("us"), (F.col("id") * 7919 % 101).cast("double").alias("a"), (F.col("id") * 31 % 17).cast("double").alias("b"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"))
    df = df.withColumn("y", F.when(F.col("kind") == "k0", F.col("a") > 80).otherwise(F.col("b") > 13).cast("int")).withColumn("part", F.when(F.col("id") < 1200, "train").otherwise("test"))
    return models.staged(df, "rows")


def test_segments_have_models_of_their_own(spark, rows):
    small = rows.unionByName(rows.where("id % 100 = 0").withColumn("kind", F.lit("rare")))
    scored = models.by_segment(small, "kind", ["a", "b"], "y", top=3, least=100, depth=3, rounds=4)
    assert scored.count() == small.where("part = 'test'").count()
    for segment in ("k0", "k1", "k2"):
        assert metrics.roc_auc(scored.where(F.col("segment") == segment), "p", "y").first()["auc"] > 0.95
    assert {r["p"] for r in scored.where("segment = 'OTHER'").select("p").collect()} == {0.0}


def test_grid_tries_all_combinations(rows):
    found = models.grid(rows.drop("part"), ["a", "b"], "y", ["us", "id"], "id", {"depth": [1, 3], "least": [5, 50], "gain": [0.0, 0.01], "rounds": [2]}).collect()
    assert len(found) == 16 and len({(r["depth"], r["least"], r["gain"], r["fold"]) for r in found}) == 16
    mean = lambda d: np.mean([r["ap"] for r in found if r["depth"] == d])
    assert mean(3) > mean(1)


def test_blocks_add_what_they_know(rows):
    train, test = (rows.where(F.col("part") == p) for p in ("train", "test"))
    found = {r["block"]: r["ap"] for r in models.ablation(train, test, {"first": ["a"], "second": ["b"]}, "y", "id", depth=4, rounds=4).collect()}
    assert found.keys() == {"first", "second"} and found["second"] > found["first"] + 0.2
    variants = {r["variant"]: r for r in models.compare_variants(train, test, {"small": ["a"], "whole": ["a", "b"]}, "y", "id", depth=4, rounds=4).collect()}
    assert variants["whole"]["features"] == 2 and variants["whole"]["auc"] > variants["small"]["auc"] and variants["whole"]["ap"] == pytest.approx(found["second"])


def test_forest_and_ranker_learn(rows):
    train, test = (rows.where((F.col("part") == p) & (F.col("kind") == "k0")) for p in ("train", "test"))
    model = models.fit_forest(train, ["a", "b"], "y", 8)
    assert metrics.roc_auc(models.probability(model, test, ["a", "b"]), "p", "y").first()["auc"] > 0.95
    ranker = models.fit_ranker(train.withColumn("w", F.lit(1.0)), ["a", "b"], "y", "w", 3, 4)
    ranked = models.ranked(ranker, test.withColumn("s", F.col("id") % 5), ["a", "b"], "s", "id").collect()
    for s in range(5):
        own = sorted((r for r in ranked if r["s"] == s), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)
        assert sum(r["y"] for r in own[: sum(r["y"] for r in own)]) >= 0.8 * sum(r["y"] for r in own)


def test_reconstruction_error_by_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6)) + rng.normal(scale=0.1, size=(80, 6))
    x[7] += [0, 5, 0, -5, 0, 0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["error"] for r in models.reconstruction_error(df, "v", 2).collect()}
    centred = x - x.mean(axis=0)
    parts = np.linalg.svd(centred, full_matrices=False)[2][:2]
    want = ((centred - centred @ parts.T @ parts) ** 2).mean(axis=1)
    assert [got[k] for k in range(80)] == pytest.approx(want.tolist(), abs=1e-9) and max(got, key=got.get) == 7


def test_isolation_scores_do_not_depend_on_rows_order(spark):
    df = spark.range(300).select("id", (F.col("id") % 19).cast("double").alias("a"))
    scores = [sorted(map(tuple, forest.score(d, forest.fit(d, ["a"], "id", 10, 64), ["a"], 64).select("id", "anomaly").collect())) for d in (df, df.repartition(5).orderBy(F.desc("id")))]
    assert scores[0] == scores[1]


def test_a_vocabulary_of_any_size(spark):
    df = spark.range(36_000).select("id", F.when(F.col("id") % 12_001 != 5, F.concat(F.lit("m"), F.col("id") % 12_000)).alias("m"))
    words = models.vocabulary(df, "m", 3)
    n = words.count()
    assert 11_990 < n <= 12_000 and sorted(r["place"] for r in words.collect()) == list(range(n))
    out = models.one_hot_frequent(df.where("id < 200").unionByName(df.limit(1).withColumn("m", F.lit("other"))), "m", words, "hot").select("m", "hot").collect()
    places = {r["value"]: r["place"] for r in words.collect()}
    for r in out:
        assert r["hot"].size == n and list(r["hot"].indices) == ([places[r["m"]]] if r["m"] in places else [])


def keyed(n=900):
    rng = random.Random(2)
    return [(k, "hot" if k % 3 == 0 else rng.choice(["x", "y", None]), rng.choice([None, *map(float, range(9))])) for k in range(n)] + [(n, "lone", 5.0)]


def test_figures_beside_their_rows(spark):
    rows = keyed()
    df = spark.createDataFrame(rows, "id long, k string, v double")
    share = {r["id"]: r["s"] for r in stats.rank_share(df, "k", "v", "s").collect()}
    risk = {r["id"]: r["risk"] for r in stats.entity_risk(df.withColumn("y", (F.col("id") % 2).cast("int")), "k", "y").collect()}
    z = {r["id"]: r["category_z"] for r in stats.category_z(df, "k", "v").collect()}
    anonymous = {r["id"]: r["k"] for r in stats.k_anonymous(df, ["k"], 2).collect()}
    low = lambda v: -math.inf if v is None else v
    assert len(share) == len(risk) == len(z) == len(anonymous) == len(rows)
    for i, k, v in rows:
        own = [r for r in rows if r[1] == k]
        assert share[i] == pytest.approx(sum(low(r[2]) < low(v) for r in own) / max(1, len(own) - 1))
        assert risk[i] == pytest.approx(sum(r[0] % 2 for r in own) / len(own)) and anonymous[i] == (k if len(own) > 1 else None)
        values = [r[2] for r in own if r[2] is not None]
        std = np.std(values, ddof=1) if len(values) > 1 else 1.0
        assert z[i] == (None if v is None else pytest.approx((v - np.mean(values)) / std))
    codes = {r["k"]: r["c"] for r in select.label_index(df, "k", "c").collect()}
    assert codes == {"hot": 0, "lone": 1, "x": 2, "y": 3, None: None}
    for found in (stats.rank_share(df, "k", "v", "s"), stats.category_z(df, "k", "v"), stats.entity_risk(df.withColumn("y", F.lit(1)), "k", "y")):
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().replace("WindowGroupLimit", "").split("Relation")[0]


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    rng = random.Random(5)
    values = [rng.lognormvariate(0, 3) for _ in range(20_000)]
    df = models.staged(spark.createDataFrame([("a", v) for v in values] + [("b", -v) for v in values], "k string, v double"), "values")
    at = {"m": (0.5, lambda n, _: (n - 1) * 0.9)}  # the bracket is taken around the wrong share
    got = {r["k"]: r["m"] for r in quantiles.at_places(df, "v", at, "k").collect()}
    assert got == {"a": pytest.approx(float(np.quantile(values, 0.9))), "b": pytest.approx(float(np.quantile([-v for v in values], 0.9)))}
    assert quantiles.at_places(df.where("k = 'a'").drop("k"), "v", at).first()["m"] == pytest.approx(float(np.quantile(values, 0.9)))
