"""Fits hold a bounded number of rows in a task, however few files their rows come from; forests score by tables that are ready."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ledgerflow.operators import forest, models


@pytest.mark.parametrize("fit", ["boosted", "held", "forest", "ranker"])
def test_a_fit_deals_its_rows(spark, monkeypatch, fit):
    monkeypatch.setattr(models, "ROWS", 100, raising=False)
    seen = []
    for kind in (GBTClassifier, RandomForestClassifier, GBTRegressor):
        real = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, df, real=real: seen.append([r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]) or real(self, df))
    df = spark.range(0, 2000, 1, 1).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 100).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 100 > 80).cast("int").alias("y"), (F.col("id") % 10 == 0).alias("h"), F.lit(1.0).alias("w"))
    model = {
        "boosted": lambda: models.fit_boosted(df, ["a", "b"], "y", 2, 2), "held": lambda: models.fit_boosted(df, ["a", "b"], "y", 2, 2, held="h"),
        "forest": lambda: models.fit_forest(df, ["a", "b"], "y", 3), "ranker": lambda: models.fit_ranker(df, ["a", "b"], "y", "w", 2, 2),
    }[fit]()
    assert sum(seen[0]) == 2000 and max(seen[0]) <= 120
    best = model.transform(models.assemble(df, ["a", "b"])).groupBy("y").agg(F.avg("prediction").alias("p"))
    assert {r["y"]: r["p"] > 0.5 for r in best.collect()} == {0: False, 1: True}


def test_paths_of_a_tree_are_ready():
    tree = pd.DataFrame([(0, 1, 0, 5.0, 10.0), (0, 2, -1, 0.0, 4.0), (0, 3, 1, 1.0, 6.0), (0, 6, -1, 0.0, 1.0), (0, 7, -1, 0.0, 5.0)], columns=["tree", "node", "feature", "cut", "size"])
    feature, cut, path = forest._dense(tree)
    assert feature[[1, 2, 3, 6, 7]].tolist() == [0, -1, 1, -1, -1] and cut[[1, 3]].tolist() == [5.0, 1.0]
    assert np.array_equal(path[[2, 6, 7]], [1 + forest.expected_path(4), 2.0, 2 + forest.expected_path(5)])
