"""Queries that compare fits run them whole: all rounds and levels of the reference."""

import pytest
from conftest import DATA
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from ledgerflow.operators import models
from ledgerflow.plans import catalogue

#: How many fits, rounds, depths and largest number of features.
WHOLE = {"candidate_lift": (6, 200, {8}, 4), "feature_ablation": (3, 300, {8}, 6), "model_variants": (3, 200, {8}, 6), "grid_search": (16, 300, {6, 8}, 6)}


@pytest.mark.parametrize("name", WHOLE)
def test_fits_are_whole(spark, monkeypatch, name):
    seen, real = [], GBTClassifier.fit

    def fit(self, df):
        seen.append((self.getMaxIter(), self.getMaxDepth(), self.getMinInfoGain(), self.isSet("validationIndicatorCol"), self.getSubsamplingRate(), len(df.first()["features"])))
        return real(self.copy().setMaxIter(1).setMaxDepth(2), df)

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    assert catalogue.QUERIES[name](spark, DATA).count()
    fits, rounds, depths, features = WHOLE[name]
    assert len(seen) == fits and {s[1] for s in seen} == depths and max(s[5] for s in seen) == features
    for own_rounds, _, gain, stops, share, _ in seen:
        assert own_rounds == rounds and gain <= 1e-4 and not stops and share == 1.0


def test_small_tables_are_few_tasks_and_large_fits_run_alone(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 12).select((F.col("id") % 10).alias("a"), (F.col("id") % 2).alias("y"))
    assert models.learnt(df, ["a"], "y").rdd.getNumPartitions() == 1 and models.beside(df) == 8
    monkeypatch.setattr(models, "SIDE", 2500)
    assert models.beside(df) == 2 and models.beside(df.unionAll(df).unionAll(df)) == 1
