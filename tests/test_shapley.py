"""Shapley values against all subsets of features, and against the model's own margin."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerflow.operators import models, shapley

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def fitted(spark):
    columns = {c: (F.col("id") * k % m).cast("double") for c, k, m in (("a", 7, 23), ("b", 31, 17), ("c", 13, 11))}
    df = spark.range(900).withColumns(columns).withColumn("d", F.col("a") + F.col("id") % 2)  # d goes with a
    df = df.withColumn("y", ((F.col("a") > 11) & (F.col("b") < 9) | (F.col("c") > 8) & (F.col("d") > 5)).cast("int"))
    return df, models.fit_boosted(df, COLUMNS, "y", 4, 4)


def known_value(node, x, known):
    """What a tree gives for the known features of a row, by walking it."""
    if not node.subtreeDepth():
        return node.prediction()
    f, rows = node.split().featureIndex(), node.impurityStats().count()
    if f in known:
        return known_value(node.leftChild() if x[f] <= node.split().threshold() else node.rightChild(), x, known)
    return sum(known_value(c, x, known) * c.impurityStats().count() / rows for c in (node.leftChild(), node.rightChild()))


def test_values_equal_all_subsets(fitted):
    _, model = fitted
    rng = np.random.default_rng(2)
    x = np.vstack([rng.uniform(-2, 25, (12, 4)), [[np.nan, 3.0, 9.0, 6.0]]])
    got = shapley.values(shapley.trees(model), x)
    roots = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees)]
    for row, found in zip(x, got):
        value = {s: sum(w * known_value(r, row, s) for w, r in roots) for k in range(5) for s in combinations(range(4), k)}
        for j in range(4):
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (value[tuple(sorted((*s, j)))] - value[s]) for s in value if j not in s)
            assert found[j] == pytest.approx(want, abs=1e-9)


def test_contributions_sum_to_the_margin(fitted):
    df, model = fitted
    wide = df.limit(300)
    sums = models.contributions(model, wide, COLUMNS, "id", None).groupBy("id").agg(F.sum("contribution").alias("s"), F.count(F.lit(1)).alias("n"))
    margin = model.transform(models.assemble(wide, COLUMNS)).select("id", vector_to_array("rawPrediction")[1].alias("margin"))
    base = models.expected_margin(model)
    rows = sums.join(margin, "id").collect()
    assert len(rows) == 300 and all(r["n"] == 4 and r["s"] == pytest.approx(r["margin"] - base, abs=1e-9) for r in rows)
    assert models.contributions(model, wide, COLUMNS, "id", 2).groupBy("id").count().agg(F.max("count")).first()[0] == 2


def test_a_tree_of_one_leaf_has_no_values():
    leaf = shapley.Leaf(2.0, (), (), (), ())
    assert shapley.values([[leaf]], np.ones((3, 2))).tolist() == [[0.0, 0.0]] * 3 and shapley.expectation([[leaf]]) == 2.0
