"""Exact order statistics by brackets and ranks equal the plain ones, with hot, small, empty and null keys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import quantiles, select

AT = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p995": 0.995, "top": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    hot = spark.range(30_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    ties = spark.range(9_000).select(F.lit("ties").alias("k"), (F.col("id") % 3).cast("double").alias("v"))
    few = spark.createDataFrame([("few", 3.0), ("few", 1.0), ("few", None), (None, 5.0), (None, 6.0), ("none", None)], "k string, v double")
    return hot.unionByName(ties).unionByName(few).cache()


def plain(rows):
    by = {}
    for r in rows.collect():
        by.setdefault(r["k"], []).append(r["v"])
    return by


def test_quantiles_by_key(rows):
    got = {r["k"]: r for r in quantiles.quantiles(rows, "v", AT, "k", small=0).collect()}
    same = {r["k"]: r for r in quantiles.quantiles(rows, "v", AT, "k").collect()}
    for key, values in plain(rows).items():
        known = [v for v in values if v is not None]
        for name, q in AT.items():
            want = float(np.quantile(known, q)) if known else None
            assert got[key][name] == pytest.approx(want) and same[key][name] == pytest.approx(want), (key, name)
    assert set(got) == set(same)


def test_quantiles_of_all_rows(rows, spark):
    known = [v for vs in plain(rows).values() for v in vs if v is not None]
    row = quantiles.quantiles(rows, "v", AT, small=0).first()
    assert all(math.isclose(row[n], float(np.quantile(known, q))) for n, q in AT.items())
    for small in (0, 10):
        empty = quantiles.quantiles(rows.limit(0), "v", AT, small=small).collect()
        assert len(empty) == 1 and empty[0]["mid"] is None


def test_kth_largest_by_key(rows):
    for share in (0.01, 0.5, 1.0):
        small = {r["k"]: r["threshold"] for r in select.kth_largest(rows, "k", "v", share).collect()}
        large = {r["k"]: r["threshold"] for r in quantiles.kth_largest(rows, "k", "v", share, small=0).collect()}
        for key, values in plain(rows).items():
            k, known = max(1, int(len(values) * share)), sorted((v for v in values if v is not None), reverse=True)
            want = known[k - 1] if k <= len(known) else None
            assert large[key] == want and small.get(key) == want, (key, share)
