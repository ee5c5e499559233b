"""Daily states against a rescan, and what a refresh reads."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import rolling
from ledgerflow.sources.workspace import removed, scratch

ROWS = "day long, kind string, amount double"


def drawn(n=3000, days=120):
    rng = random.Random(12)
    rows = [(rng.randrange(days), rng.choice(["a", "b", None]), rng.choice([0.0, None, -rng.lognormvariate(3, 2), rng.lognormvariate(3, 2), 1e-12, 1e8 + rng.random()])) for _ in range(n)]
    return [r for r in rows if r[0] != 77]  # a day without rows


def test_ten_refreshes_equal_the_rescan(spark):
    rows = drawn()
    df = spark.createDataFrame(rows, ROWS)
    source = scratch(spark, "source")
    df.write.partitionBy("day").parquet(source)
    states = rolling.DailyStates(spark, scratch(spark, "states"), days=30)
    states.load(df.where("day <= 109"), "kind", "amount", "day")
    for day in range(110, 120):
        # what was taken in before is gone: a refresh can only read its own day
        removed(spark, f"{source}/day={day - 1}")
        own = spark.read.schema(ROWS).parquet(f"{source}/day={day}").drop("day")
        state = states.refresh(own, "kind", "amount", day)
        if day % 4 == 0:
            state = states.refresh(own, "kind", "amount", day)  # again: it counts once
    assert min(states.known()) == 90 and 77 not in states.known()
    got = {r["key"]: r for r in rolling.figures(state, {"median": 0.5, "p90": 0.9}).collect()}
    again = {r["key"]: r for r in rolling.figures(rolling.state_of(df.where("day >= 90"), "kind", "amount"), {"median": 0.5, "p90": 0.9}).collect()}
    assert got.keys() == {"a", "b", None}
    for key, r in got.items():
        values = sorted(v for d, k, v in rows if d >= 90 and k == key and v is not None)
        assert r["n"] == len(values) and r["mean"] == pytest.approx(statistics.fmean(values)) and r["std"] == pytest.approx(statistics.stdev(values))
        for name, q in (("median", 0.5), ("p90", 0.9)):
            assert r[name] == again[key][name] == pytest.approx(values[int((len(values) - 1) * q)], rel=rolling.ACCURACY * 1.0001, abs=1e-9)


def test_brackets_hold_their_accuracy(spark):
    df = spark.range(2000).select(((F.rand(5) - 0.5) * F.pow(10.0, F.rand(6) * 16 - 8)).alias("v"))
    off = df.withColumn("w", rolling.bracket_value(rolling.bracket(F.col("v")))).where("abs(v) > 1e-9").agg(F.max(F.abs(F.col("w") / F.col("v") - 1))).first()[0]
    assert off <= rolling.ACCURACY * 1.0001


def test_an_empty_day(spark):
    states = rolling.DailyStates(spark, scratch(spark, "states"))
    state = states.refresh(spark.createDataFrame([], ROWS), "kind", "amount", 5)
    assert rolling.figures(state, {"median": 0.5}).count() == 0
