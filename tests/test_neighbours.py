"""Exact neighbours against all pairs: duplicates, names, clusters, ties, nulls and few rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import models, neighbours

ROWS = "id long, a double, b double, c string, d string"


def drawn(n=700):
    rng = random.Random(6)
    rows = [(k, rng.gauss(0, 1), rng.gauss(0, 5), rng.choice("xyz"), rng.choice([None, "p"])) for k in range(n)]
    rows += [(n + k, 3.0, 3.0, "x", "p") for k in range(350)]  # one point holds a third of the rows
    rows += [(3 * n + k, float(k % 6), float(k // 6), "x", None) for k in range(36)] + [(5 * n, None, None, None, None), (5 * n + 1, 1e6, -1e6, "far", "p")]
    rng.shuffle(rows)
    return rows


def brute(rows, own, k):
    x = lambda r: [(v or 0.0) / s for v, s in zip(r[1:3], own.scales)]
    out = {}
    for r in rows:
        gaps = [(math.sqrt(sum((p - q) ** 2 for p, q in zip(x(r), x(o))) + own.unlike**2 * sum(p != q for p, q in zip(r[3:], o[3:]))), o[0]) for o in rows if o[0] != r[0]]
        out[r[0]] = sorted(gaps)[:k]
    return out


@pytest.mark.parametrize("scaled, pivots, chunk, block", [(True, 1024, 4096, 1 << 16), (False, 9, 7, 5), (True, 1, 100, 50)])
def test_neighbours_are_exact(spark, scaled, pivots, chunk, block):
    rows = drawn()
    df = spark.createDataFrame(rows, ROWS)
    own = neighbours.space(df, ["a", "b"], ["c", "d"], scaled)
    assert own.unlike == (1.0 if scaled else pytest.approx(sum(neighbours.space(df, ["a", "b"], []).scales) / 2))
    want = brute(rows, own, 4)
    near, _ = neighbours.nearest(df, own, "id", 4, pivots, chunk, block)
    got = {r["id"]: [(o["gap"], o["id"]) for o in r["near"]] for r in near.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert [g for g, _ in got[k]] == pytest.approx([g for g, _ in want[k]], abs=1e-9), k
        strict = [i for (g, i), (h, _) in zip(want[k], want[k][1:]) if h - g > 1e-6]
        assert {i for _, i in got[k]} >= set(strict)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "x", None), (2, 0.0, 1.0, "x", None)], ROWS)
    own = neighbours.space(df, ["a", "b"], ["c"])
    assert {r["id"]: [o["id"] for o in r["near"]] for r in neighbours.nearest(df, own, "id", 5)[0].collect()} == {1: [2], 2: [1]}
    assert neighbours.nearest(df.limit(0), own, "id", 5)[0].count() == 0


def test_a_point_meets_few_others(spark):
    """Clusters far apart: what is searched grows with the rows, not with their square."""
    df = spark.range(4000).select("id", ((F.col("id") % 40) * 1000 + F.rand(3)).alias("a"), F.rand(4).alias("b"), F.lit("x").alias("c"), F.lit("x").alias("d"))
    own = neighbours.Space(("a", "b"), (), (1.0, 1.0), 1.0)
    found = []
    real = neighbours.staged
    try:
        neighbours.staged = lambda d, name: found.append((name, real(d, name))) or found[-1][1]
        neighbours.nearest(df, own, "id", 5)[0].count()
    finally:
        neighbours.staged = real
    searches = dict(found)["searches"].join(dict(found)["cells"].groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    assert searches < 4000 * 4000 / 20


def test_smote_lies_between_neighbours_and_takes_their_names(spark):
    rows = [(k, float(k // 100) * 100 + (k % 10) / 10, "u" if k // 100 < 2 else "v", int(k < 400)) for k in range(4000)]
    made = models.smote(spark.createDataFrame(rows, "id long, a double, c string, y int"), "y", ["a"], ["c"], "id", 0.3).collect()
    assert 900 < len(made) < 1400
    assert all(0 <= r["a"] % 100 <= 0.9 + 1e-9 and r["c"] == ("u" if r["a"] < 200 else "v") for r in made)
