"""Rings and components against union-find, with hubs of a third of all rows, chains and nulls."""

import random
from collections import Counter

from ledgerflow.operators import graphs as g


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(1000, 1060)] + [(5, k) for k in range(6, 400)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges += [(None, 3), (4, None), (77777, 77777), (1060, 1000), (6, 5)]
    rng.shuffle(edges)
    want = {x: c for x, c in brute(e for e in edges if e[0] != e[1]).items()}
    for heavy, few in ((g.HEAVY, g.FEW), (4, 0)):
        got = {r["node"]: r["component"] for r in g.components(spark.createDataFrame(edges, "a long, b long"), heavy, few).collect()}
        assert got == want
    assert g.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rings_with_a_device_of_a_third_of_the_rows(spark):
    rng = random.Random(7)
    uses = [("hub", c, int(c % 50 == 0)) for c in range(600)] + [(f"d{rng.randrange(700)}", 1000 + rng.randrange(800), int(rng.random() < 0.1)) for _ in range(1200)]
    uses += [(None, 5000, 1), ("d1", None, 1), (None, 3, 1), ("lone", 6000, None), ("lone", 6000, 1)]
    rng.shuffle(uses)
    top = brute(((0, c, ""), (1, 0, d)) for d, c, _ in uses if d is not None and c is not None)
    ring = {c: top.get((0, c, ""), (0, c, ""))[1] for _, c, _ in uses if c is not None}
    members, confirmed = Counter(ring.values()), Counter()
    devices = Counter(v[1] for k, v in top.items() if k[0] == 1)
    for _, c, f in uses:
        if c is not None:
            confirmed[ring[c]] += f or 0
    want = {(c, r, members[r], devices[r], confirmed[r]) for c, r in ring.items()}
    df = spark.createDataFrame(uses, "device string, customer long, fraud int")
    for heavy, few in ((g.HEAVY, g.FEW), (2, 0)):
        rows = g.rings(df, "device", "customer", "fraud", heavy, few).collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_a_hub_is_not_shuffled(spark):
    rows = spark.createDataFrame([(1 if k % 3 == 0 else k, k) for k in range(300)], "a long, b long")
    facts = rows.groupBy("a").count()
    joined = g.heavy_join(rows, facts.withColumn("x", facts["a"] * 2), "a", "count", 10, 0)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted((a, b, a * 2) for a, b in map(tuple, rows.collect()))


def test_keys_of_one_member_add_no_edge(spark, monkeypatch):
    uses = [(f"own{k}", k % 40, k % 2) for k in range(400)] + [("both", 3, 1), ("both", 7, 0), ("both", 3, 0)]
    real, seen = g.components, []
    monkeypatch.setattr(g, "components", lambda edges, *more: seen.append(edges.where("a <> b").count()) or real(edges, *more))
    rows = {r[0]: tuple(r)[1:] for r in g.rings(spark.createDataFrame(uses, "device string, customer long, fraud int"), "device", "customer", "fraud").collect()}
    assert seen == [1] and rows[7] == rows[3] == (3, 2, 21, 21) and rows[1] == (1, 1, 10, 10) and len(rows) == 40
