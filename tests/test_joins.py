"""Joins against brute force, with hot keys."""

import random
from collections import Counter
from itertools import combinations

from conftest import DATA
from pyspark.sql import functions as F

from ledgerflow.operators import joins as j
from ledgerflow.plans import catalogue


def test_hot_device_keeps_its_links(spark):
    uses = [(1, k) for k in range(620)] + [(2, k) for k in range(0, 620, 7)] + [(3, 5), (4, None), (None, 7), (None, 8), (2, 7)]
    users = {d: {u for e, u in uses if e == d and u is not None} for d in (1, 2, 3)}
    want = Counter(p for held in users.values() for p in combinations(sorted(held), 2))
    df = spark.createDataFrame(uses, "device long, customer long")
    for found in (j.shared_pairs(df, "device", "customer"), j.shared_pairs(df, "device", "customer", block=50)):
        assert {(r["a"], r["b"]): r["shared"] for r in found.collect()} == want


def test_shared_device_all_has_all_customers(spark):
    found = catalogue.QUERIES["shared_device_all"](spark, DATA)
    assert found.where("a % 3 <> 0 OR b % 3 <> 0").count() > 0


def test_cycles_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(8), rng.randrange(8), rng.randrange(-40, 300), k) for k in range(150)]
    e = [x for x in edges if x[0] != x[1]]
    want = sorted((a[3], b[3], c[3]) for a in e for b in e if a[1] == b[0] and b[2] > a[2] for c in e if b[1] == c[0] and c[1] == a[0] and b[2] < c[2] <= a[2] + 30)
    found = j.cycles(spark.createDataFrame(edges, "src long, dst long, us long, o_orderkey long"), 30)
    assert want and sorted(tuple(r) for r in found.collect()) == want


def test_cycles_through_an_account_of_a_third_of_the_edges(spark):
    rng = random.Random(5)
    edges = [(0, rng.randrange(1, 120), rng.randrange(400), k) if k % 6 == 0 else (rng.randrange(1, 120), 0, rng.randrange(400), k) if k % 6 == 3 else (rng.randrange(120), rng.randrange(120), rng.randrange(400), k) for k in range(900)]
    e = [x for x in edges if x[0] != x[1]]
    out = {}
    for x in e:
        out.setdefault(x[0], []).append(x)
    want = sorted((a[3], b[3], c[3]) for a in e for b in out.get(a[1], ()) if a[2] < b[2] <= a[2] + 40 for c in out.get(b[1], ()) if c[1] == a[0] and b[2] < c[2] <= a[2] + 40)
    df = spark.createDataFrame(edges, "src long, dst long, us long, o_orderkey long")
    assert any(0 in (x[0], x[1]) for x in e if x[3] in {w for t in want for w in t})
    for hub in (j.HUB, 0):
        assert sorted(tuple(r) for r in j.cycles(df, 40, hub=hub).collect()) == want
    assert sorted(tuple(r) for r in j.cycles_by_triangles(df, 40, block=3, heavy=20, few=0).collect()) == want


def test_fan_in_out_all_has_all_orders(spark):
    found = catalogue.QUERIES["fan_in_out_all"](spark, DATA)
    orders, lines = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem"))
    pairs = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_suppkey").distinct().count()
    total = found.selectExpr("sum(fan_out)", "sum(fan_in)").first()
    assert tuple(total) == (pairs, pairs)


def test_ranges_that_nest_and_overlap(spark):
    rng = random.Random(4)
    bands = [(a := rng.randrange(-500, 3000), a + rng.choice([0, 1, 3, 64, 500, 2000]), f"b{k}") for k in range(80)]
    bands += [(None, -400, "low"), (2900, None, "high"), (10, 5, "crossed"), (0, 2**40, "wide"), (-(2**60), 2**60, "all but few")]
    values = [*range(-600, 3400, 7), 2**40, 2**40 + 1, 2**60, 2**60 + 1, -(2**61), None]
    far = 2**61
    want = []
    for v in values:
        held = [(hi2 - lo2, lo2, lo, hi, n) for lo, hi, n in bands for lo2, hi2 in [(-far if lo is None else lo, far if hi is None else hi)] if v is not None and lo2 <= v <= hi2]
        want.append((v, min(held, key=lambda h: (h[:2], h[4]))[0] if held else None))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    table = spark.createDataFrame(bands, "lo long, hi long, name string")
    for small in (j.NODES, 0):
        got = [(r["v"], None if r["name"] is None else (far if r["hi"] is None else r["hi"]) - (-far if r["lo"] is None else r["lo"])) for r in j.in_range(df, table, "v", "lo", "hi", small).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert j.in_range(df, table.limit(0), "v", "lo", "hi").where("name IS NOT NULL").count() == 0


def test_a_range_of_any_width_is_few_intervals(spark):
    nodes = j.range_nodes(spark.createDataFrame([(1, 2**60 - 2, "x")], "lo long, hi long, name string"), "lo", "hi", ["name"])
    assert nodes.count() <= 124


def test_addresses(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("1.2.3",), ("1.2.3.256",), (None,)], "a string")
    assert [r[0] for r in df.select(j.ip_number(df["a"])).collect()] == [16909060, 4294967295, None, None, None]


def test_a_task_counts_a_bounded_number_of_pairs(spark):
    uses = spark.range(0, 4000, 1, 2).select((F.col("id") % 20).alias("d"), (F.col("id") * 7919 % 1009).alias("c")).distinct()
    want = uses.alias("l").join(uses.alias("r"), "d").where("l.c < r.c").groupBy("l.c", "r.c").count().toDF("a", "b", "shared")
    found = j.shared_pairs(uses, "d", "c", 40, rows=20_000)
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.sum("shared").alias("n")).collect()]
    assert sum(sizes) == want.agg(F.sum("shared")).first()[0] and max(sizes) <= 30_000
    assert found.exceptAll(want).count() == 0 == want.exceptAll(found).count()
