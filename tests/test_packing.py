"""Pairs are shuffled as packed bytes, none is lost, and a task's memory is bounded."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from ledgerflow.operators import joins as j
from ledgerflow.operators import packing
from ledgerflow.plans import catalogue


def by_force(uses):
    held = {}
    for d, c in uses:
        held.setdefault(d, set()).add(c)
    return Counter(p for users in held.values() for p in combinations(sorted(users), 2))


def test_a_pair_is_shuffled_in_few_bytes(spark):
    uses = spark.range(0, 60_000, 1, 4).select(F.pmod(F.xxhash64("id"), F.lit(600)).alias("d"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(9000)).alias("c")).distinct()
    sc = spark.sparkContext
    sc.setJobGroup("pairs", "pairs")
    pairs = j.shared_pairs(uses, "d", "c").agg(F.sum("shared")).first()[0]
    stages = {s for job in sc.statusTracker().getJobIdsForGroup("pairs") for s in sc.statusTracker().getJobInfo(job).stageIds}
    sc.setJobGroup("other", "other")
    store = sc._jsc.sc().statusStore()
    sent = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if sc.statusTracker().getStageInfo(s))
    assert pairs > 2_000_000 and 0 < sent < 5 * pairs


@pytest.mark.parametrize("of, kind", [(lambda k: f"u{k}", "string"), (lambda k: k * 3**35 - 2**60, "long"), (lambda k: -7 * k, "int"), (lambda k: k << 24, "long")])
def test_users_of_any_kind(spark, of, kind):
    rng = random.Random(6)
    uses = [(rng.choice(["a", "b", "c"]), of(rng.randrange(90))) for _ in range(250)]
    found = j.shared_pairs(spark.createDataFrame(uses, f"d string, c {kind}"), "d", "c", 20)
    assert {(r["a"], r["b"]): r["shared"] for r in found.collect()} == by_force(uses) and dict(found.dtypes) == {"a": kind.replace("long", "bigint"), "b": kind.replace("long", "bigint"), "shared": "bigint"}
    assert j.shared_pairs(spark.createDataFrame([], f"d string, c {kind}"), "d", "c").collect() == []


def test_the_name_all_is_the_same_query(spark):
    one, other = (catalogue.QUERIES[name] for name in ("shared_device", "shared_device_all"))
    assert one is other and catalogue.ORACLE_SQL["shared_device"] == catalogue.ORACLE_SQL["shared_device_all"]
    plan = other(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "owners" in plan and "REPARTITION_BY_NUM" in plan  # packed pairs, no rows of them


def test_lists_of_a_hot_key_meet_in_many_tasks(spark):
    uses = spark.range(0, 3000, 1, 4).select(F.lit(1).alias("d"), F.col("id").alias("c"))
    found = j.shared_pairs(uses, "d", "c", 100, rows=1 << 17)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "ENSURE_REQUIREMENTS" not in plan.split("SortMergeJoin")[1].split("REPARTITION")[0]
    assert found.agg(F.count("a"), F.sum("shared"), F.min(F.col("b") - F.col("a"))).first() == (3000 * 2999 // 2, 3000 * 2999 // 2, 1)


def batch(rows, *names):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], list(names))


def test_lists_go_on_over_batches():
    rows = sorted([(1, k) for k in range(23)] + [(2, 5), (2, 5), (3, 1)] + [(4, k) for k in range(10)] * 2)
    for size in (1, 2, 7, 100):
        got = [r for b in packing.lists((batch(rows[k : k + size], "d", "c") for k in range(0, len(rows), size)), 10) for r in b.to_pylist()]
        assert [(r["d"], r["c"]) for r in got] == [(1, list(range(10))), (1, list(range(10, 20))), (1, [20, 21, 22]), (2, [5]), (3, [1]), (4, list(range(10)))]


def test_packed_pairs_are_counted_in_bounded_pieces():
    met = pa.RecordBatch.from_arrays([pa.array([[0, 3, 70_000], [1, 2], [0, 3]], pa.list_(pa.int32())), pa.array([None, [4, 5], None], pa.list_(pa.int32()))], ["xs", "ys"])
    sent = [b for k in (1, 1 << 21) for b in packing.packed([met] * 3, 1, 3, most=k)]
    for most in (1, 1 << 21):
        got = Counter({(r["a"], r["b"]): r["shared"] for b in packing.counted(iter(sent), 10, 3, most=most, rows=2) for r in b.to_pylist()})
        assert got == {(10, 13): 12, (10, 70_010): 6, (13, 70_010): 6, (11, 14): 6, (11, 15): 6, (12, 14): 6, (12, 15): 6}
