"""Sliding windows and scans against replays: many ties, hot entities, nulls."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import scans, sliding
from ledgerflow.operators import windows as w

ROWS = "transaction_id long, cc_num long, us long, amount double, merchant_name string, operation_type string"


def tied(n=5000):
    """n rows of one card at day 0, n at day 1 and one at day 2, among others."""
    rows = [(k, 1, (k // n) * w.DAY, float(k % 11), f"m{k % 7}" if k < n else f"m{k % 3}", f"t{k % 2}") for k in range(2 * n + 1)]
    return [*rows, (10**6, 2, 0, 5.0, "m1", "t1"), (10**6 + 1, None, 5, 1.0, "m1", "t0")]


def test_any_number_of_ties(spark):
    n = 5000
    df = spark.createDataFrame(tied(n), ROWS)
    out = w.same_counts(w.velocity(w.prepared(df)), (1,))
    out = w.long_spans(w.mean_gap(w.repeats_under(w.depletion(out, "amount", w.DAY), 9.0, 0.5, w.DAY), 1), w.DAY)
    out = w.sudden_large(w.diversity(out, (1,)))
    got = {r["transaction_id"]: r for r in out.collect()}
    assert len(got) == 2 * n + 3
    sizes = [float(k % 11) for k in range(2 * n + 1)]
    for k in (0, 1, n - 1, n, n + 1, 2 * n - 1, 2 * n):
        first = 0 if k < 2 * n else n
        held = sizes[first : k + 1]
        r = got[k]
        assert r["cnt_24h"] == r["span_count"] == len(held) and r["cnt_1h"] == k % n + 1
        assert r["sum_24h"] == pytest.approx(sum(held)) and r["span_sum"] == pytest.approx(sum(held)) and r["mean_24h"] == pytest.approx(statistics.fmean(held))
        assert r["std_24h"] == pytest.approx(statistics.pstdev(held), abs=1e-9)
        key = lambda i: f"m{i % 7}" if i < n else f"m{i % 3}"
        assert r["same_1d"] == sum(key(i) == key(k) for i in range(first, k + 1)) and r["uniq_1d"] == len({key(i) for i in range(first, k + 1)})
        assert r["just_under"] == sum(4.5 <= x < 9 for x in held)
        assert r["depletion"] == (pytest.approx(sum(held) / sizes[first]) if sizes[first] else None)
    assert got[10**6]["cnt_24h"] == 1 and got[10**6 + 1]["cnt_24h"] == 1


def test_buckets_with_ties(spark):
    n = 3000
    out = w.bucketed(spark.createDataFrame(tied(n), ROWS), w.DAY, {"n": w.counted(w.DAY), "s": w.summed("amount", w.DAY), "v": w.deviation("amount", w.DAY)})
    got = {r["transaction_id"]: r for r in out.collect()}
    sizes = [float(k % 11) for k in range(2 * n + 1)]
    for k in (0, n, 2 * n - 1, 2 * n):
        held = sizes[0 if k < 2 * n else n : k + 1]
        assert (got[k]["n"], got[k]["s"]) == (len(held), pytest.approx(sum(held))) and got[k]["v"] == pytest.approx(statistics.pstdev(held), abs=1e-9)


def test_wavelet_levels_against_counting():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        values = rng.integers(0, 20, n)
        upto, bound = rng.integers(0, n + 1, 50), rng.integers(0, 25, 50)
        assert sliding.count_below(values, upto, bound).tolist() == [int((values[:u] < b).sum()) for u, b in zip(upto, bound)]
        low = rng.integers(0, n, 50)
        high = np.array([rng.integers(a + 1, n + 1) for a in low])
        k = np.array([rng.integers(0, b - a) for a, b in zip(low, high)])
        assert sliding.kth_smallest(values, low, high, k).tolist() == [int(np.sort(values[a:b])[x]) for a, b, x in zip(low, high, k)]


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_sliding_against_replay(spark, most, monkeypatch):
    monkeypatch.setattr(sliding._streamed, "__defaults__", (most,))
    rng = random.Random(8)
    rows = [(k, rng.choice([1, 1, 2, 3, None]), rng.randrange(-20, 60) * w.HOUR, rng.choice([None, 1.0, 2.5, -3.0, 7.0]), rng.choice([None, "a", "b", "c"]), "t") for k in range(400)]
    rows += [(k, 9, None, 1.0, "a", "t") for k in (400, 401)]
    measures = {"d": sliding.Distinct("merchant_name", 5 * w.HOUR), "long": sliding.Distinct("merchant_name", 20 * w.HOUR), "q": sliding.Quantile("amount", 0.5, 5 * w.HOUR), "p": sliding.Quantile("amount", 0.9, 20 * w.HOUR)}
    got = {r["transaction_id"]: r for r in sliding.over_windows(spark.createDataFrame(rows, ROWS), measures).collect()}
    assert len(got) == len(rows) and tuple(got[400][c] for c in measures) == (None,) * 4
    for r in rows[:400]:
        seen = [x for x in rows[:400] if x[1] == r[1] and (x[2], x[0]) <= (r[2], r[0])]
        within = lambda h: [x for x in seen if r[2] - x[2] <= h * w.HOUR]  # noqa: B023, E731
        assert got[r[0]]["d"] == len({x[4] for x in within(5)} - {None}) and got[r[0]]["long"] == len({x[4] for x in within(20)} - {None})
        for c, q, h in (("q", 0.5, 5), ("p", 0.9, 20)):
            values = [x[3] for x in within(h) if x[3] is not None]
            assert got[r[0]][c] == (pytest.approx(float(np.quantile(values, q))) if values else None)


def test_sliding_of_a_large_card_is_n_log_n():
    """All rows of a card of 400,000 rows in one window: a set or a sort a row would touch 8e10 rows."""
    took = []
    for n in (100_000, 400_000):
        rng = np.random.default_rng(1)
        first, codes, values = np.zeros(n, dtype=np.int64), rng.integers(0, 5000, n), rng.random(n)
        began = time.perf_counter()
        found = sliding.distinct_in(first, np.zeros(n, dtype=np.int64), codes)
        median, _ = sliding.quantile_in(first, values, np.ones(n, dtype=bool), 0.5)
        took.append(time.perf_counter() - began)
        assert found[-1] == len(np.unique(codes)) and median[-1] == pytest.approx(np.median(values))
    assert took[1] < 20 * took[0] and took[1] < 30


def test_sliding_of_an_empty_table(spark):
    assert sliding.over_windows(spark.createDataFrame([], ROWS), {"d": sliding.Distinct("merchant_name", 5)}).count() == 0


def hot_rows(n=3000):
    """One card holds a third of the rows, another only ties; large amounts with small deviations; nulls."""
    rng = random.Random(3)
    card = lambda k: 1 if k % 3 == 0 else rng.randrange(2, 200)
    rows = [(k, card(k), rng.randrange(500) * w.HOUR, None if k % 50 == 7 else 1e6 + rng.random(), f"m{rng.randrange(5)}", rng.choice(["x", "y", None])) for k in range(n)]
    return [*rows, *((n + k, 500, 0, float(k), "m", "x") for k in range(30)), (n + 99, 7, None, 1.0, "m", "x")]


def test_scans_of_a_hot_card(spark):
    rows = hot_rows()
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, ROWS).withColumn("label", F.expr("CAST(transaction_id % 4 = 0 AS INT)"))
        dealt = scans.blocks(df)
        sizes = sorted(r["count"] for r in dealt.groupBy("__block").count().collect())
        assert len(sizes) > 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert dealt.where("cc_num = 1").select("__block").distinct().count() > 2
        run, risk = ({r["transaction_id"]: r for r in d.collect()} for d in (scans.expanding(df), scans.prior_risk(df, "cc_num", "label")))
        moved, shared = ({r["transaction_id"]: r for r in d.collect()} for d in (scans.transitions(df), scans.shares(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    timed = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0]))
    assert len(run) == len(risk) == len(moved) == len(shared) == len(timed)
    held = {}
    for r in timed:
        past = held.setdefault(r[1], [])
        labels = [int(p[0] % 4 == 0) for p in past]
        moves = [(a[5], b[5]) for a, b in zip(past, past[1:])]
        assert risk[r[0]]["prior_risk"] == pytest.approx(statistics.fmean(labels) if labels else 0.0)
        assert moved[r[0]]["transition_rarity"] == pytest.approx(1 / (moves.count((past[-1][5], r[5])) + 1) if past else 0.0)
        assert shared[r[0]]["key_ratio"] == pytest.approx(sum(p[4] == r[4] for p in past) / (len(past) + 1))
        past.append(r)
        values = [p[3] for p in past if p[3] is not None]
        got = run[r[0]]
        assert got["run_cnt"] == len(values)
        if values:
            std = statistics.stdev(values) if len(values) > 1 else 0.0
            assert got["run_sum"] == pytest.approx(sum(values)) and got["run_mean"] == pytest.approx(statistics.fmean(values)) and got["run_std"] == pytest.approx(std, rel=1e-4, abs=1e-9)
