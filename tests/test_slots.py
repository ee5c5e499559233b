"""Keyed state by slots of cards: few calls for many cards, the features of the batch windows."""

import numpy as np
from pyspark.sql import functions as F

from ledgerflow.streaming import jobs
from test_streaming import DAY, HOUR, START, brute, features, run


def made(n, cards, seed=5):
    """Rows in order of their time, with ties of time, null merchants and amounts of unlike sizes."""
    r = np.random.default_rng(seed)
    hours = np.sort(r.integers(0, 24 * 45 * 4, n)) / 4
    return [(i, int(r.integers(cards)), START + int(h * HOUR), float(10.0 ** int(r.integers(6))), None if i % 13 == 0 else f"m{int(r.integers(6))}") for i, h in enumerate(hours)]


def test_cards_share_calls(spark, tmp_path, monkeypatch):
    rows = made(900, 300)
    calls = spark.sparkContext.accumulator(0)

    class Counted(jobs.Velocity):
        def handleInputRows(self, key, given, timers):
            calls.add(1)
            yield from super().handleInputRows(key, given, timers)

    monkeypatch.setattr(jobs, "Velocity", Counted)
    got = features(run(spark, [rows[:450], rows[450:]], tmp_path, lambda p: jobs.score_stream(p, slots=4)))
    assert got == brute(rows) and 0 < calls.value <= 8  # not one a card and batch


def test_first_meetings_beyond_those_held_together(spark, tmp_path):
    rows = made(120, 3)
    make = lambda p: p.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", "1 hour").withColumn("slot", F.lit(0)).groupBy("slot").transformWithStateInPandas(jobs.Velocity(known=4), jobs.VELOCITY, "append", "eventTime")
    assert features(run(spark, [rows[:40], rows[40:80], rows[80:]], tmp_path, make)) == brute(rows)


def test_rows_without_a_card_are_a_slot(spark, tmp_path):
    big = 2**62 + 1  # a number that a double doesn't hold
    rows = [(1, None, START, 1.0, "a"), (2, big, START, 2.0, "a"), (3, None, START + HOUR, None, None), (4, big, START + 8 * DAY, 4.0, "b")]
    got = run(spark, [rows], tmp_path, lambda p: jobs.score_stream(p, slots=1))
    assert features(got) == brute(rows) and {r["transaction_id"]: r["cc_num"] for r in got} == {1: None, 2: big, 3: None, 4: big}
