"""What every batch of a stream reads, and what reaches the keyed state."""

from conftest import DATA
from pyspark.sql import functions as F

from ledgerflow.plans import modelling
from ledgerflow.streaming import jobs
from test_streaming import HOUR, START, brute, features, run


def test_batches_read_a_stored_threshold(spark, monkeypatch):
    given, decide = [], jobs.decide_stream

    def seen(payments, fitted, **more):
        given.append(fitted)
        return decide(payments, fitted, **more)

    monkeypatch.setattr(jobs, "decide_stream", seen)
    assert modelling.stream_decisions(spark, DATA).count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "parquet" in plan  # else each batch would take the quantile anew


def test_further_columns_stay_out_of_the_state(spark, tmp_path, monkeypatch):
    rows = [(i, i % 3, START + i * HOUR, float(i), f"m{i % 4}") for i in range(60)]
    wide = spark.sparkContext.accumulator(0)

    class Watched(jobs.Velocity):
        def handleInputRows(self, key, given, timers):
            frames = list(given)
            wide.add(sum("note" in f.columns for f in frames))
            yield from super().handleInputRows(key, iter(frames), timers)

    monkeypatch.setattr(jobs, "Velocity", Watched)
    got = run(spark, [rows[:30], rows[30:]], tmp_path, lambda p: jobs.score_stream(p.withColumn("note", F.lit("x" * 100)), slots=2))
    assert features(got) == brute(rows) and wide.value == 0
