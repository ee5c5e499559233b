"""Queries named _all, and those without SQL, reach every row of their tables."""

from conftest import DATA
from pyspark.sql import functions as F

from ledgerflow.operators import metrics
from ledgerflow.plans import catalogue, modelling


def test_no_row_is_left_out(spark):
    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem", "customer", "region")}
    n = {t: df.count() for t, df in tables.items()}
    run = lambda name: catalogue.QUERIES[name](spark, DATA)
    total = lambda df, c: df.agg(F.sum(c)).first()[0]
    assert total(run("position_ctr_all"), "n") == n["lineitem"] == modelling._items(spark, DATA).count()
    sessions = tables["lineitem"].groupBy("l_orderkey").count().where("count >= 3").count()
    assert run("ndcg_all").first()["sessions"] == sessions
    assert total(run("daily_rate_all"), "n") == n["orders"]
    assert run("profile_items_all").count() == n["customer"] * n["region"]
    scored = run("profile_features_all")
    profiled = total(scored.join(tables["orders"], F.col("transaction_id") == F.col("o_orderkey")).groupBy(F.col("o_custkey") % 100).agg(F.max("n").alias("n")), "n")
    assert scored.count() + profiled == n["orders"]


def test_group_correlation_takes_all_groups(spark):
    rows = [(g, float(k), float(k if g < 30 else -k)) for g in range(60) for k in range(3)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    assert abs(metrics.group_correlation(df, "g", "a", "b").first()[0]) < 1e-9
    assert metrics.group_correlation(df, "g", "a", "b", 10).first()[0] > 0.99
