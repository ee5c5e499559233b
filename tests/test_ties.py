"""Ties are settled by a rule, in a query and in its SQL alike."""

import duckdb
from compare import assert_same

from ledgerflow.plans import catalogue


def test_best_order_takes_the_largest_key_of_equal_prices(spark, tmp_path):
    rows = [(k, k % 5, None if k % 5 == 4 else float(k // 50), f"p{k % 3}") for k in range(200)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    for name, ordered in (("up", df.orderBy("o_orderkey")), ("down", df.orderBy(df["o_orderkey"].desc()))):
        ordered.coalesce(1).write.parquet(str(tmp_path / name / "orders.parquet"))
        found = catalogue.QUERIES["best_order"](spark, str(tmp_path / name))
        got = sorted(map(tuple, found.select("o_custkey", "o_orderkey").collect()))
        assert got == [(0, 195), (1, 196), (2, 197), (3, 198), (4, None)]
        con = duckdb.connect()
        con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path / name}/orders.parquet/*.parquet'")
        assert_same(found, con.execute(catalogue.ORACLE_SQL["best_order"]))
